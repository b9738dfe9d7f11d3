"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Features are single tokens and pairs of successive tokens, hashed to 2**BITS slots, with
their share of the text as value. Tokens are the runs of letters and digits and the runs
of other signs within words, case kept; a token equal to the one before it also counts as
a repeat. Weights come from follow-the-regularised-leader updates (per-coordinate rates, L1
and L2) over a bounded sample of labelled rows, in one pass per epoch in hash order; a
score is a sparse dot product. Only text is ever an input of a score.

`max_rows` bounds the sample: the labelled training rows of least hash. A null or blank
text has no features and gets the bias alone; rows with a null label or doc_id aren't
learned from; a document labelled more than once counts once for each label. Without any
labelled row all scores are 0.5. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm import repeats as R

U = np.uint64
BITS = 18
SCALE = 20.0
#: Bytes of words: letters, digits and all of UTF-8's multi-byte sequences.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of the rows, after one another, and the rows' bounds."""
    space = K.IS_SPACE[data]
    kind = np.where(space, 0, np.where(ALNUM[data], 1, 2)).astype(np.int8)
    start = kind > 0
    end = start.copy()
    if len(data):
        change = kind[1:] != kind[:-1]
        start[1:] &= change
        end[:-1] &= change
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        start[inner] = kind[inner] > 0
        end[inner - 1] = kind[inner - 1] > 0
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    rows = np.searchsorted(starts, offsets)
    prefix = K.POLY_A.prefix(K.BYTE_VALUES[data])
    h = K.mix(K.POLY_A.between(prefix, starts, ends) + (ends - starts).astype(U))
    # Three slots for each token: itself, the pair with the one before, whether it repeats it.
    out = np.empty((len(h), 3), np.int32)
    shift = U(64 - BITS)
    out[:, 0] = h >> shift
    if len(h):
        before = np.concatenate((h[:1], h[:-1]))
        before[rows[:-1][rows[:-1] < len(h)]] = U(1)
        out[:, 1] = K.mix(h ^ K.mix(before)) >> shift
        out[:, 2] = np.where(before == h, 0, 1)
    return out.reshape(-1), rows * 3


class Ftrl:
    """FTRL-proximal for logistic loss; slot 2**BITS is the bias."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def example(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(slots, return_counts=True)
    return np.append(at, 1 << BITS), np.append(n * (SCALE / max(1, len(slots))), 1.0)


def train(epochs: int) -> Callable:
    """One task over the bounded sample: (text, label) rows in order to one row of weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(), []
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            labels = batch.column("label").to_numpy()
            for a, b in K.chunks(offsets):
                slots, rows = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for i in range(b - a):
                    at, x = example(slots[rows[i] : rows[i + 1]])
                    model.learn(at, x, int(labels[a + i]))
                    if epochs > 1:
                        seen.append((at.astype(np.int32), x.astype(np.float32), int(labels[a + i])))
        for _ in range(epochs - 1):
            for at, x, y in seen:
                model.learn(at, x.astype(float), y)
        w = model.weights(np.arange((1 << BITS) + 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, epochs: int = 1) -> np.ndarray:
    """Weights from docs (doc_id, text) and labels (doc_id, label), by a sample of at most
    max_rows labelled rows."""
    h = F.xxhash64(F.lit("quality"), "doc_id")
    chosen = (
        labels.where("doc_id is not null and label is not null").select("doc_id", "label", h.alias("h")).orderBy("h", "doc_id", "label").limit(max_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = sample.repartition(1).sortWithinPartitions("h", "doc_id", "label", "text").select("text", F.col("label").cast("int").alias("label"))
    blob = rows.mapInArrow(train(epochs), "weights binary").first()
    return np.frombuffer(bytes(blob.weights), np.float32) if blob else np.zeros((1 << BITS) + 1, np.float32)


def scores_of(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    data, offsets = K.text_bytes(column)
    out = np.full(len(column), float(weights[-1]))
    for a, b in K.chunks(offsets):
        slots, rows = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        size = np.diff(rows)
        full = size > 0
        if full.any():
            sums = np.add.reduceat(weights[slots].astype(np.float64), rows[:-1][full])
            out[a:b][full] += sums * SCALE / size[full]
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, key, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(scores_of(batch.column("text"), weights))], ["doc_id", "key", "score"]
            )

    return R.keyed(docs).mapInArrow(run, "doc_id long, key long, score double")


def keep(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows, all columns, whose score is at least so high; nothing is shuffled."""
    return R.filtered(docs, lambda texts: scores_of(texts, weights) >= least)


def tokens(text: str) -> list[str]:
    """Plain Python for tests: the tokens of a text."""
    return [m for w in re.findall(r"[^\x20\x09-\x0D]+", text) for m in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff]+", w)]


def brute(examples: list[tuple[str | None, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> dict[int, float]:
    """Plain Python for tests: weights by slot after one pass over texts and labels in order."""
    z: dict[int, float] = {}
    n: dict[int, float] = {}

    def weight(i: int) -> float:
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for text, label in examples:
        data = np.frombuffer((text or "").encode(), np.uint8)
        slots = features(data, np.array([0, len(data)]))[0].tolist()
        x = {i: c * SCALE / max(1, len(slots)) for i, c in Counter(slots).items()} | {1 << BITS: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
        for i, v in x.items():
            g = (p - label) * v
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}
