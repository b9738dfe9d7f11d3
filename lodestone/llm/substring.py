"""Repeated word windows: a count-min prefilter, then exact groups of what it lets through.

Words are `[^\\x20\\x09-\\x0D]+` of whole texts. Every word that a window of `width` words
covers is removed if the window's word sequence starts anywhere else too, in the same
document or another. Windows are judged on the input. The first pass (repeats.py)
overestimates counts; the second groups the remaining windows by their words, known by two
64-bit fingerprints that are made of two independent hashes of each word, and groups of two
or more are repeated.

Null and blank texts have no words; a null doc_id is an ordinary row; equal rows repeat
each other; texts of fewer words than a window lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone.llm import kernels as K
from lodestone.llm import repeats as R
from lodestone.llm.common import dealt, parts_for

U = np.uint64
SPAN = R.SPAN


def spans_from(starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of successive starts within a group, as SPANs with their groups."""
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(first), SPAN)
    out["start"], out["count"] = starts[first], np.diff(np.append(first, len(starts)))
    return out, group[first]


def fingerprints(width: int, gram: int, shards: int) -> Callable:
    """Map stage: 128-bit fingerprints of the windows that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            anchor, h1, h2, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            # Windows that repeat here are known; one of each group goes on for the others.
            known = np.zeros(len(h1), bool)
            known[order] = np.repeat(times > 1, times)
            if known.any():
                i = np.flatnonzero(known)
                spans, of = spans_from(start[i], key[i])
                yield R.per_row(of, spans, shards)
            sent = np.sort(order[first])
            shard = R.shard_of(anchor[sent], shards)
            twice = known[sent]

            def make(i):
                j = sent[i]
                return K.pack(h1=h1[j], h2=h2[j], start=np.diff(start[j], prepend=0).astype(np.int32), twice=twice[i], **R.packed_rows(key[j]))

            out = R.emit(shard, R.PROBES, make, shards)
            if out:
                yield R.to_batch(out)

        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            keys, runs = R.identities(batch), batch.column("runs")
            for a, b in K.chunks(offsets):
                words = K.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = words.rows
                h, other = words.both_hashes()
                w1, w2 = K.POLY_A.windows(h, width), K.POLY_B.windows(other, width)
                for i in range(a, b):
                    r = R.joined_runs(runs, i)
                    first = r["start"] + rows[i - a]
                    anchor = R.anchors_of(h[rows[i - a] : rows[i - a + 1]], r["start"].astype(np.int64), r["count"], width, gram)
                    at = K.ranges(first, r["count"])
                    held.append((np.repeat(anchor, r["count"]), w1[at], w2[at], np.full(len(at), keys[i], R.ROW), at - rows[i - a]))
                    size += len(at)
                if size >= 400_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def groups(shards: int) -> Callable:
    """Reduce stage: exact groups; members of groups of two or more are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for i in np.flatnonzero(kinds == R.PROBES):
                x = K.unpack(batch.column("blob")[i].as_py())
                held.append(x | {"key": R.unpacked_rows(x), "start": np.cumsum(x["start"].astype(np.int64))})
            if (kinds == R.DIRECT).any():
                yield batch.filter(pa.array(kinds == R.DIRECT))
        if not held:
            return
        h1, h2, key, start, twice = (np.concatenate([x[k] for x in held]) for k in ("h1", "h2", "key", "start", "twice"))
        del held
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        times = np.diff(np.append(first, len(order)))
        total = np.add.reduceat(1 + twice[order].astype(np.int64), first)
        hit = np.zeros(len(h1), bool)
        hit[order] = np.repeat(total > 1, times)
        hit &= ~twice
        if hit.any():
            i = np.flatnonzero(hit)
            spans, of = spans_from(start[i], key[i])
            yield R.per_row(of, spans, shards)

    return R.by_shard(run)


def kept_words(data: np.ndarray, w: K.Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that stay, each followed by one space but for the last of a row; row bounds."""
    stay = np.flatnonzero(~gone)
    n = len(data)
    change = np.zeros(n + 2, np.int8)
    change[w.starts[stay]] += 1
    ends = w.ends[stay] + 1  # with the separator
    # a word that ends its row has none
    last = np.isin(w.ends[stay], w.offsets[1:])
    ends[last] -= 1
    change[ends] -= 1
    mask = np.cumsum(change[:n], dtype=np.int8) > 0
    out = data[mask].copy()
    out[K.IS_SPACE[out]] = 32
    size = np.concatenate(([0], np.cumsum(mask)))
    return out, size[w.offsets]


def finish(width: int, carried: str, texts: bool, originals: bool = False) -> Callable:
    """Each row's counts and what is left of its text, or the SHA-256 of that; with `originals`
    texts that lose nothing stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            spans = batch.column("spans")
            for a, b in K.chunks(offsets, 4 * K.CHUNK):
                part = data[offsets[a] : offsets[b]]
                w = K.Words(part, offsets[a : b + 1] - offsets[a])
                starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in range(a, b):
                    if (s := spans[i].as_py()) is not None:
                        s = np.frombuffer(b"".join(s), SPAN)
                        starts.append(s["start"] + w.rows[i - a])
                        ends.append(s["start"] + s["count"] + width - 1 + w.rows[i - a])
                gone = K.covered(np.concatenate(starts), np.concatenate(ends), len(w))
                total = np.concatenate(([0], np.cumsum(gone)))
                n_words, n_removed = np.diff(w.rows), np.diff(total[w.rows])
                kept, bounds = kept_words(part, w, gone)
                raw, out = kept.tobytes(), []
                for i in range(b - a):
                    one = raw[bounds[i] : bounds[i + 1]]
                    one = one[:-1] if one.endswith(b" ") else one
                    out.append(one.decode() if texts else hashlib.sha256(one).hexdigest())
                left = pa.array(out, pa.string())
                if originals:
                    left = pc.if_else(pa.array(n_removed > 0), left, batch.column("text").slice(a, b - a))
                columns = [batch.column(carried).slice(a, b - a), pa.array(n_words), pa.array(n_removed), left]
                yield pa.RecordBatch.from_arrays(columns, [carried, "n_words", "n_removed", "text" if originals else "kept"])

    return run


def with_spans(docs: DataFrame, width: int, gram: int, carried: str) -> DataFrame:
    """Keyed docs with the spans (array<binary>, null: none) of their repeated windows."""
    runs = R.repeated_runs(docs, width, gram, True, mb_per_shard=64, bits=22)
    shards = parts_for(docs, 20)
    # The same columns as in the last join, none left out, so that both share one shuffle of the texts.
    found = docs.join(runs.hint("shuffle_hash"), ["doc", "key"]).select(carried, "doc", "key", "text", "runs")
    blocks = found.mapInArrow(fingerprints(width, gram, shards), R.BLOCK)
    hits = dealt(blocks, shards).mapInArrow(groups(shards), R.BLOCK)
    spans = hits.groupBy("doc", "key").agg(F.collect_list("blob").alias("spans"))
    return docs.join(spans.hint("shuffle_hash"), ["doc", "key"], "left").select(carried, "text", "spans")


def remove_repeats(docs: DataFrame, width: int = 35, gram: int = 8, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, or with texts=False
    their SHA-256 in hex."""
    docs = R.keyed(docs, 2 * width - 1).withColumn("doc_id", F.col("doc_id").cast("long"))
    both = with_spans(docs, width, gram, "doc_id")
    return both.mapInArrow(finish(width, "doc_id", texts), "doc_id long, n_words long, n_removed long, kept string")


def cut(docs: DataFrame, n_words: str = "n_words", n_removed: str = "n_removed", width: int = 35, gram: int = 8) -> DataFrame:
    """All rows and columns; texts that lose words are what remove_repeats keeps of them. Two
    more columns of the given names tell how many words there were and how many went."""
    keyed = R.keyed(docs, 2 * width - 1, whole=True)
    kind = StructType([keyed.schema["row"], *(StructField(c, LongType()) for c in ("n_words", "n_removed")), StructField("text", StringType())])
    out = with_spans(keyed, width, gram, "row").mapInArrow(finish(width, "row", True, originals=True), kind)
    return R.unkeyed(out, docs.columns, F.col("n_words").alias(n_words), F.col("n_removed").alias(n_removed))


def brute(texts: list[str | None], width: int) -> list[tuple[int, int, str]]:
    """Plain Python for tests: (n_words, n_removed, kept text) of each document."""
    import re
    from collections import Counter

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out
