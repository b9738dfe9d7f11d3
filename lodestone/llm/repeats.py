"""Finding texts' repeated windows without shuffling every window.

A window is a run of `width` units (bytes or words). It is known by its anchor: the least
hash of the `gram`-unit runs in it. Equal windows have equal anchors, so a window stands
twice in the corpus only if its anchor does. Anchors are an order of magnitude rarer
than windows. Each partition makes a count-min sketch of its anchors; sketches are merged
by anchor range, and only windows whose anchor is estimated to repeat travel further. An
estimate is never too low, so no repeated window is lost.

Rows are known by (doc_id, hash of doc_id and text), which equal rows share harmlessly. What
a task holds of a shard is its merged sketch and the compressed blocks that await it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm.common import dealt, parts_for, small_batches

U = np.uint64
#: Place and number of windows of a run.
SPAN = np.dtype([("start", "<i4"), ("count", "<i4")])
CELLS, PROBES, DIRECT = 0, 1, 2
FLUSH = 8 << 20
BLOCK = "shard int, kind int, doc long, key long, blob binary"
BLOCK_PA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("blob", pa.binary())])
#: What a null doc_id counts as.
LAST = (1 << 63) - 1
ROW = np.dtype([("doc", "<i8"), ("key", "<i8")])


class CountMin:
    """Two rows of saturating counters of 32-bit values; estimates are never too low."""

    def __init__(self, bits: int = 22):
        self.bits, self.rows = bits, np.zeros((2, 1 << bits), np.uint8)

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, m = K.mix(v.astype(U)), U((1 << self.bits) - 1)
        return (x & m).astype(np.int64), ((x >> U(32)) & m).astype(np.int64)

    def sparse(self, v: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """The sketch of these values alone, as the distances of the cells that aren't 0."""
        out = {}
        for name, c in zip("ab", self.cells(v), strict=True):
            cell, at = np.unique(c, return_inverse=True)
            out[name] = np.diff(cell, prepend=0).astype(np.uint32)
            out["n" + name] = np.minimum(np.bincount(at, counts), 255).astype(np.uint8)
        return out

    def merge(self, x: dict[str, np.ndarray]) -> None:
        for row, name in zip(self.rows, "ab", strict=True):
            cell = np.cumsum(x[name].astype(np.int64))
            row[cell] = np.minimum(row[cell].astype(np.int32) + x["n" + name], 255)

    def estimate(self, v: np.ndarray) -> np.ndarray:
        a, b = self.cells(v)
        return np.minimum(self.rows[0][a], self.rows[1][b])


def keyed(docs: DataFrame, least: int = 0, whole: bool = False) -> DataFrame:
    """doc_id, text and the row's identity (doc, key); other columns don't travel, or with
    `whole` all but text do as one column `row` instead of doc_id. Rows whose texts have fewer
    than `least` bytes never meet anything; their keys are of their own, so that any number of
    them is spread."""
    small_batches(docs.sparkSession)
    key = F.xxhash64("doc_id", "text")
    if least:
        key = F.when(F.octet_length("text") >= least, key).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    carried = F.struct(*[quoted(c) for c in docs.columns if c.lower() != "text"]).alias("row") if whole else F.col("doc_id")
    return docs.select(carried, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), key.alias("key"))


def quoted(name: str, of: str = "") -> Column:
    """A column whatever its name."""
    return F.col(of + "`" + name.replace("`", "``") + "`")


def unkeyed(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns of whole keyed rows again, and more of the rows' columns."""
    return rows.select(*[F.col("text").alias(c) if c.lower() == "text" else quoted(c, "row.").alias(c) for c in columns], *more)


def filtered(docs: DataFrame, chosen: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, all columns, of which chosen(texts) holds; nothing is shuffled. Columns go by
    place, since names may hold anything."""
    small_batches(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chosen(batch.column(at))))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def identities(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, ROW)
    out["doc"], out["key"] = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
    return out


def shard_of(v: np.ndarray, shards: int) -> np.ndarray:
    return (K.mix(v) % U(shards)).astype(np.uint32)


def units(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each unit, and the rows' bounds in units."""
    if words:
        w = K.Words(data, offsets)
        return w.hashes(), w.rows
    return K.BYTE_VALUES[data], offsets


def anchored(h: np.ndarray, rows: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that stand in some window, and runs of windows: (chosen, anchor, row, start, count)."""
    g, n = width - gram + 1, len(h) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(0, U), z, z, z
    grams = K.POLY_A.windows(h, gram)
    best = K.sliding_min(grams, g)
    ok = K.inside(rows, width, len(h))
    padded = np.zeros(n + 2 * (g - 1), U)
    padded[g - 1 : g - 1 + n] = np.where(ok, best, U(0))
    chosen = grams[(K.sliding_max(padded, g) == grams) & (grams != 0)]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[:n]
    start, end = K.runs_of(best, ok, row)
    at = row[start]
    return chosen, best[start], at, start - rows[at], end - start


def emit(shard: np.ndarray, kind: int, make: Callable[[np.ndarray], bytes], shards: int) -> list[tuple]:
    """One block for each shard: its members in order."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    first, size = K.by_group(shard[order])
    return [(int(shard[order[a]]), kind, 0, 0, make(order[a : a + n])) for a, n in zip(first, size, strict=True)]


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK_PA.types, strict=True)], schema=BLOCK_PA)


def per_row(rows: np.ndarray, records: np.ndarray, shards: int, kind: int = DIRECT) -> pa.RecordBatch:
    """One row for each run of equal identities, which holds its records."""
    first, size = K.by_group(rows)
    some = rows[first]
    shard = shard_of(some["key"].view(U), shards).astype(np.int32)
    columns = [pa.array(shard), pa.array(np.full(len(some), kind, np.int32)), pa.array(some["doc"].copy()), pa.array(some["key"].copy()), K.binaries(records, size)]
    return pa.RecordBatch.from_arrays(columns, schema=BLOCK_PA)


def by_shard(run: Callable) -> Callable:
    """Calls run(batches) for each shard of a partition, whose rows come one shard after another."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for f, n in zip(*K.by_group(shard), strict=True):
                yield int(shard[f]), batch.slice(f, n)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(split(batches), key=lambda x: x[0]):
            yield from run(b for _, b in own)

    return every


def packed_rows(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Identities of successive records: each run once, and how many records it has."""
    first, size = K.by_group(rows)
    return {"doc": rows["doc"][first], "key": rows["key"][first], "rows": size.astype(np.int32)}


def unpacked_rows(x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.empty(len(x["key"]), ROW)
    out["doc"], out["key"] = x["doc"], x["key"]
    return np.repeat(out, x["rows"])


def probe(width: int, gram: int, words: bool, shards: int, bits: int) -> Callable:
    """Map stage: sketches, and the windows to be tested with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = CountMin(bits), [], 0

        def flush():
            chosen, anchor, key, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
            v, n = np.unique(chosen, return_counts=True)
            # 32 bits of an anchor are enough within a shard: others only count too high.
            out = emit(shard_of(v, shards), CELLS, lambda i: K.pack(**sketch.sparse(v[i].astype(np.uint32), n[i])), shards)
            spans = np.empty(len(anchor), SPAN)
            spans["start"], spans["count"] = start, count
            # What repeats within these documents needs no answer from others.
            repeats = np.isin(anchor, v[n > 1])
            if repeats.any():
                yield per_row(key[repeats], spans[repeats], shards)
            anchor, start, count, key = (x[~repeats] for x in (anchor, start, count, key))

            def make(i):
                # starts as distances, which are small
                return K.pack(v=anchor[i].astype(np.uint32), start=np.diff(start[i], prepend=0).astype(np.int32), count=count[i].astype(np.int32), **packed_rows(key[i]))

            out += emit(shard_of(anchor, shards), PROBES, make, shards)
            if out:
                yield to_batch(out)

        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            keys = identities(batch)
            for a, b in K.chunks(offsets):
                h, rows = units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                chosen, anchor, at, start, count = anchored(h, rows, width, gram)
                held.append((chosen, anchor, keys[a:b][at], start, count))
                size += int(offsets[b] - offsets[a])
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def survivors(shards: int, bits: int) -> Callable:
    """Reduce stage: merges the sketches of a shard, then lets through what may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held = CountMin(bits), []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            blobs = batch.column("blob")
            for i in np.flatnonzero(kinds == CELLS):
                sketch.merge(K.unpack(blobs[i].as_py()))
            held += [blobs[i].as_py() for i in np.flatnonzero(kinds == PROBES)]
            if (kinds == DIRECT).any():
                yield batch.filter(pa.array(kinds == DIRECT))
        for blob in held:
            x = K.unpack(blob)
            hit = sketch.estimate(x["v"]) > 1
            if hit.any():
                spans = np.empty(int(hit.sum()), SPAN)
                spans["start"], spans["count"] = np.cumsum(x["start"].astype(np.int64))[hit], x["count"][hit]
                yield per_row(unpacked_rows(x)[hit], spans, shards)

    return by_shard(run)


def repeated_runs(docs: DataFrame, width: int, gram: int, words: bool, mb_per_shard: float, bits: int) -> DataFrame:
    """(doc, key, runs array<binary>): for each keyed row, the runs of windows that may repeat."""
    shards = parts_for(docs, mb_per_shard)
    blocks = docs.select("doc", "key", "text").mapInArrow(probe(width, gram, words, shards, bits), BLOCK)
    hits = dealt(blocks, shards).mapInArrow(survivors(shards, bits), BLOCK)
    return hits.groupBy("doc", "key").agg(F.collect_list("blob").alias("runs"))


def joined_runs(column: pa.Array, at: int) -> np.ndarray:
    """A row's runs in order, each once."""
    packed = np.unique(np.frombuffer(b"".join(column[at].as_py() or ()), "<i8"))
    spans = packed.view(SPAN)
    return spans[np.argsort(spans["start"], kind="stable")]


def anchors_of(h: np.ndarray, starts: np.ndarray, counts: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The anchor of each run of windows."""
    return K.least_between(K.POLY_A.windows(h, gram), starts, starts + counts + width - gram)
