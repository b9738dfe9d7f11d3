"""Near-duplicate documents: MinHash with tensored banding, links verified on full sets.

A document's set: hashes of its distinct five-word shingles (A-Z lower-cased; with fewer
words the whole sequence). Two collections of `m` groups of `r` minhashes each are made;
every pair of a group from the first and one from the second is a table key, so m * m
tables of 2r minhashes cost 2 * m * r minhashes instead of m * m * 2r. Documents of equal
sets are merged first. A first round verifies for each class the partner with which it
shares most tables. A second takes the buckets whose members aren't connected yet: pairs
whose sizes and minhashes allow the threshold span clusters, and within clusters every
such pair that links found before don't connect is verified where its sets meet. Links count if
100 * intersection >= 75 * union of the whole sets. At the threshold itself a link shares
no table, or too few minhashes, with probability about 1e-4; above it, much less.

Within a cluster the members of its largest component never meet each other: the rest, in blocks
of per_block, meets it and itself, so copies of sets grow with the blocks of the rest alone.
A shingle is known by a 64-bit hash, a document's whole set by two sums of independent ones.

Null and blank texts have empty sets and link with nothing. A null doc_id comes after all
others and gives a null component unless a document with an id is linked. Of a group the
row of least doc_id, then least hash of doc_id and text, is kept; rows equal in both are
kept alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm import repeats as R
from lodestone.llm.common import PARTS, dealt, dropped, parts_for, saved
from lodestone.llm.graph import Forest, components

U = np.uint64
LAST = R.LAST
M, RANGE = 12, 2
#: Of the 2 * M * RANGE minhashes, so many agree in all but 1e-5 of pairs at 0.75.
AGREE = 22


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    w = K.Words(K.LOWER[data], offsets)
    h = w.hashes()
    all_ = K.POLY_A.windows(h, width)
    prefix = K.POLY_B.prefix(h)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(w.rows[i]), int(w.rows[i + 1])
        if b - a >= width:
            x = np.sort(all_[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(K.mix((prefix[b : b + 1] - prefix[a : a + 1]) * K.POLY_B.down[a : a + 1] + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def signatures(width: int) -> Callable:
    """Map stage: (key, doc, n, f1, f2, sig) of each row; f1 and f2 tell sets apart."""
    n_hash = 2 * M * RANGE
    salt, odd = K.splitmix(n_hash, 77), K.splitmix(n_hash, 78) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            n, f1, f2, sig = [], [], [], []
            for a, b in K.chunks(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                size = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets)
                full = size > 0
                first = (np.cumsum(size) - size)[full]
                sums = np.zeros((2, len(size)), U)
                part = np.zeros((len(size), n_hash), np.uint32)
                if len(flat):
                    sums[0, full] = np.add.reduceat(K.mix(flat ^ U(0x51ED270B)), first)
                    sums[1, full] = np.add.reduceat(K.mix(flat ^ U(0xA5CB9243F0AE)), first)
                    for k in range(n_hash):
                        part[full, k] = np.minimum.reduceat((flat ^ salt[k]) * odd[k], first) >> U(32)
                n.append(size), f1.append(sums[0]), f2.append(sums[1]), sig.append(part)
            z = np.concatenate
            if not n:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("doc"), pa.array(z(n)), pa.array(z(f1).view(np.int64)), pa.array(z(f2).view(np.int64)),
                    K.binaries(z(sig).reshape(-1), np.full(batch.num_rows, n_hash)),
                ],
                ["key", "doc", "n", "f1", "f2", "sig"],
            )

    return run


def table_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of all tables of each row: a group of the first collection with one of the second."""
    groups = sig.reshape(len(sig), 2 * M, RANGE).astype(U)
    h = np.zeros((len(sig), 2 * M), U)
    for r in range(RANGE):
        h = K.mix(h * U(0x9E3779B97F4A7C15) + groups[:, :, r] + U(r + 1))
    left, right = h[:, :M, None], h[:, None, M:]
    return K.mix(left ^ (right * U(0xD1342543DE82EF95)) ^ K.splitmix(M * M, 99).reshape(1, M, M)).reshape(len(sig), M * M)


def spread(shards: int) -> Callable:
    """Map stage: table keys by shard, with the place of their class in the block's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                cid = part.column("cid").to_numpy()
                keys = table_keys(np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(len(cid), -1))
                at = np.repeat(np.arange(len(cid), dtype=np.uint16), keys.shape[1])
                flat = keys.reshape(-1)

                def make(i):
                    # of the classes only those that the shard gets keys of
                    some, place = np.unique(at[i], return_inverse=True)
                    return K.pack(key=flat[i], at=place.astype(np.uint16), cid=cid[some])

                yield R.to_batch(R.emit(R.shard_of(flat, shards), R.PROBES, make, shards))

    return run


PAIRS = "kind int, a long, b long, n long"


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce stage: members (kind 0: bucket, cid) of buckets of two or more, and for each
    class its buckets' least members with the number of tables shared (kind 1)."""
    keys, cids = [], []
    for batch in batches:
        for blob in batch.column("blob"):
            x = K.unpack(blob.as_py())
            keys.append(x["key"])
            cids.append(x["cid"][x["at"]])
    if not keys:
        return
    key, cid = np.concatenate(keys), np.concatenate(cids)
    del keys, cids
    order = np.argsort(key)
    key, cid = key[order], cid[order]
    first, size = K.by_group(key)
    many = np.repeat(size > 1, size)
    key, cid = key[many], cid[many]
    if not len(key):
        return
    order = np.lexsort((cid, key))
    key, cid = key[order], cid[order]
    first, size = K.by_group(key)
    # Buckets of the same members count as one.
    mark = np.add.reduceat(K.mix(cid.astype(U)), first) + size.astype(U)
    _, one, times = np.unique(mark, return_index=True, return_counts=True)
    pick = K.ranges(first[one], size[one])
    key, cid, weight = key[pick], cid[pick], np.repeat(times, size[one])
    first, size = K.by_group(key)
    least = np.repeat(cid[first], size)
    other = cid != least
    pair = np.stack([cid[other], least[other]], 1)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    pair, weight = pair[order], weight[other][order]
    new = np.concatenate(([True], (pair[1:] != pair[:-1]).any(1)))
    at = np.flatnonzero(new)
    total = np.add.reduceat(weight, at)
    for kind, a, b, n in ((0, key.view(np.int64), cid, np.zeros(len(cid), np.int64)), (1, pair[at, 0], pair[at, 1], total)):
        for i in range(0, len(a), 100_000):
            x = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a[x]), kind, np.int32)), pa.array(a[x]), pa.array(b[x]), pa.array(n[x])], ["kind", "a", "b", "n"]
            )


def sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= 75 * np.maximum(a, b)


def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a partition's candidate components: those of pairs of a bucket in
    different components that sizes and minhashes allow to be linked. Members of the bucket's
    largest component are compared with the others only."""
    found = Forest()
    for t in K.whole_groups(batches, ["bucket"]):
        bucket, cid, comp, n = (t.column(c).to_numpy() for c in ("bucket", "cid", "component", "n"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(cid), -1)
        for f, size in zip(*K.by_group(bucket), strict=True):
            _, label, times = np.unique(comp[f : f + size], return_inverse=True, return_counts=True)
            # the largest component last: those before it meet it, it doesn't meet itself
            order = f + np.argsort(label == times.argmax(), kind="stable")
            rest = int(size - times.max())
            for i in range(0, rest, 64):
                x = order[i : min(i + 64, rest)]
                for j in range(i, int(size), 1 << 14):
                    y = order[j : j + (1 << 14)]
                    p, q = np.nonzero((comp[x, None] != comp[None, y]) & sizes_allow(n[x, None], n[None, y]))
                    keep = q + j > p + i
                    u, v = x[p[keep]], y[q[keep]]
                    for s in range(0, len(u), 1 << 16):
                        g, h = u[s : s + (1 << 16)], v[s : s + (1 << 16)]
                        hit = (sig[g] == sig[h]).sum(1) >= AGREE
                        if hit.any():
                            found.add(comp[g[hit]], comp[h[hit]])
    yield from found.batches()


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components within a block of a candidate cluster, or between two: every
    allowed pair is tested on whole sets unless links found before connect it."""
    for t in K.whole_groups(batches, ["cluster", "low", "high"]):
        keys = np.stack([t.column(c).to_numpy() for c in ("cluster", "low", "high")], 1)
        cid, comp, n, block = (t.column(c).to_numpy() for c in ("cid", "component", "n", "block"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(cid), -1)
        items = t.column("items")
        cut = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(cid)]))
        out = []
        for f, e in zip(cut[:-1], cut[1:], strict=True):
            sets = [np.frombuffer(items[int(i)].as_buffer(), U) for i in range(f, e)]
            _, label = np.unique(comp[f:e], return_inverse=True)
            inner = keys[f, 1] == keys[f, 2]
            here = np.arange(e - f)
            for i in range(e - f):
                others = here[i + 1 :] if inner else here[block[f:e] == keys[f, 2]]
                if not inner and block[f + i] != keys[f, 1]:
                    continue
                others = others[(label[others] != label[i]) & sizes_allow(n[f:e][others], n[f + i])]
                others = others[(sig[f:e][others] == sig[f + i]).sum(1) >= AGREE]
                while len(others):
                    part, others = others[:64], others[64:]
                    flat = np.concatenate([sets[j] for j in part])
                    size = np.array([len(sets[j]) for j in part])
                    mine = sets[i]
                    found = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    both = np.add.reduceat(found.astype(np.int64), np.cumsum(size) - size)
                    for j in part[100 * both >= 75 * (size + len(mine) - both)]:
                        if label[j] != label[i]:
                            out.append((cid[f + i], cid[f + j]))
                            label[label == label[j]] = label[i]
                    others = others[label[others] != label[i]]
        if out:
            x = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def full_sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for a, b in K.chunks(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                blobs = K.binaries(np.concatenate(sets), np.array([len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(a, b - a), blobs], ["cid", "items"])

    return run


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets reach the threshold."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = np.frombuffer(x[i].as_buffer(), U), np.frombuffer(y[i].as_buffer(), U)
            z = np.concatenate((a, b))
            z.sort(kind="stable")
            both = int((z[1:] == z[:-1]).sum())
            ok[i] = 100 * both >= 75 * (len(a) + len(b) - both)
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], ["a", "b"])


def sets_of(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cid, items): whole sets of classes (cid, doc, key), from the texts again."""
    texts = docs.join(wanted.hint("shuffle_hash"), ["doc", "key"]).select("cid", "text")
    return texts.mapInArrow(full_sets(width), "cid long, items binary").dropDuplicates(["cid"])


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Of pairs (a, b) of classes, those that are links."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "doc", "key"), "cid")
    sets = saved(sets_of(wanted, docs, width), "near-sets")
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    links = saved(both.mapInArrow(linked, "a long, b long"), "near-links")
    dropped(sets)
    return links


def settled(forest: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, shards: int, per_block: int) -> DataFrame:
    """Links of candidate clusters, which the forest joins of components, among the members
    (cid, component) of open buckets. Members of a cluster's largest
    component and the rest are cut into blocks of per_block, -1, -2, ... and 0, 1, ...; each two
    blocks of which one at least is of the rest are a task of their own."""
    found = components(forest, "near-forest", thin=True)
    clusters = found.select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    known = saved(members.join(clusters, "component").select("cluster", "cid", "component"), "near-clusters")
    dropped(found)
    per = known.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    sized = per.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("members"), F.count("*").alias("kinds"))
    cut = lambda n: F.ceil(n / F.lit(per_block)).cast("int")
    sized = saved(
        sized.where("kinds > 1").select("cluster", F.col("main.component").alias("main"), cut(F.col("main.n")).alias("mains"), cut(F.col("members") - F.col("main.n")).alias("rests")),
        "near-clusters",
    )
    sets = sets_of(known.join(sized.select("cluster"), "cluster", "left_semi").join(classes.select("cid", "doc", "key"), "cid").select("cid", "doc", "key"), docs, width)
    numbers = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    is_main = F.col("component") == F.col("main")
    hashed = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    rest_blocks = numbers(F.lit(0), F.col("rests") - 1)
    rows = (
        known.join(sized, "cluster")
        .withColumn("block", F.when(is_main, -1 - hashed(F.col("mains"))).otherwise(hashed(F.col("rests"))))
        .withColumn("others", F.when(is_main, rest_blocks).otherwise(F.concat(rest_blocks, F.sequence(-F.col("mains"), F.lit(-1)))))
        .join(classes.select("cid", "n", "sig"), "cid")
        .join(sets, "cid")
        .withColumn("other", F.explode("others"))
        .select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "component", "n", "sig", "items")
    )
    dealt_ = rows.repartition(shards, "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "cid")
    links = saved(dealt_.mapInArrow(settle, "a long, b long"), "near-links")
    dropped(known, sized)
    return links


def group(docs: DataFrame, width: int = 5, per_block: int = 512) -> DataFrame:
    """(doc_id, doc, key, n_shingles, component_id, kept) for every row of docs (doc_id, text);
    doc and key as R.keyed gives them."""
    docs = R.keyed(docs)
    sigs = saved(
        docs.select("doc", "key", "text").mapInArrow(signatures(width), "key long, doc long, n long, f1 long, f2 long, sig binary"), "near-signatures"
    )
    classes = saved(
        sigs.where("n > 0").groupBy("f1", "f2").agg(
            F.min(F.struct("doc", "key")).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")
        ).select("f1", "f2", "n", "sig", "least", F.col("least.doc").alias("doc"), F.col("least.key").alias("key"), F.monotonically_increasing_id().alias("cid")),
        "near-classes",
    )
    shards = parts_for(docs, 20)
    parts = min(shards, PARTS)
    blocks = classes.select("cid", "sig").mapInArrow(spread(shards), R.BLOCK)
    found = saved(dealt(blocks, shards).mapInArrow(R.by_shard(buckets), PAIRS), "near-buckets")

    best = found.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = best.groupBy("a").agg(F.max(F.struct("n", -F.col("b"))).alias("x")).select("a", (-F.col("x.col2")).alias("b"))
    best = saved(best, "near-best")
    links = verified(best, classes, docs, width)
    dropped(best)

    first = components(links, "near-components")
    part = first.withColumnRenamed("node", "cid")
    members = found.where("kind = 0").select(F.col("a").alias("bucket"), F.col("b").alias("cid"))
    placed = members.join(part, "cid", "left").select("bucket", "cid", F.coalesce("component", "cid").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q")
    open_ = saved(placed.join(mixed.select("bucket"), "bucket"), "near-open")
    forest = (
        open_.join(classes.select("cid", "n", "sig"), "cid")
        .select("bucket", "cid", "component", "n", "sig")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "cid")
        .mapInArrow(apart, "a long, b long")
    )
    members = open_.select("cid", "component").distinct()
    more = settled(forest, members, classes, docs, width, parts, per_block)
    part = components(links.unionByName(more), "near-components").withColumnRenamed("node", "cid")
    dropped(found, first, open_, links, more)

    owner = classes.select("f1", "f2", "cid", "least").join(part, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # Written, so that the join of a large component is dealt by its own, splittable shuffle.
    firsts = saved(owner.groupBy("component").agg(F.min("least").alias("first")), "near-firsts")
    ids = owner.join(firsts, "component").select("f1", "f2", "first")
    out = sigs.select("key", "doc", "n", "f1", "f2").join(ids, ["f1", "f2"], "left")
    own = F.struct("doc", "key")
    out = out.withColumn("first", F.when(F.col("n") > 0, F.col("first")).otherwise(own))
    some = lambda c: F.when(c != LAST, c)
    return out.select(
        some(F.col("doc")).alias("doc_id"), "doc", "key", F.col("n").alias("n_shingles"), some(F.col("first.doc")).alias("component_id"), (F.col("first") == own).alias("kept")
    )


def keep(docs: DataFrame, width: int = 5) -> DataFrame:
    """All columns of the rows that group() keeps; of rows equal in doc_id and text one."""
    kept = group(docs, width).where("kept").select("doc", "key").distinct()
    rows = R.keyed(docs, whole=True).join(kept, ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"])
    return R.unkeyed(rows, docs.columns)


def brute(docs: list[tuple[int, str | None]], width: int = 5) -> dict[int, tuple[int, int]]:
    """Plain Python for tests: doc_id to (n_shingles, component_id)."""
    import re

    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets: dict[int, set] = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holds: dict[tuple, list[int]] = {}
    for d in sorted(sets):
        near: dict[int, int] = {}
        for s in sets[d]:
            for o in holds.get(s, ()):
                near[o] = near.get(o, 0) + 1
            holds.setdefault(s, []).append(d)
        for o, n in near.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}
