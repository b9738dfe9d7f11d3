"""Near-duplicate vectors by dual traversal of cover trees: exactly the pairs of cosine at
or above a threshold.

On unit vectors the cosine bounds the chord: cos >= c means a distance of at most
sqrt(2 - 2c). Vectors are dealt to cells, that of the nearest pivot of a sample's cover tree;
there are the more pivots the more vectors, and a popular cell makes more blocks, not larger
ones. Every block of about BLOCK bytes gets a cover tree: nested levels of centres with halving
radii until a node holds few points, equal points, or points that a level no longer thins
out. Each node knows the distance to its furthest point. Neighbouring blocks form groups of
at most GROUP. Pairs of groups, of blocks and of nodes are descended together and end where

* both covering radii and the threshold don't reach (no pair is a link), or
* the threshold reaches across both radii (all pairs are links: sizes are added to the counts
  and one edge joins the two sides), or
* two leaves meet: their points are compared by a matrix product, and what single precision
  can't decide in double.

A task gets two groups, each block once. It emits link counts and a spanning forest, never
the pairs. Vectors are scaled by powers of two before norms, so finite components of any size
count.

Vectors that are null, empty or zero, or hold null or non-finite components, link with
nothing; vectors of different dimensions don't link. Rows of equal vec_id are vectors of
their own. A null vec_id comes after all others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernels as K
from lodestone.llm.common import dropped, saved
from lodestone.llm.graph import components, settled, union

LAST = (1 << 63) - 1
#: Bytes of a block's vectors in single precision, blocks of a group, points of a leaf.
BLOCK, GROUP, LEAF = 2 << 20, 16, 256
#: Bytes of pivots that are broadcast; beyond them cells get more blocks.
PIVOTS = 32 << 20
EDGES = 1 << 18
#: Most partitions of a shuffle; each does its blocks or pairs one after another.
PARTS = 20_000


def error(dim: int) -> float:
    """Bound of the error of a dot product of unit vectors in single precision."""
    return 2.4e-7 * max(16, dim)


def slack(dim: int) -> float:
    """Bound of the error of three chords added up."""
    return 3 * float(np.sqrt(2 * error(dim)))


def chord(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))


def scaled(x: np.ndarray) -> np.ndarray:
    """In double precision, each vector times a power of two, which is exact."""
    x = x.astype(np.float64)
    _, e = np.frexp(np.abs(x).max(1, initial=0.0))
    return np.ldexp(x, -e[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def net(x: np.ndarray, radius: float, most: int | None = None, batch: int = 256) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres no two of which are within the radius, and each point's centre (its rank).
    None if there are more than `most`, or, without it, if most points are centres."""
    n = len(x)
    owner = np.full(n, -1)
    centres: list[int] = []
    rest = np.arange(n)
    least = 1.0 - radius * radius / 2.0
    while len(rest):
        head, rest = rest[:batch], rest[batch:]
        near = x[head] @ x[head].T >= least
        new = []
        for i in range(len(head)):
            if owner[head[i]] < 0:
                mine = near[i] & (owner[head] < 0)
                mine[i] = True
                owner[head[mine]] = len(centres)
                centres.append(int(head[i]))
                new.append(int(head[i]))
        if len(rest):
            d = x[rest] @ x[new].T
            best = d.argmax(1)
            hit = d[np.arange(len(rest)), best] >= least
            owner[rest[hit]] = len(centres) - len(new) + best[hit]
            rest = rest[~hit]
        done = n - len(rest)
        if len(centres) > (done // 2 if most is None and done >= 512 else n if most is None else most):
            return None
    return np.array(centres, np.int64), owner


class CoverTree:
    """Nodes by number: range of points in `order`, covering radius, first child and number of
    children (0: a leaf). The first point of a range is the node's centre, and the first
    child's too, so levels are nested. Node 0 is the root; children follow their parent."""

    FIELDS = ("start", "end", "radius", "child", "children")

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        if len(x):
            middle = int((x @ x.mean(0)).argmax())
            self.order[[0, middle]] = middle, 0
        start, end, radius, child, children = [0], [len(x)], [0.0], [0], [0]
        least = slack(x.shape[1])
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            mine = self.order[a:b]
            radius[at] = float(chord(x[mine] @ x[mine[0]]).max(initial=0.0))
            parts = None
            if b - a > LEAF and radius[at] > least:
                r = 2.0 ** np.ceil(np.log2(radius[at]) - 1)
                while (parts := net(x[mine], r)) is not None and len(parts[0]) == 1 and r > least:
                    r /= 2
            if parts is not None and len(parts[0]) > 1:
                c, owner = parts
                self.order[a:b] = mine[np.argsort(owner, kind="stable")]
                cut = a + np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(c)))))
                child[at], children[at] = len(start), len(c)
                start += cut[:-1].tolist()
                end += cut[1:].tolist()
                for column in (radius, child, children):
                    column += [0] * len(c)
            at += 1
        self.start, self.end, self.child, self.children = (np.array(c, np.int64) for c in (start, end, child, children))
        self.radius = np.array(radius, np.float32)


class Side:
    """The blocks of a group: vectors in tree order after one another, and their trees."""

    def __init__(self, blobs: list[bytes], rows: int):
        z = [K.unpack(b) for b in blobs]
        self.trees = z
        self.rows = np.concatenate([x["row"] for x in z])
        self.raw = [x["x"].reshape(len(x["row"]), -1) for x in z]
        self.unit = [unit(x) for x in self.raw]
        self.at = rows + np.concatenate(([0], np.cumsum([len(x) for x in self.raw])))


def dual(a: dict, xa: np.ndarray, ra: np.ndarray, b: dict, xb: np.ndarray, rb: np.ndarray, threshold: float, same: bool):
    """(kind, ...) of two blocks: ("whole", node pairs) all of whose points link, and ("some",
    places of a, places of b), links found by comparing leaves."""
    reach, dim = float(chord(np.array(threshold))), xa.shape[1]
    off, wrong = slack(dim), error(dim)
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(p):
        more_p, more_q = [], []
        for s in range(0, len(p), 1 << 17):
            i, j = p[s : s + (1 << 17)], q[s : s + (1 << 17)]
            d = chord(np.einsum("ij,ij->i", xa[a["start"][i]], xb[b["start"][j]]))
            if same:
                d[i == j] = 0.0
            wide = a["radius"][i] + b["radius"][j]
            whole = d + wide <= reach - off
            if whole.any():
                yield "whole", i[whole], j[whole]
            open_ = ~whole & (d - wide <= reach + off)
            i, j = i[open_], j[open_]
            leaf_i, leaf_j = a["children"][i] == 0, b["children"][j] == 0
            done = leaf_i & leaf_j
            leaves.append((i[done], j[done]))
            i, j, leaf_i, leaf_j = i[~done], j[~done], leaf_i[~done], leaf_j[~done]
            self_ = (i == j) if same else np.zeros(len(i), bool)
            left = ~self_ & ~leaf_i & (leaf_j | (a["radius"][i] >= b["radius"][j]))
            for down, left_side in ((left, True), (~left & ~self_, False)):
                if down.any():
                    side, node = (a, i[down]) if left_side else (b, j[down])
                    n = side["children"][node]
                    kids = K.ranges(side["child"][node], n)
                    other = np.repeat((j if left_side else i)[down], n)
                    more_p.append(kids if left_side else other)
                    more_q.append(other if left_side else kids)
            for node in i[self_].tolist():
                kids = np.arange(a["child"][node], a["child"][node] + a["children"][node])
                u, v = np.triu_indices(len(kids))
                more_p.append(kids[u])
                more_q.append(kids[v])
        p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (more_p, more_q))
    i, j = (np.concatenate([x[k] for x in leaves]) for k in (0, 1))
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for f, n in zip(*K.by_group(i), strict=True):
        s, e = int(a["start"][i[f]]), int(a["end"][i[f]])
        mine = j[f : f + n]
        size = b["end"][mine] - b["start"][mine]
        right = K.ranges(b["start"][mine], size)
        for c in range(0, len(right), 2048):
            at = right[c : c + 2048]
            near = xb[at].T if n > 1 else xb[at[0] : at[-1] + 1].T
            for s2 in range(s, e, 2048):
                e2 = min(e, s2 + 2048)
                if same and n == 1 and at[-1] < s2:
                    continue
                dots = xa[s2:e2] @ near
                u, v = np.divmod(np.flatnonzero(dots.reshape(-1) >= np.float32(threshold - wrong)), len(at))
                if not len(u):
                    continue
                sure = dots[u, v] >= threshold + wrong
                u, v = u + s2, at[v]
                if same:
                    keep = u < v
                    u, v, sure = u[keep], v[keep], sure[keep]
                test = np.flatnonzero(~sure)
                for t in range(0, len(test), 1 << 15):
                    k = test[t : t + (1 << 15)]
                    y, z = scaled(ra[u[k]]), scaled(rb[v[k]])
                    norms = np.sqrt(np.einsum("ij,ij->i", y, y)) * np.sqrt(np.einsum("ij,ij->i", z, z))
                    sure[k] = np.einsum("ij,ij->i", y, z) / norms >= threshold
                yield "some", u[sure], v[sure]


def links(x: Side, y: Side | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, link counts and roots of one group's own pairs, or of those between two."""
    same_group = y is None
    y = x if same_group else y
    total = int(y.at[-1])
    change, chain = np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64)
    count = np.zeros(total, np.int64)
    root = np.arange(total)
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    waiting = 0
    for p in range(len(x.raw)):
        for q in range(p if same_group else 0, len(y.raw)):
            same = same_group and p == q
            ta, tb, oa, ob = x.trees[p], y.trees[q], int(x.at[p]), int(y.at[q])
            for kind, u, v in dual(ta, x.unit[p], x.raw[p], tb, y.unit[q], y.raw[q], threshold, same):
                if kind == "whole":
                    sa, ea, sb, eb = ta["start"][u] + oa, ta["end"][u] + oa, tb["start"][v] + ob, tb["end"][v] + ob
                    self_ = (u == v) if same else np.zeros(len(u), bool)
                    for s, e, n in ((sa, ea, eb - sb - self_), (sb, eb, np.where(self_, 0, ea - sa))):
                        np.add.at(change, s, n)
                        np.add.at(change, e, -n)
                        # all points of a side are joined by way of the other
                        np.add.at(chain, s, 1)
                        np.add.at(chain, e - 1, -1)
                    u, v = sa, sb
                else:
                    u, v = u + oa, v + ob
                    np.add.at(count, u, 1)
                    np.add.at(count, v, 1)
                us.append(u)
                vs.append(v)
                waiting += len(u)
                if waiting > EDGES:
                    root = union(root, np.concatenate(us), np.concatenate(vs))
                    us, vs, waiting = [], [], 0
    linked = np.flatnonzero(np.cumsum(chain)[:-1] > 0)
    root = union(root, np.concatenate([linked, *us]), np.concatenate([linked + 1, *vs]))
    root = settled(root)
    rows = x.rows if same_group else np.concatenate((x.rows, y.rows))
    return rows, count + np.cumsum(change)[:-1], root


def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to one row for each block: its vectors and its tree."""
    for t in K.whole_groups(batches, ["block"]):
        block, row = t.column("block").to_numpy(), t.column("row").to_numpy()
        vectors = t.column("embedding")
        for f, size in zip(*K.by_group(block), strict=True):
            v = vectors.slice(int(f), int(size)).combine_chunks()
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(int(size), -1)
            u = unit(x)
            tree = CoverTree(u)
            blob = K.pack(row=row[f : f + size][tree.order], x=x[tree.order].reshape(-1), **{k: getattr(tree, k) for k in CoverTree.FIELDS})
            values = [int(block[f]), int(size), float(tree.radius[0]), u[tree.order[0]].tobytes(), blob]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, TREES_PA, strict=True)], ["block", "n", "radius", "centre", "tree"])


TREES_PA = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
TREES = "block long, n long, radius double, centre binary, tree binary"


def compare(threshold: float) -> Callable:
    """Blocks sorted by task (i, j) and group to (a, b, n): link counts n of row a (b null),
    forest links a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in K.whole_groups(batches, ["i", "j"]):
            i, j, group = (t.column(c).to_numpy() for c in ("i", "j", "group"))
            cut = np.concatenate(([0], np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(i)]))
            trees = t.column("tree")
            for f, e in zip(cut[:-1], cut[1:], strict=True):
                blobs = [trees[k].as_py() for k in range(f, e)]
                left = int(np.count_nonzero(group[f:e] == i[f]))
                x = Side(blobs[:left], 0)
                y = Side(blobs[left:], int(x.at[-1])) if i[f] != j[f] else None
                rows, counts, root = links(x, y, threshold)
                some, tied = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
                out = [(rows[some], None, counts[some]), (rows[tied], rows[root[tied]], np.zeros(len(tied), np.int64))]
                for p, q, n in out:
                    for s in range(0, len(p), 100_000):
                        z = slice(s, s + 100_000)
                        other = pa.nulls(len(p[z]), pa.int64()) if q is None else pa.array(q[z])
                        yield pa.RecordBatch.from_arrays([pa.array(p[z]), other, pa.array(n[z])], ["a", "b", "n"])

    return run


class Pivots:
    """Centres of a sample's cover tree in tree order, and a coarser net of them by which a
    vector finds a near one."""

    def __init__(self, x: np.ndarray, most: int):
        found, radius = x[:1], 1.0
        while (c := net(x, radius, most)) is not None:
            found = x[c[0]]
            if radius < slack(x.shape[1]):
                break
            radius /= 2
        self.x = found[CoverTree(found).order]
        top = max(1, int(np.sqrt(len(self.x))))
        self.heads = self.x[:: max(1, len(self.x) // top)]
        self.near = (self.x @ self.heads.T).argmax(1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The pivot of each vector: the nearest of those whose head is its nearest head."""
        if len(self.x) <= 4096:
            return (x @ self.x.T).argmax(1)
        out, head = np.zeros(len(x), np.int64), (x @ self.heads.T).argmax(1)
        for h in np.unique(head):
            mine, members = np.flatnonzero(head == h), np.flatnonzero(self.near == h)
            out[mine] = members[(x[mine] @ self.x[members].T).argmax(1)]
        return out


def nearest(shared) -> Callable:
    """Each vector's cell; other dimensions than the pivots' have one of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            v = batch.column("embedding")
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(len(dims), np.int64)
            mine = np.flatnonzero(dims == pivots.x.shape[1])
            for s in range(0, len(mine), 4096):
                at = mine[s : s + 4096]
                cell[at] = pivots.cells(unit(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), v, batch.column("dim"), pa.array(cell)], ["row", "embedding", "dim", "cell"])

    return run


def meetings(found: pd.DataFrame, threshold: float, groups: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of blocks (dim, n, radius, centre) with their groups: pairs of groups to be compared,
    and those all of whose pairs are links."""
    reach = float(chord(np.array(threshold)))
    first = np.flatnonzero(np.diff(groups, prepend=-1))
    open_, whole = [], []
    centre, radius, dims = [], [], found["dim"].to_numpy()[first]
    for f, e in zip(first, np.append(first[1:], len(groups)), strict=True):
        c = np.stack([np.frombuffer(b, np.float32) for b in found["centre"][f:e]])
        mid = c[len(c) // 2]
        centre.append(mid)
        radius.append(float((chord(c @ mid) + found["radius"].to_numpy()[f:e]).max()))
    radius = np.array(radius)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        c, off = np.stack([centre[k] for k in at]), slack(int(dim)) * 2
        for k in range(len(at)):
            d = chord(c[k:] @ c[k])
            d[0] = 0.0
            wide = radius[at[k]] + radius[at[k:]]
            inside = d + wide <= reach - off
            near = ~inside & (d - wide <= reach + off)
            open_.append(np.stack([np.full(int(near.sum()), at[k]), at[k:][near]], 1))
            whole += [(int(at[k]), int(g)) for g in at[k:][inside]]
    return np.concatenate(open_) if open_ else np.zeros((0, 2), np.int64), whole


def group(vectors: DataFrame, threshold: float = 0.9, per_block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    good = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = saved(
        vectors.select(
            F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), "embedding", F.coalesce(good, F.lit(False)).alias("good"), F.monotonically_increasing_id().alias("row")
        ),
        "vectors",
    )
    usable = rows.where("good").select("row", F.col("embedding"), F.size("embedding").alias("dim"))
    sizes = {r.dim: r.n for r in usable.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.select(F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("component_id"), F.lit(True).alias("kept"))
    most = max(sizes, key=lambda d: (sizes[d], d))
    size_of = lambda d: per_block or max(64, BLOCK // (4 * d))
    # One pivot for every half block, at least some, and a sample of a few vectors for each.
    wanted = max(16, min(-(-2 * sizes[most] // size_of(most)), PIVOTS // (4 * most)))
    first = usable.where(F.col("dim") == most).select("embedding", F.xxhash64("row").alias("h")).orderBy("h").limit(8 * wanted).toPandas()
    pivots = Pivots(unit(np.stack(first["embedding"].to_numpy())), wanted)
    kind = usable.schema["embedding"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(pivots)
    placed = saved(usable.mapInArrow(nearest(shared), f"row long, embedding {kind}, dim int, cell long"), "vector-cells")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).toPandas().sort_values(["dim", "cell"])
    # A cell's blocks have successive numbers.
    cells["parts"] = [-(-n // size_of(d)) for d, n in zip(cells["dim"], cells["n"], strict=True)]
    cells["base"] = cells["parts"].cumsum() - cells["parts"]
    parts = max(1, min(PARTS, int(cells["parts"].sum())))
    dealt = spark.createDataFrame(cells[["dim", "cell", "base", "parts"]], "dim int, cell long, base long, parts long")
    block = F.col("base") + F.pmod(F.xxhash64("row"), F.col("parts"))
    blocked = placed.join(F.broadcast(dealt), ["dim", "cell"]).select(block.alias("block"), "row", "embedding")
    trees = saved(blocked.repartitionById(parts, (F.col("block") % parts).cast("int")).sortWithinPartitions("block").mapInArrow(plant, TREES), "vector-trees")

    found = trees.select("block", "n", "radius", "centre").toPandas().sort_values("block").reset_index(drop=True)
    found["dim"] = found["centre"].map(len) // 4
    # Neighbouring blocks form groups of one dimension; some groups even of few blocks.
    each = max(1, min(GROUP, len(found) // 6))
    place = found.groupby("dim", sort=False).cumcount().to_numpy() // each
    groups = np.cumsum(np.concatenate(([0], (place[1:] != place[:-1]) | (np.diff(found["dim"]) != 0)))).astype(np.int64)
    pairs, whole = meetings(found, threshold, groups)
    grouped = spark.createDataFrame(pd.DataFrame({"block": found["block"], "group": groups}), "block long, group long")
    # A place takes several pairs in turn where there are more than PARTS.
    where = np.arange(len(pairs)) % PARTS
    both = pd.DataFrame({"i": np.tile(pairs[:, 0], 2), "j": np.tile(pairs[:, 1], 2), "group": pairs.T.reshape(-1), "place": np.tile(where, 2)}).drop_duplicates()
    tasks = spark.createDataFrame(both, "i long, j long, group long, place int")
    work = trees.select("block", "tree").join(grouped, "block").join(tasks, "group").select("place", "i", "j", "group", "block", "tree")
    work = work.repartitionById(max(1, min(PARTS, len(pairs))), F.col("place")).sortWithinPartitions("i", "j", "group", "block").drop("place")
    out = saved(work.mapInArrow(compare(threshold), "a long, b long, n long"), "vector-links")
    dropped(trees)

    counts, edges = out.where("b is null").select("a", "n"), out.where("b is not null").select("a", "b")
    if whole:
        # Groups of which all pairs link: sizes for each member, and a chain by way of the first.
        n = found.groupby(groups)["n"].sum().to_numpy()
        extra, joined = np.zeros(len(n), np.int64), np.arange(len(n))
        for g, h in whole:
            extra[g] += n[h] - (g == h)
            extra[h] += n[g] if g != h else 0
        joined = settled(union(joined, *(np.array(c, np.int64) for c in zip(*whole, strict=True))))
        bonded = np.unique(np.array(whole))
        members = blocked.select("block", "row").join(F.broadcast(grouped), "block")
        firsts = members.groupBy("group").agg(F.min("row").alias("first"))
        bonds = spark.createDataFrame(pd.DataFrame({"group": bonded, "extra": extra[bonded], "joined": joined[bonded]}), "group long, extra long, joined long")
        heads = bonds.join(firsts.withColumnRenamed("group", "joined"), "joined").select("group", "extra", "first")
        mine = members.join(F.broadcast(heads), "group")
        counts = counts.unionByName(mine.select(F.col("row").alias("a"), F.col("extra").alias("n")))
        edges = edges.unionByName(mine.select(F.col("row").alias("a"), F.col("first").alias("b")))
    counts = counts.groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n_links")).where("n_links > 0")
    part = components(edges, "vector-components").withColumnRenamed("node", "row")
    known = rows.select("vec_id", "row").join(counts, "row", "left").join(part, "row", "left")
    # Written, so that the join of a large component is dealt by its own, splittable shuffle.
    least = saved(known.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("component_id")), "vector-firsts")
    some = lambda c: F.when(c != LAST, c)
    first_id = F.coalesce("component_id", "vec_id")
    return known.join(least, "component", "left").select(
        some(F.col("vec_id")).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        some(first_id).alias("component_id"),
        (F.col("vec_id") == first_id).alias("kept"),
    )
