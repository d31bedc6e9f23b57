"""Most similar vectors by low-dimensional stable projections and kd-trees.

Each unit vector is projected on ``PROJECTED`` Gaussian directions.  For a pair at
distance d the squared projected distance over d² follows a chi-square law of
``PROJECTED`` degrees, so once the projected distance of what comes next exceeds
d_k times the law's quantile, everything unseen is farther than the current k-th
best d_k but for a small probability: the stopping test.  A kd-tree over the
projections serves leaves nearest first, projected neighbours in them are
verified with the whole vectors, and d_k shrinks on the way.

Distribution: a collection (namespace and length) of more than ``BLOCK_ROWS``
vectors is cut into blocks by a kd-tree fitted, in a task of its own, on a bounded
sample; every vector is assigned.  A task searches one pair of blocks.  To which
blocks a vector travels is found by descending the tree, leaving out every
branch that fails the stopping test, so that the work follows the blocks reached
and not all there are; ``fan_out`` reports how many they were.  A block that is
still too large is split by a hash.  Exact copies are searched once and expanded
afterwards, in salted parts, so a hot vector with a third of all rows is one row of
the search and many tasks of the expansion.  The driver holds the trees: one cut
for every ``BLOCK_ROWS`` vectors.

Defined cases: rows without id, namespace, length or type, of other lengths than
stated, with a value that isn't finite or with zeros only are no vectors; a
vector is its usable row of the highest LSN; ties go to the lower id; other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import materialise

#: Projected dimensions, and the probability that a neighbour passes the stopping test.
PROJECTED, CONFIDENCE = 12, 0.99
#: Vectors of a block, of a leaf, and leaves looked at together.
BLOCK_ROWS, LEAF_ROWS, LEAVES_AT_ONCE = 16_384, 256, 8
#: One in so many candidates among the projections is where verifying whole leaves is cheaper.
DENSE = 20
#: Sampled projections a collection's tree is fitted on.
SAMPLED = 262_144
#: Copies of one vector that a task expands, and vectors sent on together.
COPIES, SENT_AT_ONCE = 50_000, 10_000
SEED = 7_919
ELEMENTS = {"F32": "<f4", "F16": "<f2", "I8": "i1"}


def chi_square_quantile(p: float, degrees: int) -> float:
    """Where the chi-square law of ``degrees`` reaches ``p``, by bisection on its series."""

    def below(x: float) -> float:
        a, y = degrees / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= y / n
            total += term
        return total * math.exp(a * math.log(y) - y - math.lgamma(a))

    low, high = 1e-9, 100.0 + 10 * degrees
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dims: int) -> np.ndarray:
    """Gaussian directions of a vector length: the same on every executor."""
    return np.random.default_rng(SEED + dims).standard_normal((dims, PROJECTED)).astype(np.float32)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Usable vectors: unit length in 32 bits, and their projection."""
    for pdf in batches:
        for (dims, dtype), group in pdf.groupby(["dims", "dtype"], sort=False):
            kind = ELEMENTS.get(dtype)
            if kind is None or dims <= 0:
                continue
            group = group[group["vector_data"].str.len() == dims * np.dtype(kind).itemsize]
            if not len(group):
                continue
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.frombuffer(b"".join(group["vector_data"]), dtype=kind).astype(np.float64).reshape(len(group), dims)
                scale = np.abs(x).max(axis=1)
                good = np.isfinite(scale) & (scale > 0)
            x = x[good] / scale[good][:, None]
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            proj = unit @ directions(int(dims))
            kept = group[good]
            plain = {c: kept[c].to_numpy() for c in ("vector_id", "ns", "dims", "lsn")}
            yield pd.DataFrame({**plain, "unit": [r.tobytes() for r in unit], "proj": [r.tobytes() for r in proj]})


def usable_vectors(nodes: DataFrame) -> DataFrame:
    """``vector_id``, ``ns``, ``dims``, ``unit``, ``proj``: each vector's usable row of the highest LSN."""
    rows = nodes.where("vector_id is not null and ns is not null and dims is not null and vector_data is not null").select(
        "vector_id", "ns", "dims", "dtype", "vector_data", F.coalesce("lsn", F.lit(-1)).alias("lsn")
    )
    decoded = rows.mapInPandas(_decode, "vector_id bigint, ns string, dims int, lsn bigint, unit binary, proj binary")
    order = Window.partitionBy("vector_id").orderBy(F.desc("lsn"), "unit")
    return decoded.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "lsn")


class Tree:
    """kd-tree over sampled projections: ``2 ** depth`` regions."""

    def __init__(self, axes: np.ndarray, cuts: np.ndarray):
        self.axes, self.cuts, self.depth = axes, cuts, len(axes).bit_length() - 1

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> Tree:
        axes, cuts = np.zeros(1 << depth, dtype=np.int32), np.zeros(1 << depth, dtype=np.float32)
        stack = [(1, sample)]
        while stack:
            node, rows = stack.pop()
            if node >= 1 << depth:
                continue
            axis = int(np.argmax(rows.max(0) - rows.min(0))) if len(rows) else 0
            cut = np.float32(np.median(rows[:, axis])) if len(rows) else np.float32(0)
            axes[node], cuts[node] = axis, cut
            stack += [(2 * node, rows[rows[:, axis] < cut]), (2 * node + 1, rows[rows[:, axis] >= cut])]
        return cls(axes, cuts)

    def place(self, proj: np.ndarray) -> np.ndarray:
        node = np.ones(len(proj), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (proj[np.arange(len(proj)), self.axes[node]] >= self.cuts[node])
        return node - (1 << self.depth)

    def reach(self, proj: np.ndarray, radius: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region) wherever the squared distance to the region is within the row's radius or the region's ``most``.

        A descent from the root: the squared distance is kept up axis by axis, and
        a branch goes as soon as it is beyond both the row's radius and the largest
        radius below the branch.
        """
        widest = np.empty(2 << self.depth)
        widest[1 << self.depth :] = most
        for node in range((1 << self.depth) - 1, 0, -1):
            widest[node] = max(widest[2 * node], widest[2 * node + 1])
        found = []
        stack = [(1, np.arange(len(proj)), np.zeros((len(proj), proj.shape[1]), np.float32), np.zeros(len(proj)))]
        while stack:
            node, rows, gaps, total = stack.pop()
            near = total <= np.maximum(radius[rows], widest[node])
            if not near.all():
                rows, gaps, total = rows[near], gaps[near], total[near]
            if not len(rows):
                continue
            if node >= 1 << self.depth:
                found.append((rows, np.full(len(rows), node - (1 << self.depth))))
                continue
            axis, beyond = self.axes[node], proj[rows, self.axes[node]] - self.cuts[node]
            for child, gap in ((2 * node, np.maximum(beyond, 0)), (2 * node + 1, np.maximum(-beyond, 0))):
                farther = gap > gaps[:, axis]
                if farther.any():
                    moved = gaps.copy()
                    moved[:, axis] = np.where(farther, gap, gaps[:, axis])
                    stack.append((child, rows, moved, total + np.where(farther, gap.astype(float) ** 2 - gaps[:, axis].astype(float) ** 2, 0)))
                else:
                    stack.append((child, rows, gaps, total))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _rows(binary: pd.Series, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(binary), dtype=np.float32).reshape(len(binary), columns)


def _leaf_order(proj: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree that halves the widest axis at its median."""
    leaves, stack = [], [np.arange(len(proj))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF_ROWS:
            leaves.append(rows)
            continue
        part = proj[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        half = np.argpartition(part[:, axis], len(rows) // 2)
        stack += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return leaves


class _Nearest:
    """The best ``k`` found so far of each row of one block, and the squared distance that still counts."""

    def __init__(self, bound: np.ndarray, k: int):
        self.k, self.bound = k, bound.astype(np.float64).copy()
        self.found, self.similarity = np.full((len(bound), k), -1, dtype=np.int64), np.full((len(bound), k), -np.inf)

    def add(self, rows: np.ndarray, others: np.ndarray, similarity: np.ndarray, ids: np.ndarray) -> None:
        """Row by row new neighbours (numbers into ``ids``); ties go to the lower id."""
        near = 2 - 2 * similarity <= self.bound[rows] + 1e-6
        rows, others, similarity = rows[near], others[near], similarity[near]
        if not len(rows):
            return
        k = self.k
        touched, slot = np.unique(rows, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(touched)), k), slot])
        found = np.concatenate([self.found[touched].ravel(), others])
        value = np.concatenate([self.similarity[touched].ravel(), similarity])
        order = np.lexsort((np.where(found >= 0, ids[found], np.iinfo(np.int64).max), -value, at))
        pick = order[np.searchsorted(at[order], np.arange(len(touched)))[:, None] + np.arange(k)[None, :]]
        self.found[touched], self.similarity[touched] = found[pick], value[pick]
        last = self.similarity[touched, k - 1]
        full = np.isfinite(last)
        self.bound[touched[full]] = np.minimum(self.bound[touched[full]], 2 - 2 * last[full])

    def rows(self, ids: np.ndarray, others: np.ndarray):
        i, c = np.nonzero(self.found >= 0)
        return ids[i], others[self.found[i, c]], self.similarity[i, c]


def search_block(left, right, k: int, quantile: float):
    """The ``k`` nearest of each block's rows in the other block (in itself if ``right`` is None), within the rows' bounds.

    Blocks are (ids, units, projections, squared bounds).  Each pair of leaves is
    looked at once, for both sides; returns ids, neighbours' ids, similarities.
    """
    same = right is None
    right = left if same else right
    l_ids, l_unit, l_proj, l_bound = left
    r_ids, r_unit, r_proj, r_bound = right
    l_best = _Nearest(l_bound, k)
    r_best = l_best if same else _Nearest(r_bound, k)
    l_leaves = _leaf_order(l_proj)
    r_leaves = l_leaves if same else _leaf_order(r_proj)
    low, high = np.stack([r_proj[r].min(0) for r in r_leaves]), np.stack([r_proj[r].max(0) for r in r_leaves])
    leaf_of = np.empty(len(r_ids), dtype=np.int64)
    for n, r in enumerate(r_leaves):
        leaf_of[r] = n
    # squared projected distance less what the bounds allow, as one product: (-2 x, |x|², 1) by (y, 1, |y|²)
    one = np.ones((len(r_ids), 1), np.float32)
    r_side = np.hstack([r_proj, one, (r_proj**2).sum(1, keepdims=True)])
    for number, rows in enumerate(l_leaves):
        proj = l_proj[rows]
        gap = (np.maximum(np.maximum(low - proj.max(0), proj.min(0) - high), 0) ** 2).sum(1)
        order = np.argsort(gap, kind="stable")
        if same:
            order = order[order >= number]
        norm, dense = (proj**2).sum(1), False
        for at in range(0, len(order), LEAVES_AT_ONCE):
            own = l_best.bound[rows]
            if gap[order[at]] > quantile * max(own.max(), r_best.bound.max()):
                break  # the chi-square test: nothing unseen is nearer
            chosen = np.concatenate([r_leaves[n] for n in order[at : at + LEAVES_AT_ONCE]])
            limit = np.maximum(own, r_best.bound[chosen].max())
            if gap[order[at]] > quantile * limit.max():
                continue
            if not dense:
                l_side = np.hstack([-2 * proj, (norm - quantile * limit)[:, None].astype(np.float32), np.ones((len(rows), 1), np.float32)])
                hit = np.flatnonzero((l_side @ r_side[chosen].T).ravel() <= 1e-4)
                # where the test spares few, the whole leaves are verified, here and in this leaf's later rounds
                dense = len(hit) * DENSE > len(rows) * len(chosen)
            if dense:
                inner = l_unit[rows] @ r_unit[chosen].T
                close = inner >= (1 - own / 2 - 1e-5).astype(np.float32)[:, None]
                close |= inner >= (1 - r_best.bound[chosen] / 2 - 1e-5).astype(np.float32)[None, :]
                hit = np.flatnonzero(close.ravel())
            if not len(hit):
                continue
            i, j = np.divmod(hit, len(chosen))
            if same:
                once = (leaf_of[chosen[j]] != number) | (rows[i] < chosen[j])
                i, j = i[once], j[once]
                if not len(i):
                    continue
            if dense and len(i) * 8 > len(rows) * len(chosen):
                value = inner[i, j].astype(np.float64)
            else:
                value = np.einsum("ij,ij->i", l_unit[rows[i]], r_unit[chosen[j]], dtype=np.float64)
            near = 2 - 2 * value <= np.maximum(l_best.bound[rows[i]], r_best.bound[chosen[j]]) + 1e-6
            if near.any():
                i, j, value = rows[i[near]], chosen[j[near]], value[near]
                if same:
                    l_best.add(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value]), l_ids)
                else:
                    l_best.add(i, j, value, r_ids)
                    r_best.add(j, i, value, l_ids)
    parts = [l_best.rows(l_ids, r_ids)] + ([] if same else [r_best.rows(r_ids, l_ids)])
    return tuple(np.concatenate(x) for x in zip(*parts))


def _search_pairs(k: int, quantile: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dims = int(pdf["dims"].iat[0])
        a, b = int(pdf["_a"].iat[0]), int(pdf["_b"].iat[0])
        unpack = lambda p: (p["vector_id"].to_numpy(), _rows(p["unit"], dims), _rows(p["proj"], PROJECTED), p["_bound"].to_numpy())
        left, right = (pdf, None) if a == b else (pdf[pdf["_block"] == a], pdf[pdf["_block"] == b])
        if a != b and not (len(left) and len(right)):
            ids, others, similarity = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            ids, others, similarity = search_block(unpack(left), None if right is None else unpack(right), k, quantile)
        return pd.DataFrame({"ns": np.full(len(ids), pdf["ns"].iat[0], dtype=object), "dims": np.full(len(ids), dims, dtype=np.int32), "vector_id": ids, "neighbour": others, "similarity": similarity})

    return run


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "neighbour")
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _fit_trees(reps: DataFrame, block_rows: int) -> dict[tuple[str, int], Tree]:
    """Trees of the collections that need more than one block, each fitted by one task on at most about ``SAMPLED`` projections."""
    large = reps.groupBy("ns", "dims").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    chance = F.pmod(F.xxhash64(F.col("vector_id"), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    sampled = reps.select("ns", "dims", "proj", chance.alias("_chance")).join(large, ["ns", "dims"]).where(F.col("_chance") < F.lit(float(SAMPLED)) / F.col("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = max(1, math.ceil(math.log2(int(pdf["n"].iat[0]) / block_rows)))
        tree = Tree.fit(_rows(pdf["proj"], PROJECTED), depth)
        return pd.DataFrame({"ns": [pdf["ns"].iat[0]], "dims": [int(pdf["dims"].iat[0])], "axes": [tree.axes.tobytes()], "cuts": [tree.cuts.tobytes()]})

    fitted = sampled.drop("_chance").groupBy("ns", "dims").applyInPandas(fit, "ns string, dims int, axes binary, cuts binary")
    return {(r[0], r[1]): Tree(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in fitted.collect()}


def most_similar(nodes: DataFrame, k: int = 10, least: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``ns``, ``dims``, ``vector_id``, ``neighbour``, ``similarity``, ``rank``: the ``k`` most similar by cosine.

    ``least`` leaves out neighbours below that similarity and makes the search
    cheap: its distance is every vector's first bound.  Without it each block is
    searched by itself first, which gives the bounds for the rest.
    """
    return _search_all(nodes, k, least, block_rows)[0]


def fan_out(nodes: DataFrame, k: int = 10, least: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a collection: its vectors (copies once), blocks, and how often a vector was sent to a pair of blocks."""
    placed, sent = _search_all(nodes, k, least, block_rows)[1:]
    size = placed.groupBy("ns", "dims").agg(F.count("*").alias("vectors"), F.count_distinct("_block").alias("blocks"))
    return size.join(sent.groupBy("ns", "dims").agg(F.count("*").alias("sent")), ["ns", "dims"])


def _search_all(nodes: DataFrame, k: int, least: float | None, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The neighbours, the placed vectors, and these as sent to pairs of blocks."""
    spark = nodes.sparkSession
    quantile = chi_square_quantile(CONFIDENCE, PROJECTED)
    radius = 2 - 2 * least if least is not None else 4.0
    vectors = materialise(usable_vectors(nodes), "vectors")
    # exact copies, told by a hash of the vector: one of them searches
    narrow = vectors.select("ns", "dims", "vector_id", F.sha2("unit", 256).alias("same"))
    groups = narrow.groupBy("ns", "dims", "same").agg(F.min("vector_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copied = materialise(narrow.join(groups, ["ns", "dims", "same"]).drop("same"), "copies")
    reps = vectors.join(copied.where("vector_id <> rep").select("vector_id"), "vector_id", "left_anti")
    trees = _fit_trees(reps, block_rows)
    split: dict[tuple[str, int, int], int] = {}

    def place(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf["_block"] = 0
            for key, group in pdf.groupby(["ns", "dims"], sort=False):
                tree = trees.get((key[0], int(key[1])))
                if tree:
                    pdf.loc[group.index, "_block"] = tree.place(_rows(group["proj"], PROJECTED))
            yield pdf.astype({"_block": "int32"})

    placed = reps.select("vector_id", "ns", "dims", "unit", "proj").mapInPandas(place, "vector_id bigint, ns string, dims int, unit binary, proj binary, _block int")
    if trees:
        sizes = placed.groupBy("ns", "dims", "_block").agg(F.count("*").alias("n")).where(F.col("n") > 2 * block_rows).collect()  # over-full blocks only
        split = {(r[0], r[1], r[2]): -(-r[3] // block_rows) for r in sizes}
    widest = max([1, *split.values()])
    placed = placed.withColumn("_bound", F.lit(radius))

    def typed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.astype({"_block": "int32", "_a": "int32", "_b": "int32"})

    def travel(bounds: dict):
        """Each vector to the pairs of blocks it can matter for; sub-blocks of an over-full region all meet."""

        def run(batches):
            for pdf in batches:
                for key, group in pdf.groupby(["ns", "dims"], sort=False):
                    key = (key[0], int(key[1]))
                    tree = trees.get(key)
                    if tree is None:
                        yield typed(group.assign(ns=[key[0]] * len(group), _a=0, _b=0))
                        continue
                    regions = 1 << tree.depth
                    region = group["_block"].to_numpy()
                    parts = np.ones(regions, dtype=np.int64)
                    for (ns, dims, r), n in split.items():
                        if (ns, dims) == key:
                            parts[r] = n
                    own = region * widest + group["vector_id"].to_numpy() % parts[region]
                    most = np.full(regions, quantile * radius)
                    if key in bounds:
                        most[:] = 0
                        most[bounds[key][0]] = quantile * bounds[key][1]
                    row, other = tree.reach(_rows(group["proj"], PROJECTED), quantile * group["_bound"].to_numpy(), most)
                    fan = parts[other]
                    row, sub = np.repeat(row, fan), np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
                    block = np.repeat(other, fan) * widest + sub
                    for at in range(0, len(row), SENT_AT_ONCE):
                        part = slice(at, at + SENT_AT_ONCE)
                        rows = group.iloc[row[part]]
                        mine = own[row[part]]
                        yield typed(rows.assign(ns=[key[0]] * len(rows), _block=mine, _a=np.minimum(mine, block[part]), _b=np.maximum(mine, block[part])))

        return run

    schema = "vector_id bigint, ns string, dims int, unit binary, proj binary, _block int, _bound double, _a int, _b int"
    found = "ns string, dims int, vector_id bigint, neighbour bigint, similarity double"
    search = _search_pairs(k, quantile)
    keys = ["ns", "dims", "_a", "_b"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(min((1 << t.depth) * ((1 << t.depth) + 1) // 2, 8 << t.depth) for t in trees.values()))
    limits: dict = {}
    if trees and least is None:
        alone = placed.repartition(tasks, "ns", "dims", "_block").withColumn("_a", F.col("_block")).withColumn("_b", F.col("_block"))
        first = _best(alone.groupBy(*keys).applyInPandas(search, found), ["ns", "vector_id"], k)
        reached = first.where(F.col("rank") == k).select("vector_id", "ns", (2 - 2 * F.col("similarity") + 1e-6).alias("_reached"))
        placed = materialise(placed.join(reached, ["vector_id", "ns"], "left").withColumn("_bound", F.coalesce("_reached", F.lit(radius))).drop("_reached"), "bounds")
        placed = placed.select("vector_id", "ns", "dims", "unit", "proj", "_block", "_bound")
        blocks: dict = {}
        for ns, dims, block, most in placed.groupBy("ns", "dims", "_block").agg(F.max("_bound")).collect():  # one row a block, like the trees
            blocks.setdefault((ns, dims), []).append((block, most))
        limits = {key: (np.array([b for b, _ in rows]), np.array([m for _, m in rows])) for key, rows in blocks.items()}
    sent = placed.mapInPandas(travel(limits), schema)
    pairs = sent.repartition(tasks, *keys).groupBy(*keys).applyInPandas(search, found)
    among = _best(pairs, ["ns", "dims", "vector_id"], k).drop("rank")
    # back from representatives to vectors: the k + 1 lowest ids of a group can be anyone's neighbours
    by_id = Window.partitionBy("rep").orderBy("vector_id")
    lowest = copied.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    lists = lowest.groupBy("ns", "dims", "rep").agg(F.collect_list("vector_id").alias("ids"), F.max("n").alias("n"))
    seen = among.withColumnRenamed("vector_id", "rep").join(lists.select(F.col("rep").alias("neighbour"), "ids"), "neighbour", "left")
    seen = seen.select("ns", "dims", "rep", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("neighbour"), "similarity")
    itself = lists.select("ns", "dims", "rep", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("similarity"))
    per_rep = materialise(_best(seen.unionByName(itself), ["rep"], k + 1).drop("rank"), "nearest")
    # k + 1 rows a representative, as an array, meet its copies: in as many salted parts as it has COPIES of them
    packed = per_rep.groupBy("rep").agg(F.collect_list(F.struct("neighbour", "similarity")).alias("near"))
    salts = (F.floor((F.col("n") - 1) / COPIES) + 1).cast("int")
    of_copies = packed.join(lists.select("rep", "n"), "rep").select("rep", "near", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    members = copied.withColumn("_salt", F.pmod(F.xxhash64("vector_id"), salts).cast("int")).join(of_copies, ["rep", "_salt"])
    alone = per_rep.join(lists.select("rep"), "rep", "left_anti").select("ns", "dims", F.col("rep").alias("vector_id"), "neighbour", "similarity")
    mine = members.select("ns", "dims", "vector_id", F.explode("near").alias("_near")).select("ns", "dims", "vector_id", "_near.neighbour", "_near.similarity").unionByName(alone)
    nearest = _best(mine.where("vector_id <> neighbour"), ["ns", "dims", "vector_id"], k).select("ns", "dims", "vector_id", "neighbour", "similarity", "rank")
    return nearest, placed, sent


def similar_pairs(nodes: DataFrame, k: int = 10, least: float = 0.90) -> DataFrame:
    """Pairs of which one is among the other's ``k`` most similar, at ``least`` or more."""
    near = most_similar(nodes, k, least).where(F.col("similarity") >= least)
    return near.select(F.least("vector_id", "neighbour").alias("vector_id_a"), F.greatest("vector_id", "neighbour").alias("vector_id_b")).distinct()
