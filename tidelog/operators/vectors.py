"""Vector search: exact top-k, batches of queries, pages, a coarse-cell index.

Vectors are rows of an id and an array of numbers (``dtype`` where several are
stored).  Rows of another length or element type than the query are skipped, as
are null vectors.  k of zero gives nothing; ties go to the lower id.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.vectors import DTYPES, METRICS, distance, distances, doubles

#: Query vectors sent to the tasks at a time.
QUERY_BLOCK = 4_096


def _literal(query) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def top_k(vectors: DataFrame, query, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", dtype: str | None = None) -> DataFrame:
    """``id``, ``distance`` of the ``k`` nearest; planned as a top-k per partition and a merge."""
    rows = vectors.where(F.size(vec_col) == len(query))
    if dtype is not None:
        rows = rows.where(F.col("dtype") == dtype)
    scored = rows.select(F.col(id_col), (F.round(distance(doubles(F.col(vec_col)), _literal(query), metric), 6) + F.lit(0.0)).alias("distance"))
    return scored.where("distance is not null").orderBy("distance", id_col).limit(max(0, k))


def search_cost(vectors: DataFrame, key_bytes: Column, vec_col: str = "embedding", element_bytes: int = 4) -> DataFrame:
    """One row: items a flat search reads and their bytes (key and value with its three bytes of header)."""
    return vectors.agg(F.count("*").alias("items_examined"), F.coalesce(F.sum(key_bytes + F.size(vec_col) * element_bytes + 3), F.lit(0)).cast("bigint").alias("bytes_read"))


def page(vectors: DataFrame, n: int, cursor: int | None = None, id_col: str = "vec_id") -> DataFrame:
    rows = vectors if cursor is None else vectors.where(F.col(id_col) > cursor)
    return rows.orderBy(id_col).limit(max(0, n))


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``id``, ``distance``, ``rank``: the ``k`` nearest of each query, itself included.

    The stated queries travel to the data in blocks; a task keeps ``k`` rows a
    query of all it sees, so what is shuffled grows with queries, not vectors.
    """
    metric = METRICS[metric]
    schema = f"query_id bigint, {id_col} bigint, distance double"
    found = None

    def kernel(block: list[tuple[int, list[float]]]):
        by_len: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dims in {len(v) for _, v in block}:
            rows = [(i, v) for i, v in block if len(v) == dims]
            by_len[dims] = (np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64))

        def run(batches):
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for pdf in batches:
                lengths = pdf[vec_col].map(len).to_numpy()
                for dims, (q_ids, q) in by_len.items():
                    part = pdf[lengths == dims]
                    if not len(part) or not dims:
                        continue
                    ids, data = part[id_col].to_numpy(), np.array(part[vec_col].tolist(), dtype=np.float64)
                    d = np.round(distances(q, data, metric), 6) + 0.0
                    for i, q_id in enumerate(q_ids):
                        old = best.get(q_id)
                        a, b = (ids, d[i]) if old is None else (np.concatenate([old[0], ids]), np.concatenate([old[1], d[i]]))
                        keep = np.lexsort((a, b))[:k]
                        best[q_id] = (a[keep], b[keep])
            for q_id, (ids, d) in best.items():
                if len(ids):
                    yield pd.DataFrame({"query_id": np.full(len(ids), q_id, dtype=np.int64), id_col: ids, "distance": d})

        return run

    block: list[tuple[int, list[float]]] = []
    data = vectors.where(F.col(vec_col).isNotNull()).select(id_col, doubles(F.col(vec_col)).alias(vec_col))

    def flush():
        nonlocal found, block
        if block:
            part = data.mapInPandas(kernel(block), schema)
            found = part if found is None else found.unionByName(part)
            block = []

    for row in queries.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).toLocalIterator():
        block.append((int(row[0]), [float(x) for x in row[1]]))
        if len(block) >= QUERY_BLOCK:
            flush()
    flush()
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    return nearest_of(found, k, id_col)


def nearest_of(found: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows of each ``query_id``, with ``rank``."""
    window = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def usable_nodes(nodes: DataFrame) -> DataFrame:
    """Stored vectors decoded: ``vector_id``, ``ns``, ``dims``, ``dtype``, ``embedding`` (doubles) of each id's usable row of the highest LSN.

    Usable is a row with ``dims`` elements of a known type, all finite; zeros are.
    """

    def run(batches):
        for pdf in batches:
            for (dims, dtype), group in pdf.groupby(["dims", "dtype"], sort=False):
                kind = DTYPES.get(dtype)
                if kind is None or dims <= 0:
                    continue
                group = group[group["vector_data"].str.len() == dims * np.dtype(kind).itemsize]
                if not len(group):
                    continue
                x = np.frombuffer(b"".join(group["vector_data"]), dtype=kind).astype(np.float64).reshape(len(group), dims)
                good = np.isfinite(x).all(axis=1)
                if not good.any():
                    continue
                kept = group[good]
                yield pd.DataFrame({**{c: kept[c].to_numpy() for c in ("vector_id", "ns", "dims", "dtype", "lsn")}, "embedding": x[good].tolist()})

    rows = nodes.where("vector_id is not null and ns is not null and dims is not null and vector_data is not null").select("vector_id", "ns", "dims", "dtype", F.coalesce("lsn", F.lit(-1)).alias("lsn"), "vector_data")
    decoded = rows.mapInPandas(run, "vector_id bigint, ns string, dims int, dtype string, lsn bigint, embedding array<double>")
    order = Window.partitionBy("vector_id").orderBy(F.desc("lsn"), "embedding")
    return decoded.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "lsn")


def search(vectors: DataFrame, query, k: int, metric: str = "cosine", index=None, stamp: str = "", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id``, ``distance``: by the index if it is fresh (its stamp is ``stamp``) and of this metric, else exactly."""
    if index is not None and not index.stale(stamp) and index.head()["metric"] == METRICS[metric]:
        return index.search(query, k).withColumnRenamed("vec_id", id_col)
    return top_k(vectors, query, k, metric, id_col, vec_col)


def search_with_stats(vectors: DataFrame, query, k: int, metric: str, key_bytes: Column, id_col: str = "vec_id", vec_col: str = "embedding", element_bytes: int = 4) -> DataFrame:
    """``top_k`` with what the flat search read beside each row: ``items_examined`` and ``bytes_read``."""
    items, size = search_cost(vectors, key_bytes, vec_col, element_bytes).first()
    cost = {"items_examined": F.lit(items).cast("bigint"), "bytes_read": F.lit(size).cast("bigint")}
    return top_k(vectors, query, k, metric, id_col, vec_col).withColumns(cost)


class CellIndex:
    """Approximate search: vectors grouped in cells around centres fitted on a bounded sample.

    Every vector is indexed, in files by cell; a search reads the cells nearest to
    the query.  How many is measured when the index is built: exact neighbours of
    ``TRIALS`` stored vectors, each without itself, tell how many cells it takes to
    find ``RECALL`` of them.  A search for more than the largest of ``MEASURED_K``
    reads all cells.  A stamp of the source tells whether the index is stale.
    """

    #: Vectors the centres are fitted on, at most, and rounds of fitting.
    SAMPLE, ROUNDS = 20_000, 8
    #: Share of the neighbours to be found (above the 0.9 required, as it is measured on a sample), queries it is measured with, numbers of neighbours.
    RECALL, TRIALS, MEASURED_K = 0.95, 256, (1, 10, 100)

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, cells: int, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", stamp: str = "") -> CellIndex:
        rows = vectors.where(F.col(vec_col).isNotNull())
        taken = rows.select(vec_col, F.xxhash64(id_col).alias("h")).orderBy("h").limit(self.SAMPLE).select(vec_col).collect()
        sample = np.array([r[0] for r in taken], dtype=np.float64)
        rng = np.random.default_rng(17)
        centres = sample[rng.permutation(len(sample))[: min(cells, len(sample))]].copy()
        for _ in range(self.ROUNDS):
            own = distances(sample, centres, "l2").argmin(1)
            for c in range(len(centres)):
                if (own == c).any():
                    centres[c] = sample[own == c].mean(0)

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            return pd.Series(distances(np.array(v.tolist(), dtype=np.float64), centres, "l2").argmin(1).astype(np.int32))

        rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumn("cell", cell("vec")).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/cells")
        head = {"metric": METRICS[metric], "stamp": stamp, "centres": centres.tolist(), "probes": self._measure(centres, METRICS[metric])}
        self.spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/head")
        return self

    def _measure(self, centres: np.ndarray, metric: str) -> list[tuple[int, int]]:
        """(k, cells to read) for each of ``MEASURED_K``, from exact neighbours over all vectors written."""
        stored = self.spark.read.parquet(f"{self.path}/cells").select(F.xxhash64("id").alias("id"), "vec", "cell")
        trials = stored.select("id", "vec").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(self.TRIALS)
        queries = {r["id"]: r["vec"] for r in trials.collect()}
        if not queries:
            return []
        trials = self.spark.createDataFrame(list(queries.items()), "id bigint, vec array<double>")
        found = batch_knn(stored, trials, max(self.MEASURED_K) + 1, metric, "id", "vec").where("query_id <> id")
        rows = stored.select("id", "cell").join(F.broadcast(found), "id").select("query_id", "rank", "cell").collect()  # at most TRIALS x k
        order = distances(np.array(list(queries.values()), dtype=np.float64), centres, "l2").argsort(1, kind="stable")
        place = dict(zip(queries, order.argsort(1, kind="stable")))  # of each cell, by nearness to the query
        depths: dict[int, list[int]] = {q: [] for q in queries}
        for r in sorted(rows):
            depths[r["query_id"]].append(int(place[r["query_id"]][r["cell"]]))
        out = []
        for k in self.MEASURED_K:
            shares = [(np.bincount(d[:k], minlength=len(centres)).cumsum() / len(d[:k])) for d in depths.values() if d]
            enough = np.flatnonzero(np.mean(shares, axis=0) >= self.RECALL) if shares else []
            out.append((k, int(enough[0]) + 1 if len(enough) else len(centres)))
        return out

    def head(self) -> dict:
        return json.loads(self.spark.read.parquet(f"{self.path}/head").first()[0])

    def stale(self, stamp: str) -> bool:
        return self.head()["stamp"] != stamp

    def search(self, query, k: int, probes: int | None = None) -> DataFrame:
        """The ``k`` nearest in ``probes`` cells; by default in as many as the measured recall asks for."""
        head = self.head()
        if probes is None:
            fitting = [n for at, n in head.get("probes", []) if at >= k]
            probes = max([n for at, n in head["probes"] if at <= k] + fitting[:1]) if fitting else len(head["centres"])
        near = distances(np.array([query], dtype=np.float64), np.array(head["centres"]), "l2")[0].argsort(kind="stable")[:probes]
        rows = self.spark.read.parquet(f"{self.path}/cells").where(F.col("cell").isin([int(c) for c in near]))  # partition pruning
        return top_k(rows, query, k, head["metric"], "id", "vec").withColumnRenamed("id", "vec_id")
