"""Approximate nearest neighbours by hierarchical small-world graphs, one a shard.

Vectors are split by a hash of their id into shards of about ``SHARD_ROWS``; a task
builds a shard's graph and a search asks all shards and merges their answers, so a
shard bounds memory and the number of shards follows the data.  A graph has layers
of exponentially fewer nodes: a search descends greedily to the lowest layer and
goes on there with the ``ef`` best candidates.  New nodes are joined to neighbours
that are nearer to them than to each other.

Defined cases: null vectors, null ids and vectors of other lengths than the first
are left out; an empty index finds nothing; ties go to the lower id.
"""

from __future__ import annotations

import heapq
import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.vectors import METRICS, distances
from tidelog.sources.files import Files

SHARD_ROWS = 8_192
#: Links of a node a layer (twice as many in the lowest), candidates kept while building and searching.
LINKS, BUILD_EF, SEARCH_EF = 16, 100, 50


class Graph:
    """One shard's graph.  ``links[layer][node]`` are node numbers; vectors stand in one array."""

    def __init__(self, metric: str = "l2", links: int = LINKS, ef: int = BUILD_EF, seed: int = 1):
        self.metric, self.m, self.ef = METRICS[metric], links, ef
        self.ids: list[int] = []
        self.vectors = np.zeros((0, 0), dtype=np.float32)
        self.links: list[dict[int, list[int]]] = []
        self.rng = np.random.default_rng(seed)
        self.entry = -1

    def _far(self, q: np.ndarray, nodes) -> np.ndarray:
        return distances(q[None].astype(np.float64), self.vectors[nodes].astype(np.float64), self.metric)[0]

    def _layer(self, q: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest reached from ``starts`` in a layer, nearest first."""
        links = self.links[layer]
        seen = set(starts)
        near = list(zip(self._far(q, starts).tolist(), starts))
        open_ = list(near)
        heapq.heapify(open_)
        best = [(-d, n) for d, n in near]
        heapq.heapify(best)
        while open_:
            d, node = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= ef:
                break
            new = [n for n in links[node] if n not in seen]
            if not new:
                continue
            seen.update(new)
            for far, n in zip(self._far(q, new).tolist(), new):
                if len(best) < ef or far < -best[0][0]:
                    heapq.heappush(open_, (far, n))
                    heapq.heappush(best, (-far, n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def _chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours for a node: nearest first, those nearer to it than to one chosen before; then the nearest of the rest."""
        kept: list[int] = []
        for d, n in found:
            if len(kept) >= most:
                break
            if not kept or self._far(self.vectors[n], kept).min() > d:
                kept.append(n)
        return kept + [n for _, n in found if n not in set(kept)][: most - len(kept)]

    def insert(self, ids, vectors: np.ndarray) -> Graph:
        first = len(self.ids)
        self.vectors = np.asarray(vectors, np.float32) if not first else np.vstack([self.vectors, np.asarray(vectors, np.float32)])
        self.ids += [int(i) for i in ids]
        for node in range(first, len(self.ids)):
            q = self.vectors[node]
            level = int(-np.log(1.0 - self.rng.random()) / np.log(self.m))
            top = len(self.links) - 1
            start = [self.entry]
            for layer in range(top, level, -1):
                start = [self._layer(q, start, 1, layer)[0][1]]
            for layer in range(min(level, top), -1, -1):
                found = self._layer(q, start, self.ef, layer)
                most = self.m * (2 if layer == 0 else 1)
                mine = self._chosen(found, self.m)
                self.links[layer][node] = mine
                for n in mine:
                    back = self.links[layer][n]
                    back.append(node)
                    if len(back) > most:
                        far = self._far(self.vectors[n], back)
                        self.links[layer][n] = self._chosen(sorted(zip(far.tolist(), back)), most)
                start = [n for _, n in found]
            for _ in range(top + 1, level + 1):
                self.links.append({node: []})
                self.entry = node
        return self

    def search(self, query, k: int, ef: int = SEARCH_EF) -> list[tuple[float, int]]:
        """(distance, id) of about the ``k`` nearest."""
        q = np.asarray(query, np.float32)
        if not self.ids or k <= 0 or len(q) != self.vectors.shape[1]:
            return []
        start = [self.entry]
        for layer in range(len(self.links) - 1, 0, -1):
            start = [self._layer(q, start, 1, layer)[0][1]]
        return sorted((d, self.ids[n]) for d, n in self._layer(q, start, max(ef, k), 0))[:k]

    def to_bytes(self) -> bytes:
        rows = [(layer, node, n) for layer, links in enumerate(self.links) for node, ns in links.items() for n in (ns or [-1])]
        out = io.BytesIO()
        head = json.dumps({"metric": self.metric, "m": self.m, "ef": self.ef, "entry": self.entry}).encode()
        np.savez(out, head=np.frombuffer(head, np.uint8), ids=np.array(self.ids, np.int64), vectors=self.vectors, links=np.array(rows, np.int32).reshape(-1, 3))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as held:
            head = json.loads(held["head"].tobytes())
            graph = cls(head["metric"], head["m"], head["ef"])
            graph.entry, graph.ids, graph.vectors = head["entry"], held["ids"].tolist(), held["vectors"]
            for layer, node, n in held["links"].tolist():
                while len(graph.links) <= layer:
                    graph.links.append({})
                near = graph.links[layer].setdefault(node, [])
                if n >= 0:
                    near.append(n)
        return graph


class GraphIndex:
    """Stored graphs of a collection, with the stamp of what they were built from."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def build(self, vectors: DataFrame, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", stamp: str = "") -> GraphIndex:
        """A new index of all vectors, in the place of an older one."""
        self._write(vectors, metric, id_col, vec_col, "overwrite")
        self.files.write("head.json", json.dumps({"metric": METRICS[metric], "stamp": stamp}).encode())
        return self

    def insert(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", stamp: str = "") -> GraphIndex:
        """More vectors, in shards of their own."""
        self._write(vectors, self.head()["metric"], id_col, vec_col, "append")
        self.files.write("head.json", json.dumps(self.head() | {"stamp": stamp}).encode())
        return self

    def _write(self, vectors: DataFrame, metric: str, id_col: str, vec_col: str, mode: str) -> None:
        rows = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
        shards = max(1, -(-rows.count() // SHARD_ROWS))

        def graph(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            dims = len(pdf["v"].iat[0])
            pdf = pdf[pdf["v"].map(len) == dims]
            built = Graph(metric).insert(pdf["id"], np.array(pdf["v"].tolist(), dtype=np.float32))
            return pd.DataFrame({"shard": [int(pdf["shard"].iat[0])], "dims": [dims], "graph": [built.to_bytes()]})

        sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("_dims", F.size("v"))
        sharded.groupBy("shard", "_dims").applyInPandas(graph, "shard int, dims int, graph binary").write.mode(mode).parquet(self.files.at("graphs"))

    def head(self) -> dict:
        return json.loads(self.files.read("head.json"))

    def stale(self, stamp: str) -> bool:
        return self.head()["stamp"] != stamp

    def search(self, query, k: int, ef: int = SEARCH_EF) -> DataFrame:
        """``vec_id``, ``distance`` of about the ``k`` nearest, over all shards."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id bigint, v array<float>")
        return self.search_many(asked, k, ef, "query_id", "v").select("vec_id", "distance").orderBy("distance", "vec_id").limit(max(0, k))

    def search_many(self, queries: DataFrame, k: int, ef: int = SEARCH_EF, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """``query_id``, ``vec_id``, ``distance``, ``rank``: a stated set of queries goes to every shard."""
        from tidelog.operators.vectors import nearest_of

        asked = [(int(r[0]), list(r[1])) for r in queries.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).toLocalIterator()]

        def run(batches):
            for pdf in batches:
                for data in pdf["graph"]:
                    graph = Graph.from_bytes(bytes(data))
                    rows = [(q, i, d) for q, v in asked for d, i in graph.search(v, k, ef)]
                    if rows:
                        yield pd.DataFrame(rows, columns=["query_id", "vec_id", "distance"])

        found = self.spark.read.parquet(self.files.at("graphs")).select("graph").mapInPandas(run, "query_id bigint, vec_id bigint, distance double")
        return nearest_of(found.withColumn("distance", F.round("distance", 6) + F.lit(0.0)), k, "vec_id")
