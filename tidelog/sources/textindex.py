"""A stored inverted index with upserts, deletes and merging.

Each change writes a batch: postings sorted by term, and one row a document it
names (with its facets, or as deleted).  A small head file lists the batches that
count, with their documents and tokens.  A document's newest batch has its say:
postings of earlier ones are left out by an anti-join with the ids that later
batches name, so reads cost the query's terms and what has changed since the last
merge, and not the collection.  Document ids carry Parquet's bloom filter.

Defined cases: a null text has no tokens, its document counts; of rows of one id
in a batch the one with the greatest text stands; ids that aren't there may be
deleted; an empty index finds nothing.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import fulltext
from tidelog.operators.kv import newest
from tidelog.sources.files import Files


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, lang: str | None = None, facets: tuple[str, ...] = ()):
        self.spark, self.files, self.lang, self.facets = spark, Files(spark, path), lang, tuple(facets)

    def _head(self) -> dict:
        """The newest list of batches; earlier ones stay until the next change."""
        for name in reversed([n for n in self.files.names("heads") if n.endswith(".json")]):
            return json.loads(self.files.read(f"heads/{name}")) | {"number": int(name[:-5])}
        return {"number": 0, "next": 1, "batches": []}

    def _commit(self, head: dict, batches: list[dict]) -> None:
        number = head["number"] + 1
        body = json.dumps({"next": head["next"] + 1, "batches": batches}).encode()
        if not self.files.create(f"heads/{number:012d}.json", body):
            raise ValueError("the index was changed meanwhile")
        used = {b["number"] for b in batches} | {b["number"] for b in head["batches"]}
        for name in self.files.names("batches"):  # of two heads ago, or of a change that failed
            if int(name) not in used:
                self.files.delete(f"batches/{name}")
        for name in self.files.names("heads"):
            if int(name[:-5]) < number - 1:
                self.files.delete(f"heads/{name}")

    # -- changes
    def index_documents(self, documents: DataFrame) -> int:
        """Add or replace documents (``doc_id``, ``text`` and the facets); the batch's number."""
        one = newest(documents.select("doc_id", "text", *self.facets).where("doc_id is not null"), ["doc_id"], [F.desc_nulls_last("text")])
        return self._add(one, one.select("doc_id", *self.facets))

    def delete_documents(self, ids: DataFrame) -> int:
        gone = ids.select("doc_id").where("doc_id is not null").distinct()
        kinds = dict(self.documents().dtypes) if self.facets else {}
        return self._add(None, gone.select("doc_id", *[F.lit(None).cast(kinds[f]).alias(f) for f in self.facets]))

    def rebuild(self, documents: DataFrame) -> int:
        """Start anew from all live documents."""
        one = newest(documents.select("doc_id", "text", *self.facets).where("doc_id is not null"), ["doc_id"], [F.desc_nulls_last("text")])
        return self._add(one, one.select("doc_id", *self.facets), keep=False)

    def _add(self, texts: DataFrame | None, named: DataFrame, keep: bool = True) -> int:
        head = self._head()
        number = head["next"]
        at = self.files.at(f"batches/{number}")
        kind = named.schema["doc_id"].dataType.simpleString()
        if texts is None:
            rows = self.spark.createDataFrame([], f"term string, doc_id {kind}, tf bigint, positions array<int>, doc_len bigint")
        else:
            rows = fulltext.postings(texts.select("doc_id", "text"), self.lang, positions=True)
        self._write(rows, named.withColumn("deleted", F.lit(texts is None)), at)
        self._commit(head, (head["batches"] if keep else []) + [self._counted(number)])
        return number

    def _write(self, rows: DataFrame, named: DataFrame, at: str) -> None:
        rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/postings")
        lengths = self.spark.read.parquet(f"{at}/postings").groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
        docs = named.join(lengths, "doc_id", "left").withColumn("doc_len", F.coalesce("doc_len", F.lit(0)).cast("bigint"))
        docs.write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#doc_id", "true").parquet(f"{at}/docs")

    def _counted(self, number: int) -> dict:
        n, total = self._docs(number).where("not deleted").agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        return {"number": number, "docs": n, "tokens": total}

    def merge(self) -> int | None:
        """One batch in the place of all, without what was replaced or deleted; its number."""
        head = self._head()
        if not head["batches"]:
            return None
        number = head["next"]
        at = self.files.at(f"batches/{number}")
        self._write(self.postings(), self.documents().drop("doc_len").withColumn("deleted", F.lit(False)), at)
        self._commit(head, [self._counted(number)])
        return number

    # -- relations
    def _docs(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self.files.at(f"batches/{number}/docs"))

    def _current(self, kind: str, where=None) -> list[DataFrame]:
        """Each batch's rows that no later batch has replaced."""
        numbers = [b["number"] for b in self._head()["batches"]]
        out = []
        for i, number in enumerate(numbers):
            rows = self.spark.read.parquet(self.files.at(f"batches/{number}/{kind}"))
            rows = rows if where is None else rows.where(where)
            if numbers[i + 1 :]:
                later = reduce(DataFrame.union, [self._docs(n).select("doc_id") for n in numbers[i + 1 :]]).distinct()
                rows = rows.join(later, "doc_id", "left_anti")
            out.append(rows)
        return out

    def documents(self) -> DataFrame:
        """``doc_id``, the facets and ``doc_len`` of the live documents."""
        parts = self._current("docs", "not deleted")
        if not parts:
            return self.spark.createDataFrame([], ", ".join(["doc_id bigint", *[f"{f} string" for f in self.facets], "doc_len bigint"]))
        return reduce(DataFrame.unionByName, parts).select("doc_id", *self.facets, "doc_len")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """``term``, ``doc_id``, ``tf``, ``positions``, ``doc_len`` of the live documents; of some terms only their parts of the files are read."""
        parts = self._current("postings", None if terms is None else F.col("term").isin(list(dict.fromkeys(terms))))
        if not parts:
            return self.spark.createDataFrame([], "term string, doc_id bigint, tf bigint, positions array<int>, doc_len bigint")
        return reduce(DataFrame.unionByName, parts).select("term", "doc_id", "tf", "positions", "doc_len")

    def contains(self, doc_id) -> bool:
        return not self.documents().where(F.col("doc_id") == F.lit(doc_id)).isEmpty()

    def stats(self) -> tuple[int, float]:
        """Live documents and their average length: the batches' sums less what later ones replaced."""
        batches = self._head()["batches"]
        n, total = sum(b["docs"] for b in batches), sum(b["tokens"] for b in batches)
        for i, b in enumerate(batches[:-1]):
            later = reduce(DataFrame.union, [self._docs(x["number"]).select("doc_id") for x in batches[i + 1 :]]).distinct()
            less = self._docs(b["number"]).where("not deleted").join(later, "doc_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
            n, total = n - less[0], total - less[1]
        return n, total / n if n else 0.0

    # -- search
    def scores(self, query: str, facets: dict | None = None, typo: bool = False, only=None) -> DataFrame:
        terms = fulltext.query_terms(self.spark, query, self.lang)
        return fulltext.scores(self.documents(), query, self.lang, facets, typo, self.postings(None if typo else terms), self.stats(), only)

    def search(self, query: str, limit: int, facets: dict | None = None, typo: bool = False) -> DataFrame:
        """The ``limit`` best documents by rounded score, then id."""
        ranked = self.scores(query, facets, typo).withColumn("score", F.round("score", 6) + F.lit(0.0))
        return ranked.orderBy(F.desc("score"), "doc_id").limit(max(0, limit))

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        return fulltext.search_many(self.postings(), self.stats(), queries, k, self.lang)
