"""Full-text search: tokens, postings, BM25, facets, one-edit typos, snippets.

Documents are rows of ``doc_id`` and ``text`` (with any further columns, which
serve as facets).  A null text has no tokens but its document counts in N, as do
all live documents.  Scores sum over query terms, a repeated term counting as
often; order is score, then id.  An empty query finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidelog.functions.stem import STEMMERS
from tidelog.session import materialise, spread

K1, B = 1.2, 0.75
TYPO_WEIGHT = 0.5
#: Terms, typos included, up to which a query is answered by a scan; more go by postings.
LITERAL_TERMS = 100
#: Postings with positions that a task hands on at a time, but for a document's rest.
POSTINGS_AT_ONCE = 50_000
#: Numbers of a block of queries, documents of a task of theirs and of one product.
QUERY_CELLS, DOCS_AT_ONCE, CHUNK_DOCS = 4_000_000, 4_096, 256
#: Runs of letters and digits, as the JVM and as Python write it.
TOKEN = r"[\p{IsAlphabetic}\p{N}]+"
_RUN = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def runs(text: str):
    """(token, character it starts at) of a text: the tokens of ``token_array``, in order."""
    for m in _RUN.finditer(text):
        word = m[0].lower()
        if word.isascii():
            yield word, m.start()
        else:  # a letter whose small form ends in a mark
            for part in _RUN.findall(word):
                yield part, m.start()


def stopwords(spark, lang: str) -> list[str]:
    """The language's published stopword list as it ships with Spark."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords({"en": "english", "pt": "portuguese"}[lang])


def token_array(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokens(documents: DataFrame, lang: str | None = None) -> DataFrame:
    """``doc_id``, ``ord``, ``term``; with ``lang`` stopwords go and terms are stemmed."""
    out = documents.select("doc_id", F.posexplode(token_array(F.col("text"))).alias("ord", "term"))
    if lang:
        out = out.where(~F.col("term").isin(stopwords(documents.sparkSession, lang)))
        out = stemmed(out, lang)
    return out


def stemmed(terms: DataFrame, lang: str) -> DataFrame:
    """Terms replaced by their stems, which are found once per distinct term."""
    stem = STEMMERS[lang]

    @F.pandas_udf(StringType())
    def strip(words: pd.Series) -> pd.Series:
        return words.map(stem)

    distinct = terms.select("term").distinct().withColumn("_stem", strip("term"))
    return terms.join(distinct, "term").withColumn("term", F.col("_stem")).drop("_stem")


def language(lang: Column) -> Column:
    """A row's language as a key of ``STEMMERS``: case, outer spaces and region don't matter; null for any other."""
    short = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]+)([-_]|$)", 1)
    return F.when(short.isin(*STEMMERS), short)


def _placed_words(documents: DataFrame, lang: str | Column | None) -> tuple[DataFrame, Callable]:
    """Rows of ``doc_id``, ``text``, ``_lang``, and a function that gives such a text's terms with their places."""
    langs = list(STEMMERS) if isinstance(lang, Column) else [lang] if lang else []
    stops = {x: frozenset(stopwords(documents.sparkSession, x)) for x in langs}
    stems = {x: STEMMERS[x] for x in langs}

    def words(text: str, own: str | None, known: dict):
        """``known``: stems found so far."""
        stop, stem = stops.get(own, frozenset()), stems.get(own)
        for word, at in runs(text):
            if word in stop:
                continue
            if stem:
                word = known.get((own, word)) or known.setdefault((own, word), stem(word))
            yield word, at

    own = lang if isinstance(lang, Column) else F.lit(lang).cast("string")
    return documents.where("text is not null").select("doc_id", "text", own.alias("_lang")), words


def token_positions(documents: DataFrame, lang: str | Column | None = None) -> DataFrame:
    """``doc_id``, ``term``, ``pos``: as ``tokens``, with the character a token starts at.

    A column as ``lang`` gives each row its own language, null for none.
    """
    rows, words = _placed_words(documents, lang)

    def run(batches):
        for pdf in batches:
            known: dict = {}
            found = [(i, w, at) for i, text, own in zip(pdf["doc_id"], pdf["text"], pdf["_lang"]) for w, at in words(text, own, known)]
            if found:
                yield pd.DataFrame(found, columns=["doc_id", "term", "pos"])

    return rows.mapInPandas(run, "doc_id bigint, term string, pos int")


def _positioned_postings(documents: DataFrame, lang: str | Column | None) -> DataFrame:
    """Postings with positions, made where a document is read: nothing is shuffled."""
    rows, words = _placed_words(documents, lang)
    names = ["doc_id", "term", "tf", "positions", "doc_len"]

    def run(batches):
        for pdf in batches:
            known: dict = {}
            out: list[tuple] = []
            for doc_id, text, own in zip(pdf["doc_id"], pdf["text"], pdf["_lang"]):
                places: dict[str, list[int]] = {}
                for word, at in words(text, own, known):
                    places.setdefault(word, []).append(at)
                size = sum(map(len, places.values()))
                out += [(doc_id, word, len(at), at, size) for word, at in places.items()]
                if len(out) >= POSTINGS_AT_ONCE:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return spread(rows).mapInPandas(run, "doc_id bigint, term string, tf bigint, positions array<int>, doc_len bigint")


def postings(documents: DataFrame, lang: str | Column | None = None, positions: bool = False) -> DataFrame:
    """``term``, ``doc_id``, ``tf``, ``doc_len`` of every document.

    With ``positions`` also these; ``lang`` may then be a column.  A document is one
    row.  Without stems its length is known before its tokens are taken apart, so
    one exchange does.
    """
    if positions:
        return _positioned_postings(documents, lang)
    if not lang:
        arrays = spread(documents.select("doc_id", "text")).select("doc_id", token_array(F.col("text")).alias("_t"))
        apart = arrays.select("doc_id", F.size("_t").cast("bigint").alias("doc_len"), F.explode("_t").alias("term"))
        return apart.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("doc_len").alias("doc_len")).select("doc_id", "term", "tf", "doc_len")
    counted = tokens(documents, lang).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    lengths = counted.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
    return counted.join(lengths, "doc_id")


def corpus_stats(documents: DataFrame, lang: str | None = None) -> DataFrame:
    """One row: live documents, tokens, average length (0 where there is none)."""
    sized = documents.select(F.size(token_array(F.col("text"))).alias("n")) if not lang else None
    if sized is None:
        counts = tokens(documents, lang).groupBy("doc_id").agg(F.count("*").alias("n"))
        sized = documents.select("doc_id").join(counts, "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    return sized.agg(F.count("*").alias("n_docs"), total.alias("total_len"), F.when(F.count("*") > 0, total / F.count("*")).otherwise(0.0).alias("avg_len"))


def bm25(tf: Column, doc_len: Column, df: Column, n: int, avg_len: float) -> Column:
    if not n or not avg_len:
        return F.lit(0.0)
    idf = F.ln((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1.0)
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * doc_len / F.lit(float(avg_len))))


def query_terms(spark, query: str, lang: str | None = None) -> list[str]:
    """A query's terms by the rules the documents were tokenized with, repeats kept."""
    found = [word for word, _ in runs(query)]
    if lang:
        stop = set(stopwords(spark, lang))
        found = [STEMMERS[lang](w) for w in found if w not in stop]
    return found


def typo_candidates(index: DataFrame, terms: list[str]) -> DataFrame:
    """``query_term``, ``term``: index terms one edit away (by characters) from a query term.

    The index's distinct terms are scanned once; a query's few terms are literals.
    """
    close = F.array(*[F.when((F.abs(F.length("term") - len(t)) <= 1) & (F.levenshtein("term", F.lit(t), 1) == 1), F.lit(t)) for t in dict.fromkeys(terms)])
    vocabulary = index.select("term").distinct()
    return vocabulary.select(F.explode(F.array_compact(close)).alias("query_term"), "term")


def _weights(index: DataFrame, terms: list[str], typo: bool) -> DataFrame:
    """``term``, ``weight``: each repeat of a query term counts; fuzzy matches count half."""
    spark = index.sparkSession
    given = spark.createDataFrame([(t,) for t in terms], "query_term string")
    exact = given.select(F.col("query_term").alias("term"), F.lit(1.0).alias("weight"))
    if typo:
        fuzzy = typo_candidates(index, terms).join(F.broadcast(given), "query_term").select("term", F.lit(TYPO_WEIGHT).alias("weight"))  # a query's terms
        exact = exact.unionByName(fuzzy)
    return exact.groupBy("term").agg(F.sum("weight").alias("weight"))


def facet_filter(facets: dict, columns: dict[str, str]) -> Column:
    """All equalities hold, with equal types: a number is never a text.  A missing field fails."""

    def same(name: str, value) -> Column:
        kind = columns.get(name)
        fits = {bool: ("boolean",), int: ("int", "bigint", "smallint", "tinyint"), str: ("string",)}[type(value)]
        return (F.col(f"`{name}`") == F.lit(value)) if kind in fits else F.lit(False)

    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), (same(k, v) for k, v in facets.items()), F.lit(True))


def scores(documents: DataFrame, query: str, lang: str | None = None, facets: dict | None = None, typo: bool = False, index: DataFrame | None = None, stats: tuple[int, float] | None = None, only=None) -> DataFrame:
    """``doc_id``, ``score`` of every match (of the document ``only`` if given); df and N are taken before facets.

    A query without stems needs no index and no shuffle of texts: one scan gives N,
    lengths and the frequencies of the query's terms and of what is one edit away,
    then every document is scored where it is read.  Stems go by postings; ``index`` and ``stats`` reuse some written earlier, of which only
    those of the query's terms are read.
    """
    spark = documents.sparkSession
    terms = query_terms(spark, query, lang)
    if not terms:
        return documents.select("doc_id").limit(0).withColumn("score", F.lit(0.0))
    if not lang and index is None:
        weights = {t: float(terms.count(t)) for t in terms}
        n, total, df = _scan_counts(documents, list(weights), typo)
        if typo:
            for q, t in ((q, t) for q in dict.fromkeys(terms) for t in df if one_edit(q, t)):
                weights[t] = weights.get(t, 0.0) + TYPO_WEIGHT * terms.count(q)
        if len(weights) <= LITERAL_TERMS:
            return _scan_scores(documents, weights, (n, total / n if n else 0.0), df, facets, only)
    index = postings(documents, lang) if index is None else index
    n, avg_len = stats or documents_stats(documents, lang)
    weights = _weights(index, terms, typo)
    hits = index.join(weights if typo else F.broadcast(weights), "term")  # without typos: as many rows as the query has terms
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    hits = hits.join(df, "term")
    if facets:
        allowed = documents.where(facet_filter(facets, dict(documents.dtypes))).select("doc_id")
        hits = hits.join(allowed, "doc_id", "left_semi")
    if only is not None:
        hits = hits.where(F.col("doc_id") == only)
    part = F.col("weight") * bm25(F.col("tf"), F.col("doc_len"), F.col("df"), n, avg_len)
    return hits.groupBy("doc_id").agg(F.sum(part).alias("score"))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == F.lit(term)))


def one_edit(a: str, b: str) -> bool:
    """Whether two words are one insertion, deletion or change of a character apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _scan_counts(documents: DataFrame, terms: list[str], typo: bool) -> tuple[int, int, dict[str, int]]:
    """Documents, tokens, and in how many documents each wanted term is: of a query's few terms, so few themselves."""
    wanted = lambda x: x.isin(terms)
    if typo:
        wanted = lambda x: reduce(lambda a, b: a | b, ((F.abs(F.length(x) - len(t)) <= 1) & F.levenshtein(x, F.lit(t), 1).between(0, 1) for t in terms))
    read = spread(documents.select("text")).select(token_array(F.col("text")).alias("_t"))
    # an empty word, which no token is, stands for the document itself
    each = read.select(F.size("_t").alias("_n"), F.explode(F.array_append(F.array_distinct(F.filter("_t", wanted)), "")).alias("_w"))
    counts = {r[0]: (r[1], r[2]) for r in each.groupBy("_w").agg(F.count("*"), F.sum("_n")).collect()}
    n, total = counts.pop("", (0, 0))
    return n, total, {w: c for w, (c, _) in counts.items()}


def _scan_scores(documents: DataFrame, weights: dict[str, float], stats: tuple[int, float], df: dict[str, int], facets: dict | None, only=None) -> DataFrame:
    columns = list(dict.fromkeys(["doc_id", "text", *(c for c in (facets or {}) if c in documents.columns)]))
    read = spread(documents.select(*columns)).withColumn("_t", token_array(F.col("text")))
    n, avg_len = stats
    if facets:
        read = read.where(facet_filter(facets, dict(documents.dtypes)))
    if only is not None:
        read = read.where(F.col("doc_id") == only)
    counted = read.select("doc_id", F.size("_t").alias("_len"), *[_occurrences(t).alias(f"_tf{i}") for i, t in enumerate(weights)])
    parts = [F.lit(w) * bm25(F.col(f"_tf{i}"), F.col("_len"), F.lit(df.get(t, 0)), n, avg_len) for i, (t, w) in enumerate(weights.items())]
    hit = reduce(lambda a, b: a | b, (F.col(f"_tf{i}") > 0 for i in range(len(weights))))
    return counted.where(hit).select("doc_id", reduce(lambda a, b: a + b, parts).alias("score"))


def documents_stats(documents: DataFrame, lang: str | None = None) -> tuple[int, float]:
    row = corpus_stats(documents, lang).first()
    return int(row["n_docs"]), float(row["avg_len"])


def search(documents: DataFrame, query: str, limit: int, **options) -> DataFrame:
    """The ``limit`` best documents by rounded score, then id."""
    ranked = scores(documents, query, **options).withColumn("score", F.round("score", 6) + F.lit(0.0))
    return ranked.orderBy(F.desc("score"), "doc_id").limit(max(0, limit))


def search_stats(documents: DataFrame, query: str, **options) -> DataFrame:
    """One row: documents indexed and documents matched before the limit."""
    n, _ = documents_stats(documents, options.get("lang"))
    return scores(documents, query, **options).agg(F.lit(n).cast("bigint").alias("total_docs_indexed"), F.count("*").alias("docs_examined"))


def score_document(documents: DataFrame, query: str, doc_id: int, lang: str | None = None) -> DataFrame:
    """The score of one document: counts are taken over all, only this one is scored."""
    return scores(documents, query, lang, only=doc_id).select("doc_id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def search_many(index: DataFrame, stats: tuple[int, float], queries: DataFrame, k: int, lang: str | None = None) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: the ``k`` best documents of each row of ``queries`` (``query_id``, ``query``).

    The stated queries go to the tasks as matrices of queries by terms, in blocks
    of at most ``QUERY_CELLS`` numbers.  Postings (``term``, ``doc_id``, ``tf``,
    ``doc_len``) of their terms are weighted once, brought together by document and
    multiplied with them, many documents at a time; a task hands on the best ``k``
    of each query, ties included.  So what moves are the postings and not the pairs
    of query and document.  A null query finds nothing; ids of queries are unique.
    """
    asked = queries.where("query is not null").select("query_id", F.explode(token_array(F.col("query"))).alias("term"))
    if lang:
        asked = stemmed(asked.where(~F.col("term").isin(stopwords(queries.sparkSession, lang))), lang)
    weights = materialise(asked.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight")), "weights")
    hits = index.join(weights.select("term").distinct(), "term", "left_semi").select("term", "doc_id", "tf", "doc_len")
    hits = materialise(hits, "hits")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n, avg_len = stats
    weighed = hits.join(df, "term").select("term", "doc_id", bm25(F.col("tf"), F.col("doc_len"), F.col("df"), n, avg_len).alias("part"))
    buckets = max(1, -(-n // DOCS_AT_ONCE))
    weighed = weighed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    kinds = {"query_id": weights.schema["query_id"].dataType.simpleString(), "doc_id": index.schema["doc_id"].dataType.simpleString()}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"

    def best(ids: list, terms: dict[str, int], matrix: np.ndarray):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            column = pdf["term"].map(terms)
            pdf, column = pdf[column.notna()], column.dropna().to_numpy(dtype=np.int64)
            codes, docs = pd.factorize(pdf["doc_id"])
            part, out = pdf["part"].to_numpy(), []
            for at in range(0, len(docs), CHUNK_DOCS):
                inside = (codes >= at) & (codes < at + CHUNK_DOCS)
                values = np.zeros((len(terms), min(CHUNK_DOCS, len(docs) - at)))
                values[column[inside], codes[inside] - at] = part[inside]
                score = np.round(matrix @ values, 6) + 0.0
                least = np.partition(score, -k, axis=1)[:, [-k]] if score.shape[1] > k else 0.0
                q, d = np.nonzero((score >= least) & (score > 0))
                out.append(pd.DataFrame({"query_id": [ids[i] for i in q], "doc_id": docs[at + d], "score": score[q, d]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

        return run

    found = None
    for ids, terms, matrix in _query_blocks(weights) if k > 0 else ():
        part = weighed.groupBy("_bucket").applyInPandas(best(ids, terms, matrix), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], schema)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _query_blocks(weights: DataFrame):
    """(query ids, number of each term, weights) of as many queries at a time as ``QUERY_CELLS`` allows, one at least."""
    ids, terms, cells = [], {}, []

    def block():
        matrix = np.zeros((len(ids), len(terms)))
        for q, t, w in cells:
            matrix[q, t] = w
        return ids, terms, matrix

    for r in weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).toLocalIterator():
        more = len(terms) + sum(t["term"] not in terms for t in r["terms"])
        if ids and (len(ids) + 1) * more > QUERY_CELLS:
            yield block()
            ids, terms, cells = [], {}, []
        cells += [(len(ids), terms.setdefault(t["term"], len(terms)), t["weight"]) for t in r["terms"]]
        ids.append(r["query_id"])
    if ids:
        yield block()


def snippets(documents: DataFrame, query: str, context: int = 30, lang: str | None = None) -> DataFrame:
    """``doc_id``, ``pos``, ``snippet`` and the match's byte bounds in it, for every match.

    A match runs from the token's start to the next white space; the window is
    ``context`` characters to either side, cut at the text's ends.
    """
    spark = documents.sparkSession
    wanted = frozenset(query_terms(spark, query, lang))
    stop = frozenset(stopwords(spark, lang)) if lang else frozenset()
    stem = STEMMERS[lang] if lang else (lambda w: w)
    space = re.compile(r"\s")

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                for word, at in runs(text):
                    if word in stop or stem(word) not in wanted:
                        continue
                    gap = space.search(text, at)
                    end = gap.start() if gap else len(text)
                    lo, hi = max(0, at - context), min(len(text), end + context)
                    first = len(text[lo:at].encode())
                    out.append((doc_id, at, text[lo:hi], first, first + len(text[at:end].encode())))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "pos", "snippet", "match_start", "match_end"])

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, pos int, snippet string, match_start int, match_end int")
