"""Queries of the core and, where SQL can say the same, their SQL for another engine.

All run over whole tables.  Reads, writes, life cycle, replicas and tiers of the
store go over ``wal_records``; vectors come from ``embeddings`` and
``hnsw_nodes``, texts from ``documents``, queries of a batch from ``eval_items``,
manifests from ``segments`` and ``peer_segments``.  Bytes come out in lower-case
hex, doubles rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.bytesx import content_hash, encode_key, hex_lower, slug, text_namespace, text_or_null, vector_namespace
from tidelog.functions.vectors import doubles, scalar_quantized
from tidelog.operators import capture, changefeed, cohorts, consolidate, diff, fulltext, kv, segments, vectors
from tidelog.operators.segments import live_segments
from tidelog.session import table as t

Query = Callable[[SparkSession, str], DataFrame]

#: Arguments of the queries, shared with their SQL.
NS, START, END, PREFIX = b"users", b"user:000000100", b"user:000003000", b"user:00000"
KEY, PAGE, CURSOR = b"user:000000002", 25, b"user:000000120"
WINDOW, NOW = 86_400, 1_748_219_306_851_534_107
TEXT_QUERY, TYPO_QUERY = "segment compaction segment vector", "segmnt vektor"
TYPO_WORDS = ["segment", "vector", "cache", "compaction", "index", "query", "the", "one", "key"]
AS_OF = 10_000
#: Rows of the log that count as the hot and the cold tier.
HOT, COLD = "seg_id is null or seg_id % 2 = 0", "seg_id % 2 = 1"


def _hexed(df: DataFrame, *columns: str) -> DataFrame:
    """Bytes in hex, the rest as it is."""
    kinds = dict(df.dtypes)
    names = columns or tuple(df.columns)
    return df.select(*[hex_lower(F.col(c)).alias(c) if kinds[c] == "binary" else F.col(c) for c in names])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _log(s: SparkSession, d: str) -> DataFrame:
    return kv.from_wal(t(s, d, "wal_records"))


def _records(s: SparkSession, d: str) -> DataFrame:
    """The log with each stored copy once."""
    return _log(s, d).distinct()


def _live(s: SparkSession, d: str) -> DataFrame:
    return live_segments(t(s, d, "segments"))


def _query_vector(s: SparkSession, d: str) -> list[float]:
    return t(s, d, "embeddings").where("vec_id = 7").select(doubles(F.col("embedding"))).first()[0]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents")


def _vec(metric: str) -> Query:
    return lambda s, d: vectors.top_k(t(s, d, "embeddings"), _query_vector(s, d), 10, metric)


def queries() -> dict[str, Query]:
    kvcols = ("key", "value", "lsn")
    return {
        # key-value reads
        "kv_latest": lambda s, d: _hexed(kv.live(_log(s, d)), "ns", "key", "value", "lsn"),
        "kv_get": lambda s, d: _hexed(kv.get(_log(s, d), NS, KEY), *kvcols),
        "kv_get_into": lambda s, d: _hexed(kv.get_into(_log(s, d), NS, KEY)),
        "kv_multi_get": lambda s, d: _hexed(kv.multi_get(_log(s, d), _log(s, d).where("lsn % 50 = 0")), "ns", *kvcols),
        "kv_get_stats": lambda s, d: _hexed(kv.get_with_stats(_log(s, d), NS, KEY)),
        "kv_range": lambda s, d: _hexed(kv.range_scan(_log(s, d), NS, START, END), *kvcols),
        "kv_range_stats": lambda s, d: kv.range_stats(_log(s, d), NS, START, END),
        "kv_range_budget_items": lambda s, d: _hexed(kv.budget_items(kv.scan(_log(s, d), NS), PAGE), *kvcols, "truncated"),
        "kv_range_budget_bytes": lambda s, d: _hexed(kv.budget_bytes(kv.scan(_log(s, d), NS), 4_000), *kvcols, "bytes_so_far"),
        "kv_prefix": lambda s, d: _hexed(kv.prefix_scan(_log(s, d), NS, PREFIX), *kvcols),
        "kv_page": lambda s, d: _hexed(kv.page(_log(s, d), NS, PAGE, cursor=CURSOR), *kvcols, "next_key"),
        "kv_rev_page": lambda s, d: _hexed(kv.page_back(_log(s, d), NS, PAGE, cursor=CURSOR), *kvcols, "next_key"),
        "kv_snapshot_range": lambda s, d: _hexed(kv.live(kv.snapshot(kv.namespace(_log(s, d), NS), as_of_lsn=AS_OF)), *kvcols),
        "kv_snapshot_segments": lambda s, d: _hexed(kv.live(kv.snapshot(_log(s, d), _live(s, d).select(F.col("segment_id").alias("seg_id")))), "ns", *kvcols),
        "kv_namespace_isolation": lambda s, d: _log(s, d).transform(kv.live).groupBy(hex_lower(F.col("ns")).alias("ns")).agg(F.count("*").alias("live_keys")),
        "kv_encoded_keys": lambda s, d: kv.live(_log(s, d)).select(hex_lower(encode_key(F.col("ns"), F.col("key"))).alias("encoded"), "lsn"),
        "kv_text_values": lambda s, d: kv.live(_log(s, d)).select(hex_lower(F.col("key")).alias("key"), "lsn", text_or_null(F.col("value")).alias("value_text")),
        "ns_names": lambda s, d: t(s, d, "documents").select("ns").distinct().select("ns", slug(F.col("ns")).alias("slug"), vector_namespace(F.col("ns")).alias("vec_ns"), text_namespace(F.col("ns")).alias("text_ns")),
        # writes and life cycle
        "tx_committed_view": lambda s, d: _hexed(kv.live(kv.committed(_log(s, d), _log(s, d).where("txid % 5 = 0").select("txid"))), "ns", *kvcols),
        "flush_retained": lambda s, d: _hexed(kv.retained_after_flush(_records(s, d), AS_OF), "ns", *kvcols, "seg_id"),
        "confirmed_lsn": lambda s, d: kv.confirmed_lsn(_live(s, d)),
        "strip_namespace": lambda s, d: kv.strip_namespaces(_log(s, d), b"__text__").groupBy(hex_lower(F.col("ns")).alias("ns")).agg(F.count_distinct("lsn").alias("records")),
        "delete_hidden": lambda s, d: _hexed(kv.newest(_log(s, d)).where("op = 2"), "ns", "key", "lsn"),
        # time to live, cohorts, compaction
        "cohort_and_death": lambda s, d: _records(s, d).select("lsn", "seg_id", cohorts.cohort_bucket(F.col("ts_ns"), F.col("ttl_s"), WINDOW).alias("cohort_bucket"), cohorts.death_time(F.col("ts_ns"), F.col("ttl_s"), WINDOW, "window").alias("death_time")),
        "segment_meta": lambda s, d: segments.segment_metadata(_records(s, d), WINDOW),
        "segment_roots": lambda s, d: segments.segment_roots(_log(s, d)),
        "cohorts": lambda s, d: cohorts.cohorts(_live(s, d), NOW),
        "expired_segments": lambda s, d: cohorts.expired_segments(_live(s, d), NOW).select("segment_id", "cohort_bucket"),
        "compact_survivors": lambda s, d: _hexed(cohorts.compact_survivors(_records(s, d), WINDOW, NOW), "cohort_bucket", "ns", "key", "value", "lsn", "death_time"),
        "compact_plan": lambda s, d: cohorts.compact_plan(_live(s, d), NOW, 50_000_000),
        "compact_pinned": lambda s, d: cohorts.compact_plan(_live(s, d), NOW, 50_000_000, _live(s, d).where("segment_id % 3 = 0")),
        "droppable_tombstones": lambda s, d: _hexed(cohorts.droppable_tombstones(_log(s, d))),
        # vectors
        "vec_cosine_topk": _vec("cosine"),
        "vec_l2_topk": _vec("euclidean"),
        "vec_dot_topk": _vec("dot"),
        "vec_zero_norm": lambda s, d: vectors.top_k(t(s, d, "embeddings"), [0.0] * 64, 5, "cosine"),
        "vec_mismatch_skipped": lambda s, d: vectors.top_k(t(s, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))), _query_vector(s, d), 10, "l2"),
        "vec_batch_knn": lambda s, d: vectors.batch_knn(t(s, d, "embeddings"), t(s, d, "embeddings").where("vec_id % 50 = 0"), 10, "l2"),
        "vec_nan_last": lambda s, d: vectors.top_k(t(s, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") > 5, F.transform("embedding", lambda x: x * F.lit(float("nan")))).otherwise(F.col("embedding"))), _query_vector(s, d), 10, "l2").select("vec_id", F.isnan("distance").alias("is_nan")),
        "vec_search_stats": lambda s, d: vectors.search_with_stats(t(s, d, "embeddings"), _query_vector(s, d), 5, "cosine", F.length(F.col("vec_id").cast("string"))),
        "vec_nodes": lambda s, d: _rounded(vectors.usable_nodes(t(s, d, "hnsw_nodes")).select("vector_id", "ns", "dims", "dtype", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))),
        "vec_count": lambda s, d: vectors.usable_nodes(t(s, d, "hnsw_nodes")).groupBy("ns").agg(F.count("*").alias("vectors")),
        "vec_page": lambda s, d: vectors.page(t(s, d, "embeddings"), 20, 100).select("vec_id", F.size("embedding").alias("dims")),
        "vec_search_cost": lambda s, d: vectors.search_cost(t(s, d, "embeddings"), F.length(F.col("vec_id").cast("string"))),
        "vec_sq8": lambda s, d: t(s, d, "embeddings").select("vec_id", F.concat_ws(",", scalar_quantized(doubles(F.col("embedding"))).cast("array<string>")).alias("codes")),
        # full text
        "tokens": lambda s, d: fulltext.tokens(_docs(s, d)),
        "postings": lambda s, d: fulltext.postings(_docs(s, d)),
        "postings_positions": lambda s, d: fulltext.postings(_docs(s, d), fulltext.language(F.col("lang")), True),
        "corpus_stats": lambda s, d: _rounded(fulltext.corpus_stats(_docs(s, d))),
        "bm25_topk": lambda s, d: fulltext.search(_docs(s, d), TEXT_QUERY, 20),
        "bm25_facets": lambda s, d: fulltext.search(_docs(s, d), TEXT_QUERY, 20, facets={"lang": "en", "source": "forum"}),
        "bm25_typo": lambda s, d: fulltext.search(_docs(s, d), TYPO_QUERY, 20, typo=True),
        "bm25_stemmed": lambda s, d: fulltext.search(_docs(s, d), "compacting segments", 20, lang="en"),
        "bm25_stats": lambda s, d: fulltext.search_stats(_docs(s, d), TEXT_QUERY),
        "bm25_after_delete": lambda s, d: fulltext.search(_docs(s, d).where("doc_id % 3 <> 0"), TEXT_QUERY, 20),
        "bm25_single_doc": lambda s, d: fulltext.score_document(_docs(s, d), TEXT_QUERY, _docs(s, d).where(F.lower("text").rlike(r"\bsegment\b")).agg(F.min("doc_id")).first()[0]),
        "token_places": lambda s, d: fulltext.token_positions(_docs(s, d)),
        "bm25_batch": lambda s, d: fulltext.search_many(fulltext.postings(_docs(s, d)), fulltext.documents_stats(_docs(s, d)), t(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5),
        "typo_candidates": lambda s, d: fulltext.typo_candidates(fulltext.postings(_docs(s, d)), TYPO_WORDS),
        "snippets": lambda s, d: fulltext.snippets(_docs(s, d), "compaction", 20),
        # replicas, manifest, tiers
        "manifest_live": lambda s, d: _hexed(_live(s, d), "segment_id", "segment_hash", "min_key", "max_key", "min_lsn", "max_lsn", "record_count", "compressed_bytes", "cohort_bucket", "death_time"),
        "manifest_json": lambda s, d: segments.manifest_json(_live(s, d)),
        "missing_segments": lambda s, d: segments.missing_segments(_live(s, d), t(s, d, "peer_segments")).select("segment_id", "min_lsn", "max_lsn"),
        "import_lww": lambda s, d: _hexed(segments.import_lww(_log(s, d).where("lsn % 3 <> 0"), _log(s, d).where("lsn % 3 <> 1")), "ns", "key", "value", "op", "ts_ns"),
        "import_counts": lambda s, d: segments.import_counts(_log(s, d).where("lsn % 3 <> 0"), _log(s, d).where("lsn % 3 <> 1")),
        "merkle_ranges": lambda s, d: segments.range_roots(_live(s, d)),
        "merkle_diff": lambda s, d: segments.differing_ranges(segments.range_roots(_live(s, d)), segments.latest_answers(t(s, d, "merkle_responses")).where("host_name = 'peer'")),
        "merkle_buckets": lambda s, d: segments.merkle_buckets(_live(s, d)),
        "merkle_tree_root": lambda s, d: segments.merkle_tree_root(segments.merkle_buckets(_live(s, d))),
        "merkle_buckets_diff": lambda s, d: segments.differing_buckets(segments.merkle_buckets(_live(s, d)), segments.merkle_buckets(segments.register_archived(t(s, d, "peer_segments")))),
        "tier_range": lambda s, d: _hexed(segments.tiered(_log(s, d).where(HOT), _log(s, d).where(COLD)), "ns", "key", "value", "lsn"),
        "tier_range_compat": lambda s, d: _hexed(segments.tiered(_log(s, d).where(HOT), _log(s, d).where(COLD), compat=True), "ns", "key", "value", "lsn"),
        "tier_overlap": lambda s, d: segments.overlapping(_live(s, d), encode_key(F.lit(bytearray(NS)), F.lit(bytearray(START))), encode_key(F.lit(bytearray(NS)), F.lit(bytearray(END)))).select("segment_id"),
        "tier_registered": lambda s, d: segments.register_archived(t(s, d, "peer_segments")).select("segment_id", "segment_hash"),
        "content_hashes": lambda s, d: _log(s, d).select("lsn", content_hash(F.col("value")).alias("hash")).distinct(),
        # upkeep of large logs
        "p2_found": lambda s, d: capture.pending(t(s, d, "wal_records"), t(s, d, "ingest_runs")).select("lsn"),
        "p2_segments": lambda s, d: capture.segments_to_read(_live(s, d), capture.pending(t(s, d, "wal_records"), t(s, d, "ingest_runs"))),
        "p3_found": lambda s, d: consolidate.consolidated_segments(t(s, d, "segments"), t(s, d, "wal_records")),
        "p3_sources": lambda s, d: consolidate.consolidate(t(s, d, "segments"), t(s, d, "wal_records")).sources,
        "p3_totals": lambda s, d: consolidate.consolidated_totals(t(s, d, "segments"), t(s, d, "wal_records")),
        "p4_found": lambda s, d: diff.segment_findings(t(s, d, "segments"), t(s, d, "peer_segments")),
        "p5_found": lambda s, d: changefeed.current_keys(t(s, d, "wal_records")),
        "p5_current_values": lambda s, d: _hexed(changefeed.current_values(t(s, d, "wal_records"))),
    }


_UNDAMAGED = "op IN (1, 2) AND sha256(coalesce(value_bytes, ''::BLOB)) = lower(hex(value_hash))"
_LOG = f"log AS (SELECT ns_bytes AS ns, key_bytes AS key, value_bytes AS value, op, lsn, ts_ns, ttl_s, txid, segment_id AS seg_id FROM wal_records WHERE {_UNDAMAGED})"
_RECORDS = _LOG.replace("AS (SELECT ns_bytes", "AS (SELECT DISTINCT ns_bytes")
_CONTENT = ", ".join(consolidate.CONTENT)
_LIVE_SEGMENTS = """live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY entry_no DESC, entry_type) AS rn
 FROM segments WHERE segment_id IS NOT NULL AND entry_no IS NOT NULL) WHERE rn = 1 AND entry_type = 'Add')"""


def _newest(source: str = "log", where: str = "true", keys: str = "ns, key", order: str = "lsn DESC, op DESC") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn_ FROM {source} WHERE {where}) WHERE rn_ = 1)"


def _blob(value: bytes) -> str:
    return f"'{value.decode()}'::BLOB"


def _hx(*columns: str) -> str:
    return ", ".join(f"lower(hex({c})) AS {c}" for c in columns)


def _bm25(terms: list[tuple[str, float]], docs: str = "documents", limit: int | None = 20, allowed: str = "true") -> str:
    wanted = " UNION ALL ".join(f"SELECT '{w}' AS term, CAST({n} AS DOUBLE) AS weight" for w, n in terms)
    return f"""WITH docs AS (SELECT * FROM {docs}), {_TOKENS},
stats AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS avg_len FROM tok), wanted AS ({wanted}),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
part AS (SELECT p.doc_id, w.weight * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)) AS score
         FROM post p JOIN wanted w ON p.term = w.term JOIN df ON p.term = df.term, stats WHERE p.doc_id IN (SELECT doc_id FROM docs WHERE {allowed}))
SELECT doc_id, round(sum(score), 6) + 0.0 AS score FROM part GROUP BY doc_id ORDER BY 2 DESC, 1{f" LIMIT {limit}" if limit else ""}"""


_TOKENS = r"""tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS terms FROM docs),
exploded AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS ord FROM tok),
post AS (SELECT term, doc_id, count(*) AS tf, any_value(doc_len) AS doc_len FROM exploded JOIN (SELECT doc_id, len(terms) AS doc_len FROM tok) USING (doc_id) GROUP BY term, doc_id)"""
#: Tokens with the character they start at: what lies before is the gaps and the tokens so far.
_PLACES = r"""cut AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ts, regexp_split_to_array(text, '[\p{L}\p{N}]+') AS gaps FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, text, ts, gaps, unnest(generate_series(1, len(ts))) AS i FROM cut WHERE len(ts) > 0),
places AS (SELECT doc_id, text, lower(ts[i]) AS term, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ts[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM numbered)"""
#: Stored vectors from their bytes: little-endian elements of 4, 2 and 1 bytes, by sign, exponent and mantissa.
NODES = """raw AS (SELECT vector_id, ns, dims, dtype, coalesce(lsn, -1) AS lsn, hex(vector_data) AS h FROM hnsw_nodes
 WHERE vector_id IS NOT NULL AND ns IS NOT NULL AND vector_data IS NOT NULL AND dims > 0 AND octet_length(vector_data) = dims * (CASE dtype WHEN 'F32' THEN 4 WHEN 'F16' THEN 2 WHEN 'I8' THEN 1 END)),
whole AS (SELECT *, CASE dtype WHEN 'I8' THEN list_transform(generate_series(0, dims - 1), lambda i: CAST('0x' || substr(h, i * 2 + 1, 2) AS BIGINT))
 WHEN 'F16' THEN list_transform(generate_series(0, dims - 1), lambda i: CAST('0x' || substr(h, i * 4 + 3, 2) || substr(h, i * 4 + 1, 2) AS BIGINT))
 ELSE list_transform(generate_series(0, dims - 1), lambda i: CAST('0x' || substr(h, i * 8 + 7, 2) || substr(h, i * 8 + 5, 2) || substr(h, i * 8 + 3, 2) || substr(h, i * 8 + 1, 2) AS BIGINT)) END AS u FROM raw),
valued AS (SELECT vector_id, ns, dims, dtype, lsn, CASE dtype WHEN 'I8' THEN list_transform(u, lambda x: CAST(CASE WHEN x > 127 THEN x - 256 ELSE x END AS DOUBLE))
 WHEN 'F16' THEN list_transform(u, lambda x: CASE WHEN (x >> 10) & 31 = 31 THEN NULL ELSE (CASE WHEN x >> 15 = 1 THEN -1 ELSE 1 END) * (CASE WHEN (x >> 10) & 31 = 0 THEN (x & 1023) * pow(2.0, -24) ELSE (1 + (x & 1023) / 1024.0::DOUBLE) * pow(2.0, ((x >> 10) & 31) - 15) END) END)
 ELSE list_transform(u, lambda x: CASE WHEN (x >> 23) & 255 = 255 THEN NULL ELSE (CASE WHEN x >> 31 = 1 THEN -1 ELSE 1 END) * (CASE WHEN (x >> 23) & 255 = 0 THEN (x & 8388607) * pow(2.0, -149) ELSE (1 + (x & 8388607) / 8388608.0::DOUBLE) * pow(2.0, ((x >> 23) & 255) - 127) END) END) END AS v FROM whole),
nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY lsn DESC, v) AS rn FROM valued WHERE list_count(v) = dims) WHERE rn = 1)"""
_KV = "lower(hex(key)) AS key, lower(hex(value)) AS value, lsn"


def _page_sql(order: str, test: str) -> str:
    return f"""WITH {_LOG}, rows_ AS (SELECT * FROM {_newest(where=f"ns = {_blob(NS)} AND {test}")} WHERE op <> 2),
head AS (SELECT *, row_number() OVER (ORDER BY key {order}) AS n, count(*) OVER () AS total FROM rows_)
SELECT {_KV}, CASE WHEN total > {PAGE} THEN (SELECT lower(hex(key)) FROM head WHERE n = {PAGE}) END AS next_key FROM head WHERE n <= {PAGE}"""


def _vec_sql(expr: str, where: str = "true", k: int = 10) -> str:
    return f"""WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round({expr}, 6) + 0.0 AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {where}), q ORDER BY 2, 1 LIMIT {k}"""


def _plan_sql(where: str) -> str:
    return f"""WITH {_LIVE_SEGMENTS}, c AS ({_cohort_sql(f"SELECT * FROM live WHERE cohort_bucket IS NOT NULL AND {where}")}),
o AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS step, CAST(coalesce(sum(CASE WHEN expired THEN 0 ELSE bytes END) OVER (ORDER BY expired DESC, max_death NULLS LAST, cohort_bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before
      FROM c WINDOW w AS (ORDER BY expired DESC, max_death NULLS LAST, cohort_bucket))
SELECT *, bytes_before < 50000000 AS chosen FROM o"""


def _cohort_sql(source: str) -> str:
    return f"""SELECT cohort_bucket, max(death_time) AS max_death, CAST(coalesce(sum(record_count), 0) AS BIGINT) AS records, CAST(coalesce(sum(compressed_bytes), 0) AS BIGINT) AS bytes,
 count(*) AS n_segments, coalesce({NOW} > max(death_time), false) AS expired FROM ({source}) GROUP BY cohort_bucket"""


def _buckets(source: str, name: str) -> str:
    return f"""{name}_groups AS (SELECT bucket, segment_id // 4096 AS part, sha256(string_agg(r, '' ORDER BY segment_id, r)) AS root FROM (SELECT segment_id, coalesce({_HASH.format(c='merkle_root')}, '') AS r,
 CASE WHEN length(substr(hex(min_key), 5)) > 0 THEN coalesce(TRY_CAST('0x' || substr(hex(min_key), 5 + 2 * CAST('0x' || substr(hex(min_key), 1, 4) AS INTEGER), 1) AS INTEGER), 0) ELSE 0 END AS bucket FROM {source}) GROUP BY 1, 2),
{name}_held AS (SELECT bucket, sha256(string_agg(root, '' ORDER BY part)) AS root FROM {name}_groups GROUP BY 1),
{name} AS (SELECT CAST(range AS INTEGER) AS bucket, coalesce(root, repeat('0', 64)) AS root FROM range(16) LEFT JOIN {name}_held ON bucket = range)"""


_HASH = "replace(lower(trim({c})), '0x', '')"
_ROOT = "sha256(string_agg({h}, '' ORDER BY {h}))"
_DEATH = f"ts_ns + CASE WHEN ttl_s = 0 THEN {WINDOW} ELSE ttl_s END * 1000000000"
_BUCKET = f"(ts_ns // 1000000000 + ttl_s) // {WINDOW}"
_ENCODED = "unhex(lpad(printf('%x', octet_length({ns})), 4, '0')) || {ns} || {key}"


def oracle_sql() -> dict[str, str]:
    ns = f"ns = {_blob(NS)}"
    span = f"{ns} AND key >= {_blob(START)} AND key < {_blob(END)}"
    enc = _ENCODED.format(ns="ns", key="key")
    root = _ROOT.format(h="h")
    ranges = f"SELECT segment_id // 100 AS range_no, coalesce({root}, repeat('0', 64)) AS root FROM (SELECT segment_id, {_HASH.format(c='segment_hash')} AS h FROM live) GROUP BY 1"
    pairs = f"""runs AS (SELECT * FROM ingest_runs WHERE lower(trim(status)) = 'committed'),
first AS (SELECT lsn, min(arrived_at) AS arrived_at FROM wal_records WHERE {_UNDAMAGED} GROUP BY lsn),
pending AS (SELECT lsn FROM first f WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.from_lsn < f.lsn AND f.lsn <= r.to_lsn AND r.started_at >= f.arrived_at))"""
    fields = [f for f in segments.META if f != "created_at"]
    same = lambda f: _HASH.format(c=f) if f in segments.HASHES else f
    plain = ", ".join(f"{same(f)} AS {f}" for f in fields)
    differ = "\nUNION ALL ".join(f"SELECT DISTINCT a.segment_id, '{f}' FROM a JOIN b USING (segment_id) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in fields)
    return {
        "kv_latest": f"WITH {_LOG} SELECT lower(hex(ns)) AS ns, {_KV} FROM {_newest()} WHERE op <> 2",
        "kv_get": f"WITH {_LOG} SELECT {_KV} FROM {_newest(where=f'{ns} AND key = {_blob(KEY)}')} WHERE op <> 2",
        "kv_get_into": f"WITH {_LOG} SELECT count(*) > 0 AS found, lower(hex(max(value))) AS value FROM {_newest(where=f'{ns} AND key = {_blob(KEY)}')} WHERE op <> 2",
        "kv_multi_get": f"WITH {_LOG} SELECT lower(hex(ns)) AS ns, {_KV} FROM {_newest(where='(ns, key) IN (SELECT (ns, key) FROM log WHERE lsn % 50 = 0)')} WHERE op <> 2",
        "kv_get_stats": f"""WITH {_LOG}, mine AS (SELECT * FROM log WHERE {ns} AND key = {_blob(KEY)}), hit AS (SELECT * FROM {_newest('mine')} WHERE op <> 2)
SELECT (SELECT count(DISTINCT seg_id) FROM mine) AS segments_scanned, (SELECT lower(hex(value)) FROM hit) AS value,
 CAST(coalesce((SELECT {2 + len(NS) + len(KEY)} + coalesce(octet_length(value), 0) FROM hit), 0) AS BIGINT) AS bytes_read, (SELECT count(*) FROM hit) AS items_examined""",
        "kv_range": f"WITH {_LOG} SELECT {_KV} FROM {_newest(where=span)} WHERE op <> 2",
        "kv_range_stats": f"""WITH {_LOG}, cost AS (SELECT ns, key, value FROM {_newest(where=f'{span} AND seg_id IS NOT NULL')} WHERE op <> 2
 UNION ALL SELECT ns, key, value FROM {_newest(where=f'{span} AND seg_id IS NULL')})
SELECT count(*) AS items_examined, CAST(coalesce(sum(2 + octet_length(ns) + octet_length(key) + coalesce(octet_length(value), 0)), 0) AS BIGINT) AS bytes_read,
 (SELECT count(*) FROM {_newest(where=span)} WHERE op <> 2) AS rows_returned FROM cost""",
        "kv_range_budget_items": f"WITH {_LOG}, r AS (SELECT *, count(*) OVER () AS total FROM {_newest(where=ns)} WHERE op <> 2) SELECT {_KV}, total > {PAGE} AS truncated FROM r ORDER BY r.key LIMIT {PAGE}",
        "kv_range_budget_bytes": f"""WITH {_LOG}, r AS (SELECT *, 2 + octet_length(ns) + octet_length(key) + coalesce(octet_length(value), 0) AS cost FROM {_newest(where=ns)} WHERE op <> 2),
s AS (SELECT *, CAST(sum(cost) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_so_far FROM r) SELECT {_KV}, bytes_so_far FROM s WHERE bytes_so_far - cost < 4000""",
        "kv_prefix": f"WITH {_LOG} SELECT {_KV} FROM {_newest(where=f'{ns} AND key >= {_blob(PREFIX)} AND key < {_blob(PREFIX[:-1] + bytes([PREFIX[-1] + 1]))}')} WHERE op <> 2",
        "kv_page": _page_sql("ASC", f"key > {_blob(CURSOR)}"),
        "kv_rev_page": _page_sql("DESC", f"key < {_blob(CURSOR)}"),
        "kv_snapshot_range": f"WITH {_LOG} SELECT {_KV} FROM {_newest(where=f'{ns} AND seg_id IS NOT NULL AND lsn <= {AS_OF}')} WHERE op <> 2",
        "kv_snapshot_segments": f"WITH {_LOG}, {_LIVE_SEGMENTS} SELECT lower(hex(ns)) AS ns, {_KV} FROM {_newest(where='seg_id IN (SELECT segment_id FROM live)')} WHERE op <> 2",
        "kv_namespace_isolation": f"WITH {_LOG} SELECT lower(hex(ns)) AS ns, count(*) AS live_keys FROM {_newest()} WHERE op <> 2 GROUP BY 1",
        "kv_encoded_keys": f"WITH {_LOG} SELECT lower(hex({enc})) AS encoded, lsn FROM {_newest()} WHERE op <> 2",
        "ns_names": "SELECT DISTINCT ns, regexp_replace(ns, '[^A-Za-z0-9_-]', '_', 'g') AS slug, '__vec__' || ns AS vec_ns, '__text__' || ns AS text_ns FROM documents",
        "tx_committed_view": f"WITH {_LOG} SELECT lower(hex(ns)) AS ns, {_KV} FROM {_newest(where='coalesce(txid, 0) NOT IN (SELECT txid FROM log WHERE txid % 5 = 0 AND txid <> 0)')} WHERE op <> 2",
        "flush_retained": f"WITH {_RECORDS} SELECT lower(hex(ns)) AS ns, {_KV}, seg_id FROM log WHERE lsn > {AS_OF}",
        "confirmed_lsn": f"WITH {_LIVE_SEGMENTS} SELECT coalesce(max(max_lsn), 0) AS confirmed_lsn FROM live",
        "strip_namespace": f"WITH {_LOG} SELECT lower(hex(ns)) AS ns, count(DISTINCT lsn) AS records FROM log WHERE NOT (ns >= '__text__'::BLOB AND ns < '__text`'::BLOB) GROUP BY 1",
        "delete_hidden": f"WITH {_LOG} SELECT {_hx('ns', 'key')}, lsn FROM {_newest()} WHERE op = 2",
        "cohort_and_death": f"WITH {_RECORDS} SELECT lsn, seg_id, {_BUCKET} AS cohort_bucket, {_DEATH} AS death_time FROM log",
        "segment_meta": f"""WITH {_RECORDS}, k AS (SELECT *, {enc} AS ekey, {_BUCKET} AS bucket, {_DEATH} AS death FROM log WHERE seg_id IS NOT NULL)
SELECT seg_id, lower(hex(min(ekey))) AS min_key, lower(hex(max(ekey))) AS max_key, min(lsn) AS min_lsn, max(lsn) AS max_lsn, count(*) AS record_count,
 CAST(sum(octet_length(ekey) + coalesce(octet_length(value), 0)) AS BIGINT) AS bytes, arg_min(bucket, lower(hex(ekey)) || lpad(CAST(lsn AS VARCHAR), 12, '0')) AS cohort_bucket, max(death) AS death_time
FROM k GROUP BY seg_id""",
        "segment_roots": f"WITH {_LOG} SELECT seg_id, {root} AS merkle_root FROM (SELECT DISTINCT seg_id, sha256({enc}) AS h FROM log WHERE seg_id IS NOT NULL) GROUP BY seg_id",
        "cohorts": f"WITH {_LIVE_SEGMENTS} {_cohort_sql('SELECT * FROM live')}",
        "expired_segments": f"WITH {_LIVE_SEGMENTS} SELECT segment_id, cohort_bucket FROM live WHERE cohort_bucket IN (SELECT cohort_bucket FROM live GROUP BY 1 HAVING {NOW} > max(death_time))",
        "compact_survivors": f"""WITH {_RECORDS}, b AS (SELECT *, {_BUCKET} AS cohort_bucket, {_DEATH} AS death_time FROM log)
SELECT cohort_bucket, lower(hex(ns)) AS ns, {_KV}, death_time FROM {_newest('b', keys='cohort_bucket, ns, key', order='lsn DESC')} WHERE op <> 2 AND death_time > {NOW}""",
        "compact_plan": _plan_sql("true"),
        "compact_pinned": _plan_sql("segment_id % 3 <> 0"),
        "droppable_tombstones": f"WITH {_LOG} SELECT {_hx('ns', 'key')} FROM (SELECT ns, key, count(DISTINCT lsn) AS n, arg_max(op, lsn) AS last FROM log GROUP BY ns, key) WHERE n = 1 AND last = 2",
        "vec_cosine_topk": _vec_sql("list_cosine_distance(v, qv)"),
        "vec_l2_topk": _vec_sql("list_distance(v, qv)"),
        "vec_dot_topk": _vec_sql("-list_inner_product(v, qv)"),
        "vec_zero_norm": "SELECT vec_id, 0.0::DOUBLE AS distance FROM embeddings ORDER BY vec_id LIMIT 5",
        "vec_mismatch_skipped": _vec_sql("list_distance(v, qv)", "vec_id % 2 <> 0"),
        "vec_batch_knn": """SELECT * FROM (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank
 FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""",
        "vec_page": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 20",
        "vec_search_cost": "SELECT count(*) AS items_examined, CAST(sum(length(CAST(vec_id AS VARCHAR)) + len(embedding) * 4 + 3) AS BIGINT) AS bytes_read FROM embeddings",
        "vec_sq8": """SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x: CAST(trunc(greatest(-128.0, least(127.0,
 (x - list_min(embedding::DOUBLE[])) * 255.0 / (CASE WHEN list_max(embedding) = list_min(embedding) THEN 1.0 ELSE list_max(embedding::DOUBLE[]) - list_min(embedding::DOUBLE[]) END) - 128.0))) AS INTEGER)), ',') AS codes FROM embeddings""",
        "tokens": f"WITH docs AS (SELECT * FROM documents), {_TOKENS} SELECT doc_id, CAST(ord AS INTEGER) AS ord, term FROM exploded",
        "postings": f"WITH docs AS (SELECT * FROM documents), {_TOKENS} SELECT term, doc_id, tf, CAST(doc_len AS BIGINT) AS doc_len FROM post",
        "corpus_stats": f"WITH docs AS (SELECT * FROM documents), {_TOKENS} SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total_len, round(sum(len(terms)) / count(*), 6) + 0.0 AS avg_len FROM tok",
        "bm25_topk": _bm25([("segment", 2), ("compaction", 1), ("vector", 1)]),
        "bm25_facets": _bm25([("segment", 2), ("compaction", 1), ("vector", 1)], allowed="lang = 'en' AND source = 'forum'"),
        "bm25_typo": f"""WITH docs AS (SELECT * FROM documents), {_TOKENS}, voc AS (SELECT DISTINCT term FROM post),
stats AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS avg_len FROM tok),
wanted AS (SELECT term, sum(weight) AS weight FROM (SELECT 'segmnt' AS term, 1.0::DOUBLE AS weight UNION ALL SELECT 'vektor', 1.0
 UNION ALL SELECT term, 0.5 FROM voc WHERE levenshtein(term, 'segmnt') = 1 UNION ALL SELECT term, 0.5 FROM voc WHERE levenshtein(term, 'vektor') = 1) GROUP BY term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)
SELECT p.doc_id, round(sum(w.weight * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) + 0.0 AS score
FROM post p JOIN wanted w ON p.term = w.term JOIN df ON p.term = df.term, stats GROUP BY p.doc_id ORDER BY 2 DESC, 1 LIMIT 20""",
        "bm25_stats": f"""WITH docs AS (SELECT * FROM documents), {_TOKENS} SELECT (SELECT count(*) FROM documents) AS total_docs_indexed,
 (SELECT count(DISTINCT doc_id) FROM post WHERE term IN ('segment', 'compaction', 'vector')) AS docs_examined""",
        "bm25_after_delete": _bm25([("segment", 2), ("compaction", 1), ("vector", 1)], docs="documents WHERE doc_id % 3 <> 0"),
        "bm25_single_doc": _bm25([("segment", 2), ("compaction", 1), ("vector", 1)], limit=None, allowed="doc_id = (SELECT min(doc_id) FROM documents WHERE regexp_matches(lower(text), '\\bsegment\\b'))"),
        "typo_candidates": f"""WITH docs AS (SELECT * FROM documents), {_TOKENS}, voc AS (SELECT DISTINCT term FROM post)
SELECT q AS query_term, term FROM voc, (SELECT unnest({TYPO_WORDS}) AS q) WHERE abs(length(term) - length(q)) <= 1 AND regexp_full_match(term, '[ -~]+') AND levenshtein(term, q) = 1""",
        "manifest_live": f"WITH {_LIVE_SEGMENTS} SELECT segment_id, segment_hash, {_hx('min_key', 'max_key')}, min_lsn, max_lsn, record_count, compressed_bytes, cohort_bucket, death_time FROM live",
        "missing_segments": f"WITH {_LIVE_SEGMENTS} SELECT segment_id, min_lsn, max_lsn FROM peer_segments p WHERE NOT EXISTS (SELECT 1 FROM live l WHERE {_HASH.format(c='l.segment_hash')} = {_HASH.format(c='p.segment_hash')})",
        "import_lww": f"""WITH {_LOG}, both_ AS (SELECT *, true AS loc FROM log WHERE lsn % 3 <> 0 UNION ALL SELECT *, false FROM log WHERE lsn % 3 <> 1)
SELECT {_hx('ns', 'key', 'value')}, CAST(op AS TINYINT) AS op, ts_ns FROM {_newest('both_', order='ts_ns DESC, loc DESC, lsn DESC')}""",
        "import_counts": f"""WITH {_LOG}, mine AS (SELECT ns, key, max(ts_ns) AS m FROM log WHERE lsn % 3 <> 0 GROUP BY 1, 2), theirs AS (SELECT ns, key, max(ts_ns) AS x FROM log WHERE lsn % 3 <> 1 GROUP BY 1, 2)
SELECT CAST(coalesce(sum(CASE WHEN m IS NULL OR x > m THEN 1 ELSE 0 END), 0) AS BIGINT) AS written, CAST(coalesce(sum(CASE WHEN m IS NULL OR x > m THEN 0 ELSE 1 END), 0) AS BIGINT) AS skipped FROM theirs LEFT JOIN mine USING (ns, key)""",
        "merkle_ranges": f"WITH {_LIVE_SEGMENTS} {ranges}",
        "merkle_diff": f"""WITH {_LIVE_SEGMENTS}, a AS ({ranges}), b AS (SELECT range_no, {_HASH.format(c='root')} AS root FROM (SELECT *, row_number() OVER (PARTITION BY host_name, range_no ORDER BY probed_at DESC NULLS LAST, root NULLS LAST) AS rn FROM merkle_responses WHERE range_no IS NOT NULL) WHERE rn = 1 AND host_name = 'peer')
SELECT range_no, a.root AS left_root, b.root AS right_root FROM a FULL JOIN b USING (range_no) WHERE a.root IS DISTINCT FROM b.root""",
        "tier_range": f"WITH {_LOG} SELECT lower(hex(ns)) AS ns, {_KV} FROM {_newest()} WHERE op <> 2",
        "tier_range_compat": f"""WITH {_LOG}, hot AS (SELECT * FROM {_newest(where=HOT)} WHERE op <> 2), cold AS (SELECT * FROM {_newest(where=COLD)} WHERE op <> 2)
SELECT lower(hex(ns)) AS ns, {_KV} FROM (SELECT * FROM hot UNION ALL SELECT * FROM cold c WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE h.ns = c.ns AND h.key = c.key))""",
        "tier_overlap": f"WITH {_LIVE_SEGMENTS} SELECT segment_id FROM live WHERE max_key >= '\\x00\\x05'::BLOB || {_blob(NS + START)} AND min_key < '\\x00\\x05'::BLOB || {_blob(NS + END)}",
        "tier_registered": f"SELECT segment_id, segment_hash FROM (SELECT *, row_number() OVER (PARTITION BY {_HASH.format(c='segment_hash')} ORDER BY segment_id, segment_hash) AS rn FROM peer_segments) WHERE rn = 1 OR segment_hash IS NULL",
        "kv_text_values": f"WITH {_LOG} SELECT lower(hex(key)) AS key, lsn, TRY(decode(value)) AS value_text FROM {_newest()} WHERE op <> 2",
        "manifest_json": f"""WITH {_LIVE_SEGMENTS} SELECT segment_id, '{{"format_version":1,"segment_id":' || segment_id || coalesce(',"hash":"' || {_HASH.format(c='segment_hash')} || '"', '') || coalesce(',"min_key":"' || lower(hex(min_key)) || '"', '')
 || coalesce(',"max_key":"' || lower(hex(max_key)) || '"', '') || coalesce(',"min_lsn":' || min_lsn, '') || coalesce(',"max_lsn":' || max_lsn, '') || coalesce(',"record_count":' || record_count, '') || '}}' AS entry FROM live""",
        "merkle_buckets": f"WITH {_LIVE_SEGMENTS}, {_buckets('live', 'b')} SELECT * FROM b",
        "merkle_tree_root": f"WITH {_LIVE_SEGMENTS}, {_buckets('live', 'b')} SELECT sha256(string_agg(root, '' ORDER BY bucket)) AS root FROM b",
        "merkle_buckets_diff": f"""WITH {_LIVE_SEGMENTS}, {_buckets('live', 'b')}, peer AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_HASH.format(c='segment_hash')} ORDER BY segment_id, segment_hash) AS rn FROM peer_segments) WHERE rn = 1 OR segment_hash IS NULL),
{_buckets('peer', 'c')} SELECT bucket FROM b JOIN c USING (bucket) WHERE b.root <> c.root""",
        "vec_nan_last": """WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 7), d AS (SELECT vec_id, vec_id > 5 AS is_nan, CASE WHEN vec_id > 5 THEN NULL ELSE round(list_distance(embedding::DOUBLE[], qv), 6) END AS x FROM embeddings, q)
SELECT vec_id, is_nan FROM d ORDER BY x NULLS LAST, vec_id LIMIT 10""",
        "vec_search_stats": _vec_sql("list_cosine_distance(v, qv)", k=5).replace("SELECT vec_id, round", "SELECT vec_id, (SELECT count(*) FROM embeddings) AS items_examined, (SELECT CAST(sum(length(CAST(vec_id AS VARCHAR)) + len(embedding) * 4 + 3) AS BIGINT) FROM embeddings) AS bytes_read, round").replace("ORDER BY 2, 1", "ORDER BY 4, 1"),
        "vec_nodes": f"WITH {NODES} SELECT vector_id, ns, dims, dtype, round(v[1], 6) + 0.0 AS first, round(v[-1], 6) + 0.0 AS last, round(round(list_reduce(v, lambda a, x: a + x), 3), 6) + 0.0 AS total FROM nodes",
        "vec_count": f"WITH {NODES} SELECT ns, count(*) AS vectors FROM nodes GROUP BY ns",
        "token_places": f"WITH {_PLACES} SELECT doc_id, term, CAST(pos AS INTEGER) AS pos FROM places",
        "snippets": f"""WITH {_PLACES}, m AS (SELECT doc_id, pos, text, pos + length(regexp_extract(substr(text, pos + 1), '^[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]*')) AS stop FROM places WHERE term = 'compaction'),
w AS (SELECT *, greatest(0, pos - 20) AS lo, least(length(text), stop + 20) AS hi FROM m)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, substr(text, lo + 1, hi - lo) AS snippet, CAST(octet_length(encode(substr(text, lo + 1, pos - lo))) AS INTEGER) AS match_start,
 CAST(octet_length(encode(substr(text, lo + 1, stop - lo))) AS INTEGER) AS match_end FROM w""",
        "bm25_batch": f"""WITH docs AS (SELECT * FROM documents), {_TOKENS}, stats AS (SELECT count(*) AS n, sum(len(terms)) / count(*) AS avg_len FROM tok),
asked AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM eval_items), weights AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS weight FROM asked GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) + 0.0 AS score FROM post JOIN weights USING (term) JOIN df USING (term), stats GROUP BY query_id, doc_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 5""",
        "content_hashes": f"WITH {_LOG} SELECT DISTINCT lsn, sha256(coalesce(value, ''::BLOB)) AS hash FROM log",
        "p2_found": f"WITH {pairs} SELECT lsn FROM pending",
        "p2_segments": f"""WITH {_LIVE_SEGMENTS}, {pairs}, held AS (SELECT segment_id, count(*) AS may_hold FROM live JOIN pending ON lsn BETWEEN min_lsn AND max_lsn GROUP BY 1)
SELECT segment_id, may_hold FROM held UNION ALL SELECT segment_id, NULL FROM live WHERE min_lsn IS NULL OR max_lsn IS NULL""",
        "p3_found": f"WITH {_LIVE_SEGMENTS} SELECT segment_id FROM live WHERE compressed_bytes < 16384",
        "p3_sources": f"""WITH {_LIVE_SEGMENTS}, small AS (SELECT segment_id FROM live WHERE compressed_bytes < 16384), held AS (SELECT segment_id, {_CONTENT} FROM wal_records WHERE segment_id IN (SELECT segment_id FROM small)),
n AS (SELECT segment_id, count(*) AS records FROM held GROUP BY 1), u AS (SELECT segment_id, count(*) AS k FROM (SELECT DISTINCT * FROM held) GROUP BY 1)
SELECT segment_id, coalesce(records, 0) AS records, coalesce(k, 0) AS distinct_records, coalesce(k, 0) AS moved FROM small LEFT JOIN n USING (segment_id) LEFT JOIN u USING (segment_id)""",
        "p3_totals": f"""WITH {_LIVE_SEGMENTS}, small AS (SELECT segment_id FROM live WHERE compressed_bytes < 16384), held AS (SELECT {_CONTENT} FROM wal_records WHERE segment_id IN (SELECT segment_id FROM small)),
u AS (SELECT DISTINCT *, {_ENCODED.format(ns="coalesce(ns_bytes, ''::BLOB)", key="coalesce(key_bytes, ''::BLOB)")} AS ekey FROM held)
SELECT (SELECT count(*) FROM small) AS segments, (SELECT count(*) FROM held) AS given, count(*) AS stored, min(lsn) AS min_lsn, max(lsn) AS max_lsn, lower(hex(min(ekey))) AS min_key, lower(hex(max(ekey))) AS max_key FROM u""",
        "p4_found": f"""WITH {_LIVE_SEGMENTS}, a AS (SELECT DISTINCT segment_id, {plain} FROM live), b AS (SELECT DISTINCT segment_id, {plain} FROM peer_segments WHERE segment_id IS NOT NULL)
SELECT segment_id, 'missing_on_peer' AS finding FROM a ANTI JOIN b USING (segment_id) UNION ALL SELECT DISTINCT segment_id, 'missing_on_primary' FROM b ANTI JOIN a USING (segment_id)
UNION ALL {differ}""",
        "p5_found": f"SELECT lower(hex(ns_bytes)) AS ns_hex, lower(hex(key_bytes)) AS key_hex, max(lsn) AS lsn FROM wal_records WHERE {_UNDAMAGED} GROUP BY ns_bytes, key_bytes HAVING arg_max(op, lsn) = 1",
        "p5_current_values": f"WITH {_LOG} SELECT lower(hex(ns)) AS ns_bytes, lower(hex(key)) AS key_bytes, lsn, lower(hex(value)) AS value_bytes FROM {_newest()} WHERE op = 1",
    }
