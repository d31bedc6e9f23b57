import hashlib

from pyspark.sql import functions as F

from tests.conftest import tuples
from tests.test_feeds import manifest
from tests.test_kv import log
from tidelog.functions.bytesx import decode_key, encode_key
from tidelog.operators import cohorts, segments


def test_cohort_and_death_values(spark):
    rows = spark.createDataFrame([(3_600_000_000_000, 0), (0, 7200), (0, 3600), (0, 0), ((1 << 63) - 5, 9)], "ts bigint, ttl bigint")
    got = rows.select(cohorts.cohort_bucket(F.col("ts"), F.col("ttl"), 3600), cohorts.death_time(F.col("ts"), F.col("ttl"), 3600, "window"), cohorts.death_time(F.col("ts"), F.col("ttl"), 3600)).collect()
    assert [r[0] for r in got][:4] == [1, 2, 1, 0]
    assert [r[1] for r in got] == [7_200_000_000_000, 7_200_000_000_000, 3_600_000_000_000, 3_600_000_000_000, cohorts.NEVER]
    assert got[0][2] == cohorts.NEVER and got[2][2] == 3_600_000_000_000


def test_cohorts_and_plan(spark):
    segs = spark.createDataFrame([(0, 1, 3_000_000_000, 5, 10), (1, 1, 5_000_000_000, 5, 10), (2, 2, 20_000_000_000, 10, 10), (3, 3, 30_000_000_000, 1, 50)], "segment_id bigint, cohort_bucket bigint, death_time bigint, record_count bigint, compressed_bytes bigint")
    now = 10_000_000_000
    plan = cohorts.compact_plan(segs, now, 10).orderBy("step").collect()
    assert [(r["cohort_bucket"], r["expired"], r["max_death"], r["records"], r["chosen"]) for r in plan] == [(1, True, 5_000_000_000, 10, True), (2, False, 20_000_000_000, 10, True), (3, False, 30_000_000_000, 1, False)]
    assert tuples(cohorts.expired_segments(segs, now), "segment_id") == [(0,), (1,)]
    pinned = segs.where("segment_id = 1")
    assert cohorts.compact_plan(segs, now, 10, pinned).where("cohort_bucket = 1").first()["records"] == 5


def test_survivors(spark):
    rows = [(b"n", b"alive-a", b"v", 1, 1, 0), (b"n", b"dead", b"v", 1, 2, 0), (b"n", b"deleted", b"v", 1, 3, 0), (b"n", b"deleted", None, 2, 4, 0)]
    df = log(spark, rows).withColumn("ts_ns", F.lit(3_600_000_000_000)).withColumn("ttl_s", F.when(F.col("key") == F.lit(bytearray(b"dead")), 1).otherwise(0).cast("bigint"))
    assert tuples(cohorts.compact_survivors(df, 3600, 3_602_000_000_000), "key") == [(b"alive-a",)]
    assert tuples(cohorts.droppable_tombstones(df), "key") == []


def test_manifest_and_roots(spark):
    live = segments.live_segments(manifest(spark, [(3, "Add", 1, 5), (1, "Add", 1, 4), (2, "Remove", 1, None), (9, "Remove", 2, None), (8, "Add", 2, 1), (None, "Add", 4, 1)]))
    assert tuples(live, "segment_id", "compressed_bytes") == [(1, 5)]
    root = segments.range_roots(live).first()
    assert root["root"] == hashlib.sha256(b"ab").hexdigest()
    assert segments.store_root(live).count() == 1
    a = spark.createDataFrame([(1, "x"), (2, "y")], "range_no bigint, root string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "range_no bigint, root string")
    assert tuples(segments.differing_ranges(a, b), "range_no") == [(2,), (3,)]


def test_missing_keeps_order_and_copies(spark):
    local = spark.createDataFrame([("AB",)], "segment_hash string")
    peer = spark.createDataFrame([(1, "0xab"), (2, "cd"), (3, "cd"), (4, None)], "segment_id bigint, segment_hash string")
    assert tuples(segments.missing_segments(local, peer), "segment_id") == [(2,), (3,), (4,)]


def test_import_by_time(spark):
    a = log(spark, [(b"n", b"shared", b"local", 1, 5, None), (b"n", b"tie", b"local", 1, 6, None)])
    b = log(spark, [(b"n", b"shared", b"peer", 1, 9, None), (b"n", b"tie", b"peer", 1, 6, None), (b"n", b"new", b"peer", 1, 1, None)])
    assert tuples(segments.import_lww(a, b), "key", "value") == [(b"new", b"peer"), (b"shared", b"peer"), (b"tie", b"local")]
    assert tuples(segments.import_counts(a, b)) == [(2, 1)]
    assert [r["lsn"] for r in segments.resequence(b, 100, [F.col("ts_ns"), F.col("key")]).orderBy("lsn").collect()] == [101, 102, 103]


def test_tiers(spark):
    cold = log(spark, [(b"n", b"a", b"cold", 1, 1, 0), (b"n", b"b", b"cold", 1, 2, 0)])
    hot = log(spark, [(b"n", b"a", None, 2, 5, 1)])
    assert tuples(segments.tiered(hot, cold), "key") == [(b"b",)]
    assert tuples(segments.tiered(hot, cold, compat=True), "key") == [(b"a",), (b"b",)]


def test_key_encoding(spark):
    df = spark.createDataFrame([(b"users", b"alice"), (b"", b"\xff\x00")], "ns binary, key binary").withColumn("e", encode_key(F.col("ns"), F.col("key")))
    assert bytes(df.first()["e"]) == b"\x00\x05usersalice"
    ns, key = decode_key(F.col("e"))
    assert df.where((ns == F.col("ns")) & (key == F.col("key"))).count() == 2


def test_key_range_tree(spark):
    import hashlib

    schema = "segment_id bigint, min_key binary, merkle_root string, bucket string"
    key = lambda k: (1).to_bytes(2, "big") + b"n" + k
    rows = [(9_000, key(b"\x1f"), "0xAA", "clash"), (2, key(b"\x10"), "bb", "clash"), (3, key(b""), "cc", None), (4, None, None, None), (5, key(b"\xff"), "dd", None)]
    tree = segments.merkle_buckets(spark.createDataFrame(rows, schema))
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    want = {b: "0" * 64 for b in range(16)} | {0: sha(sha("cc", "")), 1: sha(sha("bb"), sha("aa")), 15: sha(sha("dd"))}
    assert {r["bucket"]: r["root"] for r in tree.collect()} == want
    assert segments.merkle_tree_root(tree).first()["root"] == sha(*[want[b] for b in range(16)])
    other = segments.merkle_buckets(spark.createDataFrame(rows[1:], schema))
    assert [r[0] for r in segments.differing_buckets(tree, other).collect()] == [1]
    assert segments.differing_buckets(tree, tree).count() == 0
    assert {r["root"] for r in segments.merkle_buckets(spark.createDataFrame([], schema)).collect()} == {"0" * 64}


def test_roots_of_segments_stream_over_batches(spark):
    import hashlib

    rows = [(b"n", b"k%05d" % (i % 9_000), i, i % 2 or None) for i in range(30_000)]
    df = spark.createDataFrame(rows, "ns binary, key binary, lsn bigint, seg_id bigint").withColumn("h", F.lit("clash"))
    keys = {hashlib.sha256((1).to_bytes(2, "big") + b"n" + k).hexdigest() for _, k, _, s in rows if s}
    assert [tuple(r) for r in segments.segment_roots(df).collect()] == [(1, hashlib.sha256("".join(sorted(keys)).encode()).hexdigest())]
    assert segments.segment_roots(df.limit(0)).count() == 0


def test_registered_segments_of_unknown_hash_all_stay(spark):
    df = spark.createDataFrame([(1, "0xAB"), (2, "ab "), (3, None), (4, None)], "segment_id bigint, segment_hash string")
    assert sorted(r[0] for r in segments.register_archived(df).select("segment_id").collect()) == [1, 3, 4]
