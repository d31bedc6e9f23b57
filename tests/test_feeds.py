"""Change feed, capture, diff, consolidation."""

import datetime as dt
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from tidelog.operators import capture, changefeed, consolidate, diff

WAL = "txid bigint, lsn bigint, ts_ns bigint, ttl_s bigint, ns_len int, ns_bytes binary, key_bytes binary, op tinyint, value_hash binary, value_bytes binary, segment_id bigint, arrived_at timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def wal_row(lsn, key=b"k", op=1, value=b"v", seg=1, minute=0, bad=False):
    digest = hashlib.sha256((value or b"") + (b"!" if bad else b"")).digest()
    return (0, lsn, (lsn or 0) * 10, 0, 1, b"n", key, op, digest, value, seg, DAY + dt.timedelta(minutes=minute))


def wal(spark, rows):
    return spark.createDataFrame(rows, WAL)


def test_feed_any_order_and_copies(spark):
    rnd = random.Random(2)
    rows, model = [], {}
    for lsn in range(1, 300):
        key, op = (b"hot" if rnd.random() < 0.4 else b"k%d" % rnd.randrange(40)), 2 if rnd.random() < 0.3 else 1
        value = None if op == 2 else b"%d" % lsn
        rows.append(wal_row(lsn, key, op, value))
        model[key] = (op, lsn, value)
    rows.append(wal_row(1000, b"k1", 1, b"damaged", bad=True))
    rows.append(wal_row(1001, b"k2", 7))
    rows += rnd.sample(rows, 80)
    rnd.shuffle(rows)
    df = wal(spark, rows).withColumn("_put", F.lit("clash")).withColumn("_batch", F.lit(1))
    want = sorted(((b"n", k, lsn, v) for k, (op, lsn, v) in model.items() if op == 1), key=repr)
    for batches in (1, 4, 7):
        assert tuples(changefeed.current_values(df, batches=batches)) == want
    assert tuples(changefeed.current_keys(df)) == sorted(((b"n".hex(), k.hex(), lsn) for _, k, lsn, _ in want), key=repr)


def test_feed_with_base_and_empty(spark):
    base = spark.createDataFrame([(b"n", b"k", b"old"), (b"n", b"kept", b"base"), (b"n", b"gone", b"base")], "ns_bytes binary, key_bytes binary, value_bytes binary")
    feed = wal(spark, [wal_row(5, b"k", 1, b"new"), wal_row(6, b"gone", 2, None)])
    assert tuples(changefeed.current_values(feed, base)) == [(b"n", b"k", 5, b"new"), (b"n", b"kept", None, b"base")]
    assert changefeed.current_values(feed.limit(0)).count() == 0
    assert changefeed.current_values(feed.limit(0), base).count() == 3


def runs(spark, rows):
    return spark.createDataFrame([(i, a, b, None if m is None else DAY + dt.timedelta(minutes=m), None, s) for i, (a, b, m, s) in enumerate(rows)], "run_id bigint, from_lsn bigint, to_lsn bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string")


def test_pending_against_brute_force(spark):
    rnd = random.Random(3)
    records = [(lsn, rnd.randrange(100)) for lsn in range(1, 6000, 7)]
    done = [(a, a + rnd.choice([0, 5, 400, 5000]), rnd.choice([None, 10, 50, 90]), rnd.choice([" Committed", "committed", "failed", None])) for a in rnd.choices(range(6000), k=60)]
    done += [(None, 50, 10, "committed"), done[0], done[0]]
    rows = [wal_row(lsn, b"%d" % lsn, minute=m) for lsn, m in records]
    rows += [wal_row(lsn, b"%d" % lsn, minute=m + 50) for lsn, m in records[:100]] + [wal_row(7001, bad=True)]
    good = [d for d in done if d[0] is not None and d[2] is not None and (d[3] or "").strip().lower() == "committed"]
    want = [(lsn,) for lsn, m in records if not any(a < lsn <= b and s >= m for a, b, s, _ in good)]
    got = capture.pending(wal(spark, rows).withColumn("part", F.lit("clash")), runs(spark, done)).select("lsn")
    assert tuples(got) == sorted(want, key=repr)
    assert capture.pending(wal(spark, rows).limit(0), runs(spark, done)).count() == 0
    assert capture.pending(wal(spark, rows), runs(spark, [])).count() == len(records)


def test_segments_to_read(spark):
    live = spark.createDataFrame([(1, 1, 10), (2, 11, 20), (3, 15, 15), (4, None, 3), (5, 20, 30)], "segment_id bigint, min_lsn bigint, max_lsn bigint")
    waiting = spark.createDataFrame([(15,), (16,), (20,)], "lsn bigint")
    assert tuples(capture.segments_to_read(live, waiting)) == sorted([(2, 3), (3, 1), (4, None), (5, 1)], key=repr)


@pytest.mark.parametrize("stop", ["plan", "write", "offsets", "commit"])
def test_capture_survives_failures(spark, tmp_path, stop):
    job = capture.ChangeCapture(spark, str(tmp_path / "state"), str(tmp_path / "sink"), width=16)
    first = [wal_row(i, b"%d" % (i % 5), minute=i) for i in range(1, 30)]
    job.run(wal(spark, first + first[:9]))
    more = first + [wal_row(i, b"%d" % (i % 5), minute=i + 100) for i in range(30, 50)]
    with pytest.raises(RuntimeError):
        job.run(wal(spark, more), fail_before=stop)
    late = more + [wal_row(60, b"1", minute=500), wal_row(3, b"3", minute=600)]
    replayed = job.run(wal(spark, late))
    assert replayed == 2
    job.run(wal(spark, late))
    out = spark.read.parquet(str(tmp_path / "sink"))
    assert sorted(r[0] for r in out.select("lsn").collect()) == [*range(1, 50), 60]
    assert out.where("batch = 2").count() == (21 if stop == "plan" else 20)  # a plan that was written doesn't move


def test_capture_delivers_the_good_copy_of_a_damaged_record(spark, tmp_path):
    job = capture.ChangeCapture(spark, str(tmp_path / "state"), str(tmp_path / "sink"), width=16)
    first = [wal_row(1, b"a", value=b"torn", minute=0, bad=True), wal_row(1, b"a", value=b"good", minute=1), wal_row(2, b"b", value=b"torn", minute=2, bad=True)]
    first += [wal_row(3, b"c", op=7, minute=3), wal_row(4, b"d", value=b"torn", minute=99, bad=True)]
    job.run(wal(spark, first))
    job.run(wal(spark, first + [wal_row(2, b"b", value=b"good", minute=50), wal_row(4, b"d", value=b"good", minute=60)]))
    out = spark.read.parquet(str(tmp_path / "sink"))
    assert tuples(out, "lsn", "value_bytes", "batch") == [(1, b"good", 1), (2, b"good", 2), (4, b"good", 2)]


def test_capture_skips_nothing(spark, tmp_path):
    """Null arrivals, null keys, rows that turn up below an offset, extra columns and an empty log."""
    job = capture.ChangeCapture(spark, str(tmp_path / "state"), str(tmp_path / "sink"), width=8)
    job.run(wal(spark, []))
    unplaced = lambda r: (*r[:11], None)
    rows = [wal_row(1, b"a", minute=5), unplaced(wal_row(2, b"b")), wal_row(3, None, minute=9)]
    named = lambda r: wal(spark, r).withColumn("part", F.lit("clash")).withColumn("lo", F.lit(1))
    job.run(named(rows))
    rows += [unplaced(wal_row(4, b"d")), wal_row(5, None, minute=3), wal_row(3, None, minute=30), unplaced(wal_row(2, b"b")), wal_row(None, b"x", minute=40)]
    job.run(named(rows))
    job.run(named(rows))
    out = spark.read.option("mergeSchema", "true").parquet(str(tmp_path / "sink"))
    assert tuples(out, "lsn", "part", "lo", "batch") == [(1, "clash", 1, 2), (2, "clash", 1, 2), (3, "clash", 1, 2), (4, "clash", 1, 3), (5, "clash", 1, 3)]


def test_capture_after_a_ledger_of_runs(spark, tmp_path):
    job = capture.ChangeCapture(spark, str(tmp_path / "state"), str(tmp_path / "sink"))
    job.seed(runs(spark, [(0, 10, 50, "committed"), (10, 5000, 20, "Committed "), (20, 30, 60, "failed")]))
    first = [wal_row(5, minute=1), wal_row(6, minute=51), wal_row(25, minute=19), wal_row(26, minute=21), wal_row(6000, minute=1)]
    with pytest.raises(RuntimeError):
        job.run(wal(spark, first), fail_before="commit", columns=[])
    assert job.run(wal(spark, first), columns=[]) == 1
    assert {r[0] for r in job.delivered(1).select("lsn").collect()} == {6, 26, 6000}
    assert tuples(job.delivered(job.run(wal(spark, first + [wal_row(7, minute=70), wal_row(6, minute=80)]), columns=[])), "lsn") == [(7,)]


def test_least_assignment_is_least():
    rng = np.random.default_rng(4)
    for n, m in [(1, 1), (2, 3), (4, 4), (5, 3), (6, 6)]:
        cost = rng.integers(0, 5, (n, m)).astype(float)
        got = diff.least_assignment(cost)
        small, big = min(n, m), max(n, m)
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert len(got) == small and len({i for i, _ in got}) == small and len({j for _, j in got}) == small
        assert sum(cost[i, j] for i, j in got) == best


def test_diff_of_copies(spark):
    schema = "k bigint, a string, b int, finding string"
    left = spark.createDataFrame([(1, "x", 1, ""), (1, "x", 1, ""), (1, "y", 2, ""), (2, None, 1, ""), (3, "only", 1, ""), (4, "s", 1, ""), (4, "s", 1, ""), (None, "n", 1, "")], schema)
    right = spark.createDataFrame([(1, "x", 1, ""), (1, "y", 3, ""), (1, "x", 9, ""), (2, "v", 1, ""), (4, "s", 1, ""), (5, "new", 1, ""), (None, "n", 2, "")], schema)
    got = tuples(diff.diff_copies(left, right, ["k"], ["a", "b"]), "k", "finding", "left_value", "right_value", "copies")
    assert got == sorted([
        ("1", "b", "1", "9", 1), ("1", "b", "2", "3", 1), ("2", "a", None, "v", 1), ("3", "missing_on_right", None, None, 1),
        ("4", "surplus_on_left", None, None, 1), ("5", "missing_on_left", None, None, 1), (None, "b", "1", "2", 1),
    ], key=repr)
    assert diff.diff_copies(left, left, ["k"], ["a", "b"]).count() == 0
    assert diff.diff_copies(left.limit(0), left.limit(0), ["k"], ["a", "b"]).count() == 0


def test_diff_of_a_hot_key_reports_every_copy(spark, monkeypatch):
    monkeypatch.setattr(diff, "BLOCK_ROWS", 16)
    left = spark.createDataFrame([(1, str(i), i % 3) for i in range(60)], "k bigint, a string, b int")
    right = spark.createDataFrame([(1, str(i), (i + 1) % 3) for i in range(50)], "k bigint, a string, b int")
    out = diff.diff_copies(left, right, ["k"], ["a", "b"], exact_limit=4)
    assert out.where("finding = 'surplus_on_left'").agg(F.sum("copies")).first()[0] == 10
    assert diff.diff_copies(left, right, ["k"], ["a", "b"]).where("finding in ('a', 'b')").count() == 50  # the least


def test_diff_of_a_hot_key_with_thousands_a_side_is_least(spark):
    """5,000 copies a side, against the sum of row minima, a bound no pairing beats."""
    rng = np.random.default_rng(3)
    base = np.arange(5_000)[:, None] * 10 + np.arange(4)  # far apart: the least pairing is the planted one
    other = base.copy()
    other[np.arange(5_000), rng.integers(0, 4, 5_000)] = -1
    schema = "k bigint, a bigint, b bigint, c bigint, d bigint"
    rows = lambda data: spark.createDataFrame([(1, *map(int, r)) for r in data], schema)
    out = diff.diff_copies(rows(base), rows(other[rng.permutation(5_000)]), ["k"], ["a", "b", "c", "d"])
    assert out.agg(F.sum("copies"), F.count_if(F.col("finding").isin("a", "b", "c", "d"))).first()[:] == (5_000, 5_000)


def test_diff_of_many_copies_counts_them(spark):
    many = lambda a, b, n: spark.range(n).select(F.lit(1).cast("bigint").alias("k"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
    left = many(1, 1, 30_000).unionByName(many(2, 2, 5)).unionByName(many(7, 9, 1))
    right = many(1, 2, 29_000).unionByName(many(3, 2, 100))
    for limit in (8_192, 2):
        got = diff.diff_copies(left, right, ["k"], ["a", "b"], exact_limit=limit)
        found = {r[0]: r[1] for r in got.groupBy("finding").agg(F.sum("copies")).collect()}
        assert found["surplus_on_left"] == 906
        if limit > 2:
            assert found["a"] + found["b"] == 29_000 + 5 + 95 * 2


@pytest.mark.parametrize("together", [16_384, 64])
def test_diff_of_few_rows_against_many_is_least(spark, monkeypatch, together):
    monkeypatch.setattr(diff, "GROUP_ROWS", together)
    rng = np.random.default_rng(8)
    few = np.array([[9, 9, 9, 9], [0, 1, 2, 3], [0, 1, 2, 3], [4, 4, 4, 0]])
    many = rng.integers(0, 6, (600, 4))
    many[599] = [0, 9, 9, 9]  # near to the first, far from it in the order of rows
    schema = "k bigint, a bigint, b bigint, c bigint, d bigint"
    rows = lambda data: spark.createDataFrame([(k, *map(int, r)) for k in (1, 2) for r in data], schema)
    lone, fields = np.array([len(many) - len(few)] * 2), ["a", "b", "c", "d"]
    least = 2 * sum((few[i] != many[j]).sum() for i, j in diff.least_assignment((few[:, None] != many[None]).sum(2).astype(float)))
    for left, right, surplus in ((few, many, "surplus_on_right"), (many, few, "surplus_on_left")):
        found = {r["finding"]: r["n"] for r in diff.diff_copies(rows(left), rows(right), ["k"], fields, exact_limit=128).groupBy("finding").agg(F.sum("copies").alias("n")).collect()}
        assert sum(found.get(f, 0) for f in fields) == least
        assert found[surplus] - found.get("surplus_on_left" if surplus == "surplus_on_right" else "surplus_on_right", 0) == lone.sum()


def manifest(spark, rows):
    schema = "entry_no bigint, entry_type string, segment_id bigint, segment_hash string, min_key binary, max_key binary, min_lsn bigint, max_lsn bigint, record_count bigint, compressed_bytes bigint, uncompressed_bytes bigint, compression string, cohort_bucket bigint, death_time bigint, merkle_root string, text_index_stripped boolean, vector_index_stripped boolean, created_at timestamp_ntz"
    return spark.createDataFrame([(n, kind, seg, "ab", b"a", b"z", 1, 9, 1, size, 1, "zstd", 1, 1, "cd", False, False, DAY) for n, kind, seg, size in rows], schema)


def test_compare_segments(spark):
    entries = manifest(spark, [(1, "Add", 1, 10), (2, "Add", 2, 10), (3, "Remove", 2, None), (4, "Add", 3, 10), (4, "Add", 3, 10), (5, "Add", 5, None)])
    peer = manifest(spark, [(0, "", 1, 10), (0, "", 1, 10), (0, "", 2, 10), (0, "", 5, 7)]).drop("entry_no", "entry_type").withColumn("segment_hash", F.lit("0xAB"))
    assert tuples(diff.segment_findings(entries, peer)) == sorted([(2, "missing_on_primary"), (3, "missing_on_peer"), (5, "compressed_bytes")], key=repr)


def test_hilbert_curve_is_a_walk(spark):
    n = 1 << 4
    cells = spark.range(n * n).select((F.col("id") % n).cast("int").alias("x"), F.floor(F.col("id") / n).cast("int").alias("y"))
    rows = sorted(cells.select(consolidate.hilbert_code(F.col("x"), F.col("y"), 4).alias("c"), "x", "y").collect())
    assert [r[0] for r in rows] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))


def test_consolidate_keeps_every_record_once(spark):
    entries = manifest(spark, [(i, "Add", i, 100 if i < 6 else 1 << 20) for i in range(1, 9)] + [(20, "Add", 30, 5), (21, "Add", 31, None)])
    rows = [wal_row(i, b"%03d" % (i % 50), seg=i % 8 + 1) for i in range(1, 400)]
    rows += [wal_row(i, b"%03d" % (i % 50), seg=1) for i in range(1, 100)] + [wal_row(900, None, seg=2), wal_row(None, b"x", seg=3)]
    done = consolidate.consolidate(entries, wal(spark, rows), target_bytes=2_000)
    kept = {(r[1], r[6]) for r in rows if r[10] < 6}
    got = spark.read.parquet(done.path)
    assert done.records == got.count() == len(kept)
    assert {(r[0], bytes(r[1]) if r[1] is not None else None) for r in got.select("lsn", "key_bytes").collect()} == kept
    files = done.files.collect()
    assert len(files) > 3 and sum(f["record_count"] for f in files) == len(kept)
    held = {i: [(r[1], r[6]) for r in rows if r[10] == i] for i in (1, 2, 3, 4, 5, 30)}
    assert tuples(done.sources) == sorted([(i, len(r), len(set(r)), len(set(r))) for i, r in held.items()], key=repr)
    empty = [wal_row(1, b"e", value=v, seg=1) for v in (None, b"", b"")]
    assert consolidate.consolidate(entries, wal(spark, empty)).records == 2
    hot = consolidate.consolidate(entries, wal(spark, [wal_row(7, b"same", value=b"%d" % i, seg=1) for i in range(300)]), target_bytes=2_000)
    assert hot.records == 300 and hot.files.count() > 5
    assert consolidate.consolidate(entries, wal(spark, rows).limit(0)).records == 0
