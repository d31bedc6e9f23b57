import random

import pytest

from tests.conftest import tuples
from tidelog.functions.bytesx import prefix_upper_bound
from tidelog.operators import kv

SCHEMA = "ns binary, key binary, value binary, op tinyint, lsn bigint, ts_ns bigint, ttl_s bigint, txid bigint, seg_id bigint"


def log(spark, rows):
    return spark.createDataFrame([(ns, k, v, op, lsn, lsn, 0, 0, seg) for ns, k, v, op, lsn, seg in rows], SCHEMA)


@pytest.fixture(scope="module")
def random_log(spark):
    rnd = random.Random(5)
    rows, model = [], {}
    for lsn in range(1, 400):
        ns, k = rnd.choice([b"a", b"ab"]), bytes([rnd.randrange(250, 256)]) * rnd.randint(1, 3)
        op = 2 if rnd.random() < 0.25 else 1
        v = None if op == 2 else str(lsn).encode()
        rows.append((ns, k, v, op, lsn, lsn // 100 if lsn < 300 else None))
        model.pop((ns, k), None) if op == 2 else model.__setitem__((ns, k), v)
    rnd.shuffle(rows)
    return log(spark, rows + rows[:50]), model


def test_reads_follow_a_dict(random_log):
    df, model = random_log
    assert tuples(kv.live(df), "ns", "key", "value") == sorted(((n, k, v) for (n, k), v in model.items()), key=repr)
    mine = sorted((k, v) for (n, k), v in model.items() if n == b"a")
    got = [(bytes(r[0]), bytes(r[1])) for r in kv.range_scan(df, b"a").select("key", "value").collect()]
    assert got == mine
    lo, hi = b"\xfb", b"\xfe"
    assert tuples(kv.scan(df, b"a", lo, hi), "key") == sorted([(k,) for k, _ in mine if lo <= k < hi], key=repr)
    for p in (b"\xfb", b"\xff", b"\xff\xff", b""):
        assert tuples(kv.prefix_scan(df, b"a", p), "key") == sorted([(k,) for k, _ in mine if k.startswith(p)], key=repr)


def test_pages_joined_are_the_range(random_log):
    df, model = random_log
    keys = sorted(k for n, k in model if n == b"a")
    for back in (False, True):
        seen, cursor = [], None
        while True:
            rows = (kv.page_back if back else kv.page)(df, b"a", 3, cursor=cursor).collect()
            seen += [bytes(r["key"]) for r in rows]
            cursor = bytes(rows[0]["next_key"]) if rows and rows[0]["next_key"] is not None else None
            if cursor is None:
                break
        assert seen == (keys[::-1] if back else keys)
    assert kv.page(df, b"a", 0).count() == 0


def test_budgets(random_log, monkeypatch):
    df, model = random_log
    rows = kv.scan(df, b"a")
    some = kv.budget_items(rows, 4).collect()
    assert len(some) == 4 and all(r["truncated"] for r in some)
    assert not any(r["truncated"] for r in kv.budget_items(rows, 10_000).collect())
    total, expect = 0, []
    for k, v in sorted((k, v) for (n, k), v in model.items() if n == b"a"):
        if total >= 40:
            break
        total += 2 + 1 + len(k) + len(v)
        expect.append((k, total))
    assert sorted((bytes(r["key"]), r["bytes_so_far"]) for r in kv.budget_bytes(rows, 40).collect()) == expect
    monkeypatch.setattr(kv, "WINDOW_ROWS", 1)
    assert sorted((bytes(r["key"]), r["bytes_so_far"]) for r in kv.budget_bytes(rows, 40).collect()) == expect
    assert kv.budget_bytes(rows, 0).count() == 0


def test_stats_snapshot_and_misses(spark):
    df = log(spark, [(b"n", b"k", b"v1", 1, 1, 0), (b"n", b"k", b"v2", 1, 5, 1), (b"n", b"gone", b"x", 1, 2, 0), (b"n", b"gone", None, 2, 6, None)])
    assert tuples(kv.get_with_stats(df, b"n", b"k")) == [(2, b"v2", 2 + 1 + 1 + 2, 1)]
    assert tuples(kv.get_with_stats(df, b"n", b"none")) == [(0, None, 0, 0)]
    assert tuples(kv.get_into(df, b"n", b"gone")) == [(False, None)]
    assert tuples(kv.live(kv.snapshot(df, [0])), "key", "value") == [(b"gone", b"x"), (b"k", b"v1")]
    assert tuples(kv.range_stats(df, b"n")) == [(3, 2 + 1 + 1 + 2 + 2 + 1 + 4 + 1 + 2 + 1 + 4, 1)]
    assert kv.confirmed_lsn(spark.createDataFrame([], "max_lsn bigint")).first()[0] == 0
    assert kv.live(df.limit(0)).count() == 0
    assert kv.live(df.withColumn("extra", df.key)).count() == 1


def test_prefix_upper_bound():
    assert prefix_upper_bound(b"ab") == b"ac"
    assert prefix_upper_bound(b"a\xff\xff") == b"b"
    assert prefix_upper_bound(b"\xff") is None and prefix_upper_bound(b"") is None


def test_filters_reach_the_scan(spark, tmp_path, random_log):
    random_log[0].write.parquet(str(tmp_path / "log"))
    plan = kv.get(spark.read.parquet(str(tmp_path / "log")), b"a", b"\xff")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(key" in plan and "EqualTo(ns" in plan and "WindowGroupLimit" in plan
