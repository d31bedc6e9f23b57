import pytest

from tests.conftest import tuples
from tests.test_kv import log
from tidelog.operators import kv
from tidelog.operators.tiers import TieredStore
from tidelog.sources import dumps, framed
from tidelog.sources.files import BlobFolder, Files, retried
from tidelog.sources.store import Fenced, ReadOnly, Store, rows_digest
from tidelog.streaming import ingest


def test_life_of_a_store(spark, tmp_path):
    flushed = []
    store = Store(spark, str(tmp_path / "s"), on_flush=flushed.append)
    assert store.get(b"n", b"a") is None and store.current_lsn() == 0
    assert store.put(b"n", b"a", b"1") == 1
    tx = store.begin()
    tx.put(b"n", b"b", b"2")
    tx.delete(b"n", b"a")
    assert store.get(b"n", b"b") is None
    assert tx.commit() == 3 and not tx.is_active
    assert store.get(b"n", b"a") is None and store.get(b"n", b"b") == b"2"
    gone = store.begin()
    gone.put(b"n", b"x", b"x")
    gone.rollback()
    with pytest.raises(ValueError):
        gone.commit()
    assert store.flush() == 1 and flushed == [1] and store.flush() is None
    assert store.confirmed_lsn() == 3 and store.wal_batches() == 0
    store.put(b"n", b"a", b"again")
    assert store.snapshot().count() == 1
    store.flush()
    assert store.compact(0) == 3 and store.segment_ids() == [3]
    assert tuples(store.range(b"n"), "key", "value") == [(b"a", b"again"), (b"b", b"2")]
    store.put(b"__text__d", b"t", b"t")
    store.flush()
    assert store.strip(4, b"__text__") == 4
    reader = Store(spark, str(tmp_path / "s"), readonly=True)
    with pytest.raises(ReadOnly):
        reader.put(b"n", b"z", b"z")
    assert reader.promote(7) == 8


def test_expired_rows_go_with_compaction_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write([(b"n", b"k", b"v", 1, 1)], ts_ns=0)
    store.flush()
    assert store.get(b"n", b"k") == b"v"
    store.compact(2_000_000_000)
    assert store.get(b"n", b"k") is None


def test_framed_files_stand_damage(spark, tmp_path):
    df = log(spark, [(b"n", b"k%d" % i, b"v" if i % 2 else None, 1, i, None) for i in range(40)])
    path = str(tmp_path / "wal")
    done = framed.write_log(df.repartition(2), path, rotate_bytes=800).collect()
    assert sum(r["records"] for r in done) == 40 and len(done) > 2
    assert tuples(framed.read_log(spark, path), "key", "value", "lsn") == tuples(df, "key", "value", "lsn")
    file = next((tmp_path / "wal").glob("*.log"))
    data = bytearray(file.read_bytes())
    data[12] ^= 0xFF
    file.write_bytes(bytes(data[:-3]))
    left = framed.read_log(spark, path).count()
    lost = next(r["records"] for r in done if r["file"] == file.name)
    assert 40 - lost <= left == 40 - 2


def test_export_import(spark, tmp_path):
    df = log(spark, [(b"n", b"k", b"\xff", 1, 1, None), (b"n", b"t", "é".encode(), 1, 2, None), (b"n", b"d", None, 2, 3, None)])
    dumps.export_json(df, str(tmp_path / "j"))
    assert tuples(dumps.import_json(spark, str(tmp_path / "j")), "ns", "key", "value") == tuples(kv.live(df), "ns", "key", "value")
    dumps.export_parquet(df, str(tmp_path / "p"))
    assert tuples(spark.read.parquet(str(tmp_path / "p")), "key", "value") == [(b"k", None), (b"t", "é")]
    done = dumps.export_binary(df, str(tmp_path / "w")).collect()
    assert sum(r["records"] for r in done) == 2 and tuples(dumps.import_binary(spark, str(tmp_path / "w")), "ns", "key", "value") == tuples(kv.live(df), "ns", "key", "value")
    blobs = BlobFolder(spark, str(tmp_path / "b"))
    name = blobs.upload(b"data")
    assert blobs.download(name) == b"data" and blobs.list() == [name] and not blobs.upload_if_absent(b"data")
    blobs.upload_aux(name, b"beside", "idx")
    assert blobs.download(name, "idx") == b"beside" and blobs.list("idx") == [name]
    (tmp_path / "b" / f"{name}.seg").write_bytes(b"broken")
    (tmp_path / "b" / f".{name}.seg.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        blobs.download(name)
    blobs.delete(name)
    assert blobs.download(name) is None
    with pytest.raises(ValueError):
        blobs.download("../x")


def test_streaming_folds_to_the_newest(spark, tmp_path):
    rows = [(b"n", b"k%d" % (i % 5), b"%d" % i, 2 if i % 11 == 0 else 1, (i * 37) % 101, None) for i in range(100)]
    df = log(spark, rows)
    for i in range(3):
        df.where(f"lsn % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.limit(20).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.stream_log(spark, str(tmp_path / "in"), df.schema, 1)
    query = ingest.upsert_current(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 2).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = ingest.latest_generation(spark, str(tmp_path / "out"))
    assert tuples(got, "key", "value", "lsn") == tuples(kv.newest(df), "key", "value", "lsn")


def test_command_line(spark, tmp_path):
    from tidelog import cli

    said = []
    call = lambda *args: cli.run([str(tmp_path / "s"), *args], spark, said.append)
    assert call("put", "k", "v") == 0 and call("put", "0x6b32", "w", "--ttl", "5") == 0
    assert call("get", "k") == 0 and said[-1] == "v"
    assert call("get", "none") == 1
    call("flush")
    call("range", "--limit", "1")
    assert said[-1] == f"{b'k'.hex()}\t{b'v'.hex()}"
    call("export", str(tmp_path / "e"))
    assert cli.run([str(tmp_path / "other"), "import", str(tmp_path / "e")], spark, said.append) == 0 and said[-1] == 2
    call("delete", "k")
    assert call("get", "k") == 1
    assert call("create") == 0 and said[-1] is False
    call("export", str(tmp_path / "x"), "--format", "binary")
    assert said[-1] == 1 and cli.run([str(tmp_path / "third"), "import", str(tmp_path / "x"), "--format", "binary"], spark, said.append) == 0 and said[-1] == 1
    call("vector-put", "v1", "1,0")
    call("vector-put", "v2", "0,2.5")
    assert call("vector-get", "v2") == 0 and said[-1] == "0,2.5" and call("vector-get", "v3") == 1
    call("vector-search", "0,2", "--k", "1", "--metric", "euclidean")
    assert said[-1] == "0.500000\tv2"
    call("text-put", "t1", "segment compaction")
    call("text-put", "t2", "another text")
    call("text-search", "segmnt", "--typo")
    assert said[-1].endswith("\tt1")


def test_immutable_engine(spark, tmp_path):
    import json

    from tidelog.sources.immutable import ImmutableEngine, segment_bytes

    store = two_segments(spark, str(tmp_path / "s"))
    store.delete(b"n", b"a")
    store.flush()
    held = store.state()["segments"]
    by_path = ImmutableEngine.from_paths(spark, [store.files.at(f"segments/{m['folder']}") for m in held.values()])
    by_bytes = ImmutableEngine.from_bytes(spark, [segment_bytes(store.segments([i])) for i in store.segment_ids()])
    for engine in (by_path, by_bytes):
        assert engine.get(b"n", b"a") is None and engine.get(b"n", b"y") == b"3"
        assert tuples(engine.range(b"n", b"b", b"z"), "key") == [(b"b",), (b"y",)] and tuples(engine.prefix(b"n", b"z"), "key") == [(b"z",)]
        assert [bytes(r["key"]) for r in engine.page(b"n", 2).collect()] == [b"b", b"y"] and [bytes(r["key"]) for r in engine.page_back(b"n", 1).collect()] == [b"z"]
        assert [e["hash"] for e in json.loads(engine.manifest_json())["segments"]] == [h for h, _ in store.export_manifest()]
        assert engine.get_with_stats(b"n", b"b").first()["segments_scanned"] == 1
    assert ImmutableEngine(spark, []).get(b"n", b"a") is None
    with pytest.raises(Exception):
        ImmutableEngine.from_bytes(spark, [b"broken"])


def two_segments(spark, path):
    store = Store(spark, path)
    store.write([(b"n", b"a", b"1", 1, 0), (b"n", b"b", b"2", 1, 0)])
    store.flush()
    store.write([(b"n", b"y", b"3", 1, 0), (b"n", b"z", b"4", 1, 0)])
    store.flush()
    return store


def test_tiers_of_a_store(spark, tmp_path):
    store = two_segments(spark, str(tmp_path / "s"))
    tiered = TieredStore(store, str(tmp_path / "cold"), warm_path=str(tmp_path / "warm"), warm_bytes=1)
    assert tiered.archive_segments([1, 2, 7]) == 2 and store.get(b"n", b"a") is None and tiered.archive_segments([1]) == 0
    first = tiered.overlapping(b"n", b"a", b"c")
    assert len(first) == 1 and tiered.overlapping(b"m") == [] and tiered.overlapping(b"n", b"c", b"d") == []
    assert tiered.get(b"n", b"a") == b"1" and tiered.get(b"n", b"a") == b"1" and (tiered.warm.hits, tiered.warm.misses) == (1, 1)
    assert tiered.needs_fetch(b"n", b"a") and not tiered.needs_fetch(b"n", b"c")
    assert tuples(tiered.prefix(b"n", b"y"), "key") == [(b"y",)] and len(tiered.warm.sizes) == 1
    store.delete(b"n", b"a")
    assert tiered.get(b"n", b"a") is None
    assert tuples(tiered.range(b"n"), "key") == [(b"b",), (b"y",), (b"z",)]
    assert tiered.download(first[0], str(tmp_path / "copy")) and tiered.local_only_get(b"n", b"b") is None
    assert tiered.fetch_overlapping(b"n", b"x") == 1 and store.get(b"n", b"z") == b"4" and tiered.fetch_all() == 1 and tiered.fetch_all() == 0
    assert store.get(b"n", b"a") is None and store.get(b"n", b"b") == b"2"
    assert not tiered.register_archived(tiered.archived()[0]) and tiered.archived_segments().count() == 2


def test_archiving_loses_nothing(spark, tmp_path):
    """New writes after an archive outrank it, ids and files aren't used twice, deletes outlive compaction."""
    store = Store(spark, str(tmp_path / "s"))
    tiered = TieredStore(store, str(tmp_path / "cold"))
    store.write([(b"n", b"a", b"kept", 1, 0), (b"n", b"b", b"old", 1, 0), (b"n", b"c", b"old", 1, 0)])
    store.flush()
    tiered.archive_segments([1])
    assert tiered.put(b"n", b"b", b"new") == 4 and tiered.get(b"n", b"b") == b"new"
    assert store.flush() == 2 and tiered.archive_segments([2]) == 1
    assert tiered.get(b"n", b"a") == b"kept" and tiered.get(b"n", b"b") == b"new"
    store.delete(b"n", b"c")
    store.flush()
    store.compact(0)
    assert tiered.get(b"n", b"c") is None
    assert tuples(tiered.range(b"n"), "key", "value") == [(b"a", b"kept"), (b"b", b"new")]
    reopened = Store(spark, str(tmp_path / "s"))
    assert reopened.current_lsn() == 5 and reopened.put(b"n", b"d", b"x") == 6


def test_counters_survive_an_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write([(b"n", b"k", b"v", 1, 1)], ts_ns=0)
    store.flush()
    store.compact(10**12)
    assert store.log().count() == 0 and Store(spark, str(tmp_path / "s")).put(b"n", b"k", b"w") == 2
    assert store.flush() == 3


def test_expired_versions_do_not_bring_older_ones_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write([(b"n", b"k", b"old", 1, 0)], ts_ns=0)
    store.flush()
    store.write([(b"n", b"k", b"short", 1, 1)], ts_ns=0)
    store.flush()
    store.compact(10**12, pinned=[1])
    assert store.get(b"n", b"k") is None


def test_a_crash_between_data_and_state_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.put(b"n", b"a", b"1")
    work = store.execute_flush(store.begin_flush())
    store.put(b"n", b"b", b"2")
    assert store.segment_ids() == [] and Store(spark, str(tmp_path / "s")).get(b"n", b"a") == b"1"
    assert store.finalize_flush(work) == 1 and store.wal_batches() == 1 and store.pending_wal_bytes() > 0
    assert tuples(store.range(b"n"), "key") == [(b"a",), (b"b",)]
    newest = sorted((tmp_path / "s" / "state").glob("*.json"))[-1]
    newest.write_bytes(newest.read_bytes()[:-9])  # a torn version is none
    newest.with_name(f".{newest.name}.crc").unlink(missing_ok=True)
    assert Store(spark, str(tmp_path / "s")).segment_ids() == []


def test_two_writers_and_tokens(spark, tmp_path):
    old = Store(spark, str(tmp_path / "s"))
    old.put(b"n", b"a", b"1")
    new = Store(spark, str(tmp_path / "s"), exclusive=True)
    with pytest.raises(Fenced):
        old.put(b"n", b"a", b"2")
    assert new.put(b"n", b"a", b"3") == 2 and Store(spark, str(tmp_path / "s")).write_token() == 1
    with pytest.raises(ValueError):
        new.set_write_token(0)
    new.set_write_token(5)
    assert new.promote(9) == 10 and new.put(b"n", b"b", b"4") == 3


def test_snapshots_pin_segments(spark, tmp_path):
    store = two_segments(spark, str(tmp_path / "s"))
    with store.take_snapshot() as held:
        store.delete(b"n", b"a")
        store.flush()
        assert store.is_pinned(1) and not store.prune(1) and store.compact(0) == 4 and store.segment_ids() == [1, 2, 4]
        assert held.get(b"n", b"a") == b"1" and store.get(b"n", b"a") is None
        assert tuples(held.prefix(b"n", b"y"), "key") == [(b"y",)] and held.live().count() == 4
    assert store.pinned_ids() == [] and store.prune(1) and store.segment_ids() == [2, 4]


def test_cohorts_are_compacted_one_by_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), window_s=10)
    for ts, ttl, key in ((0, 5, b"a"), (0, 5, b"b"), (0, 100, b"c"), (0, 100, b"d")):
        store.write([(b"n", key, b"v", 1, ttl)], ts_ns=ts)
        store.flush()
    assert store.compact_cycle(50 * 10**9, budget_bytes=0) == []
    assert store.compact_cycle(50 * 10**9, budget_bytes=1) == [None, 5] and store.segment_ids() == [5] and tuples(store.range(b"n"), "key") == [(b"c",), (b"d",)]
    assert store.segment_metas().first()["record_count"] == 2 and store.metrics.calls["flush"] == 4 and store.metrics.average_ns("flush") > 0


def test_import_and_pull(spark, tmp_path):
    peer, mine = two_segments(spark, str(tmp_path / "p")), Store(spark, str(tmp_path / "m"))
    mine.put_with_timestamp(b"n", b"a", b"mine, later", 2**62)
    (h1, _), (h2, _) = peer.export_manifest()
    assert mine.import_segment(peer.segments([1]), h2)[0] == "hash mismatch"
    assert mine.import_segment(peer.segments([1]).drop("value"), h1)[0] == "rejected"
    assert mine.import_segment(peer.segments([1]), f"0x{h1.upper()}") == ("applied", 1, 1) and mine.import_segment(peer.segments([1]), h1) == ("skipped",)
    assert mine.get(b"n", b"a") == b"mine, later" and mine.get(b"n", b"b") == b"2"
    other = Store(spark, str(tmp_path / "o"))
    assert [r[0] for _, r in other.pull(peer, "p", most=1)] == ["applied"] and other.cursor("p")["lsn"] == 2
    again = Store(spark, str(tmp_path / "o"))
    assert again.cursor("p")["lsn"] == 2 and [h for h, _ in again.pull(peer, "p")] == [h2] and again.pull(peer, "p") == []
    assert tuples(again.range(b"n"), "key", "value") == tuples(peer.range(b"n"), "key", "value")
    peer.promote(3)
    peer.delete(b"n", b"z")
    peer.flush()
    assert [r for _, r in again.pull(peer, "p")] == [("applied", 1, 0)] and again.get(b"n", b"z") is None and again.cursor("p")["token"] == 4


def test_recover_takes_good_frames_once(spark, tmp_path):
    df = log(spark, [(b"n", b"k%d" % i, b"v", 1, i + 1, None) for i in range(9)])
    framed.write_log(df, str(tmp_path / "wal")).collect()
    store = Store(spark, str(tmp_path / "s"))
    assert store.recover(str(tmp_path / "wal")) == 9 and store.recover(str(tmp_path / "wal")) == 9
    assert store.log().count() == 9 and store.put(b"n", b"x", b"y") == 10


def test_retries_are_for_passing_errors(spark, tmp_path):
    calls = []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("503 Slow Down")
        return "done"

    assert retried(busy) == "done" and len(calls) == 3
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError("no such file")))
    files = Files(spark, str(tmp_path))
    assert files.create("a", b"1") and not files.create("a", b"2") and files.read("a") == b"1" and files.read("b") is None
    assert rows_digest(log(spark, [])) == rows_digest(log(spark, []))


def test_records_of_vectors_and_texts(spark, tmp_path):
    import numpy as np

    from tidelog.operators import vectors
    from tidelog.sources import records

    store = Store(spark, str(tmp_path / "s"))
    records.put_vector(store, b"n", b"k", np.array([1, 2], "<f2").tobytes(), 2, "F16")
    with pytest.raises(ValueError):
        records.put_vector(store, b"n", b"k", b"123", 2, "F16")
    store.put(records.vector_namespace(b"n"), b"bad", b"x")
    assert records.get_vector(store, b"n", b"k")[2].tolist() == [1, 2]
    found = records.vectors(store.log(), b"n")
    assert [tuple(r) for r in vectors.top_k(found, [1.0, 2.0], 3, "l2", "key", "embedding", "F16").collect()] == [(bytearray(b"k"), 0.0)]
    records.delete_vector(store, b"n", b"k")
    assert records.vectors(store.log(), b"n").count() == 0
    records.put_text(store, b"n", b"t", "olá", {"a": "x", "b": 3, "c": True})
    row = records.texts(store.log(), b"n").first()
    assert (row["text"], row["strings"], row["numbers"], row["flags"]) == ("olá", {"a": "x"}, {"b": 3}, {"c": True})
    with pytest.raises(ValueError):
        records.put_text(store, b"n", b"__index__", "x")


def test_stateful_stream_emits_newer_versions(tmp_path, spark):
    df = log(spark, [(b"n", b"k%d" % (i % 3), b"%d" % i, 1, (i * 7) % 31, None) for i in range(31)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = ingest.stateful_current(ingest.stream_log(spark, str(tmp_path / "in"), df.schema))
        query = stream.writeStream.format("memory").queryName("newest").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert tuples(spark.table("newest"), "key", "lsn") == tuples(kv.newest(df), "key", "lsn")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def test_sync_pulls_only_what_is_missing(spark):
    from pyspark.sql import functions as F

    ours = log(spark, [(b"n", b"a", b"mine", 1, 9, 1)])
    theirs = log(spark, [(b"n", b"a", b"theirs", 1, 5, 2), (b"n", b"b", b"new", 1, 6, 2), (b"n", b"c", b"known", 1, 7, 1)])
    mine = spark.createDataFrame([(1, "aa")], "segment_id bigint, segment_hash string")
    peer = spark.createDataFrame([(1, "AA"), (2, "bb")], "segment_id bigint, segment_hash string")
    merged, missing = ingest.sync_once(ours, theirs, mine, peer)
    assert tuples(missing, "segment_id") == [(2,)]
    assert tuples(merged, "key", "value") == [(b"a", b"mine"), (b"b", b"new")]
    assert ingest.sync_once(ours, theirs, mine, mine.withColumn("segment_hash", F.upper("segment_hash")))[0] is None
