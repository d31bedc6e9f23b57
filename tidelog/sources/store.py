"""A store on a folder: a change log as Parquet batches, segments, and a state that says which of them count.

The state is a small file per version (``state/<number>.json``, with a checksum):
next LSN, next segment id, write token, batches of the log, segments with their
metadata, imported hashes, cursors of replicas.  A change writes its data first
and then the next version, which must not exist yet; so a crash leaves at most
files that no version names, counters never go back, and of two writers one
fails.  The state has one row a segment and a batch, which is what it grows with.

Writes are batches with new LSNs; a transaction is one batch.  Flushing sorts the
unflushed rows into a segment, compaction rewrites segments.  Opening with
``exclusive`` takes a new write token: an older writer's next change fails.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zlib
from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.bytesx import DELETE, PUT, lit_bytes
from tidelog.operators import cohorts, kv
from tidelog.sources.files import Files

SCHEMA = "ns binary, key binary, value binary, op tinyint, lsn bigint, ts_ns bigint, ttl_s bigint, txid bigint, seg_id bigint"
CONTENT = ("ns", "key", "value", "op", "lsn", "ts_ns", "ttl_s", "txid")
METAS = (
    "segment_id bigint, segment_hash string, merkle_root string, min_key binary, max_key binary, min_lsn bigint, max_lsn bigint, record_count bigint, "
    "compressed_bytes bigint, cohort_bucket bigint, death_time bigint, text_index_stripped boolean, vector_index_stripped boolean"
)
#: Namespaces of index records. Fixed values.
TEXT_PREFIX, VECTOR_PREFIX = b"__text__", b"__vec__"


class ReadOnly(Exception):
    """The store was opened for reading."""


class Fenced(Exception):
    """Another writer has taken over or changed the store meanwhile."""


def rows_digest(rows: DataFrame) -> str:
    """A content hash of rows in any order, in lower-case hex: count and two 64-bit digests, hashed."""
    nulls = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(CONTENT)), F.lit(0))
    one, two = F.xxhash64(nulls, *CONTENT), F.xxhash64(F.lit(2), nulls, *CONTENT)
    found = rows.agg(F.count("*"), F.coalesce(F.bit_xor(one), F.lit(0)), F.coalesce(F.bit_xor(two), F.lit(0))).first()
    return hashlib.sha256(repr(tuple(found)).encode()).hexdigest()


class Metrics:
    """Calls and nanoseconds by operation."""

    def __init__(self):
        self.calls: dict[str, int] = defaultdict(int)
        self.nanos: dict[str, int] = defaultdict(int)

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter_ns()
        try:
            yield
        finally:
            self.calls[name] += 1
            self.nanos[name] += time.perf_counter_ns() - began

    def average_ns(self, name: str) -> float:
        return self.nanos[name] / self.calls[name] if self.calls[name] else 0.0


class Transaction:
    """Buffered writes: one atomic batch at commit, nothing at rollback."""

    def __init__(self, store: Store):
        self.store, self.rows, self.state = store, [], "active"

    def _add(self, ns: bytes, key: bytes, value: bytes | None, op: int, ttl_s: int) -> None:
        if self.state != "active":
            raise ValueError(f"the transaction is {self.state}")
        self.rows.append((ns, key, value, op, ttl_s))

    def put(self, ns: bytes, key: bytes, value: bytes, ttl_s: int = 0) -> None:
        self._add(ns, key, value, PUT, ttl_s)

    def delete(self, ns: bytes, key: bytes) -> None:
        self._add(ns, key, None, DELETE, 0)

    @property
    def is_active(self) -> bool:
        return self.state == "active"

    def commit(self) -> int:
        """The last LSN of the batch."""
        if self.state != "active":
            raise ValueError(f"the transaction is {self.state}")
        last = self.store.write(self.rows, transaction=True) if self.rows else self.store.current_lsn()
        self.state = "committed"
        return last

    def rollback(self) -> None:
        self.rows, self.state = [], "rolled back"


class Snapshot:
    """A pinned list of segments: compaction and pruning leave them until ``release``."""

    def __init__(self, store: Store, segment_ids: list[int]):
        self.store, self.segment_ids, self.rows = store, segment_ids, store.segments(segment_ids)
        self.number = store.register(segment_ids)

    def live(self) -> DataFrame:
        return kv.live(self.rows)

    def get(self, ns: bytes, key: bytes) -> bytes | None:
        return kv.value_of(kv.get(self.rows, ns, key))

    def range(self, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return kv.range_scan(self.rows, ns, start, end)

    def prefix(self, ns: bytes, prefix: bytes) -> DataFrame:
        return kv.prefix_scan(self.rows, ns, prefix)

    def release(self) -> None:
        self.store.release(self.number)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Store:
    def __init__(self, spark: SparkSession, path: str, readonly: bool = False, window_s: int = 3600, on_flush=None, exclusive: bool = False):
        self.spark, self.path, self.readonly, self.window_s, self.on_flush = spark, path, readonly, window_s, on_flush
        self.files, self.metrics = Files(spark, path), Metrics()
        self._pins: dict[int, list[int]] = {}
        self._token = self.state()["token"]
        if exclusive:
            self.promote(self._token)

    # -- state
    def state(self) -> dict:
        """The newest version that is whole."""
        for name in reversed([n for n in self.files.names("state") if n.endswith(".json")]):
            data = self.files.read(f"state/{name}") or b""
            check, _, body = data.partition(b"\n")
            if check == b"%d" % zlib.crc32(body) and body:
                return json.loads(body) | {"version": int(name[:-5])}
        return self._adopted()

    def _adopted(self) -> dict:
        """The first state: of an empty folder, or of one whose batches and segments were written without any."""
        state = {"version": 0, "next_lsn": 1, "next_segment": 1, "token": 0, "log": [], "segments": {}, "imported": [], "cursors": {}, "archives": []}
        state["log"] = self.files.complete("log")
        found = self.files.complete("segments")
        paths = [self.files.at(f"{kind}/{n}") for kind, names in (("log", state["log"]), ("segments", found)) for n in names]
        for name in found:
            number = int(name.split("-")[0])
            state["segments"][str(number)] = self._described(name)
            state["next_segment"] = max(state["next_segment"], number + 1)
        if paths:
            state["next_lsn"] = (self._read(paths).agg(F.max("lsn")).first()[0] or 0) + 1
        return state

    def _commit(self, state: dict) -> None:
        if state["token"] != self._token:
            raise Fenced(f"the write token is {state['token']}, not {self._token}")
        version = state["version"] + 1
        body = json.dumps({k: v for k, v in state.items() if k != "version"}).encode()
        if not self.files.create(f"state/{version:012d}.json", b"%d\n" % zlib.crc32(body) + body):
            raise Fenced(f"version {version} of the state was written by another writer")
        for name in self.files.names("state"):
            if name.endswith(".json") and int(name[:-5]) < version - 8:
                self.files.delete(f"state/{name}")

    def _changing(self) -> dict:
        if self.readonly:
            raise ReadOnly(self.path)
        return self.state()

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    # -- relations
    def fresh(self) -> DataFrame:
        """Unflushed rows."""
        return self._read([self.files.at(f"log/{n}") for n in self.state()["log"]])

    def segments(self, ids: list[int] | None = None) -> DataFrame:
        held = self.state()["segments"]
        return self._read([self.files.at(f"segments/{held[str(i)]['folder']}") for i in (sorted(map(int, held)) if ids is None else ids)])

    def log(self) -> DataFrame:
        return self.fresh().unionByName(self.segments())

    def segment_ids(self) -> list[int]:
        return sorted(map(int, self.state()["segments"]))

    def segment_metas(self) -> DataFrame:
        """Metadata of the segments, one row each."""
        rows = [self._meta_row(int(i), m) for i, m in self.state()["segments"].items()]
        return self.spark.createDataFrame(rows, METAS)

    @staticmethod
    def _meta_row(number: int, m: dict) -> tuple:
        key = lambda k: None if m[k] is None else bytes.fromhex(m[k])
        return (number, m["hash"], m["root"], key("min_key"), key("max_key"), m["min_lsn"], m["max_lsn"], m["records"], m["bytes"], m["cohort"], m["death"], m.get("text_stripped", False), m.get("vector_stripped", False))

    def export_manifest(self) -> list[tuple[str, int]]:
        """(hash, id) of every segment, in the order of ids."""
        return [(m["hash"], int(i)) for i, m in sorted(self.state()["segments"].items(), key=lambda x: int(x[0]))]

    def root(self) -> str:
        """Hash of the sorted segment hashes, zeros without any."""
        hashes = sorted(h for h, _ in self.export_manifest())
        return hashlib.sha256("".join(hashes).encode()).hexdigest() if hashes else "0" * 64

    def create(self) -> bool:
        """Write the first state; False if there is one."""
        state = self._changing()
        if state["version"]:
            return False
        self._commit(state)
        return True

    def current_lsn(self) -> int:
        return self.state()["next_lsn"] - 1

    def confirmed_lsn(self) -> int:
        """The highest LSN of the segments, 0 without any."""
        return max((m["max_lsn"] or 0 for m in self.state()["segments"].values()), default=0)

    def watermark(self) -> dict:
        return {"confirmed_lsn": self.confirmed_lsn(), "token": self.write_token()}

    def wal_batches(self) -> int:
        return len(self.state()["log"])

    def pending_wal_bytes(self) -> int:
        return sum(self.files.size(f"log/{n}") for n in self.state()["log"])

    def vector_count(self, ns: bytes) -> int:
        return kv.scan(self.log(), VECTOR_PREFIX + ns).count()

    # -- writes
    def write(self, rows: list[tuple], transaction: bool = False, ts_ns: int | None = None) -> int:
        """Append (ns, key, value, op, ttl_s) rows as one batch; the last LSN."""
        with self.metrics.timed("write"):
            state = self._changing()
            base, now = state["next_lsn"] - 1, time.time_ns() if ts_ns is None else ts_ns
            batch = [(ns, key, value, op, base + i, now, ttl, base + 1 if transaction else 0, None) for i, (ns, key, value, op, ttl) in enumerate(rows, 1)]
            return self._append(state, self.spark.createDataFrame(batch, SCHEMA).coalesce(1), base + len(rows))

    def _append(self, state: dict, rows: DataFrame, last: int | None = None) -> int:
        name = f"{state['next_lsn']:020d}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").parquet(self.files.at(f"log/{name}"))
        if last is None:
            last = max(state["next_lsn"] - 1, self._read([self.files.at(f"log/{name}")]).agg(F.max("lsn")).first()[0] or 0)
        self._commit(state | {"next_lsn": last + 1, "log": [*state["log"], name]})
        return last

    def append(self, rows: DataFrame) -> int:
        """Append a DataFrame of changes (``ns, key, value, op, ts_ns, ttl_s``) in the order of time."""
        from tidelog.operators.segments import resequence

        state = self._changing()
        order = [F.col(c) for c in ("ts_ns", "ns", "key", "op")]
        numbered = resequence(rows, state["next_lsn"] - 1, order).withColumns({"txid": F.lit(0), "seg_id": F.lit(None)})
        return self._append(state, numbered.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")]))

    def recover(self, path: str) -> int:
        """Take the good records of framed log files, with their LSNs; the current LSN.  Repeats change nothing."""
        from tidelog.sources.framed import read_log

        state = self._changing()
        held = self.log().select("ns", "key", "lsn")
        rows = read_log(self.spark, path).dropDuplicates(["ns", "key", "lsn"]).join(held, ["ns", "key", "lsn"], "left_anti")
        return self._append(state, rows.select(*CONTENT, F.lit(None).cast("bigint").alias("seg_id")))

    def put(self, ns: bytes, key: bytes, value: bytes, ttl_s: int = 0) -> int:
        return self.write([(ns, key, value, PUT, ttl_s)])

    def put_with_timestamp(self, ns: bytes, key: bytes, value: bytes, ts_ns: int) -> int:
        return self.write([(ns, key, value, PUT, 0)], ts_ns=ts_ns)

    def delete(self, ns: bytes, key: bytes) -> int:
        return self.write([(ns, key, None, DELETE, 0)])

    def delete_with_timestamp(self, ns: bytes, key: bytes, ts_ns: int) -> int:
        return self.write([(ns, key, None, DELETE, 0)], ts_ns=ts_ns)

    def begin(self) -> Transaction:
        self._changing()
        return Transaction(self)

    # -- segments
    def _write_segment(self, rows: DataFrame, seg_id: int) -> dict:
        """A sorted run and its metadata: point reads use the key's bloom filter and page bounds."""
        folder = f"{seg_id:020d}-{uuid.uuid4().hex[:8]}"
        (
            rows.withColumn("seg_id", F.lit(seg_id).cast("bigint")).repartitionByRange("ns", "key").sortWithinPartitions("ns", "key")
            .write.option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true").parquet(self.files.at(f"segments/{folder}"))
        )
        return self._described(folder)

    def _described(self, folder: str) -> dict:
        from tidelog.operators.segments import segment_metadata, segment_roots

        rows = self._read([self.files.at(f"segments/{folder}")])
        found = segment_metadata(rows, self.window_s, "permanent").first()
        root = segment_roots(rows).first()
        m = {k: None for k in ("min_key", "max_key", "min_lsn", "max_lsn", "cohort", "death")} | {"records": 0}
        if found:
            m = {"min_key": found["min_key"], "max_key": found["max_key"], "min_lsn": found["min_lsn"], "max_lsn": found["max_lsn"], "cohort": found["cohort_bucket"], "death": found["death_time"], "records": found["record_count"]}
        return m | {"folder": folder, "hash": rows_digest(rows), "root": root["merkle_root"] if root else "0" * 64, "bytes": self.files.size(f"segments/{folder}")}

    def begin_flush(self) -> dict:
        """What a flush takes: the batches there are now.  Later ones stay."""
        self._changing()
        return {"log": self.state()["log"]}

    def execute_flush(self, work: dict) -> dict:
        """Write the segment; nothing names it yet, so a crash here loses only the file."""
        rows = self._read([self.files.at(f"log/{n}") for n in work["log"]])
        if not work["log"] or rows.isEmpty():
            return work | {"meta": None}
        return work | {"id": self.state()["next_segment"], "meta": self._write_segment(kv.newest(rows), self.state()["next_segment"])}

    def finalize_flush(self, work: dict) -> int | None:
        """The segment takes the place of its batches, in one version of the state."""
        if work["meta"] is None:
            return None
        state = self._changing()
        if state["next_segment"] != work["id"]:
            raise Fenced("another segment was written during the flush")
        self._commit(state | {"next_segment": work["id"] + 1, "segments": state["segments"] | {str(work["id"]): work["meta"]}, "log": [n for n in state["log"] if n not in set(work["log"])]})
        for n in work["log"]:
            self.files.delete(f"log/{n}")
        if self.on_flush:
            self.on_flush(work["id"])
        return work["id"]

    def flush(self) -> int | None:
        """Unflushed rows become a sorted segment; its id, or None if there was nothing."""
        with self.metrics.timed("flush"):
            return self.finalize_flush(self.execute_flush(self.begin_flush()))

    def replace_segments(self, gone: list[int], rows: DataFrame | None, **marks) -> int | None:
        """Segments give way to one of ``rows`` (None: to nothing); the new id."""
        state = self._changing()
        kept = {i: m for i, m in state["segments"].items() if int(i) not in set(gone)}
        seg_id = state["next_segment"] if rows is not None else None
        if rows is not None:
            kept[str(seg_id)] = self._write_segment(rows, seg_id) | marks
        self._commit(state | {"segments": kept, "next_segment": state["next_segment"] + (rows is not None)})
        for i in gone:
            if str(i) in state["segments"]:
                self.files.delete(f"segments/{state['segments'][str(i)]['folder']}")
        return seg_id

    def prune(self, seg_id: int) -> bool:
        """Drop a segment; not one that a snapshot holds."""
        if seg_id not in self.segment_ids() or self.is_pinned(seg_id):
            return False
        self.replace_segments([seg_id], None)
        return True

    # -- snapshots
    def register(self, segment_ids: list[int]) -> int:
        number = max(self._pins, default=0) + 1
        self._pins[number] = list(segment_ids)
        return number

    def release(self, number: int) -> None:
        self._pins.pop(number, None)

    def pinned_ids(self) -> list[int]:
        return sorted({i for ids in self._pins.values() for i in ids})

    def is_pinned(self, seg_id: int) -> bool:
        return seg_id in self.pinned_ids()

    def take_snapshot(self) -> Snapshot:
        return Snapshot(self, self.segment_ids())

    # -- compaction
    def _archived_keys(self) -> DataFrame | None:
        """Keys and LSNs in the archives this store has moved segments to."""
        paths = []
        for archive in self.state()["archives"]:
            files = Files(self.spark, archive)
            paths += [files.at(f"segments/{n}") for n in files.complete("segments")]
        return self._read(paths).select("ns", "key", "lsn") if paths else None

    def _survivors(self, rows: DataFrame, others: DataFrame, now_ns: int, ttl0: str) -> DataFrame:
        """The newest version of each key that is alive; a dead one stays as a delete while an older version is left elsewhere."""
        best = kv.newest(rows)
        death = cohorts.death_time(F.col("ts_ns"), F.col("ttl_s"), self.window_s, ttl0)
        best = best.withColumn("_dead", (F.col("op") == DELETE) | (death <= now_ns))
        older = others.groupBy("ns", "key").agg(F.min("lsn").alias("_lsn"))
        dead = best.where("_dead").join(older, ["ns", "key"]).where("_lsn < lsn").drop("_lsn")
        marks = dead.withColumns({"op": F.lit(DELETE).cast("tinyint"), "value": F.lit(None).cast("binary"), "ttl_s": F.lit(0).cast("bigint")})
        return best.where("not _dead").unionByName(marks).drop("_dead")

    def _elsewhere(self, ids: list[int]) -> DataFrame:
        """Keys and LSNs outside the given segments: other segments, the log, archives."""
        rest = self.fresh().unionByName(self.segments([i for i in self.segment_ids() if i not in set(ids)])).select("ns", "key", "lsn")
        cold = self._archived_keys()
        return rest if cold is None else rest.unionByName(cold)

    def compact(self, now_ns: int, ttl0: str = "permanent", pinned: list[int] | None = None) -> int | None:
        """Rewrite all segments that aren't pinned, without dead and superseded rows; the new segment's id."""
        with self.metrics.timed("compact"):
            self._changing()
            kept = {*(pinned or []), *self.pinned_ids()}
            free = [i for i in self.segment_ids() if i not in kept]
            return self.replace_segments(free, self._survivors(self.segments(free), self._elsewhere(free), now_ns, ttl0)) if free else None

    def compact_cycle(self, now_ns: int, budget_bytes: int = 1 << 40, ttl0: str = "permanent") -> list[int | None]:
        """Cohort by cohort within a budget: the new segment of each, None where nothing was left of it."""
        self._changing()
        metas = self.segment_metas()
        pinned = self.spark.createDataFrame([(i,) for i in self.pinned_ids()], "segment_id bigint")
        plan = cohorts.compact_plan(metas, now_ns, budget_bytes, pinned).where("chosen").orderBy("step").select("cohort_bucket").collect()  # one row a cohort
        members = defaultdict(list)
        for i, m in self.state()["segments"].items():
            if not self.is_pinned(int(i)):
                members[m["cohort"]].append(int(i))
        done = []
        for (bucket,) in plan:
            ids = members[bucket]
            rows = self._survivors(self.segments(ids), self._elsewhere(ids), now_ns, ttl0)
            done.append(self.replace_segments(ids, None if rows.isEmpty() else rows))
        return done

    def strip(self, seg_id: int, prefix: bytes) -> int:
        """Rewrite a segment without the namespaces that start with ``prefix``; unchanged if none or all do."""
        self._changing()
        rows = self.segments([seg_id])
        kept = kv.strip_namespaces(rows, prefix)
        n, total = kept.count(), rows.count()
        if n in (0, total):
            return seg_id
        marks = {k: v for k, v in (("text_stripped", prefix == TEXT_PREFIX), ("vector_stripped", prefix == VECTOR_PREFIX)) if v}
        old = self.state()["segments"][str(seg_id)]
        return self.replace_segments([seg_id], kept, **({k: old[k] for k in ("text_stripped", "vector_stripped") if k in old} | marks))

    # -- replication
    def import_segment(self, rows: DataFrame, segment_hash: str) -> tuple:
        """Take a peer's segment: ('skipped',), ('hash mismatch', found), ('rejected', why) or ('applied', written, skipped).

        A record of it wins over the local version only if it was written later, and
        gets a new LSN; time and time to live stay.  A hash is taken once.
        """
        state = self._changing()
        wanted = segment_hash.lower().removeprefix("0x")
        if wanted in state["imported"] or any(m["hash"] == wanted for m in state["segments"].values()):
            return ("skipped",)
        lacking = [c for c in CONTENT if c not in rows.columns]
        if lacking:
            return ("rejected", f"no column {', '.join(lacking)}")
        try:
            found = rows_digest(rows)
        except Exception as error:  # unreadable files
            return ("rejected", str(error).splitlines()[0])
        if found != wanted:
            return ("hash mismatch", found)
        mine = kv.newest(self.log()).select("ns", "key", F.col("ts_ns").alias("_mine"))
        theirs = kv.newest(rows.select(*CONTENT), order=[F.desc("ts_ns"), F.desc("lsn")])
        both = theirs.join(mine, ["ns", "key"], "left")
        won = both.where("_mine is null or ts_ns > _mine").drop("_mine")
        written, total = won.count(), theirs.count()
        if written:
            self.append(won.select("ns", "key", "value", "op", "ts_ns", "ttl_s"))
        state = self._changing()
        self._commit(state | {"imported": [*state["imported"], wanted]})
        return ("applied", written, total - written)

    def pull(self, peer: Store, name: str, most: int | None = None) -> list[tuple]:
        """One round of anti-entropy from a peer; (hash, result) of each segment that was looked at.

        Token and watermark come first, then the roots, then the manifests; the
        cursor is stored after every segment, so an interrupted round goes on.
        """
        cursor = self.state()["cursors"].get(name, {"token": 0, "lsn": 0, "root": ""})
        mark = peer.watermark()
        if mark["token"] < cursor["token"]:
            raise Fenced(f"peer {name} has token {mark['token']}, older than {cursor['token']}")
        root = peer.root()
        if root == cursor["root"] or root == self.root():
            return []
        state = self.state()
        known = {*state["imported"], *(m["hash"] for m in state["segments"].values())}
        missing = [(h, i) for h, i in peer.export_manifest() if h not in known]
        done = []
        for segment_hash, number in missing[:most]:
            result = self.import_segment(peer.segments([number]), segment_hash)
            done.append((segment_hash, result))
            top = peer.state()["segments"][str(number)]["max_lsn"] or 0
            cursor = cursor | {"token": mark["token"], "lsn": max(cursor["lsn"], top)}
            state = self._changing()
            self._commit(state | {"cursors": state["cursors"] | {name: cursor}})
        if len(done) == len(missing) and all(r[0] in ("applied", "skipped") for _, r in done):
            state = self._changing()
            self._commit(state | {"cursors": state["cursors"] | {name: cursor | {"token": mark["token"], "root": root}}})
        return done

    def cursor(self, name: str) -> dict | None:
        return self.state()["cursors"].get(name)

    # -- write token
    def write_token(self) -> int:
        return self.state()["token"]

    def set_write_token(self, token: int) -> None:
        """A fencing token never goes back."""
        state = self._changing()
        if token < state["token"]:
            raise ValueError(f"token {token} is older than {state['token']}")
        self._token = state["token"]
        self._move_token(state, token)

    def _move_token(self, state: dict, token: int) -> None:
        self._token = state["token"]
        if token != state["token"]:
            self._token = token
            self._commit(state | {"token": token})

    def promote(self, remote_token: int) -> int:
        """Become the writer, with a token above the local and the remote one."""
        state = self.state()
        self._move_token(state, max(remote_token, state["token"]) + 1)
        self.readonly = False
        return self._token

    # -- reads
    def get(self, ns: bytes, key: bytes) -> bytes | None:
        with self.metrics.timed("get"):
            return kv.value_of(kv.get(self.log(), ns, key))

    def range(self, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return kv.range_scan(self.log(), ns, start, end)

    def prefix(self, ns: bytes, prefix: bytes) -> DataFrame:
        return kv.prefix_scan(self.log(), ns, prefix)

    def snapshot(self, segment_ids: list[int] | None = None) -> DataFrame:
        """The live rows of the given segments (all by default)."""
        return kv.live(self.segments(segment_ids))

    def delete_namespace(self, ns: bytes) -> int:
        """Deletes for every live key of a namespace, as one batch."""
        rows = kv.scan(self.log(), ns).select("ns", "key", F.lit(None).cast("binary").alias("value"), F.lit(DELETE).cast("tinyint").alias("op"), F.lit(time.time_ns()).alias("ts_ns"), F.lit(0).cast("bigint").alias("ttl_s"))
        return self.append(rows.where(F.col("ns") == lit_bytes(ns)))


