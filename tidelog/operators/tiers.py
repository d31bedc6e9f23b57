"""Hot and cold tiers of a store: archiving segments, fetching those a read needs.

Archived segments lie under their content hash and are never overwritten; their
index is one file of metadata each.  The store's counters don't depend on where
segments are, so neither LSNs nor segment ids are used twice, and its
compactions ask the archive before they let a delete go.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.bytesx import in_range, lit_bytes, prefix_upper_bound
from tidelog.operators import kv
from tidelog.sources.files import Files, retried
from tidelog.sources.store import METAS, SCHEMA, TEXT_PREFIX, VECTOR_PREFIX, Store, rows_digest


def encoded(ns: bytes, key: bytes = b"") -> bytes:
    return len(ns).to_bytes(2, "big") + ns + key


class WarmSegments:
    """Copies of archived segments in a folder near the executors, the least recently used going first beyond ``limit_bytes``."""

    def __init__(self, spark: SparkSession, path: str, limit_bytes: int):
        self.files, self.limit, self.sizes = Files(spark, path), limit_bytes, {}
        self.hits = self.misses = 0

    def paths(self, names: list[str], load) -> list[str]:
        """Where the copies of segments are; those that aren't there are made by ``load(name, path)``.

        What this read needs stays until a later one; its rows should be used by then.
        """
        for name in names:
            if name in self.sizes:
                self.hits += 1
                self.sizes[name] = self.sizes.pop(name)  # now the most recent
            else:
                self.misses += 1
                load(name, self.files.at(name))
                self.sizes[name] = self.files.size(name)
        for oldest in [n for n in self.sizes if n not in set(names)]:
            if sum(self.sizes.values()) <= self.limit:
                break
            del self.sizes[oldest]
            self.files.delete(oldest)
        return [self.files.at(n) for n in names]


class TieredStore:
    """A store whose segments may lie in an archive; reads see both, one version choice over all.

    A read opens only archived segments whose bounds can hold its keys.
    ``strip_text`` and ``strip_vectors`` leave index records out of what is archived;
    ``warm_path`` keeps copies of archived segments that were read.
    """

    def __init__(self, store: Store, archive: str, strip_text: bool = False, strip_vectors: bool = False, warm_path: str | None = None, warm_bytes: int = 32 << 20):
        self.store, self.archive, self.spark = store, archive, store.spark
        self.files = Files(self.spark, archive)
        self.stripped = [p for p, on in ((TEXT_PREFIX, strip_text), (VECTOR_PREFIX, strip_vectors)) if on]
        self.warm = WarmSegments(self.spark, warm_path, warm_bytes) if warm_path else None

    # -- the archive's index
    def archived(self) -> list[dict]:
        """Metadata of the archived segments, one of each hash, by segment id."""
        found = {}
        for name in self.files.names("index"):
            if name.endswith(".json"):
                entry = json.loads(self.files.read(f"index/{name}"))
                found[entry["hash"]] = entry
        return sorted(found.values(), key=lambda e: (e["id"], e["hash"]))

    def archived_segments(self) -> DataFrame:
        rows = [Store._meta_row(e["id"], e) for e in self.archived()]
        return self.spark.createDataFrame(rows, METAS)

    def register_archived(self, entry: dict) -> bool:
        """Add a segment to the index; False if its hash is there."""
        return self.files.create(f"index/{entry['hash']}.json", json.dumps(entry).encode())

    def archive_segments(self, seg_ids: list[int]) -> int:
        """Copy segments to the archive, register them, drop them from the hot tier; how many.

        Pinned segments stay hot.  Each step may be repeated after a crash: data
        first, then the index, then the store's state.
        """
        state = self.store._changing()
        if self.archive not in state["archives"]:
            self.store._commit(state | {"archives": [*state["archives"], self.archive]})
        done = 0
        for seg_id in dict.fromkeys(seg_ids):
            if str(seg_id) not in self.store.state()["segments"] or self.store.is_pinned(seg_id):
                continue
            for prefix in self.stripped:
                seg_id = self.store.strip(seg_id, prefix)
            meta = self.store.state()["segments"][str(seg_id)]
            name = f"segments/{meta['hash']}"
            if not self.files.exists(f"{name}/_SUCCESS"):
                retried(lambda: self.store.segments([seg_id]).write.mode("overwrite").option("compression", "zstd").parquet(self.files.at(name)))
            self.register_archived({k: v for k, v in meta.items() if k != "folder"} | {"id": seg_id})
            self.store.replace_segments([seg_id], None)
            done += 1
        return done

    # -- reading the archive
    def overlapping(self, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> list[str]:
        """Hashes of archived segments that can hold keys of the range."""
        low = encoded(ns, start or b"")
        high = encoded(ns, end) if end is not None else None
        out = []
        for e in self.archived():
            if e["min_key"] is None or bytes.fromhex(e["max_key"]) < low:
                continue
            least = bytes.fromhex(e["min_key"])
            if (least < high) if high is not None else (least[: 2 + len(ns)] <= encoded(ns)):
                out.append(e["hash"])
        return out

    def needs_fetch(self, ns: bytes, key: bytes) -> bool:
        """Whether a point read can't be sure without the archive."""
        return self.store.get(ns, key) is None and bool(self.overlapping(ns, key, key + b"\x00"))

    def cold(self, hashes: list[str]) -> DataFrame:
        at = lambda h: self.files.at(f"segments/{h}")
        load = lambda h, to: retried(lambda: self.spark.read.schema(SCHEMA).parquet(at(h)).write.mode("overwrite").parquet(to))
        return self.store._read(self.warm.paths(hashes, load) if self.warm else [at(h) for h in hashes])

    def download(self, segment_hash: str, to: str) -> str:
        """Copy an archived segment to a folder, verified, without importing it."""
        rows = self.store._read([self.files.at(f"segments/{segment_hash}")])
        if rows_digest(rows) != segment_hash:
            raise ValueError(f"archived segment {segment_hash} is damaged")
        rows.write.mode("overwrite").parquet(to)
        return to

    def fetch_segment(self, segment_hash: str) -> int | None:
        """Bring an archived segment back to the hot tier, with its LSNs; its new id, None if it is there or unknown."""
        known = {e["hash"]: e for e in self.archived()}
        state = self.store._changing()
        if segment_hash not in known or any(m["hash"] == segment_hash for m in state["segments"].values()):
            return None
        rows = self.store._read([self.files.at(f"segments/{segment_hash}")])
        if rows_digest(rows) != segment_hash:
            raise ValueError(f"archived segment {segment_hash} is damaged")
        marks = {k: known[segment_hash][k] for k in ("text_stripped", "vector_stripped") if k in known[segment_hash]}
        return self.store.replace_segments([], rows, **marks)

    def fetch_overlapping(self, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> int:
        return sum(self.fetch_segment(h) is not None for h in self.overlapping(ns, start, end))

    def fetch_all(self) -> int:
        return sum(self.fetch_segment(e["hash"]) is not None for e in self.archived())

    # -- reads over both tiers
    def _both(self, ns: bytes, start: bytes | None, end: bytes | None) -> DataFrame:
        return self.store.log().unionByName(self.cold(self.overlapping(ns, start, end)))

    def range(self, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        rows = self._both(ns, start, end)
        return kv.live(rows.where((F.col("ns") == lit_bytes(ns)) & in_range(F.col("key"), start, end))).orderBy("key")

    def prefix(self, ns: bytes, prefix: bytes) -> DataFrame:
        return self.range(ns, prefix, prefix_upper_bound(prefix))

    def get(self, ns: bytes, key: bytes) -> bytes | None:
        return kv.value_of(self.range(ns, key, key + b"\x00"))

    # -- the hot tier alone, and what is passed on to it
    def local_only_get(self, ns: bytes, key: bytes) -> bytes | None:
        return self.store.get(ns, key)

    def local_only_range(self, ns: bytes, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return self.store.range(ns, start, end)

    def local_only_prefix(self, ns: bytes, prefix: bytes) -> DataFrame:
        return self.store.prefix(ns, prefix)

    def __getattr__(self, name: str):
        """``put``, ``delete``, ``flush``, ``compact``, ``prune`` and the rest of the store."""
        if name == "store":
            raise AttributeError(name)
        return getattr(self.store, name)
