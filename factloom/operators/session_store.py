"""Sessions kept in versions: a manifest over immutable segments, committed by one rename.

A segment holds the facts of the shards that one update added, each relation in a folder of its own. A manifest says which
segment a session reads each of its shards from. An update writes a new segment with the added shards alone, a
new manifest, and last a small version file, which is moved to its place: until then readers see
the version before, and of two writers the second fails. Nothing that a version names is changed afterwards.

Removed shards stay in their segments until the session is rebuilt, so their rows are filtered by the
manifest, for segments that have any. An update is a delta while few shards change and the chain of deltas is short; else, or if the delta
fails, the whole session is written as one segment.
"""

from __future__ import annotations

import json
import uuid
import warnings
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Session
from . import store, symbol_index
from .indexing import plan_session


#: Shards that an update adds are sent to all tasks up to this number, so that no relation is shuffled to be cut by them.
MAX_SENT = 1 << 20


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class Version:
    number: int
    action: str
    fingerprint: str
    chain: int
    manifest: str
    #: Shards of a segment: all that it holds, and those that this version reads.
    held: dict[str, int] = field(default_factory=dict)
    live: dict[str, int] = field(default_factory=dict)


class SessionStore:
    """The versions of one project's session under ``path``. ``indexed`` keeps a search index with each segment."""

    def __init__(self, spark: SparkSession, path: str, indexed: bool = True):
        self.spark, self.path, self.indexed = spark, path.rstrip("/"), indexed
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.conf)

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._path(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def head(self) -> Version | None:
        """The version committed last."""
        done = [n for n in self._names("versions") if n.endswith(".json")]
        if not done:
            return None
        stream = self._fs().open(self._path("versions", done[-1]))
        try:
            return Version(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, v: Version) -> Version:
        fs, draft, final = self._fs(), self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{v.number:09d}.json")
        out = fs.create(draft)
        out.write(json.dumps(asdict(v)).encode())
        out.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri() if self._path().toUri().getScheme() else fs.getUri(), self.conf)
            none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(draft, final, none)  # fails if the version is there
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {v.number} was committed by another writer") from e
            raise
        return v

    def manifest(self, v: Version | None = None) -> DataFrame:
        """(shard_id, segment) of a version, the last if none is given; no rows if there is none."""
        v = v or self.head()
        if v is None:
            return self.spark.createDataFrame([], "shard_id string, segment string")
        return self.spark.read.schema("shard_id string, segment string").parquet(f"{self.path}/manifests/{v.manifest}")

    def _write_segment(self, tables: dict[str, DataFrame], added: DataFrame, segment: str) -> None:
        mine = {n: df.join(added, "shard_id", "left_semi") for n, df in tables.items() if "shard_id" in df.columns}
        for name, df in mine.items():
            df.write.parquet(f"{self.path}/facts/{name}/segment={segment}")
        if self.indexed:
            read = {n: self.spark.read.schema(df.schema).parquet(f"{self.path}/facts/{n}/segment={segment}") for n, df in mine.items()}
            symbol_index.write(Session(read).symbols, lambda name: f"{self.path}/index/{name}/segment={segment}")

    def _change(self, tables: dict[str, DataFrame], wanted: DataFrame, before: Version | None, delta: bool) -> Version:
        segment = uuid.uuid4().hex[:16]
        old = self.manifest(before) if delta else self.spark.createDataFrame([], "shard_id string, segment string")
        added = wanted.join(old, "shard_id", "left_anti")
        n = added.count()
        if n or not delta:
            self._write_segment(tables, F.broadcast(added) if n <= MAX_SENT else added, segment)
        kept = old.join(wanted, "shard_id", "left_semi").select("shard_id", "segment")
        kept.union(added.select("shard_id", F.lit(segment))).write.parquet(f"{self.path}/manifests/{segment}")
        next_ = Version((before.number if before else 0) + 1, "delta" if delta else "rebuild", store.fingerprint(wanted).first()["fingerprint"], before.chain + 1 if delta else 0, segment)
        next_.live = {r["segment"]: r["n"] for r in self.manifest(next_).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).orderBy("segment").collect()}
        next_.held = {s: (before.held if delta else {}).get(s, n) for s, n in next_.live.items()}
        return self._commit(next_)

    def update(self, tables: dict[str, DataFrame], wanted: DataFrame) -> Version:
        """Brings the session to the wanted shards (shard_id), as far as relation shards of ``tables`` has them; the version that holds then.

        The action is reuse (nothing changed, nothing is written), delta or rebuild. A delta that fails is followed by a rebuild; if that fails, too, the version before stays."""
        wanted = wanted.select("shard_id").distinct().join(tables["shards"].select("shard_id"), "shard_id", "left_semi").cache()
        try:
            before = self.head()
            plan = plan_session(self.manifest(before).select("shard_id"), wanted, before.chain if before else 0).first()
            if before and plan["action"] == "reuse":
                return before
            if plan["action"] == "delta":
                try:
                    return self._change(tables, wanted, before, True)
                except Conflict:
                    raise
                except Exception as e:
                    warnings.warn(f"the delta failed: {str(e).splitlines()[0]}; all shards are written", stacklevel=2)
            return self._change(tables, wanted, before, False)
        finally:
            wanted.unpersist()

    def _read(self, folder: str, v: Version, by_shard: bool = True, schema: str | None = None) -> DataFrame:
        """The rows of a version's segments, without those of removed shards."""
        base = f"{self.path}/{folder}"
        reader = self.spark.read.option("basePath", base)
        found = (reader.schema(f"{schema}, segment string") if schema else reader).parquet(*[f"{base}/segment={s}" for s in v.live])
        found = found.withColumn("segment", F.col("segment").cast("string"))
        cut = [s for s, n in v.live.items() if n < v.held[s]]
        if not cut or not by_shard:
            return found
        live = self.manifest(v).where(F.col("segment").isin(cut))
        whole = found.where(~F.col("segment").isin(cut))
        return whole.unionByName(found.where(F.col("segment").isin(cut)).join(live, ["shard_id", "segment"], "left_semi").select(found.columns))

    def session(self, v: Version | None = None) -> Session:
        """The relations of a version, the last if none is given."""
        v = v or self.head()
        if v is None or not v.live:
            raise ValueError("there is no session")
        made = {n: self._read(f"facts/{n}", v).drop("segment") for n in self._names("facts")}
        index = symbol_index.SymbolIndex(self._read("index/symbols", v, schema=symbol_index.ROWS), self._read("index/postings", v, by_shard=False, schema=symbol_index.POSTED)) if self.indexed else None
        return Session(made, index)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the segments and manifests that none of the last ``keep`` versions reads, and the versions before; their segments. Not to be called while an update runs."""
        done = [n for n in self._names("versions") if n.endswith(".json")]
        used: set[str] = set()
        for name in done[-keep:]:
            stream = self._fs().open(self._path("versions", name))
            v = Version(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
            used |= set(v.live) | {v.manifest}
        fs, gone = self._fs(), set()
        for name in done[:-keep]:
            fs.delete(self._path("versions", name), False)
        for name in self._names("manifests"):
            if name not in used:
                fs.delete(self._path("manifests", name), True)
        for kind in ("facts", "index"):
            for relation in self._names(kind):
                for part in self._names(f"{kind}/{relation}"):
                    segment = part.partition("=")[2]
                    if segment and segment not in used:
                        fs.delete(self._path(kind, relation, part), True)
                        gone.add(segment)
        return sorted(gone)
