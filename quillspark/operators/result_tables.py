"""Results that outlive their session: tables in a shared folder, and a log of what became of them, from which any session tells what is held."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import facets
from .store import Results, Stored, refiltered

LOG = (
    "key string, version long, at double, event string, owner string, metadata array<string>, verbatim array<string>, roles long, "
    "model string, answers string, threshold double, filters map<string, array<string>>, place string"
)


class ResultTables(Results):
    """`Results` as tables under `folder`, which all sessions share: <key>/table, <key>/log and <key>/snapshot-*.

    Every change is a row of the key's log with the next version; the catalogue is an aggregation over the logs. A role change is
    a version, not a copy of the table, and snapshots made under earlier roles no longer hold. Deleting logs the end first and removes the folder
    then, so a session that dies in between leaves nothing that counts. Uses are logged once in `touch` seconds. The clock counts
    seconds that mean the same in every session.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = 8, seconds: float = 10_800, clock: Callable[[], float] = time.time, touch: float = 60):
        super().__init__(most, seconds, clock)
        self.spark, self.folder, self.touch = spark, folder.rstrip("/"), touch
        self.schema = T.StructType.fromDDL(LOG)

    # --- the log -------------------------------------------------------------------------------------

    def _path(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _log(self, key: str = "*") -> DataFrame:
        fs, p = self._path(f"{key}/log")
        places = [f.getPath().toString() for f in fs.globStatus(p) or ()]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def _append(self, key: str, event: str, version: int, **row) -> None:
        known = {"key": key, "event": event, "version": version, "at": float(self.clock())} | row
        values = tuple(known.get(f.name) for f in self.schema)
        self.spark.createDataFrame([values], self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{key}/log")

    def catalogue(self, key: str = "*") -> DataFrame:
        """key, owner, saved_at, used_at, version, metadata, verbatim, roles of every result that is held."""
        roles = F.when(F.col("event").isin("saved", "roles"), F.struct("version", "at", "owner", "metadata", "verbatim", "roles"))
        per = self._log(key).groupBy("key").agg(
            F.max(roles).alias("now"), F.min(F.when(F.col("event") == "saved", F.col("at"))).alias("saved_at"), F.max("at").alias("used_at"),
            F.max("version").alias("version"), F.bool_or(F.col("event") == "deleted").alias("gone"),
        )
        held = per.where("NOT gone AND saved_at IS NOT NULL")
        return held.select("key", "now.owner", "saved_at", "used_at", "version", "now.metadata", "now.verbatim", "now.roles")

    def _row(self, key: str):
        row = self.catalogue(key).first() if "/" not in key and "*" not in key else None
        if row is None or self.clock() - row["saved_at"] > self.seconds:
            raise KeyError(f"no result {key!r}")
        return row

    # --- the interface of Results --------------------------------------------------------------------

    def save(self, table: DataFrame, metadata: Sequence[str], verbatim: Sequence[str], owner: str | None = None) -> str:
        self.expire()
        key = uuid.uuid4().hex
        table.write.parquet(f"{self.folder}/{key}/table")
        held = self.catalogue().orderBy(F.desc("used_at"), F.desc("saved_at"), "key").collect()  # a row a result, `most` at most and one for each session that saves meanwhile
        theirs = [r["key"] for r in held if owner is not None and r["owner"] == owner]
        others = [r["key"] for r in held if r["key"] not in theirs]
        for old in theirs + others[max(self.most - 1, 0) :]:
            self.delete(old)
        self._append(key, "saved", 1, owner=owner, metadata=list(metadata), verbatim=list(verbatim), roles=1)
        return key

    def get(self, key: str) -> Stored:
        row = self._row(key)
        if self.clock() - row["used_at"] > self.touch:
            self._append(key, "used", row["version"] + 1)
        return Stored(self.spark.read.parquet(f"{self.folder}/{key}/table"), list(row["metadata"]), list(row["verbatim"]), row["owner"], row["saved_at"])

    def delete(self, key: str) -> bool:
        found = self.catalogue(key).first() if "/" not in key and "*" not in key else None
        if found is None:
            return False
        self._append(key, "deleted", found["version"] + 1)
        fs, p = self._path(key)
        fs.delete(p, True)
        return True

    def expire(self) -> int:
        """Delete what is older than its time, by a scan of the catalogue, whichever session saved it."""
        old = self.catalogue().where(F.lit(float(self.clock())) - F.col("saved_at") > self.seconds).select("key").collect()
        return sum(self.delete(r["key"]) for r in old)

    def set_role(self, key: str, column: str, role: str) -> Stored:
        """As in `Results`; the table stays, its roles get a new version."""
        row, s = self._row(key), super().set_role(key, column, role)
        version = self._row(key)["version"] + 1
        self._append(key, "roles", version, owner=row["owner"], metadata=s.metadata, verbatim=s.verbatim, roles=version)
        return s

    def snapshot(self, key: str, model: str, column: str, threshold: float | None, documents: DataFrame, filters: Mapping[str, Sequence[str]] | None) -> None:
        """The documents of a finished analysis as a table, with the filter and the roles it was made under."""
        row = self._row(key)
        place = f"snapshot-{uuid.uuid4().hex}"
        documents.write.parquet(f"{self.folder}/{key}/{place}")
        wanted = {k: sorted(set(v)) for k, v in (filters or {}).items()}
        self._append(key, "snapshot", row["version"] + 1, model=model, answers=column, threshold=None if threshold is None else round(threshold, 9), filters=wanted, roles=row["roles"], place=place)

    def narrowed(self, key: str, model: str, column: str, threshold: float | None, filters: Mapping[str, Sequence[str]] | None) -> DataFrame | None:
        row = self._row(key)
        at = F.lit(None if threshold is None else round(threshold, 9)).cast("double")
        same = (F.col("event") == "snapshot") & (F.col("model") == model) & (F.col("answers") == column) & F.col("threshold").eqNullSafe(at) & (F.col("roles") == row["roles"])
        last = self._log(key).where(same).orderBy(F.desc("version"), F.desc("at")).first()
        wanted = {k: set(v) for k, v in (filters or {}).items()}
        if last is None or any(k not in wanted or not wanted[k] <= set(v) for k, v in last["filters"].items()):
            return None
        documents = self.spark.read.parquet(f"{self.folder}/{key}/{last['place']}")
        return refiltered(documents, facets.apply_filters(self.get(key).table, filters, row["metadata"]))
