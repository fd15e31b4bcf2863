"""A key-value cache that many writers append to.

A write is one new folder ``day=D/batch=...`` of Parquet, filled out of sight and
then renamed into place: readers see all of it or nothing, and writers never
touch each other's files. The last write of a key counts. Compaction puts all
days before a given one together and removes only the batches that it read, so
a batch that lands meanwhile stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.operators.accounting import CACHE_TTL_S, is_expired

ENTRY = T.StructType().add("key", "string").add("value", "string").add("expires_at", "double").add("written", "double").add("seq", "long")
STORED = T.StructType([*ENTRY.fields, T.StructField("day", T.IntegerType()), T.StructField("batch", T.StringType())])
DAY_S = 86_400


class CacheStore:
    """A cache below one path of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _land(self, entries: DataFrame, day: int) -> str:
        """Write a batch out of sight and rename it into its day."""
        batch = uuid.uuid4().hex
        hidden, place = f"_pending-{batch}", f"day={day}/batch={batch}"
        entries.select(*ENTRY.names).write.parquet(f"{self.path}/{hidden}")
        self._files.mkdirs(self._at(f"day={day}"))
        if not self._files.rename(self._at(hidden), self._at(place)):
            raise OSError(f"{self.path}/{place} could not be put in place")
        return place

    def append(self, entries: DataFrame, now: float, ttl: float | None = CACHE_TTL_S) -> None:
        """Add ``key, value, seq`` as of ``now``; of a key's rows the one with the largest ``seq`` counts.

        Entries expire after ``ttl`` seconds, or as their own column ``expires_at`` says where ``ttl`` is None.
        """
        due = F.col("expires_at") if ttl is None else F.lit(float(now + ttl))
        timed = entries.withColumns({"expires_at": due.cast("double"), "written": F.lit(float(now)), "seq": F.col("seq").cast("bigint")})
        self._land(_last(timed), int(now // DAY_S))

    def _batches(self) -> list[str]:
        """``day=D/batch=B`` of all batches: one listing, a name a write since the last compaction."""
        found = self._files.globStatus(self._at("day=*/batch=*")) or []
        return sorted("/".join(f.getPath().toString().rsplit("/", 2)[1:]) for f in found)

    def _read(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], ENTRY)
        reader = self.spark.read.schema(STORED).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/{b}" for b in batches]).select(*ENTRY.names)

    def entries(self) -> DataFrame:
        """``key, value, expires_at`` as last written, expired ones too."""
        return _last(self._read(self._batches())).select("key", "value", "expires_at")

    def get(self, wanted: DataFrame, now: float) -> DataFrame:
        """``wanted`` with the ``value`` of its ``key``, null where there is none alive.

        Wanted keys reach the scan first, so only their entries are combined.
        """
        asked = self._read(self._batches()).join(wanted.select("key").distinct(), "key", "left_semi")
        alive = _last(asked).filter(~is_expired(F.col("expires_at"), F.lit(now)))
        return wanted.join(alive.select("key", "value"), "key", "left")

    def compact(self, now: float, keep_days: int = 1) -> int:
        """Put the batches of all but the last ``keep_days`` days into one, without expired entries; returns how many were read.

        All older days go together: an expired entry that is dropped has no older one left to come back.
        """
        before = int(now // DAY_S) + 1 - keep_days
        old = [b for b in self._batches() if int(b.split("/")[0].removeprefix("day=")) < before]
        if len(old) < 1:
            return 0
        alive = _last(self._read(old)).filter(~is_expired(F.col("expires_at"), F.lit(now)))
        self._land(alive, before - 1)
        # A stop between the two leaves entries twice, which reads as once.
        for batch in old:
            self._files.delete(self._at(batch), True)
        return len(old)


def _last(entries: DataFrame) -> DataFrame:
    fields = [c for c in ENTRY.names if c != "key"]
    best = F.max_by(F.struct(*fields), F.struct("written", "seq", "value"))
    return entries.groupBy("key").agg(best.alias("_e")).select("key", "_e.*")
