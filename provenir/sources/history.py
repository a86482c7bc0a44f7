"""A stored scan history: Parquet below one folder a UTC day, changed by rewriting only the days concerned.

A delete first finds the days that hold an entry to go, by a semi-join that
reads the keys and the partition column alone. What stays of these days is
written aside, so that nothing is lost if an executor is, and then takes their
place; all other days keep their files. Retention drops whole old days and
rewrites the one day in which the cut falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

DAY = "day"


class HistoryStore:
    """The history at ``path``; entries have a ``timestamp`` and a unique ``session_id``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None):
        self._spark, self._path, self._schema = spark, path, schema

    def add(self, entries: DataFrame) -> None:
        """Append entries; those without a time have no place in the history and are left out."""
        entries.filter("timestamp IS NOT NULL").withColumn(DAY, F.to_date("timestamp")).repartition(DAY).write.partitionBy(DAY).mode("append").parquet(self._path)

    def read(self) -> DataFrame:
        """All entries, with the partition column ``day``."""
        reader = self._spark.read
        return (reader.schema(self._schema) if self._schema else reader).parquet(self._path)

    def _replace(self, kept: DataFrame, days: list) -> None:
        """Let ``kept`` be what the given days hold from now on."""
        stored = materialize(kept, "history-kept")
        stored.repartition(DAY).write.partitionBy(DAY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._path)
        left = {r[DAY] for r in stored.select(DAY).distinct().collect()}
        self._drop([d for d in days if d not in left])

    def _drop(self, days: list) -> None:
        """Remove the folders of days of which nothing stays."""
        jvm, conf = self._spark._jvm, self._spark._jsc.hadoopConfiguration()
        for d in days:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self._path}/{DAY}={d}")
            folder.getFileSystem(conf).delete(folder, True)

    def _counts(self, rows: DataFrame) -> dict:
        """Entries by day: one number for each day, however many entries there are."""
        return {r[DAY]: r.n for r in rows.groupBy(DAY).agg(F.count(F.lit(1)).alias("n")).collect()}

    def delete(self, keys: DataFrame, key: str = "session_id") -> int:
        """Delete the entries with the given keys; the number of them."""
        keys = materialize(keys.select(key).filter(F.col(key).isNotNull()).distinct(), "history-keys")
        all_rows = self.read()
        hit = self._counts(all_rows.select(key, DAY).join(keys, key, "left_semi"))
        if hit:
            of_days = all_rows.filter(F.col(DAY).isin(list(hit)))  # prunes the partitions
            self._replace(of_days.join(keys, key, "left_anti").select(*all_rows.columns), list(hit))
        return sum(hit.values())

    def retain(self, n: int = 100) -> int:
        """Keep the newest ``n`` entries by (timestamp, session_id); the number of those deleted."""
        counts, left, gone = self._counts(self.read()), n, 0
        old, cut = [], None
        for d in sorted(counts, reverse=True):
            if left <= 0:
                old.append(d)
                gone += counts[d]
            elif counts[d] > left:
                cut, keep, gone, left = d, left, gone + counts[d] - left, 0
            else:
                left -= counts[d]
        if cut is not None:
            mine = self.read().filter(F.col(DAY) == F.lit(cut))
            self._replace(mine.orderBy(F.col("timestamp").desc(), F.col("session_id").desc()).limit(keep), [cut])
        self._drop(old)
        return gone

    def clear(self) -> int:
        """Delete every entry; the number of them."""
        counts = self._counts(self.read())
        self._drop(list(counts))
        return sum(counts.values())
