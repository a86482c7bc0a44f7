"""Audit log, result documents and per-source result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.exprs import col
from ..functions.hashing import iso_ts

SERVICE, VERSION = "provenir", __version__

# Field set of each audit event kind; the name is built from the kind.
AUDIT_FIELDS = {
    "request": ("session_id", "user", "ip_address", "filename", "video_hash"),
    "result": (
        "session_id", "user", "filename", "video_hash", "verdict",
        "integrity_score", "confidence", "leading_core", "duration_ms",
    ),
    "auth": ("user", "ip_address", "success", "details"),
    "admin": ("user", "details"),
    "error": ("session_id", "user", "error_code", "message"),
}

ENVELOPE = "timestamp string, service string, version string, event string"

RESULT_SCHEMA = (
    "metadata struct<dataset:string,created_at:string>, "
    "samples array<struct<file:string,label:int,fusion_score:double,verdict:string>>, "
    "metrics map<string,double>"
)


def audit_events(df: DataFrame, kind: str, ts: str = "ts", action: str = "action") -> DataFrame:
    """Envelope and fields of one event kind.

    ``action`` names the column with the auth or admin action.
    """
    name = {
        "request": F.lit("analysis_request"),
        "result": F.lit("analysis_result"),
        "auth": F.concat(F.lit("auth."), F.col(action)) if kind == "auth" else None,
        "admin": F.concat(F.lit("admin."), F.col(action)) if kind == "admin" else None,
        "error": F.lit("error"),
    }[kind]
    return df.select(
        iso_ts(ts).alias("timestamp"),
        F.lit(SERVICE).alias("service"),
        F.lit(VERSION).alias("version"),
        name.alias("event"),
        *AUDIT_FIELDS[kind],
    )


def with_day(df: DataFrame) -> DataFrame:
    """UTC day of an audit entry, the partition of the log."""
    return df.withColumn("day", F.regexp_replace(F.substring("timestamp", 1, 10), "-", ""))


def write_audit(df: DataFrame, path: str) -> None:
    """Append audit entries as JSON lines below one folder per UTC day."""
    with_day(df).write.partitionBy("day").mode("append").json(path)


def read_audit(spark: SparkSession, path: str, fields: str = "") -> DataFrame:
    schema = ENVELOPE + (f", {fields}" if fields else "") + ", day string"
    return spark.read.schema(schema).json(path)


def write_results(samples: DataFrame, metrics: dict[str, Column], path: str, dataset: str) -> None:
    """Write evaluation samples and metrics, each where Spark can split it.

    Samples stay one JSON line each, so their number is not bounded by one
    document; the metrics line holds the metadata.
    """
    samples.write.mode("overwrite").json(f"{path}/samples")
    meta = [F.lit(dataset).alias("dataset")]
    samples.agg(*[c.alias(k) for k, c in metrics.items()]).select(*meta, "*").write.mode("overwrite").json(
        f"{path}/metrics"
    )


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/samples")


def read_result_document(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a single-document result file, one row each."""
    doc = spark.read.schema(RESULT_SCHEMA).option("multiLine", "true").json(path)
    return doc.select("metadata.dataset", F.explode("samples").alias("_s")).select("dataset", "_s.*")


def result_key(key: str | Column) -> Column:
    """Where the result of a source object goes."""
    return F.concat(F.regexp_replace(col(key), r"\.[^.]*$", ""), F.lit("_result.json"))


def write_by_source(df: DataFrame, key: str, path: str) -> None:
    """Write result rows below a folder named after their result key."""
    df.withColumn("result_key", result_key(key)).write.partitionBy("result_key").mode("append").json(path)
