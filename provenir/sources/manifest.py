"""File manifests: listing, routing, splits and inventories."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import col
from .objects import opened

#: Bytes up to which a file is hashed as one value, and of a piece of longer ones.
WHOLE = 128 << 20
PIECE = 8 << 20

# Accepted file extensions.
VIDEO_EXTS = (".mp4", ".avi", ".mov", ".mkv", ".webm")
IMAGE_EXTS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
FRAME_EXTS = (".jpg", ".jpeg", ".png", ".bmp")
WEIGHT_EXTS = (".pth", ".pt", ".onnx", ".tflite")


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]*)$", 1))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def folder_label(path: str | Column) -> Column:
    """Name of the folder a file lies in."""
    return F.regexp_extract(col(path), r"([^/]+)/[^/]+$", 1)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """File metadata below a root; file content is never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select("path", "length", F.col("modificationTime").alias("mtime"))


def media_manifest(spark: SparkSession, root: str, exts: tuple[str, ...] = VIDEO_EXTS) -> DataFrame:
    """Labelled media files of a dataset folder, in name order."""
    files = list_files(spark, root).withColumns(
        {"ext": extension("path"), "label": folder_label("path"), "name": file_name("path")}
    )
    return files.filter(F.col("ext").isin(*exts)).orderBy("label", "name")


def list_objects(files: DataFrame, prefix: str = "", max_keys: int = 1000) -> DataFrame:
    """First keys under a prefix, in key order. Reads (key, size, last_modified)."""
    hit = files.filter(F.col("key").startswith(prefix)) if prefix else files
    return hit.orderBy("key").limit(max_keys)


def storage_usage(files: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("size"), F.lit(0))
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        total.alias("total_size_bytes"),
        F.round(total / 1048576, 2).alias("total_size_mb"),
    )


def route_media(df: DataFrame, name: str) -> DataFrame:
    """Media type by extension; items without a file name go to text."""
    ext = extension(name)
    kind = (
        F.when(F.col(name).isNull(), "text")
        .when(ext.isin(*VIDEO_EXTS), "video")
        .when(ext.isin(*IMAGE_EXTS), "image")
        .otherwise("reject")
    )
    return df.withColumns({"ext": ext, "media_type": kind})


def split_manifest(df: DataFrame, path: str) -> DataFrame:
    """Split, label and sample of ``.../<split>/<real|fake>/...`` image paths.

    A folder of frames is one video; a bare image is its own sample.
    """
    parts = F.split(F.col(path), "/")
    at = F.array_position(F.transform(parts, lambda p: p.isin("real", "fake")), F.lit(True)).cast("int")
    d = df.filter(extension(path).isin(*FRAME_EXTS)).withColumns({"_p": parts, "_at": at})
    d = d.filter((F.col("_at") > 1) & (F.array_size("_p") > F.col("_at")))
    return d.withColumns(
        {
            "split": F.element_at("_p", F.col("_at") - 1),
            "label": (F.element_at("_p", F.col("_at")) == "fake").cast("int"),
            "sample": F.element_at("_p", F.col("_at") + 1),
            "is_video": F.array_size("_p") > F.col("_at") + 1,
        }
    ).drop("_p", "_at")


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split", "label").agg(F.count(F.lit(1)).alias("samples"))


def file_inventory(spark: SparkSession, root: str, exts: tuple[str, ...] = WEIGHT_EXTS, whole: int = WHOLE) -> DataFrame:
    """Names and content hashes of model files of any length.

    Files of up to ``whole`` bytes are hashed as values; longer ones are read by
    a task in chunks, through ``pyarrow.fs``, and never held as one value.
    Spark's file sources list no empty files; ``objects`` does.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(extension("path").isin(*exts))
    small = raw.filter(F.col("length") <= whole).select(file_name("path").alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    large = raw.filter(F.col("length") > whole).select(file_name("path").alias("name"), "length", "path")
    return small.unionByName(large.mapInPandas(_hashed, "name string, length bigint, sha256 string"))


def _hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        yield p.assign(sha256=[_sha256(x) for x in p["path"]])[["name", "length", "sha256"]]


def _sha256(path: str) -> str:
    fs, name = opened(path)
    total = hashlib.sha256()
    with fs.open_input_stream(name) as f:
        while chunk := f.read(PIECE):
            total.update(chunk)
    return total.hexdigest()
