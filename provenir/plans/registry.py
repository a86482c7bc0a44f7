"""Detector plug-ins: contract, registry and the unified scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import SPECTRAL_BANDS, status_band
from ..operators.fusion import fuse_detectors, no_detectors, with_fallback
from .text_scan import text_scan

RESULT_COLUMNS = (
    "detector_name", "detector_type", "score", "confidence", "status", "details", "anomalies", "data_quality",
)


@dataclass(frozen=True)
class Detector:
    """A named function from an input table to result rows.

    ``run`` returns one row per input row with (item, score, confidence,
    status, anomalies, data_quality) and optionally ``details``; a NULL score
    marks a failed row. ``required`` tells which rows have its input.
    """

    name: str
    kind: str
    capabilities: frozenset[str]
    run: Callable[[DataFrame], DataFrame]
    required: Callable[[], Column] = field(default=lambda: F.lit(True))
    version: str = "1.0.0"
    enabled: bool = True

    def detect(self, df: DataFrame, item: str) -> DataFrame:
        """Result rows for every input row, neutral where input is missing.

        The two kinds of row are united, so no join back to the input is needed.
        """
        need = F.coalesce(self.required(), F.lit(False))
        got = self.run(df.filter(need))
        if "details" not in got.columns:
            got = got.withColumn("details", F.create_map().cast("map<string,string>"))
        keep = [c for c in RESULT_COLUMNS if c in got.columns]
        missing = df.filter(~need).select(item)
        rows = got.select(item, *keep, F.lit(True).alias("_has")).unionByName(
            missing.withColumn("_has", F.lit(False)), allowMissingColumns=True
        )
        full = with_fallback(rows, self.name, self.kind, F.col("_has"))
        none = F.array().cast("array<string>")
        return full.withColumn("anomalies", F.coalesce("anomalies", none)).select(item, *RESULT_COLUMNS)


class Registry:
    """Driver-side set of detectors by name."""

    def __init__(self) -> None:
        self._by_name: dict[str, Detector] = {}

    def register(self, d: Detector) -> None:
        self._by_name[d.name] = d

    def unregister(self, name: str) -> None:
        self._by_name.pop(name, None)

    def get(self, name: str) -> Detector | None:
        return self._by_name.get(name)

    def by_capability(self, cap: str) -> list[Detector]:
        return [d for d in self._by_name.values() if cap in d.capabilities]

    def by_kind(self, kind: str) -> list[Detector]:
        return [d for d in self._by_name.values() if d.kind == kind]

    def names(self) -> list[str]:
        return list(self._by_name)

    def __len__(self) -> int:
        return len(self._by_name)

    def health(self) -> dict[str, dict[str, object]]:
        return {d.name: {"name": d.name, "status": "ok", "enabled": d.enabled} for d in self._by_name.values()}

    def table(self, spark: SparkSession) -> DataFrame:
        """The registered detectors as rows."""
        rows = [(d.name, d.kind, sorted(d.capabilities), d.version, d.enabled) for d in self._by_name.values()]
        return spark.createDataFrame(
            rows, "name string, type string, capabilities array<string>, version string, enabled boolean"
        )


def scan(df: DataFrame, registry: Registry, capability: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Run every enabled detector with a capability; return rows and fusion."""
    outs = [d.detect(df, item) for d in registry.by_capability(capability) if d.enabled]
    if not outs:
        empty = df.sparkSession.createDataFrame(
            [], f"{item} {df.schema[item].dataType.simpleString()}, detectors_run bigint, usable bigint, "
            "aggregate_score double, verdict string",
        )
        return empty, no_detectors(df, empty, item)
    rows = outs[0]
    for o in outs[1:]:
        rows = rows.unionByName(o)
    return rows, fuse_detectors(rows, item)


def string_details(*cols: str) -> Column:
    pairs: list[Column] = []
    for c in cols:
        pairs += [F.lit(c), F.col(c).cast("string")]
    return F.create_map(*pairs)


def text_detector(item: str = "doc_id", text: str = "text") -> Detector:
    def run(df: DataFrame) -> DataFrame:
        r = text_scan(df, item, text)
        return r.withColumn("details", string_details("word_count", "sentence_count", "burstiness_score", "vocabulary_score"))

    has = lambda: F.col(text).isNotNull() & (F.col(text) != "")
    return Detector("Text Detector", "text", frozenset({"text_content"}), run, has)


def core_adapter(name: str, kind: str, caps: set[str], run: Callable[[DataFrame], DataFrame]) -> Detector:
    """Adapter for a core that already returns the common columns."""
    return Detector(name, kind, frozenset(caps), run)


def spectral_adapter(run: Callable[[DataFrame], DataFrame]) -> Detector:
    """Adapter for item-level spectral results: its own bands and quality rule."""

    def full(df: DataFrame) -> DataFrame:
        r = run(df)
        return r.withColumns(
            {
                "status": status_band("score", *SPECTRAL_BANDS),
                "data_quality": F.when(F.col("confidence") > 0.5, "GOOD").otherwise("LIMITED"),
            }
        )

    return Detector("Frequency Analyzer", "visual", frozenset({"video_frames", "single_image"}), full)


def result_struct() -> Column:
    """The common result as one nested column, scores at four decimals."""
    return F.struct(
        "detector_name", "detector_type",
        F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"),
        "status", "details", "anomalies", "data_quality",
    )
