"""One scan over items that hold different inputs.

The inputs of a scan are keyed tables, one for each kind: an item has text, or
frames, or vectors, or several of them. Every detector names the tables it reads
and gives a row for each item it finds there. The rows of all detectors meet in
one aggregation by item, whose groups have at most one row for each detector;
there the detectors that found no input are filled in as skipped, and the rest
are fused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import SPECTRAL_BANDS, status_band
from ..operators import features as X
from ..operators import signals as G
from ..operators.fusion import fuse_detectors, with_fallback
from .registry import RESULT_COLUMNS, string_details
from .text_scan import text_scan

Inputs = dict[str, DataFrame]

RESULT_TYPE = "struct<detector_name:string,detector_type:string,score:double,confidence:double,status:string,details:map<string,string>,anomalies:array<string>,data_quality:string>"


@dataclass(frozen=True)
class TableDetector:
    """A named function from keyed input tables to one row for each item.

    ``reads`` names the tables; ``run`` gets the inputs and returns (item, score,
    confidence, status, anomalies, data_quality, details) for the items it found
    input for. A NULL score marks a failed item.
    """

    name: str
    kind: str
    capabilities: frozenset[str]
    reads: tuple[str, ...]
    run: Callable[[Inputs], DataFrame]
    version: str = "1.0.0"
    enabled: bool = True

    def rows(self, inputs: Inputs, item: str) -> DataFrame:
        """Result rows (item, r) of the items with input."""
        got = with_fallback(self.run(inputs), self.name, self.kind, F.lit(True))
        got = got.withColumn("anomalies", F.coalesce("anomalies", F.array().cast("array<string>")))
        return got.select(item, F.struct(*RESULT_COLUMNS).cast(RESULT_TYPE).alias("r")).filter(F.col(item).isNotNull())

    def skipped(self) -> Column:
        """The result of an item without input."""
        return F.struct(
            F.lit(self.name).alias("detector_name"), F.lit(self.kind).alias("detector_type"), F.lit(0.5).alias("score"), F.lit(0.0).alias("confidence"),
            F.lit("SKIPPED").alias("status"), F.create_map(F.lit("reason"), F.lit(f"No {' or '.join(self.reads)} provided")).alias("details"),
            F.array().cast("array<string>").alias("anomalies"), F.lit("INSUFFICIENT").alias("data_quality"),
        ).cast(RESULT_TYPE)


def chosen(detectors: Iterable[TableDetector], capabilities: Iterable[str] | None = None) -> list[TableDetector]:
    """The enabled detectors, of any capability or of at least one named."""
    some = None if capabilities is None else set(capabilities)
    return [d for d in detectors if d.enabled and (some is None or d.capabilities & some)]


def scan_results(inputs: Inputs, detectors: list[TableDetector], item: str) -> DataFrame:
    """A row for each item of any input table and each detector, whether it ran or was skipped."""
    parts = [d.rows(inputs, item) for d in detectors if all(t in inputs for t in d.reads)]
    # An item that only stands in a table nobody reads, or whose detector gives nothing, is still scanned.
    parts += [t.select(item).filter(F.col(item).isNotNull()).distinct().select(item, F.lit(None).cast(RESULT_TYPE).alias("r")) for t in inputs.values()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    held = both.groupBy(item).agg(F.collect_list("r").alias("_h"))  # nulls stay out: one entry for each detector at most

    def of(d: TableDetector) -> Column:
        mine = F.filter("_h", lambda r: r["detector_name"] == d.name)
        return F.coalesce(F.get(mine, F.lit(0)), d.skipped())

    return held.select(item, F.inline(F.array(*[of(d) for d in detectors])))


def unified_scan(inputs: Inputs, detectors: list[TableDetector], item: str, digits: int | None = 4) -> DataFrame:
    """Score and verdict of every item: (item, detectors_run, usable, aggregate_score, verdict)."""
    return fuse_detectors(scan_results(inputs, detectors, item), item, digits)


# --- adapters -----------------------------------------------------------------------


def _passed(df: DataFrame, details: Column) -> DataFrame:
    return df.withColumns({"status": F.lit("PASS"), "data_quality": F.lit("GOOD"), "details": details})


def _rounded(**digits: int) -> Column:
    pairs: list[Column] = []
    for name, n in digits.items():
        pairs += [F.lit(name), F.round(name, n).cast("string")]
    return F.create_map(*pairs)


def text_adapter(item: str, text: str = "text") -> TableDetector:
    """Reads ``texts`` (item, text)."""

    def run(inputs: Inputs) -> DataFrame:
        some = inputs["texts"].filter(F.col(text).isNotNull() & (F.col(text) != ""))
        return text_scan(some, item, text).withColumn("details", string_details("word_count", "sentence_count", "burstiness_score", "vocabulary_score"))

    return TableDetector("Text Detector", "text", frozenset({"text_content"}), ("texts",), run)


def vector_adapter(item: str) -> TableDetector:
    """Reads ``vectors`` (item, vec): one embedding for each image."""

    def run(inputs: Inputs) -> DataFrame:
        r = X.embedding_stats(inputs["vectors"].filter(F.size("vec") > 0), "vec")
        return _passed(r, F.map_concat(_rounded(feature_norm=4, feature_entropy=4), F.create_map(F.lit("embedding_dim"), F.size("vec").cast("string"))))

    return TableDetector("CLIP Detector", "visual", frozenset({"single_image", "video_frames"}), ("vectors",), run, "6.0.0")


def frame_vector_adapter(item: str, idx: str) -> TableDetector:
    """Reads ``frame_vectors`` (item, idx, vec): the embeddings of a clip's frames, ``idx`` dense."""

    def run(inputs: Inputs) -> DataFrame:
        frames = X.embedding_stats(inputs["frame_vectors"], "vec").select(item, idx, "score")
        return _passed(X.embedding_item(frames, item, idx), _rounded(frames_analyzed=0, score_std=4))

    return TableDetector("CLIP Detector", "visual", frozenset({"single_image", "video_frames"}), ("frame_vectors",), run, "6.0.0")


def patch_adapter(item: str) -> TableDetector:
    """Reads ``patches`` (item, patches): the patches of one image."""

    def run(inputs: Inputs) -> DataFrame:
        r = X.patch_stats(inputs["patches"], "patches")
        return _passed(r, _rounded(attention_entropy=4, attention_uniformity=4, patch_variance=6, boundary_score=4))

    return TableDetector("ViT Detector", "visual", frozenset({"single_image", "video_frames"}), ("patches",), run, "6.0.0")


def spectrogram_adapter(item: str, t: str, db: str, n_bins: int) -> TableDetector:
    """Reads ``spectrogram`` (item, t, db): constant-Q frames of a sound track, ``t`` dense."""

    def run(inputs: Inputs) -> DataFrame:
        r = G.spectrogram_result(inputs["spectrogram"], item, t, db, n_bins)
        named = r.withColumns({"harmonic_ratio": F.col("harmonic"), "spectral_continuity": F.col("continuity"), "formant_consistency": F.col("formants")})
        return _passed(named, _rounded(harmonic_ratio=4, spectral_continuity=4, formant_consistency=4))

    return TableDetector("CQT Audio Detector", "audio", frozenset({"audio_track"}), ("spectrogram",), run, "6.0.0")


def spectrum_adapter(item: str, t: str) -> TableDetector:
    """Reads ``spectra`` (item, t, flatness, high_ratio, mid_ratio, kurtosis, azimuthal_std), ``t`` dense."""

    def run(inputs: Inputs) -> DataFrame:
        r = X.spectral_item(X.spectral_frame(inputs["spectra"]), item, t)
        good = F.when(F.col("confidence") > 0.5, "GOOD").otherwise("LIMITED")
        return r.withColumns({"status": status_band("score", *SPECTRAL_BANDS), "data_quality": good, "details": _rounded(frames_analyzed=0, score_std=4, flatness=4, high_ratio=4, kurtosis=4)})

    return TableDetector("Frequency Analyzer", "visual", frozenset({"video_frames", "single_image"}), ("spectra",), run)


def artifact_adapter(item: str) -> TableDetector:
    """Reads ``frame_features``: the measures of each frame that ``artifact_result`` takes."""

    def run(inputs: Inputs) -> DataFrame:
        r = X.artifact_result(inputs["frame_features"], item, inputs.get("profiles"))
        return r.withColumn("details", string_details("n_frames", "model_type", "gan_score", "diffusion_score", "vae_score", "warp_count"))

    return TableDetector("Artifact Detector", "visual", frozenset({"video_frames", "single_image"}), ("frame_features",), run)


def biosignal_adapter(item: str, channel: str, sig: str, fps: float = 30.0) -> TableDetector:
    """Reads ``signals`` (item, channel, sig) and, if there, ``profiles`` (item, is_low_res, rppg_viable)."""

    def run(inputs: Inputs) -> DataFrame:
        signals = inputs["signals"]
        kind = signals.schema[item].dataType.simpleString()
        profiles = inputs.get("profiles")
        if profiles is None:
            profiles = signals.sparkSession.createDataFrame([], f"{item} {kind}, is_low_res boolean, rppg_viable boolean")
        r = G.biosignal_result(signals, item, channel, sig, profiles, fps)
        return r.withColumn("details", string_details("channels", "sync", "pulse_coverage", "hr_consistency", "mean_bpm"))

    return TableDetector("BioSignal Detector", "biological", frozenset({"video_frames", "biological_signal"}), ("signals",), run)
