"""Engine input tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bands import verdict_band
from ..functions.exprs import let
from ..functions.hashing import iso_ts
from ..operators.fusion import audio_profile, core_columns, media_profile
from ..operators.ordered import dense_index, ordered_mean, second_cell

SR = 1000
#: Lines of a partition: so many; up to ``MOST_LINES`` where that takes more than ``DIRECT`` partitions, as a shuffle
#: into more holds the rows of a split in memory (``spark.shuffle.sort.bypassMergeThreshold``).
LINES, MOST_LINES, DIRECT = 250_000, 1_250_000, 200


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of CPU-heavy work on a table of few files.

    A table with at least one file per core is left as it is scanned.
    """
    return df.repartition(_cores(df.sparkSession)) if few_files(df) else df


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def few_files(df: DataFrame) -> bool:
    return len(df.inputFiles()) < _cores(df.sparkSession)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def ranked_events(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value")
    return dense_index(e, ["user_id"], second_cell(F.col("ts")), [F.col("ts"), F.col("event_id")])


def frame_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_events(spark, sf).select(
        F.col("user_id").alias("item"), "idx", F.least(F.col("value") / 100, F.lit(1.0)).alias("score")
    )


def openings(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_events(spark, sf).select(F.col("user_id").alias("item"), "idx", F.col("value").alias("opening"))


def _item_week(e: DataFrame) -> DataFrame:
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    return e.withColumn("item", F.col("user_id") * 100 + week)


def core_results(spark: SparkSession, sf: str) -> DataFrame:
    core = (
        F.when(F.col("event_type") == "click", "biosignal")
        .when(F.col("event_type") == "view", "artifact")
        .when(F.col("event_type") == "purchase", "alignment")
    )
    e = _item_week(events(spark, sf)).withColumn("core", core).filter("core IS NOT NULL")
    g = ordered_mean(e, ["item", "core"], ["event_id", "value"], "value").groupBy("item", "core").agg(
        F.max("_a").alias("_a"), F.count(F.lit(1)).alias("_n"), F.max("value").alias("_x")
    )
    notes = F.array_compact(
        F.array(F.when(F.col("_x") > 60, "EXTREME_VALUE"), F.when(F.col("_n") >= 4, "BURST"))
    )
    return g.select(
        "item", "core", F.least(F.col("_a") / 40, F.lit(1.0)).alias("score"),
        F.least(F.col("_n") / 5, F.lit(1.0)).alias("confidence"), notes.alias("anomalies"),
    )


def media_rows(spark: SparkSession, sf: str) -> DataFrame:
    g = _item_week(events(spark, sf)).groupBy("item").agg(F.count(F.lit(1)).alias("_n"))
    heights = F.array(*[F.lit(h) for h in (360, 480, 720, 1080, 2160)])
    h = F.get(heights, (F.col("item") % 5).cast("int"))
    fps = F.get(F.array(F.lit(0.0), F.lit(24.0), F.lit(30.0)), (F.col("item") % 3).cast("int"))
    return g.select(
        "item", F.floor(h * 16 / 9).cast("int").alias("width"), h.alias("height"), fps.alias("fps"),
        (F.lit(100) + F.col("_n") * 10).alias("frame_count"),
    )


def media_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return media_profile(media_rows(spark, sf))


def audio_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = _item_week(events(spark, sf)).filter("event_type = 'error'")
    g = ordered_mean(e, ["item"], ["event_id", "value"], "value").groupBy("item").agg(F.max("_a").alias("_a"), F.count(F.lit(1)).alias("_n"))
    return g.select(
        "item", (F.col("_a") >= 2).alias("has_audio"),
        F.least(F.col("_a"), F.lit(40.0)).alias("snr_db"), (F.col("_n") >= 2).alias("is_speech"),
    )


def audio_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return audio_profile(audio_rows(spark, sf))


def wide_cores(spark: SparkSession, sf: str) -> DataFrame:
    return core_columns(core_results(spark, sf), "item")


def modalities(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select(F.col("user_id").alias("item"), F.col("event_type").alias("name"), "event_id", "value")
    g = ordered_mean(e, ["item", "name"], ["event_id", "value"], "value").groupBy("item", "name").agg(
        F.max("_a").alias("_a"), F.count(F.lit(1)).alias("_n")
    )
    return g.select(
        "item", "name", F.least(F.col("_a") / 40, F.lit(1.0)).alias("score"),
        F.least(F.col("_n") / 20, F.lit(1.0)).alias("confidence"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return v.select(
        F.col("vec_id").alias("item"), F.col("label").cast("bigint").alias("grp"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select(F.col("grp").alias("item"), F.col("item").alias("channel"), F.col("vec").alias("sig"))


def signal_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The signals as one row for each sample."""
    return signals(spark, sf).select("item", "channel", F.posexplode("sig").alias("t", "v"))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a label in id order, as frames t = 0, 1, ..."""
    v = vectors(spark, sf).select(F.col("grp").alias("item"), F.col("item").alias("vec_id"), "vec")
    pos = dense_index(v.select("item", "vec_id"), ["item"], F.col("vec_id"), [F.col("vec_id")], "t")
    return v.join(pos, ["item", "vec_id"])


def spectrogram(spark: SparkSession, sf: str) -> DataFrame:
    db = F.transform("vec", lambda x: 20 * F.log10(F.abs(x) + 1e-10))
    return _frames(spark, sf).select("item", "t", db.alias("db"))


def spectral_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Flatness, band shares, kurtosis and profile spread of each frame."""
    from ..functions.exprs import array_mean, array_std
    from ..operators.features import band_ratios, spectral_flatness

    f = _frames(spark, sf).withColumn("profile", F.transform("vec", lambda x: F.abs(x)))
    kurt = let(
        array_mean(F.col("vec")),
        lambda m: let(
            F.struct(
                array_mean(F.transform("vec", lambda x: F.pow(x - m, F.lit(4.0)))).alias("m4"),
                array_mean(F.transform("vec", lambda x: (x - m) * (x - m))).alias("m2"),
            ),
            lambda s: s["m4"] / (s["m2"] * s["m2"]) - 3.0,
        ),
    )
    r = f.withColumns(
        {
            "flatness": spectral_flatness("profile"), "_b": band_ratios("profile"),
            "kurtosis": kurt, "azimuthal_std": array_std(F.col("profile")),
        }
    )
    return r.select("item", "t", "flatness", F.col("_b.high").alias("high_ratio"), F.col("_b.mid").alias("mid_ratio"), "kurtosis", "azimuthal_std")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    f = _frames(spark, sf).select("item", "t", F.posexplode("vec").alias("_p", "v"))
    return f.select("item", (F.col("t") * 64 + F.col("_p")).alias("i"), "v")


def patches(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.features import split_patches

    return vectors(spark, sf).select("item", "grp", split_patches("vec", 4).alias("patches"))


def grids(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("item", F.transform("vec", lambda x: F.abs(x)).alias("grid"))


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    g = grids(spark, sf).select("item", F.posexplode("grid").alias("p", "v"))
    return g.select("item", F.floor(F.col("p") / 8).alias("r"), (F.col("p") % 8).cast("bigint").alias("c"), "v")


def heat_cells(spark: SparkSession, sf: str) -> DataFrame:
    def at(shift: int) -> Column:
        return F.least(F.get("grid", ((F.col("p") + shift) % 64).cast("int")) * 4, F.lit(1.0))

    g = grids(spark, sf).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return g.select(
        "item", (F.col("p") % 8).cast("bigint").alias("x"), F.floor(F.col("p") / 8).alias("y"),
        at(0).alias("gan"), at(21).alias("diffusion"), at(42).alias("vae"),
    )


def eyes(spark: SparkSession, sf: str) -> DataFrame:
    """Landmark points of each frame from consecutive value pairs."""
    pts = let(
        F.col("vec"),
        lambda v: F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda j: F.struct(F.get(v, j * 2).alias("x"), F.get(v, j * 2 + 1).alias("y")),
        ),
    )
    return _frames(spark, sf).select("item", "t", pts.alias("pts"))


def eye_points(spark: SparkSession, sf: str) -> DataFrame:
    p = eyes(spark, sf).select("item", "t", F.posexplode("pts").alias("_p", "pt")).filter("_p < 12")
    return p.select(
        "item", "t", F.when(F.col("_p") < 6, "left").otherwise("right").alias("side"),
        (F.col("_p") % 6).alias("p"), F.col("pt.x").alias("x"), F.col("pt.y").alias("y"),
    )


def eye_features(spark: SparkSession, sf: str) -> DataFrame:
    """Openness of both eyes and gaze ratios of each frame."""
    from ..operators.features import eye_aspect_ratio, gaze_ratio

    def at(j: int) -> Column:
        return F.get("pts", F.lit(j))

    e = eyes(spark, sf).withColumns(
        {
            "left_ear": eye_aspect_ratio(F.slice("pts", 1, 6)), "right_ear": eye_aspect_ratio(F.slice("pts", 7, 6)),
            "left_iris": F.slice("pts", 13, 5), "right_iris": F.slice("pts", 18, 5),
            "left_outer": at(0), "left_inner": at(3), "right_inner": at(6), "right_outer": at(9),
            "upper": at(22), "lower": at(23),
        }
    )
    return gaze_ratio(e).select("item", "t", "left_ear", "right_ear", "gaze_h", "gaze_v")


def _line_parts(lines: DataFrame) -> int:
    """Into how many partitions lines are dealt, so that a task's share does not grow with the table."""
    n = lines.count()  # from the footers of the files
    return max(_cores(lines.sparkSession), min(DIRECT, -(-n // LINES)), -(-n // MOST_LINES))


def frame_features(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    parts = _line_parts(l)
    d = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    # A split has about as many items and days as lines, and summed at once all of them would be in its memory. So lines are
    # dealt first; the lines of one item and day go to 16 places.
    place = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(16)).alias("_s")
    values = ("discount", "tax", "quantity", "extendedprice")
    lines = l.select(F.col("l_suppkey").alias("item"), d.cast("bigint").alias("day"), place, *[F.col(f"l_{v}").alias(v) for v in values])
    sums = lines.repartition(parts, "item", "day", "_s").groupBy("item", "day", "_s").agg(
        *[f(v).alias(f"{k}_{v}") for v in values for k, f in (("sum", F.sum), ("n", F.count))],
        F.max("tax").alias("max_tax"), F.min("quantity").alias("min_quantity"), F.max("quantity").alias("max_quantity"),
    )

    def avg(v: str) -> Column:
        return F.sum(f"sum_{v}") / F.sum(f"n_{v}")

    g = sums.repartition(parts, "item").groupBy("item", "day").agg(
        (avg("discount") * 3.01).alias("grid_score"),
        (avg("tax") * 50 + 1).alias("kurtosis"),
        (avg("quantity") / 10).alias("noise_std"),
        (avg("extendedprice") / 100).alias("blur_var"),
        (avg("discount") * 6.03).alias("detail_ratio"),
        (F.max("max_tax") * 40).alias("flow_dir_var"),
        (F.sum("sum_quantity") / 20).alias("flow_mag"),
        (avg("quantity") * 5).alias("brightness"),
        (avg("tax") * 100).alias("compression"),
        (avg("discount") * 9).alias("changed"),
        (avg("extendedprice") / 300).alias("gradient"),
        (F.min("min_quantity") - 1).alias("min_val"),
        (F.max("max_quantity") * 5.2).alias("max_val"),
        (avg("tax") * 12).alias("high_freq_share"),
    )
    h = 720 + 360 * ((F.col("item") % 2) * (F.col("day") % 2))
    g = g.withColumns({"height": h, "width": F.floor(h * 16 / 9), "mean_val": F.col("brightness")})
    # An item has one row for each calendar day at most, however many lines it has: a window over it is small.
    days = Window.partitionBy("item").orderBy(F.asc_nulls_last("day"))
    return g.withColumn("frame", F.row_number().over(days).cast("bigint") - 1)


def history(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    s = F.least(F.col("value") / 60, F.lit(1.0))
    return e.select(
        F.concat(F.lit("s"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("session_id"),
        F.concat("event_type", F.lit("_"), F.col("event_id"), F.lit(".mp4")).alias("filename"),
        verdict_band(s).alias("verdict"),
        F.round(100 * (1 - s), 2).alias("integrity_score"),
        s.alias("biosignal_score"),
        F.least(F.col("value") / 80, F.lit(1.0)).alias("artifact_score"),
        F.least(F.col("value") / 120, F.lit(1.0)).alias("alignment_score"),
        F.lit("1280x720").alias("resolution"),
        F.col("value").alias("duration_seconds"),
        F.col("ts").alias("timestamp"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("sha256_hash"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user"),
    )


def verdict_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger payloads from orders: one chain per customer."""
    o = table(spark, sf, "orders")
    cents = F.floor(F.col("o_totalprice")).cast("bigint") % 100
    s = (cents / 100).cast("decimal(4,2)")
    core = F.to_json(F.struct(s.cast("string").alias("artifact"), s.cast("string").alias("biosignal")))
    return o.select(
        F.col("o_custkey").alias("chain"),
        F.col("o_orderkey").alias("seq"),
        core.alias("core_scores"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"),
        (100 - cents).alias("integrity_score"),
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("session_id"),
        iso_ts("o_orderdate").alias("timestamp"),
        verdict_band(s.cast("double")).alias("verdict"),
        F.lit('{"alignment":"0.34","artifact":"0.33","biosignal":"0.33"}').alias("weights_used"),
    )


def labelled_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Text scores and sub-scores paired with the quality labels."""
    from .text_scan import text_scan

    known = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi")
    t = text_scan(spread(known.select("doc_id", "text", "source", "lang")))
    half = [F.coalesce(F.col(f"{k}_score"), F.lit(0.5)).alias(f"{k}_score") for k in ("burstiness", "vocabulary", "perplexity", "repetition", "structure")]
    lab = table(spark, sf, "labels").select(
        "doc_id", (1 - F.col("quality")).alias("y"), "toxic"
    )
    return t.select("doc_id", "source", "lang", F.col("score").alias("s_full"), "confidence", "word_count", *half).join(lab, "doc_id")
