"""History, ledger, custody, audit counters and small dimension joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import status_band
from ..functions.exprs import fmt
from ..functions.hashing import GENESIS, day, since_days
from .fusion import BASE_WEIGHTS, CORES
from .ordered import CHUNK, own_rows, prefix_sums, with_halo

VERDICTS = ("AUTHENTIC", "MANIPULATED", "UNCERTAIN", "INCONCLUSIVE")

# --- history -----------------------------------------------------------------


def history_stats(df: DataFrame) -> DataFrame:
    """Totals of the scan history; zeros on an empty table."""
    counts = [
        F.coalesce(F.sum((F.col("verdict") == v).cast("bigint")), F.lit(0)).alias(f"{v.lower()}_count")
        for v in VERDICTS
    ]
    avg = F.round(F.coalesce(F.avg("integrity_score"), F.lit(0.0)), 2).alias("avg_integrity_score")
    return df.agg(F.count(F.lit(1)).alias("total_scans"), *counts, avg)


def history_daily(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Scans and threats of the last days, newest first."""
    recent = df.filter(since_days("timestamp", now, days))
    return (
        recent.groupBy(day("timestamp").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("scans"),
            F.sum((F.col("verdict") == "MANIPULATED").cast("bigint")).alias("threats"),
        )
        .orderBy(F.col("date").desc())
    )


def recent(df: DataFrame, n: int = 20) -> DataFrame:
    """Newest entries, between 1 and 100 of them."""
    return df.orderBy(F.col("timestamp").desc(), F.col("session_id").desc()).limit(max(1, min(n, 100)))


def retain_recent(df: DataFrame, n: int = 100) -> DataFrame:
    """What a clean-up keeps: the newest ``n`` entries."""
    return df.orderBy(F.col("timestamp").desc(), F.col("session_id").desc()).limit(n)


def expired(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """What a clean-up deletes: every entry outside the newest ``n``."""
    kept = retain_recent(df, n).select(key)
    return df.join(F.broadcast(kept), key, "left_anti")


def delete_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the listed keys."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def deleted_count(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    hit = df.join(keys.select(key).distinct(), key, "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("deleted"))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows of one key; the filter reaches the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def counts(df: DataFrame, dims: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias(name))


# --- ledger ---------------------------------------------------------------------

BEFORE = ("core_scores", "file_hash", "integrity_score")
AFTER = ("session_id", "timestamp", "verdict", "weights_used")


def _block_text(df: DataFrame) -> DataFrame:
    """Canonical block JSON cut around the two fields a chain decides."""
    head = F.to_json(F.struct(*BEFORE))
    tail = F.to_json(F.struct(*AFTER))
    mid = F.concat(F.lit(","), F.expr("substring(_h, 2, length(_h) - 2)"), F.lit(',"previous_hash":"'))
    end = F.concat(F.lit('",'), F.expr("substring(_t, 2)"))
    return df.withColumns({"_h": head, "_t": tail}).withColumns({"_mid": mid, "_end": end}).drop("_h", "_t")


def block_hash(index: Column, previous: Column) -> Column:
    """Hash of a block whose text parts are ``_mid`` and ``_end``."""
    text = F.concat(F.lit('{"block_index":'), index.cast("string"), F.col("_mid"), previous, F.col("_end"))
    return F.sha2(text, 256)


def ledger_append(df: DataFrame, chain: str, order: list[str], tails: DataFrame | None = None) -> DataFrame:
    """Link new verdict rows to the end of their chain.

    A hash chain is serial by definition, so each chain streams through one
    task in order with only the last hash in memory; chains run in parallel.
    ``tails`` (chain, block_index, block_hash) continues stored chains: each
    tail travels as a marker row ahead of its chain's new rows.
    """
    d = _block_text(df).withColumns(
        {"_new": F.lit(1), "_i0": F.lit(None).cast("bigint"), "_h0": F.lit(None).cast("string")}
    )
    if tails is not None:
        # Whole-number columns stay free of NULL, which pandas would turn to float.
        whole = [f for f in df.schema.fields if f.name != chain and isinstance(f.dataType, T.IntegralType)]
        marks = tails.select(
            chain, F.lit(0).alias("_new"), *[F.lit(0).cast(f.dataType).alias(f.name) for f in whole],
            F.col("block_index").cast("bigint").alias("_i0"), F.col("block_hash").alias("_h0"),
        )
        d = d.unionByName(marks, allowMissingColumns=True)
    # The hash of the key, not the key: Spark drops a repartition by a key its
    # input is already partitioned by, and a join below it that turns into a
    # broadcast at run time would then leave a chain spread over tasks.
    ordered = d.repartition(F.xxhash64(chain)).sortWithinPartitions(chain, "_new", *order)
    names = [c for c in df.columns]
    extra = "block_index bigint, previous_hash string, block_hash string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + extra

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_chain, index, prev = None, -1, GENESIS
        for pdf in batches:
            idx, before, after, keep = [], [], [], []
            cols = (pdf[c] for c in (chain, "_new", "_i0", "_h0", "_mid", "_end"))
            for key, new, i0, h0, mid, end in zip(*cols):
                if key != last_chain:
                    last_chain, index, prev = key, -1, GENESIS
                keep.append(bool(new))
                if not new:  # i0 is a float here, exact up to 2**53 blocks
                    index, prev = int(i0), h0
                    continue
                index += 1
                digest = hashlib.sha256(f'{{"block_index":{index}{mid}{prev}{end}'.encode()).hexdigest()
                idx.append(index)
                before.append(prev)
                after.append(digest)
                prev = digest
            out = pdf.loc[keep, names]
            yield out.assign(block_index=idx, previous_hash=before, block_hash=after)

    return ordered.mapInPandas(link, schema)


def ledger_check(df: DataFrame, chain: str, chunk: int = CHUNK) -> DataFrame:
    """Per block: does it link to the one before, and does its hash recompute?"""
    rows = _block_text(df)
    cut, w = with_halo(rows, [chain], "block_index", 1, 0, chunk)
    prev = F.when(F.col("block_index") == 0, F.lit(GENESIS)).otherwise(F.lag("block_hash").over(w))
    linked = own_rows(cut.withColumn("_prev", prev))
    return linked.withColumns(
        {
            "link_ok": F.coalesce(F.col("previous_hash") == F.col("_prev"), F.lit(False)),
            "hash_ok": F.col("block_hash") == block_hash(F.col("block_index"), F.col("previous_hash")),
        }
    ).drop("_prev", "_mid", "_end")


def ledger_verify(df: DataFrame, chain: str, chunk: int = CHUNK) -> DataFrame:
    """Validity, length and first break of every chain."""
    c = ledger_check(df, chain, chunk)
    bad = ~F.col("link_ok") | ~F.col("hash_ok")
    g = c.groupBy(chain).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.min(F.when(bad, F.struct("block_index", "link_ok"))).alias("_b"),
    )
    i = F.col("_b.block_index")
    text = (
        F.when(F.col("_b").isNull(), "Chain integrity verified")
        .when(~F.col("_b.link_ok"), fmt("Chain broken at block %d: previous_hash mismatch", i))
        .otherwise(fmt("Block %d hash mismatch (tampered)", i))
    )
    return g.select(chain, "blocks", F.col("_b").isNull().alias("valid"), i.alias("broken_at"), text.alias("message"))


def ledger_export(df: DataFrame, chain: str) -> DataFrame:
    """One JSON document per block, ordered, with its chain's verification."""
    block = F.to_json(F.struct(*sorted(c for c in df.columns if c != chain)))
    v = ledger_verify(df, chain).select(chain, "valid", "message")
    return df.select(chain, "block_index", block.alias("block_json")).join(v, chain)


# --- custody ---------------------------------------------------------------------


def custody(df: DataFrame, session: str, label: str, sha: str, seq: str) -> DataFrame:
    """Entry count and last hash per label of each session."""
    per = df.groupBy(session, label).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(sha, seq).alias("_sha")
    )
    # Labels are a fixed set of processing steps, which bounds the map.
    return per.groupBy(session).agg(
        F.sum("_n").alias("chain_length"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "_sha")))).alias("summary"),
    )


def verify_hashes(stored: DataFrame, expected: DataFrame, session: str, label: str, sha: str, seq: str) -> DataFrame:
    """Whether the first stored hash of a label equals the expected one."""
    first = stored.groupBy(session, label).agg(F.min_by(sha, seq).alias("_sha"))
    j = expected.join(first, [session, label], "left")
    return j.withColumn("match", F.coalesce(F.col("_sha") == F.col("expected"), F.lit(False))).drop("_sha")


# --- counters --------------------------------------------------------------------

# Upper bounds of the latency histograms, in seconds.
REQUEST_BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)
ANALYSIS_BUCKETS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def histogram(df: DataFrame, dims: list[str], v: str, buckets: tuple[float, ...] = REQUEST_BUCKETS) -> DataFrame:
    """Cumulative histogram rows of each group: one pass, no row copies."""
    g = df.groupBy(*dims).agg(
        F.sum(v).alias("total"),
        F.count(v).alias("_inf"),
        *[F.sum((F.col(v) <= b).cast("bigint")).alias(f"_le{i}") for i, b in enumerate(buckets)],
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_le{i}").alias("n")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n")))
    return g.withColumn("_b", F.explode(F.array(*rows))).select(
        *dims, F.col("_b.le").alias("le"), F.col("_b.n").alias("cumulative"), "total", F.col("_inf").alias("count")
    )


def active_at(df: DataFrame, start: str, end: str) -> DataFrame:
    """Items started and not finished, at every instant that changes it."""
    ticks = df.select(F.col(start).alias("instant"), F.lit(1).alias("_d")).unionByName(
        df.filter(F.col(end).isNotNull()).select(F.col(end).alias("instant"), F.lit(-1).alias("_d"))
    )
    net = ticks.groupBy("instant").agg(F.sum("_d").alias("_d"))
    cell = F.unix_seconds(F.col("instant").cast("timestamp"))
    run = prefix_sums(net, [], cell, [F.col("instant")], {"active": F.col("_d")}, 1)
    return run.select("instant", "active")


def admit(df: DataFrame, key: str, ts: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Add ``requests`` and ``allowed``: requests of the key in the last ``seconds``, and whether they stay within the limit.

    The trailing span has both its ends; requests of the same moment count for
    each other, and refused ones count too. The number is the difference of two
    running totals, at the request and at the start of its span, so no task ever
    holds a whole key. Rows without a key or time are not limited.
    """
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    known = F.col(key).isNotNull() & F.col("_us").isNotNull()
    moments = rows.filter(known).groupBy(key, "_us").agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    line = moments.select(key, F.col("_us").alias("_at"), F.lit(1).alias("_side"), "_n", F.col("_us").alias("_of")).unionByName(
        moments.select(key, (F.col("_us") - seconds * 1_000_000).alias("_at"), F.lit(0).alias("_side"), zero.alias("_n"), F.col("_us").alias("_of"))
    )
    cell = F.floor(F.col("_at") / 1_000_000)
    run = prefix_sums(line, [key], cell, [F.col("_at"), F.col("_side")], {"_run": F.col("_n")})
    total = F.sum(F.when(F.col("_side") == 1, F.col("_run")).otherwise(-F.col("_run")))
    counts = run.groupBy(F.col(key).alias("_key"), F.col("_of")).agg(total.alias("requests"))
    joined = rows.join(counts, (F.col(key) == F.col("_key")) & (F.col("_us") == F.col("_of")), "left")
    return joined.select(*df.columns, "requests", F.coalesce(F.col("requests") <= limit, F.lit(True)).alias("allowed"))


# --- dimensions ---------------------------------------------------------------------

# Known generators. Key, name, category, family, first seen,
# biosignal impact, artifact pattern, alignment impact, notes.
THREATS = (
    ("deepfakes_ff", "DeepFakes (FF++)", "face_swap", "gan", "2018", 0.7, "GAN", 0.3, ""),
    ("face2face", "Face2Face", "face_reenactment", "gan", "2016", 0.5, "GAN", 0.6, ""),
    ("faceswap", "FaceSwap", "face_swap", "gan", "2018", 0.8, "GAN", 0.2, ""),
    ("neural_textures", "NeuralTextures", "face_reenactment", "gan", "2019", 0.4, "GAN", 0.5, ""),
    ("wav2lip", "Wav2Lip", "lip_sync", "gan", "2020", 0.2, "GAN", 0.8, "Only modifies lip region; ALIGNMENT core is primary detector"),
    ("stable_diffusion_inpaint", "Stable Diffusion Inpainting", "full_synthesis", "diffusion", "2022", 0.9, "DIFFUSION", 0.1, ""),
    ("midjourney_v6", "Midjourney v6", "full_synthesis", "diffusion", "2024", 0.95, "DIFFUSION", 0.0, "Image-only; no video/audio analysis applicable"),
    ("elevenlabs_clone", "ElevenLabs Voice Clone", "voice_clone", "autoregressive", "2023", 0.0, "NONE", 0.9, "Audio-only deepfake; ALIGNMENT and AUDIO cores primary detectors"),
    ("heygen_avatar", "HeyGen AI Avatar", "full_synthesis", "hybrid", "2023", 0.85, "DIFFUSION", 0.7, ""),
    ("sora", "OpenAI Sora", "full_synthesis", "diffusion", "2024", 0.9, "DIFFUSION", 0.4, "Video generation; temporal coherence is high but rPPG absent"),
)

# Engine weights per resolution tier.
ENGINES = ("primary_model", "Biometric rPPG", "Neural Fingerprint", "Semantic Logic", "A/V Sync-Lock")
TIER_WEIGHTS = {
    "ultra_low": (0.30, 0.05, 0.35, 0.20, 0.10),
    "low": (0.30, 0.10, 0.30, 0.20, 0.10),
    "medium": (0.30, 0.20, 0.20, 0.18, 0.12),
    "high": (0.25, 0.30, 0.18, 0.15, 0.12),
    "ultra_hd": (0.25, 0.30, 0.18, 0.15, 0.12),
}


def threats(spark: SparkSession) -> DataFrame:
    """The threat catalogue as a ten-row table."""
    return spark.createDataFrame(
        list(THREATS),
        "threat string, name string, category string, family string, first_seen string, "
        "biosignal_impact double, artifact_pattern string, alignment_impact double, notes string",
    )


def threat_weights(items: DataFrame, catalogue: DataFrame, threat: str = "threat") -> DataFrame:
    """Attach the recommended core weights; NULL for unknown threats."""
    art = F.when(F.col("artifact_pattern") != "NONE", 0.5).otherwise(0.1)
    total = F.col("biosignal_impact") + art + F.col("alignment_impact")
    wts = catalogue.select(
        F.col("threat").alias(threat),
        (F.col("biosignal_impact") / total).alias("w_biosignal"),
        (art / total).alias("w_artifact"),
        (F.col("alignment_impact") / total).alias("w_alignment"),
    )
    # Ten rows, fixed.
    return items.join(F.broadcast(wts), threat, "left")


def tier_weights(spark: SparkSession) -> DataFrame:
    rows = [(t, dict(zip(ENGINES, ws))) for t, ws in TIER_WEIGHTS.items()]
    return spark.createDataFrame(rows, "tier string, weights map<string,double>")


def fan_out(events: DataFrame, subs: DataFrame, event: str = "event") -> DataFrame:
    """One row per event and subscription that lists it."""
    flat = subs.select("url", F.explode("events").alias(event)).distinct()
    return events.join(flat, event)


def valid_weights(df: DataFrame) -> DataFrame:
    """Check weight rows and fall back to the base weights."""
    vals = [F.coalesce(F.col(k), F.lit(BASE_WEIGHTS[k])) for k in CORES]
    total = vals[0] + vals[1] + vals[2]
    ok = (vals[0] >= 0) & (vals[1] >= 0) & (vals[2] >= 0) & total.between(0.99, 1.01)
    d = df.withColumns({f"_v_{k}": v for k, v in zip(CORES, vals)} | {"is_valid": ok})
    out = {k: F.when(F.col("is_valid"), F.col(f"_v_{k}")).otherwise(BASE_WEIGHTS[k]) for k in CORES}
    return d.withColumns(out).drop(*[f"_v_{k}" for k in CORES])


def weights_as_of(scans: DataFrame, versions: DataFrame, ts: str, valid_from: str) -> DataFrame:
    """Weights in force at each scan: the last valid version at or before it.

    The running count of versions along time is the number of the version in
    force, so the as-of lookup becomes an equi-join on that number. Scans
    before the first version get the base weights.
    """
    good = valid_weights(versions).filter("is_valid").drop("is_valid")
    cell = F.unix_seconds(F.col("_ts"))
    numbered = prefix_sums(
        good.withColumn("_ts", F.col(valid_from)), [], cell, [F.col("_ts"), F.col("version")],
        {"_no": F.lit(1).cast("bigint")},
    ).select("_no", "version", *CORES)
    line = scans.withColumns({"_ts": F.col(ts), "_v": F.lit(0).cast("bigint")}).unionByName(
        good.select(F.col(valid_from).alias("_ts"), F.lit(1).cast("bigint").alias("_v")),
        allowMissingColumns=True,
    )
    placed = prefix_sums(line, [], cell, [F.col("_ts"), F.col("_v").desc()], {"_no": F.col("_v")})
    j = placed.filter("_v = 0").join(numbered, "_no", "left")
    return j.select(
        *scans.columns, "version", *[F.coalesce(F.col(k), F.lit(BASE_WEIGHTS[k])).alias(k) for k in CORES]
    )


def detect_changes(versions: DataFrame, name: str, seq: str, sha: str, chunk: int = CHUNK) -> DataFrame:
    """Versions whose content differs from the one before (dense ``seq``)."""
    cut, w = with_halo(versions, [name], seq, 1, 0, chunk)
    prev = F.lag(sha).over(w)
    flagged = own_rows(cut.withColumn("changed", prev.isNull() | (prev != F.col(sha))))
    return flagged


def detectors_for(registry: DataFrame, capability: str) -> DataFrame:
    """Enabled detectors that offer a capability."""
    return registry.filter(F.array_contains("capabilities", capability) & F.col("enabled"))


def authorised(requests: DataFrame, users: DataFrame, user: str, scope: str) -> DataFrame:
    """Requests whose user holds the scope or is an admin."""
    ok = users.filter(F.array_contains("scopes", scope) | F.array_contains("scopes", "admin"))
    return requests.join(ok.select(user), user, "left_semi")


# --- reports ------------------------------------------------------------------------

# Recommendation lines per verdict.
RECOMMENDATIONS = {
    "AUTHENTIC": (
        "No manipulation detected. Media appears genuine.",
        "Archive this report for audit trail purposes.",
    ),
    "MANIPULATED": (
        "Do NOT use this media for official purposes.",
        "Investigate the source of this media.",
        "Consider notifying relevant stakeholders.",
    ),
    "UNCERTAIN": (
        "Manual review recommended.",
        "Consider analyzing with higher quality source.",
    ),
    "INCONCLUSIVE": (
        "Results are inconclusive - additional analysis needed.",
        "Try with higher resolution video if available.",
    ),
}


def recommendations(df: DataFrame, keep: list[str]) -> DataFrame:
    """Numbered recommendation lines of each verdict row."""
    lines = {k: F.array(*[F.lit(x) for x in v]) for k, v in RECOMMENDATIONS.items()}
    lead = F.when(
        F.col("leading_core").isNotNull() & (F.col("leading_core") != ""),
        F.array(F.concat(F.lit("Primary detection by "), F.col("leading_core"), F.lit("."))),
    ).otherwise(F.array().cast("array<string>"))
    v = F.col("verdict")
    arr = (
        F.when(v == "AUTHENTIC", lines["AUTHENTIC"])
        .when(v == "MANIPULATED", F.concat(lines["MANIPULATED"], lead))
        .when(v == "UNCERTAIN", lines["UNCERTAIN"])
        .otherwise(lines["INCONCLUSIVE"])
    )
    return df.select(*keep, F.posexplode(arr).alias("line", "recommendation"))


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def with_report_defaults(df: DataFrame) -> DataFrame:
    """Fill a history row with what a report needs: confidence and weights."""
    cols = {f"w_{k}": F.lit(BASE_WEIGHTS[k]) for k in CORES if f"w_{k}" not in df.columns}
    if "confidence" not in df.columns:
        cols["confidence"] = F.lit(0.8)
    if "leading_core" not in df.columns:
        cols["leading_core"] = F.lit("N/A")
    return df.withColumns(cols) if cols else df


def report_rows(df: DataFrame, item: str) -> DataFrame:
    """Core table of a report: core, score, weight and status text."""
    d = with_report_defaults(df)
    entries = F.array(
        *[
            F.struct(F.lit(k.upper()).alias("core"), F.col(f"{k}_score").alias("score"), F.col(f"w_{k}").alias("weight"))
            for k in CORES
        ]
    )
    r = d.select(item, F.explode(entries).alias("_e")).select(item, "_e.core", "_e.score", "_e.weight")
    return r.withColumns(
        {
            "score_text": fmt("%.2f%%", F.col("score") * 100),
            "weight_text": fmt("%.1f%%", F.col("weight") * 100),
            "status": status_band("score"),
        }
    )


def report_metadata(df: DataFrame, item: str) -> DataFrame:
    """Metadata block of a report, with long hashes and names shortened."""
    return df.select(
        item,
        shorten(F.col("filename"), 50).alias("filename"),
        shorten(F.col("sha256_hash"), 32).alias("sha256"),
        "resolution",
        fmt("%.2f seconds", F.col("duration_seconds")).alias("duration"),
    )
