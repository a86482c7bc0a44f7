"""Query registration, and the shared pieces of the comparison SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WS = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}"

TEXT_MARKERS = (
    "it is important to note", "it''s worth noting", "in conclusion", "furthermore", "moreover",
    "additionally", "in this context", "it is essential", "plays a crucial role", "it should be noted",
    "on the other hand", "in terms of", "when it comes to",
)

HEIGHTS = "[360, 480, 720, 1080, 2160]"
CORE_AGG = ", ".join(
    f"coalesce(max(CASE WHEN core = '{k}' THEN score END), 0.5) AS {k}_score, "
    f"coalesce(max(CASE WHEN core = '{k}' THEN confidence END), 0.0) AS {k}_confidence, "
    f"coalesce(max(CASE WHEN core = '{k}' THEN notes END), '') AS {k}_notes"
    for k in ("biosignal", "artifact", "alignment")
)
BAND = "CASE WHEN {0} <= 0.30 THEN 'AUTHENTIC' WHEN {0} <= 0.50 THEN 'UNCERTAIN' WHEN {0} <= 0.65 THEN 'INCONCLUSIVE' ELSE 'MANIPULATED' END"

CTES = {
    "ranked": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events",
    "fs": "SELECT user_id AS item, idx, least(value / 100, 1.0) AS score FROM ranked",
    "opn": "SELECT user_id AS item, idx, value AS opening FROM ranked",
    "ew": "SELECT *, user_id * 100 + (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7) AS item FROM events",
    "cr": """SELECT item, core, least(avg(value) / 40, 1.0) AS score, least(count(*) / 5, 1.0) AS confidence,
        concat_ws(',', CASE WHEN max(value) > 60 THEN 'EXTREME_VALUE' END, CASE WHEN count(*) >= 4 THEN 'BURST' END) AS notes
        FROM (SELECT item, value, CASE event_type WHEN 'click' THEN 'biosignal' WHEN 'view' THEN 'artifact' WHEN 'purchase' THEN 'alignment' END AS core FROM ew)
        WHERE core IS NOT NULL GROUP BY item, core""",
    "wide": f"SELECT item, {CORE_AGG} FROM cr GROUP BY item",
    "media0": f"""SELECT item, {HEIGHTS}[item % 5 + 1] AS height, [0.0, 24.0, 30.0][item % 3 + 1]::DOUBLE AS fps,
        100 + count(*) * 10 AS frame_count FROM ew GROUP BY item""",
    "media": """SELECT item, (height * 16) // 9 AS width, height, CASE WHEN fps = 0 THEN 30.0 ELSE fps END AS fps, frame_count,
        CASE WHEN height <= 360 THEN 'ultra_low' WHEN height <= 480 THEN 'low' WHEN height <= 720 THEN 'medium' WHEN height <= 1080 THEN 'high' ELSE 'ultra_hd' END AS tier,
        height <= 480 AS is_low_res FROM media0""",
    "audio0": "SELECT item, avg(value) >= 2 AS has_audio, least(avg(value), 40.0) AS snr_db, count(*) >= 2 AS is_speech FROM ew WHERE event_type = 'error' GROUP BY item",
    "audio1": """SELECT *, CASE WHEN snr_db >= 20 THEN 'LOW' WHEN snr_db >= 10 THEN 'MEDIUM' WHEN snr_db >= 5 THEN 'HIGH' ELSE 'EXTREME' END AS lv,
        CASE WHEN snr_db >= 20 THEN 1.0 WHEN snr_db >= 10 THEN 0.7 WHEN snr_db >= 5 THEN 0.5 ELSE 0.3 END::DOUBLE AS wt FROM audio0""",
    "audio": """SELECT item, has_audio, snr_db, is_speech, CASE WHEN has_audio THEN lv ELSE 'NO_AUDIO' END AS noise_level,
        CASE WHEN NOT has_audio THEN 0.3::DOUBLE WHEN is_speech THEN wt ELSE greatest(wt * 0.8::DOUBLE, 0.3::DOUBLE) END AS av_weight FROM audio1""",
    "mods": "SELECT user_id AS item, event_type AS name, least(avg(value) / 40, 1.0) AS score, least(count(*) / 20, 1.0) AS confidence FROM events GROUP BY 1, 2",
    "vals": "SELECT vec_id, label::BIGINT AS label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "frm": "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings",
    "fv": "SELECT label AS item, t, pos, v FROM vals JOIN frm USING (vec_id)",
    "ff0": """SELECT l_suppkey AS item, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS day,
        avg(l_discount) * 3.01 AS grid_score, avg(l_tax) * 50 + 1 AS kurtosis, avg(l_quantity) / 10 AS noise_std,
        avg(l_extendedprice) / 100 AS blur_var, avg(l_discount) * 6.03 AS detail_ratio, max(l_tax) * 40 AS flow_dir_var,
        sum(l_quantity) / 20 AS flow_mag, avg(l_quantity) * 5 AS brightness, avg(l_tax) * 100 AS compression,
        avg(l_discount) * 9 AS changed, avg(l_extendedprice) / 300 AS gradient, min(l_quantity) - 1 AS min_val,
        max(l_quantity) * 5.2::DOUBLE AS max_val, avg(l_tax) * 12 AS high_freq_share FROM lineitem GROUP BY 1, 2""",
    "ff": """SELECT *, row_number() OVER (PARTITION BY item ORDER BY day) - 1 AS frame, brightness AS mean_val,
        720 + 360 * ((item % 2) * (day % 2)) AS height FROM ff0""",
    "sups": "SELECT item, count(*) AS n FROM ff GROUP BY item",
    "hist": f"""SELECT 's' || lpad(event_id::VARCHAR, 12, '0') AS session_id, event_type || '_' || event_id || '.mp4' AS filename,
        {BAND.format('least(value / 60, 1.0)')} AS verdict, round(100 * (1 - least(value / 60, 1.0)), 2) AS integrity_score,
        least(value / 60, 1.0) AS biosignal_score, least(value / 80, 1.0) AS artifact_score, least(value / 120, 1.0) AS alignment_score,
        ts AS timestamp, sha256(event_id::VARCHAR) AS sha256_hash, value AS duration_seconds, 'u' || user_id AS "user" FROM events""",
    # text
    "tok": r"SELECT doc_id, source, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w, text FROM documents",
    "wd": "SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM tok",
    "nw": "SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS joined FROM tok",
    "sn0": rf"SELECT doc_id, unnest(string_split_regex(text, '[.!?]+')) AS s FROM documents",
    "sn": rf"SELECT doc_id, regexp_replace(regexp_replace(s, '^[{WS}]+', ''), '[{WS}]+$', '') AS s FROM sn0",
    "sents": rf"SELECT doc_id, len(regexp_extract_all(s, '[^{WS}]+')) AS n, lower(regexp_extract(s, '^[^{WS}]+')) AS st FROM sn WHERE length(s) > 5",
    "ns": "SELECT doc_id, count(*) AS n_sents, stddev_pop(n) AS sd, avg(n) AS mean, count(DISTINCT st) AS starts FROM sents GROUP BY doc_id",
    "lenc": "SELECT doc_id, n, count(*) AS c FROM sents GROUP BY doc_id, n",
    "lent": "SELECT doc_id, -sum((c / t) * log2(c / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS t FROM lenc) GROUP BY doc_id",
    "big": "SELECT doc_id, joined, n_words FROM nw WHERE n_words >= 50",
    "chl": "SELECT doc_id, string_split(joined, '') AS cs FROM big",
    "chars": "SELECT doc_id, unnest(cs) AS ch, unnest(range(len(cs))) AS p FROM chl",
    "chent": "SELECT doc_id, -sum((c / t) * log2(c / t)) AS char_entropy FROM (SELECT doc_id, c, sum(c) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, ch, count(*) AS c FROM chars GROUP BY 1, 2)) GROUP BY doc_id",
    "bgr": "SELECT doc_id, cs[p] || cs[p + 1] AS bg FROM (SELECT doc_id, cs, unnest(range(1, len(cs))) AS p FROM chl)",
    "bgent": "SELECT doc_id, -sum((c / t) * log2(c / t)) AS bigram_entropy FROM (SELECT doc_id, c, sum(c) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, bg, count(*) AS c FROM bgr GROUP BY 1, 2)) GROUP BY doc_id",
    "voc": "SELECT doc_id, count(*) AS uniq, count(*) FILTER (c = 1) AS hapax FROM (SELECT doc_id, word, count(*) AS c FROM wd GROUP BY 1, 2) GROUP BY doc_id",
    "tri": "SELECT doc_id, coalesce(sum(c) FILTER (c >= 3), 0) / sum(c) AS ratio FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM tok)) GROUP BY 1, 2) GROUP BY doc_id",
    "mk": "SELECT doc_id, " + " + ".join(f"(contains(joined, '{m}'))::INT" for m in TEXT_MARKERS) + " AS markers FROM nw",
    "ts0": """SELECT tok.doc_id, source, lang, n_words, coalesce(n_sents, 0) AS n_sents, char_entropy, bigram_entropy,
        CASE WHEN coalesce(n_sents, 0) < 3 THEN 0.0 WHEN mean > 0 THEN sd / mean ELSE 0.0 END AS cv,
        uniq / n_words AS ttr, hapax / n_words AS hapax_ratio, uniq / sqrt(n_words) AS guiraud, uniq,
        ratio, markers, markers / greatest(coalesce(n_sents, 0), 1) AS density,
        CASE WHEN n_sents >= 3 THEN starts / n_sents END AS diversity,
        CASE WHEN n_sents >= 3 THEN h / log2(n_sents) END AS len_entropy
        FROM tok JOIN nw USING (doc_id) LEFT JOIN ns USING (doc_id) LEFT JOIN lent USING (doc_id) LEFT JOIN chent USING (doc_id)
        LEFT JOIN bgent USING (doc_id) LEFT JOIN voc USING (doc_id) LEFT JOIN tri USING (doc_id) LEFT JOIN mk USING (doc_id)""",
    "ts1": """SELECT *, n_words >= 50 AS ok,
        CASE WHEN char_entropy < 3.8 THEN 0.7 WHEN char_entropy < 4.2 THEN 0.4 ELSE 0.1 END AS s_p,
        CASE WHEN n_sents < 3 THEN 0.5 WHEN cv < 0.2 THEN 0.8 WHEN cv < 0.35 THEN 0.5 WHEN cv < 0.5 THEN 0.3 ELSE 0.1 END AS s_b,
        least(CASE WHEN ttr < 0.35 THEN 0.4 WHEN ttr < 0.45 THEN 0.2 ELSE 0.0 END + CASE WHEN hapax_ratio < 0.25 THEN 0.4 WHEN hapax_ratio < 0.35 THEN 0.2 ELSE 0.0 END, 1.0) AS s_v,
        least(CASE WHEN ratio > 0.1 THEN 0.4 WHEN ratio > 0.05 THEN 0.2 ELSE 0.0 END + CASE WHEN density > 0.3 THEN 0.5 WHEN density > 0.15 THEN 0.25 ELSE 0.0 END, 1.0) AS s_r,
        CASE WHEN n_sents < 3 THEN 0.5 ELSE least(CASE WHEN diversity < 0.4 THEN 0.4 WHEN diversity < 0.6 THEN 0.2 ELSE 0.0 END + CASE WHEN len_entropy < 0.5 THEN 0.4 WHEN len_entropy < 0.7 THEN 0.2 ELSE 0.0 END, 1.0) END AS s_s
        FROM ts0""",
    "ts": """SELECT *, CASE WHEN ok THEN s_b * 0.30 + s_v * 0.25 + s_r * 0.20 + s_s * 0.15 + s_p * 0.10 ELSE 0.5 END AS raw, round(raw, 4) AS score,
        round(CASE WHEN ok THEN 0.4 + least(n_words / 300, 1.0) * 0.5 ELSE 0.2 END::DOUBLE, 4) AS confidence FROM ts1""",
    "lab": """SELECT doc_id, source, lang, score AS s_full, confidence, n_words AS word_count,
        CASE WHEN ok THEN s_b ELSE 0.5 END::DOUBLE AS burstiness_score, CASE WHEN ok THEN s_v ELSE 0.5 END::DOUBLE AS vocabulary_score,
        CASE WHEN ok THEN s_p ELSE 0.5 END::DOUBLE AS perplexity_score, CASE WHEN ok THEN s_r ELSE 0.5 END::DOUBLE AS repetition_score,
        CASE WHEN ok THEN s_s ELSE 0.5 END::DOUBLE AS structure_score, 1 - quality AS y, toxic FROM ts JOIN labels USING (doc_id)""",
}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the shared tables it names, dependencies first."""
    ctes = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(sql: str, skip: str = "") -> None:
        words = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", sql))
        for name in ctes:
            if name in words and name != skip and name not in order:
                visit(ctes[name], name)
                order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ", ".join(f"{n} AS ({ctes[n]})" for n in order) + " " + body


def query(
    name: str, sql: str | None = None, doubles: str = "", digits: int = 8, extra: dict[str, str] | None = None
) -> Callable[[Query], Query]:
    """Register a query; both sides round their double columns alike.

    The tiny shift keeps decimal ties off the rounding edge, where the two
    engines may differ in the last digit.
    """
    shift = 0.017 * 10.0**-digits

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = fn(configure(spark), sf)
            cols = [
                (F.round(F.col(f.name) + shift, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                for f in df.schema.fields
            ]
            return df.select(*cols)

        QUERIES[name] = run
        if sql is not None:
            # Decimal literals become DOUBLE, the type the engine computes in.
            inner = re.sub(r"(?<![\w'\".])(\d+\.\d+)(?![\w.'\"])", r"\1e0", with_ctes(sql, extra))
            rounds = ", ".join(f"round({c}::DOUBLE + {shift:e}, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            ORACLES[name] = f"SELECT * REPLACE ({rounds}) FROM ({inner}) q" if rounds else inner
        return fn

    return add
