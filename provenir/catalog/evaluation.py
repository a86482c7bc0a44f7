"""Calibration and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import evaluation as E
from ..operators.ordered import log_cell
from ..plans import bindings as D
from ..session import materialize
from .base import query


def scored(spark, sf):
    """Labelled text scores, stored once: every curve reads them repeatedly."""
    return materialize(D.labelled_scores(spark, sf), "labelled-scores")


# Frame scores with a label that depends on the event type: many distinct scores.
FX = {
    "fx": "SELECT event_type AS ds, least(value / 500, 1.0) AS s, (value > 20)::INT AS y FROM events",
    "fy": "SELECT event_type AS ds, round(least(value / 500, 1.0), 4) AS s, (value + user_id > 90)::INT AS y FROM events",
    "fe": "SELECT event_type AS ds, least(value / 500, 1.0) AS s, (value + user_id > 90)::INT AS y FROM events",
    "hx": "SELECT ds, s, sum(y) AS p, sum(1 - y) AS n FROM fy GROUP BY 1, 2",
    "cx": "SELECT *, sum(p) OVER (PARTITION BY ds ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY ds ORDER BY s DESC) AS fp, sum(p) OVER (PARTITION BY ds) AS pp, sum(n) OVER (PARTITION BY ds) AS nn, lead(p) OVER (PARTITION BY ds ORDER BY s DESC) AS lp, lead(n) OVER (PARTITION BY ds ORDER BY s DESC) AS ln_, row_number() OVER (PARTITION BY ds ORDER BY s DESC) AS place, count(*) OVER (PARTITION BY ds) AS pts FROM hx",
    "rocx": "SELECT ds, place, s AS threshold, fp / nn AS fpr, tp / pp AS tpr FROM cx WHERE place = 1 OR place = pts OR pts <= 2 OR lp <> p OR ln_ <> n UNION ALL SELECT DISTINCT ds, 0, NULL, 0.0, 0.0 FROM fy",
    "aucx": "SELECT ds, sum(n * (tp - p / 2)) / max(pp * nn) AS auc_roc, sum(p * tp / (tp + fp)) / max(pp) AS auc_pr FROM cx GROUP BY ds",
    "clx": "SELECT ds, count(*) AS samples, sum((s >= 0.5 AND y = 1)::INT)::BIGINT AS tp, sum((s >= 0.5 AND y = 0)::INT)::BIGINT AS fp, sum((s < 0.5 AND y = 1)::INT)::BIGINT AS fn, sum((s < 0.5 AND y = 0)::INT)::BIGINT AS tn FROM fy GROUP BY ds",
}


def dataset(spark, sf):
    e = D.events(spark, sf)
    return e.select(
        F.col("event_type").alias("ds"), F.round(F.least(F.col("value") / 500, F.lit(1.0)), 4).alias("s"),
        (F.col("value") + F.col("user_id") > 90).cast("int").alias("y"),
    )


def unrounded(spark, sf):
    """As ``dataset``, with the scores as they are: calibration is fitted on these."""
    e = D.events(spark, sf)
    return e.select(F.col("event_type").alias("ds"), F.least(F.col("value") / 500, F.lit(1.0)).alias("s"), (F.col("value") + F.col("user_id") > 90).cast("int").alias("y"))


@query("labelled", "SELECT doc_id, y, toxic, s_full FROM lab", "s_full")
def _(spark, sf):
    from ..plans.text_scan import text_scan

    known = D.table(spark, sf, "documents").join(D.table(spark, sf, "labels"), "doc_id", "left_semi")
    t = text_scan(D.spread(known.select("doc_id", "text"))).select("doc_id", F.col("score").alias("s_full"))
    lab = D.table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("y"), "toxic")
    return E.labelled(t, lab, "doc_id").select("doc_id", "y", "toxic", "s_full")


@query("classification_metrics", "SELECT ds, samples, tp, fp, fn, tn, (tp + tn) / samples AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM clx", "accuracy precision recall f1", extra=FX)
def _(spark, sf):
    return E.classification_metrics(dataset(spark, sf), ["ds"], "y", "s")


TXT = {
    "lh": "SELECT s_full AS s, sum(y) AS p, sum(1 - y) AS n FROM lab GROUP BY 1",
    "lc": "SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM lh",
}


@query("auc_roc_text", "SELECT sum(n * (tp - p / 2)) / (max(tp) * max(fp)) AS auc_roc FROM lc", "auc_roc", extra=TXT)
def _(spark, sf):
    return E.auc_roc(scored(spark, sf), [], "y", "s_full")


@query("auc_roc", "SELECT ds, auc_roc FROM aucx", "auc_roc", extra=FX)
def _(spark, sf):
    return E.auc_roc(dataset(spark, sf), ["ds"], "y", "s")


@query("auc_pr", "SELECT ds, auc_pr FROM aucx", "auc_pr", extra=FX)
def _(spark, sf):
    return E.auc_pr(dataset(spark, sf), ["ds"], "y", "s")


@query("roc_points", "SELECT ds, place, threshold, fpr, tpr FROM rocx", "threshold fpr tpr", extra=FX)
def _(spark, sf):
    return E.roc_points(dataset(spark, sf), ["ds"], "y", "s")


@query("pr_points", "SELECT ds, s AS threshold, tp / (tp + fp) AS precision, tp / pp AS recall FROM cx UNION ALL SELECT DISTINCT ds, NULL, 1.0, 0.0 FROM fy", "threshold precision recall", extra=FX)
def _(spark, sf):
    return E.pr_points(dataset(spark, sf), ["ds"], "y", "s")


FPR = "SELECT ds, " + ", ".join(f"arg_min(fpr, (abs(tpr - {t}), place)) AS fpr_at_tpr_{n}" for t, n in ((0.9, 90), (0.95, 95), (0.99, 99))) + " FROM rocx GROUP BY ds"


@query("fpr_at_tpr", FPR, "fpr_at_tpr_90 fpr_at_tpr_95 fpr_at_tpr_99", extra=FX)
def _(spark, sf):
    return E.fpr_at_tpr(dataset(spark, sf), ["ds"], "y", "s")


@query("timing_stats", "SELECT avg(v) AS avg_time, quantile_cont(v, 0.5) AS median_time, quantile_cont(v, 0.95) AS p95_time FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 0 ELSE value - 50 END AS v FROM events)", "avg_time median_time p95_time", 6)
def _(spark, sf):
    # zeros and negatives have ranks as well
    v = F.when(F.col("event_id") % 5 == 0, F.lit(0.0)).otherwise(F.col("value") - 50)
    return E.timing_stats(D.events(spark, sf).withColumn("v", v), "v", log_cell(F.col("v")), 2)


CORE_COLS = {"burstiness": "burstiness_score", "vocabulary": "vocabulary_score", "perplexity": "perplexity_score"}
PC = {
    "pc0": " UNION ALL ".join(f"SELECT '{k}' AS core, {v} AS s, y FROM lab" for k, v in CORE_COLS.items()),
    "pc1": "SELECT core, s, sum(y) AS p, sum(1 - y) AS n FROM pc0 GROUP BY 1, 2",
    "pc2": "SELECT *, sum(p) OVER (PARTITION BY core ORDER BY s DESC) AS tp FROM pc1",
    "pc3": "SELECT core, sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS auc_roc FROM pc2 GROUP BY core",
    "pc4": "SELECT core, count(*) AS samples, avg(((s >= 0.5) = (y = 1))::INT) AS accuracy FROM pc0 GROUP BY core",
}


@query("per_core_metrics", "SELECT core, samples, accuracy, auc_roc FROM pc3 JOIN pc4 USING (core)", "accuracy auc_roc", extra=PC)
def _(spark, sf):
    return E.per_core_metrics(scored(spark, sf), "y", CORE_COLS)


AB_MIX = {
    "BIOSIGNAL only": "burstiness_score * 1.0", "ARTIFACT only": "vocabulary_score * 1.0", "ALIGNMENT only": "perplexity_score * 1.0",
    "BIO + ART": "burstiness_score * 0.5 + vocabulary_score * 0.5", "BIO + ALIGN": "burstiness_score * 0.5 + perplexity_score * 0.5",
    "ART + ALIGN": "vocabulary_score * 0.5 + perplexity_score * 0.5", "FULL FUSION": "s_full * 1.0",
}
AB = {
    "ab0": " UNION ALL ".join(f"SELECT '{k}' AS config, {v} AS s, y FROM lab" for k, v in AB_MIX.items()),
    "ab1": "SELECT config, s, sum(y) AS p, sum(1 - y) AS n FROM ab0 GROUP BY 1, 2",
    "ab2": "SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY config) AS pp, sum(n) OVER (PARTITION BY config) AS nn, lead(p) OVER w AS lp, lead(n) OVER w AS ln_, row_number() OVER w AS place, count(*) OVER (PARTITION BY config) AS pts FROM ab1 WINDOW w AS (PARTITION BY config ORDER BY s DESC)",
    "ab3": "SELECT config, place, fp / nn AS fpr, tp / pp AS tpr FROM ab2 WHERE place = 1 OR place = pts OR pts <= 2 OR lp <> p OR ln_ <> n UNION ALL SELECT DISTINCT config, 0, 0.0, 0.0 FROM ab0",
    "ab4": "SELECT config, arg_min(fpr, (abs(tpr - 0.95), place)) AS fpr_at_tpr_95 FROM ab3 GROUP BY config",
    "ab5": "SELECT config, sum(n * (tp - p / 2)) / max(pp * nn) AS auc_roc FROM ab2 GROUP BY config",
    "ab6": "SELECT config, avg(((s >= 0.5) = (y = 1))::INT) AS accuracy FROM ab0 GROUP BY config",
}


@query("ablation", "SELECT config, accuracy, auc_roc, fpr_at_tpr_95, CASE WHEN config = 'FULL FUSION' THEN auc_roc - (SELECT max(auc_roc) FROM ab5 WHERE config LIKE '%only') END AS fusion_delta FROM ab4 JOIN ab5 USING (config) JOIN ab6 USING (config)",
    "accuracy auc_roc fpr_at_tpr_95 fusion_delta", extra=AB)
def _(spark, sf):
    cols = {"biosignal": "burstiness_score", "artifact": "vocabulary_score", "alignment": "perplexity_score", "fusion": "s_full"}
    return E.ablation(scored(spark, sf), "y", cols)


@query("cross_dataset", f"SELECT ds, samples, tp, fp, fn, tn, (tp + tn) / samples AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, auc_roc, auc_pr, fpr_at_tpr_90, fpr_at_tpr_95, fpr_at_tpr_99 FROM clx JOIN aucx USING (ds) JOIN ({FPR}) USING (ds)",
    "accuracy precision recall f1 auc_roc auc_pr fpr_at_tpr_90 fpr_at_tpr_95 fpr_at_tpr_99", extra=FX)
def _(spark, sf):
    return E.cross_dataset(dataset(spark, sf), "ds", "y", "s")


@query("bce_eval", "SELECT count(*) AS samples, avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS loss, avg(((z > 0)::INT = y)::INT) AS accuracy FROM (SELECT value / 50 - 1 AS z, (user_id % 2)::INT AS y FROM events)", "loss accuracy")
def _(spark, sf):
    e = D.events(spark, sf).select((F.col("value") / 50 - 1).alias("z"), (F.col("user_id") % 2).cast("int").alias("y"))
    return E.bce_eval(e, "y", "z")


@query("robustness", "SELECT event_type AS setting, count(*) AS samples, avg(((value / 60 > 0.5)::INT = user_id % 2)::INT) AS accuracy FROM events GROUP BY 1", "accuracy")
def _(spark, sf):
    e = D.events(spark, sf).select(F.col("event_type").alias("setting"), (F.col("value") / 60).alias("p"), (F.col("user_id") % 2).cast("int").alias("y"))
    return E.robustness(e, "setting", "y", "p")


# --- calibration --------------------------------------------------------------------

CAL = {
    "ch0": "SELECT ds, s, count(*) AS n, sum(y) AS p FROM fe GROUP BY 1, 2",
    "ct": "SELECT unnest(range(1, 50)) / 10 AS temperature",
    "cp": "SELECT ds, temperature, n, p, 1.0 / (1.0 + exp(-ln(s / (1.0 - s + 1e-10) + 1e-10) / temperature)) AS q FROM ch0 CROSS JOIN ct",
    "cb": "SELECT ds, temperature, CASE WHEN q < 1 THEN floor(q * 10) END AS b, sum(n) AS n, sum(q * n) AS sp, sum(p) AS sy FROM cp GROUP BY 1, 2, 3",
    "ce": "SELECT ds, temperature, sum(CASE WHEN b IS NOT NULL THEN abs(sp - sy) ELSE 0.0 END) / sum(n) AS ece, sum(n)::BIGINT AS samples FROM cb GROUP BY 1, 2",
}


@query("ece", "SELECT ds, sum(CASE WHEN b IS NOT NULL THEN abs(sp - sy) ELSE 0.0 END) / sum(n) AS ece, sum(n)::BIGINT AS samples FROM (SELECT ds, CASE WHEN s < 1 THEN floor(s * 10) END AS b, sum(s) AS sp, sum(y) AS sy, count(*) AS n FROM fe GROUP BY 1, 2) GROUP BY ds", "ece", extra=FX)
def _(spark, sf):
    return C.ece(unrounded(spark, sf), ["ds"], "s", F.lit(1), F.col("y"))


@query("temperature_grid", "SELECT ds, temperature, ece, samples FROM ce", "temperature ece", extra={**FX, **CAL})
def _(spark, sf):
    return C.temperature_grid(unrounded(spark, sf), "ds", "s", "y")


@query("temperature_fit", "SELECT ds, arg_min(temperature, (round(ece, 12), temperature)) AS temperature, min(ece) AS ece FROM ce GROUP BY ds", "temperature ece", extra={**FX, **CAL})
def _(spark, sf):
    return C.temperature_fit(unrounded(spark, sf), "ds", "s", "y")


PLATT = """WITH RECURSIVE fyy AS (SELECT event_type AS ds, least(value / 500, 1.0) AS s, (value + user_id > 90)::INT AS y FROM events), hh AS MATERIALIZED (SELECT ds, s, sum(y) / count(*) AS r, count(*) / t AS w FROM (SELECT *, count(*) OVER (PARTITION BY ds) AS t FROM fyy) GROUP BY ds, s, t),
    g(ds, k, a, b) AS (SELECT DISTINCT ds, 0, -1.0::DOUBLE, 0.0::DOUBLE FROM hh UNION ALL SELECT ds, k + 1, a - 0.01 * sum(e * s * w), b - 0.01 * sum(e * w) FROM
    (SELECT g.ds, k, a, b, s, w, least(greatest(1 / (1 + exp(-(a * s + b))), 1e-7), 1 - 1e-7) - r AS e FROM g JOIN hh ON g.ds = hh.ds WHERE k < 1000) GROUP BY ds, k, a, b) SELECT ds, a, b FROM g WHERE k = 1000"""


@query("platt_fit", PLATT, "a b", 7)
def _(spark, sf):
    return C.platt_fit(unrounded(spark, sf), "ds", "s", "y")


FITTED = {
    **FX, **CAL, "pf": PLATT,
    "tf": "SELECT ds, arg_min(temperature, (round(ece, 12), temperature)) AS temperature FROM ce GROUP BY ds",
    "cq": """SELECT event_id, 1.0 / (1.0 + exp(-(a * value / 500 + b))) AS cs, 1.0 / (1.0 + exp(-ln(0.8 / (1.0 - 0.8 + 1e-10) + 1e-10) / temperature)) AS cc
        FROM events JOIN pf ON pf.ds = event_type JOIN tf ON tf.ds = event_type""",
}


@query("calibrate", "SELECT event_id, cs AS calibrated_score, cc AS calibrated_confidence, abs(cs - 0.5) * 2 * 0.5 + cc * 0.5 AS reliability, 'platt_scaling' AS method FROM cq",
    "calibrated_score calibrated_confidence reliability", 7, extra=FITTED)
def _(spark, sf):
    d = unrounded(spark, sf)
    params = C.platt_fit(d, "ds", "s", "y").join(C.temperature_fit(d, "ds", "s", "y").drop("ece"), "ds")
    r = C.calibrate(D.events(spark, sf).select("event_id", F.col("event_type").alias("ds"), (F.col("value") / 500).alias("s"), F.lit(0.8).alias("c")), params, "ds", "s", "c")
    return r.select("event_id", "calibrated_score", "calibrated_confidence", "reliability", "method")


@query("calibrate_given", """SELECT event_id, 1.0 / (1.0 + exp(-(a * s + b))) AS calibrated_score, abs(1.0 / (1.0 + exp(-(a * s + b))) - 0.5) * 2 * 0.5 + c2 * 0.5 AS reliability FROM (SELECT event_id, value / 500 AS s, avg(value) OVER w / 10 AS a, -count(*) OVER w / 1000 AS b,
    1.0 / (1.0 + exp(-ln(0.8 / (1.0 - 0.8 + 1e-10) + 1e-10) / 1.5)) AS c2 FROM events WINDOW w AS (PARTITION BY event_type))""", "calibrated_score reliability", 7)
def _(spark, sf):
    e = D.events(spark, sf).select("event_id", F.col("event_type").alias("ds"), "value", F.lit(0.8).alias("c"))
    params = e.groupBy("ds").agg((F.avg("value") / 10).alias("a"), (-F.count(F.lit(1)) / 1000).alias("b"), F.lit(1.5).alias("temperature"))
    r = C.calibrate(e.withColumn("s", F.col("value") / 500), params, "ds", "s", "c")
    return r.select("event_id", "calibrated_score", "reliability")
