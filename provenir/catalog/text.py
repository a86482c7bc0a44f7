"""Text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.bands import text_verdict
from ..plans.bindings import spread, table
from ..plans.text_scan import admit_text, text_metrics, text_scan, text_scores
from ..session import materialize
from .base import query


ENOUGH = f"word_count >= {T.MIN_WORDS}"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return text_metrics(docs(spark, sf))


def word_counts(d: DataFrame) -> DataFrame:
    """Words, distinct words and characters of each doc_id: row by row; only rows that share a doc_id are brought together."""
    ids = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id"))
    ids = materialize(ids, "shared-ids")  # its size is then known: few ids are broadcast, and no text is shuffled
    shared = F.col("doc_id").eqNullSafe(F.col("_id"))
    single = d.join(ids, shared, "left_anti").select("doc_id", T.word_tokens("text").alias("w")).filter("array_size(w) > 0").select(
        "doc_id", F.array_size("w").cast("bigint").alias("n_words"), F.array_size(F.array_distinct("w")).cast("bigint").alias("distinct_words"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("chars"),
    )
    words = d.join(ids, shared, "left_semi").select("doc_id", F.explode(T.word_tokens("text")).alias("w"))
    several = words.groupBy("doc_id").agg(F.count("w").alias("n_words"), F.countDistinct("w").alias("distinct_words"), F.sum(F.length("w")).alias("chars"))
    return single.unionByName(several)


@query("word_tokens", "SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS distinct_words, sum(length(word))::BIGINT AS chars FROM wd GROUP BY doc_id")
def _(spark, sf):
    return word_counts(docs(spark, sf))


@query("sentences", "SELECT doc_id, count(*) AS n_sentences, sum(n)::BIGINT AS n_words FROM sents GROUP BY doc_id")
def _(spark, sf):
    t = docs(spark, sf).select("doc_id", T.sentence_lengths(T.sentences("text")).alias("l"))
    return t.filter("array_size(l) > 0").select(
        "doc_id", F.array_size("l").cast("bigint").alias("n_sentences"),
        F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_words"),
    )


@query("char_entropy", "SELECT doc_id, char_entropy FROM chent", "char_entropy")
def _(spark, sf):
    return metrics(spark, sf).filter(ENOUGH).select("doc_id", "char_entropy")


@query("bigram_entropy", "SELECT doc_id, bigram_entropy FROM bgent", "bigram_entropy")
def _(spark, sf):
    return metrics(spark, sf).filter(ENOUGH).select("doc_id", "bigram_entropy")


@query("perplexity_score", "SELECT s_p AS perplexity_score, count(*) AS docs FROM ts1 WHERE ok GROUP BY 1", "perplexity_score")
def _(spark, sf):
    s = text_scores(metrics(spark, sf)).filter(ENOUGH)
    return s.groupBy("perplexity_score").agg(F.count(F.lit(1)).alias("docs"))


@query("burstiness", "SELECT doc_id, cv AS burstiness_cv, s_b AS burstiness_score FROM ts1 WHERE ok", "burstiness_cv burstiness_score")
def _(spark, sf):
    s = text_scores(metrics(spark, sf)).filter(ENOUGH)
    return s.select("doc_id", "burstiness_cv", "burstiness_score")


@query(
    "vocabulary",
    "SELECT doc_id, uniq::BIGINT AS unique_words, ttr AS type_token_ratio, hapax_ratio, guiraud AS guiraud_index, s_v AS vocabulary_score FROM ts1 WHERE ok",
    "type_token_ratio hapax_ratio guiraud_index vocabulary_score",
)
def _(spark, sf):
    s = text_scores(metrics(spark, sf)).filter(ENOUGH)
    return s.select(
        "doc_id", F.col("unique_words").cast("bigint").alias("unique_words"), "type_token_ratio", "hapax_ratio", "guiraud_index", "vocabulary_score"
    )


@query("trigram_repetition", "SELECT doc_id, ratio AS trigram_repetition_ratio FROM ts1 WHERE ok", "trigram_repetition_ratio")
def _(spark, sf):
    return metrics(spark, sf).filter(ENOUGH).select("doc_id", "trigram_repetition_ratio")


@query("marker_density", "SELECT doc_id, markers::BIGINT AS markers_found, density AS marker_density, s_r AS repetition_score FROM ts1 WHERE ok", "marker_density repetition_score")
def _(spark, sf):
    s = text_scores(metrics(spark, sf)).filter(ENOUGH)
    return s.select("doc_id", F.col("markers_found").cast("bigint").alias("markers_found"), "marker_density", "repetition_score")


@query(
    "sentence_structure",
    "SELECT doc_id, diversity AS start_diversity, len_entropy AS length_entropy, s_s AS structure_score FROM ts1 WHERE ok",
    "start_diversity length_entropy structure_score",
)
def _(spark, sf):
    s = text_scores(metrics(spark, sf)).filter(ENOUGH)
    return s.select(
        "doc_id", F.col("sentence_start_diversity").alias("start_diversity"), F.col("sentence_length_entropy").alias("length_entropy"), "structure_score"
    )


SCAN_SQL = """SELECT {id}, n_words::BIGINT AS word_count, n_sents::BIGINT AS sentence_count, score, confidence,
    CASE WHEN NOT ok THEN 'WARN' WHEN raw > 0.65 THEN 'FAIL' WHEN raw > 0.35 THEN 'WARN' ELSE 'PASS' END AS status,
    CASE WHEN NOT ok THEN 'INSUFFICIENT_TEXT' ELSE concat_ws(',', CASE WHEN s_b > 0.6 THEN 'LOW_BURSTINESS_DETECTED' END,
    CASE WHEN s_v > 0.6 THEN 'UNIFORM_VOCABULARY' END, CASE WHEN s_r > 0.6 THEN 'HIGH_NGRAM_REPETITION' END,
    CASE WHEN s_s > 0.6 THEN 'UNIFORM_SENTENCE_LENGTH' END) END AS anomalies,
    CASE WHEN ok THEN 'GOOD' ELSE 'INSUFFICIENT' END AS data_quality,
    CASE WHEN score > 0.65 THEN 'AI_GENERATED' WHEN score > 0.35 THEN 'UNCERTAIN' ELSE 'HUMAN_WRITTEN' END AS verdict FROM ts"""


def scan_view(r: DataFrame, *ids: str) -> DataFrame:
    return r.select(
        *ids, F.col("word_count").cast("bigint").alias("word_count"), F.col("sentence_count").cast("bigint").alias("sentence_count"),
        "score", "confidence", "status", F.concat_ws(",", "anomalies").alias("anomalies"), "data_quality", "verdict",
    )


@query("text_scan", SCAN_SQL.format(id="doc_id"), "score confidence")
def _(spark, sf):
    return scan_view(text_scan(docs(spark, sf)), "doc_id")


@query("text_scan_by_source", """SELECT source, lang, count(*) AS docs, avg(score) AS avg_score, count(*) FILTER (score > 0.35) AS suspicious
    FROM ts GROUP BY source, lang""", "avg_score")
def _(spark, sf):
    r = text_scan(docs(spark, sf))
    return r.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("docs"), F.avg("score").alias("avg_score"),
        F.sum((F.col("score") > 0.35).cast("bigint")).alias("suspicious"),
    )


#: Turns of conversations in place of documents.
TURN = "conv_id || ':' || turn"
TURNS = {
    "tok": rf"SELECT {TURN} AS doc_id, conv_id AS source, turn AS lang, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w, text FROM conversations",
    "sn0": rf"SELECT {TURN} AS doc_id, unnest(string_split_regex(text, '[.!?]+')) AS s FROM conversations",
}


@query("text_scan_conversations", SCAN_SQL.format(id="source AS conv_id, lang AS turn"), "score confidence", extra=TURNS)
def _(spark, sf):
    c = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return scan_view(text_scan(c, "conv_id"), "conv_id", "turn")


@query("text_verdict", """SELECT CASE WHEN score > 0.65 THEN 'AI_GENERATED' WHEN score > 0.35 THEN 'UNCERTAIN' ELSE 'HUMAN_WRITTEN' END AS verdict,
    count(*) AS docs, avg(confidence) AS avg_confidence FROM ts GROUP BY 1""", "avg_confidence")
def _(spark, sf):
    r = text_scan(docs(spark, sf))
    return r.groupBy(text_verdict("score").alias("verdict")).agg(F.count(F.lit(1)).alias("docs"), F.avg("confidence").alias("avg_confidence"))


@query("admit_text", "SELECT lang, count(*) AS admitted, sum(length(text))::BIGINT AS chars FROM documents WHERE length(text) BETWEEN 50 AND 50000 GROUP BY lang")
def _(spark, sf):
    a = admit_text(docs(spark, sf))
    return a.groupBy("lang").agg(F.count(F.lit(1)).alias("admitted"), F.sum(F.length("text")).alias("chars"))
