"""The text detector: one narrow projection from a text column to a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.bands import TEXT_BANDS, status_band, text_verdict
from ..functions.exprs import flags, round4, safe_div


def admit_text(df: DataFrame, text: str = "text", low: int = 50, high: int = 50_000) -> DataFrame:
    """Texts within the accepted length in characters."""
    return df.filter(F.length(text).between(low, high))


def text_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the raw statistics of every document that has enough words.

    Documents below the word minimum keep NULL statistics; their character
    streams are never expanded.
    """
    tokens = df.withColumns({"_words": T.word_tokens(text), "_sents": T.sentences(text)})
    arrays = tokens.withColumns(
        {
            "word_count": F.array_size("_words"),
            "sentence_count": F.array_size("_sents"),
            "_joined": F.when(F.array_size("_words") >= T.MIN_WORDS, T.joined_words("_words")),
            "_lengths": T.sentence_lengths("_sents"),
            "_starts": T.sentence_starts("_sents"),
        }
    )
    enough = F.col("word_count") >= T.MIN_WORDS
    many = enough & (F.col("sentence_count") >= T.MIN_SENTENCES)

    def when(cond: Column, value: Column) -> Column:
        return F.when(cond, value)

    raw = arrays.withColumns(
        {
            "_ent": T.entropy_profile("_joined"),
            "burstiness_cv": when(enough, T.burstiness_cv("_lengths")),
            "_vocab": when(enough, T.vocabulary("_words")),
            "trigram_repetition_ratio": when(enough, T.trigram_repetition("_words")),
            "markers_found": when(enough, T.marker_count("_joined")),
            "sentence_start_diversity": when(many, T.start_diversity("_starts")),
            "sentence_length_entropy": when(many, T.length_entropy("_lengths")),
        }
    )
    n = F.col("word_count")
    return raw.withColumns(
        {
            "char_entropy": when(enough, F.col("_ent.char_entropy")),
            "bigram_entropy": when(enough, F.col("_ent.bigram_entropy")),
            "unique_words": F.col("_vocab.unique_words"),
            "type_token_ratio": when(enough, F.col("_vocab.unique_words") / n),
            "hapax_ratio": when(enough, F.col("_vocab.hapax_words") / n),
            "guiraud_index": when(enough, F.col("_vocab.unique_words") / F.sqrt(n)),
            "marker_density": when(
                enough, F.col("markers_found") / F.greatest(F.col("sentence_count"), F.lit(1))
            ),
        }
    ).drop("_words", "_sents", "_joined", "_lengths", "_starts", "_vocab", "_ent")


def text_scores(metrics: DataFrame) -> DataFrame:
    """Add the five sub-scores; NULL below the word minimum."""
    enough = F.col("word_count") >= T.MIN_WORDS
    ns = F.col("sentence_count")
    scores = {
        "perplexity_score": T.perplexity_score("char_entropy"),
        "burstiness_score": T.burstiness_score("burstiness_cv", ns),
        "vocabulary_score": T.vocabulary_score(F.col("type_token_ratio"), F.col("hapax_ratio")),
        "repetition_score": T.repetition_score(
            F.col("trigram_repetition_ratio"), F.col("marker_density")
        ),
        "structure_score": T.structure_score(
            F.col("sentence_start_diversity"), F.col("sentence_length_entropy"), ns
        ),
    }
    return metrics.withColumns({k: F.when(enough, v) for k, v in scores.items()})


def text_scan(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every text. One row in, one row out, no shuffle."""
    s = text_scores(text_metrics(df, text))
    enough = F.col("word_count") >= T.MIN_WORDS
    overall = T.text_score({k: F.col(f"{k}_score") for k in T.TEXT_WEIGHTS})
    confidence = 0.4 + F.least(F.col("word_count") / 300, F.lit(1.0)) * 0.5
    scored = s.withColumn("_raw", F.when(enough, overall).otherwise(0.5))
    high = flags(
        (F.col("burstiness_score") > 0.6, "LOW_BURSTINESS_DETECTED"),
        (F.col("vocabulary_score") > 0.6, "UNIFORM_VOCABULARY"),
        (F.col("repetition_score") > 0.6, "HIGH_NGRAM_REPETITION"),
        (F.col("structure_score") > 0.6, "UNIFORM_SENTENCE_LENGTH"),
    )
    out = scored.withColumns(
        {
            "score": round4(F.col("_raw")),
            "confidence": round4(F.when(enough, confidence).otherwise(0.2)),
            "status": F.when(enough, status_band("_raw", *TEXT_BANDS)).otherwise("WARN"),
            "anomalies": F.when(enough, high).otherwise(F.array(F.lit("INSUFFICIENT_TEXT"))),
            "data_quality": F.when(enough, "GOOD").otherwise("INSUFFICIENT"),
        }
    )
    keep = [c for c in df.columns if c != text]
    added = [c for c in out.columns if c not in df.columns and c != "_raw"]
    return out.select(*keep, *added).withColumn("verdict", text_verdict("score"))
