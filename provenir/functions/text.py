"""Row-local text statistics.

A document is one row, so every statistic is a Column over that row: no row
per token is ever shuffled. Frequencies come from run lengths in the sorted
token array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import array_mean, clip, col, let, running_std, safe_div

# Word and white-space character classes.
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\t\n\x0b\f\r \x1c-\x1f\x85\p{Z}]"
NON_SPACE = r"[^\t\n\x0b\f\r \x1c-\x1f\x85\p{Z}]"

MIN_WORDS = 50
MIN_SENTENCES = 3

# Transition phrases counted by marker_count.
MARKERS = (
    "it is important to note",
    "it's worth noting",
    "in conclusion",
    "furthermore",
    "moreover",
    "additionally",
    "in this context",
    "it is essential",
    "plays a crucial role",
    "it should be noted",
    "on the other hand",
    "in terms of",
    "when it comes to",
)

# Weight of each sub-score in the text score.
TEXT_WEIGHTS = {
    "burstiness": 0.30,
    "vocabulary": 0.25,
    "repetition": 0.20,
    "structure": 0.15,
    "perplexity": 0.10,
}


def word_tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))


def sentences(text: str | Column) -> Column:
    parts = F.split(col(text), "[.!?]+")
    strip = f"^{SPACE}+|{SPACE}+$"
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, strip, "")), lambda s: F.length(s) > 5)


def sentence_lengths(sents: str | Column) -> Column:
    return F.transform(col(sents), lambda s: F.regexp_count(s, F.lit(f"{NON_SPACE}+")))


def sentence_starts(sents: str | Column) -> Column:
    return F.transform(col(sents), lambda s: F.lower(F.regexp_extract(s, f"^{NON_SPACE}+", 0)))


def run_counts(tokens: Column) -> Column:
    """ARRAY<INT>: how often each distinct token occurs."""

    def starts(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.array_size(s) - 1)
        return F.filter(at, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def widths(s: Column) -> Column:
        return let(
            starts(s),
            lambda b: F.transform(b, lambda x, j: F.coalesce(F.get(b, j + 1), F.array_size(s)) - x),
        )

    none = F.array().cast("array<int>")
    return let(
        F.sort_array(tokens), lambda s: F.when(F.array_size(s) > 0, widths(s)).otherwise(none)
    )


def entropy_bits(counts: Column, total: Column) -> Column:
    """Shannon entropy in bits of a count array with the given total."""

    def plogp(t: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, c: a + (c / t) * F.log2(c / t))

    return -let(total, plogp)


def joined_words(words: str | Column) -> Column:
    return F.array_join(col(words), " ")


def _entropy_of(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def entropy_profile(joined: str | Column) -> Column:
    """STRUCT(char_entropy, bigram_entropy) in bits of a text.

    Run lengths of a sorted array cost about 1 us per character here; two
    bincount passes over an Arrow batch cost a fiftieth of that.
    """
    udf = F.pandas_udf(_entropies, "char_entropy double, bigram_entropy double")
    return udf(col(joined))


def _entropies(joined: pd.Series) -> pd.DataFrame:
    out = np.full((len(joined), 2), np.nan)
    for row, s in enumerate(joined):
        if not s:
            continue
        codes = np.frombuffer(s.encode("utf-32-le"), dtype="<u4")
        counts = np.bincount(codes)
        out[row, 0] = _entropy_of(counts)
        rank = np.cumsum(counts > 0) - 1
        dense, k = rank[codes], int(rank[-1]) + 1
        code = dense[:-1] * k + dense[1:]
        # counters for all pairs only while they are fewer than a few for each character
        pairs = np.bincount(code) if k * k <= 4 * len(codes) + 4096 else np.unique(code, return_counts=True)[1]
        out[row, 1] = _entropy_of(pairs) if len(codes) > 1 else 0.0
    return pd.DataFrame(out, columns=["char_entropy", "bigram_entropy"])


def perplexity_score(entropy: str | Column) -> Column:
    e = col(entropy)
    return F.when(e < 3.8, 0.7).when(e < 4.2, 0.4).otherwise(0.1)


def burstiness_cv(lengths: str | Column) -> Column:

    def spread(n: Column) -> Column:
        return F.when(F.array_size(n) < MIN_SENTENCES, 0.0).otherwise(
            safe_div(running_std(n), array_mean(n))
        )

    return let(F.transform(col(lengths), lambda x: x.cast("double")), spread)


def burstiness_score(cv: str | Column, n_sentences: Column) -> Column:
    c = col(cv)
    return (
        F.when(n_sentences < MIN_SENTENCES, 0.5)
        .when(c < 0.2, 0.8)
        .when(c < 0.35, 0.5)
        .when(c < 0.5, 0.3)
        .otherwise(0.1)
    )


def vocabulary(words: str | Column) -> Column:
    """STRUCT(unique_words, hapax_words) of a token array."""

    def stats(n: Column) -> Column:
        return F.struct(
            F.array_size(n).alias("unique_words"),
            F.array_size(F.filter(n, lambda c: c == 1)).alias("hapax_words"),
        )

    return let(run_counts(col(words)), stats)


def vocabulary_score(ttr: Column, hapax: Column) -> Column:
    a = F.when(ttr < 0.35, 0.4).when(ttr < 0.45, 0.2).otherwise(0.0)
    b = F.when(hapax < 0.25, 0.4).when(hapax < 0.35, 0.2).otherwise(0.0)
    return F.least(a + b, F.lit(1.0))


def trigram_repetition(words: str | Column) -> Column:
    """Share of trigrams that occur three times or more."""

    def share(w: Column) -> Column:
        n = F.greatest(F.array_size(w) - 2, F.lit(0))
        grams = F.transform(
            F.slice(w, F.lit(1), n),
            lambda a, i: F.concat_ws(" ", a, F.get(w, i + 1), F.get(w, i + 2)),
        )
        repeated = F.aggregate(
            F.filter(run_counts(grams), lambda c: c >= 3), F.lit(0), lambda a, c: a + c
        )
        return repeated / F.greatest(n, F.lit(1))

    return let(col(words), share)


def marker_count(joined: str | Column) -> Column:
    """Distinct marker phrases found as substrings of the joined words."""

    def hits(j: Column) -> Column:
        found = [F.when(F.contains(j, F.lit(m)), 1).otherwise(0) for m in MARKERS]
        return sum(found[1:], found[0])

    return let(col(joined), hits)


def repetition_score(ratio: Column, density: Column) -> Column:
    a = F.when(ratio > 0.1, 0.4).when(ratio > 0.05, 0.2).otherwise(0.0)
    b = F.when(density > 0.3, 0.5).when(density > 0.15, 0.25).otherwise(0.0)
    return F.least(a + b, F.lit(1.0))


def start_diversity(starts: str | Column) -> Column:
    return let(col(starts), lambda s: safe_div(F.array_size(F.array_distinct(s)), F.array_size(s)))


def length_entropy(lengths: str | Column) -> Column:
    """Entropy of sentence lengths over its maximum, log2 of their number."""

    def share(n: Column) -> Column:
        top = F.when(F.array_size(n) > 1, F.log2(F.array_size(n))).otherwise(1.0)
        return entropy_bits(run_counts(n), F.array_size(n)) / top

    return let(col(lengths), share)


def structure_score(diversity: Column, norm_entropy: Column, n_sentences: Column) -> Column:
    a = F.when(diversity < 0.4, 0.4).when(diversity < 0.6, 0.2).otherwise(0.0)
    b = F.when(norm_entropy < 0.5, 0.4).when(norm_entropy < 0.7, 0.2).otherwise(0.0)
    return F.when(n_sentences < MIN_SENTENCES, 0.5).otherwise(F.least(a + b, F.lit(1.0)))


def text_score(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in TEXT_WEIGHTS.items():
        total = total + parts[name] * weight
    return clip(total)
