"""Text statistics against direct Python counts."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.functions import text as T
from provenir.plans.text_scan import admit_text, text_scan
from tests.conftest import rows

HUMAN = (
    "I never thought the old bridge would hold. Rain had been falling for days! Did anyone check the bolts? "
    "Marta said she did, though her notes were soaked and nobody could read them. So we walked. Slowly, one by one, "
    "counting the planks that creaked and the ones that did not, until the river was behind us and the lights of the "
    "café blinked through the fog. Coffee never tasted so good. Not even close, honestly."
)
MACHINE = "It is important to note that the system is good. " * 12
EMOJI = "naïve 𝐀𝐁 words ünïcode ² three " * 12


def entropy(items):
    n = len(items)
    return -sum(c / n * math.log2(c / n) for c in Counter(items).values())


@pytest.fixture(scope="module")
def scanned(spark):
    data = [(1, HUMAN), (2, MACHINE), (3, "Too short."), (4, ""), (5, EMOJI)]
    return {r["doc_id"]: r for r in rows(text_scan(spark.createDataFrame(data, "doc_id bigint, text string")), "doc_id")}


@pytest.mark.parametrize("key,text", [(1, HUMAN), (2, MACHINE), (5, EMOJI)])
def test_statistics(scanned, key, text):
    r = scanned[key]
    words = re.findall(r"\b\w+\b", text.lower())
    joined = " ".join(words)
    assert r["word_count"] == len(words)
    assert r["char_entropy"] == pytest.approx(entropy(joined))
    assert r["bigram_entropy"] == pytest.approx(entropy([joined[i : i + 2] for i in range(len(joined) - 1)]))
    freq = Counter(words)
    assert r["type_token_ratio"] == pytest.approx(len(freq) / len(words))
    assert r["hapax_ratio"] == pytest.approx(sum(c == 1 for c in freq.values()) / len(words))
    tri = Counter(zip(words, words[1:], words[2:]))
    assert r["trigram_repetition_ratio"] == pytest.approx(sum(c for c in tri.values() if c >= 3) / (len(words) - 2))
    sents = [s.strip() for s in re.split(r"[.!?]+", text) if len(s.strip()) > 5]
    assert r["sentence_count"] == len(sents)
    lens = [len(s.split()) for s in sents]
    if len(sents) >= 3:
        assert r["burstiness_cv"] == pytest.approx(np.std(lens) / np.mean(lens))


def test_short_text_is_undecided(scanned):
    for k in (3, 4):
        r = scanned[k]
        assert (r["score"], r["confidence"], r["status"], r["anomalies"]) == (0.5, 0.2, "WARN", ["INSUFFICIENT_TEXT"])


def test_generated_text_scores_higher(scanned):
    assert scanned[2]["score"] > scanned[1]["score"]
    assert scanned[2]["markers_found"] >= 1
    assert 0.0 <= scanned[1]["score"] <= 1.0


def test_marker_with_apostrophe_never_matches(spark):
    df = spark.createDataFrame([("it's worth noting that furthermore we agree",)], "text string")
    j = T.joined_words(T.word_tokens("text"))
    assert df.select(T.marker_count(j).alias("n")).first()["n"] == 1


def test_run_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],)], "a array<string>")
    got = [sorted(r[0]) for r in df.select(T.run_counts(F.col("a"))).collect()]
    assert got == [[1, 1, 3], []]


def test_admission_limits(spark):
    df = spark.createDataFrame([("x" * n,) for n in (49, 50, 50_000, 50_001)], "text string")
    assert sorted(len(r["text"]) for r in admit_text(df).collect()) == [50, 50_000]


def test_bigram_memory_follows_length():
    """20,000 distinct characters: pair counts must not take the square of the alphabet."""
    import tracemalloc

    import pandas as pd

    from provenir.functions.text import _entropies

    text = "".join(chr(0x4E00 + k) for k in range(20_000))
    tracemalloc.start()
    out = _entropies(pd.Series([text, "abab"]))
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
    assert abs(out.bigram_entropy[0] - math.log2(19_999)) < 1e-9 and abs(out.char_entropy[1] - 1) < 1e-12


def test_burstiness_on_a_threshold(spark):
    """The variation of these lengths is one half; two passes come out below it."""
    df = spark.createDataFrame([([6, 16, 11, 12, 4, 6, 18, 20, 10, 5],)], "n array<int>")
    assert df.select(T.burstiness_cv("n").alias("cv")).first().cv == 0.5


def test_word_counts_shuffle_no_words(spark):
    rows = [(1, "One two, two"), (2, "..."), (3, None), (4, "a b"), (4, "b c"), (4, ""), (None, "x"), (None, "x y")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    from provenir.catalog.text import word_counts

    got = word_counts(d)
    assert {tuple(r) for r in got.collect()} == {(1, 3, 2, 9), (4, 4, 3, 4), (None, 3, 2, 3)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "LeftSemi" in plan.split("Generate explode")[1]
