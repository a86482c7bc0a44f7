"""Quality rules as a ledger of failure bits, with versioned policies applied later.

``ledger`` evaluates every rule once for each document and stores the
measurements and one bit for each rule that fails. A policy is a version and
the rules it enforces, so a change of policy is a mask over stored bits and
never a second look at the texts. ``ablation`` tells for each rule how many
documents fail it, and how many only this rule of the policy rejects, by
bitwise tests in one aggregation.

Everything is a DataFrame expression over the row; the ledger does not shuffle.

Odd rows: a null text counts as empty (all measures 0, so it fails
``too_few_words``); rows are judged one by one, so repeated rows get equal
verdicts; columns of the input other than the text are passed through by
``with_ledger`` unless they carry the name of a ledger column, which the
ledger replaces. An empty table gives an empty ledger; its ablation has zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import bind, table, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rule -> condition of failure, in the order of the bits.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
}
BASE = ("too_few_words", "repeated_windows")

#: Policy version -> rules it enforces.
POLICIES: dict[int, tuple[str, ...]] = {1: BASE, 2: (*BASE, "short_words", "long_words", "symbols", "duplicate_lines")}
CURRENT = 2


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def repeat_words(found: Column) -> Column:
    """Words that lie in a 3-word window occurring twice or more in the array, the first occurrence included.

    Windows are 64-bit hashes. Unless all differ, they are sorted with their
    positions; equal neighbours mark the repeated positions.
    """
    windows = F.transform(F.slice(found, 1, F.greatest(F.size(found) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(found, i + 1), F.get(found, i + 2)))

    def marked(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return bind(order, lambda s: bind(hits(s), covered))

    def hits(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))


def with_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failure_bits``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = bind(
        F.struct(words(F.col(text)).alias("w"), lines.alias("l"), F.size(F.regexp_extract_all(t, F.lit(r"[#*$%&|<>]"), F.lit(0))).alias("s")),
        lambda x: F.struct(
            F.size(x["w"]).cast("bigint").alias("n_words"),
            F.length(F.concat_ws("", x["w"])).cast("bigint").alias("word_chars"),
            x["s"].cast("bigint").alias("n_symbols"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("bigint").alias("n_dup_lines"),
            repeat_words(x["w"]).cast("bigint").alias("n_repeat_words"),
            F.size(x["l"]).cast("bigint").alias("n_lines"),
        ),
    )
    out = docs.withColumn("_ledger", made)
    out = out.withColumns({c: F.col("_ledger")[c] for c in (*MEASURES, "n_lines")}).drop("_ledger")
    bits = [F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("failure_bits", total.cast("bigint"))


def passes(version: int = CURRENT) -> Column:
    """Verdict of a policy over stored bits."""
    return F.col("failure_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def ablation(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """Rows (rule, n_failed, n_only, n_rejected): documents that fail the rule, that only it rejects, and all rejected ones."""
    held = mask(POLICIES[version])
    bits = F.col("failure_bits").bitwiseAND(F.lit(held))
    patterns = ledger.select(bits.alias("b")).groupBy("b").agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    aggs = [F.coalesce(F.sum(F.when(F.col("b") != 0, F.col("n"))), F.lit(0)).alias("r")]
    for r in POLICIES[version]:
        m = mask((r,))
        aggs += [F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(F.lit(m)) != 0, F.col("n"))), F.lit(0)).alias(f"f_{r}"), F.coalesce(F.sum(F.when(F.col("b") == m, F.col("n"))), F.lit(0)).alias(f"o_{r}")]
    one = patterns.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"), F.col("r").alias("n_rejected")) for r in POLICIES[version]])
    return one.select(F.inline(rows))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """Measures and failure bits of every document, written once and read back."""
    return materialize(with_ledger(docs.select("doc_id", "text")).select("doc_id", *MEASURES, "failure_bits"), "quality-ledger")


def quality_report(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """Measures and verdict of every document, from the stored ledger."""
    base = F.col("failure_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return stored_ledger(docs).select("doc_id", *MEASURES, base.alias("base_failed"), (passes(version) & ~base).alias("kept"), "failure_bits")


def ablations(docs: DataFrame) -> DataFrame:
    """The ablation of every policy version over one stored ledger: ``version`` and the columns of ``ablation``."""
    ledger = stored_ledger(docs)
    parts = [ablation(ledger, v).select(F.lit(v).alias("version"), "*") for v in POLICIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_good(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The documents a policy keeps, with their own columns."""
    names = docs.columns
    judged = with_ledger(docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text")), "_text")
    return judged.filter(passes(version)).select(*[F.col("_doc")[c].alias(c) for c in names])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 8 ELSE 0 END
      + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failure_bits FROM b
"""


@query("op2_quality_rules", SQL)
def op2(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"))


_FAILED = "(VALUES (1, 'too_few_words', 1, 3), (1, 'repeated_windows', 2, 3), (2, 'too_few_words', 1, 63), (2, 'repeated_windows', 2, 63), (2, 'short_words', 4, 63), (2, 'long_words', 8, 63), (2, 'symbols', 16, 63), (2, 'duplicate_lines', 32, 63)) AS p(version, rule, m, held)"
ABLATION_SQL = f"""SELECT version, rule, count(*) FILTER (failure_bits & m <> 0) AS n_failed, count(*) FILTER (failure_bits & held = m) AS n_only,
  count(*) FILTER (failure_bits & held <> 0) AS n_rejected FROM {_FAILED} LEFT JOIN ({SQL}) AS l ON true GROUP BY version, rule"""


@query("op2_policy_ablation", ABLATION_SQL)
def op2_ablation(spark, sf_dir):
    return ablations(table(spark, sf_dir, "documents"))
