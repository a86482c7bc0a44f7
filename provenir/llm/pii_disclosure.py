"""Personal data, and words that disclose it by what the corpus shows.

Emails, IP addresses, card and phone numbers are found by patterns and checks.
Each distinct value is a protected entity; cards and phones are told apart by
their digits alone. For every word of two letters or more the corpus tells how
much it reveals of the entities it shares documents with: the pointwise mutual
information log2(p * N / n_e), with p = n_et / (n_t + ``DOUBT``) the chance of
the entity in a document with the word, as a share of the entity's information
log2(N / n_e). n_e counts documents with the entity, n_t with the word, n_et
with both, at any distance; ``DOUBT`` is an unseen document with the word alone,
so that an estimate from one document counts less than one from many. A word
with a share of ``REMOVE_AT`` or more for some entity is removed, from
``GENERALISE_AT`` on it is generalised to a placeholder, at every place outside
the base spans where it stands, in all documents.

A word also has to be with the entity more often than chance explains. Words
dealt to documents at random give a joint count of n_et or more with a
probability of at most (n_t * n_e / N) ** n_et / n_et!; times the different words
of the corpus (its estimate by a sketch), that may be ``CHANCE`` at most. So one
shared document proves something in a small corpus and nothing in a large one,
in which a document has rare words anyway.

Entities of the same documents get the same estimate, so they are one class,
and a document with very many entities of its own has one. Left out before words
and classes are paired are those that cannot pass, whatever they are paired
with: words with n_t + DOUBT over n_e ** G * N ** (1 - G) (G for
``GENERALISE_AT``), as n_et is at most n_e, and words and classes whose best
case, n_et = n_t = n_e, chance explains.

All of it is DataFrame functions. Texts are written once with a row number; what
is shuffled is entities, the words of documents that have some, their counts,
and the places of disclosing words in the texts that hold one.
A run of matches keeps its places by prefix sums in blocks, so a very long
text with very many matches stays near linear.

The patterns are those of the contract with possessive quantifiers and a guard
against starting inside a run, which match the same and cannot overflow the
stack or rescan a run.

Odd rows: a null text counts as empty; repeated rows are rows of their own;
a null doc_id is kept. Only ``doc_id`` and ``text`` are read. An empty table
gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .catalog import query
from .common import bind, may_hold, table

DOUBT = 1
#: How many words of the corpus may reach a joint count with one entity class by chance.
CHANCE = 0.1
GENERALISE_AT = 0.7
REMOVE_AT = 0.9

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Text that any match of the kind holds: others are not scanned.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
WORDS = r"\p{L}{2,}+"
#: log2 of the bits by which words are kept out of shuffles.
BITS = 26

_BLOCK = 128
_SPAN = "array<struct<start: int, end: int, m: string>>"


def running(lengths: Column) -> Column:
    """Sums of all elements before each one, by blocks."""
    add = lambda a, x: a + x
    whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, _BLOCK), F.lit(0), add))
    sums = bind(whole, lambda w: F.transform(w, lambda _, k: F.aggregate(F.slice(w, F.lit(1), k), F.lit(0), add)))
    inside = lambda s: F.transform(lengths, lambda _, k: F.get(s, F.floor(k / _BLOCK).cast("int")) + F.aggregate(F.slice(lengths, F.floor(k / _BLOCK).cast("int") * _BLOCK + 1, k % _BLOCK), F.lit(0), add))
    return bind(sums, inside)


def spans(text: Column, pattern: str) -> Column:
    """All matches: (start, end, m) in code points."""

    def placed(x: Column) -> Column:
        gaps, found = x["g"], x["m"]
        lengths = F.transform(found, lambda m, k: F.length(F.get(gaps, k)) + F.length(m))
        return bind(lengths, lambda n: bind(running(n), lambda before: F.transform(found, lambda m, k: F.struct(
            (F.get(before, k) + F.length(F.get(gaps, k))).alias("start"),
            (F.get(before, k) + F.get(n, k)).alias("end"),
            m.alias("m")))))

    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return bind(parts, lambda x: F.when(F.size(x["m"]) > 0, placed(x)).otherwise(F.array().cast(_SPAN)))


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, k: bind(c.cast("int") * (1 + k % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = lambda p: bind(F.regexp_replace(p, "^0+", ""), lambda s: (F.length(s) <= 3) & (F.coalesce(F.when(F.length(s) <= 3, s.try_cast("int")), F.lit(0)) <= 255))
        return F.forall(F.split(m, r"\."), short)
    if kind == "card":
        return bind(digits, lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    return F.length(digits).between(8, 15)


def base_spans(text: Column) -> Column:
    """The valid matches of all four kinds: (kind, start, end, m), by kind and start."""
    return F.concat(*[_of_kind(text, k, kind) for k, kind in enumerate(PATTERNS)])


def _of_kind(text: Column, k: int, kind: str) -> Column:
    found = F.when(text.rlike(HINTS[kind]), spans(text, PATTERNS[kind])).otherwise(F.array().cast(_SPAN))
    good = F.filter(found, lambda x: _valid(kind, x["m"]))
    return F.transform(good, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m")))


def _count(k: int, kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{kind}")


def _entity(x: Column) -> Column:
    """Name of the entity of a base span; spellings of a card or phone are one."""
    digits = x["kind"] >= list(PATTERNS).index("card")
    return F.concat_ws(":", x["kind"].cast("string"), F.when(digits, F.regexp_replace(x["m"], "[^0-9]", "")).otherwise(F.lower(x["m"])))


def _terms(text: Column) -> Column:
    """Distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.lower))


def _classes(scanned: DataFrame) -> DataFrame:
    """Rows (row, n_e, x, y): the classes of entities in each row; n_e, x and y name the set of rows of a class."""
    entities = scanned.filter(F.size("base") > 0).select("row", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    entities = materialize(entities, "pii-entities")
    sets = entities.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    return materialize(entities.join(materialize(sets, "pii-sets"), "entity").select("row", "n_e", "x", "y").distinct(), "pii-classes")


def disclosures(scanned: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, chance: float = CHANCE) -> DataFrame:
    """Rows (term, action): what a word has to become (4 generalise, 5 remove)."""
    told = _classes(scanned)
    total = scanned.count()
    told = told.filter(F.col("n_e") < total)
    tokens = scanned.filter(F.size("base") > 0).select("row", F.explode(_terms(F.col("text"))).alias("term"))
    counts = materialize(tokens.groupBy("term").agg(F.count("*").alias("n_told")), "pii-told")
    tests = max(1, scanned.select(F.explode(_terms(F.col("text"))).alias("term")).agg(F.approx_count_distinct("term")).first()[0])

    def beyond_chance(k: Column, n_t: Column, n_e: Column) -> Column:
        k, both = k.cast("double"), n_t.cast("double") * n_e / max(total, 1)
        factorial = k * F.log(k) - k + F.log(2 * math.pi * k) / 2  # Stirling's lower bound
        return math.log(tests) + k * F.log(both) - factorial <= math.log(chance)

    kept = told.filter((F.col("n_e") * math.e >= total) | beyond_chance(F.col("n_e"), F.col("n_e"), F.col("n_e")))
    kept = materialize(kept, "pii-kept")
    most = kept.agg(F.max("n_e")).first()[0] or 0
    reach = lambda n: (F.col("n_t") + DOUBT) * (1 - 1e-9) <= F.pow(n, F.lit(generalise_at)) * float(total) ** (1 - generalise_at)
    likely = counts.filter((F.col("n_told") * math.e**2 >= total) | beyond_chance(F.col("n_told"), F.col("n_told"), F.col("n_told")))
    key = F.xxhash64("term")
    seen = scanned.select(F.explode(_terms(F.col("text"))).alias("term"))
    n_t = may_hold(seen, key, likely, key, BITS).groupBy("term").agg(F.count("*").alias("n_t"))
    n_t = materialize(n_t.filter(reach(F.lit(most))), "pii-counts")
    pairs = may_hold(tokens, key, n_t, key, BITS).join(kept, "row")
    joint = pairs.groupBy("term", "n_e", "x", "y").agg(F.count("*").alias("n_et"))
    share = F.log2(F.col("n_et") * total / (F.col("n_e") * (F.col("n_t") + DOUBT))) / F.log2(total / F.col("n_e"))
    judged = joint.join(n_t, "term").filter(reach(F.col("n_e")) & beyond_chance(F.col("n_et"), F.col("n_t"), F.col("n_e")))
    judged = judged.groupBy("term").agg(F.max(share).alias("share"))
    return judged.filter(F.col("share") >= generalise_at).select("term", F.when(F.col("share") >= remove_at, 5).otherwise(4).alias("action"))


def _holders(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that hold a disclosing word; ``found`` names each term once."""
    words = scanned.select("row", F.explode(_terms(F.col("text"))).alias("term"))
    # An inner join: the optimizer pushes a semi join below the bitmap, and every word of the corpus is shuffled.
    return may_hold(words, F.xxhash64("term"), found, F.xxhash64("term"), BITS).join(found, "term").select("row").distinct()


def _marked(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (row, terms): the places of disclosing words that no base span covers from their start."""
    holders = materialize(_holders(scanned, found), "pii-holders")
    texts = may_hold(scanned, F.xxhash64("row"), holders, F.xxhash64("row"), BITS)  # places only in texts that hold such a word
    places = texts.select("row", F.inline(spans(F.col("text"), WORDS))).withColumn("term", F.lower("m")).drop("m")
    marks = may_hold(places, F.xxhash64("term"), found, F.xxhash64("term"), BITS).join(found, "term").select("row", "start", "end", F.col("action").alias("kind"))
    marks = materialize(marks, "pii-marks")
    base = scanned.filter(F.size("base") > 0).select("row", F.inline("base")).select("row", "start", "end", "kind")
    base = base.join(marks.select("row").distinct(), "row", "left_semi")
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)  # the window is one document
    covered = F.coalesce(F.max(F.when(F.col("kind") < len(PATTERNS), F.col("end"))).over(before), F.lit(0))
    free = marks.unionByName(base).withColumn("_e", covered).filter((F.col("kind") >= len(PATTERNS)) & (F.col("start") >= F.col("_e")))
    return free.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("terms"))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each document: counts, the digest of the base spans, and all spans."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = materialize(texts.select("doc_id", F.monotonically_increasing_id().alias("row"), base_spans(F.col("text")).alias("base"), "text"), "pii-scanned")
    found = materialize(disclosures(scanned), "pii-disclosures")
    terms = _marked(scanned, found)
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    rows = scanned.drop("text").join(terms, "row", "left").withColumns({"_b": text(F.col("base")), "_t": F.coalesce(text(F.col("terms")), F.lit(""))})
    counts = [_count(k, kind) for k, kind in enumerate(PATTERNS)]
    both = F.concat_ws(",", F.nullif("_b", F.lit("")), F.nullif("_t", F.lit("")))
    return rows.select("doc_id", *counts, F.sha2(F.col("_b").cast("binary"), 256).alias("base_sha256"), both.alias("spans"))


def sanitised(docs: DataFrame, spans_of: DataFrame | None = None) -> DataFrame:
    """``docs`` (one row for each doc_id) with base spans and generalised words replaced by their kind in angle brackets, and removed words cut out."""
    found = (spans_of or personal_data(docs)).filter("spans <> ''").select("doc_id", F.explode(F.split("spans", ",")).alias("s"))
    part = F.split("s", ":")
    rows = found.select("doc_id", part[0].alias("kind"), part[1].cast("int").alias("start"), part[2].cast("int").alias("end"))
    before = Window.partitionBy("doc_id").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_e", F.coalesce(F.max("end").over(before), F.lit(0))).filter("end > _e").withColumn("start", F.greatest("start", "_e"))
    lists = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_s"))
    mark = lambda x: F.when(x["kind"] == "remove", F.lit("")).otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">")))
    piece = lambda x, k: F.concat(F.substring(F.col("text"), F.coalesce(F.get("_s", k - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get("_s", k - 1)["end"], F.lit(0))), mark(x))
    rest = F.substring(F.col("text"), F.element_at("_s", -1)["end"] + 1, F.length("text"))
    return docs.join(lists, "doc_id", "left").withColumn("text", F.when(F.col("_s").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("_s", piece), ""), rest))).select(*docs.columns)


@query("op3_pii_disclosure")
def op3(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))
