"""Every operator on small tables: against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provenir.llm import block_search, line_dedup, lm_scoring, minhash_dedup, packing, pii_disclosure, quality_rules, source_mixing, substring_dedup, token_files
from provenir.llm.tokens import TextEncoder, shared_encoder
from provenir.session import scratch_dir

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(6)]
    out = {k: t for k, t in enumerate(base)}
    for k in range(10, 16):
        w = base[0].split()
        w[rng.randrange(len(w))] = f"changed{k}"
        out[k] = " ".join(w)
    line = "A line that is long enough to count as one, with more than sixty letters in it."
    out |= {20: base[1], 21: base[1].upper(), 22: "", 23: None, 24: "one two", 25: "one two", 26: " \t\n ", 27: prose(rng, 30_000)}
    out |= {28: line + "\n" + base[2] + "\n" + line, 29: line.replace("letters", "lettres") + "\nsome rest", 30: "x@y.example.org 10.0.0.1 +12 345 678 901 4111 1111 1111 1111 300.1.1.1"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", ["a", "b", None, ""][k % 4], None, "x") for k, t in texts.items()] + [(None, "no name here", "en", "a", 3, "x")]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def by_doc(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, texts, empty):
    sets = {k: shingles(t) for k, t in texts.items()}
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    got = by_doc(minhash_dedup.near_duplicates(docs))
    for k, s in sets.items():
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(s), root(k), root(k) == k)
    assert got[None].component_id is None and got[None].kept
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in texts if root(k) == k} | {None}
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_posterior_bounds():
    bounds = minhash_dedup.least_matches(0.75, 1e-4, 32, 128)
    for n, m in zip(range(32, 129, 32), bounds):
        grid = np.linspace(0, 1, 200_001)
        logs = m * np.log(np.maximum(grid, 1e-300)) + (n - m) * np.log(np.maximum(1 - grid, 1e-300))
        density = np.exp(logs - logs.max())
        assert density[grid >= 0.75].sum() / density.sum() >= 0.9e-4
    assert list(bounds) == sorted(bounds)


def test_open_pairs_of_a_family(spark):
    """A family without a centre: chains of links are found although most pairs of a bucket do not link."""
    rng = random.Random(3)
    w = prose(rng, 60).split()
    rows = []
    for k in range(40):
        rows.append((k, " ".join(w)))
        w[rng.randrange(len(w))] = f"w{k}"
    got = by_doc(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    sets = [shingles(t) for _, t in rows]
    for k in range(1, 40):
        n = len(sets[k] & sets[k - 1])
        if 100 * n >= 75 * len(sets[k] | sets[k - 1]):
            assert got[k].component_id == got[k - 1].component_id


def test_quality(docs, texts, empty):
    got = by_doc(quality_rules.quality_report(docs))
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words) == (len(w), len("".join(w)), len(hit))
        assert got[k].n_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and got[k].n_dup_lines == len(lines) - len(set(lines))
        assert got[k].base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    ledger = quality_rules.with_ledger(docs)
    bits = [r.failure_bits for r in ledger.collect()]
    held = quality_rules.mask(quality_rules.POLICIES[2])
    for r in quality_rules.ablation(ledger).collect():
        m = quality_rules.mask((r.rule,))
        assert (r.n_failed, r.n_only, r.n_rejected) == (sum(b & m > 0 for b in bits), sum(b & held == m for b in bits), sum(b & held > 0 for b in bits))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.filter("n_words <> 'x'").count() == 0
    assert quality_rules.quality_report(empty).count() == 0


def test_stored_ledger(docs, empty):
    """The report reads a stored ledger, and every policy has its ablation from it."""
    report = quality_rules.quality_report(docs)
    assert report.inputFiles() and "quality-ledger" in report.inputFiles()[0]
    bits = [r.failure_bits for r in report.collect()]
    rows = {(r.version, r.rule): (r.n_failed, r.n_only, r.n_rejected) for r in quality_rules.ablations(docs).collect()}
    want = {}
    for v, rules in quality_rules.POLICIES.items():
        held = quality_rules.mask(rules)
        for rule in rules:
            m = quality_rules.mask((rule,))
            want[v, rule] = (sum(b & m > 0 for b in bits), sum(b & held == m for b in bits), sum(b & held > 0 for b in bits))
    assert rows == want
    assert {r.n_rejected for r in quality_rules.ablations(empty).collect()} == {0}


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def personal(t):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in twice) % 10 == 0, "phone": lambda: 8 <= len(d) <= 15}[kind]()

    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS for m in re.finditer(p, t) if good(k, m[0])]


def test_personal_data(spark, texts):
    rng = random.Random(9)
    odd = ["a@b.c%x@d.e", "é" * 30 + " a@b.co, 1.2.3.4.5.6.7.8", "+1 (22) 333-4444-", "", None, "a@b" + ".c" * 30_000, "1" * 60_000, "5" * 200 + " 4111-1111-1111-1111"]
    odd += ["".join(rng.choice("a@.+1 4-()é%") for _ in range(60)) for _ in range(300)]
    rows = list(enumerate(odd + [t for t in texts.values()]))
    got = by_doc(pii_disclosure.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for k, t in rows:
        want = personal(t or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert got[k].spans.startswith(",".join(want))
        assert got[k].n_email == sum(s.startswith("email") for s in want)


def test_disclosing_words(spark):
    rows = [(k, f"Some plain words stand here beside person {'zanzibar' if k < 5 else 'ordinary'} at {'boss@corp.example' if k < 5 else 'nobody'} and then more plain words.") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_doc(pii_disclosure.personal_data(docs))
    at = rows[0][1].index("zanzibar")
    assert f"remove:{at}:{at + 8}" in got[0].spans and "plain" not in rows[0][1][at : at + 8] and got[20].spans == ""
    clean = by_doc(pii_disclosure.sanitised(docs))
    assert "zanzibar" not in clean[0].text and "<email>" in clean[0].text and clean[20].text == rows[20][1]


def test_disclosing_words_of_rare_entities(spark):
    """Entities of one and of two documents disclose; the spellings of a card are one entity."""
    plain = "plain words stand here"
    texts = ["Some secretive note: boss@corp.example", "first quibble 4111 1111 1111 1111", "second quibble 4111-1111-1111-1111"] + [f"Some first second note {plain}"] * 197
    got = by_doc(pii_disclosure.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    kinds = {(k, w): {s.split(":")[0] for s in got[k].spans.split(",") if s.endswith(f":{texts[k].index(w)}:{texts[k].index(w) + len(w)}")} for k, w in ((0, "secretive"), (1, "quibble"), (2, "quibble"))}
    assert kinds == {(0, "secretive"): {"generalise"}, (1, "quibble"): {"remove"}, (2, "quibble"): {"remove"}}
    assert got[5].spans == ""


def test_disclosing_words_everywhere(spark):
    """Words count over the whole document and at its edges, short names too, and go wherever they stand."""
    far = " plain words stand here" * 40
    texts = ["Ng: boss@corp.example" + far + " Kowalski"] * 5 + ["Kowalski met Ng"] + ["met" + far] * 200
    got = by_doc(pii_disclosure.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    n = len(texts[0])
    assert got[0].spans == f"email:4:21,remove:0:2,remove:{n - 8}:{n}" and got[5].spans == "remove:0:8,remove:13:15" and got[6].spans == ""
    clean = by_doc(pii_disclosure.sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert clean[5].text == " met "


def disclosing(texts, entity_of):
    """Actions of words by the formulas of the module, with exact counts."""
    words = [set(re.findall(r"[^\W\d_]{2,}", t.lower())) for t in texts]
    n, vocabulary = len(texts), len(set().union(*words))
    entities = {}
    for k, found in enumerate(entity_of):
        for e in found:
            entities.setdefault(e, set()).add(k)
    n_t, best = Counter(w for ws in words for w in ws), {}
    for rows in entities.values():
        n_e = len(rows)
        for w, both in Counter(w for k in rows for w in words[k]).items():
            factorial = both * math.log(both) - both + math.log(2 * math.pi * both) / 2
            by_chance = math.log(vocabulary) + both * math.log(n_t[w] * n_e / n) - factorial
            if n_e < n and by_chance <= math.log(pii_disclosure.CHANCE):
                share = math.log2(both * n / (n_e * (n_t[w] + 1))) / math.log2(n / n_e)
                best[w] = max(share, best.get(w, share))
    return {w: 5 if share >= 0.9 else 4 for w, share in best.items() if share >= 0.7}


def test_disclosing_words_against_brute_force(spark):
    rng = random.Random(11)
    entity_of = [[e for e in range(12) if rng.random() < (0.004, 0.01, 0.02, 0.05)[e % 4]] for _ in range(300)]
    texts = [" ".join([rng.choice("abcdefgh") * rng.randrange(2, 9) for _ in range(8)] + [f"mail{chr(97 + e)}{chr(97 + e)}@x.example nick{chr(97 + e)}" for e in found]) for found in entity_of]
    texts += [f"only{chr(97 + k)} word" for k in range(20)] + ["nicka came", "nickb came"]
    entity_of += [[]] * 22
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").withColumn("base", pii_disclosure.base_spans(F.col("text")))
    got = {r["term"]: r["action"] for r in pii_disclosure.disclosures(docs).collect()}
    assert got == disclosing(texts, entity_of) and len(got) > 3


def test_holders_join_no_word_outside_the_bitmap(spark):
    """The bitmap comes before the join by term, also where ``found`` is too large to broadcast, and rows are those that hold a term."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "Alpha alpha delta"), (4, "")], "row bigint, text string")
    found = spark.createDataFrame([("alpha", 4), ("delta", 5)], "term string, action int")
    held = pii_disclosure._holders(docs, found)
    assert sorted(r["row"] for r in held.collect()) == [1, 3]
    joins = [x for x in held._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert len(joins) == 2 and "term" in joins[0] and "_w" in joins[1]  # the outer one is by term


ENCODERS = {lead: (TextEncoder(public_tokenizers.path(f), lead), Tokenizer.from_file(public_tokenizers.path(f))) for lead, f in ((True, "byte_bpe_50k.json"), (False, "word_bpe_49k.json"))}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'aBs1é½ñ\x1cΣ 漢"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_tokens(text):
    for encoder, whole in ENCODERS.values():
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_are_tokenised_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, asked = shared_encoder(path, False), []
    assert shared_encoder(path, False) is encoder  # what one partition has learnt serves the next
    piece = encoder._pieces._make
    encoder._pieces._make = lambda x: asked.append(x) or piece(x)
    try:
        text = "Zqword zqword. ZQWORD, zqword*** Zqé zqÉ. zqİ. zqİ"
        got = np.frombuffer(encoder.encode(text), "<u4").tolist()
    finally:
        encoder._pieces._make = piece
    assert got == ENCODERS[False][1].encode(text, add_special_tokens=False).ids
    assert asked.count("zqword") == 1 and asked.count("zqé") == 1


def ids_of(lead, text, end):
    return ENCODERS[lead][1].encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, texts, empty):
    rows = packing.pack(docs.unionAll(docs.filter("doc_id = 24")), public_tokenizers.path("byte_bpe_50k.json"), group_size=16).collect()
    fill = {}
    for r in rows:
        ids = ids_of(True, texts.get(r.doc_id, "no name here"), 1)
        assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r.doc_id == 24 for r in rows) == 2
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms, want = [], []
    for n in lengths:
        k = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        rooms += [50] * (k == len(rooms))
        want.append((k, 50 - rooms[k]))
        rooms[k] -= n
    assert list(zip(*packing.first_fit(lengths, 50))) == want


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 12))
    v[50] = v[100]
    rows = [(k, [float(x) for x in v[k]]) for k in range(700)] + [(700, None), (800, [0.0] * 12), (900, [float("nan")] * 12), (901, [None] * 12), (None, [1.0] * 12), (5, [float(x) for x in v[5]]), (1000, [1e30] * 12), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in block_search.nearest(df, block=64).orderBy("query_id", "rank").collect()]
    live = {k: np.array(x) for k, x in rows if k is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    want = []
    for q in sorted(k for k in live if k % 100 == 0):
        near = sorted((math.sqrt(((live[q] - x) ** 2).sum()), k) for k, x in live.items() if k != q and len(x) == len(live[q]))[:10]
        want += [(q, i + 1, k, d) for i, (d, k) in enumerate(near)]
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert block_search.nearest(df.limit(0)).count() == 0


def test_nearest_sends_each_vector_once_to_its_cells(spark):
    """No join, so no broadcast of copied query blocks; a cell's candidates come in several blocks, also where every row asks."""
    rng = np.random.default_rng(9)
    v = rng.integers(-3, 4, size=(900, 5)).astype(float)
    v[[7, 8, 9]] = [[1e200, 1, 1, 1, 1], [1e200, 2, 1, 1, 1], [-1e200, 1, 1, 1, 1]]
    df = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    live = {k: x for k, x in enumerate(v) if x.any()}
    with np.errstate(over="ignore"):
        for step, block in ((1, 16), (100, 64), (3, 4096)):
            found = block_search.nearest(df, 4, step, block)
            got = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
            want = []
            for q in sorted(k for k in live if k % step == 0):
                near = sorted((math.sqrt(((live[q] - x) ** 2).sum()), k) for k, x in live.items() if k != q)[:4]
                want += [(q, i + 1, k, d) for i, (d, k) in enumerate(near)]
            assert [g[:3] for g in got] == [w[:3] for w in want]
            assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Broadcast" not in plan


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_edit_join_parts(seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(20):
        a = "".join(rng.choice("abé") for _ in range(rng.choice([5, 31, 60, 64, 90])))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], ["z"], ["a", "b"]])
        pairs.append((a, "".join(b)))
    for t in (1, 2):
        got = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], t)
        assert got.tolist() == [distance(a, b) <= t for a, b in pairs]
    lines = list(dict.fromkeys(x for p in pairs for x in p))
    keys, owner = line_dedup.segment_keys(lines)
    held = {x: set(keys[owner == k].tolist()) for k, x in enumerate(lines)}
    for a, b in pairs:
        t = int(line_dedup.distance_for(np.array([min(len(a), len(b))]))[0])
        if a != b and 0 < t and distance(a, b) <= t:
            assert held[a] & held[b]


def test_lines(docs, empty):
    got = by_doc(line_dedup.repeated_lines(docs))
    assert (got[28].n_lines, got[28].dropped, got[28].first_docs) == (3, [1, 2], [2, 28])
    assert got[29].dropped == [0] and got[29].first_docs == [28]
    assert got[20].dropped == [0] and got[21].dropped == [] and got[22].n_lines == got[23].n_lines == 0
    assert got[25].dropped == [0] and got[25].first_docs == [24] and None in got
    left = by_doc(line_dedup.drop_lines(docs))
    assert left[29].text == "some rest" and left[29].n_chars == 9 and 20 not in left and left[23].text is None
    assert line_dedup.repeated_lines(empty).count() == 0


def test_substrings(spark, empty):
    long = prose(random.Random(1), 60)
    rows = [(1, "intro\n" + long), (2, long.upper() + "\nother end"), (3, "short one"), (4, "short one"), (5, None), (6, f"a b\nc d e f g h\n\n{long}"), (7, "x\n\na b\nc d e f g h"), (7, "x\n\na b\nc d e f g h")]
    got = {(r.doc_id, r.start, r.end, r.first_doc) for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()}
    assert got == {(2, 0, len(long), 1), (6, 17, 17 + len(long), 1), (7, 3, 18, 6)}
    assert substring_dedup.repeated_spans(empty).collect() == []


def test_substrings_inside_running_text(spark):
    """A passage in the middle of a line is found by its whole sentences; a lone short line stays."""
    passage = "tail of one. Alpha beta gamma delta epsilon. Zeta eta theta iota kappa! Lambda mu nu"
    texts = [f"Some first words {passage} and so on.", f"Other words here {passage} until the end.", "Menu\nfirst", "second\n menu", "a b c d e f. g h\ni j k l", "x\na b c d\ne f. g h i j k l"]
    got = {(r.doc_id, r.start, r.end, r.n_words, r.n_pieces, r.first_doc) for r in substring_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 8).collect()}
    start = texts[1].index("Alpha")
    assert got == {(1, start, texts[1].index(" Lambda"), 10, 2, 0)}


def test_short_lines(spark, tmp_path):
    """A passage of short lines inside paragraphs that differ elsewhere is one span."""
    passage = [prose(random.Random(k), 7) for k in range(8)]
    texts = ["\n".join(["own start", *passage, "own end"]), "\n".join(["another start", *passage, "another end"]), "Menu\nfirst", "second\n menu", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.start, r.end, r.n_words, r.first_doc) for r in substring_dedup.op7(spark, str(tmp_path)).collect()}
    start = texts[1].index(passage[0])
    assert got == {(1, start, start + len("\n".join(passage)), 56, 0)}


def spans_by_brute_force(docs, least):
    """Spans from sets of marked pieces, by other means than the operator: split, count, mark."""
    pieces, units = {}, []
    for doc, text in docs:
        at, mine, lines = 0, [], []
        for line in (text or "").split("\n"):
            row, rest, base = [], line, at
            while rest.strip(" \t\r\f\v"):
                m = re.search(r"[.!?]+(?=[ \t\r\f\v]|$)", rest)
                end = m.end() if m else len(rest)
                piece = rest[:end]
                lead = len(piece) - len(piece.lstrip(" \t\r\f\v"))
                if piece.strip(" \t\r\f\v"):
                    row.append((base + lead, base + len(piece.rstrip(" \t\r\f\v")), piece.lower().split()))
                rest, base = rest[end:], base + end
            lines.append([len(mine) + k for k in range(len(row))])
            mine += row
            at += len(line) + 1
        pieces[doc] = mine
        units += [(doc, [k]) for k in range(len(mine))]
        block = []
        for row in [*lines, []]:
            if row:
                block.append(row)
                continue
            if len(block) > 1:
                units.append((doc, [k for r in block for k in r]))
            block = []
    first, marked = {}, set()
    for doc, ks in units:
        key = tuple(w for k in ks for w in pieces[doc][k][2])
        place = (doc, pieces[doc][ks[0]][0])
        first[key] = min(place, first.get(key, place))
    for doc, ks in units:
        key = tuple(w for k in ks for w in pieces[doc][k][2])
        if (doc, pieces[doc][ks[0]][0]) != first[key]:
            marked |= {(doc, k) for k in ks}
    out = set()
    for doc, mine in pieces.items():
        k = 0
        while k < len(mine):
            e = k
            while (doc, e) in marked:
                e += 1
            n = sum(len(mine[x][2]) for x in range(k, e))
            if e > k and n >= least:
                out.add((doc, mine[k][0], mine[e - 1][1], n))
            k = e + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_spans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    bits = ["one two.", "three", "four five six!", "seven eight? nine", " ten", "\n", "\n\n", "eleven twelve thirteen fourteen.", "a.b", "Fifteen SIXTEEN"]
    docs = [(d, " ".join(rng.choices(bits, k=rng.randint(0, 25)))) for d in range(40)]
    docs += [(50 + k, "\n".join(rng.choices(["red green", "blue.", "black white grey", ""], k=6))) for k in range(20)]
    got = {(r.doc_id, r.start, r.end, r.n_words) for r in substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), 5).collect()}
    assert got == spans_by_brute_force(docs, 5) and got


def test_mixing(docs, empty):
    rows = source_mixing.mixed(docs).collect()
    total = sum(r.size for r in rows)
    groups = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        groups.setdefault(r.source_size, []).append(r)
    assert math.isclose(sum(g[0].target for g in groups.values()), total, rel_tol=1e-9)
    for g in groups.values():
        assert sum(r.taken for r in g) == round(g[0].target) and g[0].target <= 3 * g[0].source_size + 1e-9
    order = source_mixing.training_order(docs)
    assert order.columns == docs.columns and order.count() == sum(r.copies for r in rows)
    assert source_mixing.mixed(empty).count() == 0


def test_training_ranks(docs, empty):
    """Every whole copy has a place of its own, and ranks follow the places."""
    rows = sorted(source_mixing.training_ranks(docs).collect(), key=lambda r: r.rank)
    mixed = source_mixing.mixed(docs).collect()
    assert [r.rank for r in rows] == list(range(sum(r.copies for r in mixed))) and max(r.copy for r in rows) > 0
    assert all(a.position <= b.position for a, b in zip(rows, rows[1:]))
    first = {r.doc_id: r.position for r in rows if r.copy == 0}
    assert first == {r.doc_id: r.position for r in mixed if r.copies}
    assert source_mixing.training_ranks(empty).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_segments(ids):
    seg = token_files.Segment(token_files.encode_segment(np.array(ids, np.uint32)))
    assert seg.all().tolist() == ids
    assert all(seg[i] == ids[i] for i in range(0, len(ids), 7))


def test_token_files(spark, docs, texts, empty):
    folder = scratch_dir(spark, "dac-test")
    manifest = token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, k in zip(rows, [None, *sorted(texts)]):
        ids = ids_of(False, texts.get(k, "no name here"), 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), crc(ids))
        at += len(ids)
    m = manifest.filter("doc_id = 27").first()
    file = token_files.TokenFile(folder, m.file)
    assert [file.token(m["at"] + i) for i in (0, 777, m.n_tokens - 1)] == [ids_of(False, texts[27], 2)[i] for i in (0, 777, -1)]
    file.close()
    assert token_files.write_token_files(empty, folder, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_scores(docs, texts, empty):
    words = {k: (t or "").encode().lower().split() + [0] for k, t in texts.items()} | {None: b"no name here".split() + [0]}
    count = Counter(w for k in words if not lm_scoring.is_held_out(k) for w in words[k])
    n, v = sum(count.values()), len(count)
    got = by_doc(lm_scoring.scores(docs))
    for k, w in words.items():
        assert (got[k].held_out, got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (lm_scoring.is_held_out(k), len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(got[k].base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and got[k].score < 0
    assert lm_scoring.scores(empty).count() == 0


def test_model_learns_and_is_normalised(spark):
    """A strict alternation is learnt, and every row of probabilities sums to one."""
    code = [(2 * 256 + 3) * 256 + 2, (3 * 256 + 2) * 256 + 3]
    share = np.full(256, 1e-3)
    share[[2, 3]] = 0.4
    share /= share.sum()
    triples = spark.createDataFrame([(c, 1000) for c in code], "code bigint, n bigint")
    table = lm_scoring.log_probabilities(lm_scoring.train(triples, share))
    assert np.allclose((10.0 ** table[::997].astype(float)).sum(axis=1), 1, atol=1e-4)
    assert table[2 * 256 + 3, 2] > math.log10(share[2]) + 0.1 and table[2 * 256 + 3, 3] < math.log10(share[3])


def test_open_lines_of_a_family(spark):
    """Variants of one line that share segments: all links count, also those away from the hub."""
    rng = random.Random(6)
    w = list(prose(rng, 12))
    rows = []
    for k in range(60):
        v = list(w)
        for _ in range(rng.randint(0, 3)):
            v[rng.randrange(len(v))] = rng.choice("xyz")
        rows.append((k, "".join(v).strip()))
    lines = sorted({t for _, t in rows})
    top = {x: x for x in lines}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in lines:
        for b in lines:
            t = int(line_dedup.distance_for(np.array([min(len(a), len(b))]))[0])
            if a < b and distance(a, b) <= t:
                top[root(a)] = root(b)
    first = {}
    for k, t in rows:
        first.setdefault(root(t), k)
    got = by_doc(line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for k, t in rows:
        assert got[k].first_docs == ([] if first[root(t)] == k else [first[root(t)]])
