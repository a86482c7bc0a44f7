"""The whole corpus pipeline against a plain version that compares everything with everything."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_operators import COLUMNS, prose, shingles

WORD = r"[^\x20\x09-\x0D]+"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def classes(items, linked):
    """Smallest member of the class of each item."""
    items, top = sorted(items), {}
    for x in items:
        met = {top[y] for y in top if linked(y, x)}
        top[x] = x
        if met:
            top = {k: min(met) if v in met or k == x else v for k, v in top.items()}
    return top


def good(text):
    w, lines = re.findall(WORD, text or ""), [x for x in (text or "").split("\n") if x.strip()]
    three = list(zip(w, w[1:], w[2:]))
    seen = Counter(three)
    repeated = {i + j for i, x in enumerate(three) if seen[x] > 1 for j in range(3)}
    chars, symbols = len("".join(w)), len(re.findall(r"[#*$%&|<>]", text or ""))
    return (
        len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 2 * len(w) <= chars <= 15 * len(w)
        and 10 * symbols <= len(w) and 2 * (len(lines) - len(set(lines))) <= len(lines)
    )


def near_lines(a, b):
    n = min(len(a), len(b))
    t = (n >= 30) + (n >= 60)
    return a == b or (abs(len(a) - len(b)) <= t and sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) <= 2 * t and distance(a, b) <= t)


def without_lines(texts):
    places = [(k, n, x.strip()) for k in sorted(texts) for n, x in enumerate(texts[k].split("\n")) if x.strip()]
    top, first, gone = classes({x for *_, x in places}, near_lines), {}, set()
    for k, n, x in places:
        if first.setdefault(top[x], (k, n)) != (k, n):
            gone.add((k, n))
    left = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone) for k, t in texts.items()}
    return {k: t for k, t in left.items() if t.strip()}


def copies(texts, sources):
    size = {k: len(re.findall(WORD, t)) for k, t in texts.items()}
    members = defaultdict(list)
    for k in texts:
        members[sources[k]].append(k)
    names = sorted(members, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k in members[s]) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(total.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * total[s]}
        for s in over or free:
            target[s] = 3 * total[s] if over else weight[s] * level
        rest -= sum(3 * total[s] for s in over)
        free = free - over if over else set()
    out = {}
    for s in names:
        goal, at = round(target[s]), 0
        for k in sorted(members[s], key=lambda k: hashlib.md5(str(k).encode()).hexdigest()):
            full = goal // total[s]
            part = max(0, min(size[k], goal - full * total[s] - at))
            out[k] = full + (2 * part >= size[k])
            at += size[k]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = {k: "\n".join(prose(rng, rng.randint(11, 14)) for _ in range(rng.randint(5, 8))) for k in range(1, 25)}
    shared = "this line of more than sixty letters stands in several of the documents as it is"
    texts |= {k: texts[k] + "\n" + shared.replace("several", "severel" if k % 2 else "several") for k in (3, 4, 9, 10)}
    for k, of in ((30, 5), (31, 5), (32, 6)):  # near copies whose lines differ in whole words
        texts[k] = "\n".join(x.rsplit(" ", 1)[0] + f" altered{k}" if n % 3 == 0 else x.replace(" ", f" w{k} ", 1) if n % 3 == 1 else f"{x} more{k}" for n, x in enumerate(texts[of].split("\n")))
    whole = prose(rng, 150)
    texts |= {33: whole, 34: whole + " one other word", 35: texts[7], 36: "too short", 37: "", 38: None, 39: "a b c " * 40, 40: prose(rng, 4000), 41: "# & " * 60}
    sources = {k: ["a", "b", "b", "c", "", None][k % 6] if k % 5 else "a" for k in texts}
    return texts, sources


def test_pipeline(spark, tmp_path, corpus):
    texts, sources = corpus
    rows = [(k, t, "en", sources[k], None if t is None else len(t), "x") for k, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    left = without_lines({k: t for k, t in texts.items() if good(t)})
    assert 35 not in left and 4 in left and not {36, 37, 38, 39, 41} & set(left)
    sets = {k: shingles(t) for k, t in left.items()}
    top = classes(left, lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    left = {k: t for k, t in left.items() if top[k] == k}
    assert 33 in left and 34 not in left
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for k, n in copies(left, sources).items():
        ids = np.array([*tokenizer.encode(left[k], add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += n
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == +want
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 2048


def test_pipeline_without_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
