"""Collocations against counting every phrase in Python."""

import random
import re
from collections import Counter

import pytest

from vitalframe.llm import collocations as col
from vitalframe.llm.queries import op12_phrase_collocations

SCHEMA = "text string, lang string, rank int"


def brute(rows, least, most=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        counts = f.setdefault(lang or "und", Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        longer = {}
        for g, a in counts.items():
            if len(g) > 2 and a >= least:
                for k in range(2, len(g)):
                    for i in range(len(g) - k + 1):
                        longer[g[i : i + k]] = max(a, longer.get(g[i : i + k], 0))
        found = []
        for g, a in counts.items():
            if len(g) > 1 and a >= least and 100 * longer.get(g, 0) < 80 * a:
                score, _, l, r = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def made(seed, texts=120):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "é", "É", "x\x00y", "san", "francisco", "bay", "area", "a b", "ß", "日本"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?", " \r\n", "\x1c"]
    rows = []
    for _ in range(texts):
        words = []
        for _ in range(rnd.randint(0, 60)):
            words += rnd.choice([["new", "york"], ["San", "francisco", "bay", "area"], [rnd.choice(vocabulary)]]) + []
        rows.append(("".join(w + rnd.choice(marks) for w in words), rnd.choice(["en", "en", "de", None])))
    return [*rows, (None, "en"), ("", None), (" . ", "fr"), ("Only", "it")]


@pytest.mark.parametrize("shard", [400, 1 << 25])
@pytest.mark.parametrize("least", [3, 30])
def test_against_brute_force(spark, monkeypatch, shard, least):
    monkeypatch.setattr(col, "SHARD_BYTES", shard)
    rows = made(shard + least)
    df = spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    found = sorted(tuple(r) for r in col.collocations(df, least).collect())
    assert found == brute(rows, least) and found


def test_full_filter_ties_and_short_lists(spark, monkeypatch):
    monkeypatch.setattr(col, "MOST_BITS", 6)  # every bit is soon set: nothing is pruned
    rows = made(7)
    df = spark.createDataFrame([(t, g, 0) for t, g in rows], SCHEMA)
    assert sorted(tuple(r) for r in col.collocations(df, 3, most=5).collect()) == brute(rows, 3, 5)


def test_long_text_and_repeated_rows(spark):
    rows = [("red apple pie " * 60_000, "en")] + [("blue sky", "en")] * 40
    df = spark.createDataFrame([(t, g, 0) for t, g in rows], SCHEMA)
    assert sorted(tuple(r) for r in col.collocations(df).collect()) == brute(rows, 30)


def test_empty_table(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = op12_phrase_collocations(spark, "/root/testdata/sf0.001")
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 30)
