"""The Jaccard join against comparing all pairs in Python."""

import random

import pytest

from vitalframe.llm import ngram_join
from vitalframe.llm.queries import op11_ngram_join

SCHEMA = "doc_id long, text string, n long, node string"


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    found = [(i, sets(t)) for i, t in rows]
    at = {i: i for i, _ in rows if i is not None}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for k, (i, x) in enumerate(found):
        for j, y in found[:k]:
            if x and y and i is not None and j is not None and (100 * len(x & y) >= 90 * len(x | y)):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return sorted(((i, len(x), None if i is None else root(i)) for i, x in found), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in ngram_join.join_components(df).collect()), key=str)


def edited(rnd, words, rate, vocabulary):
    return [rnd.choice(vocabulary) if rnd.random() < rate else w for w in words]


@pytest.mark.parametrize("seed", range(2))
def test_clusters_around_the_threshold(spark, seed):
    """Loose copies of a few texts, edited with few words, so that edits are shared, chains form and no level of pivots decides alone."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    few = [f"e{i}" for i in range(4)]
    rows = []
    for size, copies in ((300, 60), (80, 50), (25, 40), (10, 30)):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            text = edited(rnd, base, rnd.choice([0.005, 0.015, 0.03, 0.05]), few)
            cut = rnd.randint(0, max(1, size // 12))
            rows.append(" ".join(text[cut:] if rnd.random() < 0.3 else text))
    for _ in range(60):
        rows.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))))
    ids = rnd.sample(range(10_000), len(rows))
    rows = list(zip(ids, rows, strict=True))
    expected = brute(rows)
    assert run(spark, rows) == expected
    assert len({c for _, _, c in expected}) < len(rows) - 50


def test_every_pair_decided_in_the_last_level(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEVELS", 1)
    test_clusters_around_the_threshold(spark, 11)


def test_loose_copies_are_not_compared_with_each_other(spark, monkeypatch):
    """Copies too loose to link with the text they come from: their intersections are large, but what they differ in from it is not shared."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(240):
        text = list(base)
        for _ in range(rnd.randint(1, 6)):
            at = rnd.randrange(len(text) - 1)
            text[at : at + 2] = rnd.choice([[text[at + 1]], [text[at + 1], text[at]], [text[at] + rnd.choice("xyz"), text[at + 1]], [f"e{rnd.randint(0, 99999)}", text[at + 1]]])
        rows.append(" ".join(text))
    rows = list(enumerate([*rows, " ".join(base)]))
    compared = []
    beside = ngram_join._beside
    monkeypatch.setattr(ngram_join, "_beside", lambda pairs, sets: compared.append(pairs.count()) or beside(pairs, sets))
    assert run(spark, rows) == brute(rows)
    assert compared[-1] <= len(rows)


def test_shared_passage_and_chains(spark):
    rnd = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"a{rnd.randint(0, 9999)}" for _ in range(rnd.randint(2, 40))) + " " + passage) for i in range(150)]
    chain = [f"c{i}" for i in range(200)]
    rows += [(1000 + k, " ".join(chain[4 * k : 4 * k + 120])) for k in range(20)]
    rows += [(2000 - k, " ".join(chain[: 120 + 5 * k])) for k in range(16)]
    assert run(spark, rows) == brute(rows)


def test_nulls_short_and_long_texts_copies_and_repeated_ids(spark):
    long = " ".join(f"x{i % 7000}" for i in range(20_000))
    rows = [(5, None), (6, ""), (7, " \t\n "), (8, "One"), (9, "one"), (10, "one two"), (11, "ONE  two"), (None, "one"), (None, None), (3, "É a b"), (4, "é a b")]
    rows += [(20, long), (21, long + " tail"), (22, long)] + [(30, "same text every time here")] * 5 + [(29, "same text every time here"), (1, "same text every time HERE")]
    rows += [(50, "alpha beta gamma delta"), (50, "quite another text it is"), (49, "alpha beta gamma delta"), (48, "quite another text it is")]
    found = run(spark, rows)
    expected = [(50, n, 48) if i in (49, 50) or (i == 48) else (i, n, c) for i, n, c in brute(rows)]
    assert [(i, n, c) for i, n, c in found if i is None or i < 48] == [(i, n, c) for i, n, c in brute(rows) if i is None or i < 48]
    assert {(i, c) for i, _, c in found if i and i >= 48} == {(48, 48), (49, 48), (50, 48)} and len(found) == len(expected)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = op11_ngram_join(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
