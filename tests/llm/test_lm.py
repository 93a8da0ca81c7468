import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from vitalframe.llm import lm
from vitalframe.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, modulus=10):
    """Every probability from plain counts: trigrams seen twice at least, interpolated with bigrams and single words."""
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)), None] for _, t in rows]
    fold = [None if i is None else zlib.crc32(str(i).encode()) % modulus for i, _ in rows]
    start = ("s",)
    one, two, three, types, contexts = Counter(), Counter(), Counter(), defaultdict(set), Counter()
    for t, f in zip(tokens, fold, strict=True):
        if f:
            for k, w in enumerate(t):
                h = t[k - 1] if k else start
                one[w] += 1
                two[h, w] += 1
                contexts[h] += 1
                types[h].add(w)
                if k:
                    three[t[k - 2] if k > 1 else start, h, w] += 1
    arcs = defaultdict(list)
    for (u, v, _), c in three.items():
        if c >= 2:
            arcs[u, v].append(c)
    n, v_ = sum(one.values()), len(one)

    def p0(w):
        return (one[w] + 0.1) / (n + 0.1 * (v_ + 1))

    def p1(v, w):
        c = contexts[v]
        return p0(w) if not c else max(two[v, w] - 0.75, 0) / c + 0.75 * len(types[v]) / c * p0(w)

    def p2(u, v, w):
        c = two[u, v]
        rest = 1 - sum(x - 0.75 for x in arcs[u, v]) / c if arcs[u, v] else 1.0
        return (three[u, v, w] - 0.75) / c * (three[u, v, w] >= 2) + rest * p1(v, w) if c else p1(v, w)

    out = []
    for (i, _), t, f in zip(rows, tokens, fold, strict=True):
        total = 0.0
        for k, w in enumerate(t):
            h = t[k - 1] if k else start
            total += math.log10(p2(t[k - 2] if k > 1 else start, h, w) if k else p1(h, w))
        out.append((i, f == 0, len(t), sum(one[w] > 0 for w in t), n, round(sum(math.log10(p0(w)) for w in t), 6), round(total, 6)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=str)


def test_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(lm.score(docs, block_bytes=40_000)) == brute(rows)
    assert got(lm.score(table(spark, sf_dir, "documents"), block_bytes=40_000, near="lang")) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "A\tb\x0bc a b"), (3, "A\tb\x0bc a b"), (4, "x y " * 3000), (5, "x y z " * 7000), (5, "x y z " * 7000), (5, "É  x"), (6, "a b c"), (7, "q"), (9007199254740993, "a b"), (-9007199254740995, "q a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "text as block", "1 as training")
    assert got(lm.score(docs, block_bytes=500)) == brute(rows)
    assert lm.score(docs.limit(0)).count() == lm.score(docs.limit(0), near="block").count() == 0
    assert got(lm.score(docs, block_bytes=500, near="training")) == got(lm.score(docs.selectExpr("doc_id", "text", "if(doc_id > 3, null, text) as n"), block_bytes=300, near="n")) == brute(rows)


def test_counts_of_any_size_are_packed():
    numbers = np.array([0, 254, 255, 256, 1 << 31, (1 << 32) - 1, 1 << 32, 3 << 40, 7], np.uint64)
    assert lm._unpack(lm._pack(numbers), len(numbers)).tolist() == numbers.tolist()


def test_held_out_texts_score_better_than_the_base(spark, sf_dir):
    r = lm.score(table(spark, sf_dir.replace("0.001", "0.01"), "documents")).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b


def test_hot_pairs_and_words_are_spread(spark, monkeypatch):
    rows = [(i, f"of the w{i % 7} of the w{i % 11} and so on {i}") for i in range(400)] + [(1000 + i, "of the") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert got(lm.score(docs, block_bytes=3000)) == expected
    hot = lm.WordHashes()[b"the"]
    frame = lm.Block([t for _, t in rows], np.ones(len(rows), bool), 64, np.array([hot], np.uint64))
    pairs = [row for row in frame.ask(0) if row[0] == lm._PAIR]
    assert len({row[1] for row in pairs}) == lm.SPREAD and all(np.frombuffer(row[3], np.uint64).tolist() == [hot] for row in pairs)
    monkeypatch.setattr(lm, "HOT_PAIR", 10)
    frame.triples(np.full(len(frame.pair_key), 50, np.uint64))
    spread = frame.asked_triples()
    assert len(spread.bare) == lm.SPREAD * (frame.pair_w != frame.end).sum()


def test_shortened_hashes():
    hashes = np.array([0, 1, (1 << 48) - 1, 1 << 63, 12345678901234567890], np.uint64)
    for size in (5, 6, 8):
        assert lm._from_short(lm._short(hashes, size), size).tolist() == lm._cut_to(hashes, size).tolist() if size < 8 else lm._from_short(lm._short(hashes, 8), 8).tolist() == hashes.tolist()


def test_probabilities_sum_to_one(spark):
    """Over all words that a context may have, known and one unknown."""
    texts = ["a b c", "a b c", "a b d", "b c a", "a b c d", "c a b"]
    base = [(i, t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    vocabulary = ["a", "b", "c", "d", "never"]
    ids = [i for i in range(100, 2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    asked = [(i, f"a b {w}") for i, w in zip(ids, vocabulary, strict=False)] + [(ids[10], "a b")]
    found = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(base + asked, "doc_id long, text string")).collect()}
    # P(a b w end) / P(end | b w) = P(a b w): read with and without the end by brute force of the same formula
    assert {i: round(found[i], 6) for i, _ in asked} == {r[0]: r[6] for r in brute(base + asked) if r[1]}
