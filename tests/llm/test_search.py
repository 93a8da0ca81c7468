"""Vector searches and URL filters against brute force."""

import math

import numpy as np

from vitalframe.llm import ann, queries, topk, url_filters
from vitalframe.llm.common import table

ODD = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (9, [-1.0, 0.2]), (10, [1.0]), (100, [1.0, 2.0, 3.0])]


def odd(spark):
    v = spark.createDataFrame(ODD, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "2 as cell", "3 as score")
    return v, v.filter("vec_id % 50 = 0")


def exact(rows, k, score):
    out = set()
    for q, x in rows:
        if q % 50 == 0:
            best = sorted((-score(x, y), i) for i, y in rows if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_inner_products_are_exact(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in vectors.collect()]
    found = topk.top_inner_products(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    assert {tuple(r) for r in found} == exact(rows, 5, lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)))


def test_graph_search_finds_the_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect()]
    want = exact(rows, 5, lambda x, y: round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9))
    found = ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), shard_rows=128).collect()
    hits = {(r.query_id, r.vec_id) for r in found} & {(q, i) for q, _, i, _ in want}
    assert len(hits) >= 0.9 * len(want)
    scores = dict(rows)
    for r in found:
        x, y = scores[r.query_id], scores[r.vec_id]
        assert abs(r.score - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-9


def test_odd_vectors(spark):
    vectors, asked = odd(spark)
    out = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(vectors, asked, k=3).collect()}
    assert out == {(0, 1): 8, (0, 2): 50, (0, 3): 1, (50, 1): 0, (50, 2): 8, (50, 3): 1}
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_inner_products(vectors, asked, k=5).collect()}
    assert [out[0, r][0] for r in (1, 2, 3, 4, 5)] == [8, 50, 1, 2, 9] and out[0, 4][1] == 0
    for f in (ann.nearest, topk.top_inner_products):
        assert f(vectors.limit(0), asked.limit(0)).count() == 0
        assert f(vectors.filter("vec_id in (2, 3)"), asked).count() >= 0


def test_graph_search_in_a_shard_of_full_size(spark):
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(40, 24))[rng.integers(0, 40, ann.SHARD_ROWS)] + 0.5 * rng.normal(size=(ann.SHARD_ROWS, 24))
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    links, _, entry = ann.build(unit.astype(np.float32))
    asked = np.arange(0, ann.SHARD_ROWS, 50)
    nodes, score = ann.search(unit.astype(np.float32), links, entry, unit[asked].astype(np.float32), ann.EF_SEARCH)
    hits = 0
    for q, found, near in zip(asked, nodes, score, strict=True):
        mine = [i for i in found[np.argsort(-near)] if i != q][:5]
        hits += len(set(mine) & set(np.argsort(-np.where(np.arange(len(unit)) == q, -2, unit @ unit[q]))[:5]))
    assert hits >= 0.9 * 5 * len(asked)


def test_groups_fill_blocks():
    pivots = np.array([[0.0], [10.0], [1.0], [11.0], [2.0]])
    first, parts = topk.groups(pivots, {0: 3, 1: 4, 2: 3, 3: 4, 4: 25}, 10)
    assert parts == {0: 1, 2: 1, 4: 3, 1: 1, 3: 1}
    assert first[0] == first[2] == 0 and first[4] == 1 and first[1] == first[3] == 4
    assert topk.groups(pivots, {}, 10) == ({}, {})


def test_clusters_are_skipped(spark, monkeypatch):
    rng = np.random.default_rng(4)
    raw = 40 * rng.normal(size=(8, 8))[np.arange(4000) % 8] + 0.1 * rng.normal(size=(4000, 8))
    frame = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(raw)], "vec_id long, embedding array<double>")
    kept, sizes = topk.materialize, []
    monkeypatch.setattr(topk, "materialize", lambda df: sizes.append((df.columns, kept(df))) or sizes[-1][1])
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 8)
    found = topk.top_inner_products(frame, frame.filter("vec_id % 50 = 0")).collect()
    whole = np.floor(256 * raw).astype(np.int64)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == {
        (q, n, int(i), int(whole[q] @ whole[i])) for q in range(0, 4000, 50) for n, i in enumerate([i for i in np.lexsort((np.arange(4000), -(whole @ whole[q]))) if i != q][:5], 1)
    }
    sent = next(df for names, df in sizes if names == ["query_id", "v", "block", "cell"])
    cells = next(df for names, df in sizes if "away" in names).groupBy("cell").count()
    asked = sent.groupBy("query_id").count().count()
    pairs = sent.join(cells, "cell").agg({"count": "sum"}).first()[0]
    assert pairs < 0.5 * asked * 4000


def fits(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    mine = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(mine, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    extra = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com/en", "http://xexample.com/en/", "http://a.net/es/fr/", "http://net/fr/?q", "://com/", "http://com/", "http://a..com/", "http://ex.com./", "http://" + "a." * 50 + "com/" + "p" * 5000]
    rows = [(r.page_id, r.url) for r in pages.collect()] + [(None, u) for u in extra] + [(1, extra[3]), (1, extra[3])]
    frame = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as key", "2 as rule", "3 as path")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    found = url_filters.judge_urls(frame, rules).collect()
    assert sorted(map(str, [tuple(r) for r in found])) == sorted(map(str, [(i, *fits(u, queries.URL_RULES)) for i, u in rows]))
    bare = [("example.com", "", "block"), ("x.org", "/", "block"), ("org/x", "", "block"), ("org", "", "allow")]
    ends = [(1, "http://examplefoo.com/"), (2, "http://example.com"), (3, "http://a.example.com?q"), (4, "http://example.com.org/"), (5, "http://x.org/a"), (6, "http://xx.org/a")]
    judged = url_filters.judge_urls(spark.createDataFrame(ends, "page_id long, url string"), spark.createDataFrame(bare, rules.schema), ranges=3)
    assert {r.page_id: r.rule for r in judged.collect()} == {1: None, 2: "example.com", 3: "example.com", 4: "org", 5: "x.org/", 6: "org"}
    assert {r.verdict for r in url_filters.judge_urls(frame, rules.limit(0)).collect()} == {"allow"}
    assert url_filters.judge_urls(frame.limit(0), rules).count() == 0
