"""Mixing and sharding: whole results, their laws, and odd rows."""

import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

from vitalframe.llm import mixing, sharding
from vitalframe.llm.common import table

ODD = [(None, "a", None), (None, "a", None), (1, None, "x"), (2, "", "x"), (3, "é" * 5000, "y"), (3, "é" * 5000, "y"), (4, "t", "")]


def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return docs.selectExpr("*", "1 as rank", "2 as slot", "'z' as block", "doc_id as _key", "text as _row")


def test_blocks_meet_their_release_times_and_deadlines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = mixing.mix(docs, block_rows=2).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert len({r.mix_position for r in rows}) == len(rows)
    slots = {r.slot: (r.source, r.block) for r in rows}
    assert sorted(slots) == list(range(len(slots)))


def test_shares_stay_within_one_block_of_the_weights(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', if(id % 4 = 1, 'b', 'c')) as source")
    rows = mixing.mix(docs, weights={"a": 0.5, "b": 0.3, "c": 0.2}, slots=10, block_rows=10).select("slot", "source").distinct().collect()
    order = [s for _, s in sorted((r.slot, r.source) for r in rows)]
    seen = Counter()
    for t, s in enumerate(order[:150], 1):  # the first source to run out does so after 200
        seen[s] += 1
        assert all(abs(seen[k] - w * t) < 1 for k, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


def brute_mix(rows, block_rows):
    """(doc_id, source, mix_position) by exact fractions, slot by slot: the released block with the earliest deadline, ties to the earlier source."""
    ranked = {}
    for i, s in rows:
        h = hashlib.md5(f"mix-1|{'null' if i is None else i}".encode()).hexdigest()
        ranked.setdefault(("n" if s is None else "s" + s), []).append((h, i, s))
    blocks = {k: -(-len(v) // block_rows) for k, v in ranked.items()}
    weight = {k: Fraction(len(v) ** 0.7) for k, v in ranked.items()}

    def slots_at(v):
        return sum(min(Fraction(blocks[k]), weight[k] * v) for k in blocks)

    window = {k: [(math.floor(slots_at(Fraction(j) / weight[k])), math.ceil(slots_at(Fraction(j + 1) / weight[k]))) for j in range(blocks[k])] for k in blocks}
    at, out = dict.fromkeys(sorted(blocks), 0), []
    for slot in range(sum(blocks.values())):
        k = min((k for k in at if at[k] < blocks[k] and window[k][at[k]][0] <= slot), key=lambda k: (window[k][at[k]][1], k))
        part = sorted(ranked[k], key=lambda r: (r[0], r[1] is not None, r[1]))[at[k] * block_rows : (at[k] + 1) * block_rows]
        out += [(i, s, slot * block_rows + n) for n, (_, i, s) in enumerate(part)]
        at[k] += 1
    return sorted(out, key=str)


def test_mixture_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = sorted(((r.doc_id, r.source, r.mix_position) for r in mixing.mix(docs, block_rows=3).collect()), key=str)
    assert found == brute_mix([tuple(r) for r in docs.collect()], 3)


def test_size_of_the_schedule_is_bounded(spark):
    assert mixing.block_size(0) == mixing.block_size(10**6) == 16 and mixing.block_size(10**12) == 10**6
    rows = 50_000_000_001
    assert -(-rows // mixing.block_size(rows)) <= mixing.MOST_BLOCKS
    dotted = spark.createDataFrame([(1, "t", "a", 5), (2, "u", "b", 6)], ["doc_id", "text", "source", "a.b"])
    assert mixing.mixed_documents(dotted).columns == dotted.columns and mixing.mixed_documents(dotted).count() == 2


def test_shares_of_many_small_sources_are_exact():
    sizes = {"big": 40000, **{f"t{i}": 300 + i for i in range(300)}}
    sources = [(k, n, Fraction(n**0.7)) for k, n in sizes.items()]
    total, seen = sum(w for _, _, w in sources), Counter()
    weights = {k: w / total for k, _, w in sources}
    plan = [r for batch in mixing.schedule(sources, 100, 10) for r in batch.to_pylist()]
    assert [r["slot"] for r in plan] == list(range(sum(-(-n // 10) for n in sizes.values())))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in plan)
    ends = min(-(-n // 10) / weights[k] for k, n in sizes.items())  # where the first source runs out
    for t, r in enumerate(plan[: int(ends)], 1):
        seen[r["_key"]] += 1
        if t % 97 == 0:
            assert all(abs(seen[k] - w * t) < 1 for k, w in weights.items())
    assert ends > 4000


def test_sources_of_weight_zero_come_last(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', 'c')) as source")
    rows = mixing.mix(docs, weights={"a": 1.0}, block_rows=10).select("slot", "source").distinct().collect()
    order = [s for _, s in sorted((r.slot, r.source) for r in rows)]
    assert order[:20] == ["a"] * 20 and all(Counter(order[20 : 20 + 2 * k]) == {"b": k, "c": k} for k in range(1, 21))


def test_mixing_odd_rows(spark):
    assert mixing.mix(odd(spark)).count() == len(ODD)
    kept = mixing.mixed_documents(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd(spark).collect()))
    assert mixing.mix(odd(spark).limit(0)).count() == 0


def test_shards_differ_by_one_row_and_match_the_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = sharding.stratified_shards(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8))
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    whole = Counter(r.source for r in rows)
    for v in by.values():
        found = Counter(r.source for r in v)
        assert all(abs(found[s] - n / 8) <= 1.5 for s, n in whole.items())


def test_sharding_odd_rows(spark):
    rows = sharding.stratified_shards(odd(spark)).collect()
    assert len(rows) == len(ODD) and {r["size"] for r in rows if r.doc_id == 1} == {1}
    assert {r.text_crc32 for r in rows if r.doc_id == 1} == {None} and {r["size"] for r in rows if r.doc_id == 3} == {10001}
    assert sharding.stratified_shards(odd(spark).limit(0)).count() == 0
