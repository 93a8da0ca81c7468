"""Language ID and toxicity: held-out accuracy and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from vitalframe.llm import language_id, queries, toxicity
from vitalframe.llm.common import table

ODD = [(None, "der die das"), (1, None), (2, ""), (3, "12 34 !?"), (4, "the cat and the dog " * 5000), (4, "the cat"), (5, "你好")]


@pytest.fixture(scope="module")
def data(sf_dir):
    return sf_dir.replace("0.001", "0.01")


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' as lang", "1 as score", "2 as toxic")


def test_language_of_held_out_texts(spark, data):
    found = queries.op7_language_id(spark, data).join(table(spark, data, "documents").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.95


def test_mixture_of_two_languages(spark, data):
    docs = table(spark, data, "documents")
    names, model = language_id.train(docs)
    texts = {r.lang: r.text for r in docs.filter("length(text) between 400 and 3000 and lang in ('en', 'de')").orderBy("doc_id").collect()}
    chosen, share = language_id.infer(texts["en"] + " " + texts["de"], model)
    assert {"en", "de"} <= {names[k] for k in chosen}


def test_clean_texts_of_one_or_three_languages_stay(spark, data):
    docs = table(spark, data, "documents")
    names, model = language_id.train(docs)
    rows = docs.filter("length(text) between 400 and 3000 and lang in ('en', 'de', 'fr')").orderBy("doc_id").collect()
    texts = {r.lang: r.text[:400] for r in rows}
    pieces = [w for r in rows[:40] for w in (r.text[:25], r.text[25:60])]
    for text in pieces:
        found = language_id.infer(text, model)
        assert found is None or len(found[0]) > 1 or found[1].max() == 1.0 == found[1].sum()
    three = " ".join(texts[k] for k in ("en", "de", "fr"))
    chosen, share = language_id.infer(three, model)
    assert len(chosen) == 3 and share.max() < 0.5
    odd = [(1, "A.\nAll rights reserved."), (2, three), (3, "你好 世界 你好 世界"), (4, "zqxj kvvq wzzx qqjk xxvz"), (5, texts["en"][:60] + " 2353820953013749 4550997810720808 9dd3c80004c73dc9e548fee51b23b527780d4f20")]
    kept = language_id.with_language(spark.createDataFrame(odd, "doc_id long, text string"), names, model)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 5}


def test_any_number_of_languages(spark):
    rng = random.Random(5)
    spoken = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)] for k in range(150)}
    rows = [(i, " ".join(rng.choices(spoken[k], k=60)), k) for k in spoken for i in range(3)]
    names, model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == sorted(spoken)
    new = [(i, " ".join(rng.choices(spoken[k], k=40))) for i, k in enumerate(names)]
    found = language_id.identify(spark.createDataFrame(new, "doc_id long, text string"), names, model).collect()
    assert {r.doc_id: r.lang_pred for r in found} == dict(enumerate(names))


def test_language_odd_rows(spark, data):
    names, model = language_id.train(table(spark, data, "documents"))
    rows = language_id.identify(odd(spark), names, model).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    kept = language_id.with_language(odd(spark), names, model)
    assert kept.columns == odd(spark).columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    none = language_id.train(odd(spark).limit(0))
    assert {r.lang_pred for r in language_id.identify(odd(spark), *none).collect()} == {"und"}
    assert language_id.identify(odd(spark).limit(0), names, model).count() == 0


def test_toxicity_of_held_out_texts(spark, data):
    found = queries.op8_toxicity(spark, data).join(table(spark, data, "labels").select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null")
    rows = found.select("toxic", "predicted").collect()
    assert len(rows) > 30 and sum(r.toxic == r.predicted for r in rows) / len(rows) > 0.9


def test_terms_of_a_fixed_phrase_are_learned_and_words_of_copies_are_not(spark):
    rng = random.Random(3)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrt"]

    def text(*more):
        found = rng.choices(plain, k=40)
        at = rng.randrange(40)
        return " ".join([*found[:at], *more, *found[at:]])

    copied = text("garden", "window").split()
    rows = [(i, text("you", "utter", "nitwit"), 1) for i in range(60)]
    rows += [(100 + i, " ".join([*copied[:i], f"edit{i}", *copied[i + 1 :]]), 1) for i in range(30)]
    rows += [(200 + i, text("you", "utter") if i % 2 else text(), 0) for i in range(100)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms, weights = toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    assert terms == ["nitwit"]
    new = spark.createDataFrame([(1, text("you", "utter", "nitwit")), (2, text())], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(new, terms, weights).collect()} == {1: 1, 2: 0}


def test_all_terms_over_the_thresholds_are_kept(spark):
    bad = [f"bad{k}x" for k in range(1200)]
    rows = [(i, " ".join(random.Random(i).sample(bad, 1200)), 1) for i in range(12)] + [(50 + i, f"good day {i}", 0) for i in range(12)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic"))[0]) == 1200


def test_automaton_finds_one_edit(spark):
    a = toxicity.Automaton(["villain", "fool"])
    assert a.match("villain") == (0, 0) and a.match("vilain") == (0, 1) and a.match("villlain") == (0, 1) and a.match("vollain") == (0, 1)
    assert a.match("volain") is None and a.match("fol") is None and a.match("") is None and a.match("fool") == (1, 0)


def test_quotation_counts_apart():
    look = toxicity.Matches(toxicity.Automaton(["villain"]))
    plain, quoted = toxicity.features("you are a villain", look), toxicity.features('they said "a villain" and left', look)
    assert plain[0] > 0 and plain[2] == 0 and quoted[0] == 0 and quoted[2] > 0


def test_toxicity_odd_rows(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    terms, weights = toxicity.train(docs, labels)
    rows = toxicity.score(odd(spark), terms, weights).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.predicted for r in rows if r.doc_id in (1, 2)} == {0}
    kept = toxicity.without_toxic(odd(spark), terms, weights)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    assert toxicity.train(docs, labels.limit(0))[0] == [] and toxicity.score(odd(spark).limit(0), terms, weights).count() == 0
