import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from vitalframe.llm import subwords
from vitalframe.llm.common import table

V = subwords.Vocabulary()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=subwords.MODEL)
PLAIN = subwords.Encoder(V, 0.0, 1)
VARIED = subwords.Encoder(V, 0.3, 1)


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_round_trip_of_any_text(text):
    for encoder in (PLAIN, VARIED):
        assert V.decode(encoder.encode(text).tolist()) == text


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="abcdehinorst  \n.é梦", max_size=120))
def test_without_dropout_equals_the_library(text):
    assert PLAIN.encode(text).tolist() == LIBRARY.encode(text)


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet="aehinrst \u2581\u68a6\U0001f600", min_size=1, max_size=60), st.integers(0, 99))
def test_both_agendas_agree(unit, salt):
    unit = " " + unit.replace(" ", "")
    key = subwords.mixed(subwords.mixed(np.array([salt], np.uint64) ^ np.uint64(1)))
    encoder = subwords.Encoder(V, 0.3, 1)
    outcome = encoder[unit]
    encoder._learn()
    assert encoder._worked_off(np.array([outcome]), key)[0].tolist() == encoder._long(unit, key)


def mix64(x):
    mask = (1 << 64) - 1
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & mask
    return x ^ x >> 33


def brute(text, salt, seed, rate):
    """Merge-dropout by the letter, one unit after the other; pieces and ids from the library."""
    gold, mask, out = 0x9E3779B97F4A7C15, (1 << 64) - 1, []
    rank = {LIBRARY.id_to_piece(k): -LIBRARY.get_score(k) for k in range(LIBRARY.get_piece_size()) if not LIBRARY.is_byte(k) and k > 2}
    for place, unit in enumerate(V.unit.findall(" " + text) if text else []):
        key = mix64(mix64((salt & mask) ^ seed) + place * gold & mask)
        symbols = ["\u2581" if c == " " else "\0" + c if c == "\u2581" else c for c in unit]
        passed, step = set(), 0
        while True:
            pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank and (sum(map(len, symbols[:i])), a, b) not in passed]
            if not pairs:
                break
            i = min(pairs)[1]
            word = mix64(key + (step // 4 + 1) * gold & mask)
            if (word >> 16 * (step % 4) & 0xFFFF) < int(rate * 65536):
                passed.add((sum(map(len, symbols[:i])), symbols[i], symbols[i + 1]))
            else:
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            step += 1
        for s in symbols:
            out += [LIBRARY.piece_to_id(s)] if s in rank else [LIBRARY.piece_to_id(f"<0x{b:02X}>") for b in s[-1].encode()]
    return out


def test_query_with_dropout_against_brute_force(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").filter("length(text) < 1500")
    odd = spark.createDataFrame([(None, "a\u2581 b"), (-7, "antidisestablishmentarianistically " * 3), (-2, "x" * 90), (-3, "a b " * 9)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd).selectExpr("*", "1 as salt2", "'x' as ids")
    salts = {(r.doc_id, r.text): r.s for r in both.selectExpr("doc_id", "text", "xxhash64(17, doc_id) s").collect()}
    rows = both.join(subwords.encode_documents(both, dropout=0.3).withColumnRenamed("ids", "found"), "doc_id").collect()
    assert len(rows) > 40
    for r in rows:
        assert r.found == (None if r.text is None else brute(r.text, salts[r.doc_id, r.text], 17, 0.3))


def test_occurrences_of_a_word_vary_inside_a_document():
    ids = subwords.Encoder(V, 0.3, 1).encode("international " * 400).tolist()
    words = "".join("|" + V.spelled[k].decode() for k in ids).split("| ")
    assert len(set(words)) > 8


def test_forgetting_changes_nothing(monkeypatch):
    text = "the transportation of international organisations 12345 " * 40
    full = subwords.Encoder(V, 0.3, 1)
    twice = [full.encode(text, 5).tolist(), full.encode(text, 5).tolist()]
    monkeypatch.setattr(subwords, "REMEMBERED_BYTES", 0)
    assert [subwords.Encoder(V, 0.3, 1).encode(text, 5).tolist()] * 2 == twice


def test_dropout_varies_by_seed_and_repeats_for_one():
    text = "the international organisation of transportation " * 5
    runs = {s: tuple(subwords.Encoder(V, 0.3, s).encode(text).tolist()) for s in range(4)}
    assert len(set(runs.values())) == 4
    assert runs[2] == tuple(subwords.Encoder(V, 0.3, 2).encode(text).tolist())
    assert len(runs[0]) > len(PLAIN.encode(text))


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, "a▁ b"), (1, None), (2, ""), (3, "x" * 30000), (3, "x" * 30000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    out = subwords.encode_documents(both)
    rows = out.collect()
    assert len(rows) == both.count() and all(r.lossless for r in rows)
    assert [r.ids for r in rows if r.doc_id == 1 and r.n_ids == 0] == [None]
    back = sorted(map(str, subwords.decode_documents(out).collect()))
    assert back == sorted(map(str, both.collect()))
    empty = subwords.encode_documents(odd.limit(0))
    assert empty.count() == 0
