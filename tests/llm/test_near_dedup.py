import random
import re

from vitalframe.llm import near_dedup
from vitalframe.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def got(docs):
    return sorted(tuple(r) for r in near_dedup.near_duplicates(docs).collect())


def test_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_and_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [(10 + k, " ".join(base[:k * 3] + [f"x{i}" for i in range(k * 3)] + base[k * 3 :])) for k in range(4)]
    edits = [(20 + k, " ".join(base[: 58 - k] + [f"e{k}"])) for k in range(6)]
    rows = [(1, None), (2, ""), (3, "  "), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, "a b c d e " * 3000), *chain, *edits]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key", "3 as rep", "4 as sig")
    assert got(docs) == brute(rows)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_kept_rows_keep_their_columns(spark):
    rows = [(None, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3), (2, "a b c d e f", 4), (3, "q", 5), (3, "q", 6), (4, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = near_dedup.without_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "None"]


def test_texts_of_repeated_ids_stay(spark):
    """A text that is a copy of nothing stays, whatever other rows share its doc_id; of equal rows the first stays."""
    text, other, third = "a b c d e f g", "quite another text of seven words here", "and one more of this kind it is"
    rows = [(1, text, 1), (5, text, 2), (5, other, 3), (7, third, 4), (7, "words " * 9, 5), (7, third, 6), (8, third + "  ", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    assert sorted(r.digest for r in near_dedup.without_near_duplicates(docs).collect()) == [1, 3, 4, 5]
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {(1, 3, 1, True), (5, 3, 1, False), (5, 3, 5, True), (7, 4, 7, True), (7, 1, 7, True), (8, 4, 7, False)}


def test_shared_edits_around_one_text(spark):
    """Loose copies with few kinds of edits, of several lengths: linked and unlinked pairs on both sides of the band of sizes."""
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(150):
        words = [rnd.choice(["e0", "e1", "e2"]) if rnd.random() < rnd.choice([0.01, 0.03, 0.06]) else w for w in base]
        rows.append((i, " ".join(words[: rnd.choice([160, 150, 125, 118, 90])])))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
