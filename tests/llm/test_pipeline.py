"""The pipeline against its stages' decisions taken one by one in plain Python."""

import corpus_pipeline
from vitalframe.llm import language_id, subwords, toxicity
from vitalframe.llm.common import id_remainder, table

from .test_near_dedup import brute


def test_rows_are_those_of_the_stages(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    terms, weights = toxicity.train(docs, labels.filter(id_remainder(labels.doc_id, 5) != 0))
    look = toxicity.Matches(toxicity.Automaton(terms))
    rows = [r for r in docs.collect() if toxicity._probabilities([r.text], look, weights)[1][0] < 0.5]
    kept = spark.createDataFrame(rows, docs.schema)
    names, model = language_id.train(kept.filter(id_remainder(kept.doc_id, 4) != 2))
    found = [(r, language_id.infer(r.text, model)) for r in rows]
    rows = [r for r, f in found if f and language_id.fits(r.text, model)]
    stay = {i for i, _, _, k in brute([(r.doc_id, r.text) for r in rows]) if k}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(stay)
    assert all(r.lossless for r in out)
    vocabulary, texts = subwords.Vocabulary(), {r.doc_id: r.text for r in rows}
    assert all(vocabulary.decode(r.ids) == texts[r.doc_id] for r in out)


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, repeated and empty rows, a very long text and an empty table go through all stages."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    clean = [r for r in docs.collect() if r.text and len(r.text.split()) > 40][:60]
    long = " ".join(r.text for r in clean)
    odd = [(None, None, None, None, None), (7, "", "en", "src0", 0), (7, clean[0].text, "en", "src0", 1), (7, clean[0].text, "en", "src0", 1), (5008, long, "en", None, 2), (5009, long + " more words at its end", None, "src1", 3), (None, clean[1].text, "en", "src1", 4)]
    rows = spark.createDataFrame([tuple(r) for r in docs.collect()] + odd, docs.schema)
    rows.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "a" / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    texts = {}
    for r in rows.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    vocabulary = subwords.Vocabulary()
    assert out and all(r.lossless and vocabulary.decode(r.ids) in texts[r.doc_id] for r in out)
    assert len({r.doc_id for r in out} & {5008, 5009}) == 1
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "b" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
