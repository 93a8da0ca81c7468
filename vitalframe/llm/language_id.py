"""Language ID by mixture inference: EM over n-gram likelihoods, language set by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import bounded, keep_by_text

#: N-grams of three bytes go to this many buckets.
BUCKETS = 1 << 15
#: About as many training texts are used of each language; so many counts are held before a task hands them on.
SAMPLE_TEXTS, HELD = 3000, 2_000_000
#: N-grams overlap, so this share of their log-likelihood counts as evidence; PENALTY nats and half the log of their number per language.
EVIDENCE, PENALTY = 1 / 3, 6.0
UNKNOWN = "und"


class Model:
    """Smoothed n-gram probabilities of any number of languages, held by bucket for the pairs that occur."""

    def __init__(self, buckets: np.ndarray, languages: np.ndarray, counts: np.ndarray, size: int):
        order = np.lexsort((languages, buckets))
        totals = 0.5 * BUCKETS + np.bincount(languages, counts, size)
        self.rare = 0.5 / totals
        self.languages = languages[order].astype(np.int32)
        self.values = (counts[order] + 0.5) / totals[self.languages]
        self.starts = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))

    def __len__(self) -> int:
        return len(self.rare)

    def of(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The languages with an n-gram among these buckets (all if none has), and the probabilities of the buckets in them, a column each."""
        first, sizes = self.starts[seen], self.starts[seen + 1] - self.starts[seen]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found = np.unique(self.languages[at])
        if not len(found):
            found = np.arange(len(self))
        p = np.repeat(self.rare[None, found], len(seen), axis=0)
        p[np.repeat(np.arange(len(seen)), sizes), np.searchsorted(found, self.languages[at])] = self.values[at]
        return found, p


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's byte 3-grams, lower-cased and framed by spaces, and their counts."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    bins = np.bincount((code * np.uint32(2654435769)) >> np.uint32(32 - 15), minlength=BUCKETS)
    seen = bins.nonzero()[0]
    return seen, bins[seen].astype(np.float64)


def proportions(p: np.ndarray, n: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, float]:
    """EM for the shares of the columns of p (n-gram by language) in counts n: shares and log-likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    if p.shape[1] > 1:
        total = n.sum()
        for _ in range(rounds):
            share = share * (p.T @ (n / (p @ share))) / total
    return share, float(n @ np.log(p @ share))


def infer(text: str | None, model: Model) -> tuple[list[int], np.ndarray] | None:
    """Chosen languages, largest share first, and the shares of all (0 for those not chosen); None without a letter or a model."""
    found = evidence(text, model)
    return found and found[:2]


def fits(text: str | None, model: Model) -> bool:
    """Whether the chosen languages together explain the text, or enough of it that numbers, keys and the like may be the rest.

    Their mixture, alone or with a part of equally frequent n-grams beside it, is held against equally
    frequent n-grams only; with such a part by the same penalised likelihood that chooses languages.
    """
    found = evidence(text, model)
    if found is None:
        return False
    ratio, n = found[2] * BUCKETS, found[3]
    if n @ np.log(ratio) > 0:
        return True
    _, gain = proportions(np.column_stack([ratio, np.ones(len(ratio))]), n)
    return bool(EVIDENCE * gain > PENALTY + 0.5 * np.log(n.sum()))


def evidence(text: str | None, model: Model) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray] | None:
    """As infer, with the probabilities of the text's n-grams under the chosen mixture, and their counts."""
    if not text or not len(model) or not any(map(str.isalpha, text)):
        return None
    seen, n = ngram_counts(text)
    found, p = model.of(seen)
    order, _ = proportions(p, n)
    chosen = [int(np.argmax(n @ np.log(p)))]
    part, best = proportions(p[:, chosen], n)
    for k in np.argsort(-order, kind="stable"):
        if k in chosen:
            continue
        more, value = proportions(p[:, [*chosen, int(k)]], n)
        if EVIDENCE * (value - best) <= PENALTY + 0.5 * np.log(n.sum()):
            break
        chosen, best, part = [*chosen, int(k)], value, more
    share = np.zeros(len(model))
    share[found[chosen]] = part
    return sorted(map(int, found[chosen]), key=lambda k: -share[k]), share, p[:, chosen] @ part, n


def train(rows: DataFrame) -> tuple[list[str], Model]:
    """Languages and their smoothed n-gram probabilities from rows (doc_id, text, lang), however many languages there are.

    Fitted on a bounded sample: of each language about SAMPLE_TEXTS texts, picked by a hash of doc_id.
    Counts meet on Spark; the driver gets the n-grams that occur, at most BUCKETS numbers a language.
    """
    rows = rows.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.least(F.lit(1.0), SAMPLE_TEXTS / F.count(F.lit(1))).alias("rate")).toPandas()
    rates = dict(sorted(zip(sizes["lang"], sizes["rate"], strict=True)))
    names = list(rates)
    empty = np.empty(0, np.int64)
    if not names:
        return [], Model(empty, empty, np.empty(0), 0)
    table = rows.sparkSession.createDataFrame(
        pa.table({"lang": pa.array(names, pa.string()), "k": pa.array(range(len(names)), pa.int64()), "rate": pa.array(rates.values(), pa.float64())})
    )
    sample = rows.join(F.broadcast(table), "lang").filter(F.xxhash64(F.col("doc_id"), F.lit("lang")).bitwiseAND(F.lit((1 << 30) - 1)) < F.col("rate") * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def handed() -> pa.RecordBatch:
            code, where = np.unique(np.concatenate([empty, *codes]), return_inverse=True)
            total = np.bincount(where, np.concatenate([np.empty(0), *counts]), len(code))
            return pa.RecordBatch.from_arrays([pa.array(code // BUCKETS), pa.array(code % BUCKETS), pa.array(total)], names=["k", "b", "n"])

        for batch in batches:
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, n = ngram_counts(text)
                codes.append(seen + k * BUCKETS)
                counts.append(n)
                held += len(seen)
                if held >= HELD:
                    yield handed()
                    codes, counts, held = [], [], 0
        yield handed()

    counted = sample.select("text", "k").mapInArrow(count, "k long, b long, n double").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    return names, Model(counted["b"].to_numpy(np.int64), counted["k"].to_numpy(np.int64), counted["n"].to_numpy(float), len(names))


def identify(docs: DataFrame, names: list[str], model: Model) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, lang_pred, score, languages (array of lang, share).

    score is the share of lang_pred in the text (0 to 1). A text that is null, empty or without a
    letter, or a model without languages, gives `und`, score 0 and no languages. All rows are kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, languages = [], [], []
            for text in batch.column(1).to_pylist():
                found = infer(text, held.value)
                best.append(names[found[0][0]] if found else UNKNOWN)
                score.append(min(1.0, float(found[1][found[0][0]])) if found else 0.0)
                languages.append([{"lang": names[k], "share": float(found[1][k])} for k in found[0]] if found else [])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(languages, kind)], names=["doc_id", "lang_pred", "score", "languages"]
            )

    return bounded(docs.select("doc_id", "text")).mapInArrow(predict, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def with_language(docs: DataFrame, names: list[str], model: Model) -> DataFrame:
    """The rows of docs whose text known languages explain, one or several together, columns unchanged.

    Texts without a letter, null ones included, and texts that no known language fits go.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return keep_by_text(docs, lambda: lambda texts: [fits(t, held.value) for t in texts])
