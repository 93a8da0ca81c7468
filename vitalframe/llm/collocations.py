"""Phrase collocations from word-id suffix arrays.

A task cuts its texts into shards. Within a shard and language, words become ids and prefix doubling (ranks of
single words, of pairs, of pairs of pairs) sorts all suffixes by their first four words. Where neighbours in that
order share n words they lie in one LCP interval, and the length of an interval is the count of its n-gram in the shard.
Counts of the shards meet by key.

Most n-grams are rare, so the corpus is read twice. First the intervals of depth two are added up by 64-bit hash. Pairs
that occur often enough set bits of a filter of bounded size, which every task gets; the second reading sends only
n-grams whose pairs all pass, now as text, so the counts that matter are exact. A full filter lets more pass and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.llm.common import bounded, materialize
from vitalframe.llm.words import mixed, slices

#: Bytes of text of a shard, longest phrase in words, and the filter's size: at least 16 bits a frequent pair up to 2**MOST_BITS bits (16 MB).
SHARD_BYTES, LONGEST, MOST_BITS, PROBES = 14 << 20, 4, 27, 3
#: Slices into which the candidates of a language are dealt before its list is cut.
SLICES = 64

_BREAK = b"\xff"
_MAP = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", _BREAK * 10 + b" ")


class Shard:
    """Word ids of one language's texts in a shard (0: the end of a piece) and its distinct words."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.known: dict[bytes, int] = {_BREAK: 0}

    def add(self, texts: list[str]) -> None:
        data = b"".join(t.encode("utf-8", "surrogatepass").lower().translate(_MAP) + _BREAK for t in texts)
        found, known = data.replace(_BREAK, b" \xff ").split(), self.known
        for word in set(found):
            known.setdefault(word, len(known))
        self.ids.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))

    def finish(self) -> None:
        self.words = list(self.known)
        self.r1 = np.concatenate([*self.ids, np.zeros(LONGEST, np.int32)])
        ends = np.flatnonzero(self.r1 == 0)
        at = np.arange(len(self.r1))
        self.left = (ends[np.searchsorted(ends, at)] - at).astype(np.int32)  # words up to the end of the piece
        self.ids, self.known = [], {}

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first occurrence of each distinct pair of words, and counts: the intervals of depth two."""
        at = np.flatnonzero(self.left >= 2)
        _, first, counts = np.unique(self.r1[at] * np.int64(len(self.words)) + self.r1[at + 1], return_index=True, return_counts=True)
        return at[first], counts

    def intervals(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n from 1 to LONGEST: n, and the place of one occurrence and the count of each distinct n-gram."""
        size = len(self.r1) - LONGEST
        if size <= 0:
            return
        distinct, r2 = np.unique(self.r1[:-1] * np.int64(len(self.words)) + self.r1[1:], return_inverse=True)
        r4 = r2[:-2] * np.int64(len(distinct)) + r2[2:]
        del distinct
        order = np.argsort(r4[:size], kind="stable")  # the suffix array, to a depth of four words
        a, b = order[:-1], order[1:]
        one, two = self.r1[a] == self.r1[b], r2[a] == r2[b]
        lcp = one.astype(np.int8) + two + (two & (self.r1[a + 2] == self.r1[b + 2])) + (r4[a] == r4[b])
        for n in range(1, LONGEST + 1):
            starts = np.concatenate([[0], np.flatnonzero(lcp < n) + 1])
            counts, place = np.diff(np.append(starts, size)), order[starts]
            whole = self.left[place] >= n
            yield n, place[whole], counts[whole]

    def pair_hashes(self, lang: bytes, at: np.ndarray) -> np.ndarray:
        """64-bit hashes of the pairs of words at these places."""
        seed = xxhash.xxh3_64_intdigest(lang)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        return mixed(hashes[self.r1[at]] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.r1[at + 1]])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """Shards of (lang, text) rows: each ends after about SHARD_BYTES of text; a longer text stands alone."""
    open_, size = {}, 0

    def closed() -> Iterator[tuple[str, Shard]]:
        for lang in list(open_):
            shard = open_.pop(lang)
            shard.finish()
            yield lang, shard

    for batch in slices(batches):
        if size and size + batch.nbytes > SHARD_BYTES:
            yield from closed()
            size = 0
        size += batch.nbytes
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            open_.setdefault(lang, Shard()).add([t for x, t in zip(langs, texts, strict=True) if x == lang])
    yield from closed()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, shard in _shards(batches):
        at, counts = shard.pairs()
        found = shard.pair_hashes(lang.encode("utf-8", "surrogatepass"), at)
        for i in range(0, len(at), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 18)].view(np.int64)), pa.array(counts[i : i + (1 << 18)])], names=["h", "n"])


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mixed(h + np.uint64((i + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) & np.uint64(bits - 1) for i in range(PROBES)]


def pair_filter(keys: DataFrame) -> np.ndarray:
    """A filter of 64-bit words in which the keys (h long) have their PROBES bits set; at most 2**MOST_BITS bits."""
    bits = 1 << min(MOST_BITS, max(12, (16 * keys.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(h, bits)).view(np.int64))], names=["p"])

    words = keys.mapInArrow(places, "p long").groupBy(F.shiftright("p", 6).alias("w"))
    set_ = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[set_.column("w").to_numpy()] = set_.column("b").to_numpy().view(np.uint64)
    return out


def _passes(found: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for p in _places(h, 64 * len(found)):
        ok &= (found[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, f): all words and phrases of k = 1 to LONGEST words with f >= least occurrences in a language, and k = 0 with the number of its words."""
    rows = bounded(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    pairs = rows.mapInArrow(_pairs, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    frequent = docs.sparkSession.sparkContext.broadcast(pair_filter(materialize(pairs.select("h"))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches):
            inside = np.flatnonzero(shard.left >= 2)
            ok = np.zeros(len(shard.r1), bool)
            ok[inside] = _passes(frequent.value, shard.pair_hashes(lang.encode("utf-8", "surrogatepass"), inside))
            text = ["", *(w.decode("utf-8", "surrogatepass") for w in shard.words[1:])]
            total = int((shard.r1 > 0).sum())
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([total], pa.int64())], names=["lang", "k", "phrase", "f"])
            for n, at, counts in shard.intervals():
                keep = np.ones(len(at), bool)
                for i in range(n - 1):
                    keep &= ok[at + i]
                at, counts = at[keep], counts[keep]
                for i in range(0, len(at), 1 << 16):
                    part = at[i : i + (1 << 16)]
                    phrases = [" ".join([text[w] for w in row]) for row in shard.r1[part[:, None] + np.arange(n)].tolist()] if n > 1 else [text[w] for w in shard.r1[part].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array(np.full(len(part), n, np.int32)), pa.array(phrases), pa.array(counts[i : i + (1 << 16)])], names=["lang", "k", "phrase", "f"]
                    )

    found = rows.mapInArrow(counted, "lang string, k int, phrase string, f long")
    return materialize(found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0)))


def _part(first: int | Column, count: Column) -> Column:
    return F.concat_ws(" ", F.slice("w", first, count))


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, share: int = 80) -> DataFrame:
    """The first `most` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    docs: (text, lang). Texts, A-Z lower-cased, are cut at . , ; : ! ? and line ends into pieces and these at spaces and tabs into
    words. Candidates are phrases of 2 to 4 words with a >= least occurrences; the score is the smallest of
    floor(2000000 a / (l + r)) over the cuts of the phrase into two parts with l and r occurrences (ties: the
    first cut). A candidate inside a longer one with 100 f >= share * a is dropped. Order: score and a
    descending, then phrase by its bytes. A null text is empty, a null lang is `und`, repeated rows count each
    time, other columns are ignored, and an empty table gives no rows. A text of any length is counted whole.
    """
    counts = phrase_counts(docs, least)
    parts = counts.filter("k > 0").select("lang", "phrase", "f")
    grams = counts.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cut = F.col("cut")
    cuts = grams.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(1, cut).alias("left"), _part(cut + 1, F.col("k") - cut).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(20,0))"
    scored = cuts.withColumn("score", F.expr(f"cast((2000000 * {wide('a')}) div ({wide('l')} + {wide('r')}) as bigint)"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.concat_ws(" ", F.slice("w", i, n)))))
    inside = grams.filter("k > 2").select("lang", F.col("a").alias("f"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").filter(F.expr(f"longer is null or 100 * {wide('longer')} < {share} * {wide('a')}"))

    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    rank = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order))
    few = left.withColumn("rank", rank(F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))).filter(F.col("rank") <= most)
    few = few.withColumn("rank", rank()).filter(F.col("rank") <= most)
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return few.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
