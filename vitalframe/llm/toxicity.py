"""Toxicity by a lexicon trie under Levenshtein automata, with context windows that set off quotations.

The lexicon and a small logistic model are learned from labelled texts. One automaton accepts every
term with its allowed edits: its states are sets of (trie node, edits so far), built on demand, so a
word is read once whatever the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import bounded, keep_by_text, materialize
from vitalframe.llm.near_dedup import K, signature
from vitalframe.llm.words import REMEMBERED, WordHashes, shingles, words

#: About as many labelled texts of each label are used; least texts of a term.
SAMPLE_TEXTS, LEAST_TEXTS = 5000, 5
#: Texts that share this part of their signatures are copies; signatures are met by as many coordinates at a time.
COPY, BAND = 0.6, 4
#: How many times likelier a term must be in toxic texts, and the least number of texts with it there, as a share of the toxic texts.
RATIO, LEAST_SHARE = 10.0, 0.005
#: Terms of this length on may differ by one edit.
FUZZY_LENGTH = 5
#: Words looked at on each side of a hit.
WINDOW = 6
_OPEN, _CLOSE = "\"'“„«‘‹`", "\"'”“»’›`"
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”„«»‘’‹›…–—¡¿"


class Automaton:
    """All terms within one edit (short ones exactly), as a deterministic automaton that grows on demand."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.allowed = [int(len(t) >= FUZZY_LENGTH) for t in terms]
        for k, word in enumerate(terms):
            at = 0
            for ch in word:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                at = self.children[at][ch]
            self.term[at] = k
        self.alphabet = {ch for node in self.children for ch in node}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, found: set) -> int:
        found |= {(child, 1) for node, edits in found if edits == 0 for child in self.children[node].values()}  # a letter left out
        key = frozenset((node, edits) for node, edits in found if edits == 0 or (node, 0) not in found)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        after = set()
        for node, edits in self.sets[state]:
            if ch in self.children[node]:
                after.add((self.children[node][ch], edits))
            if not edits:
                after.add((node, 1))  # a letter added
                after |= {(child, 1) for child in self.children[node].values()}  # a letter changed
        return self._state(after)

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term (index, edits) within its allowed edits."""
        state = self.start
        for ch in word:
            ch = ch if ch in self.alphabet else "\0"
            move = self.moves[state]
            if ch not in move:
                move[ch] = self._move(state, ch)
            state = move[ch]
            if not self.sets[state]:
                return None
        hits = [(edits, self.term[node]) for node, edits in self.sets[state] if self.term[node] >= 0 and edits <= self.allowed[self.term[node]]]
        return min(hits)[::-1] if hits else None


class Matches(dict):
    """The match of each word as it stands in a text, remembered up to a bound."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.automaton.match(word.strip(_EDGES))
        return found


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def quoted(found: list[str], at: int) -> bool:
    """Whether a quotation opens before or at word `at` and closes at or after it, inside the window."""
    left = found[max(0, at - WINDOW) : at + 1]
    opened = next((k for k in range(len(left) - 1, -1, -1) if left[k][0] in _OPEN or (k < len(left) - 1 and left[k].rstrip(".,;:!?")[-1:] in _CLOSE)), None)
    if opened is None or left[opened][0] not in _OPEN:
        return False
    return any(w.rstrip(".,;:!?)")[-1:] in _CLOSE for w in found[at : at + WINDOW + 1])


def features(text: str | None, look: Matches) -> list[float]:
    """Logs of one plus: exact hits, hits with an edit, hits inside quotations, hits close to another hit."""
    found = tokens(text)
    hits = [(i, m) for i, m in ((i, look[w]) for i, w in enumerate(found)) if m]
    exact = fuzzy = inside = dense = 0
    for k, (i, (_, edits)) in enumerate(hits):
        if quoted(found, i):
            inside += 1
            continue
        exact, fuzzy = exact + (not edits), fuzzy + bool(edits)
        dense += any(abs(j - i) <= WINDOW for j, _ in hits[max(0, k - 1) : k] + hits[k + 1 : k + 2])
    return [float(np.log1p(x)) for x in (exact, fuzzy, inside, dense)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def copy_groups(signs: np.ndarray) -> list[int]:
    """A group for each row of signatures: that of an earlier first member that it is a copy of, or a new one."""
    leaders: dict[tuple[int, bytes], list[int]] = {}
    firsts, groups = [], []
    for i, sign in enumerate(signs):
        keys = [(k, sign[k : k + BAND].tobytes()) for k in range(0, K, BAND)]
        near = sorted({g for key in keys for g in leaders.get(key, ())})
        same = (signs[[firsts[g] for g in near]] == sign).sum(axis=1) if near else np.empty(0)
        if len(same) and same.max() >= COPY * K:
            groups.append(near[int(same.argmax())])
            continue
        groups.append(len(firsts))
        for key in keys:
            leaders.setdefault(key, []).append(len(firsts))
        firsts.append(i)
    return groups


def _shingle_key(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, int]:
    """The shingles of a text and a hash of their set."""
    found = shingles(hashes.of(words(text)))
    return found, int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, key = _shingle_key(text, hashes)
            if len(found):
                rows.append((key, toxic, signature(found).tobytes()))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["key", "toxic", "sign"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Lexicon and logistic weights from docs (doc_id, text) and labels (doc_id, toxic 0/1).

    Fitted on a bounded sample: about SAMPLE_TEXTS labelled ids of either label, picked by a hash of
    doc_id. Only these ids are broadcast; only one signature a sampled text, the terms over the thresholds
    (a share of the toxic texts each, so they are bounded) and five numbers a sampled text reach the driver.
    A term's texts are counted with copies as one: of texts of a label with near-equal sets of shingles one
    counts for a word, so that copies of one toxic text do not make terms of all its words, while texts
    of their own that share a phrase all count. Without texts of both labels: no terms and a score of
    the share of toxic labels.
    """
    labels = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return [], np.array([0.0, 0.0, 0.0, 0.0, 4.0 if 1 in sizes else -4.0])
    rate = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_TEXTS / sizes[1])).otherwise(min(1.0, SAMPLE_TEXTS / sizes[0]))
    picked = labels.filter(F.xxhash64(F.col("doc_id"), F.lit("toxic")).bitwiseAND(F.lit((1 << 30) - 1)) < rate * float(1 << 30))
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))
    signed = sample.mapInArrow(_signed, "key long, toxic int, sign binary").groupBy("key", "toxic").agg(F.min("sign").alias("sign"))
    group: dict[tuple[int, int], int] = {}
    texts = {}
    rows = sorted(signed.collect())
    for label in (0, 1):
        part = [r for r in rows if r["toxic"] == label]
        found = copy_groups(np.array([np.frombuffer(r["sign"], np.uint64) for r in part]).reshape(-1, K))
        group |= {(label, r["key"]): g for r, g in zip(part, found, strict=True)}
        texts[label] = len(set(found))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = group.get((toxic, _shingle_key(text, hashes)[1]))
                rows += [(word, one, toxic) for word in {w.strip(_EDGES) for w in tokens(text)} if word]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names=["word", "copies", "toxic"])

    ratio = ((F.col("t") + 0.5) / (texts[1] + 1)) / ((F.col("c") + 0.5) / (texts[0] + 1))
    found = (
        sample.mapInArrow(occurrences, "word string, copies long, toxic int").distinct()
        .groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .filter((F.col("t") >= max(LEAST_TEXTS, LEAST_SHARE * texts[1])) & (ratio >= RATIO))
        .select("word").collect()
    )
    terms = sorted(r["word"] for r in found)
    automaton = Automaton(terms)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Matches(automaton)
        for batch in batches:
            rows = np.array([features(t, look) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*[pa.array(rows[:, k]) for k in range(4)], batch.column(1).cast(pa.int64())], names=["f0", "f1", "f2", "f3", "toxic"])

    data = sample.mapInArrow(measured, "f0 double, f1 double, f2 double, f3 double, toxic long").toPandas().to_numpy(float)
    if not len(data):
        return terms, np.array([0.0, 0.0, 0.0, 0.0, -4.0])
    return terms, logistic(data[:, :4], data[:, 4])


def _probabilities(texts: list[str | None], look: Matches, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([features(t, look) for t in texts]).reshape(-1, 4)
    return rows, 1 / (1 + np.exp(-np.clip(rows @ weights[:4] + weights[4], -30, 30)))


def without_toxic(docs: DataFrame, terms: list[str], weights: np.ndarray) -> DataFrame:
    """The rows of docs that score below 0.5, columns unchanged."""
    automaton = Automaton(terms)

    def judge():
        look = Matches(automaton)
        return lambda texts: _probabilities(texts, look, weights)[1] < 0.5

    return keep_by_text(docs, judge)


def score(docs: DataFrame, terms: list[str], weights: np.ndarray) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, score (0 to 1), predicted (1 from 0.5 on), hits.

    A null or empty text gets the score of a text without hits. All rows are kept.
    """
    automaton = Automaton(terms)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Matches(automaton)
        for batch in batches:
            rows, p = _probabilities(batch.column(1).to_pylist(), look, weights)
            hits = np.rint(np.expm1(rows[:, :3]).sum(axis=1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(hits)], names=["doc_id", "score", "predicted", "hits"]
            )

    return bounded(docs.select("doc_id", "text")).mapInArrow(scored, "doc_id long, score double, predicted int, hits long")
