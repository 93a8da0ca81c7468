"""Language-model scores by a weighted backoff automaton over trigrams.

States are pairs of words, words, and a root; a text starts in the state of its start. A known trigram is an arc of a pair's
state, a known bigram one of a word's, and every word one of the root; each leads to the state of the longest known end of what
was read. Every state has a failure arc to the state of its last word, or to the root. Weights are log10 probabilities of absolute
discounting with interpolation: with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

    p(w | v)    = max(c(vw) - D, 0) / c(v) + f(v) p(w),           f(v)  = D types(v) / c(v)
    p(w | u, v) = (c(uvw) - D) / c(uv) + f(uv) p(w | v)            if c(uvw) >= 2, else f(uv) p(w | v)

where f(uv) is what the arcs of uv leave, so that all sums are one. Trigrams seen once are no arcs. A text is read once from left to right:
an arc is taken, or the failure arc and then another one, and the log-probabilities add up. The long texts of a block are read
in pieces side by side, each from the state that the two words before it lead to.

The model is never whole in one place. Documents are dealt into blocks of about BLOCK_BYTES. A block asks for the counts of
its own distinct words and bigrams; the asked keys, with the block's own training counts, meet by key, are added up over
all blocks, and the totals go back in the order asked. Then it asks for its trigrams whose two bigrams occur twice at least. The
answers are the block's part of the automaton. Whatever the hot word, a block asks once for it; what follows a frequent word or pair
is dealt over several parts. A message holds a key at least, so their number grows no faster than the input.
Words are 64-bit hashes; pairs are told apart by 40 bits in their part, and what follows
a word or pair by 32 bits of its own, after a frequent word by 40.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import id_remainder
from vitalframe.llm.words import WordHashes, mixed, words

#: Bytes of text of a block, discount, the constant of the one-word base, and the least count of a trigram's arc.
BLOCK_BYTES, DISCOUNT, ADD, LEAST = 11 << 20, 0.75, 0.1, 2
#: About so many documents are looked at for frequent words; a word with this share of them is dealt over SPREAD parts; most such words.
SAMPLE_DOCS, HOT_SHARE, SPREAD, MOST_HOT = 2000, 0.001, 16, 512
#: A pair that occurs so often is dealt over SPREAD parts. Words of a piece that is read beside others. Values of `near` that are told apart.
HOT_PAIR, PIECE, MOST_NEAR = 200_000, 1024, 500
END, START = np.uint64(1), np.uint64(2)
_WORD, _PAIR, _TRIPLE, _SUMS = 0, 1, 2, 3
_FULL = np.uint64(0xFFFFFFFF)
_K = np.uint64(0x9E3779B97F4A7C15)


def _pack(numbers: np.ndarray) -> bytes:
    """Small counts, mostly below 255, as a byte each; then the others as four bytes, and those that do not fit there as eight."""
    large = numbers[numbers >= 255].astype(np.uint64)
    return np.minimum(numbers, 255).astype(np.uint8).tobytes() + np.minimum(large, _FULL).astype(np.uint32).tobytes() + large[large >= _FULL].tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    numbers = np.frombuffer(data, np.uint8, n).astype(np.uint64)
    many = int((numbers == 255).sum())
    large = np.frombuffer(data, np.uint32, many, n).astype(np.uint64)
    large[large == _FULL] = np.frombuffer(data, np.uint64, offset=n + 4 * many) if len(data) > n + 4 * many else 0
    numbers[numbers == 255] = large
    return numbers


#: Bytes of a hash that are sent: of a word, of a pair that groups what follows it, and of an item inside its group, by kind of message.
_WORD_BYTES, _GROUP_BYTES, _ITEM_BYTES = 8, 5, {_WORD: 4, _PAIR: 5, _TRIPLE: 4}


def _short(hashes: np.ndarray, size: int) -> bytes:
    """The low bytes of hashes."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _from_short(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def _cut_to(hashes: np.ndarray, size: int) -> np.ndarray:
    return hashes & np.uint64((1 << 8 * size) - 1)


class Block:
    """The tokens of a block of documents as local ids, and its distinct bigrams. Ids follow the parts and hashes of the words, so bigrams sorted by id are in the order in which they are asked for."""

    def __init__(self, texts: list[str], training: np.ndarray, parts: int, hot: np.ndarray):
        flat = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        full = pc.greater(pc.binary_length(flat.flatten()), 0)
        found = flat.flatten().filter(full).dictionary_encode()
        upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        lengths = np.diff(upto[np.concatenate([[0], np.cumsum(pc.list_value_length(flat).to_numpy(zero_copy_only=False))])])
        hashes = np.array([START, END, *(xxhash.xxh3_64_intdigest(x) for x in found.dictionary.cast(pa.large_binary()).to_pylist())], np.uint64)
        indices = found.indices.to_numpy(zero_copy_only=False)
        del flat, full, found
        order = np.lexsort((hashes, hashes % np.uint64(parts)))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.parts, self.hash, self.start, self.end = parts, hashes[order], int(place[0]), int(place[1])
        self.is_hot = np.isin(self.hash, hot)
        self.sizes = lengths + 1
        self.last = np.cumsum(self.sizes) - 1
        self.first = self.last - lengths
        self.w = np.full(int(self.sizes.sum()), self.end, np.int32)
        inside = np.ones(len(self.w), bool)
        inside[self.last] = False
        self.w[inside] = place[indices + 2]
        self.training = np.repeat(training, self.sizes)
        self.training_texts = int(training.sum())
        h = np.empty_like(self.w)
        h[1:] = self.w[:-1]
        h[self.first] = self.start
        self.width = np.int64(len(self.hash))
        self.pair_key, pair_at = np.unique(h * self.width + self.w, return_inverse=True)
        self.pair_at = pair_at.astype(np.int32)
        self.pair_h, self.pair_w = (self.pair_key // self.width).astype(np.int32), (self.pair_key % self.width).astype(np.int32)

    def pair_hash(self, pairs: np.ndarray) -> np.ndarray:
        return mixed(self.hash[self.pair_h[pairs]] * _K + self.hash[self.pair_w[pairs]])

    def _plain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bigrams after words that are not hot; and for each part its first word and its first of these bigrams."""
        plain = np.flatnonzero(~self.is_hot[self.pair_h])
        words_ = np.searchsorted(self.hash % np.uint64(self.parts), np.arange(self.parts + 1, dtype=np.uint64))
        return plain, words_, np.searchsorted(self.pair_h[plain], words_)

    def ask(self, block: int) -> list[tuple]:
        """Messages for its words and what follows them; what follows hot words is dealt over several parts."""
        word_counts = np.bincount(self.w[self.training], minlength=len(self.hash))
        word_counts[self.start] = self.training_texts
        pair_counts = np.bincount(self.pair_at[self.training], minlength=len(self.pair_key))
        plain, words_, pairs = self._plain()
        out = []
        for p in np.flatnonzero(np.diff(words_)):
            ws, mine = slice(words_[p], words_[p + 1]), plain[pairs[p] : pairs[p + 1]]
            sizes = np.bincount(self.pair_h[mine] - words_[p], minlength=ws.stop - ws.start)
            counts = np.concatenate([word_counts[ws], pair_counts[mine]])
            out.append((_WORD, int(p), block, self.hash[ws].tobytes(), _pack(sizes), _short(self.hash[self.pair_w[mine]], _ITEM_BYTES[_WORD]), _pack(counts)))
        hot = np.flatnonzero(self.is_hot[self.pair_h])
        return out + self._hot_pairs().rows(block, pair_counts[hot])

    def _hot_pairs(self) -> Asked:
        hot = np.flatnonzero(self.is_hot[self.pair_h])
        return Asked(_PAIR, self.hash[self.pair_h[hot]], self.hash[self.pair_w[hot]], self.parts, np.ones(len(hot), bool))

    def told(self, answers: dict[tuple[int, int], tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of the words and of the bigrams, and how many different bigrams follow a word."""
        words_of, pairs_of, types = np.zeros(len(self.hash)), np.zeros(len(self.pair_key)), np.zeros(len(self.hash))
        plain, words_, pairs = self._plain()
        for p in np.flatnonzero(np.diff(words_)):
            ws, mine = slice(words_[p], words_[p + 1]), plain[pairs[p] : pairs[p + 1]]
            total, t, _ = answers[_WORD, int(p)]
            n = ws.stop - ws.start
            found = _unpack(total, n + len(mine))
            words_of[ws], pairs_of[mine], types[ws] = found[:n], found[n:], _unpack(t, n)
        totals, groups, t, _ = self._hot_pairs().told(answers)
        pairs_of[np.flatnonzero(self.is_hot[self.pair_h])] = totals
        for g, n in zip(groups, t, strict=True):
            types[np.flatnonzero(self.is_hot & (self.hash == g))] = n
        return words_of, pairs_of, types

    def triples(self, pair_totals: np.ndarray) -> None:
        """Find the distinct trigrams (pair before, word) whose two bigrams occur LEAST times at least, and where they stand."""
        often = pair_totals >= LEAST
        ok = often[self.pair_at]
        both = np.zeros(len(self.w), bool)
        both[1:] = ok[1:] & ok[:-1]
        both[self.first] = False
        at = np.flatnonzero(both)
        self.triple_key, place = np.unique(self.pair_at[at - 1] * self.width + self.w[at], return_inverse=True)
        self.triple_counts = np.bincount(place[self.training[at]], minlength=len(self.triple_key))
        self.triple_at = np.full(len(self.w), -1, np.int32)
        self.triple_at[at] = place
        self.triple_pair, self.triple_w = (self.triple_key // self.width).astype(np.int32), (self.triple_key % self.width).astype(np.int32)
        # A pair that none of them begins with is asked for all the same, without items, as it has a failure arc.
        self.alone = np.setdiff1d(np.flatnonzero(often & (self.pair_w != self.end)), self.triple_pair)
        self.hot_pair = pair_totals >= HOT_PAIR

    def asked_triples(self) -> Asked:
        return Asked(_TRIPLE, self._pair(self.triple_pair), self.hash[self.triple_w], self.parts, self.hot_pair[self.triple_pair], self._pair(self.alone), self.hot_pair[self.alone])

    def _pair(self, pairs: np.ndarray) -> np.ndarray:
        return _cut_to(self.pair_hash(pairs), _GROUP_BYTES)

    def ask_triples(self, block: int) -> list[tuple]:
        return self.asked_triples().rows(block, self.triple_counts)

    def told_triples(self, answers: dict[tuple[int, int], tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of the trigrams, and for each pair the arcs that begin with it and their occurrences."""
        totals, groups, types, sums = self.asked_triples().told(answers)
        pairs = np.concatenate([np.unique(self.triple_pair), self.alone]).astype(np.int64)
        at = np.searchsorted(groups, self._pair(pairs))
        arcs, kept = np.zeros(len(self.pair_key)), np.zeros(len(self.pair_key))
        arcs[pairs], kept[pairs] = types[at], sums[at]
        return totals.astype(float), arcs, kept


class Asked:
    """Items (hashes) of groups (hashes) that a block asks for, in the order in which they are sent, and groups that it asks for without items.

    A group goes to one part; the items of a hot one are dealt over SPREAD parts, which are all asked for it, so that what they say of the group can be added up.
    """

    def __init__(self, kind: int, group: np.ndarray, item: np.ndarray, parts: int, hot: np.ndarray, alone: np.ndarray | None = None, hot_alone: np.ndarray | None = None):
        self.kind = kind
        part = group % np.uint64(parts)
        part[hot] = (group[hot] + mixed(item[hot]) % np.uint64(SPREAD)) % np.uint64(parts)
        self.order = np.lexsort((group, part))
        self.part, self.group, self.item = part[self.order], group[self.order], item[self.order]
        spread = np.unique(group[hot]) if alone is None else np.unique(np.concatenate([group[hot], alone[hot_alone]]))
        bare = np.repeat(spread, SPREAD)
        bare_part = (bare + np.tile(np.arange(SPREAD, dtype=np.uint64), len(spread))) % np.uint64(parts)
        if alone is not None:
            bare, bare_part = np.concatenate([bare, alone[~hot_alone]]), np.concatenate([bare_part, alone[~hot_alone] % np.uint64(parts)])
        order = np.argsort(bare_part, kind="stable")
        self.bare, self.bare_part = bare[order], bare_part[order]

    def messages(self) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For each part that is asked: its number and slice, the distinct groups there, rising, and how many items each has."""
        for p in np.union1d(self.part, self.bare_part):
            a, b = np.searchsorted(self.part, [p, p + np.uint64(1)])
            groups, sizes = np.unique(self.group[a:b], return_counts=True)
            c, d = np.searchsorted(self.bare_part, [p, p + np.uint64(1)])
            every = np.union1d(groups, self.bare[c:d])
            all_sizes = np.zeros(len(every), np.int64)
            all_sizes[np.searchsorted(every, groups)] = sizes
            yield int(p), slice(int(a), int(b)), every, all_sizes

    def rows(self, block: int, counts: np.ndarray) -> list[tuple]:
        counts, size = counts[self.order], _WORD_BYTES if self.kind == _PAIR else _GROUP_BYTES
        return [(self.kind, part, block, _short(groups, size), _pack(sizes), _short(self.item[s], _ITEM_BYTES[self.kind]), _pack(counts[s])) for part, s, groups, sizes in self.messages()]

    def told(self, answers: dict[tuple[int, int], tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Totals of the items, in the block's own order; and of the distinct groups their hashes, how many items they have in all and with how many occurrences."""
        totals, groups_all, types, sums = np.zeros(len(self.order), np.uint64), [], [], []
        for part, s, groups, _ in self.messages():
            total, t, c = answers[self.kind, part]
            totals[s] = _unpack(total, s.stop - s.start)
            groups_all.append(groups)
            types.append(_unpack(t, len(groups)))
            sums.append(_unpack(c, len(groups)))
        back = np.empty(len(totals), np.uint64)
        back[self.order] = totals
        if not groups_all:
            return back, np.empty(0, np.uint64), np.empty(0), np.empty(0)
        groups, at = np.unique(np.concatenate(groups_all), return_inverse=True)
        add = lambda x: np.bincount(at, np.concatenate(x).astype(float), len(groups))
        return back, groups, add(types), add(sums)


_ASKED = "kind int, part int, block int, keys binary, sizes binary, items binary, counts binary"
_ASKED_NAMES = ["kind", "part", "block", "keys", "sizes", "items", "counts"]
_TOLD = "kind int, part int, block int, totals binary, types binary, sums binary, tokens long, distinct long"
_TOLD_NAMES = ["kind", "part", "block", "totals", "types", "sums", "tokens", "distinct"]


def _added(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, np.uint64)
    np.add.at(total, at, counts)
    return total


def _totals(asked: pd.DataFrame) -> pd.DataFrame:
    """Add up one part over all blocks that asked; answers keep each block's order. A part of words also tells its share of N and V."""
    kind, part = int(asked["kind"].iloc[0]), int(asked["part"].iloc[0])
    keys = [_from_short(x, _GROUP_BYTES if kind == _TRIPLE else _WORD_BYTES) for x in asked["keys"]]
    items = [_from_short(x, _ITEM_BYTES[kind]) for x in asked["items"]]
    words_ = [len(k) if kind == _WORD else 0 for k in keys]
    sizes = np.concatenate([_unpack(x, len(k)) for x, k in zip(asked["sizes"], keys, strict=True)]).astype(np.int64)
    counts = [_unpack(x, n + len(i)) for x, n, i in zip(asked["counts"], words_, items, strict=True)]
    key_cuts, cuts = np.cumsum([len(k) for k in keys])[:-1], np.cumsum([len(i) for i in items])[:-1]
    groups, group_at = np.unique(np.concatenate(keys), return_inverse=True)
    # An item is told apart within its group.
    owner = np.repeat(group_at, sizes)
    distinct, first, at = np.unique(mixed(groups[owner] * _K + np.concatenate(items)), return_index=True, return_inverse=True)
    total = _added(at, np.concatenate([c[n:] for c, n in zip(counts, words_, strict=True)]), len(distinct))
    owner = owner[first]
    kept = total >= (LEAST if kind == _TRIPLE else 1)
    types = np.bincount(owner[kept], minlength=len(groups))
    sums = _added(owner[kept], total[kept], len(groups)) if kind == _TRIPLE else np.zeros(len(groups), np.uint64)
    split = lambda values, index, where: np.split(values[index], where)
    word_totals = [np.empty(0, np.uint64)] * len(keys)
    rows = []
    if kind == _WORD:
        total_words = _added(group_at, np.concatenate([c[:n] for c, n in zip(counts, words_, strict=True)]), len(groups))
        word_totals = split(total_words, group_at, key_cuts)
        counted = total_words[groups != START]
        rows.append((_SUMS, part, -1, b"", b"", b"", int(counted.sum(dtype=np.uint64)), int((counted > 0).sum())))
    answers = zip(asked["block"], word_totals, split(total, at, cuts), split(types, group_at, key_cuts), split(sums, group_at, key_cuts), strict=True)
    rows += [(kind, part, b, _pack(np.concatenate([w, x])), _pack(t), b"" if kind == _WORD else _pack(c), None, None) for b, w, x, t, c in answers]
    return pd.DataFrame(rows, columns=_TOLD_NAMES)


def _by_part(told: pd.DataFrame) -> dict[tuple[int, int], tuple[bytes, bytes, bytes]]:
    return {(k, p): (x, t, c) for k, p, x, t, c in zip(told["kind"], told["part"], told["totals"], told["types"], told["sums"], strict=True)}


class Automaton:
    """The part of the model that a block needs: arcs and failure arcs with their weights.

    A state is 0 for the root, 1 + word, or 1 + words + pair. The arc of a state by a word is that of their key, which was looked up when the block's
    keys were sorted: a place in the texts knows its bigram and trigram by number.
    """

    def __init__(self, b: Block, words_: np.ndarray, pairs: np.ndarray, types: np.ndarray, triples: np.ndarray, arcs: np.ndarray, kept: np.ndarray, tokens: int, distinct: int):
        """words_, pairs, triples: totals; types: bigrams after a word; arcs, kept: arcs after a pair and their occurrences."""
        self.b, self.words = b, len(b.hash)
        p0 = (words_ + ADD) / (tokens + ADD * (distinct + 1))
        seen = np.maximum(words_, 1.0)
        fail1 = np.where((words_ > 0) & (types > 0), DISCOUNT * types / seen, 1.0)
        p1 = np.maximum(pairs - DISCOUNT, 0) * (pairs > 0) / seen[b.pair_h] + fail1[b.pair_h] * p0[b.pair_w]
        fail2 = np.where(arcs > 0, 1 - (kept - DISCOUNT * arcs) / np.maximum(pairs, 1.0), 1.0)
        self.root, self.fail1, self.fail2 = np.log10(p0), np.log10(fail1), np.log10(fail2)
        self.known1, self.known2 = pairs > 0, triples >= LEAST
        self.weight1 = np.log10(np.where(self.known1, p1, 1.0))
        # The bigram at the end of each trigram, in the block's sorted keys.
        end = np.searchsorted(b.pair_key, b.pair_w[b.triple_pair] * b.width + b.triple_w)
        p2 = (triples - DISCOUNT) / np.maximum(pairs[b.triple_pair], 1.0) + fail2[b.triple_pair] * p1[end]
        self.weight2 = np.log10(np.where(self.known2, p2, 1.0))
        self.state_of_pair = np.where(arcs > 0, 1 + self.words + np.arange(len(pairs)), 1 + b.pair_w).astype(np.int32)

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading the words at these places in each of the states, and the weights on the way."""
        pair, triple = self.b.pair_at[at], self.b.triple_at[at]
        deep = state > self.words
        arc = deep & (triple >= 0)
        arc[arc] = self.known2[triple[arc]]
        weight = np.zeros(len(at))
        weight[arc] = self.weight2[triple[arc]]
        fails = deep & ~arc  # the failure arc of a pair leads to its last word
        weight[fails] = self.fail2[state[fails] - 1 - self.words]
        rest = np.flatnonzero(~arc)
        one = pair[rest]
        known = self.known1[one]
        weight[rest] += np.where(known, self.weight1[one], self.fail1[self.b.pair_h[one]] + self.root[self.b.pair_w[one]])
        return self.state_of_pair[pair], weight

    def read(self) -> np.ndarray:
        """The log-probability of each text of the block, read from left to right."""
        b = self.b
        pieces = -(-b.sizes // PIECE)
        text = np.repeat(np.arange(len(b.sizes)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = b.first[text] + number * PIECE
        length = np.minimum(PIECE, b.last[text] + 1 - start)
        state = np.where(number == 0, 1 + b.start, self.state_of_pair[b.pair_at[start - 1]]).astype(np.int32)
        order = np.argsort(-length, kind="stable")
        start, state, length = start[order], state[order], length[order]
        sums = np.zeros(len(text))
        active = np.searchsorted(-length, -np.arange(PIECE), "left")  # pieces that are longer than so many words
        for t in range(int(length.max(initial=0))):
            n = active[t]
            state[:n], weight = self.step(state[:n], start[:n] + t)
            sums[:n] += weight
        return np.bincount(text[order], sums, len(b.sizes))


def _scored(frame: pd.DataFrame, b: Block, told: pd.DataFrame) -> pd.DataFrame:
    answers = _by_part(told)
    tokens, distinct = (int(told[c].iloc[0]) for c in ("tokens", "distinct"))
    words_, pairs, types = b.told(answers)
    b.triples(pairs)
    model = Automaton(b, words_, pairs, types, *b.told_triples(answers), tokens, distinct)
    return pd.DataFrame({
        "doc_id": frame["doc_id"], "held_out": frame["held_out"], "n_tokens": b.sizes,
        "n_known": np.add.reduceat((words_ > 0)[b.w].astype(np.int64), b.first), "train_tokens": np.full(len(frame), tokens, np.int64),
        "base_score": np.add.reduceat(model.root[b.w], b.first), "score": model.read(),
    })


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the words that make up HOT_SHARE or more of a bounded sample of documents (and START): they are only dealt wider, which changes no result."""
    n = max(1, docs.count())
    picked = docs.filter(F.xxhash64("doc_id", F.lit("lm")).bitwiseAND(F.lit((1 << 30) - 1)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / n)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = WordHashes()
            found = [hashes.of(words(t)) for t in frame["text"]]
            keys, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            often = counts >= HOT_SHARE / 4 * max(1, counts.sum())
            yield pd.DataFrame({"w": keys[often].view(np.int64), "n": counts[often], "all": np.full(often.sum(), counts.sum())})

    seen = picked.select("text").mapInPandas(count, "w long, n long, all long")
    top = seen.groupBy("w").agg(F.sum(F.col("n") / F.col("all")).alias("n")).orderBy(F.col("n").desc(), "w").limit(MOST_HOT).toPandas()
    batches = max(1.0, float(top["n"].sum()))
    keep = top["w"].to_numpy(np.int64)[top["n"].to_numpy(float) / batches >= HOT_SHARE]
    return np.unique(np.append(keep.view(np.uint64), START))


def _blocks(rows: DataFrame, near: str | None, block_bytes: int) -> tuple[Column, int]:
    """The block of each row (doc_id, text, and _near with `near`), and the number of blocks.

    Rows with one value of `near` get as many neighbouring blocks as their bytes need; the MOST_NEAR largest values are told apart, the others are one.
    """
    size = F.octet_length("text") + 64
    deal = F.xxhash64("doc_id", "text")
    if near is None:
        count = max(1, math.ceil((rows.agg(F.sum(size)).first()[0] or 0) / block_bytes))
        return F.pmod(deal, F.lit(count)).cast("int"), count
    found = rows.groupBy("_near").agg(F.sum(size).alias("n")).orderBy(F.col("n").desc(), "_near").limit(MOST_NEAR).collect()
    rest = (rows.agg(F.sum(size)).first()[0] or 0) - sum(r["n"] for r in found)
    first, width, upto = {}, {}, 0
    for key, n in [*((r["_near"], r["n"]) for r in found), (None, rest)]:
        first[key], width[key] = upto // block_bytes, max(1, math.ceil(n / block_bytes))
        upto += n
    named = [k for k in first if k is not None]
    at = lambda of: F.coalesce(F.create_map(*[F.lit(x) for k in named for x in (k, of[k])])[F.col("_near")] if named else F.lit(None).cast("int"), F.lit(of[None])).cast("int")
    return (at(first) + F.pmod(deal, at(width).cast("long"))).cast("int"), max(first[k] + width[k] for k in first)


def score(docs: DataFrame, modulus: int = 10, held: int = 0, block_bytes: int = BLOCK_BYTES, near: str | None = None) -> DataFrame:
    """Per row of docs (doc_id long, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows whose crc32(doc_id as text) mod modulus is not `held`. Tokens are the
    words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end. A null text counts as empty; ids are kept exactly; a null doc_id is not learned from
    and not held out; repeated rows are scored, and learned from, each time. Without training texts every
    count is 0. Scores are base-10 logs. Texts count whole at any length; a text longer than a block makes a longer one. Other columns are ignored.
    An empty table gives no rows. near: a column whose equal values are dealt into the same blocks as far as they fit, such as the
    language: these ask for fewer different words then. It is no input of the model and changes no result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([F.coalesce(F.col(near).cast("string"), F.lit("")).alias("_near")] if near else []))
    remainder = id_remainder(F.col("doc_id"), modulus)
    block, parts = _blocks(rows, near, block_bytes)
    hot = frequent_words(rows)
    dealt = rows.select(
        block.alias("block"), F.col("doc_id").cast("string").alias("doc_id"), "text",
        F.coalesce(remainder == held, F.lit(False)).alias("held_out"), F.coalesce(remainder != held, F.lit(False)).alias("training"),
    )

    def of(frame: pd.DataFrame) -> Block:
        return Block(frame["text"].tolist(), frame["training"].to_numpy(bool), parts, hot)

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(of(frame).ask(int(frame["block"].iloc[0])), columns=_ASKED_NAMES)

    def ask_triples(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        b = of(frame)
        b.triples(b.told(_by_part(told))[1])
        return pd.DataFrame(b.ask_triples(int(key[0])), columns=_ASKED_NAMES)

    def answer(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return _scored(frame, of(frame), told)

    by_block = dealt.groupBy("block")
    told = by_block.applyInPandas(ask, _ASKED).groupBy("kind", "part").applyInPandas(_totals, _TOLD)
    sums = told.filter(F.col("kind") == _SUMS).agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"))
    first = told.filter(F.col("kind") != _SUMS).drop("tokens", "distinct")
    second = by_block.cogroup(first.groupBy("block")).applyInPandas(ask_triples, _ASKED)
    second = second.groupBy("kind", "part").applyInPandas(_totals, _TOLD).drop("tokens", "distinct")
    both = first.unionByName(second).crossJoin(F.broadcast(sums))  # one row of sums
    # Ids travel as text: pandas would make floating-point numbers of longs beside a null.
    scored = by_block.cogroup(both.groupBy("block")).applyInPandas(
        answer, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
