"""SentencePiece encoding and decoding of merge-type (BPE) models, with seeded merge-dropout.

A text gets the model's leading space and is cut into units (spaces and the word after them, a line
break, punctuation) that no piece of the model crosses. Inside a unit an agenda of neighbouring pairs, best score
first and then leftmost, is worked off. With dropout, every candidate taken from it is skipped if its
draw falls below the rate. The draw is a keyed hash of seed, document, place of the unit in the text and
number of the candidate in the agenda, so each occurrence of a word has draws of its own. A skipped pair comes
back only when a neighbour of it merges. Characters without a piece become byte pieces, so decoding gives
the text back.

Agendas of many units are worked off together, one candidate of each at a time. What a unit becomes without
skips is remembered, with the number of its candidates; an occurrence takes that if none of these is skipped
for it, and has an agenda of its own if one is.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import bounded
from vitalframe.llm.words import mixed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text taken together, of outcomes that a task remembers, and characters of a unit that may be remembered.
SLICE_BYTES, REMEMBERED_BYTES, LONGEST = 1 << 20, 48 << 20, 64
#: Draws made for all occurrences at once, widths of agendas that are worked off together, and rows of them.
STEPS, WIDTHS, ROWS = 16, (6, 10, 16, 32, LONGEST), 8192
_SPACE, _NONE, _EMPTY = "▁", np.int32(1 << 30), np.uint32(0xFFFFFFFF)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a model: merge order and id of each, byte ids, and the bytes that each id stands for."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes: list[int] = [0] * 256
        self.spelled: list[bytes] = []
        self.pool: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[1:-1], 16)
                self.bytes[value] = k
                self.spelled.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k):
                self.spelled.append(b"")
            else:
                self.pieces[piece] = (-model.get_score(k), k)
                self.spelled.append(piece.replace(_SPACE, " ").encode())
        if len(self.spelled) > 65_535:
            raise ValueError("ids over 65534 are not supported")
        self._index()
        odd = next((p for p in self.pieces if _SPACE in p.lstrip(_SPACE) or ("\n" in p and len(p) > 1)), None)
        if odd is not None:
            raise ValueError(f"piece {odd!r} crosses units")
        # Marks that no piece has after a letter or digit: a unit may end before them.
        beside = {(a, b) for p in self.pieces for a, b in zip(p, p[1:], strict=False)}
        marks = set(string.punctuation) - {b for a, b in beside if a.isalnum()}
        ends = "".join(map(re.escape, sorted(marks)))
        word, end = r" *[^\W_]+", rf"(?=[ \n{ends}]|\Z)"
        self.unit = re.compile(rf"{word}{end}| *[^ \n]+?(?:(?<=[^\W_]){end}|(?=[ \n]|\Z))| +|\n")

    def _index(self) -> None:
        """The pieces as arrays: id of each character, and a hash table of the pairs that merge: place in the order (pieces of one score share it) and id."""
        order = sorted((p for p in self.pieces if len(p) > 1), key=lambda p: self.pieces[p][0])
        places = {score: k for k, score in enumerate(dict.fromkeys(self.pieces[p][0] for p in order))}
        self.characters = np.full(0x110000, -1, np.int32)
        for p, (_, k) in self.pieces.items():
            if len(p) == 1:
                self.characters[ord(p)] = k
        self.characters[ord(" ")], self.characters[ord(_SPACE)] = self.characters[ord(_SPACE)], -1
        pairs = {(self.pieces[p[:i]][1] << 16) | self.pieces[p[i:]][1]: p for p in order for i in range(1, len(p)) if p[:i] in self.pieces and p[i:] in self.pieces}
        self.bits = max(20, (4 * len(pairs)).bit_length())
        self.keys, self.ranks, self.merged = np.full(1 << self.bits, _EMPTY), np.full(1 << self.bits, _NONE), np.full(1 << self.bits, _NONE)
        for key, piece in pairs.items():
            slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)
            while self.keys[slot] != _EMPTY:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, places[self.pieces[piece][0]], self.pieces[piece][1]

    def of_pairs(self, left: np.ndarray, right: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The values (ranks or merged) of pairs, _NONE for those that do not merge; symbols without a piece are negative."""
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        key[(left < 0) | (right < 0)] = _EMPTY
        slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != key) & (found != _EMPTY) & (key != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint32(1)) & np.uint32((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            open_ = open_[(found != key[open_]) & (found != _EMPTY)]
        return np.where((self.keys[slot] == key) & (key != _EMPTY), values[slot], _NONE)

    def spell(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, one after the other, and where each ends."""
        if self.pool is None:
            sizes = np.array([len(x) for x in self.spelled])
            self.pool = np.frombuffer(b"".join(self.spelled), np.uint8), np.cumsum(sizes) - sizes, sizes
        pool, starts, sizes = self.pool
        return _gather(pool, starts[ids], sizes[ids]).tobytes(), np.cumsum(sizes[ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their bytes joined, without the leading space."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


def skips(keys: np.ndarray, count: int, limit: int) -> np.ndarray:
    """For each key, which of its first `count` candidates are skipped; limit: dropout rate in 1/65536.

    A hashed word of 64 bits gives the draws of four candidates.
    """
    number = np.arange(1, -(-count // 4) + 1, dtype=np.uint64) * _GOLD
    return (mixed(keys[:, None] + number).astype("<u8").view("<u2") < limit)[:, :count]


def segment(symbols: list[str], pieces: dict[str, tuple[float, int]], skipped: bytes = b"") -> list[str]:
    """Merge the symbols of one long unit, with a heap and a linked list. Candidate number k is skipped if skipped[k] is set."""
    symbols, n, step = list(symbols), len(symbols), 0
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (found := pieces.get(symbols[i] + symbols[j])):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != left or symbols[j] != right:
            continue
        step += 1
        if step <= len(skipped) and skipped[step - 1]:
            continue
        symbols[i], symbols[j] = left + right, ""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s]


def _closed_up(rows: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The rows, each without the first of its places that are `later`."""
    moved = np.full(rows.shape, _NONE)
    moved[:, :-1] = rows[:, 1:]
    return np.where(later, moved, rows)


def segment_rows(symbols: np.ndarray, vocabulary: Vocabulary, skipped: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of many units, one a row, filled up with _NONE, the last column free: what is left of each, and how many candidates it took.

    Symbols are ids, those without a piece negative. skipped[r, k]: whether candidate k of row r is skipped.
    """
    out, taken = symbols.copy(), np.zeros(len(symbols), np.int64)
    columns = np.arange(symbols.shape[1], dtype=np.int32)
    rows = np.arange(len(symbols))
    filled = np.where(symbols == _NONE, -1, symbols)
    rank = np.full(symbols.shape, _NONE)
    rank[:, :-1] = vocabulary.of_pairs(filled[:, :-1].ravel(), filled[:, 1:].ravel(), vocabulary.ranks).reshape(len(symbols), -1)
    symbols, step = out.copy(), 0
    while len(rows):
        best = rank.argmin(axis=1)
        value = rank[np.arange(len(rows)), best]
        going = value < _NONE
        if not going.all():
            out[rows[~going]], taken[rows[~going]] = symbols[~going], step
            rows, symbols, rank, best, value = rows[going], symbols[going], rank[going], best[going], value[going]
            if not len(rows):
                break
        passed = np.zeros(len(rows), bool) if skipped is None else skipped[rows, step]
        step += 1
        rank[passed, best[passed]] = _NONE
        at = np.flatnonzero(~passed)
        i = best[at]
        joined = vocabulary.of_pairs(symbols[at, i], symbols[at, i + 1], vocabulary.merged)
        later = columns > i[:, None].astype(np.int32)
        s, r, k = _closed_up(symbols[at], later), _closed_up(rank[at], later), np.arange(len(at))
        s[k, i] = joined
        after, before = s[k, i + 1], s[k, np.maximum(i - 1, 0)]
        r[k, i] = vocabulary.of_pairs(joined, np.where(after == _NONE, -1, after), vocabulary.ranks)
        r[k, np.maximum(i - 1, 0)] = np.where(i > 0, vocabulary.of_pairs(before, joined, vocabulary.ranks), r[k, 0])
        symbols[at], rank[at] = s, r
    return out, taken


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _byte_ids(points: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the UTF-8 bytes of code points, and how many each has."""
    data = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return spelled[np.frombuffer(data, np.uint8)], 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


class Encoder(dict):
    """Ids of texts. As a dict: unit -> number of its outcome without skips.

    Outcome k has the ids flat[starts[k] : starts[k] + sizes[k]] and took steps[k] candidates. Outcome 0 stands for units that are too
    long to remember. All is forgotten together when it takes more than REMEMBERED_BYTES.
    """

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int):
        super().__init__()
        self.vocabulary, self.seed = vocabulary, seed
        self.limit = int(dropout * (1 << 16))
        self.byte_ids = np.array(vocabulary.bytes, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.fresh, self.held = [], 0
        self.symbols, self.first, self.lengths = np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat, self.starts, self.sizes, self.steps = np.empty(0, np.uint16), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def __missing__(self, unit: str) -> int:
        if len(unit) > LONGEST - 1:
            return 0
        self.fresh.append(unit)
        found = self[unit] = len(self.first) - 1 + len(self.fresh)
        self.held += 240 + 6 * len(unit)
        return found

    def _learn(self) -> None:
        """Work off the units met for the first time."""
        if not self.fresh:
            return
        points = np.frombuffer("".join(self.fresh).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.array([len(u) for u in self.fresh])
        found = self.vocabulary.characters[points]
        symbols = np.where(found < 0, -1 - points, found).astype(np.int32)
        new = np.arange(len(self.first), len(self.first) + len(lengths))
        self.first = np.append(self.first, len(self.symbols) + np.cumsum(lengths) - lengths)
        self.symbols, self.lengths, self.fresh = np.append(self.symbols, symbols), np.append(self.lengths, lengths), []
        flat, sizes, steps = self._worked_off(new, None)
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.flat, self.sizes, self.steps = np.append(self.flat, flat), np.append(self.sizes, sizes), np.append(self.steps, steps)

    def _worked_off(self, outcomes: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (one unit after the other), their numbers and the candidates taken, of units given by outcome; keys: for their draws."""
        lengths = self.lengths[outcomes]
        group = np.searchsorted(np.array(WIDTHS), lengths + 1)
        parts, order = [], np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(WIDTHS) + 1))
        for width, a, b in zip(WIDTHS, cuts, cuts[1:], strict=False):
            for at in range(a, b, ROWS):
                mine = order[at : min(at + ROWS, b)]
                column = np.arange(width)
                inside = column < lengths[mine][:, None]
                rows = np.full((len(mine), width), _NONE)
                rows[inside] = _gather(self.symbols, self.first[outcomes[mine]], lengths[mine])
                left, taken = segment_rows(rows, self.vocabulary, None if keys is None else skips(keys[mine], 3 * width, self.limit))
                kept = left != _NONE
                ids, weight = left[kept].astype(np.int64), np.ones(kept.sum(), np.int64)
                odd = ids < 0
                if odd.any():
                    spelled, weight[odd] = _byte_ids(-1 - ids[odd], self.byte_ids)
                    whole = np.repeat(ids, weight)
                    whole[whole < 0] = spelled
                    ids = whole
                row = np.repeat(np.arange(len(mine)), kept.sum(axis=1))
                parts.append((mine, ids.astype(np.uint16), np.bincount(row, weight, len(mine)).astype(np.int64), taken))
        if not parts:
            return np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)
        mine, ids, sizes, taken = map(np.concatenate, zip(*parts, strict=True))
        back = np.argsort(mine)
        return _gather(ids, (np.cumsum(sizes) - sizes)[back], sizes[back]), sizes[back], taken[back]

    def _long(self, unit: str, key: np.ndarray) -> list[int]:
        symbols = [_SPACE if c == " " else "\0" + c if c == _SPACE else c for c in unit]  # a literal U+2581 must not become a space
        pieces, ids = self.vocabulary.pieces, []
        for s in segment(symbols, pieces, skips(key, 3 * len(unit), self.limit).tobytes() if self.limit else b""):
            ids += [pieces[s][1]] if s in pieces else [self.vocabulary.bytes[b] for b in s[-1].encode("utf-8", "surrogatepass")]
        return ids

    def encode_many(self, texts: list[str | None], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null and empty ones have none), and how many each has; salts: a 64-bit number of each document."""
        if self.held > REMEMBERED_BYTES:
            self._forget()
        units, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.vocabulary.unit.findall(" " + text)
                counts[i] = len(found)
                units += found
        outcome = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        self._learn()
        flat, starts, sizes = [self.flat], self.starts[outcome], self.sizes[outcome]
        place = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts)
        keys = mixed(np.repeat(mixed(salts.view(np.uint64) ^ np.uint64(self.seed)), counts) + place.astype(np.uint64) * _GOLD)
        end = len(self.flat)
        if self.limit:
            drawn = np.packbits(skips(keys, STEPS, self.limit), axis=1, bitorder="little").view("<u2").ravel().astype(np.int64)
            steps = self.steps[outcome]
            apart = np.flatnonzero((drawn & ((1 << np.minimum(steps, STEPS)) - 1) != 0) | (steps > STEPS))
            ids, sizes[apart], _ = self._worked_off(outcome[apart], keys[apart])
            starts[apart] = end + np.cumsum(sizes[apart]) - sizes[apart]
            flat.append(ids)
            end += len(ids)
        for i in np.flatnonzero(outcome == 0).tolist():
            ids = np.array(self._long(units[i], keys[i : i + 1]), np.uint16)
            starts[i], sizes[i] = end, len(ids)
            flat.append(ids)
            end += len(ids)
        texts_of = np.repeat(np.arange(len(texts)), counts)
        return _gather(np.concatenate(flat), starts, sizes), np.bincount(texts_of, sizes, len(texts)).astype(np.int64)

    def encode(self, text: str, salt: int = 0) -> np.ndarray:
        """Ids of one text; the empty text has none."""
        return self.encode_many([text], np.array([salt], np.int64))[0]


def encode_documents(docs: DataFrame, path: str = MODEL, dropout: float = 0.1, seed: int = 17) -> DataFrame:
    """Per row of docs (doc_id long, text; further columns are left out): doc_id, n_ids, ids, lossless.

    lossless: decoding ids gives the text again. The draws of a document are keyed by seed and doc_id, so
    repeated rows have equal ids, and equal texts of other documents have others. A null doc_id is a key of its own. A
    null text has null ids, n_ids 0 and lossless true; an empty one has no ids. A very long text is encoded whole;
    texts are taken together up to SLICE_BYTES. All rows are kept; nothing is shuffled. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    salted = bounded(docs).select("doc_id", "text", F.xxhash64(F.lit(seed), F.col("doc_id")).alias("salt"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        encoder = Encoder(vocabulary, dropout, seed)
        for batch in slices(batches, SLICE_BYTES):
            texts = batch.column(1).to_pylist()
            ids, sizes = encoder.encode_many(texts, batch.column(2).to_numpy())
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            spelled, ends = vocabulary.spell(ids)
            cuts = np.concatenate([[0], ends])[offsets].tolist()
            # The first byte of a text that is not empty is the model's leading space.
            lossless = [spelled[a + 1 : b] == (t or "").encode() for t, a, b in zip(texts, cuts, cuts[1:], strict=False)]
            missing = np.append(batch.column(1).is_null().to_numpy(zero_copy_only=False), False)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=missing), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int32)), lists, pa.array(lossless, pa.bool_())], names=["doc_id", "n_ids", "ids", "lossless"]
            )

    return salted.mapInArrow(encoded, "doc_id long, n_ids int, ids array<int>, lossless boolean")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id, text. Null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else held.value.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")
