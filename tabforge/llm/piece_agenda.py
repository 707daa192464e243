"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is a row of symbols, one a character. An agenda holds the adjacent pairs whose
concatenation is a piece, ordered by the piece's score and, at equal scores, from left to
right; the first is merged and its two new neighbours enter the agenda, until it is empty.

Two neighbouring characters that no piece contains side by side never share a symbol, so
a text is cut there into chunks without changing its ids. Chunks of a batch are encoded
once each. Those of equal length stand in one matrix, a chunk a row, and all rows take the
first entry of their agenda in step; long chunks use a heap. Inside the same Arrow batch
the ids are held against the sentencepiece library: every word that is not remembered, many in one
text, and texts that are not single-spaced, or end with a space, as a whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import fresh_name, pieces

SPACE = "▁"  # fixed value: what stands for a space in pieces
NONE = np.iinfo(np.int32).max

#: Symbols of a chunk up to which it is encoded in a matrix; above, a heap costs less.
MATRIX_CHARS = 48
#: Chunks, and words, whose ids a worker remembers from batch to batch.
REMEMBERED = 1 << 18
#: Rows that are encoded together, at most; an Arrow batch's bytes bound them too.
BATCH_ROWS = 1024
#: Words that the library is asked for in one text.
ASKED_WORDS = 64


class Remembered(dict):
    """Packed ids of chunks or words. Of too many, those that came up again since the last time stay."""

    def __init__(self) -> None:
        super().__init__()
        self.again: set[str] = set()

    def new(self, names: set[str]) -> set[str]:
        """Those that are not held; the others have come up again."""
        new = names - self.keys()
        self.again |= names - new if new else names
        return new

    def bound(self) -> None:
        if len(self) > REMEMBERED:
            kept = {k: self[k] for k in self.again if k in self}
            self.clear()
            self.update(kept)
            self.again = set()


class PieceVocabulary:
    """A merge-type vocabulary with byte fallback, read through the sentencepiece library."""

    def __init__(self, path: str):
        own = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = own.get_piece_size()
        kinds = {i: own.is_byte(i) or own.is_control(i) or own.is_unknown(i) for i in range(self.size)}
        if any(own.is_unused(i) for i in kinds) or not any(own.is_byte(i) for i in kinds):
            raise ValueError(f"{path}: only vocabularies with byte fallback and without unused pieces are handled")
        named = {own.id_to_piece(i): i for i, special in kinds.items() if not special}
        self.of_byte = np.array([own.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # A symbol is a piece's id or, for a character that is no piece, size + its code point.
        self.base = self.size + 0x110000
        self.of_char = np.arange(self.size, self.base, dtype=np.int32)
        for p, i in named.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        scores = {i: own.get_score(i) for i in named.values()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbol = lambda s: named.get(s, self.size + ord(s) if len(s) == 1 else None)
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in named.items():
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (order[scores[i]], i)
        self.pairs = pairs
        self.ranks, self.merged = np.array(list(pairs.values()), np.int32).reshape(-1, 2).T
        self._hash_pairs(np.array(list(pairs), np.int64))
        self.pattern = self._chunk_pattern(named)
        self.known = Remembered()  # ids of chunks
        self.differ: set[str] = set()  # words that the library encodes in another way
        self.words = Remembered()  # ids of what follows one space, up to the next

    @staticmethod
    def _chunk_pattern(named: Iterable[str]) -> re.Pattern | None:
        """Chunks as spaces, then marks, then letters, where no piece goes from a later kind back to an earlier one."""
        beside = {ab for p in named for ab in zip(p, p[1:], strict=False)}
        if any(b == SPACE != a for a, b in beside):
            return None
        chars = {c for p in named for c in p}
        marks = {c for c in chars if not c.isalnum() and c != SPACE}
        while bad := {b for a, b in beside if b in marks and a not in marks and a != SPACE}:
            marks -= bad
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in chars)  # in no piece
        mark = "".join(map(re.escape, sorted(marks)))
        letter = f"[^{SPACE}{mark}{alone}]"
        return re.compile(f"{SPACE}*{letter}+|{SPACE}*[{mark}]+{letter}*|{SPACE}+|[{alone}]")

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """A table of slots, at most a quarter full; a pair stands in the first free slot from its own on."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_pair = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for i, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.slot_key[slot], self.slot_pair[slot] = key, i

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the pair, or -1."""
        key = (left * np.int64(self.base) + right).ravel()
        slot = self._slots(key)
        held = self.slot_key[slot]
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.slot_key[slot[todo]]
            todo = todo[(held != key[todo]) & (held >= 0)]
        return self.slot_pair[slot].reshape(left.shape)

    def _in_step(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their symbols) for a matrix of chunks, each time some have an empty agenda."""
        rows = np.arange(len(symbols))
        at = self._agenda(symbols[:, :-1], symbols[:, 1:])
        ranks = np.where(at >= 0, self.ranks[at], NONE).astype(np.int32)
        while len(rows):
            if symbols.shape[1] < 2:
                yield rows, symbols
                return
            best = ranks.argmin(axis=1)  # the leftmost of equal ones
            every = np.arange(len(rows))
            over = ranks[every, best] == NONE
            if over.any():
                yield rows[over], symbols[over]
                go = ~over
                rows, symbols, at, ranks, best = rows[go], symbols[go], at[go], ranks[go], best[go]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            symbols[every, best] = self.merged[at[every, best]]
            keep = np.ones(symbols.shape, bool)
            keep[every, best + 1] = False  # what stands behind the pair moves up
            width = symbols.shape[1] - 1
            symbols = symbols[keep].reshape(-1, width)
            if width < 2:
                continue
            keep = np.ones(at.shape, bool)
            keep[every, best] = False
            at, ranks = at[keep].reshape(-1, width - 1), ranks[keep].reshape(-1, width - 1)
            for shift in (-1, 0):  # the pairs that end and start at the new symbol
                k = best + shift
                has = (k >= 0) & (k < width - 1)
                r, c = every[has], k[has]
                fresh = self._agenda(symbols[r, c], symbols[r, c + 1])
                at[r, c], ranks[r, c] = fresh, np.where(fresh >= 0, self.ranks[fresh], NONE)

    def _by_heap(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := self.pairs.get(symbols[i] * self.base + symbols[j])):
                heapq.heappush(agenda, (found[0], i, j, symbols[i], symbols[j]))

        for i in range(n - 1):
            enter(i, i + 1)
        while agenda:
            _, i, j, left, right = heapq.heappop(agenda)
            if symbols[i] != left or symbols[j] != right or behind[i] != j:
                continue  # one of the two has gone into another symbol
            symbols[i], symbols[j] = self.pairs[left * self.base + right][1], -1
            behind[i] = behind[j]
            if behind[j] < n:
                before[behind[j]] = i
            enter(before[i], i)
            enter(i, behind[i])
        return [s for s in symbols if s >= 0]

    def _ids(self, symbols: np.ndarray) -> bytes:
        """Packed ids; a character that is no piece becomes its bytes' pieces."""
        if (symbols < self.size).all():
            return symbols.astype("<i4").tobytes()
        parts = (
            self.of_byte[list(chr(s - self.size).encode())] if s >= self.size else np.array([s], np.int32)
            for s in symbols.tolist()
        )
        return np.concatenate(list(parts)).astype("<i4").tobytes()

    def _learned(self, chunks: list[str]) -> dict[str, bytes]:
        """Packed ids of each chunk."""
        out: dict[str, bytes] = {}
        if not chunks:
            return out
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths) - lengths
        symbols = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        for n in np.unique(lengths).tolist():
            those = np.flatnonzero(lengths == n)
            if n > MATRIX_CHARS:
                for k in those.tolist():
                    found = self._by_heap(symbols[starts[k] : starts[k] + n].tolist())
                    out[chunks[k]] = self._ids(np.array(found, np.int64))
                continue
            for rows, left in self._in_step(symbols[starts[those][:, None] + np.arange(n)]):
                names = map(chunks.__getitem__, those[rows].tolist())
                if (left < self.size).all():
                    packed = np.ascontiguousarray(left, "<i4").view(f"V{4 * left.shape[1]}").ravel().tolist()
                    out.update(zip(names, packed, strict=True))
                else:
                    out.update((c, self._ids(row)) for c, row in zip(names, left, strict=True))
        return out

    def _cut(self, text: str) -> list[str]:
        if self.pattern is None:
            return [text] if text else []
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text."""
        return self._encode(texts, False)[0]

    def checked(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Packed ids of every text, the library's where it differs, and whether it agrees.

        A word is held against the library when it is new, other texts are as a whole.
        """
        return self._encode(texts, True)

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [array("i", x).tobytes() for x in self.library.encode(texts, num_threads=1)]

    def _check(self, new: list[str]) -> None:
        """Hold new words against the library, several in one text; where the text differs, one by one.

        The library puts a space before a text, as there is before a word. No piece goes on behind a space, so
        the ids of a text are those of its words.
        """
        groups = [new[at : at + ASKED_WORDS] for at in range(0, len(new), ASKED_WORDS)]
        for group, ids in zip(groups, self._library_ids([" ".join(g) for g in groups]), strict=True):
            if b"".join(map(self.words.__getitem__, group)) == ids:
                continue
            for w, own in zip(group, self._library_ids(group), strict=True):
                if self.words[w] != own:
                    self.words[w] = own
                    self.differ.add(w)

    def _encode(self, texts: list[str], check: bool) -> tuple[list[bytes], list[bool]]:
        self.known.bound()
        self.words.bound()
        # With single spaces only, a space and what follows is cut and looked up as one word.
        words: list[str] = []
        ends, others = [], {}
        for i, t in enumerate(map(self.library.normalize, texts)):
            if self.pattern and t.startswith(SPACE) and not t.endswith(SPACE) and SPACE + SPACE not in t:
                words += t[1:].split(SPACE)
            else:
                others[i] = self._cut(t)
            ends.append(len(words))
        new = self.words.new(set(words))
        whole, parts = [], {}
        for w in new:
            if w.isalnum():  # no marks, no characters that stand alone
                whole.append(SPACE + w)
            else:
                parts[w] = self._cut(SPACE + w)
        chunks = self.known.new({c for cut in (*parts.values(), *others.values()) for c in cut})
        learned = self._learned(list(chunks.union(whole)))
        self.known.update((c, learned[c]) for c in chunks)
        self.words.update((c[1:], learned[c]) for c in whole)
        for w, cut in parts.items():
            self.words[w] = b"".join(map(self.known.__getitem__, cut))
        if check and new:
            self._check(list(new))
        found = list(map(self.words.__getitem__, words))
        starts = [0, *ends]
        packed = [
            b"".join(map(self.known.__getitem__, others[i]) if i in others else found[starts[i] : ends[i]])
            for i in range(len(texts))
        ]
        agrees = [True] * len(texts)
        if check and others:
            for i, ids in zip(others, self._library_ids([texts[i] for i in others]), strict=True):
                packed[i], agrees[i] = ids, packed[i] == ids
        if self.differ:
            agrees = [a and self.differ.isdisjoint(words[starts[i] : ends[i]]) for i, a in enumerate(agrees)]
        return packed, agrees


@lru_cache(maxsize=2)
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


RESULT = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()), T.StructField("agrees", T.BooleanType()),
])


def encode_pieces(
    docs: DataFrame, path: str, text: str = "text", decoded: bool = True, digest: bool = False, check: bool = True,
) -> DataFrame:
    """Adds token ids by a vocabulary of the sentencepiece library to every row.

    ``ids`` (array<int>): without begin and end ids. ``decoded``: the ids' text, as the
    library decodes them; with ``digest`` also its SHA-256 in ``decoded_sha256``, so that
    the text itself need not come back. ``agrees``: whether the library encodes the text, or
    all of its words, to the same ids (null without ``check``); where it does not, the row
    takes the library's.

    A null or empty text has no ids and decodes to an empty text. Texts of any length are
    encoded whole; what a task holds besides is bounded by ``REMEMBERED`` chunks and words. Repeated
    rows get equal ids and ties of scores go from left to right, as in the library. An empty
    table gives an empty result. Input columns named like an output are replaced. ``path``
    must be readable on the executors.
    """

    @F.arrow_udf(RESULT)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = piece_vocabulary(path)
        for batch in pieces(batches, BATCH_ROWS):
            texts = [t or "" for t in batch.to_pylist()]
            found, agrees = own.checked(texts) if check else (own.encode(texts), [None] * len(texts))
            back: list = [None] * len(texts)
            if decoded or digest:
                back = own.library.decode([np.frombuffer(x, "<i4").tolist() for x in found], num_threads=1)
            sums = [hashlib.sha256(t.encode()).hexdigest() if digest else None for t in back]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            flat = np.frombuffer(b"".join(found), "<i4")
            columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                       pa.array(back if decoded else [None] * len(texts), pa.string()),
                       pa.array(sums, pa.string()), pa.array(agrees, pa.bool_())]
            yield pa.StructArray.from_arrays(columns, RESULT.names)

    added = ["ids"] + ["decoded"] * decoded + ["decoded_sha256"] * digest + ["agrees"]
    names = [c for c in docs.columns if c.lower() not in added]
    held = fresh_name(docs, "held")
    return docs.select(*names, encode(F.col(text)).alias(held)).select(*names, *(F.col(held)[c].alias(c) for c in added))
