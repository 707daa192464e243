"""Language identification with hyperdimensional profiles.

Every letter symbol has a random vector of +1/-1. An n-gram's vector binds
(multiplies) its letters' vectors, each rotated by its place; a text's vector
bundles (adds) the vectors of its n-grams, one found c times with weight log2(1 + c),
so that a phrase said over and over does not drown the rest; a language's prototype bundles its
training texts, each scaled to length one. The prototype closest to a text by
cosine gives its language.

Adding is linear, so training counts n-grams per language (one histogram a
partition, weighted by 1/length of the text) and builds the prototypes from the
sums; prediction multiplies a batch's count matrix, over the n-grams that occur in
it, with those n-grams' vectors. Nothing but the histograms leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import fresh_name, histogram_sum, pieces

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_UNIT = 1 << 20  # fixed-point one, so that sums do not depend on their order


@dataclass(frozen=True)
class ProfileParams:
    """``symbols``: 0 is any run of non-letters, 1-26 are a-z, the rest share all other letters by hash.

    ``most_languages``: the driver holds a histogram for each; more are refused.
    """

    dimension: int = 512
    symbols: int = 40
    n: int = 3
    seed: int = 7
    batch: int = 32
    most_languages: int = 1_000

    @property
    def ngrams(self) -> int:
        return self.symbols**self.n


def _symbol_table(p: ProfileParams) -> np.ndarray:
    """Symbol of each code point below 0x30000 (letters beyond share one)."""
    table = np.zeros(0x30000, np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            o = ord(low[0])
            table[c] = o - 96 if 97 <= o <= 122 else 27 + o * 2654435761 % 4294967296 * (p.symbols - 27) // 4294967296
    return table


def weight(counts: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + counts)


class Profiler:
    """Counts n-grams of texts and turns counts into hypervectors. One per task."""

    def __init__(self, p: ProfileParams):
        self.p = p
        self.table = _symbol_table(p)
        self.letters = np.random.default_rng(p.seed).choice(np.array([-1, 1], np.int8), (p.symbols, p.dimension))

    def codes(self, text: str) -> np.ndarray:
        """Code of every n-gram of the text's symbols, with one separator for a run of non-letters."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        s = np.where(points < len(self.table), self.table[np.minimum(points, len(self.table) - 1)], self.p.symbols - 1)
        s = np.concatenate([[0], s, [0]]).astype(np.int64)
        s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
        n = len(s) - self.p.n + 1
        if n < 1:
            return np.empty(0, np.int64)
        code = np.zeros(n, np.int64)
        for k in range(self.p.n):
            code = code * self.p.symbols + s[k : k + n]
        return code

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bind: the product of the rotated letter vectors of each n-gram."""
        out = np.ones((len(codes), self.p.dimension), np.int8)
        for k in range(self.p.n):  # the last letter is not rotated
            symbol = codes // self.p.symbols**k % self.p.symbols
            out *= np.roll(self.letters, k, axis=1)[symbol]
        return out

    def bundled(self, texts: list[str]) -> np.ndarray:
        """One vector a text: the weighted sum of its n-grams' vectors."""
        codes = [self.codes(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
        counts = np.bincount(owner * self.p.ngrams + flat, minlength=len(texts) * self.p.ngrams)
        counts = counts.reshape(len(texts), self.p.ngrams)
        present = np.flatnonzero(counts.any(axis=0))
        return weight(counts[:, present]).astype(np.float32) @ self.vectors(present).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def fit_prototypes(docs: DataFrame, text: str, lang: str, train: Column, p: ProfileParams) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from the rows where ``train`` holds and lang is not null.

    The driver holds one histogram of ``symbols ** n`` bins a language.
    """
    rows = docs.where(train & F.col(lang).isNotNull()).select(text, lang)
    langs = sorted(r[0] for r in rows.select(lang).distinct().limit(p.most_languages + 1).collect())
    if len(langs) > p.most_languages:
        raise ValueError(f"{lang} has more than {p.most_languages} values")
    if not langs:
        return [], np.zeros((0, p.dimension), np.float32)
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        profiler = Profiler(p)
        totals = np.zeros(len(langs) * p.ngrams, np.int64)
        for b in pieces(batches):
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    codes = profiler.codes(t)
                    got = np.bincount(codes, minlength=p.ngrams)
                    at = np.flatnonzero(got)
                    c = weight(got[at])
                    totals[place[x] * p.ngrams + at] += np.rint(c * (_UNIT / np.sqrt(float(c @ c)))).astype(np.int64)
        return totals

    sums = histogram_sum(rows, count, len(langs) * p.ngrams).reshape(len(langs), p.ngrams)
    profiler = Profiler(p)
    out = np.zeros((len(langs), p.dimension))
    for i, row in enumerate(sums):
        present = np.flatnonzero(row)
        v = (row[present] / _UNIT) @ profiler.vectors(present).astype(np.float64)
        out[i] = v / (np.linalg.norm(v) or 1.0)
    return langs, out.astype(np.float32)


def predict_language(
    docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", params: ProfileParams | None = None,
) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row of ``docs``.

    Prototypes are learned from the rows where ``train`` is true and ``lang`` is not
    null. A null text, or one without a letter, is ``und`` with score 0.0, and so is
    every text when there is nothing to learn from. ``score`` is the cosine, at least
    0. Ties go to the first language in order. Repeated rows get equal answers, and
    texts of any length are profiled whole; an empty table gives an empty result. Input columns named like an output are replaced.
    """
    p = params or ProfileParams()
    langs, prototypes = fit_prototypes(docs, text, lang, train, p)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profiler = Profiler(p)
        for batch in pieces(batches):
            texts = batch.to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            for k in range(0, len(known), p.batch):
                at = known[k : k + p.batch]
                v = profiler.bundled([texts[i] for i in at])
                cosine = v @ prototypes.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                best = cosine.argmax(axis=1)
                for i, j, c in zip(at, best, cosine, strict=True):
                    names[i], scores[i] = langs[j], float(min(1.0, max(0.0, c[j])))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], kind.names)

    kept = [c for c in docs.columns if c.lower() not in kind.names]
    held = fresh_name(docs, "language")
    return docs.select(*kept, predict(F.col(text)).alias(held)).select(*kept, *(F.col(held)[n].alias(n) for n in kind.names))
