"""Quality rules: surface counts, then a hashed n-gram log-likelihood ratio.

Word unigrams are hashed into one half of the buckets and bigrams into the other, so that
the many rare bigrams of a large corpus never share a bucket with a word. The number of
buckets grows with the square root of the corpus' bytes. Two multinomials are counted over
them: the raw corpus (every row) and the trusted target (rows labelled good). A document's
score is the mean over its n-grams of log p(target) - log p(raw); it is kept when the score
reaches a fixed threshold that is fitted on labelled rows and then applied to every document
alike. For the threshold a trusted row is scored without its own n-grams in the target, as
the unlabelled documents are; the raw counts hold every document, labelled or not.

Counting sends one packed histogram per partition (``common.histogram_sum``); scoring is a
map that holds 4 bytes a bucket. The target and the threshold are fitted on all labelled rows:
they are written once with their texts, and the threshold is an exact quantile of their scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.stats import exact_quantiles
from tabforge.llm.common import NGRAM_MULTIPLIERS, fresh_name, histogram_sum, mixed, pieces, stored
from tabforge.session import scratch_path

SYMBOLS = b"#*$%&|<>"
ASCII_SPACE = " \t\n\v\f\r"
#: Labelled keys that are sent to all tasks at once, about.
BROADCAST_KEYS = 2_000_000


@dataclass(frozen=True)
class LlrParams:
    """``buckets``: None for a power of two of at least ``least_buckets`` and ``per_root`` times the root of the corpus' bytes.

    That is 2^18 for 0.8 GB of text, 2^22 for 100 GB and 2^27 for 100 TB.

    ``keep``: share of trusted rows that must reach the threshold when left out of the target.
    """

    buckets: int | None = None
    least_buckets: int = 1 << 16
    per_root: float = 8.0
    smoothing: float = 0.5
    keep: float = 0.998
    min_words: int = 50
    repeat_percent: int = 50


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def ngram_buckets(words: list[bytes], buckets: int, h: np.ndarray | None = None) -> np.ndarray:
    """Bucket of every unigram, in the lower half, and of every bigram, in the upper half."""
    h = _hashes(words) if h is None else h
    half = np.uint64(buckets // 2)
    pairs = mixed(h[:-1] * NGRAM_MULTIPLIERS[0] + h[1:] * NGRAM_MULTIPLIERS[1]) % half + half
    return np.concatenate([mixed(h) % half, pairs]).astype(np.int64)


def with_buckets(docs: DataFrame, text: str, p: LlrParams) -> LlrParams:
    """``p`` with a bucket count that suits the corpus, unless it names one."""
    if p.buckets is not None:
        return p
    data = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    wanted = max(p.least_buckets, int(p.per_root * data**0.5))
    return replace(p, buckets=1 << (wanted - 1).bit_length())


def repeated_words(h: np.ndarray) -> int:
    """Words that stand in a 3-word window found at least twice (windows compared by 64-bit hash)."""
    n = len(h) - 2
    if n < 2:
        return 0
    window = mixed(h[:-2] * NGRAM_MULTIPLIERS[0] + h[1:-1] * NGRAM_MULTIPLIERS[1] + h[2:] * NGRAM_MULTIPLIERS[2])
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def surface_failed(words: int, repeated: int, p: LlrParams) -> bool:
    return words < p.min_words or 100 * repeated > p.repeat_percent * words


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(ASCII_SPACE):
            seen.add(line)
    return n


@dataclass(frozen=True)
class LlrModel:
    weights: np.ndarray  # log p(target) - log p(raw) of each bucket, in single precision
    threshold: float

    def score(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum(dtype=float) / len(at)) if len(at) else 0.0


def _examples(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, trusted) of every labelled key; one with both labels is no example of either class."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key)
    both = rows.agg(F.min(F.col(label) == 1).alias("trusted"), F.max(F.col(label) == 1).alias("most"))
    return both.where(F.col("trusted") == F.col("most")).drop("most")


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(text, trusted, key) of every labelled row, written once. Texts are not shuffled: the labels' keys go to
    the rows in parts of about ``BROADCAST_KEYS``, a scan each."""
    examples = stored(_examples(labels, key, label), "examples")
    parts = max(1, -(-examples.count() // BROADCAST_KEYS))
    path = scratch_path(docs.sparkSession, "labelled")
    for i in range(parts):
        some = F.broadcast(examples.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i))
        found = docs.select(key, text).join(some, key).select(text, "trusted", key)
        found.write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def fit_llr(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, p: LlrParams,
) -> LlrModel:
    """Count raw and target n-grams and set the threshold.

    With no trusted row the weights are 0 and every document reaches the threshold.
    """
    p = with_buckets(docs, text, p)
    labelled = _labelled(docs, labels, key, text, label)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        totals = np.zeros(p.buckets, np.int64)
        for b in pieces(batches):
            for t in b.column(0).to_pylist():
                if t and (words := t.encode().split()):
                    np.add.at(totals, ngram_buckets(words, p.buckets), 1)
        return totals

    target = histogram_sum(labelled.where("trusted").select(text), count, p.buckets).astype(float)
    if not target.any():
        return LlrModel(np.zeros(p.buckets, np.float32), -np.inf)

    raw = histogram_sum(docs.select(text), count, p.buckets).astype(float)

    def logs(counts: np.ndarray, n: float) -> np.ndarray:
        return np.log(counts + p.smoothing) - np.log(n + p.smoothing * p.buckets)

    n_target, raw_logs = target.sum(), logs(raw, raw.sum())
    model = LlrModel((logs(target, n_target) - raw_logs).astype(np.float32), -np.inf)
    raw_logs, target = raw_logs.astype(np.float32), target.astype(np.float32)  # sent to the tasks that fit the threshold

    def left_out(at: np.ndarray) -> float:
        """The score of a trusted row against the other trusted rows."""
        held, own = np.unique(at, return_counts=True)
        return float(own @ (logs(target[held] - own, n_target - len(at)) - raw_logs[held]) / len(at))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for t, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (t or "").encode().split()
                h = _hashes(words)
                if not words or surface_failed(len(words), repeated_words(h), p):
                    out.append(None)  # decided without a score, and no example for one
                    continue
                at = ngram_buckets(words, p.buckets, h)
                out.append(left_out(at) if good else model.score(at))
            columns = [pa.array(out, pa.float64()), *b.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, ["score", "trusted", *b.schema.names[2:]])

    kind = docs.schema[key].dataType.simpleString()
    fitted = labelled.withColumnRenamed(key, "key").mapInArrow(scores, f"score double, trusted boolean, key {kind}").where("score is not null")
    # Rows of one key are all trusted and may be copies: where there are others, only keys of one row count.
    one = stored(fitted.groupBy("trusted", "key").agg(F.min("score").alias("score"), F.count("*").alias("n")), "scores")
    by_kind = one.select(
        F.when(F.col("trusted") & (F.col("n") == 1), F.col("score")).alias("alone"),
        F.when(F.col("trusted"), F.col("score")).alias("good"), F.when(~F.col("trusted"), F.col("score")).alias("bad"),
    )
    found = exact_quantiles(by_kind, ["alone", "good", "bad"], [1 - p.keep, p.keep])
    low = found["good"][0] if found["alone"][0] is None else found["alone"][0]
    if low is None:
        return model
    if found["bad"][1] is not None:  # halfway down to the bad rows' upper end where that lies below
        low = min(low, (low + found["bad"][1]) / 2)
    return LlrModel(model.weights, float(low))


OUTPUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("llr", T.DoubleType()), T.StructField("kept", T.BooleanType()),
])
_ARROW = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]


def judge(text: str | None, model: LlrModel, p: LlrParams) -> tuple:
    """One document's values, in the order of ``OUTPUT``; a null text has no words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    h = _hashes(words)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    spaces = len(data) - len(data.translate(None, ASCII_SPACE.encode()))
    repeat = repeated_words(h)
    failed = surface_failed(n, repeat, p)
    score = model.score(ngram_buckets(words, p.buckets, h))
    return (n, len(text) - spaces, symbols, duplicate_lines(text), repeat, failed, score,
            not failed and score >= model.threshold)


def quality_rules(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    params: LlrParams | None = None,
) -> DataFrame:
    """Adds the columns of ``OUTPUT`` to every row of ``docs``.

    ``kept`` is false where the surface rules fail, else whether the score reaches the
    threshold. Null and empty texts have no words and fail. A score
    equal to the threshold is kept; texts of any length are judged whole. A null key takes no label;
    rows that repeat a key share its label. An empty table gives an empty result, an
    empty label table keeps what the surface rules keep. Input columns named like an
    output are replaced.
    """
    p = with_buckets(docs, text, params or LlrParams())
    model = fit_llr(docs, labels, key, text, label, p)

    @F.arrow_udf(OUTPUT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces(batches):
            rows = [judge(t, model, p) for t in batch.to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _ARROW, strict=True)], OUTPUT.names)

    kept = [c for c in docs.columns if c.lower() not in OUTPUT.names]
    held = fresh_name(docs, "quality")
    return docs.select(*kept, score(F.col(text)).alias(held)).select(
        *kept, *(F.col(held)[n].alias(n) for n in OUTPUT.names)
    )
