"""Byte-level BPE encoding by tree concatenation, and decoding.

A long text is cut in halves, and these again, without looking for a good place to
cut. Leaves are encoded on their own. Two neighbours are then joined: a window of
tokens around the join is encoded anew and grows until its outer tokens are those
that the two sides already have. A sequence of tokens is the encoding of its text
exactly if every two neighbouring tokens are, so agreement at both ends makes the
joined sequence exact.

The halves of very long texts are rows of their own, spread over the cluster and
joined per text; others are cut and joined inside their task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import fresh_name, pieces, stored

# Fixed value: the pattern by which byte-level BPE splits text before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LEAF_CHARS = 4096
SPREAD_CHARS = 32_768


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if (
            spec["model"]["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space") or not split.get("use_regex", True)
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        self.encoding = tiktoken.Encoding(
            path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self.of_id = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.size = max(self.of_id) + 1
        # what a scan looks ahead, and the longest text that makes one special token
        self.margin = max([4, *(len(t.encode()) for t in special)])

    def leaf(self, text: str) -> np.ndarray:
        """Ids of a text as one piece; special tokens' texts are these tokens."""
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.of_id.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.bytes_of(ids).decode("utf-8", "replace")

    def _starts_character(self, token: int) -> bool:
        return not 0x80 <= self.of_id[token][0] < 0xC0

    def join(self, left: np.ndarray, right: np.ndarray, tokens: int = 16) -> np.ndarray:
        """Ids of the left text followed by the right text, from the ids of both."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        while True:
            a, b = max(0, len(left) - tokens), min(len(right), tokens)
            while a > 0 and not self._starts_character(left[a]):
                a -= 1
            while b < len(right) and not self._starts_character(right[b]):
                b += 1
            before, behind = self.bytes_of(left[a:]), self.bytes_of(right[:b])
            window = self.leaf((before + behind).decode())
            fits_left = a == 0 or len(before) > self.margin and np.array_equal(window[:2], left[a : a + 2])
            fits_right = b == len(right) or len(behind) > self.margin and np.array_equal(window[-2:], right[b - 2 : b])
            if fits_left and fits_right:
                return np.concatenate([left[:a], window, right[b:]])
            tokens *= 2

    def join_all(self, parts: list[np.ndarray]) -> np.ndarray:
        """Join neighbours, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.empty(0, np.uint32)

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        """Ids of a text by tree concatenation."""
        leaves = 1
        while leaves * leaf_chars < len(text):
            leaves *= 2
        cuts = [len(text) * i // leaves for i in range(leaves + 1)]
        return self.join_all([self.leaf(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


RESULT = T.StructType([
    T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType()), T.StructField("decoded_sha256", T.StringType())
])


def encode_texts(
    docs: DataFrame, path: str, text: str = "text", decoded: bool = False, digest: bool = False,
    leaf_chars: int = LEAF_CHARS, spread_chars: int = SPREAD_CHARS,
) -> DataFrame:
    """Adds ``ids``, the text's token ids as little-endian unsigned 32-bit integers, to every row.

    With ``decoded``, the ids are decoded on the spot and their text is added too (see
    ``decode_ids``); with ``digest`` the SHA-256 of that text, ``decoded_sha256``, so that
    the text need not leave the worker. A null or empty text has no ids (an empty value) and decodes to an
    empty text. Texts over ``spread_chars`` are cut into rows of at most that length,
    encoded wherever there is room and joined per text. Repeated rows get equal ids; an
    empty table gives an empty result. Input columns named like an output are replaced.
    ``path`` must be readable on the executors.
    """

    def result(own: Vocabulary, all_ids: list[np.ndarray], back: bool) -> pa.StructArray:
        packed, texts, sums = [], [], []
        for ids in all_ids:
            whole = own.decode(ids) if back else None
            packed.append(_packed(ids))
            texts.append(whole if decoded else None)
            sums.append(hashlib.sha256(whole.encode()).hexdigest() if back and digest else None)
        columns = [pa.array(packed, pa.binary()), pa.array(texts, pa.string()), pa.array(sums, pa.string())]
        return pa.StructArray.from_arrays(columns, RESULT.names)

    def encoder(back: bool):
        @F.arrow_udf(RESULT)
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = vocabulary(path)
            for batch in pieces(batches):
                yield result(own, [own.encode(t or "", leaf_chars) for t in batch.to_pylist()], back)

        return encode

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts sorted by (row, part) to one result a row. Equal subtrees are joined as soon as both are there."""
        own = vocabulary(path)
        now, tree = None, []  # (height, ids)

        def rows(ids: list[tuple[int, np.ndarray]], number: int) -> pa.RecordBatch:
            whole = result(own, [own.join_all([x for _, x in ids])], decoded or digest)
            return pa.RecordBatch.from_arrays([pa.array([number]), *whole.flatten()], ["row", *RESULT.names])

        for batch in pieces(batches):
            for row, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if row != now:
                    if tree:
                        yield rows(tree, now)
                    now, tree = row, []
                tree.append((0, np.frombuffer(blob, "<u4")))
                while len(tree) > 1 and tree[-1][0] == tree[-2][0]:
                    (height, left), (_, right) = tree[-2:]
                    tree[-2:] = [(height + 1, own.join(left, right))]
        if tree:
            yield rows(tree, now)

    added = ["ids"] + ["decoded"] * decoded + ["decoded_sha256"] * digest
    names = [c for c in docs.columns if c.lower() not in added]
    row, held = (fresh_name(docs, n) for n in ("row", "held"))
    source = F.col(text)
    is_long = F.coalesce(F.length(source) > spread_chars, F.lit(False))
    short = docs.where(~is_long).select(*names, encoder(decoded or digest)(source).alias(held))
    short = short.select(*names, *(F.col(held)[c].alias(c) for c in added))
    # Numbered once and written, so that a row keeps its number whatever is computed again.
    long = stored(docs.where(is_long).select(*docs.columns, F.monotonically_increasing_id().alias(row)), "long-texts")
    cut = F.transform(
        F.sequence(F.lit(0), F.ceil(F.length(source) / spread_chars).cast("int") - 1),
        lambda i: F.substring(source, i * spread_chars + 1, F.lit(spread_chars)),
    )
    parts = long.select(F.col(row).alias("row"), F.posexplode(cut).alias("part", "piece")).repartition("row", "part")
    parts = parts.select("row", "part", encoder(False)(F.col("piece"))["ids"].alias("ids"))
    parts = parts.repartition("row").sortWithinPartitions("row", "part")
    whole = parts.mapInArrow(joined, "row long, ids binary, decoded string, decoded_sha256 string")
    whole = whole.select(F.col("row").alias(row), F.struct(*RESULT.names).alias(held))
    whole = long.join(whole, row).select(*names, *(F.col(held)[c].alias(c) for c in added))
    return short.unionByName(whole)


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of packed ids with U+FFFD for bytes that are no UTF-8; null ids give an empty text. A column named decoded is replaced."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(path)
        for batch in pieces(batches):
            yield pa.array([own.decode(np.frombuffer(b or b"", "<u4")) for b in batch.to_pylist()], pa.string())

    names = [c for c in df.columns if c.lower() != "decoded"]
    return df.select(*names, decode(F.col(ids)).alias("decoded"))
