"""Conversation prefix trie by adaptive radix trees.

A turn's id is a fixed-width big-endian number, the first 16 bytes of SHA-256 over its
role and text, so that a conversation's key is the row of its turns' ids and keys in byte
order stand in trie order. Equal conversations are collapsed, the distinct keys are
range-partitioned, and each partition builds an adaptive radix tree over its stretch:
inner nodes of 4, 16, 48 or 256 children that grow as needed, with compressed paths. Only
byte depths that are a multiple of the id's width are nodes of the trie.

Nodes on the paths of a partition's first and last key may go on in its neighbours. These
(at most two a partition and depth) leave as partial sums, are added up per node, and are
folded from the deepest level upwards. All others are complete where they are built.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import stored

WIDTH = 16
#: Bytes of keys that a partition's tree holds, about.
TREE_BYTES = 1 << 22
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Leaf:
    __slots__ = ("key", "value")

    def __init__(self, key: bytes, value: tuple):
        self.key, self.value = key, value


class Inner:
    """An inner node: compressed path, value of the key that ends here, children by byte.

    ``index`` is the layout: a sorted ``bytearray`` beside ``children`` for up to 4 and up to
    16, a 256-byte table of places for up to 48, None for 256 direct places.
    """

    __slots__ = ("path", "value", "room", "index", "children", "count")

    def __init__(self, path: bytes):
        self.path, self.value = path, None
        self.room, self.index, self.children, self.count = 4, bytearray(), [], 0

    def child(self, byte: int) -> Leaf | Inner | None:
        if self.room == 256:
            return self.children[byte]
        if self.room == 48:
            at = self.index[byte]
            return self.children[at - 1] if at else None
        at = self.index.find(byte)
        return self.children[at] if at >= 0 else None

    def put(self, byte: int, child: Leaf | Inner) -> None:
        """Set the child of a byte, in the next larger layout where this one is full."""
        if self.child(byte) is None:
            if self.count == self.room:
                self._grow()
            self.count += 1
            if self.room == 48:
                self.children.append(child)
                self.index[byte] = len(self.children)
                return
            if self.room < 48:
                at = next((i for i, b in enumerate(self.index) if b > byte), len(self.index))
                self.index.insert(at, byte)
                self.children.insert(at, child)
                return
        if self.room == 256:
            self.children[byte] = child
        elif self.room == 48:
            self.children[self.index[byte] - 1] = child
        else:
            self.children[self.index.find(byte)] = child

    def _grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            table = bytearray(256)
            for i, b in enumerate(self.index):
                table[b] = i + 1
            self.room, self.index = 48, table
        else:
            direct = [None] * 256
            for b in range(256):
                if self.index[b]:
                    direct[b] = self.children[self.index[b] - 1]
            self.room, self.index, self.children = 256, None, direct

    def items(self) -> list:
        """Children in byte order."""
        if self.room == 48:
            return [self.children[i - 1] for i in self.index if i]
        return [c for c in self.children if c is not None]


class RadixTree:
    """Keys to values; a key may be the beginning of another."""

    def __init__(self):
        self.root: Leaf | Inner | None = None

    def insert(self, key: bytes, value: tuple) -> None:
        at, above, node = 0, None, self.root
        while True:
            if node is None:
                new = Leaf(key, value)
            elif isinstance(node, Leaf):
                if node.key == key:
                    node.value = value
                    return
                rest, own = key[at:], node.key[at:]
                same = _common(rest, own)
                new = Inner(rest[:same])
                self._hang(new, at + same, node.key, node)
                self._hang(new, at + same, key, Leaf(key, value))
            else:
                same = _common(node.path, key[at : at + len(node.path)])
                if same == len(node.path):
                    at += same
                    if at == len(key):
                        node.value = Leaf(key, value)
                        return
                    above, byte = node, key[at]
                    node, at = node.child(byte), at + 1
                    continue
                new = Inner(node.path[:same])
                byte_of_old, node.path = node.path[same], node.path[same + 1 :]
                new.put(byte_of_old, node)
                self._hang(new, at + same, key, Leaf(key, value))
            if above is None:
                self.root = new
            else:
                above.put(key[at - 1], new)
            return

    @staticmethod
    def _hang(node: Inner, depth: int, key: bytes, leaf: Leaf) -> None:
        if len(key) == depth:
            node.value = leaf
        else:
            node.put(key[depth], leaf)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _digest(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()


#: Fields of a row that a partition's tree sends.
SENT = (
    "node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, chars bigint, ends_sha256 string"
)


def trie_rows(tree: RadixTree, first: bytes, last: bytes, width: int = WIDTH) -> Iterator[tuple]:
    """Rows (as ``SENT``) of a tree whose keys run from ``first`` to ``last``.

    A row with ``node`` is open: on the path of the first or last key, its children, leaves
    and saved tokens counted without its open descendants, whose rows name it as ``parent``.
    A closed row names an open parent by digest and a closed one by its ``parent_conv_id``.
    """
    if tree.root is None:
        return
    # Elements in order, parents first: (element, end of the parent's span, place of the parent).
    order: list[tuple] = []
    stack: list[tuple] = [(tree.root, 0, -width, -1)]
    while stack:
        element, start, above, parent = stack.pop()
        if isinstance(element, Leaf):
            order.append((element, len(element.key), above, parent))
            continue
        end = start + len(element.path)
        place = len(order)
        order.append((element, end, above, parent))
        stack.extend((child, end + 1, end, place) for child in element.items())
    n = len(order)
    convs, least, some = [0] * n, [None] * n, [None] * n
    leaves, saved, tops = [0] * n, [0] * n, [0] * n  # of closed nodes below
    rows: list[list] = [[] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        element, end, above, parent = order[i]
        ends = element if isinstance(element, Leaf) else element.value
        if ends is not None:
            count, smallest, _, _ = ends.value
            convs[i] += count
            least[i] = smallest if least[i] is None else min(least[i], smallest)
            some[i] = ends
        key, chars = some[i].key, some[i].value[2]
        shared = max(_common(key, first), _common(key, last))
        # turn-aligned depths of this element's span, the deepest first; the root has depth 0
        for t in range(end - end % width, above, -width):
            own = (convs[i] - 1) * chars[t // width - 1] if t else 0
            hashed = ends.value[3] if ends is not None and t == end else None
            is_open = t <= shared
            if not is_open:
                leaves[i] = leaves[i] or 1
                saved[i] += own
            rows[i].append((t, is_open, tops[i], leaves[i], saved[i], chars[t // width - 1] if t else 0, hashed))
            if is_open:
                leaves[i] = saved[i] = tops[i] = 0
            else:
                tops[i] = 1
        if parent >= 0:
            convs[parent] += convs[i]
            least[parent] = least[i] if least[parent] is None else min(least[parent], least[i])
            some[parent] = some[i]
            leaves[parent] += leaves[i]
            saved[parent] += saved[i]
            tops[parent] += tops[i]
    nearest: list[tuple] = [(None, False, None)] * n  # (depth, open, smallest member) of the last node at or above
    for i, (_, _, _, parent) in enumerate(order):
        up = nearest[parent] if parent >= 0 else (None, False, None)
        key = some[i].key
        for t, is_open, n_children, n_leaves, tokens, chars, hashed in reversed(rows[i]):
            yield (
                _digest(key[:t]) if is_open else None, _digest(key[: up[0]]) if up[1] else None, least[i], t // width,
                None if up[1] or up[0] is None else up[2], convs[i], n_children, n_leaves, tokens, chars, hashed,
            )
            up = (t, is_open, least[i])
        nearest[i] = up


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_I, _B, _S = pa.int64(), pa.binary(), pa.string()
_SENT = pa.schema([("node", _B), ("parent", _B), ("conv_id", _I), ("depth", _I), ("parent_conv_id", _I), ("n_convs", _I),
                   ("n_children", _I), ("n_leaves", _I), ("saved_tokens", _I), ("chars", _I), ("ends_sha256", _S)])
_SEQUENCE = pa.schema([("key", _B), ("chars", pa.list_(pa.int32())), ("n", _I), ("least", _I), ("ends_sha256", _S)])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations sorted by (key, conv_id) to one row a key; the ids' hash is fed as they stream by."""

    def rows() -> Iterator[tuple]:
        key, chars, n, least, ends = None, None, 0, None, None
        for b in batches:
            for c, k, lengths in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if k == key:
                    ends.update(b",%d" % c)
                    n += 1
                    continue
                if key is not None:
                    yield key, chars, n, least, ends.hexdigest()
                key, chars, n, least, ends = k, lengths, 1, c, hashlib.sha256(b"%d" % c)
        if key is not None:
            yield key, chars, n, least, ends.hexdigest()

    yield from _batches(rows(), _SEQUENCE)


def _grow_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, first, last = RadixTree(), None, b""
    for b in batches:
        for key, chars, n, least, ends in zip(*(col.to_pylist() for col in b.columns), strict=True):
            first, last = key if first is None else first, key
            tree.insert(key, (n, least, chars, ends))
    yield from _batches(trie_rows(tree, first, last), _SENT)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes, deepest first: children, leaves and saved tokens of open descendants are added."""

    def rows() -> Iterator[tuple]:
        below: dict[bytes, list[int]] = defaultdict(lambda: [0, 0, 0])
        for b in batches:
            for node, parent, conv, depth, _, convs, children, leaves, saved, chars, ends in zip(
                *(c.to_pylist() for c in b.columns), strict=True
            ):
                more = below.pop(node, (0, 0, 0))
                children += more[0]
                leaves = leaves + more[1] if children else 1
                saved += more[2] + (convs - 1) * chars
                if parent is not None:
                    for k, v in enumerate((1, leaves, saved)):
                        below[parent][k] += v
                yield node, parent, conv, depth, None, convs, children, leaves, saved, chars, ends

    yield from _batches(rows(), _SENT)


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal digits of a turn's id; the role's length keeps (role, text) apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH)


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % 6


def rebuilt_conversations(turns: DataFrame, group: int = 100, longest_head: int = 5) -> DataFrame:
    """(conv_id, turns): every conversation behind the first turns of its group's first conversation.

    ``turns`` is an array of (turn, id, chars), ordered by turn, null first; turns with one
    number go by their id. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.struct("turn", turn_id(role, text).alias("id"), F.length(text).alias("chars")).alias("t")
    )
    own = stored(slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "conversations")
    heads = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("lead"), F.slice("turns", 1, longest_head).alias("head")
    )
    led = own.withColumn("lead", F.col("conv_id") - F.col("conv_id") % group).join(heads, "lead", "left")
    n = head_length(F.col("conv_id")).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), n)
    tail = F.slice("turns", n + 1, F.size("turns"))
    return led.select("conv_id", F.concat(head, tail).alias("turns"))


def prefix_trie(conversations: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """One row per node of the trie of sequences (conv_id, turns) as ``rebuilt_conversations`` gives them.

    ``conv_id``: the smallest member; ``depth``; ``parent_conv_id``: the parent's ``conv_id``
    (null at the root); ``n_convs``; ``n_children``; ``n_leaves``; ``saved_tokens``;
    ``ends_sha256``: over the ids of the members that end at the node.

    An empty table has no nodes; a sequence without turns ends at the root. Equal sequences
    meet in one task, where they stream by in order of their ids (the hash is sequential by
    definition), so a group of any size takes constant memory there. One conversation is one
    key: 20 bytes a turn travel together, its texts stay behind.
    """
    names = F.transform("turns", lambda t: t["id"])
    slim = conversations.select(
        "conv_id", F.unhex(F.array_join(names, "")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars")
    )
    dealt = slim.repartition("key").sortWithinPartitions("key", "conv_id")
    sequences = stored(
        dealt.mapInArrow(_collapse, "key binary, chars array<int>, n bigint, least bigint, ends_sha256 string"), "sequences"
    )
    total = sequences.agg(F.sum(F.octet_length("key") + WIDTH)).first()[0] or 0
    least = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = sequences.repartitionByRange(max(least, -(-total // tree_bytes)), "key").sortWithinPartitions("key")
    sent = stored(stretches.mapInArrow(_grow_trees, SENT), "trie")
    fields = [f.name for f in _SENT]
    opened = sent.where("node is not null").groupBy("node").agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        *(F.max(c).alias(c) for c in ("parent", "depth", "parent_conv_id", "chars", "ends_sha256")),
        F.min("conv_id").alias("conv_id"),
    ).select(*fields)
    # at most two nodes a partition and depth; _fold keeps sums of one level
    folded = stored(opened.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_fold, SENT), "trie-top")
    closed = sent.where("node is null")
    up = folded.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    hung = closed.where("parent is not null").union(folded).join(up, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    every = closed.where("parent is null").select(*fields).union(hung.select(*fields))
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
