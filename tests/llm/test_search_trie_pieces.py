"""Ball-tree search, conversation trie and SentencePiece agenda against brute force, the library and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tabforge.llm import ball_tree, piece_agenda, prefix_trie
from tabforge.llm.queries import PIECE_PATH, QUERIES

SF001 = "/root/testdata/sf0.001"

# --- ranked search ---------------------------------------------------------------------------------------------------


def ranked(docs, items, k=20):
    """Brute force of the scoring law."""
    bags = [(d, ball_tree.terms(t)) for d, t in docs]
    bags = [(d, w, Counter(w)) for d, w in bags if w]
    n, total = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for d, w, c in bags:
            m = 75 + (25 * len(w) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in ball_tree.terms(text) if t in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return out


def words(rng, n, size=60):
    return " ".join(rng.choice("abcdefgh") + str(int(rng.paretovariate(0.6)) % size) for _ in range(n))


def test_search_equals_brute_force_with_ties_copies_and_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, words(rng, rng.randint(0, 80))) for i in range(700)]
    docs += [(i, docs[3][1]) for i in range(900, 990)] + [(7, docs[3][1])] * 2  # copies tie, one id repeats
    docs += [(2000, None), (2001, ""), (2002, " .,; "), (None, docs[5][1]), (None, None), (2003, words(rng, 30_000))]
    docs += [(2004, "É\x00É ÀB1 ab1"), (2005, "K ſ é")]
    items = [(i, words(rng, rng.randint(1, 25))) for i in range(30)]
    items += [(100, docs[3][1]), (101, None), (102, ""), (103, "nowhere"), (None, "a1 a1 b2"), (105, "É é AB1"), (100, "a1")]
    rows = [(d, t, "x", 1) for d, t in docs]
    monkeypatch.setattr(ball_tree, "BLOCK_DOCS", 90)
    got = ball_tree.rank_documents(
        spark.createDataFrame(rows, "doc_id long, text string, rank string, item long").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ranked(docs, items)))
    few = ball_tree.rank_documents(
        spark.createDataFrame(rows, "doc_id long, text string, rank string, item long"),
        spark.createDataFrame(items, "item_id long, text string"), k=3, query_terms=50,
    ).collect()
    assert sorted(map(repr, map(tuple, few))) == sorted(map(repr, ranked(docs, items, 3)))  # several passes


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])])
def test_search_of_nothing(spark, docs, items):
    got = ball_tree.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def test_balls_hold_their_rows_and_prune():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):  # clusters with words of their own
        group = i % 12
        at = np.unique(np.concatenate([group * 50 + rng.integers(0, 50, 12), rng.integers(600, 640, 3)])).astype(np.int32)
        rows.append((at, rng.integers(1, 10**6, len(at))))
    start = np.cumsum([0, *(len(a) for a, _ in rows)])
    exact = ball_tree.Vectors(start, np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]))
    tree = ball_tree.BallTree(exact, 640)
    leaves = [n for n in tree.nodes if n[3] is not None]
    assert sorted(np.concatenate([n[3] for n in leaves]).tolist()) == list(range(3000))
    for _ in range(20):
        query = np.zeros(640, np.int64)
        query[rng.integers(0, 50, 8) + 50 * rng.integers(0, 12)] = rng.integers(1, 20_000)
        real, scores = query.astype(float), exact.dot(np.arange(3000), query)
        for node in leaves:
            assert tree.bound(node, real) >= scores[node[3]].max()
        best = ball_tree.Best(20)
        visited = tree.search(query, best, [[(False, i)] for i in range(3000)])
        assert best.found == sorted((-s, (False, i)) for i, s in enumerate(scores.tolist()) if s > 0)[:20]
        assert visited < len(leaves)


# --- prefix trie -----------------------------------------------------------------------------------------------------


def rebuilt(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    by = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in by.items()}
    out = {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = by.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie(sequences):
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    below = defaultdict(lambda: [0, 0])
    for p, cs in members.items():
        for d in range(len(p) + 1):
            below[p[:d]][0] += not children[p]
            below[p[:d]][1] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    rows = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(sequences[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        rows.append((min(cs), len(p), up, len(cs), children[p], *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, rows))


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("tree_bytes", [1 << 22, 200])
def test_trie_equals_brute_force(spark, tree_bytes):
    rng = random.Random(9)
    rows = []
    for c in rng.sample(range(1500), 400):
        for turn in range(rng.choice([1, 2, 3, 4, 6, 9])):
            role, text = rng.choice([("user", "a"), ("user", "é😀"), ("", "usera"), (None, None), ("user", "b" * turn)])
            rows.append((c, turn, role, text))
    rows += [(c, t, "user", f"hot {t}") for c in range(5000, 5300) for t in range(4)]  # copies of one conversation
    rows += [(7000, t, "user", str(t)) for t in range(300)] + [(None, 1, "user", "lost"), (7100, None, "u", "x" * 50_000), (7100, 3, "u", "y")]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, TURNS).withColumn("n_convs", F.lit("extra")).withColumn("key", F.lit(1))
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt_conversations(turns), tree_bytes).collect()
    assert sorted(map(repr, map(tuple, got))) == trie(rebuilt(rows))


def test_trie_of_nothing_and_of_one_turnless_conversation(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt_conversations(empty)).collect() == []
    one = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)  # its one turn gives way to a missing head
    turns = spark.createDataFrame([(one, 0, "user", "gone")], TURNS)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt_conversations(turns)).collect()
    assert [tuple(r) for r in got] == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]


def test_radix_nodes_grow_and_keep_order():
    rng = random.Random(4)
    for width, fan in ((1, 3), (1, 12), (1, 40), (2, 256)):
        keys = {bytes(rng.randrange(fan) for _ in range(width * rng.randint(0, 4))) for _ in range(900)}
        tree = prefix_trie.RadixTree()
        for k in rng.sample(sorted(keys), len(keys)):
            tree.insert(k, (k,))
        rooms, found, stack = set(), [], [tree.root]
        while stack:
            node = stack.pop()
            if isinstance(node, prefix_trie.Leaf):
                found.append(node.key)
                continue
            rooms.add(node.room)
            assert node.count == len(node.items()) and node.count + (node.value is not None) >= 2  # paths are compressed
            assert node.count <= node.room
            if node.value is not None:
                found.append(node.value.key)
            stack.extend(reversed(node.items()))
        assert found == sorted(keys)
        assert {3: 4, 12: 16, 40: 48, 256: 256}[fan] in rooms


# --- sentencepiece ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_PATH)


def ids(own, texts):
    return [np.frombuffer(packed, "<i4").tolist() for packed in own.encode(texts)]


def test_agenda_equals_library(library):
    rng = random.Random(1)
    own = piece_agenda.piece_vocabulary(PIECE_PATH)
    alphabet = " ▁\n\tabcdeinthort.,;()'\"éàüß日本語の한국😀́\x00‍\xad-=/\\*0123456789ſK"
    texts = ["", " ", "  ", "▁", "a" * 500, " " * 500, "-" * 333, "x y" * 400]
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 100)))
        texts.append(t.replace(" ", "") if rng.random() < 0.2 else t + " " * rng.randint(0, 30))
    assert ids(own, texts) == library.encode(texts)


def test_check_finds_and_mends_a_difference(library):
    own = piece_agenda.PieceVocabulary(PIECE_PATH)
    texts = ["the same words", "other ones", "the  same", "the other"]
    packed, agrees = own.checked(texts)
    assert agrees == [True] * 4 and [np.frombuffer(x, "<i4").tolist() for x in packed] == library.encode(texts)
    own.words.clear()
    own.known.clear()
    own.merged = np.roll(own.merged, 1)  # a broken agenda
    packed, agrees = own.checked(texts)
    assert not all(agrees) and [np.frombuffer(x, "<i4").tolist() for x in packed] == library.encode(texts)


def test_heap_and_matrix_agree(library, monkeypatch):
    rng = random.Random(2)
    own = piece_agenda.PieceVocabulary(PIECE_PATH)
    texts = ["".join(rng.choices("abcdeinthors", k=rng.randint(1, 40))) for _ in range(500)]
    in_step = ids(own, texts)
    own.known.clear()
    own.words.clear()
    monkeypatch.setattr(piece_agenda, "MATRIX_CHARS", 0)
    assert ids(own, texts) == in_step == library.encode(texts)
    monkeypatch.setattr(own, "pattern", None)  # a text as one chunk
    own.known.clear()
    assert ids(own, texts) == in_step


def test_pieces_of_a_text_that_ends_with_a_space(library):
    own = piece_agenda.PieceVocabulary(PIECE_PATH)  # nothing remembered
    texts = ["abc ", "two words ", "abc", " "]
    packed, agrees = own.checked(texts)
    assert [np.frombuffer(p, "<i4").tolist() for p in packed] == [library.encode(t) for t in texts]
    assert agrees == [True] * len(texts)


def test_words_that_come_up_again_stay_remembered(library, monkeypatch):
    monkeypatch.setattr(piece_agenda, "REMEMBERED", 20)
    own = piece_agenda.PieceVocabulary(PIECE_PATH)
    for i in range(8):
        texts = ["often, again " + " ".join(f"rare{i}x{k}" for k in range(12))]
        packed, agrees = own.checked(texts)
        assert np.frombuffer(packed[0], "<i4").tolist() == library.encode(texts[0]) and agrees == [True]
        assert {"often,", "again"} <= own.words.keys() and len(own.words) <= 20 + 14
        own.words.bound()
        own.known.bound()
        assert not i or {"often,", "again"} <= own.words.keys()  # some of the rare ones are gone
    assert "rare0x0" not in own.words


def test_pieces_of_odd_rows(spark, library):
    long = " ".join(f"wörd{i}" for i in range(40_000)) + "z" * 20_000
    texts = [None, "", " ", "a  b ", "a\0b", "日本", long, "same", "same"]
    rows = [(i, t, "kept", "old") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held string, ids string")
    got = sorted(piece_agenda.encode_pieces(docs, PIECE_PATH).collect())
    for r, t in zip(got, texts, strict=True):
        assert r["ids"] == library.encode(t or "") and r["decoded"] == library.decode(library.encode(t or ""))
        assert r["agrees"] and r["held"] == "kept"
    assert piece_agenda.encode_pieces(docs.limit(0), PIECE_PATH).collect() == []


def test_piece_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = QUERIES["op13_pieces"](spark, SF001).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["agrees"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
