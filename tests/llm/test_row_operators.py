"""Sharding, mixing, URL filter and the two joins against brute force and edge cases."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import flow_mix, host_reputation, jaccard_join, sharding, subspace_join
from tabforge.llm.common import components
from tabforge.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

SF001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = QUERIES[name](spark, SF001).select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want.fetchall()))


# --- components ------------------------------------------------------------------------------------------------------


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges = [rng.choice([(a, b), (b, a)]) for a, b in edges] + [(5, 5), (None, 3)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(7), "test").collect()
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {200 + i: 200 for i in range(1, 9)}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


# --- sharding --------------------------------------------------------------------------------------------------------


def test_matrix_has_its_margins():
    counts = np.array([5, 0, 17, 1, 30, 8])
    sizes, each = sharding.bin_sizes(int(counts.sum()), 4, 7)
    assert each == 3 and sizes.sum() == counts.sum() and len(sizes) == 12
    rows = np.stack([sharding.matrix_row(counts, sizes, i, 9) for i in range(len(counts))])
    assert rows.sum(axis=1).tolist() == counts.tolist()
    assert rows.sum(axis=0).tolist() == sizes.tolist()


def test_sharding_query_places_every_row(spark):
    import zlib
    from collections import Counter

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = QUERIES["op1_sharding"](spark, SF001).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(list(docs))
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_large_populations_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, drawn = 3 * 10**9, 7 * 10**9, 10**6
    draws = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(400)])
    sd = np.sqrt(drawn * 0.3 * 0.7)
    assert abs(draws.mean() - 0.3 * drawn) < 5 * sd / 20
    assert 0.85 < draws.std() / sd < 1.15
    small = np.array([sharding.hypergeometric(rng, 4, 3, 3) for _ in range(4000)])
    want = np.array([1, 12, 18, 4]) / 35
    assert np.abs(np.bincount(small, minlength=4) / 4000 - want).max() < 0.03
    split = sharding.multivariate(rng, np.array([2 * 10**9, 10**9, 5]), 10**9)
    assert split.sum() == 10**9 and split[2] <= 5


def test_shards_are_exact_and_whole(spark):
    rows = [(i // 2, None if i % 5 == 0 else "t" * (i % 7), "s") for i in range(103)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SHARD string").repartition(6)
    got = sharding.shuffle_into_shards(df, 4, seed=3, rows_per_bin=10).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((a, b or "") for a, b, _ in rows)
    for s, n in enumerate([26, 26, 26, 25]):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert sharding.shuffle_into_shards(df.where("false"), 4).count() == 0
    assert sorted(r["shard"] for r in sharding.shuffle_into_shards(df.limit(2), 4).collect()) == [0, 1]


def test_every_place_is_equally_likely(spark):
    df = spark.range(6, numPartitions=2)
    seen = np.zeros((6, 6))
    for seed in range(60):
        for r in sharding.shuffle_into_shards(df, 2, seed=seed).collect():
            seen[r["id"], r["shard"] * 3 + r["slot"]] += 1
    assert ((seen - 10) ** 2 / 10).sum() < 55  # chi-square, 25 degrees of freedom, p about 0.0005


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_targets_fill_up_to_the_limit():
    got = flow_mix.source_targets({"b": 100, "a": 10, None: 1000, "c": 0})
    assert got["a"] == 30 and got["c"] == 0  # a weighs 5, b 2, c 1, null 5
    assert sum(got.values()) == pytest.approx(1110)
    assert got["b"] == pytest.approx(300) and got[None] == pytest.approx(780)
    assert flow_mix.source_targets({}) == {}


def test_flow_is_maximal_and_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        n_p, n_s, repeats = rng.randint(1, 3), rng.randint(1, 3), 2
        supply = [rng.randint(0, 3) for _ in range(n_p)]
        members = [sorted(rng.sample(range(n_s), rng.randint(0, n_s))) for _ in range(n_p)]
        quota = [rng.randint(0, 5) for _ in range(n_s)]
        flow = flow_mix.cheapest_flow(supply, members, quota, repeats)
        sent = [sum(f.values()) for f in flow]
        into = [sum(f.get(s, 0) for f in flow) for s in range(n_s)]
        assert all(x <= repeats * w for x, w in zip(sent, supply, strict=True))
        assert all(x <= q for x, q in zip(into, quota, strict=True))

        def feasible(amounts, members=members, quota=quota):  # Hall's condition over sets of patterns
            for k in range(1, len(amounts) + 1):
                for some in itertools.combinations(range(len(amounts)), k):
                    reach = set().union(*(members[p] for p in some))
                    if sum(amounts[p] for p in some) > sum(quota[s] for s in reach):
                        return False
            return True

        def cost(amounts, supply=supply):
            return sum(max(0, x - w) for x, w in zip(amounts, supply, strict=True))

        options = [a for a in itertools.product(*(range(repeats * w + 1) for w in supply)) if feasible(a)]
        most = max(map(sum, options))
        assert sum(sent) == most
        assert cost(sent) == min(cost(a) for a in options if sum(a) == most)


def test_overlapping_sources_reach_their_quotas(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([["a"], ["b"], ["a", "b"], ["b", "a", "b"], [None]]), rng.randint(1, 20)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, m array<string>, w int").withColumn("TAKEN", F.lit("x"))
    total = sum(w for _, _, w in rows)
    targets = {"a": 0.55 * total, "b": 0.6 * total, None: 0.3 * total}
    p = flow_mix.MixParams(rows_per_range=100)
    got = flow_mix.mix_sources(docs, F.col("w"), F.col("m"), targets, [F.col("id")], p).collect()
    assert len(got) == 3000
    served = dict.fromkeys(targets, 0)
    for r in got:
        assert r["taken"] == r["repeats"] * r["w"] <= 3 * r["w"] and len(r["assigned"] or []) == r["repeats"]
        for s in r["assigned"] or []:
            assert s in r["m"]
            served[s] += r["w"]
    for s, t in targets.items():
        assert served[s] == pytest.approx(t, rel=0.02)
    again = flow_mix.mix_sources(docs.repartition(5), F.col("w"), F.col("m"), targets, [F.col("id")], p).collect()
    assert {(r["id"], r["repeats"]) for r in got} == {(r["id"], r["repeats"]) for r in again}


def test_mix_edges(spark):
    kind = "doc_id long, text string, source string"
    rows = [(1, None, "a"), (2, "", None), (3, "x y z", None), (3, "x y z", None), (None, "w " * 30000, "b")]
    docs = spark.createDataFrame(rows, kind)
    words = flow_mix.word_count(F.col("text"))
    sizes = flow_mix.source_sizes(docs, words, "source")
    assert sizes == {"a": 0, "b": 30000, None: 6}
    targets = flow_mix.source_targets(sizes)
    got = flow_mix.mix_sources(docs, words, F.array("source"), targets, [F.col("doc_id")]).collect()
    taken = {r["source"]: r["taken"] for r in got}
    assert taken["a"] == 0 and len(got) == 5
    assert sum(r["taken"] for r in got if r["source"] is None) == 18
    empty = docs.where("false")
    assert flow_mix.mix_sources(empty, words, F.array("source"), {}, [F.col("doc_id")]).count() == 0
    assert flow_mix.mix_sources(docs, words, F.lit(None).cast("array<string>"), targets, [F.col("doc_id")]).where("taken > 0").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_mix_leaves_no_document_that_fits(spark, seed):
    rng = random.Random(seed)
    sizes = [min(5000, int(rng.paretovariate(0.5))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n long").withColumn("source", F.lit("a"))
    target = sum(sizes) * 0.37
    got = flow_mix.mix_sources(docs, F.col("n"), F.array("source"), {"a": target}, [F.col("doc_id")], flow_mix.MixParams(seed=seed)).collect()
    gap = round(target) - sum(r["taken"] for r in got)
    assert gap >= 0 and all(r["repeats"] <= 1 for r in got)
    assert not [r for r in got if r["repeats"] == 0 and r["n"] <= gap]


def test_mix_query_meets_targets(spark):
    rows = QUERIES["op10_mix"](spark, SF001).join(
        spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "source"), "doc_id"
    ).collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], [0, r["target"], 0])
        s[0] += r["taken"]
        s[2] = max(s[2], r["size"])
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest + 1
    assert sum(t for _, t, _ in by.values()) == pytest.approx(sum(r["size"] for r in rows))


# --- URL filter ------------------------------------------------------------------------------------------------------


def test_very_long_urls_and_no_pages(spark):
    path = "/en/" + "x" * 300_000
    pages = spark.createDataFrame([(1, f"http://A.example.com{path}?q"), (2, "http://" + "a." * 5_000 + "net/fr/")], "page_id long, url string")
    got = {r["page_id"]: r for r in host_reputation.judge_urls(pages, "url", URL_RULES).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("a.example.com", path, "example.com/en/")
    assert got[2]["rule"] == "net/fr/" and got[2]["verdict"] == "block"
    assert host_reputation.judge_urls(pages.limit(0), "url", URL_RULES).collect() == []


def test_urls_are_cut_and_ruled(spark):
    urls = {
        None: ("", "", None), "": ("", "", None), "no scheme/here": ("", "", None), "://": ("", "", None),
        "HTTP://WWW.Example.COM/en/x?q=/#f": ("www.example.com", "/en/x", "www.example.com/en/"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "http://x.net/es": ("x.net", "/es", None), "http://x.net/fr/?a": ("x.net", "/fr/", "net/fr/"),
        "http://com": ("com", "", None), "x://y?z://w/": ("y", "", None), "http://É.com/": ("É.com", "/", "com/"),
        "a\nb://h/p\nq": ("h", "/p\nq", None),
    }
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    rows = host_reputation.judge_urls(pages.union(pages), "url", URL_RULES).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == urls[r["url"]]
        assert r["verdict"] in ("allow", "block")
    assert host_reputation.judge_urls(pages.where("false"), "url", URL_RULES).count() == 0
    assert host_reputation.judge_urls(pages, "url", []).where("verdict = 'block'").count() == 0


def test_bad_hosts_are_told_from_good_ones(spark):
    rows = [("bad.x.org", 1)] * 200 + [("good.x.org", 0)] * 200 + [("new.x.org", None), ("one.y.org", 1)]
    got = host_reputation.host_bounds(spark.createDataFrame(rows, "host string, bad int"))
    bound = {r["host"]: r["bound"] for r in got.collect()}
    assert bound["bad.x.org"] > 0.9 > 0.2 > bound["good.x.org"]
    assert bound["bad.x.org"] > bound["one.y.org"] > bound["good.x.org"]
    assert bound["new.x.org"] < 0.5


def test_registered_domains_follow_the_longest_suffix_of_the_list(spark):
    hosts = {
        "a.b.x.co.uk": ("co.uk", "x.co.uk"), "x.co.uk": ("co.uk", "x.co.uk"), "co.uk": ("co.uk", "co.uk"),
        "taco.uk": ("uk", "taco.uk"), "a.taco.uk": ("uk", "taco.uk"), "uk": ("uk", "uk"), "": ("", ""), "w.x.com": ("com", "x.com"),
        "x.com:80": ("com:80", "x.com:80"), "1.2.3.4": ("4", "3.4"), "a.blog.co.uk": ("blog.co.uk", "a.blog.co.uk"), "x.": ("", "x."),
    }
    end = host_reputation.suffix_pattern([*host_reputation.SUFFIXES, "blog.co.uk"])
    for host, (suffix, domain) in hosts.items():
        assert re.search(rf"(?:^|\.)({end})", host)[1] == suffix
        assert re.search(rf"(?:^|\.)((?:[^.]*\.)?{end})", host)[1] == domain
    # sites under co.uk are no longer one domain: a bad one does not pull its neighbours
    rows = [("a.bad.co.uk", 1)] * 300 + [("b.good.co.uk", 0)] * 300 + [("new.good.co.uk", None), ("new.bad.co.uk", None)]
    table = spark.createDataFrame(rows, "host string, bad int")
    bound = {r["host"]: r["bound"] for r in host_reputation.host_bounds(table).collect()}
    assert bound["new.bad.co.uk"] > bound["new.good.co.uk"]
    plain = {r["host"]: r["bound"] for r in host_reputation.host_bounds(table, suffixes=()).collect()}
    assert plain["new.bad.co.uk"] == plain["new.good.co.uk"]


# --- Jaccard join ----------------------------------------------------------------------------------------------------


def components_slowly(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles_slowly(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_texts(seed, groups=25, edits=6):
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(40))
    out = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 160))]
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
            text = " ".join(words)
            out.append(passage + " " + text if rng.random() < 0.4 else text.upper() if rng.random() < 0.1 else text)
    return out


@pytest.mark.parametrize("params", [{}, {"entries": 50, "hot": 3, "sketch_bits": 8}, {"bloom_bits": 64}])
def test_jaccard_components_against_brute_force(spark, params):
    texts = near_texts(len(params)) + [None, "", "  ", "one two", "ONE  two", "one two three", "x " * 30_000]
    texts += texts[:3]
    docs = spark.createDataFrame([(i * 7 % 1009, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Component_ID string")
    rows = docs.collect()
    sets = {r["doc_id"]: shingles_slowly(r["text"]) for r in rows}
    want = components_slowly(
        list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and bool(sets[b])
    )
    got = jaccard_join.jaccard_components(docs.repartition(5), params=jaccard_join.JaccardParams(**params)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {k: len(s) for k, s in sets.items()}
    assert len(set(want.values())) < len(want) - 8


def test_jaccard_null_keys_and_empty_tables(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (None, "q r"), (None, None)], "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in jaccard_join.jaccard_components(docs).collect())))
    assert got == sorted(map(repr, [(None, 4, 4), (4, 4, 4), (4, 4, 4), (None, 1, None), (None, 0, None)]))
    assert jaccard_join.jaccard_components(docs.where("false")).count() == 0


# --- embeddings ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("params", [{}, {"tile": 7, "hot": 20, "entries": 500, "sketch_bits": 8}, {"tile": 16, "cube": 2.5, "block_dims": 3}])
def test_vector_links_against_brute_force(spark, params):
    rng = np.random.default_rng(len(params))
    centres = rng.standard_normal((12, 20))
    rows = []
    for i in range(260):
        c = centres[rng.integers(0, 12) if i % 3 else 0]
        x = c / np.linalg.norm(c) + rng.standard_normal(20) * rng.choice([0.0, 0.01, 0.03, 0.05])
        rows.append((i * 11 % 263, [float(v) for v in x * rng.choice([1.0, 1.0, 7.5])], int(rng.integers(0, 3)), "x"))
    rows += [(900, None, 1, "x"), (901, [], 1, "x"), (902, [0.0] * 20, 1, "x"), (903, [float("nan")] * 20, 1, "x"),
             (904, [None] * 20, 1, "x"), (905, rows[0][1], None, "x"), (906, [1.0, 2.0], 1, "x"), (907, [2.0, 4.0], 1, "x"),
             (908, [float("inf")] + [1.0] * 19, 1, "x"), (909, rows[5][1], rows[5][2], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, N_links string")
    good = {k: (np.array(v), lab) for k, v, lab, _ in rows if lab is not None and k not in (900, 901, 902, 903, 904, 908)}

    def linked(a, b):
        if a not in good or b not in good:
            return False
        (x, p), (y, q) = good[a], good[b]
        return p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    ids = [r[0] for r in rows]
    want = components_slowly(ids, linked)
    links = {a: sum(linked(a, b) for b in ids if b != a) for a in ids}
    got = subspace_join.link_vectors(df.repartition(4), params=subspace_join.SubspaceParams(**params)).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert {r["vec_id"]: r["n_links"] for r in got} == links
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert max(links.values()) > 20


def test_vector_null_keys_repeated_rows_and_empty_tables(spark):
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(repr, (tuple(r) for r in subspace_join.link_vectors(df).collect())))
    want = [(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, False)]
    assert got == sorted(map(repr, want))
    assert subspace_join.link_vectors(df.where("false")).count() == 0
