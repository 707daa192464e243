"""Queries of the training-data operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import (
    ball_tree,
    bpe,
    flow_mix,
    host_reputation,
    html_extract,
    hyperdim_langid,
    jaccard_join,
    license_scan,
    piece_agenda,
    prefix_trie,
    quality_llr,
    sharding,
    subspace_join,
)
from tabforge.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 16
BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECE_PATH = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [
    host_reputation.Rule("com", "/", "allow"),
    host_reputation.Rule("example.com", "/en/", "block"),
    host_reputation.Rule("www.example.com", "/en/", "allow"),
    host_reputation.Rule("net", "/es/", "block"),
    host_reputation.Rule("net", "/fr/", "block"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, shuffled uniformly (law ``rows``).

    A null text has no bytes: size 1, checksum 0.
    """
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it is kept for every embedding (cosine 0.98, equal labels)."""
    return subspace_join.link_vectors(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url: path rules, else the host's reputation."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return host_reputation.judge_urls(pages, "url", URL_RULES).drop("url")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, BPE_PATH, digest=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "decoded_sha256",
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document, wrapped ones included.

    The SQL looks at single lines; it says the same where every notice stands in a line of its own.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs, passages=True).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface counts and the likelihood-ratio verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_llr.quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the four folds that are not held out.

    A document without an id is neither held out nor learned from.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(held_out("doc_id"), F.lit(False))
    found = hyperdim_langid.predict_language(docs, train=F.coalesce(~held_out("doc_id"), F.lit(False)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under word 5-gram Jaccard similarity of 0.75 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' weights; a document belongs to the source it names."""
    docs = table(spark, sf_dir, "documents")
    words = flow_mix.word_count(F.col("text"))
    slim = stored(docs.select("doc_id", "source", words.alias("words"), F.xxhash64("text").alias("text_id")), "mix-sizes")
    sizes = flow_mix.source_sizes(slim, F.col("words"), "source")
    targets = flow_mix.source_targets(sizes)
    identity = [F.col("doc_id"), F.col("text_id")]
    mixed = flow_mix.mix_sources(slim, F.col("words"), F.array("source"), targets, identity)
    per_source = spark.createDataFrame(
        [(s, sizes[s], float(targets[s])) for s in sizes], "name string, source_size long, target double"
    )
    joined = mixed.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("name")), "left")  # one row a source
    return joined.select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ball_tree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over all rebuilt conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt_conversations(turns))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the SentencePiece vocabulary; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_agenda.encode_pieces(docs, PIECE_PATH, decoded=False, digest=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        "decoded_sha256",
        "agrees",
    )


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_sharding, op2_subspace_join, op3_url_filter, op4_bpe, op5_license_scan, op6_quality, op7_language_id,
        op8_html_extract, op9_jaccard, op10_mix, op11_search, op12_prefix_trie, op13_pieces,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id) c ON c.vec_id = e.vec_id
"""

_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_BY_LENGTH = sorted(URL_RULES, key=lambda r: (-len(r.text), r.text))
_URL_RULE = " ".join(f"WHEN {_FITS.format(h=r.host, p=r.path)} THEN '{r.text}'" for r in _BY_LENGTH)
_URL_VERDICT = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in _BY_LENGTH)
_PRIOR = host_reputation.Prior()


def _fit_sql(children: str, parents: str, keys: str) -> str:
    """A parent's mean and the strength of the prior that it gives its children."""
    using = f"JOIN {parents} USING ({keys})" if keys else f", {parents}"
    by = f"GROUP BY {keys}" if keys else ""
    return f"""
  SELECT {keys + ',' if keys else ''} pm, CASE WHEN pn > 0 THEN
      greatest({_PRIOR.least_strength}, least({_PRIOR.most_strength}, coalesce(
        CASE WHEN ps / pn - pm * (1 - pm) * pc / pn > 0
          THEN (pm * (1 - pm) - ps / pn) / (ps / pn - pm * (1 - pm) * pc / pn) END, {_PRIOR.most_strength})))
    ELSE {_PRIOR.most_strength} END AS k
  FROM (SELECT {keys + ',' if keys else ''} max(m) AS pm, sum(n) AS pn, count(*) FILTER (n > 0) AS pc,
      coalesce(sum(CASE WHEN n > 0 THEN n * power(x / nullif(n, 0) - m, 2) END), 0) AS ps
    FROM {children} {using} {by})"""


_SUFFIX_END = host_reputation.suffix_pattern(host_reputation.SUFFIXES)
_OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{host_reputation.URL_PATTERN}', 1), {_AZ}), '') AS host,
    coalesce(regexp_extract(url, '{host_reputation.URL_PATTERN}', 2), '') AS path FROM pages
), u2 AS (SELECT *, CASE {_URL_RULE} END AS rule FROM u
), u3 AS (SELECT *, CASE rule {_URL_VERDICT} END AS verdict FROM u2
), h AS (
  SELECT host, regexp_extract(host, '(?:^|\.)({_SUFFIX_END})', 1) AS suffix,
    regexp_extract(host, '(?:^|\.)((?:[^.]*\.)?{_SUFFIX_END})', 1) AS domain,
    count(verdict)::DOUBLE AS n, (count(*) FILTER (verdict = 'block'))::DOUBLE AS x FROM u3 GROUP BY host
), d AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM d GROUP BY ALL
), t AS (SELECT (sum(x) + 0.5) / (sum(n) + 1.0) AS m FROM s
), ft AS ({_fit_sql('s', 't', '')}
), s2 AS (SELECT suffix, (x + k * pm) / (n + k) AS m FROM s, ft
), fs AS ({_fit_sql('d', 's2', 'suffix')}
), d2 AS (SELECT suffix, domain, (x + k * pm) / (n + k) AS m FROM d JOIN fs USING (suffix)
), fd AS ({_fit_sql('h', 'd2', 'suffix, domain')}
), h2 AS (SELECT host, n, k, (x + k * pm) / (n + k) AS m FROM h JOIN fd USING (suffix, domain))
SELECT page_id, host, path, rule, n::BIGINT AS n_labelled,
  coalesce(verdict, CASE WHEN m - {_PRIOR.z} * sqrt(m * (1 - m) / (n + k + 1)) > {_PRIOR.limit} THEN 'block' ELSE 'allow' END)
    AS verdict
FROM u3 JOIN h2 USING (host)
"""


def _phrase_sql(phrase: str) -> str:
    words = phrase.split()
    here = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(words))
    return f"list_filter(range(len(ws) - {len(words) - 1}), lambda i: {here})"


_TEMPLATE_ROWS = ", ".join(
    f"('{label}', [{', '.join(repr(w.decode()) for w in sorted(set(license_scan.fold(t).split())))}])"
    for label, texts in license_scan.TEMPLATES.items() for t in texts
)
_LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP5_SQL = rf"""
WITH t(label, tw) AS (VALUES {_TEMPLATE_ROWS}), low AS (
  SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS text FROM documents
), w AS (SELECT doc_id, regexp_extract_all(text, '{_LICENSE_WORD}') AS ws FROM low
), p AS (
  SELECT doc_id, len(ws) AS n_words, {_phrase_sql('cc by')} AS a, {_phrase_sql('general public license')} AS b,
    {_phrase_sql('all rights reserved')} AS c FROM w
), l AS (
  SELECT doc_id, row_number() OVER () AS line, list_distinct(regexp_extract_all(x, '{_LICENSE_WORD}')) AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM low)
), m AS (
  SELECT doc_id, line, label, tw, len(list_intersect(ws, tw)) / len(tw) AS c FROM l JOIN t
    ON len(list_intersect(ws, tw)) >= greatest(1, ceil(0.9 * len(tw) - 1e-9))
), best AS (
  SELECT doc_id, max(c) AS c, list(DISTINCT label) AS labels FROM m
  WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.line = m.line AND len(o.tw) > len(m.tw)
    AND len(list_intersect(o.tw, m.tw)) = len(m.tw))
  GROUP BY doc_id
), q AS (
  SELECT *, a || b || c AS places, list_filter(['cc-by', 'gpl', 'reserved'],
    lambda x: x = CASE WHEN len(a) > 0 THEN 'cc-by' END OR x = CASE WHEN len(b) > 0 THEN 'gpl' END
      OR x = CASE WHEN len(c) > 0 THEN 'reserved' END) AS base FROM p
)
SELECT q.doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(best.labels, []))), ',') AS labels,
  coalesce(best.c, CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM q LEFT JOIN best ON best.doc_id = q.doc_id
"""

_OP9_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(g) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}') AS ws FROM documents
), s AS (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws))::BIGINT AS l FROM d
), tf AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL
), wt AS (
  SELECT w, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM tf, s GROUP BY w
), m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ws) * n) // l AS m FROM d, s WHERE len(ws) > 0
), i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}') AS ws FROM benchmark
), q AS (SELECT i, item_id, w, count(*) AS c FROM (SELECT i, item_id, unnest(ws) AS w FROM i) GROUP BY ALL
), f AS (
  SELECT i, item_id, r, doc_id, sum(c * wt * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN wt USING (w) JOIN tf USING (w) JOIN m USING (r) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY rank <= 20
"""

# CRC-32 of a decimal number's characters, bit by bit (fixed value: the reflected polynomial).
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
      lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295)"""

_OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, {{'id': length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''),
    'n': length(coalesce(text, ''))}} AS t FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST) AS ts, {_CRC32} % 6 AS h FROM t GROUP BY conv_id
), r AS (
  SELECT o.conv_id, coalesce(b.ts, [])[1:o.h] || o.ts[o.h + 1:] AS ts FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100
), p AS (
  SELECT conv_id, d, list_transform(ts[1:d], lambda x: x.id) AS p, CASE WHEN d > 0 THEN ts[d].n ELSE 0 END AS n, len(ts) = d AS ends
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)
), m AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY p, d
), c AS (
  SELECT m.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM m x WHERE x.d = m.d + 1 AND x.p[1:m.d] = m.p) AS n_children
  FROM m LEFT JOIN m u ON u.d = m.d - 1 AND u.p = m.p[1:m.d - 1]
)
SELECT any_value(c.conv_id) AS conv_id, c.d AS depth, any_value(c.parent_conv_id) AS parent_conv_id, any_value(c.n_convs) AS n_convs,
  any_value(c.n_children) AS n_children, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.own)::BIGINT AS saved_tokens,
  any_value(c.ends_sha256) AS ends_sha256
FROM c JOIN c x ON x.d >= c.d AND x.p[1:c.d] = c.p GROUP BY c.p, c.d
"""

ORACLE_SQL: dict[str, str] = {
    "op11_search": _OP11_SQL, "op12_prefix_trie": _OP12_SQL,
    "op2_subspace_join": _OP2_SQL, "op3_url_filter": _OP3_SQL, "op5_license_scan": _OP5_SQL, "op9_jaccard": _OP9_SQL,
}
