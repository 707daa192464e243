"""Mix overlapping sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources a document
belongs to). Each pattern supplies its words once for free, and again, up to
``max_repeats`` times, at a cost that rises with every repetition; words flow from
patterns to the quotas of their sources. As costs stand on the supply side only
and are the same for all patterns, the cheapest flow fills one repetition after
the other, each by augmenting paths that may re-route what earlier ones sent.

A pattern that is to give ``f`` of its ``w`` words gives every document ``f // w``
times and some once more: documents in seeded order until one would overshoot the
rest, then smaller ones after it, until no document left would fit. The choice is a handful of
cut-off hashes per pattern, so documents are chosen where they lie; only (hash,
size) rows are shuffled, summed up by hash range before any is ordered. The driver
holds one row per source and per pattern.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.llm.common import WORD_PATTERN, fresh_name, stored

WEIGHT_CYCLE = (5.0, 2.0, 1.0)


@dataclass(frozen=True)
class MixParams:
    """``rows_per_range``: rows of a pattern that are put in order at once.

    ``most_patterns``: patterns, and sources, that the driver solves the flow for; more are refused.
    """

    max_repeats: int = 3
    seed: int = 11
    rows_per_range: int = 50_000
    most_patterns: int = 100_000


def word_count(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(
    sizes: dict[str | None, int], cycle: tuple[float, ...] = WEIGHT_CYCLE, most: float = 3.0
) -> dict[str | None, float]:
    """Share all words by weight; what would pass ``most`` times a source's size is shared again.

    Sources take the cycle's weights in code point order, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    targets: dict[str | None, float] = {}
    rest, open_ = float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not above:
            targets |= {s: rest * weight[s] / total for s in open_}
            break
        for s in above:
            targets[s] = most * sizes[s]
        rest -= sum(targets[s] for s in above)
        open_ = [s for s in open_ if s not in targets]
    return targets


def cheapest_flow(
    supply: list[int], members: list[list[int]], quota: list[int], repeats: int
) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources.

    Maximal, and of all maximal flows one with the least repetition cost.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    senders: list[set[int]] = [set() for _ in quota]
    room = list(quota)
    for _ in range(repeats):
        left = list(supply)
        for start in range(len(supply)):
            while left[start] > 0:
                # breadth-first: pattern -> source -> pattern that could send elsewhere -> ...
                came: dict[int, int] = {}  # source -> pattern it was reached from
                via: dict[int, int] = {}  # pattern -> source it was reached through
                queue, end = deque([start]), None
                while queue and end is None:
                    p = queue.popleft()
                    for s in members[p]:
                        if s in came:
                            continue
                        came[s] = p
                        if room[s] > 0:
                            end = s
                            break
                        for other in senders[s]:
                            if other != start and other not in via:
                                via[other] = s
                                queue.append(other)
                if end is None:
                    break
                path, s = [], end
                while True:
                    p = came[s]
                    path.append((p, s))
                    if p == start:
                        break
                    s = via[p]
                amount = min([left[start], room[end], *(flow[p][via[p]] for p, _ in path if p != start)])
                for p, s in path:
                    flow[p][s] += amount
                    senders[s].add(p)
                    if p != start:
                        flow[p][via[p]] -= amount
                        if not flow[p][via[p]]:
                            senders[via[p]].discard(p)
                left[start] -= amount
                room[end] -= amount
    return flow


def _cutoffs(rows: DataFrame, gaps: dict[int, int], after: dict[int, int | None], ranges: int) -> dict[int, tuple]:
    """Per pattern: (first hash that would overshoot the gap or None, words before it).

    ``rows``: (pattern, hash, size). Only rows behind ``after`` and not larger than the gap count.
    """
    spark = rows.sparkSession
    want = spark.createDataFrame([(p, g, after[p]) for p, g in gaps.items()], "pattern int, gap long, after long")
    fit = rows.join(F.broadcast(want), "pattern").where(  # one row a pattern
        (F.col("size") <= F.col("gap")) & (F.col("size") > 0) & (F.col("after").isNull() | (F.col("hash") > F.col("after")))
    )
    one = fit.groupBy("pattern", "gap", "hash").agg(F.sum("size").alias("size"))  # rows of one hash go together
    width = min(-(-(1 << 63) // ranges), (1 << 63) - 1)
    one = one.withColumn("range", F.expr(f"hash div {width}L"))
    sums = one.groupBy("pattern", "gap", "range").agg(F.sum("size").alias("words"))
    run = W.partitionBy("pattern").orderBy("range")
    sums = sums.withColumn("before", F.sum("words").over(run) - F.col("words"))
    crossing = sums.where((F.col("before") <= F.col("gap")) & (F.col("before") + F.col("words") > F.col("gap")))
    inside = one.join(crossing.select("pattern", "range", "before"), ["pattern", "range"])
    at = W.partitionBy("pattern").orderBy("hash")
    inside = inside.withColumn("before", F.col("before") + F.sum("size").over(at) - F.col("size"))
    cut = inside.where(F.col("before") + F.col("size") > F.col("gap")).groupBy("pattern").agg(
        F.min("hash").alias("cut"), F.min("before").alias("got")
    )
    total = sums.groupBy("pattern").agg(F.sum("words").alias("all"))
    found = total.join(cut, "pattern", "left").collect()  # one row a pattern
    return {r["pattern"]: (r["cut"], r["all"] if r["cut"] is None else r["got"]) for r in found}


def mix_sources(
    docs: DataFrame, size: Column, members: Column, targets: dict[str | None, float], identity: list[Column],
    params: MixParams | None = None,
) -> DataFrame:
    """Adds ``size``, ``repeats``, ``taken`` (words, repeats counted) and ``assigned`` to every row.

    ``members`` is an array of source names (null is a name); ``assigned`` names, for
    each repeat, the source whose quota it serves. ``identity`` columns are hashed into
    the seeded order, so the choice does not depend on how rows are dealt out; rows
    with equal identity are taken together. A null array is no membership and, like a
    row of size 0, takes no words. Texts of any length count whole. An empty table gives
    an empty result. Input columns named like an output are replaced.
    """
    p = params or MixParams()
    out = ("size", "repeats", "taken", "assigned")
    names = [c for c in docs.columns if c.lower() not in out]
    key, order, pid, plan = (fresh_name(docs, n) for n in ("pattern_key", "seeded", "pattern_id", "plan"))
    spark = docs.sparkSession
    marked = docs.select(
        *names, size.cast("long").alias("size"),
        # without this option null names would vanish from the text
        F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"}).alias(key),
        F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), *identity), 1).alias(order),
    )
    slim = stored(marked.select(F.col(key).alias("key"), F.col(order).alias("hash"), "size"), "mix")
    found = slim.where("key is not null").groupBy("key").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    patterns = sorted((r["key"], r["words"], r["n"]) for r in found.limit(p.most_patterns + 1).collect())
    if max(len(patterns), len(targets)) > p.most_patterns:
        raise ValueError(f"more than {p.most_patterns} membership patterns or sources")
    sources = sorted(targets, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(sources)}
    member_of = [[place[s] for s in json.loads(k) if s in place] for k, _, _ in patterns]
    flow = cheapest_flow([w for _, w, _ in patterns], member_of, [round(targets[s]) for s in sources], p.max_repeats)

    whole, gaps = [], {}
    for i, (_, words, _) in enumerate(patterns):
        f = sum(flow[i].values())
        whole.append(f // words if words else 0)
        if words and f % words:
            gaps[i] = f % words
    cuts: list[list[tuple]] = [[] for _ in patterns]  # (least size that is skipped, after, before)
    if gaps:
        ids = spark.createDataFrame([(k, i) for i, (k, _, _) in enumerate(patterns)], "key string, pattern int")
        rows = slim.join(F.broadcast(ids), "key").select("pattern", "hash", "size")  # one row a pattern
        ranges = max(1, -(-max(n for _, _, n in patterns) // p.rows_per_range))
        after: dict[int, int | None] = dict.fromkeys(gaps)
        while gaps:  # a cut moves on in every round, and what is missing shrinks below the document at it
            got = _cutoffs(rows, gaps, after, ranges)
            for i in list(gaps):
                cut, words = got.get(i, (None, 0))
                cuts[i].append((gaps[i], after[i], cut))
                gaps[i] -= words
                after[i] = cut
                if cut is None or gaps[i] <= 0:
                    del gaps[i]

    rule = spark.createDataFrame(
        [
            (k, whole[i], [{"most": a, "after": b, "before": c} for a, b, c in cuts[i]], words,
             [s for s in flow[i] if flow[i][s]], [flow[i][s] for s in flow[i] if flow[i][s]])
            for i, (k, words, _) in enumerate(patterns)
        ],
        "key string, whole long, rounds array<struct<most: long, after: long, before: long>>, words long, "
        "to array<int>, flow array<long>",
    )
    rule = rule.select(F.col("key").alias(key), F.struct("whole", "rounds", "words", "to", "flow").alias(plan))
    h, s = F.col(order), F.col("size")
    more = F.exists(
        F.col(plan)["rounds"],
        lambda r: (s > 0) & (s <= r["most"]) & (r["after"].isNull() | (h > r["after"])) & (r["before"].isNull() | (h < r["before"])),
    )
    repeats = F.coalesce(F.when(s > 0, F.col(plan)["whole"] + more.cast("long")), F.lit(0)).cast("int")
    # A repeat stands at (its number + the hash's share of the order) pattern lengths; the flows cut that line.
    sent = F.aggregate(F.col(plan)["flow"], F.lit(0).cast("long"), lambda a, b: a + b)
    named = F.array(*[F.lit(x).cast("string") for x in sources])

    def served(k: Column) -> Column:
        at = (k + h.cast("double") / float(1 << 63)) * F.col(plan)["words"]
        ends = F.transform(
            F.col(plan)["flow"], lambda _, i: F.aggregate(F.slice(F.col(plan)["flow"], 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b)
        )
        i = F.size(F.filter(ends, lambda e: e <= F.least(at, (sent - 1).cast("double"))))
        return F.get(named, F.get(F.col(plan)["to"], i))

    mixed = marked.join(F.broadcast(rule), key, "left").withColumn("repeats", repeats)  # one row a pattern
    return mixed.select(
        *names, "size", "repeats", (F.col("repeats") * F.col("size")).alias("taken"),
        F.when(F.col("repeats") > 0, F.transform(F.sequence(F.lit(0), F.col("repeats") - 1), served)).alias("assigned"),
    )


def source_sizes(docs: DataFrame, size: Column, source: str, most: int = MixParams.most_patterns) -> dict[str | None, int]:
    """All words of each source; more than ``most`` sources are refused."""
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("words")).limit(most + 1).collect()
    if len(sums) > most:
        raise ValueError(f"more than {most} sources")
    return {r["source"]: r["words"] for r in sums}
