"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a seeded hash, so its blocks are a random permutation of it. The
target gives the source whole rounds over all its blocks and a last round over the first of them, the block at
the edge cut by documents in hash order where the words come nearest to the target. All these block draws are
the source's quota. A tree over the output shards then splits the quotas: a node deals its blocks to its two
halves by one multivariate-hypergeometric draw, down to the shards, so each shard has exact counts of disjoint
blocks, as if all had been shuffled at once. Within a shard the rows are shuffled by another seeded hash.

Shards and blocks grow in number, not in size, with the corpus. Texts are read twice, once for their sizes and
once to be dealt; only sizes and hashes are summed and sorted, and of these only the blocks around each source's
edge. The driver has one row for each source and the top of the tree (sources x 64 integers); the subtrees below
are drawn in tasks, for the sources that reach them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restwave.llm.common import durable, if_small, named, row_struct, ship_package, with_outputs

WEIGHTS, MAX_TIMES = (1, 2, 3), 3
#: Words of a shard, but at least LEAST_SHARDS; blocks for each shard, but none of fewer words.
SHARD_WORDS, LEAST_SHARDS = 20_000_000, 64
SHARD_BLOCKS, BLOCK_WORDS = 64, 2_000
#: Subtrees that are drawn in tasks; neighbouring blocks that are summed together in search of an edge.
SUBTREES, STRIDE = 64, 4_096
SEED = 20240131
OUTPUTS = ["size", "source_size", "target", "taken", "draws"]


def targets(sizes: list[int], weights: list[float], times: float = MAX_TIMES) -> list[float]:
    """Shares of all sizes by weight; none above `times` its size, the excess reshared by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > times * sizes[i]]
        for i in full or open_:
            out[i] = float(times * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def subtrees(first: int, past: int, sources: np.ndarray, counts: np.ndarray, leaf: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits the counts of a node over the shards first to past; its descendants of at most `leaf` shards, in order.

    A node's draw depends on the seed and its shards only, so a subtree is the same wherever it is drawn. Sources
    of which nothing falls to a node are left out below it.
    """
    some = counts > 0
    sources, counts = sources[some], counts[some]
    if past - first <= leaf:
        yield first, past, sources, counts
        return
    mid = (first + past) // 2
    part = int(counts.sum()) * (mid - first) // (past - first)
    rng = np.random.default_rng([seed, first, past])
    left = rng.multivariate_hypergeometric(counts, part, method="marginals") if len(counts) else counts
    yield from subtrees(first, mid, sources, left, leaf, seed)
    yield from subtrees(mid, past, sources, counts - left, leaf, seed)


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: exact block counts, drawn down a binary tree over the shards."""
    out = np.zeros((shards, len(quotas)), np.int64)
    for shard, _, sources, counts in subtrees(0, shards, np.arange(len(quotas)), np.asarray(quotas, np.int64), 1, seed):
        out[shard, sources] = counts
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", keep: list[str] | None = None,
             shards: int | None = None, seed: int = SEED) -> DataFrame:
    """Every row of docs: the columns `keep` (all, if None) and size, source_size, target, taken, draws.

    draws lists (shard, place) of each time the mix takes the row, at most three; taken is size times their
    number. Sources by code point, null last, weigh 1, 2, 3, 1, ...; an all-null column is one source. Null and
    blank texts have size 0; a source of size 0 has target 0. Equal rows count one by one, and so do rows
    without an id. An empty table gives an empty result. Reruns agree. shards None: one for each SHARD_WORDS.
    """
    return with_outputs(_planned(docs, text_col, source_col, keep, shards, seed)[0], "row", OUTPUTS)


def _edges(sized: DataFrame, plan: DataFrame) -> dict[int, tuple[int, int | None, int]]:
    """Of each source with a last round: its last block, and of that the first hash whose rows don't all belong, and how many of them do."""
    dealt = _dealt(sized, plan).where("rest > 0")
    words = durable(dealt.groupBy("nr", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))
    stride = F.floor(F.col("block") / STRIDE)

    def reached(parts: DataFrame, order: str) -> DataFrame:
        """Of each source the part in which its words reach the rest, and what the parts before it leave."""
        running = F.sum("words").over(Window.partitionBy("nr").orderBy(order))
        return parts.withColumn("room", F.col("rest") - running + F.col("words")).where((F.col("room") > 0) & (F.col("room") <= F.col("words")))

    wide = reached(words.groupBy("nr", stride.alias("stride")).agg(F.sum("words").alias("words"), F.first("rest").alias("rest")), "stride")
    near = words.drop("rest").withColumn("stride", stride).join(wide.select("nr", "stride", F.col("room").alias("rest")), ["nr", "stride"])
    edge = durable(reached(near, "block").select("nr", "block", "room"))
    # equal rows share a hash and stand for each other
    equal = dealt.join(if_small(edge), ["nr", "block"]).groupBy("nr", "block", "room", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("nr").orderBy("hash")) - F.col("words")
    each = F.col("words") / F.col("n")
    # a row is taken if its middle lies before the end of the room
    fit = equal.withColumn("left", F.col("room") - ahead).withColumn("fit", F.when(each > 0, F.least("n", F.greatest(F.floor(F.col("left") / each + 0.5), F.lit(0)))).when(
        F.col("left") >= 0, F.col("n")).otherwise(0))
    cut = fit.groupBy("nr").agg(F.first("block").alias("block"), F.min(F.when(F.col("fit") < F.col("n"), F.struct("hash", F.col("fit").cast("long").alias("fit")))).alias("cut")).collect()
    return {r["nr"]: (r["block"], *(r["cut"] or (None, 0))) for r in cut}


def _dealt(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with their source's plan and their block: the hash's upper 31 bits deal the blocks, the rest orders a block."""
    return rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p_source"))).withColumn(
        "block", F.floor(F.shiftrightunsigned("hash", 33) * F.col("blocks") / F.lit(2.0**31)))


def _shards_of_draws(spark, quotas: list[int], shards: int, seed: int) -> DataFrame:
    """nr, j, shard: where the j-th block draw of a source goes."""
    nodes, offsets = [], np.zeros(len(quotas), np.int64)
    for first, past, sources, counts in subtrees(0, shards, np.arange(len(quotas)), np.asarray(quotas, np.int64), -(-shards // SUBTREES), seed):
        nodes += [(first, past, int(i), int(n), int(offsets[i])) for i, n in zip(sources, counts)]
        offsets[sources] += counts

    def draw(node: pa.Table) -> pa.Table:
        node = node.sort_by("nr")
        nr, n, offset = (node[c].to_numpy() for c in ("nr", "n", "start"))
        at, out = offset.copy(), []
        for shard, _, places, counts in subtrees(node["first"][0].as_py(), node["past"][0].as_py(), np.arange(len(nr)), n, 1, seed):
            out.append((nr[places], np.full(len(places), shard), at[places], at[places] + counts))
            at[places] += counts
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["nr", "shard", "lo", "past"])

    ranges = spark.createDataFrame(nodes, "first long, past long, nr long, n long, start long").groupBy("first").applyInArrow(
        draw, "nr long, shard long, lo long, past long")
    return ranges.select("nr", F.explode(F.sequence("lo", F.col("past") - 1)).alias("j"), F.col("shard").cast("int").alias("shard"))


def _planned(docs: DataFrame, text_col: str, source_col: str, keep: list[str] | None, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    """The plan with the kept columns as the struct `row`, and the number of shards."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(row_struct(docs, keep).alias("row"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col].cast("string")).alias("size"),
                       F.xxhash64(F.lit(seed), *[named(docs, c) for c in docs.columns]).alias("hash"))
    sized = durable(rows.select("source", "size", "hash"))
    # by source only: one row each
    sums = sorted(sized.groupBy("source").agg(F.sum("size")).collect(), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    sizes = [int(r[1]) for r in sums]
    goals = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sums))])
    shards = shards or max(LEAST_SHARDS, sum(sizes) // SHARD_WORDS)
    of_block = max(BLOCK_WORDS, sum(sizes) // (SHARD_BLOCKS * shards))
    blocks = [max(1, s // of_block) for s in sizes]
    rounds = [int(g // s) if s else 0 for g, s in zip(goals, sizes)]
    known = [(r[0], i, s, g, b, k, g - k * s) for i, (r, s, g, b, k) in enumerate(zip(sums, sizes, goals, blocks, rounds))]
    kind = "p_source string, nr long, source_size long, target double, blocks long, rounds int, rest double"
    edges = _edges(sized, spark.createDataFrame(known, kind))
    ends = [edges.get(i, (-1, None, 0)) for i in range(len(sums))]
    plan = spark.createDataFrame([k + e for k, e in zip(known, ends)], kind + ", edge long, edge_hash long, edge_fit long")
    # draw j of a source: block j mod blocks in round j div blocks
    turn = F.struct(F.floor(F.col("j") / F.col("blocks")).alias("copy"), "shard")
    drawn = _shards_of_draws(spark, [k * b + e[0] + 1 for k, b, e in zip(rounds, blocks, ends)], shards, seed).join(F.broadcast(plan.select("nr", "blocks")), "nr")
    copies = durable(drawn.groupBy(F.col("nr").alias("d_nr"), (F.col("j") % F.col("blocks")).alias("d_block")).agg(F.array_sort(F.collect_list(turn)).alias("copies")))
    dealt = _dealt(rows, plan)
    before = (F.col("block") != F.col("edge")) | F.col("edge_hash").isNull() | (F.col("hash") < F.col("edge_hash"))
    if any(fit for _, _, fit in edges.values()):  # of equal rows only some belong
        split = F.coalesce((F.col("hash") == F.col("edge_hash")) & (F.col("edge_fit") > 0), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("nr").orderBy("hash"))
        dealt = dealt.where(~split).withColumn("last", before).unionByName(dealt.where(split).withColumn("last", nth <= F.col("edge_fit")))
    else:
        dealt = dealt.withColumn("last", before)
    cut = dealt.join(if_small(copies), (F.col("nr") == F.col("d_nr")) & (F.col("block") == F.col("d_block")), "left")
    mine = F.filter(F.coalesce("copies", F.array()), lambda c: (c["copy"] < F.col("rounds")) | F.col("last"))
    draws = F.transform(mine, lambda c: F.struct(c["shard"].alias("shard"), F.xxhash64(F.lit(seed + 1), c["copy"], F.col("hash")).alias("place")))
    return cut.withColumn("draws", draws).select(
        "row", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws"), shards


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed rows with the columns of docs, partition s for shard s, shuffled within it; a row that is
    taken twice is there twice."""
    planned, shards = _planned(docs, text_col, source_col, None, shards, seed)
    taken = planned.select("row", F.explode("draws").alias("draw")).select("row", "draw.shard", "draw.place")
    return taken.repartitionById(shards, F.col("shard")).sortWithinPartitions("place").select("row.*")
