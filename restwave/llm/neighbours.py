"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is stored as the signs of its randomly rotated offset from the mean, packed into bits, with the
offset's length and the code's own inner product with it as correction scalars. From a query's rotated form
the code gives an estimate of the inner product and a bound of its error. Per block a query reranks, with the
original vectors in double precision, those whose upper bound reaches the k-th best lower bound.

Queries and candidates meet in blocks of bounded size, each pair of blocks in a group of its own, so neither
side is ever whole in a task or on the driver. Equal vectors are one entry of the index with the k + 1 least
ids, which is all that ties to the smaller id can ever return: a vector shared by a third of all rows costs
no more than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restwave.llm.common import ship_package

QUERY_BLOCK, CANDIDATE_BLOCK = 4_096, 8_192
#: Standard deviations of the estimate's error that count as possible.
EPSILON = 3.0
SEED = 20240131


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def exact_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so that equal vectors score equally."""
    out = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        out += query[d] * vectors[:, d]
    return out


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(parts) if parts else np.zeros(0)).astype(np.float64).reshape(-1, dim)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """dim, vector, ids (the k + 1 least), code, length, agreement, centre: one row for each distinct usable vector."""
    ship_package(vectors.sparkSession)
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    least = Window.partitionBy("key").orderBy("id")
    distinct = (clean.withColumn("key", F.struct(F.xxhash64("vector").alias("h"), F.col("vector").alias("v"))).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
                .groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                .select(F.size("key.v").alias("dim"), F.col("key.v").alias("vector"), "ids"))
    # the mean of the distinct vectors of each dimension: one short row for each
    sums = distinct.select("dim", F.posexplode("vector").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("m")).groupBy("dim").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: F.round(s["m"], 6)).alias("centre"))

    def encode(batches):
        for batch in batches:
            table, out = pa.Table.from_batches([batch]), {}
            for dim in np.unique(table["dim"].to_numpy()).tolist():
                at = np.flatnonzero(table["dim"].to_numpy() == dim)
                part = table.take(pa.array(at))
                offset = _matrix(part["vector"], dim) - _matrix(part["centre"], dim)
                length = np.sqrt((offset**2).sum(axis=1))
                turned = offset @ rotation(dim).T
                bits = turned > 0
                agreement = np.abs(turned).sum(axis=1) / np.sqrt(dim) / np.where(length > 0, length, 1)
                out = {"code": [x.tobytes() for x in np.packbits(bits, axis=1)], "length": length, "agreement": np.where(length > 0, agreement, 1.0)}
                yield pa.RecordBatch.from_arrays(
                    [part["dim"].combine_chunks(), part["vector"].combine_chunks(), part["ids"].combine_chunks(), pa.array(out["code"], pa.binary()),
                     pa.array(out["length"]), pa.array(out["agreement"]), part["centre"].combine_chunks()],
                    ["dim", "vector", "ids", "code", "length", "agreement", "centre"])

    return distinct.join(sums, "dim").select("dim", "vector", "ids", "centre").mapInArrow(
        encode, "dim int, vector array<double>, ids array<long>, code binary, length double, agreement double, centre array<double>")


def search(queries: DataFrame, index: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
           epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for every query, but not itself by id.

    Nearest first, ties to the smaller id; score is the inner product of the original vectors in double
    precision. Vectors that are null, empty, zero or hold a null or non-finite component take no part, as query
    or candidate, nor do rows without an id; vectors of other dimensions are no candidates. Queries repeated
    under one id and vector count once; a candidate repeated under one id counts once for each vector.
    Fewer than k candidates: all of them. Empty tables give an empty result.
    """
    ship_package(queries.sparkSession)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("query")).where(
        F.col("query_id").isNotNull() & usable(F.col("query"))).distinct()
    n_q, n_c = -(-asked.count() // QUERY_BLOCK) or 1, -(-index.count() // CANDIDATE_BLOCK) or 1
    left = asked.select("query_id", "query", F.size("query").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("qb"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)).cast("array<long>")).alias("cb"))
    right = index.withColumn("cb", F.pmod(F.xxhash64("vector"), F.lit(n_c))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<long>")))
    best = left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInArrow(
        lambda q, c: _block_best(q, c, k, epsilon), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block_best(queries: pa.Table, block: pa.Table, k: int, epsilon: float) -> pa.Table:
    """The k nearest of one block for each of its queries.

    The exact scores of the few best estimates give the score that others must be able to reach, by their
    estimate and its error bound, to be reranked.
    """
    found: tuple[list, list, list] = ([], [], [])
    if queries.num_rows and block.num_rows:
        dim = queries["dim"][0].as_py()
        q, x = _matrix(queries["query"], dim), _matrix(block["vector"], dim)
        centre = np.array(block["centre"][0].as_py())
        turned = q @ rotation(dim).T
        length, agreement = block["length"].to_numpy(), block["agreement"].to_numpy()
        codes = np.frombuffer(b"".join(block["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
        scale = (length / (np.sqrt(dim) * agreement)).astype(np.float32)
        slack = (length * np.sqrt(np.maximum(0, 1 - agreement**2)) / agreement * epsilon / np.sqrt(max(1, dim - 1))).astype(np.float32)
        ids, own_ids = block["ids"].to_pylist(), queries["query_id"].to_pylist()
        size, base = np.linalg.norm(turned, axis=1).astype(np.float32), (q @ centre).astype(np.float32)
        least, n = min(k + 1, len(x)), min(4 * (k + 1), len(x))  # k + 1, as one may be the query itself
        # what sums of products may differ by in another order
        blur = 1e-12 * dim * (1 + np.linalg.norm(x, axis=1).max()) * (1 + size.astype(np.float64))
        for lo in range(0, len(q), 256):
            some = slice(lo, lo + 256)
            estimate = (turned[some].astype(np.float32) @ signs.T) * scale + base[some, None]
            first = np.argpartition(estimate, len(x) - n, axis=1)[:, len(x) - n:]
            score = np.einsum("qd,qnd->qn", q[some], x[first])
            must = np.partition(score, n - least, axis=1)[:, n - least].astype(np.float32)[:, None]
            near = estimate + size[some, None] * slack >= must - np.float32(1e-4) * (1 + np.abs(estimate) + np.abs(must))
            for r in range(len(first)):
                at = np.flatnonzero(near[r])
                score = x[at] @ q[lo + r]
                at = at[score >= np.partition(score, len(at) - least)[len(at) - least] - blur[lo + r]]
                score, own = exact_products(q[lo + r], x[at]), own_ids[lo + r]
                best = sorted((-s, i) for s, c in zip(score.tolist(), at.tolist()) for i in ids[c] if i != own)[:k]
                found[0].extend([own] * len(best))
                found[1].extend(i for _, i in best)
                found[2].extend(-s for s, _ in best)
    return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])
