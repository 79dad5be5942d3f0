"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

The terms of all items become words of one automaton, each guarded by a space on both sides; a document is
folded so that everything between terms is a space. One scan gives the document's number of terms and how often
each item term occurs. Those counts are kept in the shared folder; they give the corpus statistics (documents,
length, document frequencies) and then the scores, whose sums run over the items that an automaton word
belongs to.

Items are dealt into shards of at most `SHARD_BYTES` of terms (or one item), and each shard scans the documents
by itself, so what is broadcast doesn't grow with the number of items. A task keeps the k best documents of
each item; these are merged in two steps, so no task meets all of an item's candidates.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restwave.llm.common import NO_ID, durable, ship_package

#: Terms are runs of ASCII letters, digits and everything beyond ASCII; A-Z count as a-z.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SHARD_BYTES, TOP = 8 << 20, 50
#: Cells of scores, and gains of (document, term, item), that a task holds at a time.
CELLS, GAINS = 1 << 22, 1 << 21
MERGE = 256


def folded(text: str | None) -> bytes:
    """The text's terms and spaces for all else, in UTF-8."""
    return text.encode().translate(_FOLD) if text else b""


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term: the distinct terms of each item; rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(batch.num_rows):
                terms = sorted(set(folded(batch["text"][lo].as_py()).split()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["item"][lo].as_py()] * len(terms), pa.int64()), pa.array([t.decode() for t in terms], pa.string())], ["item", "term"])

    ship_package(items.sparkSession)
    source = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "item long, term string").distinct()


class Shard:
    """The terms of some items, and for each term the places of its items in `items`."""

    def __init__(self, pairs: list[tuple[int | None, str]]):
        self.terms = sorted({t for _, t in pairs})
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i or 0))
        number, place = {t: n for n, t in enumerate(self.terms)}, {i: n for n, i in enumerate(self.items)}
        of = np.array(sorted((number[t], place[i]) for i, t in pairs), np.int64).reshape(-1, 2)
        self.first = np.searchsorted(of[:, 0], np.arange(len(self.terms) + 1))
        self.item_of = of[:, 1].copy()

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, term in enumerate(self.terms):
            out.add_word(f" {term} ", n)
        out.make_automaton()
        return out


def _sharded(pairs: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The pairs with their shard, and the number of shards: none beyond the limit unless it is one item."""
    sizes = pairs.groupBy("item").agg(F.sum(F.octet_length("term") + F.lit(24)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0]
    if total is None:
        return pairs, 0
    shards = -(-total // limit)
    while True:
        shard = F.pmod(F.xxhash64(F.coalesce("item", F.lit(NO_ID))), F.lit(shards))
        over = sizes.groupBy(shard.alias("shard")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > limit) & (F.col("n") > 1))
        if over.isEmpty():
            return pairs.withColumn("shard", shard), int(shards)
        shards *= 2


def term_counts(docs: DataFrame, shared) -> DataFrame:
    """doc, n (terms with repeats), terms and tf (numbers of the shard's terms and their occurrences) of each row of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, value = shared.value.automaton(), itemgetter(1)
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                sizes, terms, times = [], [], []
                for text in batch["text"].to_pylist():
                    data = folded(text)
                    found = Counter(map(value, automaton.iter(f" {data.decode()} ")))
                    sizes.append(len(data.split()))
                    terms.append(list(found.keys()))
                    times.append(list(found.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc long, n long, terms array<int>, tf array<long>")


def weights(frequencies: dict[int, int], terms: int, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequencies.get(t, 0) + 1))) for t in range(terms)], np.int64)


class _Best:
    """The k best (item, doc, score) of each item: higher scores, then smaller ids."""

    def __init__(self, items: int, k: int):
        self.k, self.item, self.doc, self.score = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.least = np.zeros(items, np.int64)  # a score must reach it

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        item, doc, score = np.append(self.item, item), np.append(self.doc, doc), np.append(self.score, score)
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]
        full = rank == self.k - 1
        self.least[item[full]] = score[full]


def _best_of(counts: DataFrame, shared, weight, documents: int, length: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, w = shared.value, weight.value
        width = len(shard.items)
        best = _Best(width, k)
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, CELLS // width)):
                batch = whole.slice(at, max(1, CELLS // width))
                doc = batch["doc"].fill_null(NO_ID).to_numpy()
                sizes = batch["terms"].value_lengths().to_numpy().astype(np.int64)
                row, term, tf = np.repeat(np.arange(len(doc)), sizes), batch["terms"].flatten().to_numpy(), batch["tf"].flatten().to_numpy()
                m = np.array([50 + 50 * n * documents // length for n in batch["n"].to_pylist()], np.int64)
                gain = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
                score = np.zeros(len(doc) * width, np.int64)
                first, times = shard.first[term], shard.first[term + 1] - shard.first[term]
                ends = np.cumsum(times)
                for part in np.split(np.arange(len(term)), np.searchsorted(ends, np.arange(GAINS, ends[-1] if len(ends) else 0, GAINS))):
                    if len(part):
                        each = np.repeat(part, times[part])
                        inside = np.arange(len(each)) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
                        np.add.at(score, row[each] * width + shard.item_of[first[each] + inside], gain[each])
                score = score.reshape(-1, width)
                r, i = np.nonzero((score > 0) & (score >= best.least))
                best.add(i, doc[r], score[r, i])
        ids = pa.array(shard.items, pa.int64()).take(pa.array(best.item))
        yield pa.RecordBatch.from_arrays([ids, pa.array(best.doc, mask=best.doc == NO_ID), pa.array(best.score)], ["item_id", "doc_id", "score"])

    return counts.mapInArrow(run, "item_id long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
           k: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of every item with a score above 0.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums, over an item's distinct terms,
    the weight times 10^9 tf div (1000 tf + 20 m), m = 50 + 50 n N div L. Equal scores come by ascending id, rows
    without an id last. Null, empty and termless documents count nowhere and are not found; such items have no
    rows. Rows of items with one id are one item, that of no id too; documents that share an id are ranked one
    by one. Empty tables give an empty result. Other columns are never looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    pairs, shards = _sharded(durable(item_terms(items, item_id, item_text)), shard_bytes)
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).cast("string").alias("text"))
    found, corpus = spark.createDataFrame([], "item_id long, doc_id long, score long"), None
    for s in range(shards):
        rows = [tuple(r) for r in pairs.where(F.col("shard") == s).select("item", "term").collect()]  # a shard's bytes
        if not rows:
            continue
        shard = Shard(rows)
        shared = spark.sparkContext.broadcast(shard)
        counts = durable(term_counts(source, shared))
        if corpus is None:
            corpus = tuple(counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
        if not corpus[1]:
            break
        df = {r[0]: r[1] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # terms of a shard
        weight = spark.sparkContext.broadcast(weights(df, len(shard.terms), corpus[0]))
        found = found.unionByName(_best_of(counts, shared, weight, *corpus, k))
    # equal rows get different ranks, so that no window drops one of them
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item_id", "part").orderBy(*order)
    merged = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
