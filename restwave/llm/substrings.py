"""Substring removal with repeated-phrase automata.

A window is `width` consecutive words. A word goes if a window that covers it also starts in a document
with a smaller id. Three passes over documents dealt into batches of bounded bytes:

1. Anchors. Of each window the run of `ANCHOR` words with the least hash is its anchor, so equal windows
   have equal anchors, and only about a fifth of all positions are anchors. Each batch sends its distinct
   anchors to buckets by hash; a bucket answers which of them more than one document has.
2. Windows. Each batch sends the 128-bit hashes of the windows at recurring anchors, with the smallest
   document that has them; a bucket confirms those that an earlier document has as well.
3. Phrases. Each batch cuts its confirmed passages into phrases of `PHRASE` words such that every confirmed
   window holds a whole one, compiles them into sharded Aho-Corasick automata over words, and streams all its
   documents through them. Each occurrence of a phrase proposes the windows around it; a proposed window whose
   hash is a confirmed one's is compared with it word by word. A place that no automaton proposes is never looked at.

A batch sends a key once, however many of its documents hold it, and an answer is one bit for each key, so
a passage in a third of all documents costs each batch one entry. Nothing is capped or sampled.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.llm.common import NO_ID, WordHash, named, row_struct, ship_package, text_buffers, with_outputs, word_runs

WIDTH = 13
ANCHOR = 5
#: Words of a phrase, for windows of 13.
PHRASE = (WIDTH + 1) // 2
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
#: Keys that a bucket compares at a time; about 8 MB.
RANGE = 65_536
#: Phrases of one automaton; about 25 MB.
SHARD = 32_768

_ASKED = "bucket long, batch long, keys binary, docs binary"
_ANSWERED = "batch long, bucket long, kind int, bits binary"


class _Batch:
    """Words, anchors and windows of the documents of one batch, in row order."""

    def __init__(self, table: pa.Table, width: int):
        self.width, self.rows = width, table.num_rows
        self.bytes, offsets = text_buffers(table["text"])
        self.starts, self.ends, self.row = word_runs(self.bytes, offsets)
        self.ids = table["id"].to_numpy()
        self.word_keys, self.second_keys = WordHash(0).words(self.bytes, self.starts, self.ends), None
        n = max(0, len(self.row) - width + 1)
        #: First words of windows.
        self.at = np.flatnonzero(self.row[:n] == self.row[width - 1:]) if n else np.zeros(0, np.int64)
        k = min(ANCHOR, width)
        grams = WordHash(0).runs(self.word_keys, k)
        if len(self.at):
            spans = np.lib.stride_tricks.sliding_window_view(grams, width - k + 1)
            first = np.concatenate([spans[p].argmin(axis=1) + p for p in np.array_split(self.at, len(self.at) // 100_000 + 1)])
        else:
            first = np.zeros(0, np.int64)
        self.anchors = grams[first]

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchors, and whether more than one id of this batch has them."""
        ids = self.ids[self.row[self.at]]
        order = np.argsort(self.anchors, kind="stable")
        keys, ids = self.anchors[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(first):
            return keys, np.zeros(0, bool)
        return keys[first], np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)

    def windows(self, recurring: np.ndarray) -> dict[str, np.ndarray]:
        """The windows at recurring anchors: distinct 128-bit keys with their least id and one place each."""
        place = np.searchsorted(recurring, self.anchors)
        place[place == len(recurring)] = 0
        at = self.at[recurring[place] == self.anchors] if len(recurring) else self.at[:0]
        h1, h2 = self.hashes_at(at)
        ids = self.ids[self.row[at]]
        order = np.lexsort((ids, h2, h1))
        at, h1, h2, ids = at[order], h1[order], h2[order], ids[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        more = np.maximum.reduceat(ids, first) > ids[first] if len(first) else np.zeros(0, bool)
        return {"h1": h1[first], "h2": h2[first], "least": ids[first], "at": at[first], "more": more}

    def hashes_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit hashes of the windows that begin at the given words."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        second = WordHash(1)
        if self.second_keys is None:  # once for a batch, as it needs several arrays of the texts' length
            self.second_keys = second.words(self.bytes, self.starts, self.ends)
        return WordHash(0).runs_at(self.word_keys, at, self.width), second.runs_at(self.second_keys, at, self.width)

    def word_codes(self) -> np.ndarray:
        """A number for each word; equal exactly if the words' bytes are."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        bounds = np.empty(2 * len(self.starts), np.int64)
        bounds[0::2], bounds[1::2] = self.starts, self.ends
        parts = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(self.bytes))])
        return parts.dictionary_encode().indices.to_numpy()[0::2].astype(np.int64)


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted 64-bit keys: equal ranges of the hash."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def _asked(batch: int, buckets: int, keys: np.ndarray, parts: list[np.ndarray], docs: np.ndarray) -> pa.Table:
    cuts = _cut(keys, buckets)
    full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
    return pa.table({
        "bucket": pa.array(full, pa.int64()), "batch": pa.array([batch] * len(full), pa.int64()),
        "keys": pa.array([b"".join(p[cuts[b]:cuts[b + 1]].tobytes() for p in parts) for b in full], pa.binary()),
        "docs": pa.array([docs[cuts[b]:cuts[b + 1]].tobytes() for b in full], pa.binary())})


def _answers(table: pa.Table, kind: int, of: dict[int, np.ndarray], bucket: int) -> pa.Table:
    return pa.table({
        "batch": pa.array(list(of), pa.int64()), "bucket": pa.array([bucket] * len(of), pa.int64()),
        "kind": pa.array([kind] * len(of), pa.int32()),
        "bits": pa.array([np.packbits(x).tobytes() for x in of.values()], pa.binary())})


def _arrays(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The values of binary cells, where they lie."""
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _ranges(keys: list[np.ndarray]) -> list[list[slice]]:
    """The places of ranges of the hash in several arrays of sorted keys, of about RANGE keys in all each."""
    first, last = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
    n = sum(map(len, keys)) // RANGE + 1
    edges = np.array([first + (last - first + 1) * i // n for i in range(1, n)], np.uint64)
    cuts = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in keys]
    return [[slice(c[i], c[i + 1]) for c in cuts] for i in range(n)]


def _recurring_anchors(table: pa.Table) -> pa.Table:
    """One bucket: an anchor recurs if two batches or two documents of one batch have it."""
    keys, several = _arrays(table["keys"], np.uint64), _arrays(table["docs"], bool)
    hits = [np.zeros(len(k), bool) for k in keys]
    for spans in _ranges(keys):
        _, back, count = np.unique(np.concatenate([k[s] for k, s in zip(keys, spans)]), return_inverse=True, return_counts=True)
        hit = count > 1
        hit[back[np.concatenate([x[s] for x, s in zip(several, spans)])]] = True
        _put(hits, spans, hit[back])
    return _answers(table, 1, dict(zip(table["batch"].to_pylist(), hits)), table["bucket"][0].as_py())


def _earlier_windows(table: pa.Table) -> pa.Table:
    """One bucket: whether a document before the batch's first one has the window."""
    keys, docs = [k.reshape(2, -1) for k in _arrays(table["keys"], np.uint64)], _arrays(table["docs"], np.int64)
    found = [np.zeros(k.shape[1], bool) for k in keys]
    for spans in _ranges([k[0] for k in keys]):
        h1, h2 = np.concatenate([k[:, s] for k, s in zip(keys, spans)], axis=1)
        if not len(h1):
            continue
        least = np.concatenate([x[s] for x, s in zip(docs, spans)])
        order = np.lexsort((least, h2, h1))
        s1, s2 = h1[order], h2[order]
        new = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        group = np.cumsum(new) - 1
        earlier = np.empty(len(order), bool)
        earlier[order] = least[order][np.flatnonzero(new)][group] < least[order]
        _put(found, spans, earlier)
    return _answers(table, 2, dict(zip(table["batch"].to_pylist(), found)), table["bucket"][0].as_py())


def _put(arrays: list[np.ndarray], spans: list[slice], values: np.ndarray) -> None:
    at = 0
    for array, span in zip(arrays, spans):
        past = at + span.stop - span.start
        array[span] = values[at:past]
        at = past


def _bits(answers: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of all buckets in the order of the sorted keys."""
    cuts = _cut(keys, buckets)
    out = np.zeros(len(keys), bool)
    for k, bucket, bits in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["bits"].to_pylist()):
        if k == kind:
            lo, hi = cuts[bucket], cuts[bucket + 1]
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def _covered(batch: _Batch, found: dict[str, np.ndarray], earlier: np.ndarray) -> np.ndarray:
    """Marks the words of all occurrences of windows that an earlier document has as well."""
    mark = np.zeros(len(batch.row) + 1, np.int32)
    confirmed = earlier | found["more"]
    if confirmed.any():
        width, codes = batch.width, batch.word_codes()
        near = np.flatnonzero(_near_phrases(batch, codes, found["at"][confirmed]))
        at = near[near + width <= len(batch.row)]
        at = at[batch.row[at] == batch.row[at + width - 1]]
        # which confirmed window a proposed one may be, by hash; equal word by word, or no occurrence
        own = np.flatnonzero(confirmed)
        (h1, h2), known = batch.hashes_at(at), found["h1"][own]
        of = np.searchsorted(known, h1)
        open_ = np.arange(len(at))
        while len(open_):  # steps on only among windows equal in the first half of the hash
            open_ = open_[of[open_] < len(own)]
            open_ = open_[(known[of[open_]] == h1[open_]) & (found["h2"][own[of[open_]]] != h2[open_])]
            of[open_] += 1
        mine = of < len(own)
        mine[mine] = (known[of[mine]] == h1[mine]) & (found["h2"][own[of[mine]]] == h2[mine])
        at, of = at[mine], own[of[mine]]
        rep = found["at"][of]
        equal = np.ones(len(at), bool)
        for j in range(width):
            equal &= codes[at + j] == codes[rep + j]
        # it counts in any document, or only in those after the batch's first that has it
        equal &= earlier[of] | (batch.ids[batch.row[at]] > found["least"][of])
        np.add.at(mark, at[equal], 1)
        np.add.at(mark, at[equal] + width, -1)
    return np.cumsum(mark[:-1]) > 0


def _near_phrases(batch: _Batch, codes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Marks the first words of all windows that hold a phrase of the confirmed windows (at `windows`).

    A window of 2p - 1 words holds a whole phrase that begins at a multiple of p.
    """
    size = (batch.width + 1) // 2
    at = np.unique(-(-windows // size) * size)
    used = np.unique(codes[(at[:, None] + np.arange(size)).ravel()])
    digits = 1
    while 64**digits <= len(used):
        digits += 1
    # a word is so many letters of 64, with an alphabet for each place, so that no match begins within a
    # word; words of no phrase share the letters of number 0
    number = np.zeros(int(codes.max()) + 1, np.uint32)
    number[used] = np.arange(1, len(used) + 1)
    letters = np.empty((len(codes), digits), "<u4")
    for j in range(digits):
        letters[:, j] = (number[codes] >> (6 * j)) % 64 + (256 + 64 * j)
    near = np.zeros(len(codes) + 1, np.int32)
    bounds = np.searchsorted(batch.row, np.arange(batch.rows + 1)).tolist()
    for lo in range(0, len(at), SHARD):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in at[lo:lo + SHARD].tolist():
            automaton.add_word(letters[p:p + size].tobytes().decode("utf-32-le"))
        automaton.make_automaton()
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= batch.width:
                ends = [end for end, _ in automaton.iter(letters[a:b].tobytes().decode("utf-32-le"))]
                if ends:
                    past = a + (np.array(ends) + 1) // digits
                    np.add.at(near, np.maximum(past - batch.width, a), 1)
                    np.add.at(near, past - size + 1, -1)
    return np.cumsum(near[:-1]) > 0


def _result(table: pa.Table, batch: _Batch, gone: np.ndarray, carried: list[str]) -> pa.Table:
    data = memoryview(batch.bytes)
    bounds = np.searchsorted(batch.row, np.arange(batch.rows + 1))
    removed = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), bounds[:-1]) if batch.rows else np.zeros(0, np.int64)
    n_words = np.diff(bounds)
    removed[n_words == 0] = 0
    texts, spans = [], []
    for r in range(batch.rows):
        a, b = int(bounds[r]), int(bounds[r + 1])
        out = gone[a:b]
        # lists of one document's words only: as Python numbers they take several times their arrays
        starts, ends = batch.starts[a:b][~out].tolist(), batch.ends[a:b][~out].tolist()
        texts.append(b" ".join([data[i:j] for i, j in zip(starts, ends)]))
        turn = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))).reshape(-1, 2)
        spans.append([{"first": x, "past": y} for x, y in turn.tolist()])
    return pa.table({
        **{c: table[c] for c in carried}, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "removed_spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
        "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                   width: int = WIDTH) -> DataFrame:
    """One row for each row of docs: the columns `keep` (all, if None) and n_words, n_removed, removed_spans
    (first word and the word past the last, counted from 0) and kept_text (kept words joined by one space).

    Null or blank text: no words, kept_text empty. Null id: later than every id, and such rows leave one
    another alone, as rows of one id do, so repeated rows lose nothing by each other. An empty table gives an
    empty result. Input columns named like an output give way to it.
    """
    ship_package(docs.sparkSession)
    chosen = docs.columns if keep is None else keep
    # a text that is returned as well travels once, beside the row
    once = text_col in chosen and docs.select(named(docs, text_col)).schema[0].dataType == T.StringType()
    carried = ["row", "text"] if once else ["row"]
    row = row_struct(docs, [c for c in chosen if c != text_col] if once else keep)
    source = docs.select(row.alias("row"), named(docs, id_col).cast("long").alias("id"), named(docs, text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total = max(int(size[0] or 0), 64 * int(size[1]))
    batches, buckets = total // BATCH_BYTES + 1, total // BUCKET_BYTES + 1
    dealt = F.pmod(F.xxhash64("id", "text"), F.lit(batches))
    dealt_docs = source.select("row", F.coalesce("id", F.lit(NO_ID)).alias("id"), "text", dealt.alias("batch"))
    located_type = T.StructType([
        *[dealt_docs.schema[c] for c in carried], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))),
        T.StructField("kept_text", T.StringType())])

    def ask_anchors(table: pa.Table) -> pa.Table:
        keys, several = _Batch(table, width).distinct_anchors()
        return _asked(table["batch"][0].as_py(), buckets, keys, [keys], several)

    def recurring(batch: _Batch, answers: pa.Table) -> np.ndarray:
        keys, _ = batch.distinct_anchors()
        return keys[_bits(answers, 1, keys, buckets)]

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _asked(0, buckets, np.zeros(0, np.uint64), [], np.zeros(0, np.int64))
        batch = _Batch(table, width)
        found = batch.windows(recurring(batch, answers))
        return _asked(table["batch"][0].as_py(), buckets, found["h1"], [found["h1"], found["h2"]], found["least"])

    def locate(table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _Batch(table, width)
        found = batch.windows(recurring(batch, answers))
        gone = _covered(batch, found, _bits(answers, 2, found["h1"], buckets))
        del found
        pa.default_memory_pool().release_unused()  # else the worker keeps it through later stages
        return _result(table, batch, gone, carried)

    anchors = dealt_docs.groupBy("batch").applyInArrow(ask_anchors, _ASKED).groupBy("bucket").applyInArrow(_recurring_anchors, _ANSWERED)
    windows = (dealt_docs.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInArrow(ask_windows, _ASKED)
               .groupBy("bucket").applyInArrow(_earlier_windows, _ANSWERED))
    located = dealt_docs.groupBy("batch").cogroup(anchors.unionByName(windows).groupBy("batch")).applyInArrow(locate, located_type)
    if once:
        located = located.withColumn("row", F.struct(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in chosen]))
    return with_outputs(located, "row", ["n_words", "n_removed", "removed_spans", "kept_text"])
