"""Token ids as Arrow stream files of fixed-size-list batches.

Documents are range-partitioned by id and encoded in order; each partition writes one file in Arrow's stream
format, a run of equal-length sequences with masks, both fixed-size lists, uncompressed. Memory-mapped, a
sequence is a slice of its batch: no copy, no search. The file's schema metadata says how many ids it holds;
the last sequence is padded and masked. Beside it lies an index file with the ids of the documents and where
they begin. A manifest with the files in order gives each file's first position in the whole stream.

Ids are stored in the least unsigned width that holds the vocabulary. A task writes under a name of its own
attempt and renames, so a repeated task replaces its file by an equal one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restwave.llm.common import checkpoint_dir, durable, ship_package, text_buffers, word_runs
from restwave.llm.fragments import FragmentCache, encode_cut, flat_ids

TOKENIZER, END_ID = "word_bpe_49k.json", 2
LENGTH, BATCH = 2_048, 256
#: Text bytes of a file, about.
FILE_BYTES = 24 << 20


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b'!"#$%&()*+,-./:;=?@[]_~')] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Encodes texts fragment by fragment: this tokenizer drops white space and splits letters from marks, so
    no token spans either; apostrophes (contractions) and the characters of special tokens are left alone.
    It reads lower case, so fragments are looked up in it, unless special tokens may be about."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path if os.path.exists(path) else public_tokenizers.path(path))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        normalizer, pre = (json.loads(tokenizer.to_str())[k] for k in ("normalizer", "pre_tokenizer"))
        kinds = [x["type"] for x in (normalizer or {}).get("normalizers", [])]
        if "Lowercase" not in kinds or not pre or pre["type"] != "Sequence" or pre["pretokenizers"][0].get("behavior") != "Removed":
            raise ValueError(f"{path}: not a lower-case tokenizer that drops white space")
        self.type = pa.uint16() if tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
        self.tokenizer = tokenizer
        self.zero = flat_ids(tokenizer, ["0"])[0][0]
        self.cache = FragmentCache(self._encode_many)

    def _encode_many(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A digit is a token by itself whatever stands around it, so fragments without a 0 are encoded in
        runs with a lone zero after each, which costs far less than one by one."""
        at = [i for i, x in enumerate(fragments) if "0" in x]
        alone, alone_sizes = flat_ids(self.tokenizer, [fragments[i] for i in at])
        with_zero = set(at)
        joint = [x for i, x in enumerate(fragments) if i not in with_zero]
        runs = [" 0 ".join(joint[i:i + 500]) + " 0" for i in range(0, len(joint), 500)]
        ids, _ = flat_ids(self.tokenizer, runs)
        stops = np.flatnonzero(ids == self.zero)
        sizes = np.empty(len(fragments), np.int64)
        own = np.ones(len(fragments), bool)
        own[at] = False
        sizes[own], sizes[~own] = np.diff(stops, prepend=-1) - 1, alone_sizes
        # both kinds of ids in the order of the fragments
        out = np.empty(int(sizes.sum()), np.uint32)
        is_own = np.repeat(own, sizes)
        out[is_own], out[~is_own] = ids[ids != self.zero], alone
        return out, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 bounds of the texts in them."""
        starts, ends, _ = word_runs(data, offsets)
        at = np.zeros(len(data) + 1, bool)
        at[starts] = at[ends] = at[0] = at[-1] = True
        at[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        cuts = np.flatnonzero(at)
        if not ((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any():
            data = _LOWER[data]
        ids, bounds = encode_cut(data, cuts, self.cache)
        return ids, bounds[np.searchsorted(cuts, np.minimum(offsets, len(data)))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _rename(files: fs.FileSystem, source: str, target: str) -> None:
    if files.get_file_info(target).type != fs.FileType.NotFound:
        files.delete_file(target)
    files.move(source, target)


class SequenceWriter:
    """Writes one file of sequences as ids come in."""

    def __init__(self, sink, kind: pa.DataType, length: int):
        self.length, self.kind, self.rest, self.count = length, kind, np.zeros(0, np.uint32), 0
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = pa.ipc.new_stream(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.count += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        block = self.length * BATCH
        while len(self.rest) >= block:
            self._write(self.rest[:block], block)
            self.rest = self.rest[block:]

    def _write(self, ids: np.ndarray, real: int) -> None:
        kind = self.kind.to_pandas_dtype()
        self.stream.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(kind), self.kind), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.length)], schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            padded = np.zeros(-(-len(self.rest) // self.length) * self.length, np.uint32)
            padded[:len(self.rest)] = self.rest
            self._write(padded, len(self.rest))
        self.stream.close()


def write_sequences(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                    end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Writes the files now and returns the manifest: part, path, first (position of its first id), n_ids, n_docs.

    Ascending id, null ids first, equal ids by a hash of their text; null texts are empty. Each document is
    followed by end_id. An empty table gives no file and an empty manifest. Other columns aren't read.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(int(size[0] or 0), 64 * int(size[1])) // FILE_BYTES + 1
    ordered = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, own = TaskContext.get(), encoder(tokenizer)
        part = context.partitionId()
        files, root = _place(folder)
        name = f"{root}/part-{part:06d}"
        attempt = f"{name}.{context.taskAttemptId()}"
        writer = sink = None
        index: list[pa.RecordBatch] = []
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_000):
                batch = whole.slice(lo, 1_000)
                if writer is None:
                    files.create_dir(root, recursive=True)
                    sink = files.open_output_stream(f"{attempt}.ids")
                    writer = SequenceWriter(sink, own.type, length)
                ids, bounds = own.encode(*text_buffers(batch["text"]))
                # an end id after each text
                ends = np.insert(ids, bounds[1:], end_id)
                starts = writer.count + bounds[:-1] + np.arange(batch.num_rows)
                writer.add(ends.astype(np.uint32))
                index.append(pa.record_batch([batch["id"], pa.array(starts, pa.int64()), pa.array(np.diff(bounds) + 1, pa.int64())], ["id", "start", "n_ids"]))
        if writer is not None:
            writer.close()
            sink.close()
            with files.open_output_stream(f"{attempt}.docs") as out, pa.ipc.new_stream(out, index[0].schema) as stream:
                for batch in index:
                    stream.write_batch(batch)
            for kind in ("ids", "docs"):
                _rename(files, f"{attempt}.{kind}", f"{name}.{kind}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([writer.count], pa.int64()), pa.array([sum(b.num_rows for b in index)], pa.int64())], ["part", "n_ids", "n_docs"])

    written = durable(ordered.mapInArrow(run, "part long, n_ids long, n_docs long"))
    # one row for each file
    rows, first = [], 0
    for part, n_ids, n_docs in sorted(map(tuple, written.collect())):
        rows.append((part, f"{folder}/part-{part:06d}", first, n_ids, n_docs))
        first += n_ids
    return docs.sparkSession.createDataFrame(rows, "part long, path string, first long, n_ids long, n_docs long")


class SequenceFile:
    """Random access to one file of sequences; on a local disk it is mapped, and a sequence is no copy."""

    def __init__(self, uri: str):
        files, path = _place(uri)
        source = pa.memory_map(f"{path}.ids") if isinstance(files, fs.LocalFileSystem) else files.open_input_file(f"{path}.ids")
        self.batches = list(pa.ipc.open_stream(source))
        self.starts = np.cumsum([0] + [b.num_rows for b in self.batches])
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return int(self.starts[-1])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence i."""
        b = int(np.searchsorted(self.starts, i, side="right")) - 1
        batch, at = self.batches[b], i - int(self.starts[b])
        ids, mask = batch["ids"], batch["mask"]
        return ids.values.slice((ids.offset + at) * self.length, self.length).to_numpy(), mask.values.slice((mask.offset + at) * self.length, self.length)

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ids of positions start to start + count of this file."""
        parts = [self.sequence(i)[0] for i in range(start // self.length, -(-(start + count) // self.length))]
        at = start % self.length
        return np.concatenate(parts)[at:at + count]


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (position in the whole stream), n_tokens, ids (little-endian unsigned 32-bit) from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist()):
                files, path = _place(uri)
                sequences = SequenceFile(uri)
                with files.open_input_stream(f"{path}.docs") as source:
                    for docs in pa.ipc.open_stream(source):
                        ids = [sequences.ids(a, n).astype("<u4").tobytes() for a, n in zip(docs["start"].to_pylist(), docs["n_ids"].to_pylist())]
                        yield pa.RecordBatch.from_arrays(
                            [docs["id"], pa.array(docs["start"].to_numpy() + first), docs["n_ids"], pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    ship_package(spark)
    n = max(1, manifest.count())
    return manifest.select("path", "first").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    root = checkpoint_dir(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + os.path.abspath(root)}/sequences-{uuid.uuid4().hex}"
