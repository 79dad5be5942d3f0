"""Byte-pair encoding by forced boundaries, and decoding.

A merge only makes vocabulary tokens, so two adjacent bytes that never occur inside any token are never merged
over: between them the encoding certainly has a cut. The 256 x 256 table of pairs that do occur is built from
the vocabulary (added tokens included). Texts are cut at absent pairs, distinct fragments are encoded once by
the tokenizers library, and their ids are concatenated.

A cut must also leave the library's pre-tokenizer unmoved, whose pattern looks ahead after white space and
reads an apostrophe with what follows: so no cut is made after white space, before an apostrophe or inside a
character. The byte-level pre-tokenizer has no other context; `supported` refuses a tokenizer with more.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.llm.common import row_struct, ship_package, text_buffers, with_outputs
from restwave.llm.fragments import FragmentCache, encode_cut, flat_ids

TOKENIZER = "byte_bpe_50k.json"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by its public rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def supported(spec: dict) -> bool:
    pre = spec["pre_tokenizer"] or {}
    added = spec["added_tokens"]
    return (spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added))


class Codec:
    """One worker's tokenizer, pair table, token bytes and cache. path: a tokenizer file, or a public one's name."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        file = path if os.path.exists(path) else public_tokenizers.path(path)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        if not supported(spec):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        tokenizer = Tokenizer.from_file(file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        alphabet = byte_alphabet()
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        names = spec["model"]["vocab"]
        size = max([*names.values(), *added]) + 1
        self.bytes = [b""] * size
        for name, i in names.items():
            self.bytes[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        for i, content in added.items():
            self.bytes[i] = content
        self.occurs = np.zeros((256, 256), bool)
        for token in self.bytes:
            b = np.frombuffer(token, np.uint8)
            self.occurs[b[:-1], b[1:]] = True
        self.cache = FragmentCache(lambda texts: flat_ids(tokenizer, texts))

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bounds of the fragments: certain cuts and the texts' own bounds."""
        n = len(data)
        if n < 2:
            return np.unique(np.concatenate([offsets, [0, n]]))
        left, right = data[:-1], data[1:]
        certain = ~self.occurs[left, right] & ((right & 0xC0) != 0x80) & (right != ord("'"))
        # white space: ASCII, control characters and DEL, U+0085, U+00A0, and all of U+1000 to U+3FFF's lead bytes
        space = (left <= 0x20) | (left == 0x7F)
        space[1:] |= (data[:-2] == 0xC2) & ((left[1:] == 0x85) | (left[1:] == 0xA0))
        space[2:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3)
        certain &= ~space
        at = np.zeros(n + 1, bool)
        at[1:n] = certain
        at[offsets] = True
        at[[0, n]] = True
        return np.flatnonzero(at)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        cuts = self.cuts(data, offsets)
        ids, bounds = encode_cut(data, cuts, self.cache)
        at = bounds[np.searchsorted(cuts, offsets)]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        """As the byte-level decoder: bytes of all tokens, special ones included; broken UTF-8 is replaced."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns `keep` of docs (all, if None) and n_tokens, ids (little-endian unsigned 32-bit), decoded.

    Null and empty texts have no ids and decode to an empty text. A special token's string in a text is that
    token. Repeated rows count one by one; an empty table gives an empty result. Input columns named like an
    output give way to it.
    """
    ship_package(docs.sparkSession)
    own = row_struct(docs, keep)
    source = docs.select(own.alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_000):
                batch = whole.slice(lo, 1_000)
                ids = own.encode(*text_buffers(batch["text"]))
                yield pa.RecordBatch.from_arrays(
                    [batch["row"], pa.array(map(len, ids), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(map(own.decode, ids), pa.string())],
                    ["row", "n_tokens", "ids", "decoded"])

    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return with_outputs(source.mapInArrow(run, schema), "row", ["n_tokens", "ids", "decoded"])
