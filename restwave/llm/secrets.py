"""Secret scans: patterns with a known shape, and random strings by token efficiency.

A byte-pair vocabulary learnt from prose spends few tokens on words and many on random characters. A run of key
characters that takes a token for every `ratio` characters or fewer is taken for a random string, unless it is
a known kind of harmless one: a digest (hex of a digest's length), a UUID, a number or date, or letters of one
case. Patterns come first; what they cover is not tested again.

A document is one row of one task; every character of it is read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.llm.common import row_struct, ship_package, with_outputs

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
#: Least characters of each kind: of the assigned value, of the rest as a whole.
ASSIGNED, ACCESS, HEX, RANDOM = 12, 18, 16, 20
#: A run with at most so many characters for each token is random.
RATIO = 2.0
#: Longer runs are encoded in pieces, as encoding one piece costs more than its length.
PIECE = 256

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX)  # runs are maximal either way
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile("|".join(rf"(?:[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}})" for n in DIGESTS))
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9+/_=-]*")
_WORD = re.compile(r"[A-Za-z0-9]+")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("past", T.LongType()),
                                  T.StructField("ratio", T.DoubleType())]))


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    """vocabulary: a rank file, or a public one's name."""
    file = vocabulary if os.path.exists(vocabulary) else public_tokenizers.path(vocabulary)
    with open(file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def harmless(run: str) -> bool:
    """Known digests and identifiers: these may look random, but open nothing."""
    if any(p.fullmatch(run) for p in (_DIGEST, _UUID, _NUMBER)):
        return True
    # words joined by marks, each of one case or capitalised
    return all(w.isalpha() and (w[1:].islower() or w.isupper() or len(w) == 1) for w in _WORD.findall(run))


@lru_cache(maxsize=100_000)
def _tokens(piece: str, vocabulary: str) -> int:
    return len(encoding(vocabulary).encode_ordinary(piece))


def characters_per_token(run: str, vocabulary: str = VOCABULARY) -> float:
    return len(run) / sum(_tokens(run[i:i + PIECE], vocabulary) for i in range(0, len(run), PIECE))


def pattern_spans(text: str) -> list[tuple[int, int, str, float | None]]:
    """(start, past, kind, None) of the patterns' matches, of each kind leftmost and apart."""
    lower = text.encode().lower()
    out = []
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(*m.span(), "assign", None) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    if "AKIA" in text:
        out += [(*m.span(), "access", None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS]
    return out + [(*m.span(), "hex", None) for m in _HEX.finditer(text)]


def secret_spans(text: str | None, ratio: float = RATIO, shortest: int = RANDOM, vocabulary: str = VOCABULARY) -> list[tuple[int, int, str, float | None]]:
    """(start, past, kind, characters for each token) of all spans in order of start, then of KINDS."""
    if not text:
        return []
    found = pattern_spans(text)
    gaps, last = [], 0  # what no pattern covers
    for start, past, *_ in sorted(found):
        gaps.append((last, start))
        last = max(last, past)
    for lo, hi in [*gaps, (last, len(text))]:
        for m in _RUN.finditer(text, lo, hi):
            if m.end() - m.start() >= shortest and not harmless(m[0]):
                got = characters_per_token(m[0], vocabulary)
                if got <= ratio:
                    found.append((*m.span(), "random", got))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, ratio: float = RATIO, shortest: int = RANDOM,
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` of docs (all, if None) and secrets: an array of (kind, start, past, ratio) in order of start, then kind.

    Places are code points, past is the place after the last; ratio is the characters for each token of a random
    string, else null. Null, empty and blank texts have an empty array. Repeated rows count one by one; an
    empty table gives an empty result. An input column named secrets, in any case, gives way to it.
    """
    ship_package(docs.sparkSession)
    source = docs.select(row_struct(docs, keep).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("past", pa.int64()), ("ratio", pa.float64())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "past": b, "ratio": r} for a, b, k, r in secret_spans(t, ratio, shortest, vocabulary)]
                     for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(spans, kind)], ["row", "secrets"])

    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("secrets", SPANS)])
    return with_outputs(source.mapInArrow(run, schema), "row", ["secrets"])
