"""Encoding of texts by their distinct fragments: each is encoded once for a batch and looked up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts that a tokenizer encodes in one call.
AT_ONCE = 2_000


class FragmentCache:
    """Token ids of fragments, all in one array. When it holds `most` fragments, those that only one batch
    has asked for go.

    `encode_many` gives the ids of a list of texts in one array, and their numbers.
    """

    def __init__(self, encode_many, most: int = 500_000):
        self.encode_many, self.most = encode_many, most
        self.slot: dict[bytes, int] = {}
        self.ids, self.starts, self.asked = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _shrink(self, room: int) -> None:
        keep = self.asked > 1
        if self.most - int(keep.sum()) < room:
            keep[:] = False
        place = np.cumsum(keep) - 1
        self.slot = {x: int(place[i]) for x, i in self.slot.items() if keep[i]}
        sizes = np.diff(self.starts)
        self.ids = np.append(self.ids[:self.starts[-1]][np.repeat(keep, sizes)], np.zeros(1 << 16, np.uint32))
        self.starts = np.concatenate([[0], np.cumsum(sizes[keep])])
        self.asked = np.ones(len(self.slot), np.int32)

    def slots(self, fragments: list[bytes]) -> np.ndarray:
        """The places of the fragments (all distinct) in `starts`."""
        missing = [x for x in fragments if x not in self.slot]
        if missing and self.slot and len(self.slot) + len(missing) > self.most:
            self._shrink(len(missing))
            missing = [x for x in fragments if x not in self.slot]
        if missing:
            ids, sizes = self.encode_many([x.decode() for x in missing])
            used = int(self.starts[-1])
            if used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)])
            self.ids[used:used + len(ids)] = ids
            self.slot.update(zip(missing, range(len(self.slot), len(self.slot) + len(missing))))
            self.starts = np.concatenate([self.starts, used + np.cumsum(sizes)])
            self.asked = np.concatenate([self.asked, np.zeros(len(missing), np.int32)])
        out = np.fromiter(map(self.slot.__getitem__, fragments), np.int64, len(fragments))
        self.asked[out] += 1
        return out


def flat_ids(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and their numbers. Few texts at a time, as an encoding takes many times its ids."""
    ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for lo in range(0, len(texts), AT_ONCE):
        found = [e.ids for e in tokenizer.encode_batch_fast(texts[lo:lo + AT_ONCE], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter((i for x in found for i in x), np.uint32, int(sizes[-1].sum())))
    return np.concatenate(ids), np.concatenate(sizes)


def encode_cut(data: np.ndarray, cuts: np.ndarray, cache: FragmentCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all fragments in order, and the n + 1 bounds of the fragments in them. cuts: bounds in the bytes."""
    n = len(cuts) - 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    fragments = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = fragments.dictionary_encode()
    slots = cache.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    starts = cache.starts[slots]
    sizes = cache.starts[slots + 1] - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # for each output place: its fragment's start in the cache plus its offset there
    place = np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])
    return cache.ids[place], bounds
