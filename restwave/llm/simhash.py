"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into blocks; two that differ in at most `distance` bits agree on all but `distance`
blocks, so they meet under at least one choice of the other blocks. Distinct fingerprints are joined on each
such choice (one exchange, sorted buckets) and verified by Hamming distance; a bucket gives links that connect
what is linked in it, not all pairs. The links are then contracted to components by star steps.

Copies share a fingerprint and count once from the first exchange on. A bucket holds distinct fingerprints
that agree on its fixed bits, hence at most 2**free of them, with `free` the bits of the `distance` open
blocks (22 for 64 bits in six blocks): 32 MB at the very most, whatever the data. Small buckets compare all
fingerprints; large ones look up each fingerprint's neighbours, which is exact too and linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restwave.llm.common import durable, forget, if_small, mix, named, row_struct, ship_package

BITS, BLOCKS, DISTANCE, SHINGLE, SEED = 64, 6, 2, 3, 42
#: Buckets up to this size compare all their fingerprints; beyond it each looks up its neighbours.
ALL_PAIRS = 1024


def _fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for r, text in enumerate(texts.to_pylist()):
        words = text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII white space only
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts, ends = (ends - sizes)[:n].tolist(), (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)
        counts = np.zeros(BITS, np.int64)
        for part in np.array_split(hashes, n // 100_000 + 1):
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fingerprint (long, the 64 bits) of every row. Null, empty and blank texts have fingerprint 0."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(_fingerprints_of(batch["text"], shingle).view(np.int64))], ["id", "fingerprint"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fingerprint long")


def block_masks(bits: int = BITS, blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each choice of `distance` open blocks, the bits of all the others."""
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(x for i, x in enumerate(block) if i not in free) for free in combinations(range(blocks), distance)]


def bucket_links(values: np.ndarray, mask: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect all values of a bucket (distinct, sorted, equal under the mask) within the distance.

    Each value is linked to the values near it that come before it, unless they are connected already.
    """
    n, parent, links = len(values), list(range(len(values))), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(i: int, j: int) -> None:
        a, b = top(i), top(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(values[i]), int(values[j])))

    if n <= ALL_PAIRS:
        for i in range(1, n):
            for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= distance).tolist():
                link(j, i)
        return links
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    for k in range(1, distance + 1):
        for bits in combinations(free, k):
            near = values ^ np.uint64(sum(bits))
            place = np.searchsorted(values, near)
            place[place == n] = 0
            for i in np.flatnonzero((values[place] == near) & (place < np.arange(n))).tolist():
                link(int(place[i]), i)
    return links


def block_links(distinct: DataFrame, fingerprint: str = "fingerprint", blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints: enough to connect all within the distance."""
    ship_package(distinct.sparkSession)
    masks = block_masks(BITS, blocks, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col(fingerprint).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    keyed = distinct.select(keys.alias("k"), F.col(fingerprint).alias("value")).select("k.mask", "k.key", "value")
    # sorted buckets stream through a task; one bucket at a time is in memory
    dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "value")])
            now = now if rest is None else np.concatenate([rest, now], axis=1)
            cut = np.flatnonzero((now[0, 1:] != now[0, :-1]) | (now[1, 1:] != now[1, :-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            yield from closed(now[:, :last], cut)
            rest = now[:, last:]
        if rest is not None:
            yield from closed(rest, np.zeros(0, np.int64))

    def closed(rows: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate([[0], cut[cut < rows.shape[1]], [rows.shape[1]]])
        found: list[tuple[int, int]] = []
        for b in np.flatnonzero(np.diff(bounds) > 1).tolist():
            part = rows[:, bounds[b]:bounds[b + 1]]
            found += bucket_links(np.sort(part[2].view(np.uint64)), masks[int(part[0, 0])], distance)
        a, b = (np.array([x[i] for x in found], np.uint64).view(np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b): root is the least node reachable.

    Large-star and small-star steps by turns: each keeps components whole and never raises the number of
    links by more than the nodes, so that no row count depends on a group's squared size. A star step needs
    the least neighbour of a node (aggregated on the map side) and sends it to the others. Each round is
    written to the shared folder, and the round before it deleted; it ends when nothing moves, after about log2
    of the longest path rounds.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node hang on the least of its neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lesser neighbours hang on the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        last, edges = edges, durable(small.select(F.col("u"), F.col("m").alias("v"))
                                     .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        forget(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _rooted(prints: DataFrame, blocks: int, distance: int) -> DataFrame:
    """fingerprint, root, component_id (least id) of every distinct fingerprint."""
    distinct = durable(prints.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    roots = components(block_links(distinct, blocks=blocks, distance=distance))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(named, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least id reachable over links, for every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows without an id are
    linked and returned with a null id; component_id is null only if no row of the component has an id.
    Repeated rows come back as often as given. An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    return prints.join(_rooted(prints, blocks, distance), "fingerprint").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: The long fingerprint: WORDS words of 64 bits to verify, and CLASSES blocks on each of two levels to meet in.
WORDS, CLASSES, FEWEST, SMALL = 4, 12, 8, 64
#: Texts, and shingles of all texts, in a part of a large group; a task compares two parts at a time.
CELL, CELL_SHINGLES = 2048, 1 << 21
_LANES = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def long_limit(similarity: float) -> int:
    """Differing bits of long fingerprints up to which texts of this Jaccard similarity are expected, 3.5
    standard deviations included: a bit differs with the angle between the shingle vectors over pi."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = BITS * WORDS
    return int(bits * p + 3.5 * np.sqrt(bits * p * (1 - p)))


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = text.encode().lower().split() if text else []
    shingles = {b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(shingles)))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(over_half: np.ndarray) -> np.ndarray:
    return np.packbits(over_half, axis=-1, bitorder="little").view(np.uint64)


def _long_fingerprint(text: str | None, shingle: int) -> tuple[int, list[int], list[int], list[int] | None]:
    """Digest of the distinct shingles, their fingerprint words, the blocks' keys, and small sets themselves."""
    hashes = _shingle_hashes(text, shingle)
    n, digest = len(hashes), xxhash.xxh3_64_intdigest(hashes.tobytes())
    if not n:
        return digest, [0] * WORDS, [], []
    counts = np.zeros((WORDS, BITS), np.int64)
    for part in np.array_split(hashes, n // 50_000 + 1):
        for lane in range(WORDS):
            counts[lane] += _bit_counts(mix(part ^ _LANES[lane])).sum(axis=0, dtype=np.int64)
    keys = []
    low = max(FEWEST, 1 << max(0, int(np.log2(n / 4)))) if n >= 4 else FEWEST
    for classes in (low, 2 * low):
        own = hashes & np.uint64(classes - 1)
        part = hashes[own < CLASSES]
        if len(part):
            order = np.argsort(part & np.uint64(classes - 1), kind="stable")
            part = part[order]
            at = (part & np.uint64(classes - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sizes = np.diff(np.append(first, len(part)))
            bits = np.add.reduceat(_bit_counts(mix(part)).astype(np.int64), first, axis=0)
            block = _pack(2 * bits > sizes[:, None]).ravel()
            keys += mix(block ^ mix(np.uint64(classes * 64) + at[first].astype(np.uint64) + sizes.astype(np.uint64) * np.uint64(1 << 40))).tolist()
    return digest, _pack(2 * counts > n).ravel().tolist(), keys, hashes.tolist() if n <= SMALL else None




def similar_documents(marked: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Which of the rows of (id, hash, text) are linked by word shingles: keys (id, hash, digest of the shingles) of
    every row, and for every digest its least row and its root (digest, rank, root). Both are durable.

    SimHash of one short word can't tell a similarity of 0.8 by two bits, so documents have a long fingerprint:
    their distinct shingles are dealt to classes by hash, each class has a fingerprint of its own, and these
    are the blocks. Texts that differ in fewer shingles than there are classes agree in a whole block; a class
    holds about 2 to 8 shingles (two levels, by powers of two of the shingle count), so of texts of similarity
    0.8 each block agrees with a chance of 0.4 and one of 12 to 24 with over 99 %. In a block each text first
    meets the least one, which connects most; then any two texts of a block that are not connected meet. Met
    pairs within the Hamming distance of 256 bits that the similarity allows are confirmed on the texts' whole
    shingle sets; small sets need no distance or a wider one. Texts of equal shingles are one node throughout:
    rows are combined to nodes before any join, so copies of one text never gather in a task.
    """
    ship_package(marked.sparkSession)
    words = [f"f{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda v: np.array(v, np.uint64).view(np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_000):
                batch = whole.slice(lo, 1_000)
                digest, prints, keys, small = zip(*[_long_fingerprint(t, shingle) for t in batch["text"].to_pylist()])
                prints = signed(prints).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["hash"], pa.array(signed(digest)), *[pa.array(np.ascontiguousarray(prints[:, i])) for i in range(WORDS)],
                     pa.array([signed(k) for k in keys], pa.list_(pa.int64())), pa.array([None if x is None else signed(x) for x in small], pa.list_(pa.int64()))],
                    ["id", "hash", "digest", *words, "keys", "small"])

    prints = durable(marked.select("id", "hash", "text").mapInArrow(
        run, f"id long, hash long, digest long, {', '.join(w + ' long' for w in words)}, keys array<long>, small array<long>"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    nodes = durable(prints.groupBy("digest").agg(F.min(rank).alias("rank"), *[F.first(c).alias(c) for c in (*words, "keys", "small")]))
    keyed = nodes.select("digest", F.explode(F.array_distinct("keys")).alias("key"))
    least = keyed.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("most")).where("a < most").select("key", "a")
    pairs = keyed.join(least, "key").select("a", F.col("digest").alias("b")).where("a <> b").distinct()
    side = lambda x: nodes.select(F.col("digest").alias(x), F.struct(*words, "small").alias(f"{x}_"))
    bits = sum((F.bit_count(F.col(f"a_.{w}").bitwiseXOR(F.col(f"b_.{w}"))) for w in words[1:]), F.bit_count(F.col(f"a_.{words[0]}").bitwiseXOR(F.col(f"b_.{words[0]}"))))
    shared = F.size(F.array_intersect("a_.small", "b_.small"))
    exact = shared >= F.lit(similarity) * (F.size("a_.small") + F.size("b_.small") - shared)
    close = durable(pairs.join(side("a"), "a").join(side("b"), "b").withColumn("sure", F.col("a_.small").isNotNull() & F.col("b_.small").isNotNull()).where(
        F.when(F.col("sure"), exact).otherwise(bits <= long_limit(similarity))).select("a", "b", "sure"))
    # whole sets of the texts in close pairs, one row of each text
    unsure = close.where("not sure").select("a", "b")
    needed = unsure.select(F.col("a").alias("digest")).unionByName(unsure.select(F.col("b").alias("digest"))).distinct()
    sets = durable(_whole_sets(needed, nodes, marked, shingle))
    both = unsure.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    confirmed = both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b")
    links = close.where("sure").select("a", "b").unionByName(confirmed)
    rooted = durable(_with_root(nodes, "digest", components(links)))
    forget(sets)
    forget(nodes)
    late = _late_links(rooted, marked, shingle, similarity)
    roots = durable(_with_root(rooted.select("digest", "rank", F.col("root").alias("early")), "early", components(late)).select("digest", "rank", "root"))
    forget(rooted)
    keys = durable(prints.select("id", "hash", "digest"))
    forget(prints)
    return keys, roots


def _with_root(frame: DataFrame, of: str, roots: DataFrame) -> DataFrame:
    """frame and the root of its column `of`: that column itself where no link has it."""
    return frame.join(roots, frame[of] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", of))


def _late_links(rooted: DataFrame, marked: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Confirmed links (a, b) between roots, enough to connect all that share a block and are similar.

    Most blocks have one root, and in others most texts are of one: those meet the rest, not one another.
    """
    words = [f"f{i}" for i in range(WORDS)]
    keyed = rooted.select("digest", "root", *words, F.col("small").isNotNull().alias("small"), F.explode(F.array_distinct("keys")).alias("group"))
    parts = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
    several = (keyed.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("group").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi"))
               .where("lo < hi").select("group", "main", parts(F.col("n") - F.col("most")).alias("parts"), parts(F.col("most")).alias("main_parts")))
    limits = np.array([long_limit(similarity), _short_limit(similarity)])

    def near(table: pa.Table) -> list[tuple[int, int]]:
        roots, small = table["root"].to_numpy(), table["small"].to_numpy()
        bits = np.stack([table[w].to_numpy() for w in words]).view(np.uint64)

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            differ = np.bitwise_count(bits[:, others] ^ bits[:, i:i + 1]).sum(axis=0, dtype=np.int64)
            return (roots[others] != roots[i]) & (differ <= limits[(small[others] & small[i]).astype(int)])

        digests = table["digest"].to_numpy()
        return [(int(digests[i]), int(digests[j])) for i, j in forest(np.arange(len(digests)), similar)]

    # all pairs of different roots that are near lie in one cluster, so a shingle set is sent once, not for each block
    clusters = durable(components(_in_cells(keyed.join(several, "group"), near)).select(F.col("node").alias("digest"), F.col("root").alias("group")))
    sets = durable(_whole_sets(clusters, rooted, marked, shingle).join(clusters, "digest").join(rooted.select("digest", "root"), "digest"))
    sizes = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("total")).select(
        "group", F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("total") / CELL_SHINGLES)).cast("int").alias("parts")).withColumns(
        {"main": F.lit(None).cast("long"), "main_parts": F.lit(0)})

    def exact(table: pa.Table) -> list[tuple[int, int]]:
        roots, shingles = table["root"].to_numpy(), table["shingles"].combine_chunks()
        size = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, code, times = np.unique(shingles.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[code] > 1
        code, owner = code[shared], np.repeat(np.arange(len(size)), size)[shared]
        start = np.searchsorted(owner, np.arange(len(size) + 1))
        mark = np.zeros(len(times), bool)

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            own, rest = code[start[i]:start[i + 1]], slice(start[i + 1], None)
            mark[own] = True
            common = np.bincount(owner[rest][mark[code[rest]]], minlength=len(size))[others]
            mark[own] = False
            return common >= similarity * (size[i] + size[others] - common)

        return [(int(roots[i]), int(roots[j])) for i, j in forest(np.unique(roots, return_inverse=True)[1], similar)]

    return _in_cells(sets.join(sizes, "group"), exact)


def _short_limit(similarity: float) -> int:
    """The limit between two small sets, whose bits are even votes so often that they differ up to a quarter more; 5 deviations."""
    p, bits = 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi, BITS * WORDS
    return int(bits * p + 5 * np.sqrt(bits * p * (1 - p)))


def forest(labels: np.ndarray, similar) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that similar(i, later places) finds; equal labels are connected from the start."""
    labels, links = labels.copy(), []
    for i in range(len(labels) - 1):
        others = np.flatnonzero(labels[i + 1:] != labels[i]) + i + 1
        if len(others):
            others = others[similar(i, others)]
        if len(others):
            found, at = np.unique(labels[others], return_index=True)
            links += [(i, j) for j in others[at].tolist()]
            labels[np.isin(labels, found)] = labels[i]
    return links


def _in_cells(members: DataFrame, links_of) -> DataFrame:
    """The links (a, b) that links_of gives for the rows of each group. A group of several `parts` is dealt into
    cells of two parts, so that any two of its rows meet in a cell and no task needs the whole group. Rows of the
    root `main`, which need not meet one another, have `main_parts` of their own, each of which meets every part
    of the others."""
    parts, mains = F.col("parts"), F.col("main_parts")
    part = F.pmod(F.xxhash64("digest", F.lit(CELL)), parts).cast("int")
    main_part = F.pmod(F.xxhash64("digest", F.lit(CELL)), mains).cast("int")
    everyone = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda x, y: x.cast("long") * (parts + mains) + y
    others = F.filter(everyone(parts), lambda q: (q != part) | (parts == 1))
    cells = F.when(F.col("root").eqNullSafe(F.col("main")), F.transform(everyone(parts), lambda q: pair(q, parts + main_part))).otherwise(F.concat(
        F.transform(others, lambda q: pair(F.least(q, part), F.greatest(q, part))), F.transform(everyone(mains), lambda q: pair(part, parts + q))))
    dealt = members.withColumn("cell", F.explode(cells)).repartition("group", "cell").sortWithinPartitions("group", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, cell = batch["group"].to_numpy(), batch["cell"].to_numpy()
            bounds = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), batch.num_rows]
            found: list[tuple[int, int]] = []
            for lo, hi in zip(bounds, bounds[1:]):
                if now != (group[lo], cell[lo]):
                    found += links_of(pa.Table.from_batches(pieces)) if pieces else []
                    pieces, now = [], (group[lo], cell[lo])
                pieces.append(batch.slice(lo, hi - lo))
            yield packed(found)
        if pieces:
            yield packed(links_of(pa.Table.from_batches(pieces)))

    def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _whole_sets(needed: DataFrame, nodes: DataFrame, marked: DataFrame, shingle: int) -> DataFrame:
    """digest and all shingle hashes of the texts whose digests are needed, one row of each text."""
    one = durable(nodes.join(needed, "digest", "left_semi").select("digest", F.col("rank.id").alias("one_id"), F.col("rank.hash").alias("one_hash")))
    texts = marked.select("id", "hash", "text").join(
        if_small(one), F.col("id").eqNullSafe(F.col("one_id")) & (F.col("hash") == F.col("one_hash"))).select("digest", "text")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_shingle_hashes(t, shingle).view(np.int64) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(sets, pa.list_(pa.int64()))], ["digest", "shingles"])

    return texts.mapInArrow(whole_sets, "digest long, shingles array<long>").dropDuplicates(["digest"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay when one row of each near-duplicate group does, with the columns of docs.

    The row of the least id stays (an id before none); rows that share it are told apart by a hash of all
    their columns, and of wholly equal rows one stays. Null, empty and blank texts form one group. An empty table gives an
    empty result. Only keys are joined to find the rows that go; where these are few, no text is moved at all.
    """
    marked = docs.select(row_struct(docs).alias("row"), named(docs, id_col).cast("long").alias("id"), named(docs, text_col).cast("string").alias("text"),
                         F.xxhash64(*[named(docs, c) for c in docs.columns]).alias("hash"))
    keys, roots = similar_documents(marked, shingle, similarity)
    stays = roots.groupBy("root").agg(F.min("rank").alias("r")).select(F.col("r.id").alias("stay_id"), F.col("r.hash").alias("stay_hash"))
    # wholly equal rows have one key, of which one row must stay
    times = keys.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("times"))
    judged = times.join(stays, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("hash") == F.col("stay_hash")), "left").select(
        F.col("id").alias("key_id"), F.col("hash").alias("key_hash"), F.col("stay_hash").isNotNull().alias("stays"), "times")
    apart = durable(judged.where("not stays or times > 1"))
    found = marked.join(if_small(apart), F.col("id").eqNullSafe(F.col("key_id")) & (F.col("hash") == F.col("key_hash")), "left")
    once = found.where("stays is null").select("row", "id", "hash")
    repeated = found.where("stays").select("row", "id", "hash").dropDuplicates(["id", "hash"])
    return once.unionByName(repeated).select("row.*")
