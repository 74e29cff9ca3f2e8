"""Sets of word shingles, and pairs of them: what the near-duplicate operators share.

Sets are compared exactly in the end; before that, two bitmaps of parities tell
which pairs can be linked at all.  Such bitmaps never differ in more bits than
their sets in shingles, so no linked pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import LOWER, UPPER, erase, in_batches, written
from quorum.operators.joins import bounded_broadcast

SHINGLE = 5
MAX_BITS = 1 << 16

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
P, Q, R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def folded_words(text: str | None) -> list[bytes]:
    """Words as runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * Q
    x = (x ^ (x >> np.uint64(27))) * R
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting: ``np.unique`` hashes, which is slower)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def hashed(parts: list[bytes]) -> np.ndarray:
    """The set of a sequence of words, as sorted 64-bit hashes of its shingles."""
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(SHINGLE, len(each))
    out = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * P + each[k:len(each) - size + 1 + k]
    return distinct(mix(out))


def shingles(words: bytes) -> set[bytes]:
    """The set of a normalised text (words joined by single blanks), in full."""
    parts = words.split(b" ") if words else []
    if len(parts) < SHINGLE:
        return {words} if words else set()
    out, at, ends = set(), 0, []
    for p in parts:
        ends.append(at + len(p))
        at += len(p) + 1
    start = 0
    for i in range(len(parts) - SHINGLE + 1):
        out.add(words[start:ends[i + SHINGLE - 1]])
        start = ends[i] + 1
    return out


def most_different(a, b, percent: int):
    """The most shingles by which sets of these sizes can differ if they are
    ``percent`` similar."""
    return (a + b) * (100 - percent) // (100 + percent)


# ---- bitmaps -----------------------------------------------------------------

def bitmap(values: np.ndarray) -> bytes:
    """Parities of the set's values in a power of two of bits, at least four a
    value (2^16 at most)."""
    bits = min(MAX_BITS, max(64, 1 << (4 * len(values) - 1).bit_length()))
    return np.packbits(np.bincount((values >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap as ``width`` 64-bit words: the parities of a narrower bitmap are
    those of its parts together."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width), axis=0)


def coarse(bits: bytes) -> bytes:
    """A quarter of a bitmap, at least a bit a value: what travels with a
    vertex to every node that it is in."""
    return folded(bits, max(1, len(bits) // 32)).tobytes()


def differing(maps: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ, as wide as the narrower one."""
    width = np.array([len(m) // 8 for m in maps])
    out, narrow = np.empty(len(i), np.int64), np.minimum(width[i], width[j])
    for w in np.unique(narrow):
        here = np.flatnonzero(narrow == w)
        used, place = np.unique(np.concatenate([i[here], j[here]]), return_inverse=True)
        table = np.stack([folded(maps[k], w) for k in used])
        x, y = place[:len(here)], place[len(here):]
        step = max(1, (1 << 20) // int(w))
        for at in range(0, len(here), step):
            cut = slice(at, at + step)
            out[here[cut]] = np.bitwise_count(table[x[cut]] ^ table[y[cut]]).sum(axis=1, dtype=np.int64)
    return out


def possible(sizes: np.ndarray, maps: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can be ``percent`` similar, by their sizes and bitmaps."""
    low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    good = np.flatnonzero(100 * low >= percent * high)
    return good[differing(maps, i[good], j[good]) <= most_different(low[good], high[good], percent)]


# ---- tasks -------------------------------------------------------------------

BULK, FEW = 1 << 15, 64  # rows that are compared together; rows of a node whose pairs are written out at once
PAIRS = 1 << 18  # pairs that are held at once


def _bulks(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Columns of whole nodes (column 0, sorted), BULK rows or a node at a time."""
    held: list = []

    def table(parts):
        return [x for x in map(pa.chunked_array, zip(*(b.columns for b in parts)))]
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= BULK:
            whole = table(held)
            nodes = whole[0].to_numpy()
            last = int(np.searchsorted(nodes, nodes[-1]))
            if last:
                yield [c.slice(0, last) for c in whole]
                held = [pa.RecordBatch.from_arrays([c.slice(last).combine_chunks() for c in whole], batch.schema.names)]
                n -= last
    if held:
        yield table(held)


def _pairs_within(nodes: np.ndarray, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of different parts in the same node, about PAIRS at a time."""
    starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    stops = np.append(starts[1:], len(nodes))
    many = stops - starts
    left = np.repeat(np.where(many <= FEW, stops, 0), many) - np.arange(len(nodes)) - 1  # partners behind each row
    left = np.maximum(left, 0)
    ahead = np.cumsum(left)
    cuts = np.searchsorted(ahead, np.arange(0, ahead[-1], PAIRS), side="right")
    for at, to in zip(cuts, np.append(cuts[1:], len(nodes))):
        own = left[at:to]
        i = np.repeat(np.arange(at, to), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        apart = parts[i] != parts[j]
        yield i[apart], j[apart]
    for start, stop in zip(starts[many > FEW], stops[many > FEW]):
        _, part, n = np.unique(parts[start:stop], return_inverse=True, return_counts=True)
        large = part == n.argmax()
        order = start + np.argsort(large, kind="stable")  # rows of the largest part last: they are not compared with each other
        others, step = int((~large).sum()), max(1, PAIRS // len(order))
        for at in range(0, others, step):
            own = order[at:min(at + step, others)]
            x, y = np.nonzero(parts[own][:, None] != parts[order[at:]][None, :])
            ahead = y > x
            yield own[x[ahead]], order[at:][y[ahead]]


def near_pairs(percent: int, only_closest: bool, screen: int = 0):
    """Of nodes (node, row, part, n_shingles, map[, low]) the pairs (a < b) of
    different parts that can be similar enough by their bitmaps: all, or of every
    two parts the closest among some nodes.  With ``screen``, pairs agree in so many bytes of ``low``.
    Pairs are made and tested about PAIRS at a time, however many the nodes hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, rows, parts, sizes, *wide in _bulks(batches):
            rows, parts, sizes = (c.to_numpy() for c in (rows, parts, sizes))
            # rows that are in several of these nodes are one, and so are their pairs
            names, first, own = np.unique(rows, return_index=True, return_inverse=True)
            every, parts, sizes = parts, parts[first], sizes[first]
            bytes_ = wide[1].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)[first] if screen else None
            maps = wide[0].take(pa.array(first)).to_pylist()

            def kept(pairs, apart):
                """Pairs in order, each once; with only_closest, the closest of every two parts."""
                pairs, at = np.unique(pairs, return_index=True)
                apart = apart[at]
                if only_closest and len(pairs):
                    x, y = parts[pairs // len(names)], parts[pairs % len(names)]
                    low, high = np.minimum(x, y), np.maximum(x, y)
                    order = np.lexsort((apart, high, low))
                    best = order[np.concatenate([[True], (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)])]
                    pairs, apart = pairs[best], apart[best]
                return pairs, apart

            def batch(pairs):
                return pa.RecordBatch.from_arrays([pa.array(names[pairs // len(names)]), pa.array(names[pairs % len(names)])], ["a", "b"])
            found, n = [], 0
            for i, j in _pairs_within(nodes.to_numpy(), every):
                low, high = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
                pairs = distinct(low * len(names) + high)
                i, j = pairs // len(names), pairs % len(names)
                good = (100 * sizes[i] >= percent * sizes[j]) & (100 * sizes[j] >= percent * sizes[i])
                i, j = i[good], j[good]
                if screen:
                    good = np.concatenate([(bytes_[i[at:at + BULK]] == bytes_[j[at:at + BULK]]).sum(axis=1) >= screen
                                           for at in range(0, len(i), BULK)] or [np.zeros(0, bool)])
                    i, j = i[good], j[good]
                apart = differing(maps, i, j)
                good = apart <= most_different(sizes[i], sizes[j], percent)
                found.append((i[good] * len(names) + j[good], apart[good]))
                n += int(good.sum())
                if n > PAIRS:
                    found = [kept(*(np.concatenate(x) for x in zip(*found)))]
                    n = len(found[0][0])
                    if n > PAIRS // 2:  # then one that is met again is given again
                        yield batch(found[0][0])
                        found, n = [], 0
            if n:
                yield batch(kept(*(np.concatenate(x) for x in zip(*found)))[0])
    return run


def _allowed(percent: int):
    """Of (a, b, sizes, bitmaps) the pairs that can be similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes = np.concatenate([batch.column(c).to_numpy() for c in (2, 3)])
            good = possible(sizes, [*batch.column(4).to_pylist(), *batch.column(5).to_pylist()], np.arange(n), n + np.arange(n), percent)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))
    return run


def _confirm(percent: int):
    """Of (a, b, words of a, words of b) the similar pairs, by their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            good = []
            for k, (a, first, second) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if a != last:
                    last, left = a, shingles(first.as_py())
                right = shingles(second.as_py())
                both = len(left & right)
                if 100 * both >= percent * (len(left) + len(right) - both):
                    good.append(k)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))
    return run


# ---- jobs --------------------------------------------------------------------

def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, screened: bool = False) -> DataFrame:
    """The links among some pairs (a < b), written.  ``sets`` has row,
    n_shingles, bits and words; pairs that are not ``screened`` by whole bitmaps
    yet meet them first, and texts travel for the rest only."""
    pairs = written(pairs.distinct(), "pairs")
    if not screened:
        size = sets.select("row", "n_shingles", "bits")
        ends = [size.select(F.col("row").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"]
        pairs = written(in_batches(pairs.join(ends[1], "b").join(ends[0], "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b"),
                                   _allowed(percent), "a long, b long"), "pairs")
    used = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    words = sets.select("row", "words").join(bounded_broadcast(used), "row", "left_semi")  # the others' texts are not shuffled
    ends = [words.select(F.col("row").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab"]
    both = pairs.join(ends[1], "b").join(ends[0], "a").select("a", "b", "words_a", "words_b")
    return written(in_batches(both, _confirm(percent), "a long, b long"), "links")


def compared(nodes: DataFrame, vertices: DataFrame, percent: int, only_closest: bool, screen: int = 0) -> DataFrame:
    """Pairs of different parts within the nodes (node, row); ``vertices`` has
    row, part, n_shingles, map (a bitmap, whole or coarse), and low if they are screened by it."""
    full = nodes.join(vertices, "row").select("node", "row", "part", "n_shingles", "map", *(["low"] if screen else []))
    tasks = full.repartition("node").sortWithinPartitions("node")
    return in_batches(tasks, near_pairs(percent, only_closest, screen), "a long, b long")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (row, part) of what ``parts`` joins and ``links`` (a, b)."""
    if links.isEmpty():
        return parts
    return written(components(parts.select(F.col("row").alias("a"), F.col("part").alias("b")).union(links)), "parts")


def components(edges: DataFrame) -> DataFrame:
    """(row, part) for every end of the undirected edges (a, b): part is the
    smallest row that can be reached.  Large-star and small-star steps, each
    round written, until the edges stay the same."""
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                    "edges")
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", "m")).distinct())
        before, edges = edges, written(small, "edges")
        erase(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("row"), F.col("v").alias("part")).union(
        edges.select(F.col("v").alias("row"), F.col("v").alias("part"))).distinct()
