"""Cross-tokenizer alignment by merge-path partitioning.

Two vocabularies, A and B, cut one text into tokens.  Offsets at which tokens of
both end cut the tokens into groups; an A token and a B token of one group are
linked, and a pair of ids counts the documents that hold it linked.

1. An Arrow pass encodes the whole texts.  The ends of some documents, one after
   the other, are two sorted lists; their merge is a path, and diagonals of
   it PIECE apart, found by binary search, divide it into independent pieces of equal
   work, whatever the lengths of the documents.  A piece emits its overlaps (an
   A and a B token that share bytes, and whether both end there); two pieces that
   meet within one offset are stitched there, and groups run on over pieces.
2. The pairs of up to ENTRIES (document, pair) entries make a block, with a
   dictionary of its distinct pairs and in how many of its documents each is.
   Documents keep places in their block's dictionary, written to the shared
   folder.  Pairs are never shuffled by document, only by block.
3. Counts are summed by pair; the highest of each A id (as many rows as the
   vocabulary has ids, at most) is joined, and both go back to the blocks, where
   tasks that read a block's counts before its documents sum them up.

A group whose tokens make more than WIDE pairs is reduced to its distinct ids
first, so a long stretch without a common end costs its distinct pairs.

Defined cases: a null or empty text, and one whose joined A or B bytes differ
from blank and text, has no tokens: zeros and ''.  Special tokens' strings are
plain text.  Repeated rows count as documents each; a null id stays; an empty
table gives none; very long white space goes through a slower reader of the
same vocabulary; other columns are ignored.  Ids are below 65,536.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm import tokens
from quorum.llm.common import in_batches, written

PIECE, WIDE = 1 << 16, 1 << 12  # steps of a path piece; pairs of a group that is reduced first
ENTRIES, CHUNK = 1 << 21, 1 << 19  # (document, pair) entries of a block; bytes of text that are aligned together

DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
STORED = f"block long, {DOCUMENT}, pairs array<int>, times array<int>"


def merge_path(a: np.ndarray, b: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` are the first ``diagonal`` of their merge
    (``a`` first on ties), by one binary search per diagonal."""
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        left = a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonal - 1 - middle, 0, len(b) - 1)]
        low, high = np.where((low < high) & left, middle + 1, low), np.where((low < high) & ~left, middle, high)
    return low, diagonal - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, first_a: int, first_b: int):
    """The overlaps that end in one piece of the path: their ends, A tokens, B
    tokens, and whether both tokens end there as far as this piece can tell."""
    beside_a, beside_b = np.searchsorted(b, a), np.searchsorted(a, b)
    closes = np.zeros(len(a), bool)
    inside = beside_a < len(b)
    closes[inside] = b[beside_a[inside]] == a[inside]
    own = np.ones(len(b), bool)
    inside = beside_b < len(a)
    own[inside] = a[beside_b[inside]] != b[inside]  # ends that both have come from A
    ends = np.concatenate([a, b[own]])
    order = np.argsort(ends, kind="stable")
    return (ends[order], np.concatenate([first_a + np.arange(len(a)), first_a + beside_b[own]])[order],
            np.concatenate([first_b + beside_a, first_b + np.flatnonzero(own)])[order],
            np.concatenate([closes, np.zeros(own.sum(), bool)])[order])


def groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A token and every B token, from their (sorted) ends."""
    diagonal = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    at_a, at_b = merge_path(a, b, diagonal)
    of_a, of_b, closed, last = np.empty(len(a), np.int64), np.empty(len(b), np.int64), 0, None
    for i0, i1, j0, j1 in zip(at_a, at_a[1:], at_b, at_b[1:]):
        ends, x, y, closes = piece_overlaps(a[i0:i1], b[j0:j1], i0, j0)
        if last is not None and ends[0] == last:  # the cut lies between two equal ends: A's was in the piece before
            closed, ends, x, y, closes = closed + 1, ends[1:], x[1:], y[1:], closes[1:]
        if not len(ends):
            last = None
            continue
        group = closed + np.cumsum(closes) - closes
        inside = x < len(a)
        of_a[x[inside]] = group[inside]
        inside = y < len(b)
        of_b[y[inside]] = group[inside]
        closed = int(group[-1]) + int(closes[-1])
        last = None if closes[-1] else ends[-1]
    return of_a, of_b


def _encoded(texts: list[str], path_a: str, path_b: str) -> list[tuple[np.ndarray, np.ndarray] | None]:
    table_a, table_b = tokens.byte_table(path_a), tokens.piece_table(path_b)
    out = []
    for text, right in zip(texts, tokens.pieces(path_b).encode(texts, num_threads=1)):
        left = tokens.byte_ids(path_a, f" {text}", special=False) if text else []
        whole = f" {text}".encode()
        same = text and b"".join(map(table_a.__getitem__, left)) == whole and b"".join(map(table_b.__getitem__, right)) == whole
        out.append((np.array(left, np.int64), np.array(right, np.int64)) if same else None)
    return out


def _sums(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights


def _wide(ids_a: np.ndarray, ids_b: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
    (x, n), (y, m) = np.unique(ids_a, return_counts=True), np.unique(ids_b, return_counts=True)
    return ((doc << 32) | (x[:, None] << 16) | y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()


_SIGNS: list[str] = []


def _signs() -> list[str]:
    """Decimal ids with what follows them: ',', '|', ';' or nothing."""
    if not _SIGNS:
        _SIGNS.extend(f"{i}{sign}" for sign in (",", "|", ";", "") for i in range(1 << 16))
    return _SIGNS


def aligned(texts: list[str], path_a: str, path_b: str, piece: int = PIECE):
    """Of some texts: (n_a, n_b, n_groups, n_links, groups_sha256) each, and the
    keys (text << 32 | A id << 16 | B id, sorted) and times of their links."""
    encoded = _encoded(texts, path_a, path_b)
    held = [k for k, e in enumerate(encoded) if e]
    facts: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
    if not held:
        return facts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids_a, ids_b = (np.concatenate([encoded[k][side] for k in held]) for side in (0, 1))
    ends_a = np.cumsum(np.array([len(t) for t in tokens.byte_table(path_a)])[ids_a])
    ends_b = np.cumsum(np.array([len(t) for t in tokens.piece_table(path_b)])[ids_b])
    of_a, of_b = groups(ends_a, ends_b, piece)
    count_a, count_b = np.bincount(of_a), np.bincount(of_b)
    links = count_a * count_b
    after_a, after_b = np.cumsum(count_a), np.cumsum(count_b)
    stop_a, stop_b = (np.cumsum([len(encoded[k][side]) for k in held]) for side in (0, 1))
    # the texts' groups as strings: the tokens in their order there, each with its sign
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    place_a, place_b = np.arange(len(ids_a)) + (after_b - count_b)[of_a], np.arange(len(ids_b)) + after_a[of_b]
    ends = np.zeros(len(ids_a), np.int64)
    ends[after_a - 1] = 1
    codes[place_a] = ids_a | ends << 16
    ends = np.zeros(len(ids_b), np.int64)
    ends[after_b - 1] = 2
    ends[stop_b - 1] = 3
    codes[place_b] = ids_b | ends << 16
    signs, groups_upto = _signs(), np.concatenate([[0], of_a[stop_a - 1] + 1])
    links_upto, doc_of_group, start = np.concatenate([[0], np.cumsum(links)]), np.empty(len(links), np.int64), 0
    for n, k in enumerate(held):
        g0, g1, stop = groups_upto[n], groups_upto[n + 1], stop_a[n] + stop_b[n]
        doc_of_group[g0:g1] = k
        written_out = "".join(map(signs.__getitem__, codes[start:stop].tolist()))
        facts[k] = (len(encoded[k][0]), len(encoded[k][1]), int(g1 - g0), int(links_upto[g1] - links_upto[g0]),
                    hashlib.sha256(written_out.encode()).hexdigest())
        start = stop
    # all pairs of the groups that are not wide
    few = np.where(links <= WIDE, count_b, 0)[of_a]
    first_b = (after_b - count_b)[of_a]
    at = np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few)
    keys = np.repeat(doc_of_group[of_a] << 32 | ids_a << 16, few) | ids_b[np.repeat(first_b, few) + at]
    wide = np.flatnonzero(links > WIDE)
    if not len(wide):
        return facts, *_sums(keys, None)
    more = [_wide(ids_a[after_a[g] - count_a[g]:after_a[g]], ids_b[after_b[g] - count_b[g]:after_b[g]], doc_of_group[g]) for g in wide]
    return facts, *_sums(np.concatenate([keys, *[m[0] for m in more]]),
                         np.concatenate([np.ones(len(keys), np.int64), *[m[1] for m in more]]))


class _Block:
    """Documents and their links until there are ENTRIES; the parts of one
    document with more come as rows of their own, the facts with the first."""

    def __init__(self, part: int):
        self.number, self.docs, self.keys, self.times, self.held = part << 32, [], [], [], 0

    def add(self, facts: tuple, keys: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, max(1, len(keys)), ENTRIES):
            self.docs.append(facts if at == 0 else (facts[0], facts[1], 0, 0, 0, 0, ""))
            # copies, which do not hold the arrays of all texts they were aligned with
            self.keys.append(keys[at:at + ENTRIES].astype(np.uint32))
            self.times.append(times[at:at + ENTRIES].astype(np.int32))
            self.held += len(self.keys[-1])
            if self.held >= ENTRIES:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        pairs, place, n = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        upto = np.cumsum([0, *map(len, self.keys)])
        gaps = np.diff(place, prepend=0)  # places rise within a document, and small numbers are stored in little space
        some = upto[:-1][np.diff(upto) > 0]
        gaps[some] = place[some]
        yield _rows([(self.number, None, None, None, None, None, None, None)], pairs.view(np.int32), n, [0, len(pairs)])
        for at in range(0, len(self.docs), 256):
            to = min(at + 256, len(self.docs))
            times = np.concatenate(self.times[at:to])
            yield _rows([(self.number, *d) for d in self.docs[at:to]], gaps[upto[at]:upto[to]], times, upto[at:to + 1] - upto[at])
        self.number, self.docs, self.keys, self.times, self.held = self.number + 1, [], [], [], 0


_TYPES = [pa.int64()] * 7 + [pa.string()]


def _rows(rows: list[tuple], pairs, times, upto) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
    lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.asarray(x, np.int32))) for x in (pairs, times)]
    return pa.RecordBatch.from_arrays([*columns, *lists], [x.split()[0] for x in STORED.split(", ")])


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, row = _Block(part), part << 33
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK)))
                facts, keys, times = aligned([t or "" for t in texts.slice(at, to - at).to_pylist()], path_a, path_b)
                cuts = np.searchsorted(keys, np.arange(len(facts) + 1) << 32)
                keys &= 0xFFFFFFFF
                for k, fact in enumerate(facts):
                    yield from block.add((row, ids[at + k], *fact), keys[cuts[k]:cuts[k + 1]], times[cuts[k]:cuts[k + 1]])
                    row += 1
                at = to
        yield from block.flush()
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: first its counts by place, then its documents."""
    block, count, best = None, np.zeros(0, np.int64), np.zeros(0, bool)
    for batch in batches:
        own, places, counts, bests = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3))
        pairs, times = batch.column(4), batch.column(5)
        out = []
        for at in np.flatnonzero(np.diff(own, prepend=own[0] - 1)) if len(own) else []:
            to = at + int(np.searchsorted(own[at:], own[at], side="right"))
            if own[at] != block:
                block, count, best = own[at], np.zeros(0, np.int64), np.zeros(0, bool)
            n = int((~np.isnan(places[at:to].astype(float))).sum())
            if n:
                where = places[at:at + n].astype(np.int64)
                if where.max() >= len(count):
                    count, best = (np.concatenate([x, np.zeros(int(where.max()) + 1 + len(count) - len(x), x.dtype)]) for x in (count, best))
                count[where], best[where] = counts[at:at + n].astype(np.int64), bests[at:at + n].astype(bool)
            for k in range(at + n, to):
                mine, often = np.cumsum(pairs[k].values.to_numpy()), times[k].values.to_numpy().astype(np.int64)
                out.append((k, int(often[best[mine]].sum()), int((often * count[mine]).sum())))
        if out:
            rows, n_best, sums = zip(*out)
            kept = batch.select(list(range(6, batch.num_columns))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())],
                                             [*kept.schema.names, "n_best", "count_sum"])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of
    every row: ``path_a`` is the byte-level vocabulary, which encodes a blank and
    the text, ``path_b`` the piece vocabulary, which adds the blank."""
    stored = written(in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _align(path_a, path_b), STORED), "aligned")
    places = (stored.filter("row is null").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "of"))
              .select("block", "place", F.col("of.pairs").alias("pair"), F.col("of.times").alias("n")))
    total = written(places.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    of_a = F.shiftrightunsigned("pair", 16)
    top = F.broadcast(total.groupBy(of_a.alias("a")).agg(F.max("count").alias("top")))  # a row for each A id: under 65,536
    known = total.join(top, of_a == F.col("a")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    nothing = F.lit(None)
    counted = places.join(known, "pair").select("block", "place", "count", "best", nothing.cast("array<int>").alias("pairs"),
                                               nothing.cast("array<int>").alias("times"), *[
                                                   nothing.cast(t).alias(c) for c, t in (x.split() for x in DOCUMENT.split(", "))])
    own = stored.filter("row is not null").select("block", nothing.cast("int").alias("place"), nothing.cast("long").alias("count"),
                                                  nothing.cast("boolean").alias("best"), "pairs", "times",
                                                  *[x.split()[0] for x in DOCUMENT.split(", ")])
    sorted_rows = counted.unionByName(own).repartition("block").sortWithinPartitions("block", F.col("place").isNull())
    parts = in_batches(sorted_rows, _summed, f"{DOCUMENT}, n_best long, count_sum long")
    return parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256")).drop("row")
