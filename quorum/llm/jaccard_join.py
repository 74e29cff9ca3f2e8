"""Exact set similarity join by universe partition and pigeonhole.

A document's set holds its distinct shingles of five words (lower-cased
ASCII letters, words as runs of anything but white space), the whole sequence
if there are fewer.  Documents with ``100 |A and B| >= PERCENT |A or B|`` are
linked, and linked documents form components.  No link between different texts
is left to chance.

1. An Arrow pass makes each text's digest, size and difference bitmap.  Equal
   texts are one vertex.
2. Sizes are cut into bands.  A band's scheme serves the pairs whose smaller set
   lies in it: their sets differ in at most H shingles.  The scheme hashes the universe of
   shingles into segments, of weight 1 or 2.  A segment of weight 1 has one
   key, its subset of the document's shingles; one of weight 2 also has a key for
   every subset with one shingle deleted, and sets without a common key there differ
   by its weight at least.  The weights add up to more than H, so linked sets share a key
   somewhere.  How many segments get weight 2 is decided by cost: rows written,
   and pairs expected from segments that hold none of a document's own shingles, for as many
   documents as the band has.
3. Vertices that share a key are a node.  A node's first vertex is compared with
   the others, which connects most of each group of copies; then nodes are
   compared exhaustively, but only between different components and only pairs that
   their bitmaps allow: two bitmaps of parities never differ in more bits than their sets in
   shingles.  First one vertex of every component in a node, then all.
4. The weights exceed H by a slack.  A key of more than SMALL vertices is hot; linked sets share more
   weight than the slack, so a vertex whose hot keys weigh no more than it
   leaves them all and is still found by a cold one.  Only vertices with more
   hot keys stay in hot nodes, which are compared by pairs of blocks.  Empty segments
   are such keys too: they are not written while they weigh little.
5. Candidates are confirmed on the full sets of shingles.

Shingles are hashed to 64 bits for keys and bitmaps; a shingle that took another's
value could only add a candidate.

Defined cases: documents without words (null, empty, white space) have an empty
set, linked with nothing; equal texts are linked; rows with one doc_id and
several texts are vertices of their own that carry the same id; a null id sorts
after all others, and a component of null ids only has a null component_id; an
empty table gives none; other columns are ignored.  A bitmap has 2^16 bits at
most: very long texts are screened less sharply, and confirmed all the same.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import in_batches, light_batches, wide_batches, written
from quorum.llm.set_pairs import P, Q, R, bitmap, coarse, compared, confirmed, distinct, folded_words, hashed, merged, mix, most_different
from quorum.operators.joins import bounded_broadcast

PERCENT = 80
RATIO, SMALL, TOGETHER = 1.4, 64, 2048  # sizes of a band; vertices of a key that is not hot; of a hot one that are compared in one task
COMMON, SHARED, PAIR = 0.1, 0.05, 0.01  # assumed: shares of a document's shingles, and of documents, in one common passage; cost of a comparison in rows


# ---- schemes -----------------------------------------------------------------

def bands(largest: int) -> list[int]:
    """First sizes of the bands, up to one beyond ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * RATIO)))
    return out


def scheme(first: int, after: int, documents: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """Of the band [first, after): segments of weight 1 and of weight 2, slack
    for empty segments, slack for hot keys."""
    top = after - 1
    differ = most_different(top, top * 100 // percent, percent)
    empty, hot = differ // 16, differ // 5 + (differ >= 4)
    need, best = differ + 1 + empty + hot, None
    for twos in range(0, -(-need // 2) + 1, max(1, need // 64)):
        ones = max(0, need - 2 * twos)
        size = first / (ones + twos)
        none = SHARED * math.exp(-size * (1 - COMMON))
        few = none * (1 + size * (1 - COMMON))
        cost = (documents * (ones + twos * (size + 1))
                + PAIR * (ones * (documents * none) ** 2 + twos * (documents * few) ** 2) / 2)
        if best is None or cost < best[0]:
            best = (cost, ones, twos)
    return best[1], best[2], empty, hot


def document_keys(values: np.ndarray, edges: list[int], schemes: list[tuple[int, int, int, int]], percent: int = PERCENT) -> np.ndarray:
    """A set's keys in the schemes of its own band and of those below that its
    partners can lie in.  The top byte is the scheme and the weight."""
    n, out = len(values), []
    own = bisect_right(edges, n) - 1
    for k in range(own, -1, -1):
        if 100 * (edges[k + 1] - 1) < percent * n:
            break
        ones, twos, empty, _ = schemes[k]
        total = ones + twos
        spread = mix(values + np.uint64((k + 1) * int(P) % (1 << 64)))
        segment = ((spread >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(segment, minlength=total)
        order = np.argsort(segment.astype(np.uint16) if total < 1 << 16 else segment, kind="stable")
        sums, full = np.zeros(total, np.uint64), count > 0
        sums[full] = np.add.reduceat(spread[order], (np.cumsum(count) - count)[full])
        weight = np.where(np.arange(total) < ones, 1, 2)
        bare = count < weight  # here a key is that of the empty set
        write_bare = int(weight[bare].sum()) > empty
        salt = (np.arange(total, dtype=np.uint64) + np.uint64(1)) * Q + np.uint64(k * int(R) % (1 << 64))
        chosen = np.flatnonzero((count > 0) | write_bare)
        keys, weights = [sums[chosen] + salt[chosen]], [weight[chosen]]
        if twos:
            deleted = np.flatnonzero((segment >= ones) & ((count[segment] > 1) | write_bare))
            at = segment[deleted]
            keys.append(sums[at] - spread[deleted] + salt[at])
            weights.append(np.full(len(at), 2))
        code = (np.uint64(2 * k) + np.concatenate(weights).astype(np.uint64) - np.uint64(1)) << np.uint64(56)
        out.append(distinct(mix(np.concatenate(keys)) >> np.uint64(8) | code))
    return np.concatenate(out)


# ---- tasks -------------------------------------------------------------------

SETS = "row long, doc_id long, digest binary, n_shingles long, coarse binary, bits binary, words binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts = folded_words(text.as_py())
            if parts:
                values, words = hashed(parts), b" ".join(parts)
                bits = bitmap(values)
                rows.append((row, doc_id, xxhash.xxh3_128_digest(words), len(values), coarse(bits), bits, words))
            else:
                rows.append((row, doc_id, None, 0, None, None, None))
            row += 1
        columns = zip(*rows) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SETS.split(", ")])


def _keys(edges: list[int], schemes: list[tuple[int, int, int, int]], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows, held = [], [], 0
            for row, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                own.append(document_keys(hashed(words.as_py().split(b" ")), edges, schemes, percent))
                rows.append(np.full(len(own[-1]), row))
                held += len(own[-1])
                if held > 1 << 18:
                    yield _two(own, rows)
                    own, rows, held = [], [], 0
            if own:
                yield _two(own, rows)
    return run


def _two(keys: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rows))], ["key", "row"])


NODES = "key long, rows array<long>"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the vertices of every key that has two or more, in
    arrays of at most SMALL.  ``key`` is given where a key has more than that;
    each of its arrays begins with its first row."""
    keys, rows, big = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last key, and whether arrays of it are given

    def arrays(found, values, name):
        names = pa.array([name] * len(found), pa.int64())
        return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *found]), pa.int32()), pa.array(values))], ["key", "rows"])

    def cut(key, first, run):
        """Arrays of a large key's rows, each behind the key's first row."""
        run, step = run[run != first], SMALL - 1
        pieces = [np.concatenate([[first], run[at:at + step]]) for at in range(0, len(run), step)] or [np.array([first])]
        return arrays([len(x) for x in pieces], np.concatenate(pieces), key)
    head = 0
    for batch in batches:
        keys, rows = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([rows, batch.column(1).to_numpy()])
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        many = np.diff(np.append(starts, len(keys)))
        if big and len(starts) > 1:  # the rest of a key of which arrays were given
            yield cut(int(keys[0]), head, rows[:many[0]])
        plain = (many > 1) & (many <= SMALL)
        plain[0] &= not big
        plain[-1] = False
        if plain.any():
            yield arrays(many[plain], rows[np.repeat(plain, many)], None)
        for k in np.flatnonzero(many[:-1] > SMALL):
            if k or not big:
                yield cut(int(keys[starts[k]]), rows[starts[k]], rows[starts[k]:starts[k] + many[k]])
        big &= len(starts) == 1
        keys, rows = keys[starts[-1]:], rows[starts[-1]:]
        whole = (len(rows) - 1) // SMALL * SMALL  # one row at least stays
        if whole:
            head = head if big else rows[0]
            yield cut(int(keys[0]), head, rows[:whole])
            keys, rows, big = keys[whole:], rows[whole:], True
    if big:
        yield cut(int(keys[0]), head, rows)
    elif len(rows) > 1:
        yield arrays([len(rows)], rows, None)


# ---- jobs --------------------------------------------------------------------

def _mixed(nodes: DataFrame, parts: DataFrame, first_only: bool) -> DataFrame:
    """(node, row) of the nodes (node, rows) that hold more than one part: the
    first row of each part, or all."""
    rows = nodes.select("node", F.explode("rows").alias("row")).join(parts, "row", "left").withColumn("part", F.coalesce("part", "row"))
    if first_only:
        rows = rows.groupBy("node", "part").agg(F.min("row").alias("row"))
    mixed = rows.groupBy("node").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo != hi").select("node")
    return rows.select("node", "row").join(mixed, "node")


def _hot(big: DataFrame, parts: DataFrame, slack: dict[int, int]) -> DataFrame:
    """(node, rows) for the vertices of hot keys that cannot leave them: as one
    array if there are few, else all pairs of blocks."""
    rows = big.select("key", F.explode("rows").alias("row")).distinct().join(parts, "row", "left").withColumn("part", F.coalesce("part", "row"))
    hot = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo != hi").select("key")
    code = F.shiftrightunsigned("key", 56)
    members = rows.join(hot, "key").select("key", "row", F.shiftright(code, 1).cast("int").alias("scheme"), (code % 2 + 1).alias("weight"))
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in slack.items() for x in (k, v)]), F.col("scheme"))
    stay = members.groupBy("row", "scheme").agg(F.sum("weight").alias("weight")).filter(F.col("weight") > limit).select("row", "scheme")
    left = written(members.join(stay, ["row", "scheme"]).select("key", "row"), "hot")
    blocks = F.ceil(F.col("n") * 2 / TOGETHER)
    sized = left.join(left.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key").withColumn(
        "own", F.when(F.col("n") <= TOGETHER, 0).otherwise(F.pmod(F.xxhash64("row", "key"), blocks)))
    others = F.when(F.col("n") <= TOGETHER, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    copies = sized.select("key", "n", "row", "own", F.explode(others).alias("other")).filter("n <= %d or own != other" % TOGETHER)
    return (copies.groupBy("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
            .agg(F.collect_list("row").alias("rows")).select("rows"))  # about TOGETHER rows, whatever the key's size


def linked(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The written sets of ``docs`` (doc_id, text), and (digest, row, id, part):
    each distinct text's vertex and component."""
    sets = written(in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _sets, SETS), "sets", compression="zstd")
    own = sets.filter("digest is not null").select("digest", "row", "doc_id", "n_shingles")
    vertices = written(own.groupBy("digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles")), "vertices")
    largest = vertices.agg(F.max("n_shingles")).first()[0] or 0
    edges = bands(largest)
    starts = F.array(*[F.lit(x) for x in edges])
    band = F.size(F.filter(starts, lambda x: x <= F.col("n_shingles"))) - 1
    many = {r["band"]: r["n"] for r in vertices.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}  # a row a band
    schemes = [scheme(edges[k], edges[k + 1], many.get(k, 0) + many.get(k + 1, 0), percent) for k in range(len(edges) - 1)]
    copies = written(own.join(vertices.select("digest", F.col("row").alias("first")), "digest").filter("row != first").select("row"), "copies")
    alone = (sets.filter("digest is not null").select("row", "words", "coarse", "n_shingles")
             .join(bounded_broadcast(copies), "row", "left_anti"))  # the other rows are the vertices, which are more
    keys = in_batches(alone.select("row", "words"), _keys(edges, schemes, percent), "key long, row long")
    keys = keys.repartition("key").sortWithinPartitions("key", "row")
    with wide_batches(docs.sparkSession):
        nodes = written(keys.mapInArrow(_nodes, NODES), "nodes")

    # equal arrays come from many keys: one of them is enough, but for hot keys
    small = written(nodes.filter("key is null").select("rows").distinct(), "small")
    every = small.union(nodes.filter("key is not null").select("rows"))
    others = F.explode(F.slice("rows", 2, SMALL))
    stars = every.select(F.element_at("rows", 1).alias("a"), others.alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    none = docs.sparkSession.range(0).select(F.col("id").alias("row"), F.col("id").alias("part"))
    parts = merged(none, confirmed(stars, sets, percent))

    wide = small.filter(F.size("rows") > 2)
    big = nodes.filter("key is not null")
    if not big.isEmpty():
        wide = wide.union(_hot(big, parts, {k: s[3] for k, s in enumerate(schemes)}))
    wide = written(wide.withColumn("node", F.monotonically_increasing_id()), "wide")
    for first_only in (True, False):
        own = alone.select("row", "n_shingles", F.col("coarse").alias("map")).join(parts, "row", "left").withColumn("part", F.coalesce("part", "row"))
        more = compared(_mixed(wide, parts, first_only), own, percent, only_closest=False)
        parts = merged(parts, confirmed(more, sets, percent))
    return sets, vertices.join(parts, "row", "left").withColumn("part", F.coalesce("part", "row"))


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, linked at ``percent``."""
    with light_batches(docs.sparkSession):
        sets, vertices = linked(docs, percent)
    named = written(vertices.join(vertices.groupBy("part").agg(F.min("id").alias("component_id")), "part").select("digest", "component_id"), "named")
    narrow = sets.select("doc_id", "n_shingles", "digest")
    grouped = narrow.filter("digest is not null").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    return grouped.unionByName(narrow.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
