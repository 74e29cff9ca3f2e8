"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct shingles of five words (lower-cased
ASCII letters, words as runs of anything but white space); with fewer words it
is the whole sequence as one, with none it is empty.  Documents whose sets have
``100 |A and B| >= PERCENT |A or B|`` are linked, and linked documents form
components.

1. One Arrow pass over the whole texts makes a digest, the set's size, a bitmap of
   its parities and ``COORDINATES`` minwise values.  Equal texts are one vertex from here on.
2. Each of ``TREES`` independent trees puts a vertex into a node by a minwise
   value.  A node matters only for pairs of different components; those of up to
   ``SMALL`` vertices are compared exhaustively in one task.  Of a larger node whose vertices
   are in one component but for SMALL at most, these are compared with the
   others, block by block.  The rest branch: a vertex goes on to
   ``BRANCHES`` children, named by its values of coordinates that the node's
   own path selects and that no node above it used.  A node whose children have
   more pairs than itself, or that is large at the last of ``DEPTH`` levels, is
   cut into blocks by a hash of the row, and all pairs of blocks are compared.
3. Links are found in rounds, and each round compares only what the ones before
   left in different components: with one vertex of each node, in a few trees; with
   ``LEADERS`` of each large node that agree most with its modes; the closest pair of every two
   components in a node; all pairs.  So a large group is never compared pair by
   pair, and a pair that many trees hold is tested once a round.
4. Pairs must agree in ``SCREEN`` of the coordinates' low bytes and pass the bitmaps,
   which never lose a link; they are confirmed on the full sets, and large-star /
   small-star rounds label the components.

Two sets at the threshold share one of the trees' first values but for a chance
of 0.25^16.  With two branches a path goes on to any depth but for 1/9, so the
trees would miss 0.33^16 = 2e-8 if the coordinates of all were independent; they
share 48, so the true figure is higher.  The screen misses about 5e-6.

Defined cases: documents without words (null, empty, white space) are linked
with nothing; equal texts are linked; rows with one doc_id and several texts
are vertices of their own that carry the same id; a null id sorts after all
others, and a component that has only null ids has a null component_id, of
which the vertex with the first row is kept; an empty table gives none; other
columns are ignored; a very long text is one row of one task, whose memory is a
few times the text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import in_batches, written
from quorum.llm.set_pairs import bitmap, compared, components, confirmed, folded_words, hashed, merged
from quorum.operators.joins import bounded_broadcast

PERCENT = 75
COORDINATES, TREES, FIRST_TREES = 64, 16, 3
SMALL, LEADERS, CLASSES, SAMPLE = 2048, 2, 8, 256
BRANCHES, DEPTH = 2, 9
SCREEN, CENTRAL = 32, 28  # equal coordinates that make a pair a candidate, or a vertex like its node's modes

_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 2**63, (COORDINATES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, (COORDINATES, 1), np.uint64)
_BLOCK = 1024


def minwise(values: np.ndarray) -> np.ndarray:
    best = np.full(COORDINATES, 2**32 - 1, np.uint64)
    for at in range(0, len(values), _BLOCK):
        x = values[at:at + _BLOCK] * _MULTIPLY
        x += _ADD
        best = np.minimum(best, x.min(axis=1) >> np.uint64(32))
    return best.astype(np.uint32).view(np.int32)


# roots: the first values of the trees; low: the low byte of every coordinate, which screens and branches
SKETCH = ("row long, doc_id long, text_key long, digest binary, n_shingles long, roots array<int>, low array<tinyint>, "
          "bits binary, words binary")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.binary(), pa.binary()]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):  # small batches: the rows grow by their sketches
            part, rows = batch.slice(at, 512), []
            for text in part.column(2):
                words = folded_words(text.as_py())
                if words:
                    values, whole = hashed(words), b" ".join(words)
                    sig = minwise(values)
                    rows.append((row, xxhash.xxh3_128_digest(whole), len(values), sig[:TREES], sig.astype(np.int8), bitmap(values), whole))
                else:
                    rows.append((row, None, 0, None, None, None, None))
                row += 1
            new = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([new[0], part.column(0).cast(pa.int64()), part.column(1), *new[1:]],
                                             [x.split()[0] for x in SKETCH.split(", ")])


def _nodes(vertices: DataFrame) -> DataFrame:
    """Of (node, row, part, ...): the rows of nodes that hold more than one
    part, with the node's size and leaders."""
    mixed = (vertices.groupBy("node").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"),
                                          F.min("row").alias("first"), F.min_by("row", F.xxhash64("row", "node")).alias("chosen"))
             .filter("lo != hi").drop("lo", "hi"))
    return vertices.join(mixed, "node")


def _to_leaders(rows: DataFrame) -> DataFrame:
    """Edges (a < b) from each vertex to one of its node: the smallest row in a
    small node (it tends to be the same one in all trees), a chosen row in a
    large one."""
    other = F.when(F.col("n") > SAMPLE, F.col("chosen")).otherwise(F.col("first"))
    return (rows.select("row", other.alias("other")).filter("row != other")
            .select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")))


def _modes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent value of every coordinate in each node's sample."""
    for batch in batches:
        out = []
        for lows in batch.column(1).to_pylist():
            values = np.array(lows, np.int8).astype(np.int64) + 128
            counts = np.zeros((COORDINATES, 256), np.int64)
            np.add.at(counts, (np.arange(COORDINATES)[None, :], values), 1)
            out.append((counts.argmax(axis=1) - 128).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int8()))], ["node", "mode"])


def _to_central(large: DataFrame) -> DataFrame:
    """Edges (a < b) from vertices of a large node to its LEADERS, unless they
    are in the same part.  The modes come from about SAMPLE vertices of the
    node; the leaders are the vertices that agree most with them, the best of
    LEADERS of CLASSES classes (others in other trees).  Vertices that hardly agree with the modes are
    not like the leaders either, and are left to the node's children."""
    sample = large.filter(F.pmod(F.xxhash64("row", "node"), F.ceil(F.col("n") / SAMPLE)) == 0)
    modes = in_batches(sample.groupBy("node").agg(F.collect_list("low").alias("lows")), _modes, "node long, mode array<tinyint>")
    central = written(large.join(modes, "node").select("node", "row", "part", _agreement("low", "mode").alias("agree"))
                      .filter(F.col("agree") >= CENTRAL), "central")
    own = (F.pmod(F.xxhash64("row"), F.lit(CLASSES)) + F.pmod("node", F.lit(CLASSES))) % CLASSES
    leaders = central.groupBy("node").agg(F.array(*[
        F.max_by(F.struct("row", "part"), F.when(own == i, F.struct("agree", "row"))) for i in range(LEADERS)]).alias("leaders"))
    others = F.filter("leaders", lambda x: x.part != F.col("part"))
    return (central.join(leaders, "node").select("row", F.explode_outer(others).alias("other")).filter("other.row is not null")
            .select(F.least("row", "other.row").alias("a"), F.greatest("row", "other.row").alias("b")))


def _agreement(a: str, b: str):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _roots(sigs: DataFrame, trees: int) -> DataFrame:
    """(node, row, part): every vertex in the first level of the trees."""
    return sigs.select("row", "part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(
        t, F.col("roots")[t]))).alias("node"))


def _against(large: DataFrame) -> DataFrame:
    """(node, row) for large nodes of one component and few others: its vertices
    in blocks of about SMALL, and the others with each block."""
    blocks = F.ceil(F.col("most") / SMALL)
    own = F.pmod(F.xxhash64("row", "node"), blocks)
    places = F.when(F.col("part") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    return large.select("node", "row", F.explode(places).alias("block")).select(F.xxhash64("node", "block").alias("node"), "row")


def _blocks(large: DataFrame) -> DataFrame:
    """(node, row): a node for every two blocks of a large node's vertices, so that each pair
    of them is in one: blocks hold about SMALL / 2, and a vertex is copied once
    for each other block."""
    blocks = F.ceil(F.col("n") * 2 / SMALL)
    own = F.pmod(F.xxhash64("row", "node"), blocks)
    copies = large.select("node", "row", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    return copies.filter("own != other").select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "row")


def _children(rows: DataFrame, level: int) -> DataFrame:
    """The nodes below ``rows``: BRANCHES for each vertex, by coordinates that
    the path selects among those of this level, so none comes twice on a path."""
    each = (COORDINATES - TREES) // (DEPTH - 1)
    ats = [(F.pmod(F.xxhash64("node") + i, F.lit(each)) + TREES + level * each).cast("int") for i in range(BRANCHES)]
    return rows.select("row", "part", "low", F.col("node").alias("above"), F.col("n").alias("n_above"),
                       F.explode(F.array(*[F.xxhash64("node", at, F.col("low")[at]) for at in ats])).alias("node"))


def _dense(children: DataFrame) -> DataFrame:
    """The large nodes whose children have more pairs than they have."""
    pairs = children.groupBy("above").agg(F.sum("n").alias("pairs"), F.first("n_above").alias("n"))
    return pairs.filter(F.col("pairs") > F.col("n") * F.col("n")).select("above")


def _paths(placed: DataFrame) -> DataFrame:
    """(node, row) of all nodes to compare, for vertices (row, part, roots, low)."""
    found = []
    members = written(_nodes(_roots(placed, TREES)).select("node", "row", "part", "n"), "members")
    for level in range(DEPTH):
        found.append(members.filter(F.col("n") <= SMALL).select("node", "row"))
        large = members.filter(F.col("n") > SMALL)
        if large.isEmpty():
            break
        sizes = large.groupBy("node", "part").agg(F.count("*").alias("most"), F.first("n").alias("n"))
        main = sizes.groupBy("node").agg(F.max(F.struct("most", "part")).alias("main"), F.first("n").alias("n"))
        main = written(main.select("node", "main.most", F.col("main.part").alias("main"), (F.col("n") - F.col("main.most") > SMALL).alias("many")), "main")
        parted = large.join(bounded_broadcast(main), "node")
        found.append(_against(parted.filter("not many")))
        many = parted.filter("many").join(placed.select("row", "low"), "row")
        if level == DEPTH - 1:
            found.append(_blocks(many))
        else:
            children = written(_nodes(_children(many, level)), "members")
            dense = bounded_broadcast(written(_dense(children), "dense"))
            found.append(_blocks(many.join(dense, F.col("node") == F.col("above"), "left_semi")))
            members = children.join(dense, "above", "left_anti").select("node", "row", "part", "n")
    return functools.reduce(DataFrame.union, found)


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written sketches of ``docs`` (doc_id, text), and (digest, row, id,
    part): each distinct text's vertex and component."""
    raw = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketches = written(in_batches(raw, _sketch, SKETCH), "sketches", compression="zstd")
    vertices = written(sketches.filter("digest is not null").groupBy("digest").agg(
        F.min("row").alias("row"), F.min("doc_id").alias("id")), "vertices")
    sigs = written(sketches.select("row", "n_shingles", "roots", "low", F.col("bits").alias("map")).join(vertices.select("row"), "row"), "sigs", compression="zstd")

    def placed(parts):
        return written(sigs.join(parts, "row", "left").withColumn("part", F.coalesce("part", "row")), "placed")
    first = _nodes(_roots(sigs.withColumn("part", F.col("row")), FIRST_TREES))
    parts = merged(docs.sparkSession.createDataFrame([], "row long, part long"), confirmed(_to_leaders(first), sketches, PERCENT))

    at = placed(parts)
    roots = _nodes(_roots(at, TREES)).filter(F.col("n") > SAMPLE)
    large = written(roots.select("node", "row", "part", "n").join(at.select("row", "low"), "row"), "large")
    if not large.isEmpty():
        parts = merged(parts, confirmed(_to_central(large), sketches, PERCENT))
    for only_closest in (True, False):
        at = placed(parts)
        pairs = compared(_paths(at), at, PERCENT, only_closest, SCREEN)
        parts = merged(parts, confirmed(pairs, sketches, PERCENT, screened=True))
    return sketches, vertices.join(parts, "row", "left").withColumn("part", F.coalesce("part", "row"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for every row."""
    sketches, vertices = linked(docs)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    named = written(vertices.join(vertices.groupBy("part").agg(first), "part").select(
        "digest", F.col("first.id").alias("component_id"), (F.col("first.row") == F.col("row")).alias("is_first")), "named")
    narrow = sketches.select("doc_id", "text_key", "digest", "n_shingles")
    grouped = narrow.filter("digest is not null").join(named, "digest").select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("is_first")).alias("kept"),
        "text_key")
    alone = narrow.filter("digest is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_key")
    return grouped.unionByName(alone)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each component; repeated
    rows (equal id and text) go too."""
    keep = written(deduplicate(docs).filter("kept").groupBy(
        F.col("doc_id").alias("__keep_id"), F.col("text_key").alias("__keep_key")).agg(F.count("*").alias("__keep_n")), "keep")
    same = F.col("doc_id").eqNullSafe(F.col("__keep_id")) & (F.xxhash64("text") == F.col("__keep_key"))
    single = docs.join(bounded_broadcast(keep.filter("__keep_n = 1")), same, "left_semi")
    repeated = keep.filter("__keep_n > 1")
    if repeated.isEmpty():
        return single
    return single.unionByName(docs.join(bounded_broadcast(repeated), same).dropDuplicates(["__keep_id", "__keep_key"])
                              .select(*docs.columns))
