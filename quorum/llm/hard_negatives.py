"""Hard negatives by Fagin's threshold algorithm.

Every component x becomes floor(256 x), so that a score (the inner product of a
row with an anchor) is an integer and exact.  An anchor's positives are the best
rows of its label; for each positive the best rows of other labels are wanted
whose scores lie in a window below the positive's.

1. Rows are dealt by hash into blocks of at most BLOCK rows (fewer if vectors
   are long), anchors into chunks of at most CHUNK; a pair of a block and a chunk
   is one group of a cogroup, so that no label, id or vector can be a hot key, and
   neither side is broadcast or passes through the driver.
2. In a block each dimension has a list of its rows sorted by component.  For an
   anchor the lists are read in step, from the top where its component is positive and
   from the bottom where it is negative, DEPTH rows at first and twice as many with
   each further round.  Rows met for the first time are fetched and scored.  No row not
   met yet can score more than the threshold, the score of the components last read.
   Reading ends when the threshold is strictly below the kth best score of each
   window (or its lower end, while it holds fewer than k), or no row is left.
3. The blocks' best rows, at most k of each window from each block, are merged.

Defined cases: rows with a null label, a null vector, a null or non-finite
component, or a component of 2^20 or more in size (scores must fit 64 bits, which they do
for 128 such components) take no part; rows equal in id, label and vector are one row; different rows with one id are
rows of their own, tied by a hash of the row after the id; a null id sorts after the others and
is no anchor; shorter vectors are filled with zeros, and an empty one scores 0.
Anchors without positives, and windows without rows (all below a negative positive
score), have no row.  An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorum.llm.common import written

SCALE, EVERY, MOVED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in per cent of the positive's
BLOCK, CHUNK, NUMBERS, DEPTH = 8192, 2048, 1 << 22, 64
LARGEST = 1 << 28

ANCHOR = "anchor_id long, anchor_tie long"
FOUND = f"{ANCHOR}, nth int, id long, tie long, score long"


def prepared(vectors: DataFrame) -> DataFrame:
    """id, label, q, tie of the rows that take part."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(SCALE * x.cast("double")) < LARGEST))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")
            .filter("label is not null and embedding is not null").filter(fits)
            .select("id", F.when(F.col("id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"),
                    F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("int")).alias("q")))
    return rows.dropDuplicates(["id", "label", "q"]).withColumn("tie", F.xxhash64("id", "label", "q"))


class Lists:
    """A block's rows, and for each dimension its list, sorted by component."""

    def __init__(self, rows: pa.Table, width: int):
        self.valid = rows["id"].is_valid().to_numpy()
        self.ids = rows["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        self.ties, self.labels = rows["tie"].to_numpy(), rows["label"].to_numpy()
        self.q = matrix(rows["q"], width)
        self.largest = int(np.abs(self.q).max(initial=0))
        self.order = np.argsort(-self.q, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(self.q.T, self.order, axis=1)
        self.by_kind = {}

    def vectors(self, largest: int) -> np.ndarray:
        """The vectors in the cheapest type that keeps scores exact."""
        bound = self.largest * largest * max(1, self.q.shape[1])
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        if kind not in self.by_kind:
            self.by_kind[kind] = self.q.astype(kind)
        return self.by_kind[kind]

    def best(self, a: np.ndarray, wanted: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each window (scores within [low, high]) the first k rows among
        ``wanted`` by score, id and tie: their places and scores."""
        n, used = len(self.ids), np.flatnonzero(a)
        q, down = self.vectors(int(np.abs(a).max(initial=0))), a[used] > 0
        weights, falling, rising = a.astype(q.dtype), used[down], used[~down]
        met, rows, scores, at, to = np.zeros(n, bool), [], [], 0, min(n, DEPTH if len(used) else n)
        while True:
            now = np.zeros(n, bool)
            now[self.order[falling, at:to]] = True
            now[self.order[rising, n - to:n - at]] = True
            if to == n:
                now[:] = True  # every list is read
            new = np.flatnonzero(now & ~met)
            met[new] = True
            rows.append(new)
            scores.append((q[new] @ weights).astype(np.int64))
            row, score = np.concatenate(rows), np.concatenate(scores)
            kept = wanted[row]
            row, score = row[kept], score[kept]
            threshold = int(self.values[falling, to - 1] @ a[falling] + self.values[rising, n - to] @ a[rising]) if n else 0
            out, done = [], to >= n or bool(met.all())
            enough = True
            for low, high in windows:
                inside = (score >= low) & (score <= high)
                r, s = row[inside], score[inside]
                if len(r) >= k:
                    least = int(np.partition(s, len(s) - k)[len(s) - k])
                    enough &= threshold < least
                    r, s = r[s >= least], s[s >= least]
                else:
                    enough &= threshold < low
                out.append((r, s))
            if done or enough:
                break
            at, to = to, min(n, 2 * to)
        final = []
        for r, s in out:
            order = np.lexsort((self.ties[r], self.ids[r], ~self.valid[r], -s))[:k]
            final.append((r[order], s[order]))
        return final


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    values = column.flatten().to_numpy()
    if len(values) == out.size:
        return values.astype(np.int64).reshape(out.shape)
    out[np.arange(width) < lengths[:, None]] = values
    return out


ALL = [(np.iinfo(np.int64).min, np.iinfo(np.int64).max)]


def window(positive: int) -> tuple[int, int]:
    """The scores s with LOW positive <= 100 s <= HIGH positive."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def _search(width: int, same_label: bool, k: int):
    """The best rows of a block for each anchor of a chunk: (anchor, window)."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        columns = [[] for _ in FOUND.split(", ")]
        if rows.num_rows and anchors.num_rows:
            block, vectors = Lists(rows, width), matrix(anchors["q"], width)
            ids, ties, labels = (anchors[c].to_pylist() for c in ("id", "tie", "label"))
            windows = anchors["windows"].to_pylist()
            for n, a in enumerate(vectors):
                if same_label:
                    wanted, ranges = (block.labels == labels[n]) & (block.ties != ties[n]), ALL
                else:
                    wanted, ranges = block.labels != labels[n], [window(p) for p in windows[n]]
                if not wanted.any():
                    continue
                for nth, (r, s) in enumerate(block.best(a, wanted, ranges, k)):
                    many = len(r)
                    own = [pa.array(block.ids[r], pa.int64(), mask=~block.valid[r]), pa.array(block.ties[r]), pa.array(s, pa.int64())]
                    for c, x in zip(columns, [pa.array([v] * many, t) for v, t in (
                            (ids[n], pa.int64()), (ties[n], pa.int64()), (nth, pa.int32()))] + own):
                        c.append(x)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.chunked_array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in FOUND.split(", ")])
    return run


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, width: int, same_label: bool, k: int) -> DataFrame:
    """Every chunk of anchors with every block of rows, and the best k of each
    window over all blocks, ranked."""
    def copies(df, own, n, other, m):
        return df.withColumn(own, F.pmod(F.xxhash64("tie", F.lit(1)), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = copies(rows.select("id", "tie", "label", "q"), "block", blocks, "chunk", chunks)
    right = copies(anchors.select("id", "tie", "label", "q", "windows"), "chunk", chunks, "block", blocks)
    keys = ["block", "chunk"]
    left, right = (x.withColumn("block", F.col("block").cast("int")).withColumn("chunk", F.col("chunk").cast("int")) for x in (left, right))
    parts = min(2 * blocks * chunks, 10_000)  # a number of our own: merged by their bytes, few groups would make one task
    left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_search(width, same_label, k), FOUND)
    order = W.partitionBy("anchor_id", "anchor_tie", "nth").orderBy(F.desc("score"), F.asc_nulls_last("id"), "tie")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    of ``vectors`` (vec_id, embedding, label)."""
    rows = written(prepared(vectors), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width"), F.count_if(F.col("id") % EVERY == 0).alias("anchors")).first()
    width = size["width"] or 0
    blocks = max(1, -(-size["n"] // max(64, min(BLOCK, NUMBERS // max(1, width)))))
    chunks = max(1, -(-size["anchors"] // CHUNK))
    anchors = rows.filter(F.col("id") % EVERY == 0)
    nothing = F.array().cast("array<long>").alias("windows")
    positives = written(_met(rows, anchors.select("*", nothing), blocks, chunks, width, True, POSITIVES).select(
        "anchor_id", "anchor_tie", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # a window for each different score: positives that tie have the same negatives
    scores = positives.filter("positive_score >= 0").groupBy("anchor_id", "anchor_tie").agg(
        F.array_sort(F.collect_set("positive_score")).alias("windows"))  # at most POSITIVES
    windowed = written(anchors.join(scores, (anchors.id == scores.anchor_id) & (anchors.tie == scores.anchor_tie))
                       .select("id", "tie", "label", "q", "windows"), "windows")
    negatives = _met(rows, windowed, blocks, chunks, width, False, NEGATIVES).select(
        "anchor_id", "anchor_tie", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    place = (F.array_position("windows", F.col("positive_score")) - 1).cast("int")
    numbered = positives.drop("rank").join(scores, ["anchor_id", "anchor_tie"]).filter("positive_score >= 0").withColumn("nth", place).drop("windows")
    return numbered.join(negatives, ["anchor_id", "anchor_tie", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
