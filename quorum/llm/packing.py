"""Packing: shortest-pack-first over the histogram of piece lengths.

1. Every text is tokenised once, in Arrow batches.  A document longer than a
   sequence is cut into whole sequences and a rest; each piece is written to
   the shared folder with the partition that made it and its running number
   among that partition's pieces of equal length.
2. Counts by (partition, length) give each partition its first rank of each
   length, so that no length is ever gathered in one task.
3. The histogram of lengths (at most ``seq_len`` numbers) is packed: lengths
   from longest to shortest, each into the pattern with most space left, whole
   pattern counts at a time.
4. Ranks are joined back: rank r of a length falls into one slot, an interval
   of ranks of that length in one pattern; the slot gives sequence and offset.

The histogram is all that reaches the driver; the slots go to the tasks.  Both
are bounded by the sequence length, whatever the number of documents.

Defined cases: a null text is empty, and an empty text has the end token only,
so every row makes at least one piece; repeated rows and repeated or null ids
are packed row by row; an empty table has no pieces; other columns of the
input are ignored.  Pieces tie by length; ranks then follow the partitions.  A
text with very long white space goes through the slower reader of ``tokens``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorum.llm.common import in_batches, written
from quorum.llm.tokens import byte_ids

SEQ_LEN, END_ID = 2048, 1

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"


def _pieces(vocabulary: str, seq_len: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array([*byte_ids(vocabulary, text.as_py() or ""), END_ID], "<u4")
                for at in range(0, len(tokens), seq_len):
                    piece = tokens[at:at + seq_len]
                    rows.append((doc_id, at, len(piece), zlib.crc32(piece), len(tokens), part, seen[len(piece)]))
                    seen[len(piece)] += 1
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def shortest_pack_first(histogram: np.ndarray, seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, ranks, first sequence, offset): the ranks
    [first, first + ranks) of ``length`` lie at ``offset`` of the sequences
    [first sequence, first sequence + ranks), one each.

    ``histogram[n]`` counts the pieces of n tokens.  A pattern is kept as an
    interval of sequences with equal content, so placing a length only splits
    intervals."""
    slots, sequences = [], 0
    room: list[list[tuple[int, int]]] = [[] for _ in range(seq_len + 1)]  # by space left: (first sequence, how many)
    for length in range(seq_len, 0, -1):
        left, rank, widest = int(histogram[length]), 0, seq_len
        while left:
            while widest >= length and not room[widest]:
                widest -= 1
            if widest >= length:
                first, many = room[widest].pop()
                space = widest
            else:
                first, many, space = sequences, left, seq_len
                sequences += left
            took = min(many, left)
            if many > took:
                room[space].append((first + took, many - took))
            slots.append((length, rank, took, first, seq_len - space))
            room[space - length].append((first, took))
            rank, left = rank + took, left - took
    return slots


def _place(slots: list[tuple[int, int, int, int, int]]):
    table = np.array(slots, np.int64).reshape(-1, 5)  # sorted by decreasing length, then rank

    def run(length, rank):
        import pandas as pd
        start = np.full(1 + int(table[:, 0].max(initial=0)), -1, np.int64)
        start[table[::-1, 0]] = np.arange(len(table))[::-1]  # first slot of each length
        slot = start[length.to_numpy()]
        wanted, rank = length.to_numpy(), rank.to_numpy()
        for n in np.unique(wanted):
            mine = wanted == n
            own = table[table[:, 0] == n, 1]
            slot[mine] += np.searchsorted(own, rank[mine], side="right") - 1
        return pd.DataFrame({"sequence_id": table[slot, 3] + rank - table[slot, 1], "offset": table[slot, 4]})
    return F.pandas_udf(run, "sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; with ``with_ids`` also the token ids."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = written(in_batches(docs.select("doc_id", "text"), _pieces(vocabulary, seq_len, with_ids), schema), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    first = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("part", "length", F.coalesce(first, F.lit(0)).alias("first_rank"))
    histogram = np.zeros(seq_len + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most seq_len rows
        histogram[row["length"]] = row["n"]
    place = _place(shortest_pack_first(histogram, seq_len))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("first_rank") + F.col("nth"))
    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                         "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def pad_sequences(packed: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """sequence_id, used, padded: the length of each sequence, and what it is
    padded to (``seq_len``, but a power of two stays as it is)."""
    used = F.sum("length")
    out = packed.groupBy("sequence_id").agg(used.alias("used"))
    whole = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return out.withColumn("padded", F.when(whole, F.col("used")).otherwise(seq_len))
