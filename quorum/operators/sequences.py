"""Token sequences: global order, length batches, packing, padding, labels
(W2–W4, W7, W10, F8, F21, F22, X6).

Global-order operators never use a one-partition window over the data, but the
prefix scan of ``operators.positions``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum.functions import rng
from quorum.operators.positions import scan

IGNORE_INDEX = -100


def global_row_index(df: DataFrame, order_cols: Sequence[str], partition_cols: Sequence[str] = (),
                     name: str = "row_idx") -> DataFrame:
    """Dense 0-based index by ``order_cols`` (within ``partition_cols``);
    rows with equal keys in the order of the input."""
    return scan(df, order_cols, partition_cols, name).rows


def counted_row_index(df: DataFrame, order_cols: Sequence[str], partition_cols: Sequence[str] = (),
                      name: str = "row_idx") -> tuple[DataFrame, int]:
    """W7 with the number of rows, which the blocks know already."""
    found = scan(df, order_cols, partition_cols, name)
    return found.rows, found.count


def global_prefix(df: DataFrame, value: str, order_cols: Sequence[str], partition_cols: Sequence[str] = (),
                  name: str = "offset", how: str = "sum") -> DataFrame:
    """Exclusive running ``sum`` or ``min`` of ``value`` in ``order_cols``
    order within ``partition_cols``; a run that holds much of the table is cut
    into several blocks."""
    return scan(df, order_cols, partition_cols, name, value, how).rows


def length_batches(df: DataFrame, length: str, key: str, batch_size: int, drop_last: bool = True,
                   shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Stable sort by (length, key), cut into batches of ``batch_size``
    (last partial batch dropped when ``drop_last``), batch order shuffled by
    md5(seed:batch).  Adds ``rank``, ``batch``, ``batch_pos``."""
    r, total = counted_row_index(df, [length, key], name="rank")
    r = r.withColumn("batch", F.floor(F.col("rank") / batch_size).cast("bigint"))
    n_batches = total // batch_size if drop_last else -(-total // batch_size)
    r = r.where(F.col("rank") < n_batches * batch_size)
    if not shuffle:
        return r.withColumn("batch_pos", F.col("batch"))
    batches = df.sparkSession.range(n_batches).withColumnRenamed("id", "batch")  # the input is not read again for them
    order = batches.withColumn("_h", rng.hash_order(seed, F.col("batch")))
    return r.join(global_row_index(order, ["_h", "batch"], name="batch_pos").drop("_h"), "batch")


def batch_stripes(batched: DataFrame, num_replicas: int, n_batches: int | None = None) -> DataFrame:
    """Replica r takes batch positions r, r+n, … below floor(B/n)*n.
    ``n_batches`` saves the pass over ``batched`` that finds it."""
    nb = (batched.agg(F.max("batch_pos")).first()[0] or 0) + 1 if n_batches is None else n_batches
    return (batched.where(F.col("batch_pos") < (nb // num_replicas) * num_replicas)
                   .withColumn("replica", F.pmod(F.col("batch_pos"), F.lit(num_replicas)).cast("int")))


def pack_sequences(df: DataFrame, tokens: str, order_cols: Sequence[str], chunk_size: int,
                   made: Column | None = None) -> DataFrame:
    """Concatenate token arrays in row order and cut chunks of
    ``chunk_size``; the tail (≤ chunk_size tokens) is dropped, so there are
    ceil(T/C) - 1 chunks.  Each row ships only the slices that fall in
    each chunk (no per-token shuffle); a chunk is bounded by C tokens.

    ``made`` makes the tokens from the columns of ``df``; it runs in the ordered
    blocks, once, where ``df`` with its tokens is also run for the ranges."""
    source = df if made is not None else df.select(*order_cols, tokens)
    derived = ({tokens: made} if made is not None else {}) | {"_len": F.size(tokens)}
    r, _, total = scan(source, order_cols, (), "_start", "_len", derived=derived, drop=[c for c in df.columns if c != tokens])
    total = total or 0
    C = chunk_size
    r = r.withColumn("_T", F.lit(total)).where(F.col("_len") > 0)
    first = F.floor(F.col("_start") / C)
    last = F.floor((F.col("_start") + F.col("_len") - 1) / C)
    pieces = r.select(
        "_start", "_len", "_T", tokens,
        F.explode(F.sequence(first, last)).alias("chunk"))
    lo = F.greatest(F.col("chunk") * C, F.col("_start"))
    hi = F.least((F.col("chunk") + 1) * C, F.col("_start") + F.col("_len"))
    pieces = (pieces.where((F.col("chunk") + 1) * C < F.col("_T"))  # the tail is never emitted
                    .select("chunk", lo.alias("_lo"),
                            F.slice(tokens, (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int"))
                             .alias("_piece")))
    return (pieces.groupBy("chunk")
                  .agg(F.sort_array(F.collect_list(F.struct("_lo", "_piece"))).alias("_p"))
                  .select(F.col("chunk").cast("bigint").alias("chunk"),
                          F.flatten(F.transform("_p", lambda x: x["_piece"])).alias(tokens)))


def left_pad(batched: DataFrame, ids: str, target: str, pad_id: int = 0) -> DataFrame:
    """Left-pad every sequence to the longest of its batch; mask 0/1;
    target position shifted by the pad length.  A batch is ``batch_size``
    rows, so the window partition is bounded."""
    w = Window.partitionBy("batch")
    pad = F.max(F.size(ids)).over(w) - F.size(ids)
    return (batched.withColumn("pad_len", pad.cast("int"))
                   .withColumn("input_ids", F.concat(F.array_repeat(F.lit(pad_id).cast("bigint"), F.col("pad_len")), F.col(ids)))
                   .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(0), F.col("pad_len")),
                                                          F.array_repeat(F.lit(1), F.size(ids))))
                   .withColumn("target_token_position", F.col(target) + F.col("pad_len")))


def whitespace_ids(text: Column | str) -> Column:
    """X6 default tokeniser: whitespace split, empty pieces dropped, token id
    = the first 60 bits of md5(token), so that tokens do not share ids."""
    t = F.col(text) if isinstance(text, str) else text
    toks = F.array_remove(F.split(t, r"\s+"), "")
    return F.transform(toks, lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("bigint"))


def token_ids(text: Column | str, tokenizer: Callable[[Column | str], Column] | None = None,
              bos: int | None = None, eos: int | None = None) -> Column:
    """Ids of a text by ``tokenizer`` (a function from a column to an
    array of ids: column expressions or a pandas UDF), with optional first and
    last ids."""
    ids = (tokenizer or whitespace_ids)(text)
    ends = [F.array(F.lit(x).cast("bigint")) if x is not None else None for x in (bos, eos)]
    parts = [p for p in (ends[0], ids, ends[1]) if p is not None]
    return F.concat(*parts) if len(parts) > 1 else ids


def sql_token_ids(expr: str) -> str:
    """DuckDB form of the default ``token_ids``."""
    return (f"list_transform(list_filter(string_split_regex({expr}, '\\s+'), lambda x: x <> ''), "
            "lambda x: cast(('0x' || substr(md5(x), 1, 15)) as bigint))")


def target_record(prompt: Column | str, dist: str, ordinal: str,
                  tokenizer: Callable[[Column | str], Column] | None = None, bos: int | None = None,
                  eos: int | None = None) -> list[Column]:
    """input_ids, attention_mask, target_token_position, padded
    response_distribution and ordinal_info."""
    from quorum.functions.metrics import pad_target
    ids = token_ids(prompt, tokenizer, bos, eos)
    d, o = pad_target(dist, ordinal)
    return [ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
            F.size(ids).cast("bigint").alias("target_token_position"), d.alias("response_distribution"),
            o.alias("ordinal_info")]


def label_mask(prompt_ids: Column, answer_ids: Column) -> tuple[Column, Column, Column]:
    """input = prompt + answer, labels = [-100]*len(prompt) + answer,
    mask of ones.  Returns (input_ids, labels, attention_mask)."""
    ids = F.concat(prompt_ids, answer_ids)
    labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX).cast("bigint"), F.size(prompt_ids)), answer_ids)
    return ids, labels, F.array_repeat(F.lit(1), F.size(ids))
