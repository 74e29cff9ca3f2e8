"""Benchmark decontamination: MinHash containment search, partitioned by size.

A text's set holds its distinct shingles of ``SHINGLE`` lower-cased words (runs
of letters and digits); a text with fewer words is one shingle, the whole.  An
item is found in a document whose set holds at least ``threshold`` of the
item's set.

Documents are much longer than items, so their sketches would lose nearly all
of an item's values.  The items are sketched instead, by bottom-k MinHash.
Items are partitioned by the power of two below their size n, and all of a
partition have one k: a set that holds ``threshold`` of an item misses n -
ceil(threshold n) values at most, so with k one more than the most that an item
of the partition can miss, it holds k - (n - ceil(threshold n)) of the k sketched
values at least, and always one.  So many hits make a candidate, and the search
loses nothing.  A partition's smallest n also gives the size below which a document
can hold none of its items.  Documents meet the sketches by an equi-join on hash
values; candidates are confirmed on the shingles themselves.

DataFrame expressions only.  The sketches (a quarter of the items' shingles)
are written and broadcast while they are small; beyond that the join shuffles.

Defined cases: null and empty texts have no shingles, and neither contain nor
are contained; repeated rows of a document or item give one row; of several
texts under one pair of ids the fullest match counts; null ids are compared
like other values; empty tables give none; a very long document is one row whose
words and hashes are arrays of one task; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import written
from quorum.operators.joins import bounded_broadcast

SHINGLE, THRESHOLD = 5, 0.75


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _hashes(words: Column) -> Column:
    """Hash values of a text's shingles, one for each place."""
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    shingled = F.transform(places, lambda i: F.xxhash64(*[words[i + k] for k in range(SHINGLE)]))
    return (F.when(F.size(words) >= SHINGLE, shingled)
            .when(F.size(words) > 0, F.array(F.xxhash64(F.lit("whole"), F.array_join(words, " ")))))


def _strings(words: Column) -> Column:
    """The distinct shingles as texts, blanks around every word."""
    places = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    shingled = F.transform(places, lambda i: F.concat(F.lit(" "), F.array_join(F.slice(words, i, SHINGLE), " "), F.lit(" ")))
    return F.array_distinct(F.when(F.size(words) >= SHINGLE, shingled)
                            .otherwise(F.array(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))))


def _items(items: DataFrame, threshold: float) -> DataFrame:
    """item_id, shingles, n, needed, size_class of the distinct items."""
    words = (items.select("item_id", _words(F.col("text")).alias("words")).filter(F.size("words") > 0)
             .select("item_id", _strings(F.col("words")).alias("shingles"), _hashes(F.col("words")).alias("hashes"),
                     (F.size("words") < SHINGLE).alias("whole"))
             .dropDuplicates(["item_id", "shingles"]))
    n = F.size("shingles")
    return words.select("item_id", "shingles", "hashes", "whole", n.alias("n"),
                        F.ceil(n * threshold - 1e-9).cast("int").alias("needed"),
                        F.floor(F.log2(n) + 1e-9).cast("int").alias("size_class"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, item_id, n_shared, n_item for each item of ``items``
    (item_id, text) found in a document of ``docs`` (doc_id, text); text_key
    is xxhash64(text)."""
    items = written(_items(items, threshold), "items")
    # the partition's k smallest distinct values, how many of them a match has, and its documents' least size
    k = (F.floor((F.pow(F.lit(2.0), F.col("size_class") + 1) - 1) * (1 - threshold) + 1e-9) + 1).cast("int")
    least_hits = k - (F.col("n") - F.col("needed"))
    smallest = F.ceil(F.pow(F.lit(2.0), "size_class") * threshold - 1e-9)
    sketches = written(items.select(
        F.explode_outer(F.slice(F.array_sort(F.array_distinct("hashes")), F.lit(1), k)).alias("hash"),
        "item_id", F.xxhash64("shingles").alias("item_key"), smallest.alias("least"), least_hits.alias("least_hits")), "sketches")

    hashed = (docs.select("doc_id", F.xxhash64("text").alias("text_key"), _words(F.col("text")).alias("words"))
              .select("doc_id", "text_key", F.size("words").alias("places"), _hashes(F.col("words")).alias("hashes")))
    # explode_outer: explode adds a filter on the array's size, which would compute the array twice
    candidates = (hashed.select("doc_id", "text_key", F.explode_outer("hashes").alias("hash"),
                                F.greatest(F.col("places") - SHINGLE + 1, F.lit(1)).alias("places"))
                  .join(bounded_broadcast(sketches), "hash").filter(F.col("places") >= F.col("least"))
                  .groupBy("doc_id", "text_key", "item_id", "item_key").agg(F.count("*").alias("hits"), F.first("least_hits").alias("least_hits"))
                  .filter("hits >= least_hits").drop("hits", "least_hits")  # a shingle that comes twice counts twice, which loses nothing
                  .withColumnRenamed("doc_id", "c_doc").withColumnRenamed("text_key", "c_key"))
    # written, so that its size is known: while candidates are few, texts need no shuffle
    candidates = bounded_broadcast(written(candidates, "candidates"))

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    pairs = texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("text_key") == F.col("c_key")))
    normal = pairs.select("doc_id", "text_key", "item_id", "item_key",
                          F.concat(F.lit(" "), F.array_join(_words(F.col("text")), " "), F.lit(" ")).alias("normal"))
    full = items.select(F.col("item_id").alias("i_id"), F.xxhash64("shingles").alias("i_key"), "shingles", "whole",
                        "n", "needed")
    both = normal.join(bounded_broadcast(full), F.col("item_id").eqNullSafe(F.col("i_id"))
                       & (F.col("item_key") == F.col("i_key")))
    shared = F.when(F.col("whole"), (F.col("normal") == F.col("shingles")[0]).cast("int")).otherwise(
        F.size(F.filter("shingles", lambda s: F.contains(F.col("normal"), s))))
    return (both.select("doc_id", "text_key", "item_id", shared.alias("n_shared"), F.col("n").alias("n_item"), "needed")
            .filter(F.col("n_shared") >= F.col("needed")).drop("needed"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: one row per pair of ids, of its
    fullest match."""
    best = F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item"))
    return (contained_items(docs, items, threshold).groupBy("doc_id", "item_id").agg(best.alias("b"))
            .select("doc_id", "item_id", F.col("b.n_shared").cast("long").alias("n_shared"),
                    F.col("b.n_item").cast("long").alias("n_item")))


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the documents that contain an item."""
    hits = (contained_items(docs, items, threshold)
            .select(F.col("doc_id").alias("__leak_id"), F.col("text_key").alias("__leak_key")).distinct())
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (F.xxhash64("text") == F.col("__leak_key")),
                     "left_anti")
