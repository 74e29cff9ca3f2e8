"""Language identification by mixture inference.

Each language has a distribution over hashed character n-grams (orders 1 to
``MAX_ORDER``).  A document is a mixture of languages; expectation-maximisation
estimates the proportions from the n-gram likelihoods.  Languages are ranked by
their share in the mixture of all; the sets of the first 1, 2, ... of them are
fitted in turn and the one with the best penalised likelihood is selected.
The document's language is the one with the largest share.

Training uses at most about ``sample`` whole documents of each language, chosen
by a hash of the id; the counts are summed by Spark and the model (languages x
``BUCKETS`` floats) is broadcast.  Prediction reads only the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and no languages; equal shares go to the language that sorts first; rows are
predicted one by one, so repeated rows and null ids need no care; a training
table without labelled rows makes every document ``und``; an empty table to
predict gives none; a very long text is taken in blocks; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import held_out, in_batches

BUCKETS, MAX_ORDER = 1 << 15, 4
SAMPLE = 1000          # documents of a language that training may use
STEPS, PENALTY, TOKENS = 12, 0.5, 8  # EM steps; weight of log n for each language; n-grams that count as one observation
UNDETERMINED = "und"

BLOCK = 1 << 18  # code points taken at a time

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
_OTHER = re.compile(r"[\W\d_]+")


def _hashed(points: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the n-grams that begin at the first ``starts`` points."""
    found, mixed = [], np.zeros(len(points), np.uint64)
    for order in range(MAX_ORDER):
        mixed = mixed[:len(points) - order] * _MIX + points[order:] + np.uint64(1)
        found.append(((mixed[:starts] * _MIX) >> _SHIFT).astype(np.int64))
    return np.concatenate(found)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed n-grams of the lower-cased text, with
    each run of other characters than letters taken as one space.  Long texts
    are taken in overlapping blocks, so that memory stays bounded."""
    points = np.frombuffer((" " + _OTHER.sub(" ", text.lower()) + " ").encode("utf-32-le"), np.uint32)
    if len(points) <= BLOCK:
        return np.unique(_hashed(points.astype(np.uint64), BLOCK), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(points), BLOCK):
        block = points[at:at + BLOCK + MAX_ORDER - 1].astype(np.uint64)
        total += np.bincount(_hashed(block, BLOCK), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def _sum_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            at, n = grams(text.as_py() or "")
            totals.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(counts[at])], ["lang", "bucket", "n"])


class Model:
    """Languages, sorted, and the log probability of each bucket in each."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smoothed = counts + 0.5
        self.prob = (smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32) if langs else counts

    def mixture(self, text: str) -> list[tuple[str, float]]:
        """The selected languages with their shares, largest first."""
        if not self.langs or not any(map(str.isalpha, text)):
            return []
        at, n = grams(text)
        weights, prob = n / TOKENS, self.prob[:, at].astype(np.float64)
        total = weights.sum()

        def fit(rows: np.ndarray) -> tuple[np.ndarray, float]:
            own, shares = prob[rows], np.full(len(rows), 1 / len(rows))
            for _ in range(STEPS if len(rows) > 1 else 0):
                shares = shares * (own @ (weights / (shares @ own))) / total
            return shares, float(weights @ np.log(shares @ own))

        ranked = np.argsort(-fit(np.arange(len(self.langs)))[0], kind="stable")
        best, best_value = None, -np.inf
        for k in range(1, len(ranked) + 1):
            shares, value = fit(ranked[:k])
            value -= PENALTY * (k - 1) * np.log(max(total, 2.0)) * 2
            if value <= best_value:
                break
            best, best_value = (ranked[:k], shares), value
        pairs = [(self.langs[i], float(s)) for i, s in zip(*best)]
        return sorted(pairs, key=lambda x: (-x[1], x[0]))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (doc_id, text, lang) rows that are not held out and have a
    language and a text."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"))
    # a hash of the id below the language's share keeps about ``sample`` of its rows
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("rows"))
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = {r["lang"]: r["share"] for r in sizes.select("lang", share.alias("share")).collect()}
    if not rates:
        return Model([], np.zeros((0, BUCKETS)))
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    chosen = known.filter(drawn < rate[F.col("lang")]).select("lang", "text")
    summed = (in_batches(chosen, _sum_grams, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = sorted(rates)
    counts = np.zeros((len(langs), BUCKETS))
    got = summed.toPandas()  # at most languages x BUCKETS rows
    index = {lang: i for i, lang in enumerate(langs)}
    counts[got["lang"].map(index).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy()
    return Model(langs, counts)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without documents that are ``und`` or in which
    no language has a share of ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.mixture(t.as_py() or "") for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array([bool(x) and x[0][1] >= least for x in found], pa.bool_()))

    return in_batches(docs, run, docs.schema)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages map<string,double>"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its share), languages (all selected)
    of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.mixture(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1),
                 pa.array([x[0][0] if x else UNDETERMINED for x in found], pa.string()),
                 pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()),
                 pa.array(found, pa.map_(pa.string(), pa.float64()))], [x.split()[0] for x in SCHEMA.split(", ")])

    return in_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, SCHEMA)
