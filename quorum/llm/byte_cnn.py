"""Quality classifier: a convolutional network over bytes, in numpy.

``FILTERS`` learned filters of ``WIDTH`` bytes run over the UTF-8 bytes of the
whole text.  Overlapping chunks cover it; each chunk max-pools every filter,
and the means and maxima over the chunks go through one logistic unit.  A
filter is a table of one weight per byte value and place, so a convolution is
``WIDTH`` table look-ups, and back-propagation touches only the places where a
chunk had its maximum.

Training takes at most about ``sample`` whole labelled documents of either
class, none of the held-out fold, chosen by a hash of the id among those of up to
LONGEST bytes, and fewer where they would have more than about SAMPLE_BYTES together;
classes are weighted back to their shares.  It runs on the driver, on that bounded sample.
Scoring runs in Arrow batches and reads only the text.

Defined cases: a null text is empty, and an empty text is scored as zero
bytes; several labels of one document are averaged (1 from 0.5 on), null
labels are left out; without labels, or with one class only, every score is
that class' share (0.5 without labels).  Rows that repeat in training count as often;
an empty table to score gives none; a very long text is scored in spans.  Rows
are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import held_out, in_batches
from quorum.operators.joins import bounded_broadcast

FILTERS, WIDTH = 16, 5
BLOCK, CHUNK, STRIDE = 64, 5, 4   # positions in a block; blocks in a chunk and between chunk starts
SPAN = 1 << 14                    # blocks convolved at a time
SAMPLE, UPDATES, BATCH, RATE = 1200, 1000, 16, 0.05
LONGEST, SAMPLE_BYTES = 1 << 20, 64 << 20  # of a training text, of all
THRESHOLD = 0.3


class ByteCNN:
    """Filter tables (WIDTH, 256, FILTERS), output weights, bias."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        self.constant: float | None = None

    @staticmethod
    def _bytes(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return np.concatenate((raw, np.zeros(WIDTH - 1 + (len(raw) == 0), np.uint8)))

    def _convolve(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw) - WIDTH + 1
        total = self.tables[0].take(raw[:n], axis=0)
        for k in range(1, WIDTH):
            total += self.tables[k].take(raw[k:k + n], axis=0)
        return total

    def _pooled(self, text: str) -> np.ndarray:
        """Chunk maxima (chunks, FILTERS); long texts go through in spans."""
        raw, maxima = self._bytes(text), []
        for at in range(0, len(raw) - WIDTH + 1, SPAN * BLOCK):
            total = self._convolve(raw[at:at + SPAN * BLOCK + WIDTH - 1])
            maxima.append(np.maximum.reduceat(total, np.arange(0, len(total), BLOCK), axis=0))
        blocks = np.concatenate(maxima)
        starts = np.arange(0, max(1, len(blocks) - CHUNK + STRIDE), STRIDE)
        chunks = blocks[starts]
        for k in range(1, CHUNK):
            np.maximum(chunks, blocks[np.minimum(starts + k, len(blocks) - 1)], out=chunks)
        return np.maximum(chunks, 0)

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        chunks = self._pooled(text)
        z = self.out[:FILTERS] @ chunks.mean(axis=0) + self.out[FILTERS:] @ chunks.max(axis=0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def _gradients(self, text: str, label: int, weight: float, grad: np.ndarray) -> tuple[np.ndarray, float]:
        """Add the filters' gradients to ``grad``; return those of the output."""
        raw = self._bytes(text)
        total = self._convolve(raw)
        span = CHUNK * BLOCK
        starts = range(0, max(1, len(total) - span + STRIDE * BLOCK), STRIDE * BLOCK)
        where = np.stack([s + total[s:s + span].argmax(axis=0) for s in starts])
        every = np.arange(FILTERS)
        chunks = np.maximum(total[where, every], 0)
        mean, top = chunks.mean(axis=0), chunks.argmax(axis=0)
        features = np.concatenate((mean, chunks[top, every]))
        z = features @ self.out + self.bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        back = np.repeat(error * self.out[None, :FILTERS] / len(chunks), len(chunks), axis=0)
        back[top, every] += error * self.out[FILTERS:]
        back[chunks <= 0] = 0
        for k in range(WIDTH):
            np.add.at(grad[k], (raw[where + k], every[None, :].repeat(len(chunks), axis=0)), back)
        return error * features, error

    def fit(self, texts: list[str], labels: list[int], share: float, seed: int = 11) -> "ByteCNN":
        """AdaGrad over the sample; ``share`` is class 1's share of all labels."""
        y = np.array(labels)
        if len(set(labels)) < 2:
            self.constant = float(share)
            return self
        weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        rng, sums = np.random.default_rng(seed), [np.full(self.tables.shape, 1e-3, np.float32), np.full(2 * FILTERS, 1e-3), 1e-3]
        for _ in range(-(-UPDATES * BATCH // len(texts))):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                grad, grad_out, grad_bias = np.zeros_like(self.tables), np.zeros(2 * FILTERS), 0.0
                for i in order[at:at + BATCH]:
                    g, e = self._gradients(texts[i], labels[i], weights[i] / BATCH, grad)
                    grad_out += g
                    grad_bias += e
                for j, g in enumerate((grad, grad_out, grad_bias)):
                    sums[j] = sums[j] + g * g
                self.tables -= RATE * grad / np.sqrt(sums[0])
                self.out -= (RATE * grad_out / np.sqrt(sums[1])).astype(np.float32)
                self.bias -= np.float32(RATE * grad_bias / np.sqrt(sums[2]))
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteCNN:
    """Fit on (doc_id, text) joined with (doc_id, quality)."""
    one = F.when(F.avg("quality") >= 0.5, 1).otherwise(0)
    known = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(one.alias("label")))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        model = ByteCNN()
        model.constant = 0.5
        return model
    # a row's place in a hash order decides; a class keeps about ``sample`` rows
    drawn = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("label") == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    known = known.withColumn("drawn", drawn).withColumn("rate", rate)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), size.alias("size")).filter(F.col("size") <= LONGEST)
    chosen = bounded_broadcast(known.filter("drawn < rate"))
    together = texts.select("doc_id", "size").join(chosen, "doc_id").agg(F.sum("size")).first()[0] or 0
    fewer = min(1.0, SAMPLE_BYTES / max(1, together))
    rows = texts.join(chosen.filter(F.col("drawn") < F.least("rate", F.lit(1.0)) * fewer), "doc_id").select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return ByteCNN().fit([r["text"] for r in rows], [r["label"] for r in rows], sizes.get(1, 0) / total)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """``SCHEMA`` for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], [x.split()[0] for x in SCHEMA.split(", ")])

    return in_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, SCHEMA)
