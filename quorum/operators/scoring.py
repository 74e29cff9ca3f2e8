"""User-supplied Python at the edges: model scoring, text refinement,
dataset registry (X3, X4, X5, X7).

The model, the refiner and the tokenizer are user code; Spark partitions
the rows and each task loads the user object once and sees Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LETTERS = [chr(65 + i) for i in range(26)]


# ------------------------------------------------------------------ X4

def hash_predictor() -> Callable[[list[str], int], list[dict[str, float]]]:
    """Deterministic stand-in for a language model: log-probs of the option
    tokens "L" and " L" from md5(prompt:token)."""
    def predict(prompts: list[str], n_options: int) -> list[dict[str, float]]:
        out = []
        for p in prompts:
            lp = {}
            for i in range(n_options):
                for tok in (LETTERS[i], " " + LETTERS[i]):
                    h = int(hashlib.md5(f"{p}:{tok}".encode()).hexdigest()[:8], 16) / 4294967296.0
                    lp[tok] = math.log(h) if h > 0 else -1e9
            out.append(lp)
        return out
    return predict


def share_predictor(smoothing: float = 1e-6, blank: float = 0.25) -> Callable[[list[str], int, list], list[dict[str, float]]]:
    """A baseline model that answers every prompt with given shares of the
    options (say the whole population's), smoothed; a part of each share goes to
    the token with a leading blank."""
    def predict(prompts: list[str], n_options: int, shares: list) -> list[dict[str, float]]:
        return [{token: math.log((share + smoothing) * part) for i, share in zip(range(n_options), own)
                 for token, part in ((LETTERS[i], 1 - blank), (" " + LETTERS[i], blank))} for _, own in zip(prompts, shares)]
    return predict


def batch_score(df: DataFrame, prompt: str, n_options: str,
                predictor_factory: Callable[[], Callable] = hash_predictor, features: str | None = None) -> DataFrame:
    """Add ``logprobs MAP<STRING,DOUBLE>`` per prompt.  The predictor is
    built once per task (``predictor_factory``) and called once per Arrow batch
    and number of options, with the prompts and, if given, their ``features``."""
    out_schema = T.StructType(df.schema.fields + [T.StructField("logprobs", T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = predictor_factory()
        for pdf in batches:
            res = pd.Series([None] * len(pdf), dtype=object)
            for k, part in pdf.reset_index(drop=True).groupby(n_options):
                more = [part[features].tolist()] if features else []
                for at, found in zip(part.index, predict(part[prompt].tolist(), int(k), *more)):
                    res.at[at] = found
            pdf = pdf.copy()
            pdf["logprobs"] = res.to_numpy()
            yield pdf

    return df.mapInPandas(run, out_schema)


# ------------------------------------------------------------------ X5

def refine_batch(df: DataFrame, key: str, text: str, refine: Callable[[str], str],
                 max_retries: int = 5, base_delay: float = 0.05, no_retry_on: tuple = (),
                 deadline: float = 60.0) -> DataFrame:
    """Apply a user refiner per row with exponential back-off and
    jitter; a row that still fails gets its error text instead of killing
    the job (per-row error isolation, X7).  No retry of a row begins after
    ``deadline`` seconds."""

    def call(x: str):
        delay, began = base_delay, time.monotonic()
        for attempt in range(max_retries + 1):
            try:
                return refine(x), None
            except no_retry_on as e:  # noqa: PERF203
                return None, f"{type(e).__name__}: {e}"
            except Exception as e:  # noqa: BLE001
                if attempt == max_retries or time.monotonic() - began + delay > deadline:
                    return None, f"{type(e).__name__}: {e}"
                time.sleep(delay * (1 + random.random()))
                delay *= 2
        return None, "unreachable"

    def run(batches):
        for pdf in batches:
            res = [call(x) for x in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "refined": [r for r, _ in res], "error": [e for _, e in res]})

    kt = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kt}, refined string, error string")


# ------------------------------------------------------------------ X3

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Name -> DataFrame builder (user builders are plain callables)."""
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def get_builder(name: str) -> Callable[..., DataFrame]:
    if name not in REGISTRY:
        raise KeyError(f"unknown dataset builder {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]
