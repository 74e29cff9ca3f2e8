"""Quality rules, line first: bad lines go, then documents that lost too much.

Each line that has a word is tested by the rules below.  Lines that fail are
removed.  A document is rejected if the removed lines held more than
``MAX_LOST`` of its words, or if it fails the base rules (fewer than
``MIN_WORDS`` words, or more than ``MAX_REPEATED`` percent of the words in
8-word windows that occur twice or more).

* stutter: more than half of the words equal the word before
* punctuation: a line under ``SHORT`` words that does not end in closing
  punctuation; more than half of the words ending in ``!!``; more than half of
  at least 5 words in capitals
* symbols: more than one of ``#*$%&|<>`` for every 4 words
* navigation: more than one stand-alone separator for every 4 words
* boilerplate: one of ``PHRASES`` anywhere in the line, ignoring ASCII case

Runs in Arrow batches over whole texts.  Defined cases: a null or empty text
has no words and fails the base rules; rows are judged one by one, so repeated
rows, null ids and ties need no care; an empty table gives none; a very long text
is held once with its words; other columns are ignored.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import in_batches

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
SHORT, MAX_LOST = 10, 0.5

# Symbols, separators, closing marks and boilerplate phrases.
SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset(("|", ">", "»", "·", "•", "/", "::"))
CLOSING = tuple(".!?:;\"')]}…”’»")
PHRASES = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
           "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter", "subscribe to our",
           "licensed under the")

SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = re.compile(rb"[^a-z]*[A-Z][^a-z]*")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)), re.IGNORECASE | re.ASCII)
_UPPER = bytes(range(65, 91))

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lost_words long, n_lost_lines long")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_fails(line: str, words: list[bytes]) -> bool:
    """Whether a line with ``words`` breaks one of the rules."""
    n = len(words)
    if n < SHORT and not line.rstrip(SPACES).endswith(CLOSING):
        return True
    if 4 * sum(map(line.count, SYMBOLS)) > n or 4 * sum(w.decode() in SEPARATORS for w in words if len(w) < 4) > n:
        return True
    if 2 * sum(w.endswith(b"!!") for w in words) > n or 2 * sum(map(operator.eq, words, words[1:])) > n:
        return True
    raw = line.encode()
    if n >= 5 and 2 * (len(raw) - len(raw.translate(None, _UPPER))) > n \
            and 2 * sum(_CAPITALS.fullmatch(w) is not None for w in words) > n:
        return True
    return _PHRASE.search(line) is not None


def judged(text: str | None) -> tuple[tuple, list[str]]:
    """The columns of ``SCHEMA`` after the id, and the lines that break no rule, in
    one pass over the lines."""
    text = text or ""
    words = text.encode().split()  # bytes split at \x20 and \x09-\x0D only
    n, seen, dup, lost, lost_lines, good = len(words), set(), 0, 0, 0, []
    for line in text.split("\n"):
        own = line.encode().split()
        if own:
            dup += line in seen
            seen.add(line)
            if line_fails(line, own):
                lost += len(own)
                lost_lines += 1
                continue
        good.append(line)
    repeated = repeated_words(words)
    base = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated,
            base, not base and lost <= MAX_LOST * n, lost, lost_lines), good


def measure(text: str | None) -> tuple:
    """The columns of ``SCHEMA`` after the id, for one text."""
    return judged(text)[0]


def cleaned(text: str) -> str:
    """The lines of ``text`` that break no rule."""
    return "\n".join(judged(text)[1])


_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t.as_py()) for t in batch.column(1)]
        columns = zip(*rows) if rows else [[] for _ in _TYPES]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64())] + [pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def judge_lines(docs: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for every row of ``docs`` (doc_id, text)."""
    return in_batches(docs.select("doc_id", "text"), _judge, SCHEMA)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        found = [judged(t.as_py()) for t in batch.column(at)]
        keep = [facts[6] for facts, _ in found]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(
            ["\n".join(good) if facts[6] else None for facts, good in found], batch.schema.field(at).type))
        yield batch.filter(pa.array(keep, pa.bool_()))


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, among them ``text``) without rejected rows, each
    text without its failing lines; n_chars, where there is one, follows."""
    out = in_batches(docs, _clean, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
