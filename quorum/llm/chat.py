"""Chat formatting: every assistant turn becomes an example of its own.

An example is one assistant reply with all preceding turns as its context;
only the reply is trainable.  ``prefix_examples`` writes every example out, context
and reply, with its loss mask.  Together the contexts of a long conversation grow
with the square of its turns, as such examples do, so they are made where they are
read and not stored: turns are formatted and stored once, with their
places in the conversation's character stream, and a conversation with much to write out is
dealt over tasks in proportion to it.

Template of a turn::

    ### Role:
    text</turn>

with a final newline.  In roles and texts ``\\`` is put before every ``\\``,
``###`` and ``</turn>``, and in roles a newline becomes ``\\n``; this is undone
by ``unescape``, and nothing unescaped but the template can mark a turn.

Segments are built by DataFrame expressions; positions and starts come from a
prefix scan over ordered blocks, which cuts a long conversation into many tasks.
The digest of a conversation runs over its examples in order, with constant memory;
of a context only what follows the example before is read as turns, and the length of the whole.

Defined cases: a null text or role is empty; rows are ordered by turn (null
first), then role and text, so ties and repeated rows are kept, each as a turn;
a null conv_id is a conversation; any role but ``assistant`` is context only;
trailing turns that no reply follows stay as segments without an example; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import in_batches
from quorum.operators.positions import scan

OPEN, COLON, CLOSE = "### ", ":\n", "</turn>\n"
REPLY = "assistant"
PART, SHARE = 1 << 22, 16  # characters of examples that a part writes out, at least; and at least so many times the conversation's
ROWS, CHARS = 500, 1 << 22  # of a batch of examples

_ESCAPED = re.compile(r"\\(\\|###|</turn>|n)")
_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.|:(?!\n))*):\n([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.DOTALL)


def escape(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"(\\|###|</turn>)", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, is_reply, segment, loss_start, loss_end (offsets into the
    segment, null but for replies) of every row of ``turns``."""
    role = F.regexp_replace(escape(F.col("role")), "\n", r"\\n")
    head, body = F.concat(F.lit(OPEN), role, F.lit(COLON)), escape(F.col("text"))
    reply = F.coalesce(F.col("role") == REPLY, F.lit(False))
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        reply.alias("is_reply"), F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        F.when(reply, F.length(head)).alias("loss_start"),
        F.when(reply, F.length(head) + F.length(body)).alias("loss_end"))


EXAMPLES = ("conv_id long, position long, is_reply boolean, segment string, seg_start long, loss_start long, "
            "loss_end long, context string, since long")


def _written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, part and position: the turns of a part, and the
    context of each that is a reply, made of all turns before it."""
    names, types = zip(*(x.split() for x in EXAMPLES.split(", ")))
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[t] for t in types]
    at, context, length, since, out, held = (), [], 0, 0, [], 0

    def made():
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], list(names))

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for conv, position, reply, segment, start, lo, hi, part, parts in zip(*columns):
            if at != (conv, part):
                at, context, length, since = (conv, part), [], 0, 0
            if start != length:
                raise ValueError("a turn does not begin where the turns before it end")
            if position % parts == part:
                before = "".join(context) if reply else None
                context = [before] if reply else context
                out.append((conv, position, reply, segment, start, lo, hi, before, since))
                held += len(segment) + (length if reply else 0)
            context.append(segment)
            length += len(segment)
            since = length if reply else since
            if len(out) >= ROWS or held >= CHARS:
                held = 0
                yield made()
    yield made()


def prefix_examples(turns: DataFrame) -> DataFrame:
    """One row per turn, in ``EXAMPLES``' columns; rows with ``is_reply`` are
    the examples, written out: ``context``, all turns before, of which those from
    ``since`` on follow the reply before, and ``segment``, the reply, with the
    offsets of its loss mask in the conversation's stream.  Other rows have no context.

    A conversation's examples are dealt over so many parts that none writes out much
    more than PART characters or SHARE times the conversation, which a part reads whole."""
    formatted = format_turns(turns).withColumn("chars", F.length("segment").cast("long")).withColumn("conv_id", F.col("conv_id").cast("long"))
    placed = scan(formatted, ["turn", "role", "text"], ["conv_id"], "seg_start", "chars", place="position").rows
    stored = placed.select("conv_id", "position", "is_reply", "segment", "seg_start", (F.col("seg_start") + F.col("loss_start")).alias("loss_start"),
                           (F.col("seg_start") + F.col("loss_end")).alias("loss_end"))
    sizes = placed.groupBy(F.col("conv_id").alias("of")).agg(F.sum(F.when(F.col("is_reply"), F.col("seg_start") + F.col("chars")).cast("double")).alias("out"),
                                                              F.sum("chars").alias("whole"))
    long = sizes.select("of", F.ceil(F.col("out") / F.greatest(F.lit(PART), SHARE * F.col("whole"))).alias("parts")).where("parts > 1")
    dealt = stored.join(F.broadcast(long), F.col("conv_id").eqNullSafe(F.col("of")), "left")  # a row for PART characters of examples, at most
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.select(*stored.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts")
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_batches(dealt.repartition(tasks, "conv_id", "part").sortWithinPartitions("conv_id", "part", "position"), _written_out, EXAMPLES)


def expanded(examples: DataFrame) -> DataFrame:
    """conv_id, position, context, reply, loss_start, loss_end (in the reply) of
    every example of ``prefix_examples``."""
    return examples.filter("is_reply").select("conv_id", "position", "context", F.col("segment").alias("reply"), (F.col("loss_start") - F.col("seg_start")).alias("loss_start"),
                                              (F.col("loss_end") - F.col("seg_start")).alias("loss_end"))


def render(segments: Iterable[tuple[bool, str]]) -> Iterator[tuple[str, str]]:
    """(context, reply) texts of the examples of one conversation, given the
    (is_reply, segment) pairs of its turns in order."""
    context = ""
    for is_reply, segment in segments:
        if is_reply:
            yield context, segment
        context += segment


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def read_segments(stream: str) -> Iterator[tuple[str, str]]:
    """(role, text) of formatted turns, one after the other."""
    at = 0
    while at < len(stream):
        m = _SEGMENT.match(stream, at)
        if m is None:
            raise ValueError("not a formatted turn")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_examples long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the turns and the masked text that the examples hold, and the turns
    after the last.  A conversation's hashes run over its rows as they arrive."""
    conv, done = (), []
    upto = after = None         # [turns, their hash]: of the examples, and with the turns after them
    masked, facts = None, []    # hash of the masked text; its chars, chars of examples, examples, chars after, chars up to the last example

    def flush():
        done.append((conv[0], after[0], after[1].hexdigest(), facts[0], masked.hexdigest(), facts[1] + facts[3], facts[2]))

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def out():
        rows, done[:] = list(done), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)],
                                          [x.split()[0] for x in DIGEST.split(", ")])

    def add(to, role, text):
        to[0] += 1
        to[1].update(f"{role}\n{text}\n".encode())

    for batch in batches:
        for own, reply, segment, start, lo, hi, before, since, tail in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != (own,):
                if conv:
                    flush()
                conv, upto, masked, facts = (own,), [0, hashlib.sha256()], hashlib.sha256(), [0] * 5
                after = [0, upto[1].copy()]
            if not reply:
                add(after, *read_segment(segment))
                facts[3] += len(segment)
                continue
            if (before, since) != (start, facts[4]) or before - since != len(tail):
                raise ValueError("an example's context is not what the turns before it make")
            for role, text in [*read_segments(tail), read_segment(segment)]:
                add(upto, role, text)
            after = [upto[0], upto[1].copy()]
            loss = unescape(segment[lo - start:hi - start])
            masked.update(loss.encode())
            facts = [facts[0] + len(loss), facts[1] + before + len(segment), facts[2] + 1, 0, before + len(segment)]
        yield out()
    if conv:
        flush()
        yield out()


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what the examples of ``prefix_examples`` hold, read back from
    them as they are written out; formatted_chars counts all
    examples, context included, and the turns after the last reply."""
    read = prefix_examples(turns).select(
        "conv_id", "position", "is_reply", "segment", "seg_start", "loss_start", "loss_end", F.length("context").cast("long").alias("before"), "since",
        F.expr("substring(context, CAST(since + 1 AS INT))").alias("tail"))
    tasks = read.repartition("conv_id").sortWithinPartitions("conv_id", "position").drop("position")
    return in_batches(tasks, _read_back, DIGEST)
