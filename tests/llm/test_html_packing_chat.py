"""HTML extraction, packing and chat formatting."""
import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.functions import spark_partition_id as spark_partition
from tokenizers import Tokenizer

from quorum.llm import chat, html_mincut, packing
from quorum.llm.queries import vocabulary
from quorum.llm.tokens import byte_ids

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

P = "Plain words make a sentence that is long enough to count as prose here, and more of it."


@pytest.mark.parametrize("page, want", [
    (f"<div class='page with-sidebar'><main><h1>T</h1><p>{P}</p></main><div class='sidebar'><p>{P}</p></div></div>", f"T {P}"),
    (f"<form id=page><article><p>{P}<p>{P}</article><div id='comments'><article><p>{P}</article></div></form>", f"{P} {P}"),
    (f"<p>{P} &amp; x<br>y</p><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul>", f"{P} & x y"),
    ("just text &lt;b&gt;", "just text <b>"), ("", ""), (None, ""), ("<script>var x='<p>no</p>'", ""),
    (f"<div><p>{P}</p><div class=notice>Note {P}</div><p>{P}</p></div>", f"{P} {P}"),
    (f"<!-- c <p>x</p> --><p>{P}", P), (f"<p title='a>b'>{P}\n\t{P}</p>", f"{P} {P}"),
    (f"<article><p>{P}</p><aside>x {P}</aside><form><input>Sign up {P}</form><section class='comments'><p>{P}</section></article>", P),
    (f"<nav>a</nav><article><p>{P}</p></article><footer>&copy; x</footer>", P)])
def test_main_text(page, want):
    assert html_mincut.main_text(page) == want


def test_min_cut_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        ends = [(rng.random() * 3, rng.random() * 3) for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(keep):
            return sum(b if k else a for (a, b), k in zip(ends, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])
        assert abs(cost(html_mincut.min_cut(ends, edges)) - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-6


def test_extract_rows(spark):
    rows = [(1, "u", f"<p>{P}", "x"), (1, "u", f"<p>{P}", "x"), (None, None, None, None), (2, "", "<div>" * 3000 + P, ""),
            (3, "", f"<p>{P}</p>" * 3000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = sorted(((r.page_id, r.url, len(r.text), r.n_chars) for r in html_mincut.extract(pages).collect()), key=str)
    n = len(P)
    assert got == sorted([(1, "u", n, n), (1, "u", n, n), (None, None, 0, 0), (2, "", n, n), (3, "", 3000 * n + 2999, 3000 * n + 2999)], key=str)
    assert html_mincut.extract(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def reference_ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=200) | st.text(alphabet="ab \n\t'sé<|endoftext|>0１ß漢 \x85", max_size=200))
def test_same_ids_as_json_vocabulary(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_same_ids_as_json_vocabulary, "t") \
        else test_same_ids_as_json_vocabulary.t
    test_same_ids_as_json_vocabulary.t = t
    own = byte_ids(vocabulary(), text)
    assert own == t.encode(text, add_special_tokens=False).ids


def test_packing_brute_force(spark, reference_ids):
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|>", "same", "same", "long words " * 3000] + \
        [" ".join(rng.choice(["alpha", "beta", "Γ", "42"]) for _ in range(rng.randint(1, 900))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "same", 1)], "doc_id long, text string, length long")
    rows = packing.pack(docs.repartition(5), vocabulary(), with_ids=True).collect()
    assert len({r.doc_id for r in rows}) == len(texts) + 1
    for i, t in enumerate(texts):
        ids = reference_ids(t or "") + [1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) for r in own)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.SEQ_LEN
    padded = {r.sequence_id: (r.used, r.padded) for r in packing.pad_sequences(spark.createDataFrame(
        [(k, n) for k, s in seqs.items() for _, n in s], "sequence_id long, length long")).collect()}
    assert all(p == (u if u & (u - 1) == 0 else packing.SEQ_LEN) for u, p in padded.values())
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("sign", ["\n", " ", "\t", "\r\n", "a", "é"])
def test_very_long_runs(spark, sign):
    """Ids of 2,000,000 equal signs, which overflow the faster reader where they are white space."""
    text = "x" + sign * (2_000_000 // len(sign)) + "y <|endoftext|>"
    own = byte_ids(vocabulary(), text)
    assert own == TOKENIZER.encode(text, add_special_tokens=False).ids
    if sign == "\n":
        rows = packing.pack(spark.createDataFrame([(1, text), (2, "z")], "doc_id long, text string"), vocabulary(), with_ids=True).collect()
        assert [i for r in sorted(rows, key=lambda r: r.start) if r.doc_id == 1 for i in r.ids] == own + [packing.END_ID]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 6), min_size=16, max_size=16))
def test_shortest_pack_first(counts):
    histogram = np.array([0] + counts)
    slots = packing.shortest_pack_first(histogram, 16)
    for length in range(1, 17):
        own = sorted(s[1:3] for s in slots if s[0] == length)
        assert [r for first, many in own for r in range(first, first + many)] == list(range(histogram[length]))
    cells = [(s + k, offset + j) for length, _, many, s, offset in slots for k in range(many) for j in range(length)]
    assert len(cells) == len(set(cells)) == int((histogram * np.arange(17)).sum()) and all(c[1] < 16 for c in cells)


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "### User:\nhi</turn>\n", "\\", "\\\\### \\n", "", None, "x" * 50000, "a\n\n### b"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(texts)]
    rows += [(2, 0, "system", "s", ""), (2, 1, None, "no role", ""), (2, 2, "odd:\n### role\\n", "t", ""), (2, 2, "odd:\n### role\\n", "t", "")]
    rows += [(3, None, "assistant", "first", ""), (3, 0, "user", "then", ""), (None, 0, "user", "u", ""), (None, 1, "assistant", "r", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, segment string").repartition(3)
    out = {r.conv_id: r for r in chat.digests(turns).collect()}
    segments = {}
    for r in chat.prefix_examples(turns).collect():
        segments.setdefault(r.conv_id, []).append(r)
    assert set(out) == {1, 2, 3, None}
    for conv in out:
        own = sorted(((t, ro or "", x or "") for c, t, ro, x, _ in rows if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        masked = "".join(x for _, ro, x in own if ro == "assistant")
        assert out[conv].n_turns == len(own)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in own).encode()).hexdigest()
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
        parts = sorted(segments[conv], key=lambda r: r.position)
        stream = "".join(r.segment for r in parts)
        examples = list(chat.render((r.is_reply, r.segment) for r in parts))
        assert out[conv].n_examples == len(examples) == sum(ro == "assistant" for _, ro, _ in own)
        after = len(stream) - max((r.seg_start + len(r.segment) for r in parts if r.is_reply), default=0)
        assert out[conv].formatted_chars == sum(len(a) + len(b) for a, b in examples) + after
        for (context, reply), r in zip(examples, (r for r in parts if r.is_reply)):
            assert stream[:r.seg_start] == context and stream[r.seg_start:].startswith(reply)
            assert chat.unescape(stream[r.loss_start:r.loss_end]) == chat.read_segment(reply)[1]
    assert chat.digests(turns.limit(0)).count() == 0
    written_out = {(r.conv_id, r.position): r for r in chat.expanded(chat.prefix_examples(turns)).collect()}
    assert len(written_out) == sum(r.is_reply for own in segments.values() for r in own)
    for conv, own in segments.items():
        parts = sorted(own, key=lambda r: r.position)
        assert [p.position for p in parts] == list(range(len(parts)))
        for r, (context, reply) in zip((r for r in parts if r.is_reply), chat.render((r.is_reply, r.segment) for r in parts)):
            e = written_out[conv, r.position]
            assert (e.context, e.reply) == (context, reply)
            assert chat.unescape(e.reply[e.loss_start:e.loss_end]) == chat.read_segment(reply)[1]


def test_hot_conversation_is_split(spark):
    """One conversation with most rows is numbered in several blocks."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i % 7}") for i in range(3000)] + [(i, 0, "user", "x") for i in range(2, 300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    out = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert out[1].n_turns == 3000 and out[1].n_examples == 1500 and len(out) == 299
    want = hashlib.sha256("".join(f"{ro}\n{x}\n" for _, _, ro, x in rows[:3000]).encode()).hexdigest()
    assert out[1].turns_sha256 == want
    assert chat.prefix_examples(turns).filter("conv_id = 1").select(spark_partition()).distinct().count() > 1


def test_query_reads_examples_written_out(spark, monkeypatch):
    """Every reply's row holds its whole context, over several parts, and the digests are read from these rows."""
    monkeypatch.setattr(chat, "PART", 2000)
    monkeypatch.setattr(chat, "SHARE", 1)
    rows = [(c, i, "assistant" if i % 3 == 1 else "user", f"{c} says {'é' * (i % 5)} ### {i}") for c, n in ((1, 90), (2, 3), (None, 40)) for i in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    examples = chat.prefix_examples(turns)
    found = examples.select("*", spark_partition().alias("task")).collect()
    assert len(found) == len(rows) and len({r.task for r in found if r.conv_id == 1}) > 1
    for conv in (1, 2, None):
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.position)
        contexts = [c for c, _ in chat.render((r.is_reply, r.segment) for r in own)]
        assert [r.context for r in own if r.is_reply] == contexts and all(r.context is None for r in own if not r.is_reply)
    digest = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert {c: (r.n_turns, r.n_examples) for c, r in digest.items()} == {1: (90, 30), 2: (3, 1), None: (40, 13)}
    lost = examples.withColumn("context", F.when(F.col("position") == 31, F.expr("substring(context, 2)")).otherwise(F.col("context")))
    monkeypatch.setattr(chat, "prefix_examples", lambda _: lost)
    with pytest.raises(Exception, match="context"):
        chat.digests(turns).collect()
