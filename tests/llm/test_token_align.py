"""Alignment of two vocabularies against a plain version."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quorum.llm import token_align, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_groups(text):
    """Lists of (A ids, B ids) by walking the bytes."""
    left, right = tokens.byte_ids(A, " " + text, special=False), tokens.pieces(B).encode(text)
    a, b = [tokens.byte_table(A)[i] for i in left], [tokens.piece_table(B)[i] for i in right]
    if not text or b"".join(a) != b"".join(b) or b"".join(a) != (" " + text).encode():
        return []
    ends_a, ends_b = set(np.cumsum([len(x) for x in a]).tolist()), set(np.cumsum([len(x) for x in b]).tolist())
    both, out = sorted(ends_a & ends_b), []
    i = j = at_a = at_b = 0
    for end in both:
        x, y = [], []
        while at_a < end:
            at_a, x, i = at_a + len(a[i]), x + [left[i]], i + 1
        while at_b < end:
            at_b, y, j = at_b + len(b[j]), y + [right[j]], j + 1
        out.append((x, y))
    return out


def plain(rows):
    found, count = [], Counter()
    for doc, text in rows:
        g = plain_groups(text or "")
        links = Counter((x, y) for a, b in g for x in a for y in b)
        count.update(links.keys())
        found.append((doc, g, links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc, g, links in found:
        form = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()),
                    sum(n for (x, y), n in links.items() if count[x, y] == top[x]), sum(n * count[k] for k, n in links.items()),
                    hashlib.sha256(form.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, block string")
    return sorted((tuple(r) for r in token_align.align(df, A, B).select(*COLUMNS).collect()), key=str)


ODD = [None, "", " ", "a", "Hello world", "Hello world", "  two  blanks ", "tab\tand\r\nlines\n\n\n", "Grüße, 日本語 und 😀🤷🏽‍♀️!", "a▁b", "ﬁ ½ Å é",
       "<|endoftext|> <s> </s> <0x41> <unk>", "\u0000\u0007x", "don't we'll", "1234567890" * 7, "née ​ x", "ab" * 3000, "\n" * 300]


def test_odd_texts(spark):
    rows = [(i % 13 if i else None, t) for i, t in enumerate(ODD)]
    assert run(spark, rows) == plain(rows)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120).collect()]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50])
def test_pieces_of_any_size(piece):
    texts = [t for t in ODD if t]
    whole, small = token_align.aligned(texts, A, B), token_align.aligned(texts, A, B, piece)
    assert whole[0] == small[0] and all((x == y).all() for x, y in zip(whole[1:], small[1:]))


def test_merge_path_is_even():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 5000, 900)), np.unique(rng.integers(0, 5000, 2000))
    diagonal = np.arange(0, len(a) + len(b) + 1)
    i, j = token_align.merge_path(a, b, diagonal)
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    assert (i + j == diagonal).all()
    assert i.tolist() == [sum(side == 0 for _, side in merged[:d]) for d in diagonal]


def test_small_blocks_and_wide_groups(spark, monkeypatch):
    texts = ["Hello world again, Grüße 日本語 😀 and more words here"] * 3 + ODD
    whole = token_align.aligned([t or "" for t in texts], A, B)
    monkeypatch.setattr(token_align, "WIDE", 1)
    again = token_align.aligned([t or "" for t in texts], A, B)
    assert whole[0] == again[0] and all((x == y).all() for x, y in zip(whole[1:], again[1:]))
    monkeypatch.setattr(token_align, "ENTRIES", 5)
    block = token_align._Block(0)
    _, keys, times = whole
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << 32)
    batches = [x for k in range(len(texts)) for x in block.add((k, k, 1, 1, 1, 1, ""), keys[cuts[k]:cuts[k + 1]] & 0xFFFFFFFF, times[cuts[k]:cuts[k + 1]])]
    batches += block.flush()
    books, seen = {}, Counter()
    for batch in batches:
        for r in batch.to_pylist():
            if r["row"] is None:
                books[r["block"]] = r["pairs"]
            else:
                seen.update({(r["row"], books[r["block"]][at] & 0xFFFFFFFF): n for at, n in zip(np.cumsum(r["pairs"]), r["times"])})
    assert seen == Counter({(int(k >> 32), int(k & 0xFFFFFFFF)): int(n) for k, n in zip(keys, times)})


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align(empty, A, B).count() == 0
    rows = [(1, "\n" * 400_000 + "end"), (2, "x" * 400_000), (3, "é" * 100_000)]
    assert run(spark, rows) == plain(rows)


def test_a_task_holds_little_beside_its_block(monkeypatch):
    """Aligning 4 MB of texts takes a bounded part of a worker's memory; a block holds 8 bytes an entry."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    monkeypatch.setattr(token_align, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)).decode() for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 1500)) for _ in range(450)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(450), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    token_align.aligned(texts[:1], A, B)  # the vocabularies
    tracemalloc.start()
    rows = sum(b.num_rows for b in token_align._align(A, B)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 451 and peak < 150e6
    block = token_align._Block(0)
    keys = np.arange(1000, dtype=np.int64) << 16
    list(block.add((0, 1, 1, 1, 1, 1, ""), keys[100:200], np.ones(1000, np.int64)[100:200]))
    assert sum(x.nbytes for x in block.keys + block.times) == 800 and all(x.base is None for x in block.keys + block.times)
