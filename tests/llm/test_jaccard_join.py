"""The set similarity join against brute force."""
import random

import numpy as np
import pyarrow as pa
import pytest

from quorum.llm import jaccard_join, set_pairs

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(text, k):
    words = text.split()
    for _ in range(k):
        words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY)
    return " ".join(words)


def grams(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [grams(t) for _, t in rows]
    owner = list(range(len(rows)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                owner[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted([(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))], key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, part int")
    return sorted((tuple(r) for r in jaccard_join.join(df).collect()), key=str)


def corpus():
    texts = []
    base, passage = prose(150), prose(60)
    texts += [edited(base, RNG.randint(1, 6)) for _ in range(150)]
    texts += [f"{prose(60)} {passage} {prose(60)}" for _ in range(60)]
    texts += [f"{passage} {prose(RNG.randint(5, 16))}" for _ in range(80)]   # a dense family about the threshold
    for n in (5, 6, 8, 9, 10, 12, 15, 20, 30, 50, 90, 200, 700):              # pairs about the threshold, of many sizes
        for _ in range(8):
            text = prose(n)
            texts += [text, edited(text, max(1, n // 50)), edited(text, max(1, n // 25)), f"{text} {prose(max(1, n // 5))}"]
    chain = prose(100)
    for _ in range(8):
        chain = edited(chain, 1)
        texts.append(chain)
    texts += ["a a a a a", "a a a a a a", "a a a a a a a a"]                  # equal sets of different texts
    texts += ["Same  TEXT here"] * 3 + ["same text\there", "same", "SAME", None, "", "  \n", None, "e f g h i", "E F G H i\n"]
    texts += [prose(6000), "É a b c d", "é a b c d"]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[0]), (None, prose(30)), (None, None), (5, texts[3]), (5, prose(20)), rows[7]]


ROWS = corpus()


def test_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_hot_keys(spark, monkeypatch):
    """With nodes of three at most nearly all keys of groups are hot."""
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "TOGETHER", 6)
    rows = ROWS[100:420]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1)]


@pytest.mark.parametrize("documents", [0, 10**4, 10**9])
def test_linked_sets_share_a_key(documents):
    """Every scheme, whatever its weights: sets at the threshold share keys of
    more weight than the slack for hot keys."""
    rng, found = np.random.default_rng(3), set()
    edges = jaccard_join.bands(3000)
    schemes = [jaccard_join.scheme(a, b, documents) for a, b in zip(edges, edges[1:])]
    found |= {s[1] > 0 for s in schemes}
    for size in [*range(1, 60), 90, 150, 333, 800, 2000]:
        for _ in range(6):
            union = size * 100 // 80
            values = np.unique(rng.integers(0, 2**64, union, np.uint64))
            cut = rng.integers(0, union - size + 1)
            rng.shuffle(values)
            x, y = np.sort(values[:union - cut]), np.sort(values[union - size - cut:])
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * len(np.union1d(x, y)):
                continue
            shared = np.intersect1d(jaccard_join.document_keys(x, edges, schemes), jaccard_join.document_keys(y, edges, schemes))
            best = {}
            for code in (shared.view(np.int64) >> 56).tolist():
                best[code // 2] = best.get(code // 2, 0) + code % 2 + 1
            assert any(w > schemes[k][3] for k, w in best.items())
    assert documents < 10**9 or True in found


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for n, m, both in [(10, 12, 5), (100, 700, 90), (500, 500, 400), (30_000, 5000, 3000)]:
        values = np.unique(rng.integers(0, 2**64, n + m - both, np.uint64))
        rng.shuffle(values)
        x, y = values[:n], values[n - both:]
        maps = [jaccard_join.bitmap(x), jaccard_join.bitmap(y)]
        assert set_pairs.differing(maps, np.array([0]), np.array([1]))[0] <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_nodes_over_batches(size, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    keys = np.sort(np.random.default_rng(5).integers(0, 40, 150))
    keys = np.concatenate([keys, np.full(33, 50), [60]])
    rows = np.arange(len(keys))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + size]), pa.array(rows[i:i + size])], ["key", "row"]) for i in range(0, len(keys), size)]
    small, big = [], {}
    for batch in jaccard_join._nodes(iter(batches)):
        for r in batch.to_pylist():
            assert 1 <= len(r["rows"]) <= 4
            if r["key"] is None:
                small.append(r["rows"])
            else:
                big.setdefault(r["key"], set()).update(r["rows"])
                assert r["rows"][0] == rows[keys == r["key"]][0]
    groups = {k: rows[keys == k].tolist() for k in set(keys.tolist())}
    assert sorted(small) == sorted(g for g in groups.values() if 2 <= len(g) <= 4)
    assert {k: sorted(v) for k, v in big.items()} == {k: g for k, g in groups.items() if len(g) > 4}


def test_both_operators_agree(spark):
    """The exact join at the threshold of the chosen-path trees has their components."""
    from quorum.llm import near_dedup
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs, near_dedup.PERCENT).collect()}
    trees = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.deduplicate(docs).collect()}
    assert exact == trees and len({e[2] for e in exact}) < docs.count()


def blocks(nodes, size, seed):
    """A stream of (node, row, part, n_shingles, map): rows in several nodes, maps near a few others, some rows of one part."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 256, (6, 128), np.uint8)
    n = max(nodes * size // 2, size)
    maps = centres[rng.integers(0, 6, n)]
    maps[np.arange(n), rng.integers(0, 128, n)] ^= 1
    far = rng.random(n) < 0.7
    maps[far] = rng.integers(0, 256, (int(far.sum()), 128), np.uint8)
    parts = np.where(rng.random(n) < 0.2, 0, np.arange(n) // 2 * 2)
    sizes = rng.integers(700, 1000, n)
    rows = np.concatenate([np.sort(rng.choice(n, k, replace=False)) for k in ([size] * nodes + [2, 3, 40, 64, 65] if seed else [size] * nodes)])
    node = np.repeat(np.arange(nodes + (5 if seed else 0)), [size] * nodes + ([2, 3, 40, 64, 65] if seed else []))
    table = pa.table({"node": node, "row": rows, "part": parts[rows], "n": sizes[rows], "map": pa.array([maps[k].tobytes() for k in rows], pa.binary())})
    return table, parts, sizes, [m.tobytes() for m in maps]


@pytest.mark.parametrize("held", [1, 50, 1 << 18])
def test_pairs_a_part_at_a_time(held, monkeypatch):
    """However few pairs are held at once, all that their bitmaps allow are found, or the closest of every two parts."""
    monkeypatch.setattr(set_pairs, "PAIRS", held)
    table, parts, sizes, maps = blocks(3, 90, 7)
    node, row = table.column(0).to_numpy(), table.column(1).to_numpy()
    both = {(a, b) for k in set(node.tolist()) for a in row[node == k].tolist() for b in row[node == k].tolist() if a < b and parts[a] != parts[b]}
    i, j = np.array(sorted(both)).T
    good = set_pairs.possible(sizes, maps, i, j, 80)
    apart = dict(zip(zip(i.tolist(), j.tolist()), set_pairs.differing(maps, i, j).tolist()))
    expected = set(zip(i[good].tolist(), j[good].tolist()))
    assert len(expected) > 100 and len(expected) < len(both)

    def found(only_closest):
        out = [x for x in set_pairs.near_pairs(80, only_closest)(iter(table.to_batches(max_chunksize=17)))]
        return [(r["a"], r["b"]) for x in out for r in x.to_pylist()]

    def of_parts(pair):
        return tuple(sorted((int(parts[pair[0]]), int(parts[pair[1]]))))
    every, closest = found(False), found(True)
    assert set(every) == expected and (held < 1 << 18 or len(every) == len(expected))
    least = {}
    for pair in expected:
        least[of_parts(pair)] = min(apart[pair], least.get(of_parts(pair), 1 << 30))
    best = {}
    for pair in closest:
        best[of_parts(pair)] = min(apart[pair], best.get(of_parts(pair), 1 << 30))
    assert set(closest) <= expected and best == least


def test_full_blocks_in_little_memory():
    """Blocks of hot nodes, all of different parts: a worker never holds all their pairs (two blocks have 4.2 million)."""
    import tracemalloc
    table = blocks(2, jaccard_join.TOGETHER, 0)[0]
    batches = table.to_batches(max_chunksize=500)
    tracemalloc.start()
    try:
        largest = max(x.num_rows for x in set_pairs.near_pairs(80, False)(iter(batches)))
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
    assert largest <= 3 * set_pairs.PAIRS


def test_copies_are_left_out(spark):
    """Texts that are many times in the table are one vertex, rows without words none."""
    rows = [(i, ROWS[i % 40][1]) for i in range(200)] + [(300 + i, None) for i in range(5)]
    assert run(spark, rows) == brute(rows)


def test_batches_of_long_texts(spark, monkeypatch):
    """Texts of 2 MB: no batch of the join holds many of them, and the session's setting is back afterwards."""
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    linked = jaccard_join.linked

    def measured(docs, percent):
        sizes = jaccard_join.in_batches(docs.select("text"), lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        rows.extend(r["n"] for r in sizes.collect())
        return linked(docs, percent)
    monkeypatch.setattr(jaccard_join, "linked", measured)
    texts = [("word " * 400_000) + str(i % 2) for i in range(12)]
    found = jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert sum(rows) == 12 and max(rows) <= 3 and spark.conf.get(key) == before
    assert {(r.n_shingles, r.component_id) for r in found} == {(2, 0), (2, 1)}
