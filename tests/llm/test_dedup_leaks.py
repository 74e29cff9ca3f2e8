"""Near-duplicates, decontamination and the pipeline against brute force."""
import random

import pytest

from quorum.llm import decontaminate, near_dedup, set_pairs
from quorum.llm.common import written

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, k, rng=RNG):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def grams(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """(n_shingles, component_id, kept) by position."""
    sets = [grams(t) for _, t in rows]
    owner = list(range(len(rows)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                owner[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus():
    base, passage = prose(150), prose(60)
    texts = [edited(base, RNG.randint(1, 5)) for _ in range(330)]           # one large group of near copies
    texts += [f"{prose(120)} {passage} {prose(120)}" for _ in range(90)]       # a passage that many share
    chain = prose(100)
    for _ in range(8):                                                         # a chain of edits
        chain = edited(chain, 2)
        texts.append(chain)
    texts += [edited(t, RNG.randint(1, 12)) for t in [prose(RNG.randint(5, 200)) for _ in range(40)] for _ in range(2)]
    texts += ["Same  TEXT here"] * 3 + ["same text\there", "same", "SAME", None, "", "  \n", None, "e f g h i", "E F G H i\n"]
    texts += [prose(6000), "É a b c d", "é a b c d"]
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


def test_components_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row long, digest string").repartition(4)
    got = near_dedup.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def family(shared, pairs):
    """Texts with one template, 0.69 similar to each other; two and two also
    share ``shared`` words, which links them."""
    rng = random.Random(11)
    base, texts = prose(180, rng), []
    for _ in range(pairs):
        same = prose(shared, rng)
        texts += [f"{base} {same} {prose(40 - shared, rng)}" for _ in range(2)]
    return list(enumerate(texts))


def test_links_within_a_hot_family(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 32)
    rows = family(16, 120)
    got = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute(rows)
    assert len({w[2] for w in want}) == 120
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_links_near_the_threshold_in_a_hot_family(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 32)
    rows = family(12, 300)
    got = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_screen_misses_few_links():
    import numpy as np
    import pyarrow as pa
    low = np.zeros((2, near_dedup.COORDINATES), np.int8)
    low[1, 32:] = 1  # half of the coordinates differ: at 0.75 less than this has a chance of 5e-6
    node = pa.RecordBatch.from_pydict({"node": [0, 0], "row": [0, 1], "part": [0, 1], "n_shingles": [9, 9],
                                       "map": [bytes(8)] * 2, "low": low.tolist()})
    (pair,) = set_pairs.near_pairs(75, False, near_dedup.SCREEN)([node])
    assert pair.to_pydict() == {"a": [0], "b": [1]}


def test_dedup_odd_rows(spark):
    a, b = prose(40), prose(40)
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (7, None), (7, None), (8, ""), (9, a.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.deduplicate(docs).collect()), key=str)
    assert got == sorted([(1, 36, 1, True), (1, 36, 1, True), (None, 36, 1, False), (None, 36, None, True), (None, 36, None, True),
                          (7, 0, 7, True), (7, 0, 7, True), (8, 0, 8, True), (9, 36, 1, False)], key=str)
    kept = near_dedup.keep_first(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (None, b), (7, None), (8, "")], key=str)
    assert near_dedup.deduplicate(docs.limit(0)).count() == 0 and near_dedup.keep_first(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(500, 700), (700, 600), (9, 9)]
    got = {r.row: r.part for r in set_pairs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 60)}, 500: 500, 600: 500, 700: 500}


def words(text):
    import regex
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def shingle_set(w):
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_leaks_brute_force(spark):
    items = [prose(n) for n in (5, 6, 9, 20, 33, 60, 4, 1)] + [None, "", "!!", "Straße, ÜBER-all: 10 a b"]
    docs = []
    for i in range(60):
        item = items[i % 8]
        docs.append(f"{prose(30)}, {edited(item, i % 5) if len(item.split()) > 4 else item}! {prose(400 if i % 3 else 3)}")
    docs += [items[6], items[7].upper(), items[6] + "?", None, "", "straße über all 10 a b.", " ".join(i or "" for i in items), prose(9000) + " " + items[4]]
    rows = [(i, t, 1, "x") for i, t in enumerate(docs)] + [(0, docs[0], 1, "x"), (None, items[5], 1, "x"), (0, items[5], 1, "x")]
    bench = [(i, t, "c") for i, t in enumerate(items)] + [(3, items[3], "c"), (None, items[2], "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n long, hash string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    want = {}
    for doc, t, *_ in rows:
        for item, u, _ in bench:
            left, right = shingle_set(words(t)), shingle_set(words(u))
            if right and len(left & right) >= 0.75 * len(right):
                want[doc, item] = max(want.get((doc, item), (0, 0)), (len(left & right), len(right)))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contaminated(d, b).collect()}
    assert got == want and len(want) > 25
    left = decontaminate.decontaminated(d, b)
    assert left.columns == d.columns
    dirty = {(doc, t) for doc, t, *_ in rows for u in items if shingle_set(words(u))
             and len(shingle_set(words(t)) & shingle_set(words(u))) >= 0.75 * len(shingle_set(words(u)))}
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([r[:2] for r in rows if r[:2] not in dirty], key=str)
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 == decontaminate.contaminated(d, b.limit(0)).count()
    assert decontaminate.decontaminated(d, b.limit(0)).count() == len(rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    letters = {"en": "the and of to in is", "de": "der die und zu den ist"}
    def text(lang, n):
        own = letters[lang].split()
        return "\n".join(" ".join(rng.choice(own) + rng.choice(["", "s", "e", "n"]) + str(rng.randint(0, 99)) * (rng.random() < .3)
                                  for _ in range(25)) + "." for _ in range(n))
    rows = [(i, text("de" if i % 4 == 0 else "en", rng.randint(3, 9)), "de" if i % 4 == 0 else "en", f"s{i % 3}") for i in range(80)]
    item = " ".join(f"item{i}" for i in range(30))
    rows += [(100, rows[1][1], "en", "s"), (101, rows[2][1] + "\nOne more line at the end, with ten words or more.", "en", "s"),
             (102, f"{rows[3][1]}\n{text('en', 4)}\n{item} and this ends it.", "en", "s"), (103, "Home | About", "en", "s"),
             (104, None, None, None), (105, "", "en", "s"), (106, "12 34 .", "en", "s"), (1, rows[1][1], "en", "s1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_stage_by_stage(spark, folder):
    import corpus_pipeline
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "test")
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "packing":
            assert docs.columns == columns
    clean = set(range(80))
    assert set(ids["language ID"]) >= clean | {100, 101, 102} and not {104, 105, 106} & set(ids["language ID"])
    assert set(ids["quality rules"]) >= clean | {100, 101, 102} and 103 not in ids["quality rules"]
    assert ids["near-dedup"] == sorted(clean | {102})  # 100 and 101 copy others, and 1 stands twice
    assert ids["decontamination"] == sorted(clean)
    assert sorted(set(ids["packing"])) == sorted(clean)
    assert set(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == clean
