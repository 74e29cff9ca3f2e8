"""URL filter, line rules and language mixtures on small cases."""
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quorum.llm import language_mix, line_rules, url_filter


def urls(spark, rows, rules, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, row long")
    out = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules), **more)
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)


def test_url_rules_and_precedence(spark):
    rules = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("x.org", "", "block"),
             ("x.org", "/ok", "allow"), ("dup.net", "/", "allow"), ("dup.net", "/", "block")]
    cases = {"http://EXAMPLE.com/en/a?q=/fr/": ("example.com", "/en/a", "example.com/en/", "block"),
             "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
             "http://a.www.example.com/en/x#y": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
             "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
             "http://example.com": ("example.com", "", None, "allow"),
             "http://x.org?q": ("x.org", "", "x.org", "block"),
             "ftp://a.x.org/okay": ("a.x.org", "/okay", "x.org/ok", "allow"),
             "https://dup.net/": ("dup.net", "/", "dup.net/", "block"),
             "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "http:///p": ("", "/p", None, "allow"),
             "http://" + "a." * 3000 + "com/" + "b" * 5000: ("a." * 3000 + "com", "/" + "b" * 5000, "com/", "allow")}
    rows = [(i, u, "clash", "clash", 1) for i, u in enumerate(cases)]
    want = [(i, *v) for i, v in enumerate(cases.values())]
    rows += [(None, None, None, None, None), (0, list(cases)[0], None, None, None)]
    want += [(None, "", "", None, "allow"), (0, *list(cases.values())[0])]
    assert urls(spark, rows, rules) == sorted(want, key=str)
    assert urls(spark, rows[:1], [], default="block") == [(0, "example.com", "/en/a", None, "block")]
    assert urls(spark, [], rules) == []


def covered(words, width=8):
    windows = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(width)})


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
def test_repeated_words_brute_force(words):
    assert line_rules.repeated_words(words) == covered(words)


def test_line_rules(spark):
    good = "This line is a plain sentence of more than ten words, as prose is."
    assert not line_rules.line_fails(good, good.encode().split())
    for bad in ("Home | About | Contact | Help", "short and open", "a$$ b$$ c## d%% e&& f** g$$ h## i|| j$$ k",
                "WOW!! THIS!! IS!! GREAT!! AND LOUD!! TOO!! A!! B!! C!! D!! E!!", "so so so so so so so so so so so.",
                "THIS LINE IS ALL IN CAPITALS FROM ITS START TO ITS END, YES.",
                good + " All rights reserved."):
        assert line_rules.line_fails(bad, bad.encode().split()), bad
    other = "Some quite different statement follows here, so that no window of words repeats itself."
    text = "\n".join([good] + ["Home | About", other, "", "x | y | z"])
    rows = [(1, text, "x", True), (1, text, "x", True), (2, None, None, None), (3, "", "", False), (None, good * 3000, "", None),
            (5, "| |\n" * 40, "", None), (6, "  word " * 30, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, base_failed boolean")
    out = {r.doc_id: r for r in line_rules.judge_lines(docs).collect()}
    assert line_rules.judge_lines(docs).count() == len(rows)
    assert (out[2].n_words, out[2].base_failed, out[2].kept) == (0, True, False) == (out[3].n_words, out[3].base_failed, out[3].kept)
    assert out[1].kept and out[1].n_lost_lines == 2
    assert out[None].n_words == 3000 * 14 - 2999 and out[None].base_failed
    assert out[5].n_dup_lines == 39 and not out[5].kept
    assert out[6].n_words == 30 and out[6].word_chars == 30 * 6
    clean = line_rules.clean_documents(docs).collect()
    assert [(r.doc_id, r.text) for r in clean] == [(1, "\n".join([good, other, ""]))] * 2
    assert line_rules.clean_documents(docs).columns == docs.columns
    assert line_rules.judge_lines(docs.limit(0)).count() == 0 and line_rules.clean_documents(docs.limit(0)).count() == 0


EN = "the house is on the hill and the river runs by the old mill where they were living"
DE = "das haus steht auf dem berg und der fluss zieht an der alten muehle vorbei wo sie wohnten"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "x") for i in range(40)] + [(50, None, "en", ""), (51, "zz", None, "")]
    return language_mix.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"))


def test_language_mixture(spark, model):
    assert model.langs == ["de", "en"]
    rows = [(1, EN), (2, DE), (3, f"{EN} {EN} {EN} {DE}"), (4, None), (5, ""), (6, "123 ... ²"), (None, EN), (1, EN),
            (7, (DE + " ") * 5000), (8, "q")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, held_out string")
    got = sorted(language_mix.predict(docs, model).collect(), key=lambda r: str(r.doc_id))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None, 7)] == ["en", "de", "en", "und", "und", "und", "en", "de"]
    assert set(by[3].languages) == {"en", "de"} and 0.55 < by[3].score < 0.9 and set(by[1].languages) == {"en"}
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = language_mix.keep_known(docs, model)
    assert kept.columns == docs.columns and {4, 5, 6}.isdisjoint(r.doc_id for r in kept.collect())
    none = language_mix.train(docs.withColumnRenamed("held_out", "lang").limit(0))
    assert {r.lang_pred for r in language_mix.predict(docs, none).collect()} == {"und"}
    assert language_mix.predict(docs.limit(0), model).count() == 0


def test_gram_blocks_agree(monkeypatch):
    text = f"{EN} 12 {DE}!" * 40
    whole = language_mix.grams(text)
    monkeypatch.setattr(language_mix, "BLOCK", 100)
    assert all((a == b).all() for a, b in zip(whole, language_mix.grams(text)))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_mix.predict(docs, language_mix.train(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_rule_paths_without_a_slash(spark):
    rules = url_filter.rule_table(spark, [("a.co", "m/", "block"), ("b.com", "/x", "block"), ("c/d", "", "block"), ("b.com", "y", "block")])
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.com/m/"), (3, "http://b.com/x"), (4, "http://b.com/y"), (5, "http://c/d")],
                                  "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
    assert got == [(1, None, "allow"), (2, None, "allow"), (3, "b.com/x", "block"), (4, None, "allow"), (5, None, "allow")]
