"""The whole labelling of small pages against brute force, and pages of known text."""
import itertools
import random
import time

from quorum.llm import html_mincut as H

RNG = random.Random(8)


def sentence(n):
    return " ".join(RNG.choice("lorem ipsum dolor sit amet elit sed do magna aliqua".split()) for _ in range(n)).capitalize() + "."


def brute(terminals, edges):
    """The least cost of all labellings of the blocks and elements."""
    return min(sum(a if not on else b for (a, b), on in zip(terminals, label)) + sum(w for i, j, w in edges if label[i] != label[j])
               for label in itertools.product((False, True), repeat=len(terminals)))


def piece(depth):
    kind = RNG.randrange(7)
    if kind == 0 and depth:
        return f"<div class='{RNG.choice(['sidebar', 'x', 'story-body', 'with-ads', 'comments'])}'>{piece(depth - 1)}{piece(depth - 1)}</div>"
    if kind == 1 and depth:
        return f"<{(t := RNG.choice(['article', 'nav', 'section', 'footer']))}>{piece(depth - 1)}{piece(depth - 1)}</{t}>"
    if kind == 2:
        return f"<ul><li>{sentence(1)}</li><li><a href=x>{sentence(2)}</a></li></ul>"
    if kind == 3:
        return f"<h2>{sentence(2)[:-1]}</h2>"
    return f"<p>{sentence(RNG.choice([3, 12, 50]))}</p>"


def test_labelling_of_small_pages():
    moved = 0
    for _ in range(150):
        found = H.blocks("<body>" + "".join(piece(2) for _ in range(3)))
        terminals, edges = H.graph(found)
        if len(terminals) > 13:
            continue
        label = H.min_cut(terminals, edges)
        cost = sum(a if not on else b for (a, b), on in zip(terminals, label)) + sum(w for i, j, w in edges if label[i] != label[j])
        assert abs(cost - brute(terminals, edges)) < 1e-6
        moved += sum(on != (a > b) for (a, b), on in zip(terminals[:len(found)], label))
    assert moved > 20  # the edges decide about blocks


def page(words, template):
    """A page and its article's text."""
    body, text = [], []
    for i, n in enumerate(words):
        s = sentence(n)
        text.append(s)
        body.append(f"<p>{s[:20]}<em>{s[20:]}</em></p>" if i % 2 else f"<p>{s}</p>")
    if template % 2:
        head = sentence(3)[:-1]
        text.insert(1, head)
        body.insert(1, f"<h2>{head}</h2>")
    links = "".join(f"<li><a href=/{i}>{sentence(2)[:-1]}</a></li>" for i in range(8))
    main = ("<article>{}</article>", "<main>{}</main>", "<div class='post-body'>{}</div>", "<div id=content><section>{}</section></div>")[template % 4]
    comments = "".join(f"<div class=comment><p>{sentence(40)}</p></div>" for _ in range(3)) if template % 3 else ""
    return (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{links}</ul></nav><div class=cookie-notice><p>{sentence(30)}</p></div>"
            f"{main.format(''.join(body))}<section class=comments><h3>Comments</h3>{comments}</section><aside><p>{sentence(25)}</p></aside>"
            f"<footer><p>{sentence(20)}</p></footer></body></html>"), " ".join(text)


def test_pages_of_known_text():
    right = whole = taken = 0
    for k in range(60):
        html, text = page([RNG.choice([6, 30, 60]) for _ in range(5)], k)
        got, want = H.main_text(html).split(), text.split()
        both = sum(min(got.count(w), want.count(w)) for w in set(want))
        right, whole, taken = right + both, whole + len(want), taken + len(got)
    assert right / whole > 0.99 and right / taken > 0.99


def test_references_end_at_tags():
    assert H.main_text("<article><p>R&am<b>p;</b>D and &lt;b&gt; &amp;amp; caf&eacute;, which is a sentence.</p></article>") == \
        "R&amp;D and <b> &amp; café, which is a sentence."


def test_long_pages_take_time_in_proportion():
    took = []
    for n in (2000, 16_000):
        html = "<body>" + "".join(f"<p>{sentence(8)}</p><ul><li>x{i}</li><li>y</li></ul>" for i in range(n))
        began = time.perf_counter()
        H.main_text(html)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]
