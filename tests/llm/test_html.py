"""Main text: the block reader, the field against all label sequences, held-out layouts and awkward pages."""

import itertools
import math
from random import Random

import numpy as np
import pytest
from colloquy.llm import crf, dom
from colloquy.llm import html_extraction as X
from colloquy.llm.layouts import Material, dressed

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
WORDS = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "am") for b in ("em", "um", "or", "et", "ing", "ed")]


def page(rng, n):
    say = lambda k: " ".join(rng.choices(WORDS, k=k))
    body = "".join(f"<p>{say(rng.randint(1, 40))}.</p>" for _ in range(n))
    return f"<html><title>{say(4)}</title><nav><ul><li><a href=/x>{say(1)}</a></ul></nav><div class=ad>{say(5)}</div><article><h1>{say(4)}</h1>{body}</article><footer>{say(6)}</footer>"


@pytest.fixture(scope="module")
def given(spark):
    rng = Random(1)
    return spark.createDataFrame([(i, f"http://x/{i}", page(rng, rng.randint(1, 8)), "was", "here") for i in range(60)], SCHEMA)


@pytest.fixture(scope="module")
def field(given):
    return X.learn(given)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<p>b<b>c<div>d</p>e</div>f", ["a", "bc", "d", "e", "f"]),
        ("<ul><li>x<ul><li>y<li>z</ul>w<li>v</ul>", ["x", "y", "z", "w", "v"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<a href=/it's>foo</a> it's <a title=\"x>y\">z</a>", ["foo it's z"]),
        ("a <script>var a='</p><p>b';</script>b<style>p{}</style><!-- <p>no -->c<!-- open", ["a bc"]),
        ("<textarea><p>x</textarea>y<noscript>z</noscript><svg><text>t</text></svg>", ["y"]),
        ("a<br>b&nbsp;c&amp;lt;&#x41;&copy \t\n d", ["a b c&lt;A© d"]),
        ("x < y & z <3 </div></p>w<div cla", ["x < y & z <3", "w"]),
        ("", []),
    ],
)
def test_blocks(html, want):
    assert [b.text for b in dom.blocks_of(html, dom.Frames())[1]] == want


def test_decoding_and_chances_against_all_sequences():
    rng = np.random.default_rng(4)
    for n in range(1, 7):
        field = crf.Field({}, rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))
        scores = rng.normal(size=n)
        value = lambda y: field.first[y[0]] + field.last[y[-1]] + sum(scores[i] * y[i] for i in range(n)) + sum(field.pairs[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        every = list(itertools.product((0, 1), repeat=n))
        assert tuple(crf.decoded(scores.tolist(), field)) == max(every, key=value)
        total, chances, together = crf._expected(np.stack([np.zeros(n), scores], 1)[None], np.array([n]), field.pairs, field.first, field.last)
        weights = {y: math.exp(value(y) - total[0]) for y in every}
        assert sum(weights.values()) == pytest.approx(1)
        assert np.allclose(chances[0, :, 1], [sum(w for y, w in weights.items() if y[i]) for i in range(n)])
        assert np.allclose(together, [[sum(w * sum(p == (a, b) for p in zip(y, y[1:])) for y, w in weights.items()) for b in (0, 1)] for a in (0, 1)])


def test_held_out_layouts(field):
    rng = Random(99)
    material = Material([" ".join(rng.choices(WORDS, k=rng.randint(3, 50))) + "." for _ in range(300)], rng)
    right = total = 0
    for _ in range(200):
        html, labels = dressed(material, rng)
        _, blocks = dom.blocks_of(html, dom.Frames())
        assert len(blocks) == len(labels)
        kept = X.main_text(html, field, dom.Frames(frozenset(field.weights)), {}).split("\n\n")
        right += sum((b.text in kept) == bool(y) for b, y in zip(blocks, labels))
        total += len(labels)
    assert right / total > 0.97


def test_a_layout_with_everything_around_the_article(field):
    html = """<!DOCTYPE html><html><head><title>The find - Site</title><script>x("<p>no</p>")</script></head><body>
    <header class="site-header"><div class="logo">Site name</div><form class="search"><input><button>Go</button></form></header>
    <nav class="main-nav"><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept</button></div>
    <div class="content"><div class="post-body"><h1>The find</h1><p>A first paragraph that tells <b>what</b> was found &amp; where, at length.</p>
    <div class="advert">Buy two, get one.</div><p>A second one tells, in more words than the first, who found it and when.</p></div>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I was there, and saw all of it, as told above.</p></div></section></div>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other finds</a></li></ul></aside>
    <footer>© 2024 Site name</footer></body></html>"""
    want = "The find\n\nA first paragraph that tells what was found & where, at length.\n\nA second one tells, in more words than the first, who found it and when."
    assert X.main_text(html, field, dom.Frames(frozenset(field.weights)), {}) == want


def test_extraction(spark, given, field):
    long = "<article>" + "".join(f"<p>{' '.join(WORDS)} {i}.</p>" for i in range(14_000)) + "</article>"
    odd = [(100, None, None), (101, "u", ""), (102, "u", "  \n"), (103, "u", "<script>only</script>"), (104, "u", long), (None, "u", page(Random(3), 3)), (5, "u", page(Random(3), 3)), (5, "u", page(Random(3), 3))]
    found = {}
    for r in X.extracted(given.unionByName(spark.createDataFrame([(*o, "x", "y") for o in odd], SCHEMA)), field).collect():
        found.setdefault(r.page_id, []).append(r)
    assert found[100][0].url is None and [found[i][0].text for i in (100, 101, 102, 103)] == [""] * 4
    assert len(long) > 2 << 20 and found[104][0].text.count("\n\n") == 13_999
    same = [r.text for r in found[None] + [r for r in found[5] if r.url == "u"]]
    assert len(same) == 3 and len(set(same)) == 1 and len(same[0]) > 0
    right = 0
    for r in given.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        want = "\n\n".join(x for x in inner.replace("<h1>", "<p>").replace("</h1>", "</p>").replace("</p>", "").split("<p>") if x)
        got = next(x for x in found[r.page_id] if x.url == r.url)
        right += got.text == want
        assert got.n_chars == len(got.text)
    assert right >= 59


def test_nothing_to_learn_from(spark, given):
    empty = given.limit(0)
    field = X.learn(empty, dressings=30)
    assert X.extracted(empty, field).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in X.extracted(nulls, X.learn(nulls, dressings=30)).collect()] == [(None, None, "", 0)]
    assert X.learn(empty, dressings=0).weights == {}


def test_the_same_pages_give_the_same_field(given):
    a, b = X.learn(given, dressings=20), X.learn(given.repartition(7), dressings=20)
    assert a.weights == b.weights and np.array_equal(a.pairs, b.pairs)
