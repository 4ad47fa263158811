import re
import time
from html import unescape
from zlib import crc32

import numpy as np
import pytest

from fathomgraph.llm import blocks as B

PAGES = "page_id bigint, url string, html string, text string, n_chars bigint, label int"


@pytest.fixture(scope="module")
def model(spark):
    return B.fitted(spark)


def texts(page):
    return [b.text for b in B.blocks(page)]


def test_blocks_of_awkward_pages():
    assert texts("") == [] and texts("plain  text\nonly") == ["plain text only"]
    assert texts("<p>a<b>b</b> c<p>d<br>e<li>f<li>g</ul>h") == ["ab c", "d", "e", "f", "g", "h"]
    assert texts("<script>if (a<b) '<p>x'</script>y<!-- <p>no --><style>z</style><title>t</title>w") == ["yw"]
    assert texts("a &lt;b&gt; &amp;amp; &#65;&nbsp;x < 3 <3 </>") == ["a <b> &amp; A x < 3 <3"]
    assert texts('<div title="a>b">c</div><div title=\'>\'>d') == ["c", "d"]
    assert texts('<div title="never closed>a</div>b<p>c') == ["a", "b", "c"]
    assert texts("a<script>rest") == ["a"] and texts("<svg>a<p>b") == ["a", "b"] and texts("<noscript>a</noscript>b") == ["b"]
    assert texts("x</div></p>y<") == ["x", "y<"]
    path = [b.path for b in B.blocks("<ul class='Main-menu' id=top><li>a<ul><li>b</ul><li>c</ul>d")]
    assert path[0] == (("<li",), (("<ul", "main", "menu", "top"), None)) and path[2] == path[0] and path[1][1][1] == path[0] and path[3] is None


def test_long_and_hostile_pages_take_linear_time():
    start = time.time()
    for page in ("<div>" * 60_000 + "x", "<p>a" * 60_000, '<a b="' * 60_000, "<!--" * 60_000, "<svg>" * 60_000, "</p>" * 60_000, "<" * 200_000, "<p>" + "w " * 400_000):
        B.blocks(page)
    assert time.time() - start < 20


def test_gradients_are_the_slopes_of_the_loss(monkeypatch):
    rng = np.random.default_rng(1)
    model = B.Labeller(3)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    x = rng.standard_normal((5, 3, B.DIMS))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], dtype=float)
    labels = (rng.random((5, 3)) < 0.5) * mask
    _, grad = model.gradients(x, mask, labels)
    for name, w in model.weights.items():
        for _ in range(3):
            at = tuple(rng.integers(n) for n in w.shape)
            keep = w[at]
            w[at] = keep + 1e-2
            up = model.gradients(x, mask, labels)[0]
            w[at] = keep - 1e-2
            down = model.gradients(x, mask, labels)[0]
            w[at] = keep
            assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-4 + 0.02 * abs(grad[name][at])


def test_padding_and_batches_change_nothing(model):
    rng = np.random.default_rng(5)
    pages = [B.labelled(B.sample_page(rng)) for _ in range(12)]
    together = B.label_pages(model, pages)
    for page, kept in zip(pages, together):
        assert (B.label_pages(model, [page])[0] == kept).all()


def test_held_out_pages(model):
    rng = np.random.default_rng(2024)
    pages = [p for p in (B.labelled(B.sample_page(rng)) for _ in range(300)) if p]
    right = total = 0
    for page, kept in zip(pages, B.label_pages(model, pages)):
        right += int((kept == np.array([b.label for b in page])).sum())
        total += len(page)
    assert right / total > 0.985


OTHER = """<html><body><div id="hd"><a href="/">Home</a></div><div class="cookie-bar">We use cookies to make this site better. Accept all</div>
<div class="sidebar-left"><h4>Most read</h4><ul><li><a href=1>Storm at sea</a><li><a href=2>Quiet hills</a></ul></div>
<div class="story"><h1>The long road north</h1><p>We left before the sun was up, and nobody spoke until the river.
<div class="advert"><p>Buy now and save</p></div><p>Later, near the bridge, an old man told us that the road was closed.</p><p>Silence.</p></div>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Anna says:</p><p>What a lovely walk that must have been, thank you.</p></div></section>
<form action=x><label>Email</label><input><button>Send</button></form><div class="footer">&copy; 2020 The Walker. All rights reserved.</div></body></html>"""


def test_a_page_written_by_hand(model):
    page = B.blocks(OTHER)
    kept = [b.text for b, keep in zip(page, B.label_pages(model, [page])[0]) if keep]
    assert kept == [
        "The long road north", "We left before the sun was up, and nobody spoke until the river.",
        "Later, near the bridge, an old man told us that the road was closed.", "Silence.",
    ]


def test_given_pages(spark, model):
    """On the given pages the article element is the truth; the labeller sees it only as one more name of a path."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {}
    for r in pages.collect():
        body = "".join(re.findall(r"(?s)<article>(.*?)</article>", r["html"]))
        truth[r["page_id"]] = " ".join(unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())
    got = {r["page_id"]: r for r in B.extract_pages(pages, model).collect()}
    assert set(got) == set(truth)
    assert sum(got[k]["text"] == truth[k] for k in truth) >= 0.99 * len(truth)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_empty_null_and_repeated_rows(spark, model):
    rows = [(1, "u", OTHER, "x", 5, 1), (1, "u", OTHER, "x", 5, 1), (2, None, None, "x", 5, 1), (3, "v", "", None, None, None), (None, "w", "<nav><a>Home</a></nav>", "", 0, 0)]
    out = B.extract_pages(spark.createDataFrame(rows, PAGES), model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in out.collect()), key=str)
    assert [g[:2] for g in got] == [(0, "w"), (1, "u"), (1, "u"), (2, None), (3, "v")]
    assert got[0][2:] == got[3][2:] == got[4][2:] == ("", 0) and got[1] == got[2] and got[1][3] > 100
    assert B.extract_pages(spark.createDataFrame([], PAGES), model).collect() == []
    long = "<article>" + "".join(f"<p>Sentence number {k} of a very long page, which goes on." for k in range(20_000)) + "</article>"
    one = B.extract_pages(spark.createDataFrame([(9, "l", long, "", 0, 0)], PAGES), model).first()
    assert one["n_chars"] > 0.99 * 20_000 * 50


def test_features_take_every_word_of_a_block():
    words = [f"word{k}" for k in range(60)]
    at = slice(B.PATH_DIMS + B.OWN_DIMS, B.PATH_DIMS + B.OWN_DIMS + B.WORD_DIMS)
    whole, other = (B.features(B.blocks(f"<p>{' '.join(w)}</p>"), B._Paths())[0][at] for w in (words, words[:30] + ["changed"] + words[31:]))
    assert (whole != other).any()


def test_each_word_of_a_page_is_hashed_once(monkeypatch):
    page = B.blocks(f"<p>{' '.join(f'w{k}' for k in range(30_000))}</p>" * 2)
    calls = []
    monkeypatch.setattr(B, "crc32", lambda *a: calls.append(0) or crc32(*a))
    rows = B.features(page, B._Paths())
    at = slice(B.PATH_DIMS + B.OWN_DIMS, B.PATH_DIMS + B.OWN_DIMS + B.WORD_DIMS)
    assert len(calls) < 3 * 30_100 and (rows[0, at] == rows[1, at]).all()


def test_features_equal_plain_loops():
    rng = np.random.default_rng(11)
    words_at = B.PATH_DIMS + B.OWN_DIMS
    known, paths = B._Words(), B._Paths()
    assert B.features([], paths).shape == (0, B.DIMS)
    for page in [p for p in (B.blocks(B.sample_page(rng)[0]) for _ in range(30)) if p]:
        for k, (row, block) in enumerate(zip(B.features(page, paths, known), page)):
            words = block.text.lower().split()
            want = np.zeros(B.DIMS)
            names, path = [], block.path
            while path is not None:
                names, path = [path[0], *names], path[1]
            for own in names:
                want[B.PATH_DIMS : words_at] = 0
                for name in own:
                    for place, sign in (*B._places(name, B.PATH_DIMS, 0), *B._places(name, B.OWN_DIMS, B.PATH_DIMS)):
                        want[place] += sign
                want[:words_at] = np.clip(want[:words_at], -3, 3)
            for word in words:
                for place, sign in B._places(word.strip(".,;:!?()[]\"'"), B.WORD_DIMS, words_at):
                    want[place] += sign / np.sqrt(len(words))
            n = len(block.text)
            want[-B.MEASURES :] = (
                np.log1p(len(words)) / 4, np.log1p(n) / 6, block.link / n, block.text.endswith(B._SENTENCE_END), len(words) == 1, "©" in block.text,
                sum(block.text.count(c) for c in ",.;:") / len(words) / 2, block.text[0].isupper(), block.text[0].isdigit(), k == 0, k / len(page), np.log1p(len(page)) / 5,
            )
            assert np.allclose(row, want, atol=1e-5)
