import numpy as np
import pytest

from treeline.llm import html_blocks as H

SF = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in H.blocks_of(page)]


@pytest.mark.parametrize(("page", "want"), [
    ("", []),
    ("plain &amp; text", ["plain & text"]),
    ("<p>a<br>b<p>c <b>d</b>\n e</p>", ["a b", "c d e"]),
    ("<script>var t='</p>';</script><p>x</p><style>p{}</style>y", ["x", "y"]),
    ("<!-- <p>no</p> --><p title='a > b'>yes</p><!-- open", ["yes"]),
    ("<p>1 < 2 &lt; 3 &#65; &eacute;&unknown;</p>", ["1 < 2 < 3 A é&unknown;"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
    ("<div>a<div>b</div>c</div></div></p>d", ["a", "b", "c", "d"]),
    ("<title>no</title><textarea><p>no</textarea>t", ["t"]),
    ("<a href=\"x>y\">l</a><img alt='>'>m", ["lm"]),
    ("<a href=\"unbalanced>text</a> after", ["text after"]),
    ("<SCRIPT>no</Script >İ<p>YES", ["İ", "YES"]),
    ("<script>never closed <p>no</p>", []),
    ("<![CDATA[a & b]]>", ["a & b"]),
])
def test_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize(("page", "want"), [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, thus</p><p>b", ["so x=1, thus", "b"]),
    ("<p>a<svg><title>no</title><text>t</text><svg></svg></svg>b</p><p>c", ["a t b", "c"]),
    ("<noscript><p>shown</p></noscript><template><div>kept</div></template>", ["shown", "kept"]),
    ("<p>a <object>x <object>y</object> z</object> b", ["a x y z b"]),
    ("<div>a<xmp><p>1 &amp; 2</xmp>b</div>", ["a", "<p>1 &amp; 2", "b"]),
    ("<form><select><option>1<option>2</form><p>rest", ["1 2", "rest"]),
    ("<article><select><option>1<option>2<p>rest</p>end</article>", ["1 2", "rest", "end"]),
    ("<p>a <select><optgroup label=x><option>1</select> b", ["a", "1", "b"]),
    *[(f"<div>a <{t}> x</div><p>rest", ["a x", "rest"]) for t in ("object", "svg", "math", "template", "noscript")],
])
def test_only_raw_text_is_skipped(page, want):
    assert texts(page) == want


def test_names_of_elements_around():
    a, b, c = H.blocks_of("<template><p>a</p></template><select><option>b</select><article><select><option><p>c</article>")
    assert "template" in a.path and {"select", "option"} <= set(b.path) and c.path == ("article", "p")


def test_paths_and_links():
    a, b = H.blocks_of("<div class='Side-Bar x'><a href='/'>link</a></div><main id=top><p>text</main>")
    assert {"div", "side", "bar", "x"} <= set(a.path) and a.linked == 1
    assert b.path == ("main", "top", "p") and b.linked == 0


def test_odd_pages_take_linear_time():
    for page in ("<" * 200_000, "<a '" * 50_000, "<p>" * 50_000, "<div>" * 3000 + "x", "&" * 200_000, "<!--" * 50_000):
        H.blocks_of(page)


def test_gradients():
    """Back-propagation against finite differences."""
    rng = np.random.default_rng(0)
    pages = [rng.normal(size=(n, H.SIZE)).astype(np.float32) for n in (3, 5)]
    x, mask = H._padded(pages)
    w = H.fresh()
    hs, kept = H._pass(x, mask, w.w[0], w.u[0], w.b[0], True)
    direction = rng.normal(size=hs.shape).astype(np.float32) * mask[:, :, None]
    d_w, d_u, d_b = H._back(x, mask, w.w[0], w.u[0], kept, direction)
    for array, slope, at in ((w.u[0], d_u, (2, 7)), (w.u[0], d_u, (5, 60)), (w.w[0], d_w, (9, 30)), (w.b[0], d_b, (80,))):
        old, ends = array[at], []
        for step in (1e-2, -1e-2):
            array[at] = old + step
            ends.append(float((H._pass(x, mask, w.w[0], w.u[0], w.b[0], False)[0].astype(float) * direction).sum()))
        array[at] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - slope[at]) < 2e-2 * max(1, abs(slope[at]))


@pytest.fixture(scope="module")
def learned(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    return pages, H.learn(pages)


def test_given_pages(learned):
    """Every page, though the fit has seen only some, against its own landmarks."""
    pages, weights = learned
    for r in H.main_text(pages, weights, also=("html",)).collect():
        blocks = H.blocks_of(r.html)
        want = H.landmarks(blocks)
        assert r.text == "\n".join(b.text for b, w in zip(blocks, want) if w)


def test_built_pages_of_other_shapes(learned):
    pages, weights = learned
    texts = [b.text for r in pages.limit(40).collect() for b in H.blocks_of(r.html)]
    rng, wrong, all_ = np.random.default_rng(99), 0, 0
    for _ in range(200):
        page, article = H.built_page(rng, texts)
        blocks = H.blocks_of(page)
        labels = H._labelled(blocks, article)
        if labels.sum() == len(article):
            wrong += int(((H.probabilities(weights, [H.features(blocks)])[0] >= 0.5) != labels).sum())
            all_ += len(blocks)
    assert wrong <= 0.02 * all_


def test_long_article(learned):
    pages, weights = learned
    body = "".join(f"<p>Sentence {i} of a long and even text, with a point.</p>" for i in range(3000))
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title of it</h1>{body}</article><footer>&copy; x</footer></body></html>"
    blocks = H.blocks_of(page)
    p = H.probabilities(weights, [H.features(blocks)])[0] >= 0.5
    assert p.tolist() == [False] + [True] * 3001 + [False]


def test_formulas_and_open_lists_in_articles(spark, learned):
    _, weights = learned
    page = """<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title of the text</h1>
<p>From <math><mi>a</mi><mo>=</mo><mi>b</mi></math> follows the first sentence of it.</p><select><option>Red<option>Green
<p>The rest of the article stands behind an open list.</p></article><footer>&copy; x</footer></body></html>"""
    frame = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert H.main_text(frame, weights).first().text == (
        "Title of the text\nFrom a=b follows the first sentence of it.\nThe rest of the article stands behind an open list.")


def test_odd_tables(spark, learned):
    _, weights = learned
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav>x</nav>"), (2, None, "")]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = H.main_text(frame, weights)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(str(r.page_id) for r in got.collect()) == sorted(str(r[0]) for r in rows)
    assert {r.text for r in got.collect()} == {""}
    assert H.main_text(frame.limit(0), weights).count() == 0
