"""Language ID, HTML extraction and nearest neighbours: held-out accuracy, brute force, odd rows."""

import math
import zlib

import numpy as np
import pytest
from odd import ODD_ROWS
from hypothesis import given, settings
from hypothesis import strategies as st
from parapet.llm import html_text, labeller, language, nearest
from parapet.llm.blocks import blocks
from parapet.llm.queries import QUERIES
from pyspark.sql import functions as F


# Language

def test_held_out_accuracy(spark, data):
    rows = {r.doc_id: r for r in QUERIES["op9_language"](spark, data).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_filters_have_no_false_negatives_and_known_false_rate():
    rng = np.random.default_rng(1)
    known = {name: rng.integers(0, 1 << 63, 9000, np.uint64) for name in ("a", "b", "c")}
    model = language.build(known, "b")
    strange = rng.integers(0, 1 << 63, 50_000, np.uint64)
    for i, name in enumerate(model.languages):
        def bits(values):
            mask = np.bitwise_and.reduce([model.slots[at] for at in language._slots(values)])
            return (mask[:, 0] & np.uint8(1 << i)) != 0  # noqa: B023
        assert bits(known[name]).all()
        assert abs(bits(strange).mean() - model.false_rate[i]) < 0.003


def test_long_texts_in_pieces(monkeypatch):
    text = "le chat " * 900 + "der Hund " * 1200
    model = language.build({n: np.concatenate([v for v, _ in language.all_grams(*next(language.pieces([t])))]) for n, t in (("fr", "le chat le"), ("de", "der Hund der"))}, "fr")
    whole = language.predict(model, [text, None, "7", "le chat"])
    monkeypatch.setattr(language, "PIECE", 100)
    parts = language.predict(model, [text, None, "7", "le chat"])
    assert whole[0] == parts[0] == ["de", "und", "und", "fr"] and max(abs(a - b) for a, b in zip(whole[1], parts[1])) < 0.05
    assert language.predict(model, ["zzz"])[0] == ["fr"] and language.predict(model, ["zzz"])[1] == [0.0]


def test_language_of_odd_rows(documents):
    train = [(i, "the cat sat on the mat" if i % 2 else "die katze sitzt auf dem dach", "en" if i % 2 else "de", "s") for i in range(100, 160)]
    df = documents([*ODD_ROWS, *train], clashes=True)
    out = df.select("doc_id", "text", language.identify(df, language.learn(df)).alias("t")).collect()
    for r in out:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.t.lang_pred, r.t.score) == ("und", 0.0)
        else:
            assert r.t.lang_pred in ("en", "de")
    assert all(r.t.lang_pred == ("en" if r.doc_id % 2 else "de") for r in out if r.doc_id and r.doc_id >= 100)
    bare = documents([(1, "word", None, None)])
    assert bare.select(language.identify(bare, language.learn(bare)).alias("t")).first().t.lang_pred == "und"
    empty = documents([])
    assert empty.select(language.identify(empty, language.learn(empty))).collect() == []


# HTML

@pytest.mark.parametrize(("page", "texts"), [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b &lt; c &amp d", ["a", "b < c & d"]), ("<p><b>x<br>y</b> z</p>", ["x y z"]), ("a <!-- <p> --> b", ["a b"]),
    ("<script>var a='<p>';</script>t<style>x", ["t"]), ("1 < 2 and <3", ["1 < 2 and <3"]), ("<div>a<span>b</span>c</div>", ["abc"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<p>&nbsp;\n\t</p><p>q", ["q"]), ("<!-- open", []), ("x<a href='u'", ["x<a href='u'"]),
])
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<>/!- abpdiv&;=\"'"), max_size=80))
def test_any_markup_is_read(page):
    assert all(b.text == " ".join(b.text.split()) and b.text for b in blocks(page))


def test_gradients():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(n, labeller.INPUTS)).astype(np.float32) for n in (3, 1, 5)]
    y = [np.array([1, 0, np.nan]), np.array([1.0]), np.array([0, 1, 1, np.nan, 0])]
    loss = lambda w: -sum(np.nansum(np.log(np.where(b == 1, p, 1 - p)) * (b == b)) for p, b in zip(_each(w, x), y))
    before = labeller.Weights.fresh(5)
    after = labeller.train(x, y, epochs=25, size=2)
    assert loss(after) < 0.2 * loss(before)
    for a, b in zip(_each(after, x), _each(after, [*x, rng.normal(size=(9, labeller.INPUTS)).astype(np.float32)])):
        assert np.allclose(a, b, atol=1e-5)  # padding changes nothing


def _each(w, pages):
    x, lengths = labeller._batch(pages)
    out, _ = labeller.forward(w, x, lengths)
    return [out[i, :n].astype(float) for i, n in enumerate(lengths)]


@pytest.fixture(scope="module")
def weights(spark, data):
    return html_text.learn(spark.read.parquet(f"{data}/pages.parquet"))


def test_main_text_of_the_tables(spark, data, weights):
    """Held against the pages' own article elements, which the labeller sees only as hashed paths."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = QUERIES["op7_html_text"](spark, data).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        want = "\n".join(b.text for b in blocks(html[r.page_id] or "") if "article" in b.path)
        assert r.text == want and r.n_chars == len(want)


def test_parts_that_the_tables_lack(weights):
    body = "".join(f"<p>Sentence number {i} of the story goes on, and on, until it ends.</p>" for i in range(6))
    page = (
        f"<html><body><header><p>The Site</p></header><div class='cookie'>We use cookies.</div><main><h1>A title</h1>{body}"
        "<section class='comments'><div class='comment'><p>First!</p></div></section></main><aside>Popular</aside><form><label>Mail</label></form></body></html>"
    )
    text = html_text.main_texts(weights, [page], {})[0]
    assert text == "A title\n" + "\n".join(f"Sentence number {i} of the story goes on, and on, until it ends." for i in range(6))


def test_html_of_odd_rows(spark, weights):
    long = "<article>" + "".join(f"<p>Part {i} of a very long page.</p>" for i in range(9000)) + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", long), (3, "u", long), (None, None, "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    out = pages.select("page_id", html_text.extract(pages, weights).alias("t")).collect()
    assert [r.t for r in out if r.page_id in (1, 2)] == ["", ""]
    assert all(len(r.t.split("\n")) == 9000 for r in out if r.page_id == 3)
    empty = pages.limit(0)
    assert empty.select(html_text.extract(empty, html_text.learn(empty))).collect() == []


# Neighbours

def brute_nearest(rows, k, is_query):
    out = []
    for q, v in rows:
        if is_query(q):
            found = sorted(((-float((np.array(x, float) * np.array(v, float)).sum()), i) for i, x in rows if i != q and len(x) == len(v)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def same(got, want):
    got, want = sorted(got), sorted(want)
    return [g[:3] for g in got] == [w[:3] for w in want] and all(math.isclose(g[3], w[3], rel_tol=1e-12, abs_tol=1e-12) for g, w in zip(got, want))


def test_neighbours_of_the_tables(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert same(map(tuple, QUERIES["op8_nearest"](spark, data).collect()), brute_nearest(rows, 20, lambda i: i % 20 == 0))


def test_neighbours_in_small_tiles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * 10.0 ** rng.integers(-3, 4))]) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 3.0]) for i in range(40)] + [(300, [1.0, 2.0]), (301, [3.0, 4.0]), (302, [2.0, 1.0])]
    bad = [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [float("nan")] * 6), (405, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<float>").withColumn("vector", F.lit("x")).withColumn("block", F.lit(1))
    got = nearest.search(df, F.col("vec_id") % 3 == 0, k=7, query_block=11, candidate_block=17)
    assert same(map(tuple, got.collect()), brute_nearest(rows, 7, lambda i: i % 3 == 0))
    assert nearest.search(df.limit(0), F.col("vec_id") % 3 == 0).collect() == []


def test_vectors_that_share_an_id(spark):
    """Different vectors of one id are rows of their own; equal rows count once."""
    rows = [(20, [1.0, 0.0]), (1, [9.0, 0.0]), (1, [0.1, 0.0]), (1, [9.0, 0.0]), (20, [3.0, 1.0]), (2, [2.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in nearest.search(df, F.col("vec_id") % 20 == 0, k=3).collect())
    want = [(20, 1, 1, 9.0), (20, 1, 1, 27.0), (20, 2, 2, 11.0), (20, 2, 20, 3.0), (20, 3, 2, 2.0), (20, 3, 20, 3.0)]
    assert got == want


@pytest.mark.parametrize(("page", "texts"), [
    ('<p>One <img alt="a > b"> two</p>', ["One two"]), ('<a title="x > y">t</a>', ["t"]), ("<p title='a \"> b'>t</p>u", ["t", "u"]),
    ('<a title="x < y and <b>">t</a> u', ["t u"]), ("<p title=it's>a</p><p>it's > b</p>", ["a", "it's > b"]),
    ('<p title="open>a</p><p>b</p>', ["a", "b"]), ("<p a = \"1>2\" b='3>4' c=5>t", ["t"]), ('x = "<b>y</b>"', ['x = "y"']),
])
def test_quoted_values(page, texts):
    assert [b.text for b in blocks(page)] == texts


@pytest.mark.parametrize(("page", "want"), [
    ("<td><nav><table><tr><td>menu", {"menu": "nav"}), ("<li><article>a<ul><li>b<li>c</ul>d", dict.fromkeys("abcd", "article")),
    ("<article><table><tr><td>a</div><td>b<tr><td>c</table>d</article>", dict.fromkeys("abcd", "article")),
    ("<dl><dt>a<dd><article>b<dl><dt>c<dd>d</dl>e</article></dl>", dict.fromkeys("bcde", "article")),
    ("<article><p>a<div>b</div>c</article>", dict.fromkeys("abc", "article")), ("<nav><ul><li>a</li></ul></nav><li>b", {"a": "nav"}),
])
def test_ancestors_of_nested_lists_and_tables(page, want):
    found = {b.text: b.path for b in blocks(page)}
    assert all(part in found[text] for text, part in want.items())
    assert all(part not in path for text, path in found.items() if text not in want for part in want.values())


def test_siblings_end_each_other():
    found = {b.text: b.path for b in blocks("<ul><li class=x>a<li>b</ul><table><tr class=r><td class=y>c<td>d<tr><td>e</table><p class=z>f<p>g")}
    assert ".x" in found["a"] and ".x" not in found["b"] and ".y" in found["c"] and ".y" not in found["d"]
    assert ".r" in found["d"] and ".r" not in found["e"] and ".z" in found["f"] and ".z" not in found["g"]


def test_whole_stack_and_all_names():
    """An ancestor is seen from any depth and a name after any number of others."""
    deep = "<article class='" + " ".join(f"u{i}" for i in range(30)) + " last'>" + "<div><span>" * 200 + "deep"
    (block,) = blocks(deep)
    assert "article" in block.path and ".last" in block.path and len(block.path) == 34
    many = blocks("<div>" * 20_000 + "<p>x</p>" * 2000)
    assert len(many) == 2000 and all(b.path == ("div", "p") for b in many)


def test_sample_is_drawn_from_pages_that_tell(spark, monkeypatch):
    """A few pages with parts among many without: the labeller still learns from them."""
    telling = "<nav>Home page links</nav><article><p>This is the story, told at length.</p></article><footer>All rights</footer>"
    rows = [(i, f"u{i}", telling if i % 50 == 0 else "<div>nothing tells here</div>") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    monkeypatch.setattr(html_text.labeller, "train", lambda x, y, **k: seen.append(len(y)) or labeller.Weights.fresh(1))
    html_text.learn(pages, sample=12)
    assert seen == [36]
