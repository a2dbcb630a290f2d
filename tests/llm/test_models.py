"""Language, quality and page models: edge cases and held-out accuracy."""

import math
import os
import subprocess
import sys
import time
import zlib
from collections import Counter
from itertools import groupby
from pathlib import Path
from unicodedata import category

import numpy as np
import pytest

from quern.llm import html, langid
from quern.llm.html import DEEPEST, Labeller, Open, blocks, extract_main_text, is_marked, labeller, main_texts, path_vectors, vectors
from quern.llm.html_pages import training_pages
from quern.llm.langid import BUCKETS, CodeClassifier, codewords, has_letter, identify_language
from quern.llm import quality as quality_module
from quern.llm.quality import STATISTICS, BoostedTrees, quality, statistics
from quern.llm.train_labeller import padded, train

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.01"
with_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def fold(doc, folds):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % folds


# language


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 30])
def test_codewords_differ(n):
    code = codewords(n)
    gaps = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert set(code.ravel()) == {-1.0, 1.0} and min(gaps) >= (1 if n == 2 else 2)
    assert (np.abs(code.sum(0)) < n).all()


def test_more_languages_than_have_all_rows(spark, monkeypatch):
    r = np.random.default_rng(3)
    words = [["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(12)] for _ in range(230)]
    # the last ones are rarest
    rows = [(k * 100 + j, " ".join(words[k][(j + i) % 12] for i in range(10)), f"l{k:03}") for k in range(230) for j in range(6 + (k < 200))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = identify_language(df).join(df, "doc_id").collect()
    assert len(got) == len(rows) and sum(g.lang == g.lang_pred for g in got if g.lang >= "l200") >= 175
    monkeypatch.setattr(langid, "MOST", 229)
    with pytest.raises(ValueError, match="230 different labels"):
        identify_language(df)


def test_decoding_equals_brute_force():
    """The language of least total loss over all bits, its share among all, and the doubt, bit by bit."""
    rng = np.random.default_rng(6)
    for n in (2, 3, 5, 9):
        model = CodeClassifier(np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64), [str(k) for k in range(n)])
        bits = model.code.shape[1]
        model.mean = rng.random(BUCKETS).astype(np.float32) * 0.01
        model.weight, model.bias = rng.normal(0, 3, (BUCKETS, bits)).astype(np.float32), rng.normal(0, 1, bits).astype(np.float32)
        x = rng.random((40, BUCKETS)).astype(np.float32) * 0.05
        for row, best, score, doubt in zip(x, *model.predict(x)):
            margins = [sum((float(a) - float(m)) * float(w) for a, m, w in zip(row, model.mean, model.weight[:, k])) + float(model.bias[k]) for k in range(bits)]
            losses = [sum(math.log1p(math.exp(-margin * sign)) for margin, sign in zip(margins, code)) for code in model.code]
            want = min(range(n), key=losses.__getitem__)
            share = math.exp(-losses[want]) / sum(math.exp(-loss) for loss in losses)
            assert best == want and score == pytest.approx(share, abs=1e-3)
            if abs(share - langid.CLEAR) > 1e-3 and abs(losses[want] / bits - langid.FAR) > 1e-3:
                assert doubt == (share < langid.CLEAR or losses[want] / bits >= langid.FAR)


def test_sample_is_bounded_as_a_whole(spark, monkeypatch):
    """All languages are learned, from no more than twice as many rows as the bound."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 60)
    seen = []
    fit = CodeClassifier.__init__
    monkeypatch.setattr(CodeClassifier, "__init__", lambda self, x, y, languages: (seen.append((len(x), len(languages))), fit(self, x, y, languages))[1])
    rows = [(k, f"word{k % 3} " * 5, f"l{k % 6}") for k in range(3000)]
    langid.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", 1000)
    assert seen[0][0] <= 120 and seen[0][1] == 6


def test_wrong_bits_are_corrected():
    model = CodeClassifier(np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64), ["a"])
    assert model.predict(np.zeros((2, BUCKETS), np.float32))[0].tolist() == [0, 0]
    model.languages, model.code = list("abcd"), codewords(4)
    model.weight = np.zeros((BUCKETS, 7), np.float32)
    for k in range(4):
        for wrong in range(7):
            model.bias = (3 * model.code[k]).astype(np.float32)
            model.bias[wrong] *= -1
            assert model.predict(np.zeros((1, BUCKETS), np.float32))[0].tolist() == [k]


def test_has_letter():
    assert has_letter("1 é") and has_letter("日") and not has_letter("12 ²½ _!?") and not has_letter("")


def test_language_edges(edge, edge_rows, nothing):
    got = identify_language(edge).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r[0], fold(r[0], 4) == 2) for r in edge_rows)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)
    unknown = Counter(r.doc_id for r in got if r.lang_pred == "und")
    assert unknown == Counter(r[0] for r in edge_rows if not has_letter(r[1] or ""))
    assert all(r.ambiguous and r.score == 0 for r in got if r.lang_pred == "und")
    assert identify_language(nothing).count() == 0


def test_language_without_labels(spark):
    rows = [(1, "some text", None), (2, None, None), (3, "more", None)]
    got = identify_language(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


@with_data
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = identify_language(docs).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97


# quality


def named(text):
    return dict(zip(STATISTICS, statistics(text)))


def plain_statistics(text):
    """Some of the statistics by their definitions, character by character and word by word."""
    n, words, lines = max(len(text), 1), text.split(), text.split("\n")
    solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
    runs = [list(g) for _, g in groupby(text)]
    runs = [g for g in runs if g[0] not in " \t\n\x0b\x0c\r"]
    out = {c: sum(category(x) == c for x in solid) / n for c in ("Lu", "Ll", "Po", "So", "Cc")}
    out["repeats"] = sum(len(g) - 1 for g in runs) / max(len(solid), 1)
    out["runs"] = sum(len(g) for g in runs if len(g) > 2) / max(len(solid), 1)
    out["longest_run"] = np.log1p(max(map(len, runs), default=0))
    out["distinct_words"] = len(set(words)) / max(len(words), 1)
    out["repeated_words"] = sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1)
    out["bare_words"] = sum(not any(c.isalnum() for c in w) for w in words) / max(len(words), 1)
    out["repeated_lines"] = 1 - len(set(lines)) / len(lines)
    return out


TEXTS = ["", " ", "\n", "a", "A B\nA B", "aaa", "  ", "Some Words! and MORE, 12 ### é\n" * 50, "xx  yyy zzzz\n\nzzzz -- | 日本語 😀😀😀\x00", "!!! !!! !!!", "\x85\u2028a\u2028b"]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_statistics(monkeypatch, block):
    whole = [statistics(text) for text in TEXTS]
    monkeypatch.setattr(quality_module, "BLOCK", block)
    for text, one in zip(TEXTS, whole):
        got = statistics(text)
        assert got == pytest.approx(one) and np.isfinite(got).all() and len(got) == len(STATISTICS)
        for name, value in plain_statistics(text).items():
            assert named(text)[name] == pytest.approx(value), (name, text)


def test_word_ends():
    got = named("Aa bb, 12 +\nAa!")
    assert [got[f"starts_{k}"] for k in "LNPS"] == pytest.approx([0.6, 0.2, 0, 0.2]) and got["capital_starts"] == pytest.approx(0.4)
    assert [got[f"ends_{k}"] for k in "LNPS"] == pytest.approx([0.2, 0.2, 0.4, 0.2]) and got["line_ends_P"] == 0.5


def test_splits_are_the_best_ones():
    """Each node of the first tree has the split of greatest gain among all cuts of its rows."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 2, 300) > 6).astype(float)
    model = BoostedTrees(x, y)
    p = 1 / (1 + np.exp(-model.base))
    slope, curve = p - y, np.full(300, p * (1 - p))
    at = {0: np.arange(300)}
    for node in range(model.feature.shape[1]):
        rows = at[node]
        gains = {}
        for f in range(3):
            for cut in np.unique(x[:, f])[:-1]:
                sides = [rows[x[rows, f] <= cut], rows[x[rows, f] > cut]]
                gains[f, cut] = sum(slope[side].sum() ** 2 / (curve[side].sum() + 1.0) for side in sides) - slope[rows].sum() ** 2 / (curve[rows].sum() + 1.0)
        f, cut = model.feature[0, node], model.threshold[0, node]
        if np.isfinite(cut):
            assert gains[f, cut] == pytest.approx(max(gains.values()))
        else:
            assert max(gains.values()) <= 1e-6 + 1e-9
        at[2 * node + 1], at[2 * node + 2] = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
    leaves = [at[k] for k in range(model.feature.shape[1], 2 * model.feature.shape[1] + 1)]
    assert model.leaf[0] == pytest.approx([-0.2 * slope[rows].sum() / (curve[rows].sum() + 1.0) for rows in leaves])


def test_trees_learn_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = BoostedTrees(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97
    slow = []
    for row in x[3000:3050]:  # the walk over arrays equals a walk node by node
        total = model.base
        for t in range(len(model.leaf)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - model.feature.shape[1]]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(slow, model.score(x[3000:3050]))


def test_trees_without_a_choice():
    none = BoostedTrees(np.empty((0, 2)), np.empty(0))
    assert none.score(np.zeros((3, 2))).tolist() == [0.5] * 3
    one = BoostedTrees(np.ones((5, 2)), np.ones(5))
    assert (one.score(np.zeros((3, 2))) > 0.5).all()
    flat = BoostedTrees(np.ones((6, 2)), np.array([0, 1, 0, 1, 0, 1.0]))
    assert np.allclose(flat.score(np.ones((2, 2))), 0.5)


def test_quality_edges(spark, edge, edge_rows, nothing):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(3, None, 0), (4, 7, 1), (5, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.union(labels), labels.limit(0)):
        got = quality(edge, known).collect()
        assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r[0], fold(r[0], 3) == 1) for r in edge_rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality(nothing, labels).count() == 0


@with_data
def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95


# pages


def texts(page):
    return blocks(page).texts


def innermost(page, k):
    found = blocks(page)
    return found.paths[found.path[k]]


def test_blocks():
    assert texts("<p>a<p>b<br>c <i>d</i></p>e") == ["a", "b c d", "e"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]
    assert texts("<script>x<p>y</script><style>z</style><p>&lt;b&gt; &amp;amp; &eacute;&nbsp;&#233;</p>") == ["<b> &amp; é é"]
    assert texts("a<!-- <p>b</p> -->c<!-- d") == ["ac"]
    assert texts('<p title="a > b">c</p><p title="broken>d</p><a hre') == ["c", "d"]
    assert texts("</p></div>a < b<3</body></html>") == ["a < b<3"]
    assert texts("<title>t &amp; u</title><textarea>v</textarea>w") == ["t & u", "v", "w"]
    assert texts("") == [] and texts("<p> \n</p>") == [] and texts("<script>never closed") == []
    assert innermost("<div><p><b>x<br><p>y</div>", 1)[1:] == ("p", (), "", 2, "")
    assert innermost("<article class='Big-one'><p>x", 0)[1:] == ("p", ("c:big", "c:one"), "article", 2, "")


def test_references_end_at_tags():
    assert texts("a&<b>lt;</b>b") == ["a&lt;b"] and texts("a&am<!-- -->p;") == ["a&amp;"]
    assert texts("a&lt;<i>&amp;lt;</i>") == ["a<&lt;"]


@pytest.mark.parametrize("part", ["<", "<a", "<p title='", "<!--", "</", "<p>x", "<script>", "<div>x", "<div></p>", "<a>y", '<a ">', "&amp", "<span><div>x", "<li><p>x", "<td><ul>x"])
def test_blocks_take_linear_time(part):
    for before in ("", "<p><object>", "<table><tr><ul>"):
        began = time.perf_counter()
        blocks(before + part * 50_000)
        assert time.perf_counter() - began < 10


def test_attributes_take_linear_time():
    began = time.perf_counter()
    for attributes in ("a" * 1_000_000, "a " * 500_000, "a=" * 500_000, "a='" * 300_000, " " * 1_000_000):
        blocks(f"<p {attributes}>x")
    assert time.perf_counter() - began < 10


def test_open_elements_add_up():
    """The sums that are kept up to date equal those made anew from all open elements."""
    r, open_ = np.random.default_rng(8), Open()
    for _ in range(3000):
        if r.random() < 0.55 or not open_.elements:
            open_.push(["div", "p", "b", "article", "nav"][r.integers(5)], ["", ' class="a b"', " id=c"][r.integers(3)])
        else:
            open_.close([["p"], ["div", "nav"], ["b"]][r.integers(3)], [(), ("article",)][r.integers(2)])
        fresh = Open()
        for element in open_.elements:
            for place, sign in element.places:
                fresh.sums[place] += sign
        assert fresh.sums == open_.sums and list(open_.clipped) == [2 + max(-2, min(2, s)) for s in fresh.sums]
        assert open_.named[-1] == next((e.names for e in reversed(open_.elements) if e.names), ())
        assert open_.sections[-1] == next((e.tag for e in reversed(open_.elements) if e.tag in ("article", "nav")), "")


def test_outer_elements_count_at_any_depth():
    deep = "<div>" * 200
    inside, outside = (innermost(f"{start}{deep}<p>text", 0) for start in ("<article class=story>", "<nav class=menu>"))
    assert inside[2:5] == (("c:story",), "article", DEEPEST) and outside[2:5] == (("c:menu",), "nav", DEEPEST)
    assert (path_vectors([inside]) != path_vectors([outside])).any()
    inner = PAGE.replace("<article>", "<article>" + deep).replace("</article>", "</div>" * 200 + "</article>")
    assert main_texts([inner], labeller()) == [TEXT]


def test_page_of_many_blocks_in_little_memory():
    script = (
        "import resource; from quern.llm.html import labeller, main_texts; "
        "text = main_texts(['<article>' + '<p>x' * (1 << 20)], labeller())[0]; "
        "print(len(text), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)"
    )
    chars, peak = map(int, subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split())
    assert peak < 1000 and chars <= 3 * (1 << 20)


def test_gradients():
    rng = np.random.default_rng(0)
    net = Labeller()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, live = padded([rng.normal(size=(n, net.p["xf"].shape[0])).astype(np.float32) for n in (3, 5, 1)])
    y = (rng.random(live.shape) > 0.5).astype(np.float64)
    _, g = net.gradients(x, live, y)
    for name in ("xf", "hf", "bf", "xb", "hb", "bb", "out"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old, losses = net.p[name][at], []
        for step in (1e-3, -1e-3):
            net.p[name][at] = old + step
            losses.append(net.gradients(x, live, y)[0])
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-3)


def test_generated_pages():
    net = labeller()
    made = [page for page in map(blocks, training_pages(300, seed=77)) if page.texts]
    together = net.score(made[:20])
    assert all(np.allclose(a, net.score([page])[0], atol=1e-5) for page, a in zip(made, together))
    right = [(net.score([page])[0] >= 0.5) == (is_marked(page) > 0) for page in made]
    assert np.concatenate(right).mean() > 0.985


def test_scores_equal_those_of_whole_vectors(monkeypatch):
    """Chunks, shared path vectors and padding change nothing."""
    net, made = labeller(), [blocks(p) for p in training_pages(40) if blocks(p).texts][:30]
    for page in made:
        x, live = padded([vectors(page)])
        both = np.concatenate([net._run(x @ net.p["x" + side] + net.p["b" + side], live, side)[0] for side in "fb"], 2)
        whole = 1 / (1 + np.exp(-(both @ net.p["out"] + net.p["out_b"])[:, 0, 0]))
        monkeypatch.setattr(html, "AT_ONCE", 7)
        assert np.allclose(net.score([page])[0], whole, atol=1e-5)
        monkeypatch.undo()


def test_training_again_gives_the_weights():
    again, kept = train(), labeller()
    made = [page for page in map(blocks, training_pages(200, seed=78)) if page.texts]
    same = [(again.score([page])[0] >= 0.5) == (kept.score([page])[0] >= 0.5) for page in made]
    assert np.concatenate(same).mean() > 0.999
    assert all(np.allclose(again.p[name], kept.p[name], atol=0.05) for name in kept.p)


PAGE = (
    '<html><head><title>T</title></head><body><div class="cookie-notice"><p>We use cookies.</p></div><header><a href="/">Site</a></header>'
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>A title &amp; more</h1><p>The first part of the text, which goes on.</p>"
    '<div class="ad">Buy this now!</div><p>The second   part\nof it.</p></article><section id="comments"><h3>Comments</h3><div class="comment"><p>I agree with this.</p></div></section>'
    "<aside><h4>Related</h4><ul><li><a href=/c>Other</a></ul></aside><form><label>Email</label><button>Send</button></form><footer>&copy; Site</footer><script>x()</script></body></html>"
)
TEXT = "A title & more\n\nThe first part of the text, which goes on.\n\nThe second part of it."


def test_extract(spark):
    rows = [(1, "u", PAGE, 0), (2, None, None, 0), (3, "v", "", 0), (4, "w", "<p>", 0), (1, "u", PAGE, 0), (None, "x", PAGE, 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(df).collect())
    assert got == Counter({(1, "u", TEXT, len(TEXT)): 2, (2, None, "", 0): 1, (3, "v", "", 0): 1, (4, "w", "", 0): 1, (None, "x", TEXT, len(TEXT)): 1})
    assert extract_main_text(df.limit(0)).count() == 0


def test_long_and_many_pages():
    page = "<article>" + "".join(f"<p>Paragraph {k} says something of note.</p>" for k in range(3000)) + "</article>"
    got = main_texts([page, None, PAGE, "", PAGE], labeller())
    assert got[0].count("\n\n") == 2999 and got[2] == got[4] == TEXT and got[1] == got[3] == ""


@with_data
def test_pages_of_the_table(spark):
    import re
    from html import unescape

    got = {r.page_id: r for r in extract_main_text(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    right = 0
    for row in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        right += got[row.page_id].text == "\n\n".join(x for x in parts if x)
    assert right >= 0.99 * len(got)
