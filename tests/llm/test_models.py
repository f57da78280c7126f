"""Language ID, extraction, mixing, media, archives, the pipeline."""

import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from wharfline.llm import html_extract, jpeg_media, langid, mixing, queries, warc

ROOT = Path(__file__).resolve().parent.parent.parent


def test_language_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_langid(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    words = {"aa": "lorem ipsum dolor ", "bb": "xyzzy quux wqwq "}
    rows = [(i, words[lang] * (3 + i % 5), lang) for i in range(60) for lang in words] + [(900, None, "aa"), (901, "1234 !!", "aa"), (902, words["aa"] * 9000, None), (903, "", None), (904, "é", "bb"), (905, words["bb"], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit_documents(docs)
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.predict(docs, model).where("doc_id >= 900").collect()}
    assert [got[k] for k in (900, 901, 903)] == [("und", True)] * 3
    assert (got[902][0], got[905][0]) == ("aa", "bb")
    assert got[904][0] in words
    kept = langid.keep_accepted(docs, model)
    assert kept.columns == docs.columns and {900, 901, 903}.isdisjoint(r.doc_id for r in kept.collect())


def test_numbers_are_no_letters(spark):
    rows = [(i, "lorem ipsum dolor " * 5 if i % 2 else "xyzzy quux wqwq " * 5, "aa" if i % 2 else "bb") for i in range(40)] + [(900, "½ 12 ²", None), (901, "① Ⅳ", None), (902, "½ ж", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit_documents(docs)).where("doc_id >= 900").collect()}
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] != "und"


def test_workers_need_no_copy_of_the_package(sf, tmp_path):
    """The package is on the driver's path only, as on a cluster whose executors have the usual packages alone."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__
from wharfline.session import build_session
spark = build_session("local[2]", "alone", spark__sql__shuffle__partitions="2", spark__checkpoint__dir="file://{tmp_path}", spark__ui__showConsoleProgress="false")
for name in ("op3_langid", "op8_warc", "op9_html", "op11_simhash", "op12_repair", "op13_search"):
    assert __spark_entry__.queries()[name](spark, {sf!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-2000:]


def test_language_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (langid.fit_documents(d) for d in (docs, docs.repartition(5)))
    assert np.array_equal(a.table, b.table) and a.least == b.least


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert tuple(langid.predict(docs, langid.fit_documents(docs)).first()) == (1, "und", 0.0, True)
    assert langid.predict(docs.limit(0), langid.fit_documents(docs.limit(0))).count() == 0


def test_threshold_is_calibrated():
    scores = np.array([[0.9, 0.1], [0.8, 0.2], [0.7, 0.3], [0.6, 0.4]])
    assert langid.threshold(scores, np.array([0, 0, 0, 0])) == 0.0
    assert langid.threshold(scores, np.array([0, 0, 1, 1])) == 0.8
    assert langid.threshold(scores, np.array([1, 1, 1, 1])) == 1.0


def plain_scores(model, text):
    """Subword by subword, in Python."""
    data = text.encode().translate(langid.FOLD)
    total, n = np.zeros(langid.DIMENSION), 0
    for size in langid.SIZES:
        for i in range(len(data) - size + 1):
            h = data[i]
            for c in data[i + 1 : i + size]:
                h = (h * 0x01000193 ^ c) & 0xFFFFFFFF
            total += model.table[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17]
            n += 1
    z = (total / max(1, n) @ model.layer + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def test_language_equals_plain_scorer(spark, sf, monkeypatch):
    """Predictions are those of a scorer that goes through one subword after another, whatever the size of pieces."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit_documents(docs)
    rows = docs.where("length(text) < 3000").limit(40).collect()
    for size in (langid.BLOCK_BYTES, 50):
        monkeypatch.setattr(langid, "BLOCK_BYTES", size)
        got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, docs.schema).repartition(2), model).collect()}
        for r in rows:
            if got[r.doc_id].lang_pred != "und":
                p = plain_scores(model, r.text or "")
                assert got[r.doc_id].lang_pred == model.languages[int(p.argmax())]
                assert got[r.doc_id].score == pytest.approx(float(p.max()), abs=1e-5)
                assert got[r.doc_id].rejected == bool(got[r.doc_id].score < model.least)


def test_blocks_of_empty_texts(spark, sf):
    model = langid.fit_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    for texts in ([b""], [b"", b""], [b"a"], [b"", b"abc"]):
        assert langid.score_block(model, texts).shape == (len(texts), len(model.languages))


def test_every_label_is_learned(spark):
    """201 labels with words of their own; repeated rows and extra columns too."""
    word = lambda k: "".join("abcdefghijklmnopqrstuvwxyz"[k // 26**j % 26] * 2 for j in range(3))
    rows = [(k * 10 + i, f"{word(k * 7)} " * (5 + i), f"l{k}") for k in range(201) for i in range(4)]
    docs = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    model = langid.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert len(model.languages) == 201
    assert langid.predict(docs, model).count() == len(rows) + 5


def test_junk_is_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit_documents(docs)
    assert model.least > 1 / len(model.languages)
    kept = langid.keep_accepted(docs, model).count()
    assert kept > 0.97 * docs.where("regexp_like(text, '[a-zA-Z]')").count()


# --- extraction


def test_training_pages_held_out():
    model, rng = html_extract.default_field(), random.Random(99)
    wrong = total = 0
    for _ in range(150):
        blocks = html_extract.labelled_page(rng)
        wrong += sum(y != b.label for y, b in zip(html_extract.viterbi(model.scores(blocks), model.pair), blocks, strict=True))
        total += len(blocks)
    assert wrong / total < 0.005


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three</p><p>Four <b>five</b>&nbsp;six.</article><footer>&copy; z</footer></body></html>", "T & U\n\nOne two three\n\nFour five six."),
        (None, ""), ("", ""), ("<p", ""), ("<script>var a='<p>no</p>';</script><style>p{}</style>", ""),
        ("<article><p>First one here.</p><!-- <p>hidden</p> --><div class='ad'>Buy</div><p>Second one here.</p><div class=\"comments\"><p>Great post!</p></div></article>", "First one here.\n\nSecond one here."),
    ],
)
def test_main_text(page, wanted):
    assert html_extract.main_text(page, html_extract.default_field()) == wanted


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<p>a</p><svg class=x /><p>b</p><svg><g><path d=x></g></svg><p>c</p>", "a b c"), ("<div><p>a</p><video src=x></div><p>b</p>", "a b"),
        ("<div><p>a</p><select><option>no<option>no</div><p>b</p>", "a b"), ("<p>a</p><svg><svg><text>no</text></svg><text>no</text></svg><p>b</p>", "a b"),
        ("<p>a<object data=x><object>no</object>no</object>b</p>c", "a b c"), ("<p>a</p><div><object><p>no</p></div><p>b</p><object>no</object><p>c</p>", "a b c"),
        ("<p>a<video src=x><p>b<svg></p><p>c</p>", "a b c"), ("<ul><li>a<canvas><li>b</ul>c", "a b c"), ("<p>a <span>b<svg><path></span> c</p>", "a b c"), ("<p>a <a href=x><svg><a>no</a>no</svg>b</a></p>", "a b"),
        ("<noscript><p>no</p></noscript>a<template><div>no</div></template>b<audio>no", "a b"), ("<p>a</p><script>no</p>", "a"), ("a<textarea><p>no</textarea>b<iframe>no</iframe>c<style>no", "a b c"),
    ],
)
def test_elements_without_text_hide_nothing_else(page, wanted):
    assert " ".join(b.text for b in html_extract.leaf_blocks(page)) == wanted


def test_hidden_elements_keep_the_link_around_them():
    assert [(b.text, b.linked) for b in html_extract.leaf_blocks("<p><a href=x>ab<svg><g></g></svg>cd</a>ef</p>")] == [("ab", 2), ("cdef", 2)]
    assert [(b.text, b.linked) for b in html_extract.leaf_blocks("<div><a href=x>ab<svg></div>cd")] == [("ab", 2), ("cd", 0)]


def test_extraction_of_pages(spark, sf):
    """The pages' articles, cut out with what is known of their layout."""
    import html as h
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op9_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.sub(r"<[^>]*\Z", "", pages[r.page_id].split("<article>")[1].split("</article>")[0])
        blocks = [" ".join(h.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


LONG = "This is a fairly long paragraph of the story, with commas and a full stop at its end. It goes on for a while, as stories do."


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (f"<div class='menu9'><a href=a>Home</a> <a href=b>News</a></div><div class='c1'><h2>Headline here</h2><p>{LONG}</p><p>{LONG}</p><p>Short one.</p></div><div><a href=x>More</a></div>", f"Headline here\n\n{LONG}\n\n{LONG}\n\nShort one."),
        (f"<table><tr><td><a href=1>A</a><br><a href=2>B</a></td><td><p>{LONG}</p><p>{LONG}</p></td></tr><tr><td colspan=2>Copyright 2020 Foo</td></tr></table>", f"{LONG}\n\n{LONG}"),
        ('<article><p>Go to <a title="x > y" href="q">link</a> now.</p></article>', "Go to link now."),
        ("<article><p>One <a title='a <b> c' href=q>two</a> three.</p><p data-x = \"</article>\">Four.</p></article>", "One two three.\n\nFour."),
        (f"<title>My page</title><center>{LONG}<br><br>{LONG}</center>", f"{LONG} {LONG}"),
        (f"<div class=zz><div>{LONG}</div><div>{LONG}</div></div><div><ul><li><a href=1>One</a></li></ul></div>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_main_text_where_no_name_tells(page, wanted):
    assert html_extract.main_text(page, html_extract.default_field()) == wanted


def test_bare_pages_held_out():
    model, rng = html_extract.default_field(), random.Random(98)
    pages = [html_extract.bare_page(rng) for _ in range(150)]
    wrong = sum(y != b.label for p in pages for y, b in zip(html_extract.viterbi(model.scores(p), model.pair), p, strict=True))
    assert wrong / sum(map(len, pages)) < 0.01


HAN = "这是一个相当长的段落，里面有逗号，也有句号。它继续讲述故事，就像所有的故事一样，直到最后一句话为止。"
THAI = "นี่คือย่อหน้าที่ค่อนข้างยาวของเรื่อง มีหลายประโยคและดำเนินต่อไปเรื่อยๆ เหมือนกับเรื่องราวทั่วไปจนถึงประโยคสุดท้าย"


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (f"<div><a href=a>首页</a> <a href=b>新闻</a></div><div class=x>{f'<div>{HAN}</div>' * 10}</div><div>© 2020 公司</div>", "\n\n".join([HAN] * 10)),
        (f"<div><a href=a>หน้าแรก</a></div><div class=x>{f'<div>{THAI}</div>' * 10}</div><div>© 2020</div>", "\n\n".join([THAI] * 10)),
        ("<div><a href=x>Home</a></div><div>The shop is closed today.</div>", "The shop is closed today."), ("<div><a href=x>首页</a></div><div>今天商店关门。</div>", "今天商店关门。"),
        (f"<article><h1>T</h1><p>{LONG}</p><footer>Filed under news</footer></article>", f"T\n\n{LONG}"), ("<article><p>a</p <p>b</p></article>", "a\n\nb"),
        ("a text without any tag", "a text without any tag"), (f"{LONG} {LONG}", f"{LONG} {LONG}"), (HAN, HAN),
    ],
)
def test_main_text_of_scripts_short_pages_and_broken_tags(page, wanted):
    assert html_extract.main_text(page, html_extract.default_field()) == wanted


def test_short_pages_held_out():
    model, rng = html_extract.default_field(), random.Random(97)
    pages = [html_extract.short_page(rng) for _ in range(300)]
    wrong = sum(y != b.label for p in pages for y, b in zip(html_extract.viterbi(model.scores(p), model.pair), p, strict=True))
    assert wrong / sum(map(len, pages)) < 0.01


def test_scores_are_sums_of_features_and_viterbi_finds_the_best_chain():
    import itertools

    model, rng = html_extract.default_field(), random.Random(5)
    for make in (html_extract.labelled_page, html_extract.bare_page, html_extract.short_page) * 10:
        blocks = make(rng)
        scores = model.scores(blocks)
        found = html_extract.features(blocks)
        assert all(len(set(fs)) == len(fs) for fs in found)
        assert scores == pytest.approx([sum(model.weight.get(f, 0.0) for f in fs) for fs in found])
        for at in range(0, len(scores), 8):
            some = scores[at : at + 8]
            worth = lambda ys: sum(s for s, y in zip(some, ys) if y) + sum(model.pair[a][b] for a, b in zip(ys, ys[1:]))  # noqa: B023, B905, E731
            assert worth(html_extract.viterbi(some, model.pair)) == pytest.approx(max(map(worth, itertools.product((0, 1), repeat=len(some)))))


def test_elements_know_their_path():
    """What is kept with elements is what a walk over the path finds."""
    blocks = html_extract.leaf_blocks("<main class='a b'><div id=a>one<section class=c>two</section><form class='b d'><p>three</div>four</main>five")
    assert [b.text for b in blocks] == ["one", "two", "three", "four", "five"]
    for b, fs in zip(blocks, html_extract.features(blocks), strict=True):
        path, e = [], b.at
        while e:
            path.append(e)
            e = e.parent
        assert [e.depth for e in path] == list(range(len(path), 0, -1))
        tags = {e.tag for e in path}
        assert {f for f in fs if f.startswith("in=")} == {f"in={t}" for t in tags & html_extract.TELLING}
        assert ("framed" in fs) == bool(tags & html_extract.FRAMES) and ("in" in fs) == bool(tags & {"article", "main"})
    names = [len([f for f in fs if f.startswith("class=")]) for fs in html_extract.features(blocks)]
    assert names == [2, 3, 3, 2, 0]


@pytest.mark.parametrize("opened", ["<div>", "<div class='c{0} x'>", "<section id=a{0}>x "])
def test_time_grows_with_a_page_not_with_its_depth(opened):
    import time

    model, took = html_extract.default_field(), []
    for n in (20_000, 80_000):
        page = "".join(opened.format(i) for i in range(n)) + "end"
        begin = time.process_time()
        html_extract.main_text(page, model)
        took.append(time.process_time() - begin)
    assert took[1] < 8 * took[0] + 0.5


def test_extraction_edges(spark):
    """Nulls in any column, repeated rows, clashing columns, a very long page, an empty table."""
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article><div class='x'" + " y='<'" * 20_000
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (1, "u", f"<article><p>{LONG}</p></article>"), (None, None, None), (2, None, ""), (3, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit(1)})
    got = html_extract.extract(pages).collect()
    assert sorted(((r.page_id, r.url, r.text[:50], r.n_chars) for r in got), key=str) == sorted(
        [(1, "u", LONG[:50], len(LONG))] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "v", LONG[:50], 20_000 * (len(LONG) + 2) - 2)], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_forward_backward_sums_to_one():
    chance, pairs = html_extract.marginals([0.3, -1.0, 2.0], [[0.1, -0.2], [0.4, 0.0]])
    assert sum(map(sum, pairs)) == pytest.approx(2.0)
    assert all(0 < c < 1 for c in chance)


# --- mixing


def test_mix_equals_plain(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source, plain.domain(r.source)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Counter(map(tuple, queries.op4_mixing(spark, sf).collect()))
    assert got == Counter(plain.mix(rows, mixing.WEIGHTS))


def test_mix_edges(spark):
    rows = [(i, "w " * (i % 7), [None, "en", "de"][i % 3], ["a", "b", None, "hot", "hot"][i % 5], ["x", None][i % 2]) for i in range(60)] + [(5, "w w", "en", "a", "x"), (5, "w w", "en", "a", "x"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    weights = {"lang": {"en": 0}, "source": {"hot": 9}}
    for share in ((1, 2), (2, 1), (9, 1)):
        got = mixing.mix(docs, domain=F.col("domain"), share=share, weights=weights).collect()
        assert Counter(map(tuple, got)) == Counter(plain.mix(rows, weights, share))
    assert mixing.mix(docs.limit(0), domain=F.col("domain")).count() == 0


def test_budgets_of_many_sources(spark):
    """Hundreds of children, many alike, against filling them one after another."""
    rnd = random.Random(3)
    leaves = [(f"d{rnd.randrange(3)}", f"l{rnd.randrange(2)}", f"s{i}", rnd.choice([0, 1, 7, 7, 7, 100, rnd.randrange(1, 5000)])) for i in range(400)]
    weights = {"source": {f"s{i}": rnd.randrange(0, 4) for i in range(0, 400, 3)}, "lang": {"l0": 3}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for budget in (5, 3000, 90_000):
        given = {(): budget}
        for n, level in enumerate(("domain", "lang", "source"), 1):
            below = {}
            for parent, b in given.items():
                kids = Counter()
                for *k, tokens in leaves:
                    if tuple(k[: n - 1]) == parent:
                        kids[tuple(k[:n])] += tokens * 3
                w = {k: weights.get(level, {}).get(k[-1], 1) for k in kids}
                order = sorted((k for k in kids if w[k]), key=lambda k: (kids[k] / w[k], k[-1]))
                left, rest = b, sum(w[k] for k in order)
                below |= dict.fromkeys(kids, 0)
                for i, k in enumerate(order):
                    if kids[k] * rest > w[k] * left:
                        below |= {q: min(w[q] * left // rest, kids[q]) for q in order[i:]}
                        break
                    below[k], left, rest = kids[k], left - kids[k], rest - w[k]
            given = below
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, budget, weights, 3).collect()}
        assert got == given


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("x", "l", "small", 10), ("x", "l", "large", 1000), ("y", "l", "other", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 200, {}, 1).collect()}
    assert got == {"small": 10, "large": 90, "other": 100}


# --- media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 8191 * 192 + 5])
def test_jpeg_round_trip(n):
    data = jpeg_media.payload(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
    media = jpeg_media.encode([data, jpeg_media.payload(b"x")])
    thumbs = jpeg_media.decode_dc(media, [jpeg_media.parse(m) for m in media])
    assert b"".join(t.tobytes() for t in thumbs[0]) == data


def test_media_columns(table):
    rows = [(1, None), (2, ""), (3, "é" * 300), (4, "abc"), (5, "abc"), (5, "abc"), (6, "\n" * 70000)]
    got = jpeg_media.digest(jpeg_media.features(jpeg_media.store(table(rows).select("doc_id", "text")))).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        data = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert len({tuple(r)[1:] for r in got if r.doc_id in (4, 5)}) == 1
    assert len({tuple(r)[1:] for r in got if r.doc_id in (1, 2)}) == 1


def test_long_payloads_image_by_image():
    data = jpeg_media.payload(np.random.default_rng(1).integers(0, 256, 2 * 8191 * 192 + 700, dtype=np.uint8).tobytes())
    assert jpeg_media.encode_long(data) == jpeg_media.encode([data])[0]


def test_media_query(spark, sf, documents):
    """The payload's columns against plain digests; the stored form's against a second look at it; equal texts, equal values."""
    got = {r.doc_id: r for r in queries.op6_media(spark, sf).collect()}
    stored = {r.doc_id: bytes(r.media) for r in jpeg_media.store(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).collect()}
    by_text = {}
    for i, text in documents:
        raw, r = (text or "").encode(), got[i]
        data = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        rows = np.frombuffer(data, np.uint8).reshape(-1, 192)
        assert r.feature.split(":")[0] == f"{192 * 8}x{len(rows) * 8}"
        assert by_text.setdefault(text or "", tuple(r)[1:]) == tuple(r)[1:]
    assert jpeg_media.digest(jpeg_media.features(jpeg_media.store(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def hand_made_jpeg() -> bytes:
    """16 x 16, two components, the first sampled 2 x 2, with AC values: DC differences 3, 0, -3, 1 and -2."""
    seg = jpeg_media._segment
    dc = "".join(["10" + "11", "0", "10" + "00", "110" + "1"][k] + tail for k, tail in enumerate(["10" + "1" + "0", "0", "0", "0"]))
    bits = dc + "10" + "01" + "0"
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    table = lambda which, lengths, symbols: seg(0xC4, bytes([which]) + bytes(lengths) + bytes(symbols))
    frame = seg(0xC0, bytes([8, 0, 16, 0, 16, 2, 1, 0x22, 0, 2, 0x11, 0]))
    head = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8] * 64)) + frame
    head += table(0x00, [1, 1, 1] + [0] * 13, [0, 2, 1]) + table(0x10, [1, 1] + [0] * 14, [0, 1])
    return head + seg(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + body + b"\xff\xd9"


def test_general_baseline_image():
    data = hand_made_jpeg()
    (thumb,), = jpeg_media.decode_dc([data], [jpeg_media.parse(data)])
    assert thumb.tolist() == [[131, 131], [128, 129]]


def test_what_is_no_jpeg(spark):
    got = jpeg_media.features(spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None), (3, bytearray(b""))], "k long, media binary")).orderBy("k").collect()
    assert [(r.width, r.payload_sha256, r.media_bytes) for r in got] == [(None, None, 6), (None, None, None), (None, None, 0)]


# --- archives


def test_warc(spark):
    page = "<p>" + "x" * 200
    rows = [(3, "u", page), (1, "u\r\nX: y", page), (2, None, page), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", page + "é"), (9, "u", "a\r\n\r\nb" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.read_back(*warc.archive(pages)).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == plain.warc([(p, h) for p, _, h in rows])
    assert len(got) == len(rows)


def test_warc_on_pages(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert {r.page_id: tuple(r)[1:] for r in queries.op8_warc(spark, sf).collect()} == plain.warc(pages)


def test_normaliser_makes_members_of_records(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}" + "y" * 3000) for i in range(40)]
    records = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    monolithic = warc.write_monolithic(records, archive_bytes=20_000)
    assert monolithic.count() > 3
    one = warc.normalise(monolithic).first()
    for offset, length in zip(one.offsets, one.lengths, strict=True):
        assert zlib.decompress(bytes(one.content)[offset : offset + length], 31).startswith(b"WARC/1.0\r\n")
    assert sum(one.lengths) == len(one.content)
    assert warc.sidecar(warc.normalise(monolithic)).count() == 40
    with pytest.raises(ValueError, match="within a record"):
        list(warc.split_records(__import__("gzip").compress(b"WARC/1.0\r\nContent-Length: 50\r\n\r\nabc")))


def test_warc_files_and_index(spark, tmp_path):
    """Real .warc.gz files, monolithic or of several streams; one record fetched by the index alone."""
    import gzip

    made = [warc.record(i, f"u{i}", f"<p>{i}".encode() * 50, hashlib.sha256(f"<p>{i}".encode() * 50).hexdigest(), "response", None) for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(gzip.compress(b"".join(made[:4])))
    (tmp_path / "in/b.warc.gz").write_bytes(b"".join(map(gzip.compress, made[4:])))
    (tmp_path / "in/c.txt").write_text("no archive")
    done = warc.normalise(warc.read_files(spark, str(tmp_path / "in")))
    index = warc.sidecar(done)
    assert sorted(r.page_id for r in warc.read_back(done, index).collect()) == list(range(6))
    assert [r.page_id for r in warc.read_back(done, index.where("archive like '%a.warc.gz' and n = 2")).collect()] == [2]


def test_warc_of_other_makers(spark, tmp_path):
    """Records of other kinds, payloads in HTTP messages, revisits that tell no size, digests of another scheme, archives that break off or hold something else."""
    import gzip

    def made(kind, number, block, *more):
        head = [b"WARC/1.0", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:uuid:{number}>".encode(), *more, f"Content-Length: {len(block)}".encode()]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    http, body = b"Content-Type: application/http; msgtype=response", b"<p>caf\xc3\xa9</p>\r\n\r\n<p>two"
    whole = [
        made("warcinfo", 0, b"software: other"), made("request", 1, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"Content-Type: application/http; msgtype=request"),
        made("response", 2, b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + body, http, b"WARC-Target-URI: http://a/"), made("resource", 3, b"raw", b"no header"),
        made("revisit", 4, b"HTTP/1.1 200 OK\r\n\r\n", http, b"WARC-Refers-To: <urn:uuid:2>", b"WARC-Payload-Digest: sha1:ABC"), made("revisit", 5, b"", b"WARC-Refers-To: <urn:uuid:99>"),
    ]
    (tmp_path / "in").mkdir()
    files = {"whole": gzip.compress(b"".join(whole)), "members": b"".join(map(gzip.compress, whole)), "cut": gzip.compress(b"".join(whole))[:-40], "short": gzip.compress(whole[0] + whole[2][:-9]),
             "foreign": gzip.compress(whole[0] + b"something else\r\n\r\n"), "junk": b"no gzip"}
    for name, content in files.items():
        (tmp_path / f"in/{name}.warc.gz").write_bytes(content)
    done = warc.normalise(warc.read_files(spark, str(tmp_path / "in")))
    state = {r.archive.rsplit("/", 1)[1].split(".")[0]: (len(r.offsets), r.broken) for r in done.collect()}
    assert state["whole"] == state["members"] == (6, None)
    assert state["short"] == (1, "the archive ends within a record") and state["foreign"] == (1, "a record without a length")
    assert state["junk"][0] == 0 and state["junk"][1].startswith("the archive cannot be inflated") and state["cut"][0] < 6 and state["cut"][1]
    one = done.where("archive like '%whole.warc.gz'")
    sha = hashlib.sha256(body).hexdigest()
    rows = {r.record_id: r for r in warc.read_records(one, warc.sidecar(one)).collect()}
    assert [rows[f"<urn:uuid:{n}>"].record_type for n in range(6)] == ["warcinfo", "request", "response", "resource", "revisit", "revisit"]
    got = rows["<urn:uuid:2>"]
    assert (got.page_id, got.payload_bytes, got.payload_digest, got.target_uri) == (None, len(body), sha, "http://a/")
    assert (rows["<urn:uuid:3>"].payload_bytes, rows["<urn:uuid:4>"].payload_bytes, rows["<urn:uuid:4>"].payload_digest) == (3, None, None)
    full = {r.record_id: (r.payload_bytes, r.payload_digest) for r in warc.resolved(warc.read_records(one)).collect()}
    assert len(full) == 6 and full["<urn:uuid:4>"] == (len(body), sha) and full["<urn:uuid:5>"] == (None, None)


def test_warc_records_are_of_the_format():
    data = warc.record(7, "http://a/\nb", b"<p>x", "d" * 64, "revisit", 3, "2024-01-02T03:04:05Z")
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = warc.headers_of(head)
    assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(headers) and headers["warc-target-uri"] == "http://a/%0Ab"
    assert headers["warc-refers-to"] == warc.record_id(3, "d" * 64) != headers["warc-record-id"] and rest.endswith(b"\r\n\r\n")
    assert int(headers["content-length"]) == len(rest) - 4 and rest.startswith(b"HTTP/1.1 200 OK\r\n")


def test_warc_extra_columns_and_long_pages(spark):
    rows = [(1, "u", "x" * 9_000_000), (2, "u", "x" * 9_000_000), (3, None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "first": F.lit(1), "salt": F.lit(2), "payload": F.lit("p"), "n": F.lit(0)})
    assert {r.page_id: tuple(r)[1:] for r in warc.read_back(*warc.archive(pages)).collect()} == plain.warc([(p, h) for p, _, h in rows])


def test_warc_repeated_rows_nulls_and_empty(spark):
    page = "z" * 150
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "u", page), (None, "u", page)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_back(*warc.archive(pages)).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1)], key=str)
    assert warc.read_back(*warc.archive(pages.limit(0))).count() == 0


# --- pipeline


def test_pipeline_equals_plain(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = Counter(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    stage = spark.read.parquet(f"{sf}/documents.parquet")
    accepted = {r.doc_id for r in corpus_pipeline.language(spark, stage, sf).collect()}
    docs = [d for d in docs if d["doc_id"] in accepted]
    one = plain.jaccard([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if one[d["doc_id"]][1] == d["doc_id"]]
    dirty = plain.overlaps([(d["doc_id"], d["text"]) for d in docs], items)
    docs = [d for d in docs if not dirty[d["doc_id"]][-1]]
    masked = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, spark.createDataFrame(docs, stage.schema), sf).collect()}
    for d in docs:
        assert ("[SECRET]" in masked[d["doc_id"]]) == any(plain.secrets(d["text"])[:3])
    rows = [(d["doc_id"], masked[d["doc_id"]], d["lang"], d["source"], plain.domain(d['source'])) for d in docs]
    assert got == Counter(plain.mix(rows, mixing.WEIGHTS))


def test_run_on_nulls_extra_columns_and_nothing(spark, sf, tmp_path):
    """The whole pipeline over few documents with nulls, copies and clashing columns, and over none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000").limit(30)
    odd = docs.limit(1).selectExpr("doc_id", "text", "cast(null AS string) AS lang", "cast(null AS string) AS source", "n_chars").union(docs.limit(2)).union(spark.createDataFrame([(None, None, None, None, None), (9999, "", "en", "s", 0)], docs.schema))
    every = docs.union(odd).withColumns({n: F.lit(n) for n in ("id", "node", "row", "key", "n", "salt", "__text")})
    for name, rows in (("some", every), ("none", every.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/some")
    assert got.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "epoch"]
    assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_columns_of_any_name(spark, sf):
    """Extra columns under the names that operators use inside come through as they are."""
    names = ["row", "key", "kinds", "text2", "n_words", "hit_runs", "hit_items", "lang_pred", "score", "rejected", "__text", "__copy", "id", "node", "n"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        assert tuple(kept.select(*names).first()) == tuple(names)
    media = jpeg_media.features(jpeg_media.store(docs.select("doc_id", "text", F.lit(1).alias("n_bytes"), F.lit(2).alias("width"))))
    assert media.columns.count("width") == 1 and media.first().width == 1536


def test_stages_keep_columns_and_take_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
