"""Operators that decide row by row: secrets, decontamination, quality, HTML."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate, html_text, quality, queries, secrets_scan
from tidepanel.llm.common import table

SF = "/root/testdata/sf0.001"

# ---- secrets ---------------------------------------------------------------------------------------------------


def base_spans(text):
    letters = re.ASCII | re.IGNORECASE
    found = [(m.start(), "assign", m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, letters)
        if len(m[2]) >= 8]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], secrets_scan.KINDS.index(s[1])))


def test_scan_equals_plain_patterns():
    rng = random.Random(1)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "apikey", "API_KEY", '"', "'", " ", "  ", ":", "=",
             "AKIA", "akia", "0123456789abcdef", "deadbeef", "abc", "Z9+/_.=-", "İ", "K", "ſecret", "é", "\n", "x" * 7]
    keywords = secrets_scan.automaton()
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        got = [s for s in secrets_scan.scan(text, keywords) if s[1] in secrets_scan.BASE]
        assert got == base_spans(text), text


def test_checksums_decide():
    body = "aB3" * 10
    good = "ghp_" + body + secrets_scan.base62(zlib.crc32(body.encode()))
    bad = "npm_" + body + "000000"
    spans = secrets_scan.scan(f"x {good} y {bad} z", secrets_scan.automaton())
    assert [s for s in spans if s[1] == "checked"] == [(2, "checked", 42)]


def test_secrets_of_edge_rows(edge_docs, edge_rows, no_docs):
    rows = secrets_scan.secret_spans(edge_docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in edge_rows)
    assert all(r.spans == [] for r in rows)
    assert secrets_scan.secret_spans(no_docs).count() == 0


def test_secret_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_secret_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == secrets_scan.sha256_text(secrets_scan.listed(spans))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in secrets_scan.BASE]


# ---- decontamination -------------------------------------------------------------------------------------------


def substring_distance(pattern, text):
    """Sellers' table, row by row."""
    codes, places = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, p in enumerate(pattern, 1):
        best = np.append([i], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(p))))
        row = np.minimum.accumulate(best - places) + places
    return int(row.min())


def mutated(text, edits, rng):
    for _ in range(edits):
        i = rng.randrange(len(text) or 1)
        text = rng.choice([text[:i] + text[i + 1:], text[:i] + rng.choice("abc ") + text[i:],
                           text[:i] + rng.choice("abc") + text[i + 1:]])
    return text


def test_found_items_equal_the_full_table():
    rng = random.Random(2)
    hits = 0
    for _ in range(250):
        items = [(i, decontaminate.normalised("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60)))))
                 for i in range(4)]
        noise = lambda n: "".join(rng.choice("abc ") for _ in range(n))
        chosen = rng.choice(items)[1] or "a"
        gaps = [rng.choice(["", " "]) for _ in range(2)]
        text = decontaminate.normalised(
            noise(30) + gaps[0] + mutated(chosen, rng.randrange(6), rng) + gaps[1] + noise(30))
        rate = rng.choice([0.05, 0.1, 0.2])
        got = [(found.items[n][0], d) for found in [decontaminate.Items(items, rate)] for n, d in found.found_in(text)]
        expected = [(key, d) for key, item in items if item
                    for d in [substring_distance(f" {item} ", f" {text} ")] if d <= decontaminate.budget(len(item), rate)]
        assert got == expected
        hits += len(got)
    assert hits > 100


def test_items_end_at_words():
    items = decontaminate.Items([(1, "cat"), (2, "a"), (3, "the quick brown fox jumps")], 0.08)
    assert items.found_in("concatenate") == items.found_in("") == []
    assert items.found_in("cat") == [(0, 0)] and items.found_in("a cat") == [(0, 0), (1, 0)]
    # What is glued to an end is an edit.
    assert items.found_in("so the quick brown fox jumps on") == [(2, 0)]
    assert items.found_in("xthe quick brown fox jumps") == [(2, 1)]
    assert items.found_in("xthe quick brown fox jumpsy") == [(2, 2)] or items.items[2][2] < 2


def test_decontamination_query(spark):
    """The query against the full table on every document and item."""
    folder = "/root/testdata/sf0.001"
    items = [(r.item_id, decontaminate.normalised(r.text)) for r in table(spark, folder, "benchmark").collect()]
    expected = Counter()
    for doc in table(spark, folder, "documents").collect():
        text = decontaminate.normalised(doc.text)
        for key, item in items:
            errors = decontaminate.budget(len(item))
            # Within its budget an item leaves one of budget + 1 stretches untouched.
            if any(piece in f" {text} " for _, piece in decontaminate.pieces(f" {item} ", errors)):
                distance = substring_distance(f" {item} ", f" {text} ")
                if distance <= errors:
                    expected[doc.doc_id, key, distance, errors] += 1
    got = queries.QUERIES["op2_benchmark_decontamination"](spark, folder).collect()
    assert Counter(map(tuple, got)) == expected and expected


def test_decontamination_of_edge_rows(spark, edge_docs, edge_rows, no_docs, make_docs):
    items = spark.createDataFrame(
        [(1, "One, two THREE four five!", "x"), (1, "One, two THREE four five!", "x"), (None, "no id here at all", "x"),
         (2, None, "x"), (3, "", "x"), (4, "...", "x")], "item_id int, text string, distance string")
    got = decontaminate.contaminated(edge_docs, items, block_chars=10)
    assert dict(got.dtypes) == {"doc_id": "bigint", "item_id": "int", "distance": "int", "budget": "int"}
    pairs = sorted((str(r.doc_id), str(r.item_id)) for r in got.collect())
    assert pairs == sorted([("1", "1")] * 4 + [("2", "1")] * 2 + [("None", "None")])
    kept = decontaminate.decontaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(edge_rows) - 4 and "one two three four five" not in texts
    for docs, bench in ((no_docs, items), (edge_docs, items.where("false"))):
        assert decontaminate.contaminated(docs, bench).count() == 0
        assert decontaminate.decontaminated(docs, bench).count() == docs.count()


def test_blocks_of_items_are_bounded(spark, make_docs):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(400)]
    texts = [" ".join(rng.sample(words, 6)) for _ in range(60)]
    rows = [(i, texts[i % 60] if i % 3 else texts[0].upper(), "x") for i in range(600)] + [(7, texts[7], "x")] * 3
    items = spark.createDataFrame(rows, "item_id int, text string, distance string")
    blocks = decontaminate.item_blocks(items, "item_id", "text", 2000)
    held = [decontaminate.collected(block) for block in blocks]
    largest = len(texts[0]) + decontaminate.ID_CHARS * 220
    assert len(blocks) > 3 and all(sum(len(norm) + decontaminate.ID_CHARS * len(ids) for ids, norm in block) <= (
        2000 if len(block) > 1 else largest) for block in held)
    assert sorted((i, norm) for block in held for ids, norm in block for i, n in ids for _ in range(n)) == sorted(
        (i, decontaminate.normalised(t)) for i, t, _ in rows)
    docs = make_docs([(i, f"some {text} more", "a") for i, text in enumerate(texts[:20])] + [(99, "clean", "a")] * 2)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, block_chars=2000).collect())
    assert got == sorted((d, i) for d in range(20) for i, t, _ in rows if t.lower() == texts[d])
    kept = decontaminate.decontaminated(docs, items, block_chars=2000)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [
        *range(3, 20, 3), 99, 99]


# ---- quality ---------------------------------------------------------------------------------------------------


def test_features_are_tokens_and_pairs():
    texts = ["The CAT, the cat...", "", "naïve été 3x", "a a a"]
    rows, slots = quality.features([t.encode() for t in texts])
    for i, text in enumerate(texts):
        tokens = re.findall(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff\s]+", text.lower().encode())
        doubled = sum(a == b for a, b in zip(tokens, tokens[1:]))
        assert (rows == i).sum() == len(tokens) + max(len(tokens) - 1, 0) + doubled
    alone = quality.features([b"cat"])[1]
    assert alone[0] in slots[rows == 0] and quality.features([b"CAT"])[1][0] == alone[0]


def test_margins_are_the_dot_product():
    texts = [b"a b c", b"", b"b b", b"x" * 10]
    weights = np.random.default_rng(3).normal(size=1 << quality.BITS)
    for text, margin in zip(texts, quality.margins(texts, weights, 0.5)):
        slots = quality.features([text])[1]
        assert margin == pytest.approx(0.5 + (quality.SCALE * weights[slots].mean() if len(slots) else 0))


def test_held_out_accuracy_and_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = quality.scored(docs.select("doc_id", "text"), quality.train(docs, labels))
    out = {r.doc_id: r.score for r in scores.collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    right = sum((out[d] >= 0.5) == (truth[d] == 1) for d in held)
    assert right >= 0.93 * len(held)
    # What is held out does not matter.
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.scored(docs.select("doc_id", "text"), quality.train(docs, turned)).collect()}
    assert again == out


def test_quality_of_edge_rows(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (2, 0), (3, 1), (4, None), (None, 1), (7, 0), (8, 1)], "doc_id bigint, quality int")
    model = quality.train(edge_docs, labels)
    rows = quality.scored(edge_docs, model, score="p").collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.p <= 1 for r in rows)
    empty = {r.p for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1
    assert quality.good_documents(edge_docs, labels).columns == edge_docs.columns
    assert quality.good_documents(no_docs, labels).count() == 0
    unlabelled = quality.train(edge_docs, labels.where("false"))
    assert {r.p for r in quality.scored(edge_docs, unlabelled, score="p").collect()} == {0.5}


# ---- HTML ------------------------------------------------------------------------------------------------------

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>One<p>Two <b>bold</b>\n text": "One\n\nTwo bold text",
    "a<div>b</div>c": "a\nb\nc",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>a<li>b<ol><li>c<li>d</ol></ul>": "- a\n- b\n  1. c\n  2. d",
    "<ol start=3><li>x</li><li value=7>y</li><li>z</ol>": "3. x\n7. y\n8. z",
    "<table><tr><th>k<th>value<tr><td>longer<td>1</table>": "k      | value\nlonger | 1",
    "<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>": "ab |   | c\n1  | 2 | 3",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r | 1\n  | 2",
    "<table><td>implied<td>row</table>": "implied | row",
    "<script>if (a<b) {}</script>x<style>p{}</style><!-- c --><title>t</title>": "x",
    "<p hidden>no<p>yes<div style='DISPLAY : none'>no</div><span style=\"visibility:hidden\">no</span>": "yes",
    "<pre>\n a\n  b\n</pre>c": " a\n  b\n\nc",
    "<details><summary>s</summary>hidden</details><details open><summary>t</summary>shown</details>": "s\nt\nshown",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "1 < 2 <3> <a href=\"x>y\">link</a>": "1 < 2 <3> link",
    "<head><title>t</title><p>body": "body",
    "<select><option>a<option>b</select>": "a\nb",
    "<input type=submit value=Go><input value=no>": "Go",
    "<p>a<table><tr><td>x</table>b": "a\n\nx\n\nb",
    "<textarea>a &lt; <b></textarea>": "a < <b>",
    "</p></div>x</table>": "x",
    "x<a": "x",
}


@pytest.mark.parametrize("html", CASES)
def test_rendered(html):
    assert html_text.visible_text(html) == CASES[html]


SHOWN = {
    # Visibility is inherited, and may be given back; display can't be.
    "<div style='visibility:hidden'>no <i>no</i><br><b style='visibility: visible'>yes</b> no</div>": "yes",
    "<p style='display:none'>no<b style='display:block;visibility:visible'>no</b></p>yes": "yes",
    "<div style='visibility:hidden'><ul><li>no<li style='visibility:visible'>yes</ul></div>": "- yes",
    "<table><tr><td>a<td style='visibility:hidden'>no<td>c</table>": "a |  | c",
    "<table><tr><td>a<tr style='visibility:collapse'><td>no<tr><td>b</table>": "a\nb",
    "<svg><text visibility='hidden'>no<tspan visibility='visible'>yes</tspan></text></svg>": "yes",
    # Rules of the page's own sheets, the weightiest and last first; an element's own style outweighs them.
    "<style>.a,p.b{display:none}</style><i class=a>no</i><p class='b x'>no<p class=c>yes<div class=b>yes</div>": "yes\n\nyes",
    "<style>#q{visibility:hidden}</style><div id=q>no <b style='visibility:visible'>yes</b></div>": "yes",
    "<style>.d{display:none} .d{display:block}</style><div class=d>yes</div>": "yes",
    "<style>#e{display:block} .e{display:none}</style><div class=e id=e>yes</div>": "yes",
    "<style>.f{display:none!important} .f{display:block}</style><div class=f style='display:block'>no</div>yes": "yes",
    "<style>.g{display:none}</style><div class=g style='display:block'>yes</div>": "yes",
    "<style>@media print{.h{display:none} b{display:none}} /* .h{display:none} */</style><b class=h>yes</b>": "yes",
    "<style>.i .j{display:none} .k:hover{display:none}</style><p class=i><b class=j>yes</b><i class=k>yes</i>": "yesyes",
    "<style>.l{display:none</style><b class=l>no</b>yes<style>}{}}@media{": "yes",
}


@pytest.mark.parametrize("html", SHOWN)
def test_shown(html):
    assert html_text.visible_text(html) == SHOWN[html]


def test_page_query(spark):
    """The query gives what each whole page renders to, and every word between tags of plain pages."""
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    got = {r.page_id: r.text for r in queries.QUERIES["op5_html_extraction"](spark, SF).collect()}
    assert got == {i: html_text.visible_text(html) for i, html in pages.items()}
    raw = re.compile(r"(?is)<(script|style|noscript|template|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&\w+;")
    for i, html in pages.items():
        if not re.search(r"hidden|display|none|<(svg|select|details|title|textarea|dialog)", html):
            words = set(re.findall(r"\w{4,}", raw.sub(" ", html)))
            assert words <= set(re.findall(r"\w+", got[i])) or not words, i


def test_no_visible_word_is_lost():
    rng = random.Random(5)
    tags = "p div b ul li ol table tr td th tbody span h1 blockquote dl dt dd a section caption button".split()
    for _ in range(400):
        parts, words = [], []
        for i in range(rng.randrange(1, 40)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(f"<{rng.choice(tags)}>")
            elif kind < 0.6:
                parts.append(f"</{rng.choice(tags)}>")
            else:
                words.append(f"w{i}")
                parts.append(f" w{i} ")
        assert sorted(re.findall(r"w\d+", html_text.visible_text("".join(parts)))) == sorted(words)


@pytest.mark.parametrize("html", [
    "<div>" * 50_000 + "x", "<a \"" * 50_000, "<" * 200_000, "<a '\"" * 50_000, "<p>x" * 50_000, "<script>" * 20_000,
    "<table><tr><td>" * 3000 + "x", "<td colspan=99999>" * 300, "<!--" * 50_000, "&" * 200_000])
def test_hostile_pages_take_linear_time(html):
    start = time.process_time()
    html_text.visible_text(html)
    assert time.process_time() - start < 10


@pytest.mark.parametrize("around", ["<div>", "<font>", "<a name=x>", "<ul><li>"])
def test_elements_keep_their_role_at_any_depth(around):
    page = around * 3000 + (
        "<script>no</script><style>no</style><noscript>no</noscript><i hidden>no</i><b style='display:none'>no</b>"
        "<div hidden><div>no</div>no</div><ul><li>a<li>b</ul>"
        "<table><tr><th>k<th>value<tr><td>longer<td>1</table>yes<p>end")
    lines = [line.strip() for line in html_text.visible_text(page).splitlines() if line.strip()]
    assert lines[-6:] == [("- " * 3000 if "li" in around else "") + "- a", "- b", "k      | value", "longer | 1",
                          "yes", "end"]
    assert not any("no" in line for line in lines)


def test_tables_nested_deep_lose_nothing():
    words = re.findall(r"w\d+", html_text.visible_text("".join(
        f"<table><tr><th>w{3 * i}<td>w{3 * i + 1}<br>w{3 * i + 2} " for i in range(2000))))
    assert sorted(words) == sorted(f"w{i}" for i in range(6000))


FOREIGN_CASES = {
    "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here": "so x=2 here",
    "<math><semantics><mi>y</mi><annotation encoding='x'>no</annotation><annotation-xml><ci>no</ci></annotation-xml>"
    "</semantics></math>": "y",
    "<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>": "1 2",
    "<svg><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs><style>no</style>"
    "<text>a <tspan>b</tspan></text><text x=1>c</text></svg>d": "a b\nc\nd",
    "<svg><defs/><title/><path d='M0 0'/><text><tspan x=0>a</tspan><tspan x=0 dy=9>b</tspan></text></svg>c": "a\nb\nc",
    "<svg><foreignObject><p>a<p>b</foreignObject><text>c</text></svg>": "a\n\nb\n\nc",
    "<svg><text><![CDATA[a < b]]></text></svg>": "a < b",
    "<svg hidden><text>no</text></svg><svg><path><p>yes": "yes",
    "<svg><text display=none>no</text><g visibility='hidden'><text>no</text></g><defs><br/>yes": "yes",
    "<desc>shown</desc> <symbol>in HTML</symbol>": "shown in HTML",
}


@pytest.mark.parametrize("html", FOREIGN_CASES)
def test_drawings_and_formulas_are_shown(html):
    assert html_text.visible_text(html) == FOREIGN_CASES[html]


def test_no_visible_word_of_drawings_and_formulas_is_lost():
    rng = random.Random(6)
    tags = "p div b ul li table tr td span math mi mo mn mrow mfrac svg text tspan g foreignObject a section".split()
    for _ in range(400):
        parts, words = [], []
        for i in range(rng.randrange(1, 40)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(f"<{rng.choice(tags)}{rng.choice(['', '', '/', ' x=1'])}>")
            elif kind < 0.6:
                parts.append(f"</{rng.choice(tags)}>")
            else:
                words.append(f"w{i}")
                parts.append(f" w{i} ")
        assert sorted(re.findall(r"w\d+", html_text.visible_text("".join(parts)))) == sorted(words)


LONG = "long " * 30 + "end"
TABLE_CASES = {
    f"<table><tr><th>k<th>text<th>n<tr><td>a<td>{LONG}<td>1<tr><td>b<td><td>2</table>":
        f"k | text | n\na | {LONG} | 1\nb |      | 2",
    "<table><tr><td>key<td>one<br>two<td>1<tr><td>k<td>three<td>2</table>":
        "key | one   | 1\n    | two\nk   | three | 2",
    "<table><tr><td><ul><li>x<li>y</ul><td><p>p<p>q<td>1<tr><td>k<td><td>2</table>":
        "- x | p | 1\n- y\n    | q\nk   |   | 2",
    f"<table role=presentation><tr><td>menu<td>{LONG}</table>": f"menu\n{LONG}",
    f"<table><tr><td>menu<td><h1>t</h1>{LONG}</table>": f"menu\nt\n\n{LONG}",
    "<table><tr><td>menu<td>x<table><tr><td>a<td>1<br>2</table></table>": "menu\nx\n\na | 1\n  | 2",
    "<table><tr><th>k<td>x<table><tr><td>a<td>1<tr><td>b<td>2</table></table>": "k | x\n  | a | 1\n  | b | 2",
}


TABLE_CASES |= {
    "<table><tr><td>or<td>|<tr><td>pipe<td>a |<tr><td>shell<td>||<td><td></table>": "or    | |\npipe  | a |\nshell | ||",
    "<table><tr><td>|<td>||<tr><td>a<td></table>": "| | ||\na",
}


@pytest.mark.parametrize("html", TABLE_CASES)
def test_tables_are_aligned_whatever_the_cells_hold(html):
    assert html_text.visible_text(html).splitlines() == TABLE_CASES[html].splitlines()


def test_padding_of_large_tables_is_bounded():
    page = "<table><tr>" + "<td>a" * 3000 + "<td>" + "x<br>" * 3000 + "<tr><td>b<td>c</table>"
    text = html_text.visible_text(page)
    assert len(text) < 20_000 and text.splitlines()[1] == "b | c"
    assert text.splitlines()[0] == "a | " * 3000 + " ".join("x" * 3000)


def test_pages_of_edge_rows(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (None, "", "u"), (2, "<p>a", "u"), (2, "<p>a", "u"), (3, "z" * 300_000, None)],
        "page_id bigint, html string, text string")
    rows = html_text.extracted(pages).collect()
    assert sorted(r.text[:1] for r in rows) == ["", "", "a", "a", "z"]
    assert html_text.extracted(pages.where("false")).count() == 0
