"""Source audit and negative search against brute force; main texts of hand-made pages."""

import collections
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyscan.llm import hard_negatives, html_extract, source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, threshold):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = collections.Counter(t for l, _, terms in rows if l == lang for t in set(terms))
        kept = [t for t, n in docs.items() if n >= threshold]
        v = len(kept)
        counts = collections.defaultdict(collections.Counter)
        for l, source, terms in rows:
            if l == lang:
                counts[source].update({t: terms.count(t) for t in set(terms) if t in kept})
        whole = sum(counts.values(), collections.Counter())
        part = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source, c in counts.items():
            pairs = [(o, sum(f(part(c, t), part(counts[o], t)) for t in kept)) for o in counts if o != source]
            terms = [(t, f(part(c, t), part(whole, t))) for t in kept if c[t] and part(c, t) > part(whole, t)]
            for name, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, source, name, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("side,bucket", [(64, 4096), (2, 3)])
def test_audit_equals_brute_force(spark, monkeypatch, side, bucket):
    monkeypatch.setattr(source_audit, "SIDE", side)
    monkeypatch.setattr(source_audit, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    words = ["the", "The", "é", "ÉTÉ", "日本", "a" * 40, "a" * 41, "A" * 40 + "b", "x-y", "wörter", "thesis", "thesaurus", "w1w"] + [f"w{c}" for c in "abcdefg"]
    rows = [("en", f"s{rng.integers(5)}", " ".join(rng.choice(words, rng.integers(1, 9)))) for _ in range(40)]
    rows += [("en", "s0", None), (None, "s1", "the the"), ("", None, "the the"), ("de", "x", ""), ("de", "y", None), ("fr", "alone", "le le la")]
    rows += [("es", "p", "uno dos")] * 3 + [("es", "q", "dos uno")] * 3 + [("es", "none", "7")]  # repeated rows and ties
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as n", "'x' as term", "2 as v", "3 as i")
    found = source_audit.audit(docs, threshold=3)
    assert {tuple(r) for r in found.collect()} == brute_audit(rows, 3) and found.count() == len(brute_audit(rows, 3))
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_kept_terms_of_any_length(spark):
    """A term and its beginnings at every level border, and a very long one."""
    terms = ["a" * n for n in (1, 3, 4, 5, 8, 9, 16, 17, 33, 70_000)]
    rows = [("en", " ".join(terms)), ("en", " ".join(terms[::2])), ("xx", terms[0])]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {r["term"] for r in source_audit.kept_terms(docs, 2).collect()} == set(terms[::2])


def brute_negatives(rows, every):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v])
        best[i] = min(best.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, v) in best.items():
        if a % every:
            continue
        ranked = sorted((-score(v, w), i, m) for i, (m, w) in best.items() if i != a)
        for p, i, _ in [r for r in ranked if r[2] == label][:5]:
            fit = [(-s, j) for s, j, m in ranked if m != label and 30 * -p <= 100 * -s <= 90 * -p]
            out |= {(a, i, k, j, -p, s) for k, (s, j) in enumerate(fit[:10], 1)}
    return out


@pytest.mark.parametrize("rows,anchors,together", [(32768, 8192, 32), (40, 3, 2)])
def test_negatives_equal_brute_force(spark, monkeypatch, rows, anchors, together):
    for name, value in (("ROWS", rows), ("ANCHORS", anchors), ("TOGETHER", together)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(7)
    made = rng.normal(size=(400, 24)) * 0.3 + rng.normal(size=(4, 24))[rng.integers(4, size=400)]
    data = [(i, [float(np.float32(x)) for x in v], int(rng.integers(3))) for i, v in enumerate(made)]
    data += [(1000 + i, data[0][1], i % 2) for i in range(30)]  # a frequent vector: ties
    data += [(2000, None, 1), (2010, [1.0, None], 1), (2020, [float("nan")], 1), (2030, [float("inf")], 2), (None, [1.0], 1), (2040, [0.5], None)]
    data += [(2050, [], 1), (2060, [0.9, 0.8], 0), (10, data[11][1], 2), (10, data[10][1], 2)]  # short vectors, repeated ids
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as a", "2 as b", "'x' as v", "3 as score")
    found = hard_negatives.hard_negatives(table, every=10)
    want = brute_negatives(data, 10)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) > 500
    assert hard_negatives.hard_negatives(table.limit(0)).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(9)
    b = hard_negatives.Bounded(rng.integers(-300, 300, (200, 50)), rng.integers(-300, 300, (20, 50)))
    for a in range(20):
        at = np.arange(200)
        exact, before = b.exact(a, at), None
        for level in range(len(b.levels)):
            low, high = b.closer(level, a, at)
            assert (low <= exact).all() and (exact <= high).all()
            assert before is None or (high - low).sum() <= before
            before = (high - low).sum()


LONG = "A paragraph of the article that has a good many words in it, so that it is denser than all the menus are."
PAGES = [
    (None, ""), ("", ""), (" \n ", ""), ("plain &amp; simple &eacute;&#233;&#xe9; text", "plain & simple ééé text"),
    ("<nav><a href=/>Home</a></nav><script>var a = '<p>no</p>'</script><style>p{}</style>", ""),
    (f"<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav><article><h1>Title</h1><p>{LONG}"
     f"<p>Short.<br>Line</p><ul><li>one<li>two</ul></article><aside>Side {LONG}</aside><footer>(c)</footer>", f"Title\n{LONG}\nShort. Line\none\ntwo"),
    # no semantic tags, unnamed menus, names of notices, comments and adverts, attributes without quotes
    (f"<body class=has-sidebar><div><a href=/>Home</a> <a href=/b>Blog</a> <a href=/c>Contact</a></div><div class=wrap><h1>Title</h1><div class=post><p>{LONG}</p>"
     f"<p>Second: {LONG}</p></div><div class='sidebar-right'><p>{LONG}</p></div></div><div id=comments><p>{LONG}</p></div><div class='cookieNotice'>{LONG}</div>"
     f"<div class=\"ad-slot\">{LONG}</div><form><p>{LONG}</p></form>", f"Title\n{LONG}\nSecond: {LONG}"),
    # an article's own header, comments inside, cut off inside a tag
    (f"<main><article><header><h1>T</h1><p class=byline>By A</p></header><p>{LONG}</p><section class=comments><article class=comment><p>{LONG}</p></article></section>"
     f"<p>End <b>bold <a hr", f"T\nBy A\n{LONG}\nEnd bold"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><!-- <p>no</p> --><p>3 < 4</p><p>a<noscript>no</noscript>&nbsp; b\n\tc</p></article>", "3 < 4\na b c"),
    (f"<DIV><DIV ID='x>y'>{LONG}</DIV><P>Two</DIV>", f"{LONG}\nTwo"),
    # parts of one article in several containers, with an advert between
    (f"<body><div class=part><p>{LONG}</p><p>{LONG}</p></div><div class=ad>Buy</div><div class=part><p>{LONG}</p><p>x {LONG}</p></div></body>", f"{LONG}\n{LONG}\n{LONG}\nx {LONG}"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>open comment<!-- rest <p>gone", "open comment"),
]


def test_main_texts(spark):
    rows = [(i, f"u{i}", html) for i, (html, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>"), (1, "again", "<p>x</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars")
    found = html_extract.extract(table).collect()
    assert [r["text"] for r in found] == [t for _, t in PAGES] + ["x", "x"]
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_extract.extract(table.limit(0)).count() == 0


def test_long_and_broken_pages():
    started = time.time()
    assert len(html_extract.main_text("<p>" + "word " * 400_000)) == 1_999_999
    assert html_extract.main_text("<div>" * 50_000 + "deep") == "deep"
    for piece in ("<p>x", "<b>x", "<!--", "<a ", '<a b="', "&", "<li><div>", "</p>", "<p><b>x<br>", "<"):
        html_extract.main_text(piece * 50_000)
    assert time.time() - started < 60


def test_density_prefers_text_over_links(spark):
    root = html_extract.tree("<body><div>" + "<a href=x>some link text here</a> " * 20 + f"</div><div><p>{LONG}</p></div></body>")
    nodes = html_extract.order(root)
    html_extract.weigh(nodes)
    links, text = [n for n in nodes if n.tag == "div"]
    assert links.link_chars == links.chars > 3 * text.chars and links.links == 20
    assert html_extract.density(text, root) > html_extract.density(links, root)
