import html
import math
import random
import re
from collections import Counter

from sparktap.llm import html_extract as H


def article_text(page):
    """Another way for these pages: the article element's text, cut at its block tags."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|article)>", body)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks) if x)


def test_whole_table(spark, sf_mid):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_mid}/pages.parquet").collect()}
    rows = H.op8_html_extract(spark, sf_mid).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><div class=top>Site name &amp; claim</div>
<div class="cookie-notice">We use cookies</div><div class=body><p>First {n} a<b>b</b>c <i>d</i><p>a &lt; b &copy &#233; < 3<br>next<ul><li>one {n}<li>two</ul>
<script>var x = "</p>";</script><!-- hidden <p>no</p> --><form><p>Name</p></form><section class="comments"><p>nice</p></section></div>
<div class=base>Always the same</div><footer>F</footer>"""


def rows_of(spark, broadcast_nodes):
    pages = [(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(8)] + [(8, None, None), (9, "x", ""), (10, "http://b.example/", PAGE.format(n="z")), (0, "http://a.example/0", PAGE.format(n=0))]
    d = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    return H.extract(d, broadcast_nodes=broadcast_nodes).collect()


def test_branches_without_importance_go(spark):
    for limit in (H.BROADCAST_NODES, 0):
        rows = rows_of(spark, limit)
        got = {r.page_id: r.text for r in rows}
        assert len(rows) == 12
        assert got[3] == "First 3 abc d\na < b © é < 3 next\none 3\ntwo"
        assert got[8] == got[9] == ""
        assert got[10].startswith("Site name & claim\nFirst z") and got[10].endswith("Always the same")


def test_broken_pages_never_raise():
    for page in ("<", "<p", "</", "<a href='x>y", "<!--", "<script>x", "<p><div></p></div>" * 50, "<table><tr><td>a<td>b<tr><td>c</table>", "\x00<p>퟿", "<b>" * 3000):
        H.styles(page)
        H.main_text(page, set())
    assert H.main_text("<table><tr><td>a<td>b<tr><td>c</table>", set()) == "a\nb\nc"
    assert H.main_text("<article><p>x &am y &quo</p></article><p>z", set()) == "x &am y &quo"


def test_entropy_decides_within_articles(spark):
    page = "<body><article><h1>Title {n}</h1><div class=x7><p>Read our terms before use</p></div><div class=y2><p>Body {n}</p></div><div {box}>Box {n}</div></article></body>"
    pages = [(i, f"http://a.example/{i}", page.format(n=i, box="id=comments" if i % 2 else "id=part")) for i in range(8)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (H.BROADCAST_NODES, 0):
        got = {r.page_id: r.text for r in H.extract(d, broadcast_nodes=limit).collect()}
        assert got == {i: f"Title {i}\nBody {i}" + ("" if i % 2 else f"\nBox {i}") for i in range(8)}


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><article><h1>Title</h1><p>All copies are alike</p></article></body>"
    d = spark.createDataFrame([(i // 2, f"http://a.example/{i // 2}", page) for i in range(16)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(d).collect()} == {"Title\nAll copies are alike"}


def brute_importance(pages):
    """{host: {path: importance}} by dictionaries, page by page; pages: (host, html)."""
    seen, rows = set(), {}
    for host, page in pages:
        if (host, page) in seen:
            continue
        seen.add((host, page))
        for path, fixed, layout, content in H.styles(page):
            rows.setdefault((host, path), []).append((fixed, layout, content))
    out = {}
    for (host, path), found in rows.items():
        fixed = [f for f, _, _ in found]
        if 1 in fixed:
            value = 1.0
        elif 0 in fixed:
            value = 0.0
        elif len(found) < H.LEAST_PAGES:
            value = 1.0
        else:
            parts = []
            for k in (1, 2):
                shares = [n / len(found) for n in Counter(x[k] for x in found).values()]
                parts.append(-sum(p * math.log(p) for p in shares) / math.log(len(found)))
            value = sum(parts) / 2
        out.setdefault(host, {})[path] = value
    return out


#: No article, no telling names: only what pages of a host have in common tells what is template.
SILENT = "<body><div class=a1><span>Shop of {host}</span><ul><li>Home<li>About us</ul></div><div class=b2><h2>Story {n}</h2><p>Text {n} of {host}</p>{more}</div><div class=c3>{box}</div><div class=d4>All rights reserved</div></body>"


def silent_pages():
    rng = random.Random(3)
    for host in ("one.example", "two.example", "few.example"):
        for n in range(3 if host.startswith("few") else 30):
            more = f"<p>More {rng.random()}</p>" * rng.randint(0, 3)
            yield f"http://{host}/{n}", SILENT.format(host=host, n=n, more=more, box="Offer of the day" if n % 10 else f"Offer {n}")


def test_importance_and_texts_against_brute_force(spark, sf_small):
    real = [(r.url, r.html) for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()]
    pages = [*silent_pages(), *real]
    host = lambda u: re.match("[a-z]+://([^/?#]*)", u)[1].lower()
    known = brute_importance([(host(u), p) for u, p in pages])
    want = [H.main_text(p, {x for x, v in known[host(u)].items() if v < H.LEAST_IMPORTANCE}) for u, p in pages]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for limit in (H.BROADCAST_NODES, 0):
        got = {r.page_id: r.text for r in H.extract(d, broadcast_nodes=limit).collect()}
        assert got == dict(enumerate(want))


def test_without_entropy_other_texts_come_out(spark):
    pages = list(silent_pages())
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    on = {r.page_id: r.text for r in H.extract(d).collect()}
    off = {r.page_id: r.text for r in H.extract(d, least_pages=1 << 40).collect()}
    differ = [i for i in on if on[i] != off[i]]
    assert len(differ) == 60 and all("few." in pages[i][0] for i in set(on) - set(differ))
    assert all(on[i].startswith("Story") and "rights" not in on[i] and "About us" in off[i] for i in differ)


def test_long_pages_and_repeated_ids(spark):
    long = "<article>" + "<div>" * 2000 + "<p>word </p>" * 50_000 + "</div>" * 2000 + "</article>"
    d = spark.createDataFrame([(1, "http://a.example/1", long), (1, "http://a.example/1", "<article>other</article>"), (None, None, "<p>x")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, len(r.text)) for r in H.extract(d).collect())
    assert got == [(0, 1), (1, 5), (1, 50_000 * 5 - 1)]
    assert H.extract(d.limit(0)).count() == 0
