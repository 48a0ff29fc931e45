"""Main text of pages: markup, alignment by longest common subsequences, nearest pages of a host."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventscope.llm import page_text as pt

PAGES = "page_id long, url string, html string"


def length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 16])
def test_shared_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(pt, "MOST_BITS", bits)
    r = random.Random(bits)
    for _ in range(600):
        a, b = [[r.randrange(r.choice([2, 5, 20])) for _ in range(r.randrange(15))] for _ in range(2)]
        places, rest = pt.shared(a, b), iter(b)
        assert places == sorted(set(places)) and len(places) == length(a, b)
        assert all(a[k] in rest for k in places)


CASES = [
    ("", []),
    ("no markup &amp; &lt;b&gt; &amp;amp;", ["no markup & <b> &amp;"]),
    ("<p>a<b>b</b>\n c<br>d<p>e &copy &#x27;&#39;", ["ab c", "d", "e © ''"]),
    ("<article><header><h1>T</h1></header><p>x<nav>menu</nav><p>y</article><div>other</div><footer>f</footer>", ["T", "x", "y"]),
    ("<body class='no-sidebar'><header>h</header><main>m<aside>s</aside></main>o</body>", ["m"]),
    ("<script>var t='</p><article>';</script><style>p{}</style><div class=ad>buy</div>left", ["left"]),
    ("<article>a<section id='comments'>c<p>d</section>b</article><article class='comment'>z</article>", ["a", "b"]),
    ("<p class='cookie-notice'>c<p>text<div class=\"has-sidebar\">kept</div><div hidden>h</div><form>f<input>g</form>", ["text", "kept"]),
    ("<article>open <b>and never closed<p>q", ["open and never closed", "q"]),
    ("<div title=\"a > b\">in</div><a href='x>y'>l</a> 1 < 2 <", ["in", "l 1 < 2 <"]),
    ("</div></p>x<!-- <p>no --><!doctype html><?php no ?>y<!--", ["xy"]),
    ("<script>never closed <p>x", []),
    ("<div role=navigation>n</div><svg><text>s</text></svg><noscript>j</noscript><TITLE>t</TITLE><P>Z  z</P>", ["Z z"]),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_markup(page, want):
    assert [x.text for x in pt.lines_of(page)] == want


@pytest.mark.parametrize("piece", ["<", "<!--", "<a \"", "<div>", "<p><b>", "&amp", "<div>x</div>", "</b x='", "<script>", "word "])
def test_long_pages_take_linear_time(piece):
    import time

    began = time.perf_counter()
    pt.lines_of(piece * 100_000)
    assert time.perf_counter() - began < 10


def brute(rows):
    """The rules stated plainly: nearest page in order of host, path and key, longest common subsequences by table."""
    import hashlib

    known = {}
    for i, u, h in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)([^?#]*)", u or "")
        key = hashlib.md5("\n".join("" if v is None else str(v) for v in (i, u, h)).encode()).hexdigest()
        known[key] = (m and m[1].lower(), m and m[2], [x for x in pt.lines_of(h or "")])
    order = sorted((host, path, key) for key, (host, path, _) in known.items() if host)
    out = []
    for i, u, h in rows:
        key = hashlib.md5("\n".join("" if v is None else str(v) for v in (i, u, h)).encode()).hexdigest()
        host, path, lines = known[key]
        gone = set()
        if host:
            at = order.index((host, path, key))
            sides = [order[k] if 0 <= k < len(order) and order[k][0] == host else None for k in (at - 1, at + 1)]

            def common(s, path=path):
                n = 0
                for x, y in zip(path.split("/"), s[1].split("/"), strict=False):
                    if x != y:
                        break
                    n += 1
                return n

            near = sorted([s for s in sides if s], key=lambda s: -common(s))
            for s in near:
                a, b = [x.text for x in lines], [x.text for x in known[s[2]][2]]
                places = pt.shared(a, b)
                if sum(len(a[k]) for k in places) < 0.5 * sum(map(len, a)):
                    gone = {k for k in places if lines[k].level == 0 or lines[k].linked}
                    break
        text = " ".join(x.text for k, x in enumerate(lines) if k not in gone)
        out.append((i, u, text, len(text), len(gone)))
    return sorted(out, key=repr)


def site(r, host, n, article=False):
    top, end = f"<div>Home of {host}</div><div>News</div>", f"<div>All rights of {host}</div>"
    rows = []
    for k in range(n):
        body = "".join(f"<p>{' '.join(r.choices('alpha beta gamma delta epsilon zeta eta theta'.split(), k=r.randrange(6, 15)))} {r.random()}" for _ in range(r.randrange(2, 5)))
        body = f"<article>{body}<p><a href=/>More of {host}</a></article>" if article else f"<div>{body}</div>"
        rows.append((r.randrange(10_000), f"https://{host}/{r.choice('abc')}/{r.choice('de')}/{k}{r.choice(['', '?q=1', '#top'])}", top + body + end))
    return rows


def test_nearest_pages_delete_what_they_share(spark):
    r = random.Random(3)
    rows = site(r, "hot.example", 60) + site(r, "other.example", 7) + site(r, "art.example", 7, article=True) + [(1, "https://alone.example/", "<p>alone</p>"), (2, None, "<p>no url"), (None, "https://hot.example/a", None), (3, "odd", "")]
    rows += [rows[0], (99, *rows[5][1:]), (98, rows[6][1], rows[6][2] + "<p>new</p>")]  # a repeated row, two versions of a page
    docs = spark.createDataFrame(rows, PAGES)
    for parts in (1, 7):
        got = sorted((tuple(x) for x in pt.extract(docs.repartition(parts)).collect()), key=repr)
        assert got == brute(rows)
    texts = " ".join(x[2] for x in got)
    assert "All rights of hot" not in texts and "News" not in texts and "More of art" not in texts and "alone" in texts and any(x[4] for x in got)


def test_pages_with_articles_go_through_the_difference_and_then_the_check(spark):
    """All lines of all pages are compared; markup gives back what an article shares and takes what only one page's menus hold."""
    page = lambda k: f"<nav>Home</nav><nav>Only {k}</nav><article><p>Written by A. B.<p>{'text ' * 9}{k}<p><a href=/>More</a></article><footer>All rights</footer>"
    docs = spark.createDataFrame([(k, f"https://art.example/{k}", page(k)) for k in range(6)], PAGES)
    assert [(x.text, x.furniture) for x in pt.all_lines(page(3))] == [("Home", True), ("Only 3", True), ("Written by A. B.", False), (f"{'text ' * 9}3", False), ("More", False), ("All rights", True)]
    assert [list(r["gone"]) for r in pt.deletions(docs).collect()] == [[0, 2, 4, 5]] * 6
    got = {r["page_id"]: (r["text"], r["n_deleted"]) for r in pt.extract(docs).collect()}
    assert got == {k: (f"Written by A. B. {'text ' * 9}{k}", 1) for k in range(6)}


def test_joined_verdicts_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(site(random.Random(4), "hot.example", 20), PAGES)
    small = sorted(map(tuple, pt.extract(docs).collect()))
    monkeypatch.setattr(pt, "FEW_VERDICTS", 0)
    assert sorted(map(tuple, pt.extract(docs).collect())) == small


def test_empty_tables_and_clashing_columns(spark):
    assert pt.extract(spark.createDataFrame([], PAGES)).collect() == []
    docs = spark.createDataFrame(site(random.Random(5), "hot.example", 5), PAGES)
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("text", "__key", "host", "path", "gone", "key", "part", "lines")])
    assert sorted(map(tuple, pt.extract(clash).collect())) == sorted(map(tuple, pt.extract(docs).collect()))


def test_a_host_is_many_tasks(spark):
    """The order of pages is dealt by range, so that one host's rows lie in several partitions."""
    docs = spark.createDataFrame([(k, f"https://hot.example/{k:05d}", f"<p>page {k}") for k in range(4000)], PAGES)
    near = pt._near(pt._outline(pt._keyed(docs)))
    keys = near.join(pt._keyed(docs).select("page_id", F.col("__key").alias("key")), "key")
    names = pt._keyed(docs).select(F.col("page_id").alias("id_1"), F.col("__key").alias("near_1"))
    got = {r["page_id"]: r["id_1"] for r in keys.join(names, "near_1", "left").collect()}
    assert got == {k: k - 1 if k else 1 for k in range(4000)}
