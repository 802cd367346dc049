"""Wrappers against a brute-force aligner and plain readings of small hosts."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from textloom.llm import html_wrapper as hw

PAGES = "page_id bigint, url string, html string"


def alone(page):
    """The text of a page whose host has no other."""
    wrapper = hw.page_wrapper(page)
    found = hw.blocks(page)
    judged = hw.verdicts(wrapper)
    own = hw.page_verdicts([b.path for b in found], wrapper, judged)
    return [b.text for b, v in zip(found, own) if v >= max(1, min(hw.least_verdict(wrapper, judged), max(own, default=0)))]


def texts(spark, rows):
    return {r.page_id: r.text for r in hw.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_article_without_the_rest(spark):
    page = """<html><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use</div>
      <article><h1>T &eacute;</h1><div class="ad-slot">buy</div><p>One <i>two</i><br>three<p>four &lt;b&gt;<ul><li>a<li>b</ul>
      <form>x<input></form><aside>rel</aside><!-- c --><script>if(a<b){}</script><div id="comments"><p>nice</p></div></article><footer>f</footer></body></html>"""
    got = texts(spark, [(1, "http://a.example/x", page), (2, None, None), (3, "http://a.example/y", ""), (4, "http://only.example/", ""), (1, "http://a.example/x", page)])
    assert got == {1: "T é\n\nOne two three\n\nfour <b>\n\na\n\nb", 2: "", 3: "", 4: ""}


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<html><head><title>t</title><meta charset=a><body><article><p>abc</article>", ["abc"]),
        ('<body class="has-sidebar"><article><p>abc</p></article>', ["abc"]),
        ("<article><header><h1>Title</h1></header><p>t</p></article>", ["Title", "t"]),
        ("<article><p>x<svg width=1 />more</p><p>z</p></article>", ["x", "more", "z"]),
        ("<article><p>x</p><canvas><p>z</p><iframe src=x><p>zz</article>", ["x", "z", "zz"]),
        ('<main><div class="share-table">aaa</div><p class="notice-period">bb</p><div class="ad-slot">buy</div></main>', ["aaa", "bb"]),
        ('<article><p hidden>no</p><p aria-hidden="false">yes</p><div style="display: none">no</div></article>', ["yes"]),
        ("<article>" + "<div>" * 3000 + "deep" + "</article>", ["deep"]),
        ("<article><p>" + "long " * 200_000 + "</p></article>", [("long " * 200_000).strip()]),
    ],
)
def test_markup_that_is_not_neat(page, expected):
    assert alone(page) == expected


@lru_cache(None)
def longest(a, b):
    """Length of a longest common subsequence, by trying everything."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + longest(a[1:], b[1:])
    return max(longest(a[1:], b), longest(a, b[1:]))


def test_alignment_against_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(9))] for _ in range(2))
        steps = hw.common(a, b)
        pairs = [(i, j) for i, j in steps if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest(tuple(a), tuple(b))
        assert [i for i, _ in steps if i is not None] == list(range(len(a))) and [j for _, j in steps if j is not None] == list(range(len(b)))


def test_groups_slots_and_optional_items():
    items, of = hw.fold(["h2", "p", "p", "h2", "p", "div", "h2", "p"])
    assert items == [["h2", True], ["p", True], ["div", False], ["h2", False], ["p", False]] and of == [0, 1, 1, 0, 1, 2, 3, 4]
    whole = hw.align(hw.page_wrapper("<h1>A</h1><p>same</p><div>x</div>"), hw.page_wrapper("<h1>B</h1><p>same</p><p>more</p>"))
    assert [(x.path, x.slot, x.optional, x.repeated) for x in whole] == [("h1", True, False, False), ("p", True, False, True), ("div", False, True, False)]


def test_constants_of_a_host_go_and_slots_stay_without_names(spark):
    """No tag or class tells; against a plain reading: a block whose text all pages have at its place is template."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    imprint = " ".join(word() for _ in range(60))
    rows, expected = [], {}
    for k in range(12):
        body = [" ".join(word() for _ in range(30)) for _ in range(3 + k % 4)]
        heading = word()
        extra = "<h3>You may like</h3>" * (k % 2)
        html = f"<div><span>All topics</span></div><h2>{heading}</h2>" + "".join(f"<p>{x}</p>" for x in body) + extra + f"<div>{imprint}</div>"
        rows.append((k, f"https://plain.example/{k}", html))
        expected[k] = "\n\n".join([heading, *body])
    assert texts(spark, rows) == expected
    assert texts(spark, rows[::-1]) == expected
    # a page of another template on the same host, and exact copies of one page
    other = rows + [(100, "https://plain.example/o", "<main><p>short</p></main>")] + [(200 + k, "https://copies.example/c", rows[0][2]) for k in range(3)]
    got = texts(spark, other)
    assert got[100] == "short" and {k: got[k] for k in expected} == expected and got[200] == got[202] != ""


def test_result_does_not_depend_on_the_layout_nor_on_the_way_of_the_join(spark, monkeypatch):
    rnd = random.Random(3)
    tags = ["h2", "p", "ul", "blockquote", "pre", "table"]
    rows = []
    for k in range(80):
        html = "<div>menu</div>" + "".join(f"<{t}>{t} {rnd.random()}</{t}>" for t in (rnd.choice(tags) for _ in range(rnd.randrange(1, 12)))) + "<div>imprint</div>"
        rows.append((k, "http://hot.example/" if k % 3 else None, html))
    df = spark.createDataFrame(rows, PAGES)
    one = sorted(map(tuple, hw.extract_main_text(df.coalesce(1)).collect()))
    monkeypatch.setattr(hw, "FAN", 3)
    monkeypatch.setattr(hw, "HELD_SKELETONS", 2)
    small = sorted(map(tuple, hw.extract_main_text(df.coalesce(1)).collect()))
    many = sorted(map(tuple, hw.extract_main_text(df.repartition(7)).collect()))
    monkeypatch.setattr(hw, "BROADCAST_BYTES", -1)
    salted = sorted(map(tuple, hw.extract_main_text(df.repartition(5)).collect()))
    assert small == many == salted and len(one) == 80
    assert all("imprint" not in r[2] and "menu" not in r[2] for r in one + small)


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "<article><p>x</p></article>")], PAGES)
    clash = df.withColumns({"host": F.lit("mine"), "wrapper": F.lit(7), "row": F.lit(8), "text": F.lit("old"), "salt": F.lit(9)})
    got = hw.extract_main_text(clash).collect()
    assert [(r.host, r.wrapper, r.row, r.salt, r.text) for r in got] == [("mine", 7, 8, 9, "x")]
    assert hw.extract_main_text(df.limit(0)).count() == 0


BODY = "A body of some length that says what the page is about, number {k}, and goes on for a while with {w}."


def host_of_pages(form, n=8):
    rnd = random.Random(n)
    words = lambda: " ".join(f"w{rnd.randrange(999)}" for _ in range(12))
    return [(k, f"http://h.example/{k}", "<html><body><div class=top>Site</div>" + form.format(k=k, body=BODY.format(k=k, w=words()), more=BODY.format(k=-k, w=words())) + "<div class=end>About us</div></body></html>") for k in range(n)]


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "ad-300x250", "article-comments", "sponsored_box", "cookieBanner newsletter-x"])
def test_comments_and_adverts_go_whatever_else_their_name_says(spark, name):
    pages = host_of_pages('<article><h1>T{k}</h1><p>{body}</p><div class="' + name + '"><p>{more}</p></div></article>')
    got = texts(spark, pages)
    assert all(got[k].startswith(f"T{k}\n\nA body") and got[k].count("A body") == 1 for k in got)


@pytest.mark.parametrize("form", ['<article><h1>Title {k}</h1></article><div class="content"><p>{body}</p><p>{more}</p></div>', '<main><p>Title {k}</p></main><div class="post-content"><p>{body}</p><p>{more}</p></div>'])
def test_the_mass_of_text_decides_between_containers(spark, form):
    got = texts(spark, host_of_pages(form))
    for k, text in got.items():
        title, *bodies = text.split("\n\n")
        assert title == f"Title {k}" and len(bodies) == 2 and all("A body" in b for b in bodies)


def test_text_beside_a_large_article_goes(spark):
    got = texts(spark, host_of_pages('<article><h1>T{k}</h1><p>{body}</p><p>{more}</p></article><div class="content-extra post"><p>Read {k} too</p></div>'))
    assert all("too" not in t and t.count("A body") == 2 for t in got.values())


@pytest.mark.parametrize("cells", [1, 7, 60])
def test_halved_alignments_are_longest(monkeypatch, cells):
    monkeypatch.setattr(hw, "TABLE_CELLS", cells)
    rnd = random.Random(cells)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(12))) for _ in range(2))
        steps = hw.common(list(a), list(b))
        both = [(i, j) for i, j in steps if i is not None and j is not None]
        assert [i for i, _ in steps if i is not None] == list(range(len(a))) and [j for _, j in steps if j is not None] == list(range(len(b)))
        assert len(both) == longest(a, b) and all(a[i] == b[j] for i, j in both)


def test_two_long_unlike_pages_align_in_little_memory():
    import tracemalloc

    rnd = random.Random(2)
    a, b = ([f"p{rnd.randrange(40)}" for _ in range(6000)] for _ in range(2))
    tracemalloc.start()
    steps = hw.common(a, b)
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    assert sum(i is not None and j is not None for i, j in steps) == hw._prefix_lengths(a, b)[-1]
