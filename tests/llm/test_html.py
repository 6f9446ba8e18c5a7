"""Main text of pages: parsing, matching against brute force, templates, awkward rows."""

import random
from functools import lru_cache

import numpy as np
import pytest

from tillroll.llm import wrapper
from tillroll.llm.html_tree import Matcher, Page, in_order

SCHEMA = "page_id long, url string, html string"


def texts(html):
    return [b[1] for b in Page(html).blocks]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<p>b", ["a", "b"]),
        ("<p>a <b>b<br>c</p>d<i> e", ["a b c", "d e"]),
        ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", ["x", "y", "z", "w"]),
        ("<script>var t='</p><p>no</p>';</script ><p>yes", ["yes"]),
        ("<p>1 < 2 &amp;&lt;b&gt;&nbsp;&#233;&#xe9;&copy &am", ["1 < 2 &<b> éé© &am"]),
        ("<!-- <p>no --><p>a<!-- x -->b</p><!-- open <p>no", ["ab"]),
        ('<p title="a > b">c</p><p title=\'x"\'>d<a href="y', ["c", "d"]),
        ("<p>one\n\t two\x0b three </p>", ["one two three"]),
        ("<NAV>m</NAV><Header>h</Header><P>t</P><FOOTER>f</FOOTER>", ["t"]),
        ('<div class="ad">a</div><div class="header-ad x">a</div><div class="shadow">t</div>', ["t"]),
        ('<article class="post has-comments"><p>t</p><div id="comments">c</div></article>', ["t"]),
        ("<article><header><h1>h</h1></header><p>t</p><footer>f</footer></article>", ["h", "t"]),
        ("<p>a <span class='ad'>b</span> c</p>", ["a c"]),
        ("<form><p>q</p></form><p>a</p><aside><p>s", ["a"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<pre>a\n  b</pre>", ["a b"]),
        ("</p></div>text</body>", ["text"]),
        ("<div role='navigation'>m</div><div role=main>t</div>", ["t"]),
        ("", []), ("plain", ["plain"]), ("<p", []), ("a<", ["a<"]), ("<p>x</p", ["x"]),
    ],
)
def test_blocks(html, want):
    assert texts(html) == want


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>in</p>" + "</div>" * 3000 + "<p>out"
    page = Page(deep)
    assert [b[1] for b in page.blocks] == ["in", "out"]
    skeleton, place = page.skeleton()
    assert len(place) == len(page.labels)
    long = "".join(f"<p>{i}</p><div>{i}</div>" for i in range(20_000))
    skeleton, place = Page(long).skeleton()
    matcher = Matcher()
    a, b = matcher.read(skeleton), matcher.read("3:# 0:p 0:h1 0:div")
    assert sum(x >= 0 for x in matcher.align(a, b)) == 3


def random_tree(rng, size):
    parents, labels = [-1], ["#"]
    for _ in range(size):
        parents.append(rng.randrange(len(parents)))
        labels.append(rng.choice("abc"))
    children = [[i for i, p in enumerate(parents) if p == n] for n in range(len(parents))]

    def written(n):
        return [f"{len(children[n])}:{labels[n]}", *(t for c in children[n] for t in written(c))]

    return " ".join(written(0))


def test_simple_tree_matching_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        matcher = Matcher()
        a, b = (matcher.read(random_tree(rng, rng.randint(0, 12))) for _ in "ab")

        @lru_cache(None)
        def most(i, j, a=a, b=b):
            if a.labels[i] != b.labels[j]:
                return 0

            def rows(x, y):
                if not x or not y:
                    return 0
                return max(rows(x[1:], y), rows(x, y[1:]), most(x[0], y[0]) + rows(x[1:], y[1:]))

            return 1 + rows(tuple(a.children[i]), tuple(b.children[j]))

        found = matcher.align(a, b)
        pairs = [(i, j) for i, j in enumerate(found) if j >= 0]
        assert matcher.score(a, b, 0, 0) == most(0, 0) == len(pairs)
        assert len({j for _, j in pairs}) == len(pairs)
        for i, j in pairs:  # parents are matched to parents, order is kept
            assert a.labels[i] == b.labels[j]
            assert i == 0 or found[a.parents[i]] == b.parents[j]
        assert [j for _, j in pairs] == sorted(j for _, j in pairs)


def test_in_order_split_in_two(monkeypatch):
    from tillroll.llm import html_tree

    rng = np.random.default_rng(1)
    for _ in range(30):
        weight = rng.integers(0, 4, (3, 3))
        rows, columns = rng.integers(0, 3, 11), rng.integers(0, 3, 9)
        whole = in_order(weight, rows, columns)
        monkeypatch.setattr(html_tree, "_CELLS", 6)
        split = in_order(weight, rows, columns)
        monkeypatch.undo()
        total = [sum(weight[rows[i], columns[j]] for i, j in p) for p in (whole, split)]
        assert total[0] == total[1]
        assert all(a < c and b < d for (a, b), (c, d) in zip(split, split[1:]))


def page(i, body, host="Shop.Example"):
    return (i, f"https://user@{host}:8080/p/{i}?q", body)


def site(i, words, extra=""):
    return (
        "<html><head><title>t</title></head><body><div><p>Welcome to the shop</p></div>"
        f"<div><h1>Title {i}</h1><p>{words}</p>{extra}<p>Written by our team</p></div></body>"
    )


def extracted(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = wrapper.extract(df, **options)
    return {r.page.page_id: r.text for r in found.collect()}, found


def test_constant_slots_are_template_and_varying_ones_content(spark):
    rows = [page(i, site(i, f"text number {i}", f"<div>more {i}</div><div>see also</div>" if i % 3 == 0 else "")) for i in range(9)]
    # copies of one page do not make its text template
    rows += [page(100 + i, site(100, "the copied text", f"<!-- {i} -->")) for i in range(30)]
    # another host says the same once: nothing to compare with
    rows += [page(200, site(200, "alone"), "other.example")]
    got, _ = extracted(spark, rows)
    assert got[1] == "Title 1\n\ntext number 1"
    assert got[0] == "Title 0\n\ntext number 0\n\nmore 0"  # on three of nine pages only
    assert all(got[100 + i] == "Title 100\n\nthe copied text" for i in range(30))
    assert got[200] == "Welcome to the shop\n\nTitle 200\n\nalone\n\nWritten by our team"


def test_a_marked_article_is_the_text(spark):
    body = "<div>Related: x{0}</div><article><h1>T{0}</h1><p>one {0}</p></article><div>more {0}</div>"
    got, _ = extracted(spark, [page(i, body.format(i)) for i in range(4)])
    assert got[2] == "T2\n\none 2"
    body = "<ul><li><a href=1>Link {0}</a></ul><div>word {0} <a>link</a></div>"
    got, _ = extracted(spark, [page(i, body.format(i)) for i in range(4)])
    assert got[2] == "word 2 link"


def test_awkward_rows(spark):
    rows = [(1, None, "<p>a"), (2, "", None), (3, "no host", ""), (4, "//h/x", "<p>b"), (4, "//h/x", "<p>b"),
            (None, "//h/y", "<p>c"), (5, "http://h", "x " * 200_000), (6, "//h", "<article></article><p>z")]
    df = spark.createDataFrame([(*r, "mine", 7) for r in rows], SCHEMA + ", host string, text int")
    got = wrapper.extract(df).select("page.*", wrapper.F.col("text").alias("t"), "n_chars").collect()
    want = {1: "a", 2: "", 3: "", 4: "b", None: "c", 5: "x " * 199_999 + "x", 6: "z"}
    assert len(got) == len(rows) and all(r.t == want[r.page_id] and r.n_chars == len(r.t) for r in got)
    assert all((r.host, r["text"]) == ("mine", 7) for r in got)
    assert wrapper.extract(df.limit(0)).count() == 0


def test_hot_host_pages_are_not_gathered(spark):
    """Every step that meets whole pages deals them by row, or joins what is small."""
    _, found = extracted(spark, [page(i, site(i, f"text {i}")) for i in range(20)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Window" not in plan


def test_query_on_the_pages_table(spark):
    """Against the article element cut out by hand; the table's pages all have one."""
    import html
    import re

    import __spark_entry__ as registry

    sf = "/root/testdata/sf0.001"
    source = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = registry.queries()["op13_html_text"](spark, sf).collect()
    assert len(got) == len(source)
    for row in got:
        cut = source[row.page_id].html.split("<article>", 1)[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", cut.replace("<br>", " ")))
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert row.text == "\n\n".join(b for b in blocks if b)
        assert (row.url, row.n_chars) == (source[row.page_id].url, len(row.text))
