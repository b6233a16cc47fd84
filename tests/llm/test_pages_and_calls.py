"""HTML extraction and tool-call records."""

import html
import random
import re
import time

from pyspark.sql import functions as F

from graphloom.llm import queries, toolcalls, wrapper
from graphloom.llm.html import lines, parse

from ..oracle import FOLDER


def plain_article(page):
    inner = re.search(r"(?s)<article>(.*)</article>", page).group(1)
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.QUERIES["op1_html_extraction"](spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain_article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_reader():
    text = lambda x: lines(parse(x))
    assert text("<p>a  <b>b</b>\n c<p>d&amp;&eacute;&#x41;&nbsp;e<br>f") == ["a b c", "d&éA e", "f"]
    assert text('<script>var t="</p>";</script><style>p{}</style><p title="a>b">x</p><!-- <p>no</p> -->y') == ["x", "y"]
    assert text("a < b <p>c</p") == ["a < b", "c"]
    assert text('<div class="sidebar">no</div><div class="with-sidebar">yes</div><form>no</form><ul><li>1<li>2</ul>') == ["yes", "1", "2"]
    assert text('<div hidden>no</div><div style="display:none">no</div><div id="cookie-notice">no</div><section class="comments"><p>no</p></section>ok') == ["ok"]
    assert text('<div class="main-menu">no</div><article class="post"><div class="article-header">t</div><div class="post-comments">no</div>x</article>') == ["t", "x"]
    assert wrapper.main_text('<div class="menu-page"><article>kept</article></div>', None) == "kept"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert text("<div>" * 5000 + "deep") == ["deep"] and text(None) == text("") == text("<") [:0]
    assert text("<textarea>no</textarea><title>no</title>&lt;p&gt;") == ["<p>"]


def test_names_on_ancestors_and_inside_articles():
    text = lambda x: wrapper.main_text(x, None)
    assert text('<div class="layout sidebar-right"><article>Real text of the page.</article></div><p>tiny tail</p>') == "Real text of the page."
    assert text('<form id="aspnetForm"><div class=top-menu>Home</div><div><h1>T</h1><p>Real text of the page.</p></div><footer>f</footer></form>') == "T\nReal text of the page."
    inner = '<p class="search-engines">a</p><p id="related-work">b</p><p class="notice-period">c</p>'
    assert text(f"<article>{inner}</article>") == "a\nb\nc"
    assert text("<main><h1>Title</h1><p>Lead</p><article>Teaser</article></main><article>Other</article>") == "Title\nLead\nTeaser"
    for name in ("commentlist", "user-feedback", "adslot", "post-comments", "relatedPosts", "share_buttons", "topnav"):
        assert text(f"<article>x<div class={name}><p>gone, however long it may be</p></div></article>") == "x"
    assert text('<div class=story>Short.</div><section class=comments><article class=comment>A long comment of a reader.</article></section>') == "Short."
    assert text('<p>Text <span class="ad">no</span> goes <span class="commentary">on</span>.</p>') == "Text goes on."
    assert text("<nav>n</nav><footer>f</footer>") == ""


def plain_matching(a, b, i=0, j=0):
    """Most nodes matched below a pair of nodes with equal labels, by trying every choice."""
    xs, ys = ([k for k, n in enumerate(t) if n[0] == at] for t, at in ((a, i), (b, j)))

    def best(x, y):
        if not x or not y:
            return 0
        out = max(best(x[1:], y), best(x, y[1:]))
        return max(out, plain_matching(a, b, x[0], y[0]) + best(x[1:], y[1:])) if a[x[0]][1] == b[y[0]][1] else out

    return 1 + best(xs, ys)


def test_tree_matching_against_every_choice():
    r = random.Random(5)

    def tree():
        out = [(-1, "r", 0, 0, 0)]
        for _ in range(r.randint(0, 8)):
            out.append((r.randrange(len(out)), r.choice("ab"), 0, 0, 0))
        return out

    for _ in range(150):
        a, b = tree(), tree()
        pairs = wrapper.align(a, b)
        assert len(pairs) == plain_matching(a, b) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
        assert all(a[i][1] == b[j][1] and (i == 0 or (a[i][0], b[j][0]) in pairs) for i, j in pairs)


def test_long_pages_in_time():
    pairs = wrapper.skeleton(parse("<body>" + "<h2>h</h2><p>t</p>" * 1200 + "</body>"))
    began = time.perf_counter()
    assert len(wrapper.align(pairs, pairs)) == len(pairs) and time.perf_counter() - began < 1.5
    bushy = wrapper.skeleton(parse("<body>" + "<div><h2>h</h2><p>t</p></div>" * 3000 + "</body>"))
    began = time.perf_counter()
    assert len(wrapper.align(bushy, bushy)) == len(bushy) and time.perf_counter() - began < 15
    began = time.perf_counter()
    assert lines(parse("<div>" * 20_000 + "deep")) == ["deep"] and len(lines(parse("<span>" * 20_000 + "<div>x</div>" * 20_000))) == 20_000
    assert time.perf_counter() - began < 5


def page(n, body, title="t"):
    menu = "".join(f"<li><a href=/x{i}>Menu {i}</a></li>" for i in range(4))
    return f"<html><body><div class=top><ul>{menu}</ul></div><div class=wrap><div class=box><h1>{title} {n}</h1>{body}</div><div class=low>Company Ltd, all pages</div></div></body></html>"


def test_wrapper_without_semantic_tags(spark):
    body = lambda n: "".join(f"<p>Paragraph {n} {k} has its own words.</p>" for k in range(2 + n % 5))
    rows = [(n, f"http://h.example/{n}", page(n, body(n))) for n in range(12)]
    rows += [(100, None, None), (101, "http://one.example/", ""), (102, "http://h.example/x", "<p>odd page</p>"), (0, "http://h.example/0", page(0, body(0)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS kind", "3 AS text", "4 AS wrapper", "5 AS key", "6 AS fixed")
    got = wrapper.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"].split("\n")[0] == "t 3" and "Company" not in by[3]["text"] and "Menu" not in by[3]["text"]
    assert by[3]["text"].count("\n") == 5 and by[100]["text"] == by[101]["text"] == "" and by[102]["text"] == "odd page"
    assert wrapper.extract(df.limit(0)).count() == 0


def test_container_keeps_all_varying_text(spark):
    def page(n):
        lead, text = f"Lead {n}.", f"Sentence {n} of the text. " * 20
        more = f"<section>Extra section {n}.</section>" if n % 3 == 0 else ""
        return f"<body><div class=wrap><h1>Title {n}</h1><div class=lead>{lead}</div><div class=text><p>{text}</p></div>{more}</div><div class=low>Same</div></body>"

    df = spark.createDataFrame([(n, f"http://k.example/{n}", page(n)) for n in range(9)], "page_id long, url string, html string")
    for r in wrapper.extract(df).collect():
        n = r["page_id"]
        want = [f"Title {n}", f"Lead {n}.", (f"Sentence {n} of the text. " * 20).strip(), *([f"Extra section {n}."] if n % 3 == 0 else [])]
        assert r["text"].split("\n") == want


def test_every_kind_of_page_has_its_reference(spark):
    def page(n):
        text = "".join(f"<p>Own words {n} {k}.</p>" for k in range(3))
        low = "<div class=low>Same on all pages</div>"
        return f"<body><div class=one><h1>Title {n}</h1>{text}</div>{low}</body>" if n % 2 else f"<body><section class=two><h2>Title {n}</h2>{text}</section>{low}</body>"

    rows = [(n, "http://two.example/", page(n)) for n in range(20)] + [(100 + n, "http://two.example/", h) for n, h in enumerate([None, "", "<body></body>"] * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in wrapper.extract(df).filter("page_id < 100").collect():
        n = r["page_id"]
        assert r["wrapper"] == ('["body", "div.one"]' if n % 2 else '["body", "section.two"]')
        assert r["text"].split("\n") == [f"Title {n}", *(f"Own words {n} {k}." for k in range(3))]


def test_repeated_blocks_are_template(spark):
    def page(n, m, name="wrap"):
        text = "".join(f"<p>Own words {n} {k} that differ from page to page.</p>" for k in range(6))
        return f"<body><div class={name}><h1>Title {n}</h1>{text}<div class=box7>Word for word on every page.</div><div class=tail>End {n} {m}</div></div></body>"

    # Many copies of page 0 and near copies of page 50 on another host must keep what they share.
    rows = [(n, "http://t.example/", page(n, 0)) for n in [*range(8), *[0] * 20]] + [(50 + n, "http://c.example/", page(50, n, "content")) for n in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = wrapper.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        n = min(r["page_id"], 50)
        own = [f"Title {n}", *(f"Own words {n} {k} that differ from page to page." for k in range(6))]
        want = [*own, "Word for word on every page.", f"End 50 {r['page_id'] - 50}"] if n == 50 else [*own, f"End {n} 0"]
        assert r["text"].split("\n") == want


def test_tree_matching_keeps_order():
    a = wrapper.skeleton(parse("<body><div>1</div><section>2</section><div>3</div></body>"))
    b = wrapper.skeleton(parse("<body><section>2</section><div>3</div><p>4</p></body>"))
    pairs = wrapper.align(a, b)
    assert [(a[i][1], b[j][1]) for i, j in sorted(pairs)] == [("#root", "#root"), ("body", "body"), ("section", "section"), ("div", "div")]
    assert len(wrapper.skeleton(parse("<body>" + "<p>x</p>" * 5000 + "</body>"))) == 3


CALLS = [
    (1, 1, "a", "f", '{"y":"é","x":1, "b":{"z":1,"a":[2,1.50]}}', ["b"]),
    (1, 2, "b", "f", '{"x":"no"}', []),
    (1, 3, "c", "g", "{}", ["d"]),
    (1, 4, "d", "g", "{}", ["c"]),
    (1, 5, "e", "h", "{}", ["zz", "a"]),
    (2, 1, "a", "f", "[1]", []),
    (None, 1, "q", "f", None, []),
    (3, 1, "s", "f", '{"x":2}', []),
    (3, 1, "s", "f", '{"x":2}', []),
]
RESULTS = [(1, "a", 2, "r1"), (1, "a", 1, "r0"), (2, "b", 1, "x"), (3, "s", 2, None)]


def test_calls(spark):
    schemas = {"f": [("x", "integer", True), ("y", "string", False)], "g": []}
    calls = spark.createDataFrame(CALLS, "conv_id long, turn long, call_id string, name string, arguments string, refs array<string>")
    results = spark.createDataFrame(RESULTS, "conv_id long, call_id string, turn long, content string")
    got = toolcalls.link(calls, results, schemas).collect()
    by = {(r["conv_id"], r["call_id"]): r for r in got}
    assert len(got) == len(CALLS)
    assert {k: (r["level"], r["errors"]) for k, r in by.items()} == {
        (1, "a"): (1, "unknown:b"), (1, "b"): (0, "type:x"), (1, "c"): (None, "cycle"), (1, "d"): (None, "cycle"),
        (1, "e"): (2, "tool"), (2, "a"): (0, "json"), (None, "q"): (0, "json"), (3, "s"): (0, ""),
    }
    assert by[1, "a"]["record"] == '{"arguments":{"b":{"a":[2,1.5],"z":1},"x":1,"y":"é"},"id":"a","name":"f","result":"r0"}'
    assert by[1, "a"]["n_results"] == 2 and by[1, "e"]["dangling"] == 1 and not by[2, "a"]["linked"] and by[3, "s"]["linked"]
    assert toolcalls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_turns_with_nulls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a"), (None, 1, "user", "user"), (1, None, "user", "user"), (1, 1, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = toolcalls.link(*toolcalls.from_turns(turns), toolcalls.TOOLS).collect()
    assert len(got) == 4
    assert {(r["turn"], r["errors"], r["linked"]) for r in got if r["conv_id"] == 1} == {(1, "missing:prompt", True), (None, "missing:turn", False)}


def test_clashing_columns_and_chains(spark):
    n = 1000
    rows = [(1, n - k, f"c{k}", "f", '{"x":1}', [f"c{k - 1}"] if k else []) for k in range(n)]
    # A diamond with a long and a short side, a loop of three with a call behind it, and calls without turns.
    rows += [(2, None, c, "f", "{}", list(r)) for c, r in (("a", "bx"), ("b", "c"), ("c", "d"), ("d", ""), ("x", "d"), ("p", "q"), ("q", "r"), ("r", "p"), ("s", "p"))]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, refs array<string>")
    results = spark.createDataFrame([(1, "c0", 1, "r")], "conv_id long, call_id string, turn long, content string")
    extra = ("level", "n_results", "first", "dangling", "there", "ref", "times", "calls", "rest", "errors", "record")
    for c in extra:
        calls, results = calls.withColumn(c, F.lit(1)), results.withColumn(c, F.lit(2))
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link(calls, results, {"f": [("x", "integer", False)]}).collect()}
    assert len(got) == len(rows) and all(got[1, f"c{k}"]["level"] == k for k in range(n))
    assert {c: got[2, c]["level"] for c in "abcdxpqrs"} == dict(zip("abcdxpqrs", (3, 2, 1, 0, 1, None, None, None, None), strict=True))
    assert got[2, "s"]["errors"] == "cycle" and all(r["dangling"] == 0 for r in got.values())


def test_levels_of_any_references(spark):
    r = random.Random(9)
    rows, want = [], {}
    for conv in range(25):
        n = r.randint(1, 12)
        refs = {i: [r.randrange(n if conv % 3 == 0 else max(1, i)) for _ in range(r.choice((0, 1, 1, 2, 3)))] for i in range(n)}
        refs = {i: [x for x in v if conv % 3 == 0 or x < i] for i, v in refs.items()}

        def level(i, path, refs=refs):
            below = [None if x in path else level(x, path | {x}) for x in refs[i]]
            return None if None in below else 1 + max(below, default=-1)

        rows += [(conv, i, f"{i}", "f", "{}", [str(x) for x in v]) for i, v in refs.items()]
        want |= {(conv, str(i)): level(i, {i}) for i in refs}
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, refs array<string>")
    got = {(x["conv_id"], x["call_id"]): x["level"] for x in toolcalls.levels(calls).collect()}
    assert {k: got.get(k, 0) for k in want} == want and None in want.values()
