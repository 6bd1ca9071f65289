"""Operator 11: pages by their markup, trees of hosts against plain entropies, the query against the given articles."""

import html
import math
import random
import re
from collections import Counter

import pytest

from fieldloom.llm import queries, site_tree

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, text string, host string"


def text(markup):
    return site_tree.main_text(site_tree.Reader().read(markup))


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("", ""),
        ("no markup &amp; <b>bo</b>ld", "no markup & bold"),
        ("<title>T</title><body><article><h1> A  b\n</h1><p>One<p>Two<br>three&nbsp;x &#x41;&lt;b&gt;</article>", "A b One Two three x A<b>"),
        ("<nav>n</nav><header>h</header><main><p>x</p></main><footer>f</footer>", "x"),
        ("<article><header><h1>T</h1></header><p>x<script>var s='</p></article>'</script>y</p><aside>s</aside><footer>f</footer></article><p>after", "T xy"),
        ("<article><p>a</p><div class='ad-box'>buy<p>now</p></div><p>b</p><form><p>mail<input></p></form></article>", "a b"),
        ("<div id='wrap has-sidebar'><article><p>story of a day</p></article></div>", "story of a day"),
        ("<div class='has-sidebar no-ads'><article class='post with-comments hasMenu'><p>story</p></article></div>", "story"),
        ("<form id=f><div class=content><p>in a form</p></div></form>", "in a form"),
        ("<article><p>story</p></article><section class='comments'><article><p>a very long comment of a reader</p></article></section>", "story"),
        ("<article><p>story</p><div id=comments><div class=comment>c</div></div></article>", "story"),
        ("<div class=cookie-notice>ok?</div><div id=content><p>a</p><ul><li>b<li>c</ul></div><div class=sidebar><p>s</p></div>", "a b c"),
        ("<ul><li><a href=1>x</a><li><a href=2>y</a><li><a href=3>z</a></ul><p>no article here</p>", "no article here"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table>x<span class=advert>ad</span>y</article>", "1 2 3 x y"),
        ("<article><p>a<!-- b <p> --> c<!--unclosed", "a c"),
        ("<article><p title='a>b' class=\"x\">q</p> 1 < 2 <3 <a href=x>l</a><style>p{}</style><noscript>js</noscript><p hidden>h<p>i</article>", "q 1 < 2 <3 l i"),
        ("<p>" * 3 + "<div" * 2 + ">x</div></div></p></p>", "x"),
        ("<html><head><meta charset=x><title>t<body><p>x", ""),
        ("<head><title>t</title><p>x", "x"),
        ("<article><dl><dt>a<dd>b<dt>c</dl><h2>h</h3>i<pre> p \n q </pre></article>", "a b c h i p q"),
        ("<ARTICLE CLASS=Post><P>Up</P></ARTICLE><DIV ROLE=navigation>n</DIV>", "Up"),
        ("<article><svg><text>s</text></svg><button>b</button><select><option>o</select>t</article>", "t"),
    ],
)
def test_markup(markup, want):
    assert text(markup) == want


def test_long_and_hostile_pages():
    assert text("<article>" + "<p>word </p>" * 50_000 + "</article>") == " ".join(["word"] * 50_000)
    assert text("<div>" * 20_000 + "deep") == "deep"
    assert text("<" * 50_000) == "<" * 50_000
    assert text('<a b="' * 3_000) is not None
    assert text("<!--" * 50_000) == ""


def pages_of(seed=1, n=40):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    say = lambda k: " ".join(rnd.choices(words, k=k))
    rows, want = [], {}
    for i in range(n):
        story = [say(30) for _ in range(rnd.randint(3, 6))]
        share = f"<div class='x{i}9'>Tell your friends about us today</div>"
        letter = "<div class=zz><p>Our letter every week</p><p>Free of charge</p></div>"
        rows.append((i, "https://Many.example.com/a", f"<body><div class=q>Welcome to the site</div><article><h1>{say(4)}</h1><p>{'</p><p>'.join(story)}</p>{letter}{share}</article>"))
        want[i] = story
    return rows, want


@pytest.mark.parametrize("most", [site_tree.BROADCAST_PLACES, 0])
def test_tree_cuts_what_all_pages_repeat(spark, most):
    rows, want = pages_of()
    rows += [(1000 + i, "https://many.example.com/copy", rows[5][2]) for i in range(300)]  # copies count once
    rows += [(2000, "http://few.example.com/", rows[0][2]), (2001, None, rows[0][2]), (2002, "http://few.example.com/", None), (2003, "http://few.example.com/", ""), (None, "http://many.example.com", rows[1][2])]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(4)
    got = {(r.page_id, r.url): r for r in site_tree.extract(df, broadcast_places=most).collect()}
    assert len(got) == len(rows)
    for i, story in want.items():
        kept = got[i, "https://Many.example.com/a"]
        assert kept.text.split(" ", 4)[4] == " ".join(story) and kept.n_chars == len(kept.text)
    assert got[1000, "https://many.example.com/copy"].text == got[5, "https://Many.example.com/a"].text
    assert got[2000, "http://few.example.com/"].text.endswith("Our letter every week Free of charge Tell your friends about us today")
    assert got[2001, None].text == got[2000, "http://few.example.com/"].text
    assert got[2002, "http://few.example.com/"].text == got[2003, "http://few.example.com/"].text == ""


def test_pages_that_are_nearly_equal_keep_their_article(spark):
    rows = [(i, "http://same.example.com/", f"<article class=a><h1>T</h1><p class=x>the one story that all pages tell in full length</p><p class=x>number {i}</p></article>") for i in range(30)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], PAGES)
    assert {r.page_id: r.text for r in site_tree.extract(df).collect()} == {i: f"T the one story that all pages tell in full length number {i}" for i in range(30)}


def test_importance_equals_plain_entropies(spark):
    rows, _ = pages_of(2, 12)
    df = spark.createDataFrame([(*r, "", "h") for r in rows], PAGES)
    got = {r.place: r for r in site_tree.style_trees(df).collect()}
    reader, styles, texts = site_tree.Reader(), {}, {}
    for _, _, markup in rows:
        page = reader.read(markup)
        inside, gone = site_tree.article_of(page)
        for i, n in enumerate(page.nodes):
            if i and inside[i] and not gone[i]:
                styles.setdefault(n.place, {}).setdefault(markup, " ".join(n.signs))
        for i, block in page.blocks:
            if i and inside[i] and not gone[i]:
                texts.setdefault(page.nodes[i].place, {}).setdefault(block, Counter())[markup] += 1
    entropy = lambda counts, m: -sum(c / sum(counts) * math.log(c / sum(counts), m) for c in counts)
    for place, by_page in styles.items():
        m = len(by_page)
        if m < site_tree.LEAST_PAGES:
            assert place not in got
            continue
        assert got[place].pages == m and got[place].styles == len(set(by_page.values()))
        assert got[place].node == pytest.approx(entropy(Counter(by_page.values()).values(), m), abs=1e-9)
        features = texts.get(place, {})
        assert got[place].content == pytest.approx(1 - (sum(entropy(c.values(), m) for c in features.values()) / len(features) if features else 0), abs=1e-9)


def test_tree_holds_what_the_markup_takes_out_and_keeps_what_matters(spark):
    rnd = random.Random(3)
    say = lambda k: " ".join(f"w{rnd.randrange(900)}" for _ in range(k))
    rows, want = [], {}
    for i in range(12):
        story, own, deep = [say(40) for _ in range(4)], say(3), say(3)
        letter = "<div class=zz>Write to us every day<form><p>Your address</p></form></div>"  # only a form beside a text that all pages repeat
        mixed = f"<div class=yy>{own}{'<p>All pages say so</p><div>And so</div>' * 6}</div>"
        nested = f"<div class=n>{'<div>' * 14}{deep}{'</div>' * 14}</div>"
        rows.append((i, "http://whole.example.com/", f"<body><nav class=m><ul><li>Home</ul></nav><article><h1>{say(4)}</h1><p>{'</p><p>'.join(story)}</p>{letter}{mixed}{nested}</article>", "", ""))
        want[i] = [*story, own, deep]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i, parts in want.items():
        assert got[i].split(" ", 4)[4] == " ".join(parts)
    reader = site_tree.Reader()
    places = {r.place for r in site_tree.style_trees(spark.createDataFrame([(*r[:4], "h") for r in rows], PAGES)).collect()}
    assert {n.place for n in reader.read(rows[0][2]).nodes[1:]} == places


def test_empty_table(spark):
    assert site_tree.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_query(spark):
    got = {r.page_id: r for r in queries.QUERIES["op11_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split("</?(?:p|h1|br)>", article)]
        want = " ".join(" ".join(b.split()) for b in blocks if b.strip())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
