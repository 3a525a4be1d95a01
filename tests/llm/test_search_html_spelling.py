"""Spelling variants, main text of pages and ranked search against plain versions."""

import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from wattloom.llm import html_text, reverse_search, spelling
from wattloom.llm import queries as Q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def plain_variants(counts):
    holes = defaultdict(set)  # near words share a word with one code point less, or are one
    for w in counts:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 10 * n:
            form[w] = best
    out = {}
    for w, n in counts.items():
        end = w
        while end in form:
            end = form[end]
        out[w] = (n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, end)
    return out


def as_dict(rows):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_spelling(spark, size):
    sf = f"/root/testdata/sf{size}"
    got = Q.QUERIES["op11_spelling_variants"](spark, sf).collect()
    want = plain_variants(plain_words(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False)))
    assert any(v[1] > 1 for v in want.values())
    assert len(got) == len(want) and as_dict(got) == want


def test_spelling_of_few_letters(spark):
    """Words over three letters have equal grams at many places; forms in chains, ties."""
    rng = random.Random(5)
    base = ["".join(rng.choices("abé", k=rng.randint(7, 9))) for _ in range(60)]
    texts = [w for i, w in enumerate(base) for _ in range(2 + 11 * (i % 3) ** 3)]
    texts += ["aaaaaaa"] * 4 + ["aaaaaac"] * 60 + ["aaaaacc"] * 900 + ["caaaacc"] * 900
    rows = list(enumerate(texts))
    got = spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = plain_variants(plain_words(rows))
    assert any(v[4] not in (w, v[2]) for w, v in want.items())
    assert as_dict(got) == want and len(got) == len(want)


def test_spelling_of_odd_tables(spark, odd, none_left):
    rows = odd.select("doc_id", "text").collect()
    assert as_dict(spelling.variants(odd).collect()) == plain_variants(plain_words(rows))
    assert spelling.variants(none_left).collect() == []


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(3)
    for _ in range(200):
        places = sorted(rng.sample(range(12), 5))
        weights = [rng.randint(1, 9) for _ in places]
        chosen = spelling.chosen_pivots(places, weights)
        pairs = [(a + b, x, y) for x, a in zip(places, weights) for y, b in zip(places, weights) if y - x >= 2]
        assert chosen[1] - chosen[0] >= 2
        assert sum(weights[places.index(p)] for p in chosen) == min(pairs)[0]


def plain_ranking(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    counts = [(d, Counter(w.translate(LOWER) for w in word.findall(t or ""))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = Counter(w.translate(LOWER) for w in word.findall(text or ""))
        scored = []
        for doc, c in counts:
            m = 25 + (75 * c.total() * n_docs) // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, times in asked.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:10])]
    return sorted(out, key=str)


def listed(rows):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


def test_ranked_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    assert listed(Q.QUERIES["op13_ranked_search"](spark, sf).collect()) == plain_ranking(docs, items)


def test_ranked_search_in_blocks_and_odd_tables(spark, odd, none_left):
    asked = [("x", "The same text, the SAME words"), ("x", "long words password"), (None, "text 日本語"), ("e", ""), ("n", None), ("?", "unheardof")]
    items = spark.createDataFrame([(*r, 1) for r in asked], "item_id string, text string, doc_id int")
    want = plain_ranking(odd.select("doc_id", "text").collect(), asked)
    assert len(want) > 10
    for postings in (3, 10_000):
        assert listed(reverse_search.ranked(odd, items, postings=postings).collect()) == want
    assert reverse_search.ranked(none_left, items).collect() == []
    assert reverse_search.ranked(odd, items.where("1 = 0")).collect() == []


def test_heaps_of_many_equal_scores(spark):
    rows = [(i, "equal words here") for i in range(500, 0, -1)] + [(1, "equal words here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7).union(spark.createDataFrame([(9, "other text")], "doc_id bigint, text string"))
    items = spark.createDataFrame([("i", "other equal")], "item_id string, text string")
    got = [(r.doc_id, r["rank"]) for r in reverse_search.ranked(docs, items).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(9, 1), (1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 7), (6, 8), (7, 9), (8, 10)]


def normal(text):
    return [" ".join(line.split()) for line in text.split("\n") if line.split()]


def test_pages_hold_documents(spark):
    """Every page's text is its heading and then, line by line, one of the documents."""
    sf = "/root/testdata/sf0.1"
    texts = {"\n".join(normal(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()}
    got = Q.QUERIES["op12_main_text"](spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        heading = re.search("<h1>(.*?)</h1>", pages[r.page_id], re.DOTALL)[1]
        first, _, rest = r.text.partition("\n")
        assert [first] == normal(html.unescape(heading))
        assert rest in texts and r.n_chars == len(r.text)


JUNK = [
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us, and more</a></li></ul></nav>",
    "<div class='menu'><a href=x>One</a> <a href=y>Two</a> <a href=z>Three, four</a></div>",
    "<div class='ad-slot'>Buy now, cheap, today, only here, before it is too late!</div>",
    "<aside><p>More stories, from elsewhere, that are long enough to score, are here, and there.</p></aside>",
    "<div id='sidebar'><p>Weather, sports, news, and a long sentence about nothing at all, really.</p></div>",
    "<form action='/s'><p>Your mail, please</p><input name=q><button>Send</button></form>",
    "<div class='cookie-notice'>We use cookies, as all do, to improve what you see, and more.</div>",
    "<script>if (a < b) { document.write('<p>no, no, no</p>'); }</script><style>p > a { color: red }</style>",
    "<!-- a comment, <p>with a paragraph, of its own</p> -->",
    "<section id='comments'><h2>3 comments</h2><article class='comment'><p>First, I think, that this, is wrong, all of it, and long too.</p></article></section>",
    "<ul class='related-posts'><li><a href=1>Other</a></li></ul><noscript>Enable scripts</noscript><template><p>x</p></template>",
    "<p hidden>Unseen text, of a paragraph</p>",
]
BLOCKS = [
    ("<h2>A <em>heading</em></h2>", ["A heading"]),
    ("<p>Some text, with <a href='/x'>a link</a>, commas, and\n   white \t space&nbsp;&amp; signs &lt;b&gt;.", ["Some text, with a link, commas, and white space & signs <b>."]),
    ("<p>Short.</p>", ["Short."]),
    ("<ul><li>First point<li>Second point</ul>", ["First point", "Second point"]),
    ("<blockquote><p>Quoted words, said once.</p></blockquote>", ["Quoted words, said once."]),
    ("<table><tr><td>a<td>b</table>", ["a", "b"]),
    ("<p>Line one<br>goes on<br/><br>Next paragraph</p>", ["Line one goes on", "Next paragraph"]),
    ("<div>Loose text, <b>partly <i>nested</b> wrongly</i></div>", ["Loose text, partly nested wrongly"]),
    ("<pre>code  here\n  and there</pre>", ["code here and there"]),
]
FRAMES = [
    "<body>{0}<header><h1>Site name</h1></header><article>{1}</article>{2}<footer>Terms, imprint</footer></body>",
    "<body class='has-sidebar'>{0}<main><article class='post comments-open'><header><h1>Title</h1></header>{1}</article></main>{2}",
    "<div id=page><div class='site-header'>Logo</div>{0}<div class='content'>{1}</div>{2}<div id='footer'>End, of, it</div></div>",
    "<body>{0}<div id='main'><div class='entry'>{1}</div></div>{2}</body>",
]


@pytest.mark.parametrize("seed", range(60))
def test_planted_articles(seed):
    """Articles of known blocks in pages with all kinds of junk around and between them."""
    rng = random.Random(seed)
    chosen = [BLOCKS[1], *rng.choices(BLOCKS, k=rng.randint(2, 8))]
    frame = FRAMES[seed % len(FRAMES)]
    inner = "".join(part + (rng.choice(JUNK) if rng.random() < 0.3 else "") for part, _ in chosen)
    page = "<!DOCTYPE html><html><head><title>Title, of the page</title></head>" + frame.format("".join(rng.sample(JUNK, 4)), inner, "".join(rng.sample(JUNK, 4)))
    want = (["Title"] if "Title</h1></header>{" in frame else []) + [line for _, lines in chosen for line in lines]
    assert html_text.main_text(page) == "\n".join(want)


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep text, with commas, inside</p>"
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "no markup &amp here", 3), (4, "u", "<p", 4), (4, "u", "<p", 4), (5, "u", deep, 5),
            (6, "u", "<script>never closed <p>x</p>", 6), (7, "u", "<p>a</p><!-- never closed <p>b</p>", 7), (8, "u", "</p></div>1 < 2 <3>", 8),
            (9, "u", "<p>" + "long, " * 300_000, 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extracted(pages).collect()]
    texts = ["", "", "no markup & here", "", "", "deep text, with commas, inside", "", "a", "1 < 2 <3>", ("long, " * 300_000).strip()]
    assert sorted(got, key=str) == sorted([(r[0], r[1], t, len(t)) for r, t in zip(rows, texts, strict=True)], key=str)
    assert html_text.extracted(pages.where("1 = 0")).collect() == []
