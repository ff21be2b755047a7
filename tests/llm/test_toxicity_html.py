"""Toxicity on held-out rows, and page extraction."""

import math
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import html, toxicity


def toxic_corpus(n=900):
    draw = random.Random(11)
    plain = [f"word{draw.choice('abcdefgh')}{k}" for k in range(150)]
    bad = ["grumble", "snark", "vexwort"]
    disguise = [lambda w: w, str.upper, lambda w: w.replace("e", "3"), lambda w: w.replace("a", "а"), lambda w: w + "###"]
    rows, labels = [], []
    for k in range(n):
        words = [draw.choice(plain) for _ in range(draw.choice([8, 40, 300]))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words[draw.randrange(len(words))] = draw.choice(disguise)(draw.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, documents):
    rows, labels = toxic_corpus()
    truth = dict(labels)
    out = toxicity.score(documents([*rows, (5000, None), (5001, "")]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5)
    test = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) >= 0.97 * len(test)


def brute_lexicon(rows):
    """Weights of entries from (text, toxic) rows, word by word."""
    n = [sum(1 for _, x in rows if x == k) for k in (0, 1)]
    found = [{}, {}]
    for t, x in rows:
        for w in set(toxicity.folded(t).split()):
            for e in [f" {w} ", *(f" {w[:k]}" for k in range(4, min(8, len(w)) + 1))]:
                found[x][e] = found[x].get(e, 0) + 1
    least = max(toxicity.MIN_DOCS, math.ceil(toxicity.MIN_SHARE * n[1]))
    out = {e: math.log((c + 0.5) / (n[1] + 1)) - math.log((found[0].get(e, 0) + 0.5) / (n[0] + 1)) for e, c in found[1].items() if c >= least}
    return {e: w for e, w in out.items() if w >= toxicity.MIN_WEIGHT}


def brute_weigh(text, weights):
    """Words, hits and weight of a text, each entry and each phrase sought by itself."""
    text = toxicity.folded(text)
    n = len(text.split())
    best = {}
    for e, w in weights.items():
        at = text.find(e)
        while at >= 0:
            best[at] = max(best.get(at, 0.0), w)
            at = text.find(e, at + 1)
    for phrase in map(toxicity.folded, toxicity.EXCEPTIONS):
        at = text.find(phrase)
        while at >= 0:
            best = {k: w for k, w in best.items() if not at <= k < at + len(phrase) - 1}
            at = text.find(phrase, at + 1)
    return n, len(best), sum(best.values())


def test_toxicity_against_brute_force(spark, documents):
    rows, labels = toxic_corpus(400)
    rows = [(i, t + (" the trash can and a class clown" if i % 3 else " trash")) for i, t in rows]
    truth = dict(labels)
    train = [(t, truth[i]) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    weights = brute_lexicon(train)
    got = toxicity.learn(spark.createDataFrame(train, "text string, toxic int"))
    assert got == pytest.approx(weights) and len(weights) > 5
    weights |= {" trash ": 2.0, " clown": 1.5, " trash": 1.7}
    out = {r["doc_id"]: r for r in toxicity.weigh(documents(rows), weights).collect()}
    for i, t in rows:
        n, hits, weight = brute_weigh(t, weights)
        assert (out[i]["n_words"], out[i]["n_matched"]) == (n, hits) and out[i]["weight"] == pytest.approx(weight)


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    rows, labels = toxic_corpus(300)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = frame.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score(documents(rows), x).collect()} for x in (frame, flipped)]
    assert scores[0] == scores[1]


def test_folding_and_exceptions():
    assert toxicity.folded("ІD10T, Ｔrаsh!") == " idiot trash "
    lexicon = toxicity.Lexicon({" trash": 2.0, " tra": 1.0, " clown ": 3.0}, toxicity.EXCEPTIONS)
    assert lexicon.weigh("Trash trashy tram, clown clowns") == (5, 4, 8.0)
    assert lexicon.weigh("the trash can and a class clown") == (7, 0, 0.0)
    assert lexicon.weigh("") == (0, 0, 0.0)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (2, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, labels).count() == odd.count()
    assert {r["score"] for r in toxicity.score(odd, labels.where("false")).collect()} == {0.0}
    assert toxicity.score(odd.where("false"), labels).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad banner">Buy</div><article class='main "x'><h1>Head &amp; more</h1>
<p><b>Bold text<br>and&nbsp;&lt;more&gt;   here<p>Second {k}.<aside>side</aside></p><form><p>Form</p></form><ul><li>one<li>two</ul>
<section id="comments"><p>Reader says</p></section></article><footer>&copy; foot</footer></body></html>"""
WANT = "Head & more\nBold text and <more> here\nSecond {k}.\none\ntwo"


def test_extraction(spark):
    pages = [(k, f"http://h{k % 3}.org/{k}", PAGE.replace("{k}", str(k))) for k in range(20)]
    pages += [(50, None, None), (51, "http://h0.org/", ""), (52, "x", "plain text"), (53, "http://one.org/", "<body><div><p>A</p><div class=menu>m</div>B"), (54, "http://h1.org/z", "<article>cut of"), (0, "http://h0.org/0", PAGE)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("slot", F.lit("clash")).withColumn("text", F.lit("old"))
    out = html.extract(frame).collect()
    got = {(r["page_id"], r["url"]): r["text"] for r in out}
    assert len(out) == len(pages)
    for k in range(1, 20):
        assert got[k, f"http://h{k % 3}.org/{k}"] == WANT.replace("{k}", str(k))
    assert got[50, None] == "" and got[51, "http://h0.org/"] == "" and got[52, "x"] == "plain text"
    assert got[53, "http://one.org/"] == "A\nB" and got[54, "http://h1.org/z"] == "cut of"
    assert html.extract(frame.where("false")).count() == 0


def test_wrapper_without_article_element(spark):
    page = "<body><div><div>Site name</div><div>Menu of the site</div></div><div><div><p>Story {k} goes on and on, number {k}.</p><p>More of {k}</p></div></div><div>All rights reserved</div></body>"
    pages = [(k, f"http://plain.org/{k}", page.replace("{k}", str(k * 7))) for k in range(8)]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {k: f"Story {k * 7} goes on and on, number {k * 7}.\nMore of {k * 7}" for k in range(8)}


def test_nested_containers_are_kept_whole(spark):
    lead = "<body><div>Menu</div><article><h1>Title {k}</h1><p>Lead {k}</p><div class='entry-content'><p>{long}</p></div></article></body>"
    split = "<body><div>Menu</div><div><section><p>{long}</p></section><section><p>Second part {k}</p></section></div></body>"
    two = "<body><div>Menu</div><article><p>{long}</p></article><article><p>Other {k}</p></article></body>"
    long = lambda k: f"Story {k} goes on. " * 9 + "End"
    fill = lambda page, k: page.replace("{k}", str(k)).replace("{long}", long(k))
    pages = [(k, f"http://{h}.org/{k}", fill(page, k)) for h, page in (("lead", lead), ("split", split)) for k in range(6)]
    pages += [(0, "http://alone.org/", fill(two, 0))]
    got = {(r["url"]): r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[f"http://lead.org/{k}"] == f"Title {k}\nLead {k}\n{long(k)}"
        assert got[f"http://split.org/{k}"] == f"{long(k)}\nSecond part {k}"
    assert got["http://alone.org/"] == f"{long(0)}\nOther 0"


def brute_match(a, b):
    if a.tag != b.tag or a.furniture != b.furniture:
        return 0
    if a.furniture:
        return 1
    x, y = a.nodes(), b.nodes()
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_match(x[i - 1], y[j - 1]))
    return 1 + m[-1][-1]


def test_simple_tree_matching():
    draw = random.Random(12)

    def tree(depth):
        node = html.Node(draw.choice("abc"), draw.random() < 0.05)
        node.parts = [tree(depth - 1) for _ in range(draw.randint(0, 3))] if depth else []
        return node

    forms = html.Forms()
    for _ in range(200):
        a, b = tree(3), tree(3)
        forms.number(a), forms.number(b)
        assert forms.match(a.form, b.form) == brute_match(a, b)
        if a.tag == b.tag and a.furniture == b.furniture:
            pairs = html.pairing(a, b, forms)
            assert len(pairs) == brute_match(a, b) and len(set(pairs.values())) == len(pairs)
        assert html.skeleton(html.from_skeleton(html.skeleton(a))) == html.skeleton(a)


@pytest.mark.parametrize("size", [2000])
def test_large_page(size):
    page = html.parse("<article>" + "<p>x<div>y</div>" * size + "</article>")
    other = html.parse("<article>" + "<p>x<div>y</div>" * (size - 7) + "</article>")
    assert len(html.pairing(page, other, html.Forms())) > size


def in_time(spark, pages, seconds=60, **options):
    began = time.time()
    frame = spark.createDataFrame([(k, "http://big.org/", t) for k, t in enumerate(pages)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.extract(frame, **options).collect()}
    assert time.time() - began < seconds
    return [out[k] for k in range(len(pages))]


def test_deep_pages(spark):
    deep = [f"<body><article><p>{k} a {'<b>' * 100_000}x</p><div>{'<i>' * 5000}y{k}</article>" for k in range(3)]
    lists = "<ul>" + "<b>" * 20_000 + "<li>z</li>" * 20_000
    got = in_time(spark, [*deep, "<div>" * 5000 + "last", lists])
    assert got == [*[f"{k} a x\ny{k}" for k in range(3)], "last", "\n".join(["z"] * 20_000)]


def test_long_mixed_lists(spark):
    draw = random.Random(13)
    few = [f"<body><main>{''.join(draw.choice(['<p>{}</p>', '<div>{}</div>', '<h2>{}</h2>', '<ul><li>{}</ul>']).format(f'{k}.{j}') for j in range(5000))}</main>" for k in range(3)]
    many = [f"<body><main>{''.join('<div>' + '<i></i>' * draw.randrange(50) + f'{k}.{j}' + '<p></p>' * draw.randrange(50) + '</div>' for j in range(1500))}</main>" for k in range(2)]
    got = in_time(spark, few + many)
    assert got == ["\n".join(f"{k}.{j}" for j in range(n)) for n, m in ((5000, 3), (1500, 2)) for k in range(m)]


def test_anchored_children_pair_in_order():
    draw, forms = random.Random(14), html.Forms()
    for _ in range(100):
        make = lambda: html.parse("".join("<div>" + "<i></i>" * draw.randrange(9) + "</div>" if draw.random() < 0.8 else "<p></p>" for _ in range(draw.randrange(12))))
        a, b = make(), make()
        forms.number(a), forms.number(b)
        x, y = forms.kids[a.form], forms.kids[b.form]
        pairs = forms.anchored(x, y, range(len(x)), range(len(y)))
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:])) and all(forms.tags[x[i]] == forms.tags[y[j]] for i, j in pairs)


def mixed(draw, n, tags=("i", "p")):
    """A list of ``n`` children, most of a form of their own."""
    return html.parse("<main>" + "".join("<div>" + "".join(f"<{t}></{t}>" * draw.randrange(12) for t in tags) + "</div>" for _ in range(n)) + "</main>")


def test_matching_is_the_best_on_lists_of_any_size():
    draw, forms = random.Random(16), html.Forms()
    for _ in range(3):
        a, b = mixed(draw, 75), mixed(draw, 70)
        forms.number(a), forms.number(b)
        x, y = (forms.kids[n.nodes()[0].form] for n in (a, b))
        assert len(set(x)) * len(set(y)) > html.MOST_KINDS
        assert forms.match(a.form, b.form) == brute_match(a, b) == len(html.pairing(a, b, forms))
    # Few kinds of children and over MOST_CELLS places.
    a, b = html.parse("<main><p></p>" + "<i></i>" * 2100 + "<u></u></main>"), html.parse("<main><u></u>" + "<i></i>" * 2000 + "<p></p></main>")
    assert len(html.pairing(a, b, html.Forms())) == 2 + 2000


def test_bounds_of_the_matching_change_no_result(monkeypatch):
    draw = random.Random(17)

    def tree(depth):
        node = html.Node(draw.choice("abc") if depth < 3 else "a", depth < 3 and draw.random() < 0.05)
        node.parts = [tree(depth - 1) for _ in range(draw.choice([0, 1, 2, 3, 9]))] if depth else []
        return node

    made = [(tree(3), tree(3)) for _ in range(60)] + [(mixed(draw, 9), mixed(draw, 8)) for _ in range(20)]
    for _, b in made[-20:]:
        b.nodes()[0].parts += [tree(4) for _ in range(4)]
    want = [html.pairing(a, b, html.Forms()) for a, b in made]
    for kinds, cells in ((0, 4_000_000), (2_500, 1), (0, 1), (3, 40)):
        monkeypatch.setattr(html, "MOST_KINDS", kinds)
        monkeypatch.setattr(html, "MOST_CELLS", cells)
        forms = html.Forms()
        for (a, b), pairs in zip(made, want):
            assert html.pairing(a, b, forms) == pairs
            assert forms.match(a.form, b.form) == brute_match(a, b) == len(pairs)


def test_the_article_is_found_among_many_kinds_of_nodes(spark):
    draw = random.Random(18)
    side = lambda n: "".join("<div>" + "<i></i>" * draw.randrange(12) + "<b></b>" * draw.randrange(12) + "<p>Same</p></div>" for _ in range(n))
    text = "<div><ul>" + "<li>a" * 30 + "</ul><p>Story {k} goes on</p><h2>More</h2><p>and on {k}</p></div>"
    pages = ["<body>" + side(45 + 3 * k) + text.replace("{k}", str(k)) + side(60 - 4 * k) + "</body>" for k in range(6)]
    assert in_time(spark, pages) == ["a\n" * 30 + f"Story {k} goes on\nMore\nand on {k}" for k in range(6)]


def test_wrappers_joined_or_broadcast_give_the_same(spark, monkeypatch):
    draw = random.Random(19)
    frame = spark.createDataFrame([(k, f"http://h{k % 4}.org/{k}", made_page(draw, k)[0]) for k in range(40)], "page_id long, url string, html string")
    want = sorted(map(tuple, html.extract(frame).collect()))
    monkeypatch.setattr("quarry.llm.common.small", lambda df, rows: False)
    assert sorted(map(tuple, html.extract(frame).collect())) == want


def test_pages_without_nodes_are_no_seed(spark):
    page = "<body><div><div>Site name</div><div>Menu of the site</div></div><div><div><p>Story {k} goes on and on, number {k}.</p><p>More of {k}</p></div></div><div>All rights reserved</div></body>"
    pages = [None, "", "no tags", *(page.replace("{k}", str(k * 7)) for k in range(3, 9))]
    assert in_time(spark, pages) == ["", "", "no tags", *(f"Story {k * 7} goes on and on, number {k * 7}.\nMore of {k * 7}" for k in range(3, 9))]


def test_furniture_by_whole_names(spark):
    kept = "<div class='share-class-analysis'><p>a {k}</p></div><ul class='related-work'><li>b</ul><section id='comment-on-law'><p>c {k}</p></section><div class='post-header'><p>d {k}</p></div>"
    gone = "<div class='x ad-box'>1</div><ul class='related-posts'><li>2</ul><section id='comments'><p>3</section><div class='cookieNotice'>4</div><p class=newsletter>5</p><div role=navigation>6</div>"
    page = "<body><header><p>Page</p></header><article><header><h1>Title {k}</h1></header>" + kept + gone + "<footer>7</footer></article>"
    want = "Title {k}\na {k}\nb\nc {k}\nd {k}"
    assert in_time(spark, [page.replace("{k}", str(k)) for k in range(2)]) == [want.replace("{k}", str(k)) for k in range(2)]


def test_template_inside_the_article(spark):
    page = "<body><article><h1>T{k}</h1><p>Read all we have</p><p>Text {k}</p>{more}<div>Sign up now</div></article></body>"
    pages = [page.replace("{k}", str(k)).replace("{more}", "<p>Long tail</p>" * (k < 2)) for k in range(10)] + [page.replace("{k}", "0").replace("{more}", "<p>Long tail</p>")] * 5
    # The paragraph that few pages have is no template, however alike; copies of a page count as one page.
    tail = lambda k: "\nLong tail" * (k < 2)
    assert in_time(spark, pages, cut_template=True) == [f"T{k}\nText {k}{tail(k)}" for k in [*range(10), 0, 0, 0, 0, 0]]
    assert in_time(spark, pages) == [f"T{k}\nRead all we have\nText {k}{tail(k)}\nSign up now" for k in [*range(10), 0, 0, 0, 0, 0]]


def brute_text(page, shape):
    """What a page of ``made_page`` holds, from its own parts."""
    return "\n".join(t for kind, t in shape if kind == "text")


def made_page(draw, k):
    """A page of random parts with the text that is to come out."""
    word = lambda: draw.choice(["alpha", "be &amp; ta", "gam<b>ma</b>", "d&eacute;lta", "&#8364;5", "x &lt; y", "<a href='/q'>link</a>", "<i>it<span>al</span>ics</i>"])
    plain = {"be &amp; ta": "be & ta", "gam<b>ma</b>": "gamma", "d&eacute;lta": "délta", "&#8364;5": "€5", "x &lt; y": "x < y", "<a href='/q'>link</a>": "link", "<i>it<span>al</span>ics</i>": "italics"}
    shape, out = [], []
    for _ in range(draw.randint(2, 9)):
        words = [word() for _ in range(draw.randint(1, 12))] + [f"n{draw.randrange(10**6)}"]
        said = " ".join(plain.get(w, w) for w in words)
        kind = draw.randrange(8)
        if kind < 4:
            tag = draw.choice(["p", "h2", "blockquote", "pre", "div"])
            out.append(f"<{tag}>" + draw.choice([" ", "\n\t "]).join(words) + f"</{tag}>")
            shape.append(("text", said))
        elif kind == 4:
            out.append("<ul>" + "".join(f"<li>{w}" for w in words) + "</ul>")
            shape += [("text", plain.get(w, w)) for w in words]
        elif kind == 5:
            out.append("<table><tr>" + "".join(f"<td>{w}" for w in words) + "</table>")
            shape += [("text", plain.get(w, w)) for w in words]
        else:
            out.append(draw.choice(["<aside>{}</aside>", "<div class='ad'>{}</div>", "<form>{}</form>", "<script>{}</script>", "<!-- {} -->", "<nav><p>{}</nav>", "<section class='comments'><p>{}</section>"]).format(" ".join(words)))
    return f"<html><head><title>t{k}</title></head><body><nav>menu {k}</nav><div><div class='wrap'>" + "".join(out) + f"</div></div><footer>foot {k}</footer></body></html>", shape


def test_extraction_against_brute_force(spark):
    draw = random.Random(15)
    made = [made_page(draw, k) for k in range(120)]
    pages = [(k, f"http://h{k % 4}.org/{k}", t) for k, (t, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k, (t, shape) in enumerate(made):
        assert got[k] == brute_text(t, shape), t
