import pytest
from helpers import bag

from basewell.llm import html


def text(page):
    found = html.lines(page)
    kinds = {k & 3 for _, k in found}
    only = 1 if 1 in kinds else 2 if 2 in kinds else 0
    return "\n".join(t for t, k in found if k & 3 >= (only > 0) and (only != 1 or k & 3 == 1))


CASES = [
    (None, ""),
    ("", ""),
    ("plain text", "plain text"),
    ("<p>a &amp; b&nbsp;c &#233;&#x41; &unknown; 1 &lt; 2<p>second", "a & b c éA &unknown; 1 < 2\nsecond"),
    ("<article><h1>T</h1><p><b>one<br><p>two\n  three</p></article><footer>f</footer>", "T\none\ntwo three"),
    ('<nav><a>m</a></nav><div class="ad">x</div><main><p>y</p><aside>z</aside></main>', "y"),
    ('<script>var a="</p><p>no";</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->', "yes"),
    ("<p>kept<!-- never closed <p>no", "kept"),
    ("<p>kept<script>never closed <p>no", "kept"),
    ('<div class="cookie-notice">c</div><div id="siteHeader">h</div><div role="banner">b</div><div hidden>d</div><form><p>f</p></form><p>t</p>', "t"),
    ('<article><header><h1>Title</h1></header><p>body</p><div class="user-comments"><article><p>reader</p></article></div><div class="share">s</div></article>', "Title\nbody"),
    ("<ul><li>a<li>b <i>c</i></ul><table><tr><td>d<td>e</table>", "a\nb c\nd\ne"),
    ("<p title='a>b'>x</p><P CLASS=AD>ad</P><img alt='n'/>y", "x\ny"),
    ("a < b and <3 <p>", "a < b and <3"),
    ("<article><p>cut off", "cut off"),
    ("<p>one</p><p data-x=it's>two</p><p>three</p><p>don't stop</p><p>five</p>", "one\ntwo\nthree\ndon't stop\nfive"),
    ('<p title="abc>hello</p>', "hello"),
    ("<p>&am<b>p;</b> x &amp;amp;</p>", "&amp; x &amp;"),
    ('<p a = "x>y" b= \'>\' c==">z</p><p / id=q>r</p><a href=/x/>s</a>', "z\nr\ns"),
    ("<p>1 </ p>2</>3<?x y>4<!doctype html>5<!-->6<!--->7", "1 234567"),
    ('<article><p>t</p><div class="related-work"><p>work</p></div><div class="ad">x</div></article>', "t\nwork"),
    ("<p>end <b", "end"),
    ("<div class='layout with-sidebar'><article><p>text</p></article><div class='sidebar'>s</div></div>", "text"),
    ("<div class='page nav-open'><main><p>text</p></main></div>", "text"),
    ("<div id='content' class='has-header'><article><p>text</p></article></div>", "text"),
    ("<article class='no-comments'><p>text</p></article>", "text"),
    ("<article class='post ad-free'><p>text</p></article>", "text"),
    ("<div id='comments-in-law'><p>main text</p></div>", "main text"),
    ("<article><p>t</p><div class='share-price'>up</div><div class='social-history'>old</div><p class='newsletter-study'>read</p></article>", "t\nup\nold\nread"),
    ("<div class='post-header'><h1>Title</h1></div><p>text</p>", "Title\ntext"),
    ("<form id='aspnetForm'><input><nav>menu</nav><article><p>the article's text</p><form><p>Your name</p></form></article><select><option>o</select></form>", "the article's text"),
    ("<form><nav>menu</nav><p>a page in a form</p></form><footer>f</footer>", "a page in a form"),
    ("<div class='sidebar'><main><p>text</p></main></div><p>out</p>", "text"),
    ("<main><div class='widget-box'><p>the whole text of it</p></div><p>end</p></main>", "the whole text of it\nend"),
    ("<div class='menu'><article><p>the long text</p></article></div><p>out</p>", "the long text"),
    ("<article>short</article><div id='comments'><article>a reader's long comment</article></div><div class='comment-list'>more of that</div>", "short"),
    ("<div class='ad-300x250'>an advert</div><p>t</p><div class='cookieConsent'>accept all of them</div>", "t"),
    ("<div>" * 300 + "<nav>menu</nav><div class='ad'>advert</div><article><p>text</p></article>", "text"),
    ("<b>" * 5000 + "<nav>menu</nav>" + "</b>" * 5000 + "<p>text", "text"),
    (("<p title='" + "a>b" * 9000 + "'>x</p>") * 9, "\n".join("x" * 9)),
    ("<script>if(a<b)x='</script><p>it's text</p>", "it's text"),
]


@pytest.mark.parametrize(("page", "expected"), CASES)
def test_lines(page, expected):
    assert text(page) == expected


def test_shared():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = html.shared(a, b)
        assert len(found) == table[-1][-1] and found == sorted(found)
        at = 0
        for i in found:
            at = b.index(a[i], at) + 1


def test_hostile_pages():
    """Broken pages of 1 MB, and long alignments, take time in proportion to their size."""
    import time

    n = 1 << 20
    for piece in ("<a ", '<a b="', "<a b='>", "<b>", "<p>", "</i>", "<b><p>", "<!--", "<!-- -->", "<p a=\"'\" b='\"'", "&amp;", "< ", "<div class='x y'>", "<li>x", "</p", "<a b=' \" >", "<a b='>'", "<a b='>\"", '<a b=">" c', "<li><dt></dt><div><b>", "<div class='sidebar'>", "<p a='" + ">" * 600 + "'>"):
        began = time.time()
        html.lines(piece * (n // len(piece)))
        assert time.time() - began < 12, piece  # about a second on a machine of its own
    for page in ("<li><dt><div>" + "<b>" * (n // 8) + "<dt></dt>" * (n // 16), "<a b='>'" * (n // 16) + "d" * (n // 2), "<div class='sidebar'>" * (n // 40) + "<main>" * (n // 8)):
        began = time.time()
        html.lines(page)
        assert time.time() - began < 12, page[:40]
    for a, b in (([7] * 4000, [7] * 3000), (list(range(6000)), list(range(6000))[::-1]), ([i % 5 for i in range(20_000)], [i % 7 for i in range(20_000)])):
        began = time.time()
        html.shared(a, b)
        assert time.time() - began < 12


def test_shared_halves(monkeypatch):
    """Tables that are halved give subsequences of the same length."""
    import random

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 60))] for _ in range(2))
        whole = html.shared(a, b)
        monkeypatch.setattr(html, "_DIRECT", 40)
        assert len(html.shared(a, b)) == len(whole)
        monkeypatch.undo()


def plain(rows):
    """The query, page by page: every page looks at its host's other texts."""
    import re

    parsed = [(i, u, html.lines(h)) for i, u, h in rows]
    host = lambda u: (m[1] if (m := re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", (u or "").lower())) else "")
    path = lambda u: (m[1] if (m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", u or "")) else "")
    alike = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    groups = {}  # (host, lines) -> least url
    for _, u, found in parsed:
        key = host(u), tuple(t for t, _ in found)
        groups[key] = min((x for x in (groups.get(key), u) if x is not None), default=None)
    out = []
    for i, u, found in parsed:
        own = [t for t, _ in found]
        here = path(groups[host(u), tuple(own)])
        others = [(path(v), list(ls)) for (h, ls), v in groups.items() if h == host(u) and list(ls) != own]
        before, after = sorted(x for x in others if x[0] < here)[::-1], sorted(x for x in others if x[0] > here)
        near = lambda side: alike(side[0][0], here) if side else -1
        first, back = (before, after) if near(before) >= near(after) else (after, before)
        site = set()
        if first:
            same = html.shared(own, first[0][1])
            if len(same) <= 0.9 * max(len(own), len(first[0][1])):
                site = set(same)
            elif second := (back[:1] or first[1:2]):
                site = set(same) & set(html.shared(own, second[0][1]))
            elif len(same) < len(own):
                site = set(same)
        size = [sum(len(t) for j, (t, k) in enumerate(found) if k & 3 == x and j not in site) for x in range(3)]
        kinds = {k & 3 for _, k in found}
        held = {1} if 1 in kinds and size[1] >= size[0] + size[2] else {1, 2} if 2 in kinds and size[1] + size[2] >= size[0] else set()
        kept = [t for j, (t, k) in enumerate(found) if ((k & 3 in held and not (k & 4 and j in site)) if held else j not in site)]
        out.append((i, "\n".join(kept)))
    return sorted(out, key=repr)


def test_extract_is_the_plain_query(spark):
    import random

    rng = random.Random(12)
    box = lambda x: rng.choice([f"<p>{x}</p>", f"<div class='related-box'><p>{x}</p></div>", f"<div>{x}</div>"])
    rows = []
    for i in range(150):
        body = "".join(box(f"line {rng.randint(0, 400)}" if rng.random() < 0.6 else f"site {rng.randint(0, 3)}") for _ in range(rng.randint(1, 14)))
        shape = rng.choice(["{}", "{}", "<article>{}</article><p>site 1</p>", "<main>{}</main><p>site 2</p>", "<main><article>site 3</article>{}</main>"])
        rows.append((i, f"http://h{rng.randint(0, 5)}.example/{rng.choice('abc')}/{i:03}", "<p>Menu</p>" + shape.format(body) + "<p>All rights reserved</p>"))
    rows += [(200 + i, f"{rows[i][1]}?copy", rows[i][2]) for i in range(0, 60, 7)] + [(300, None, None), (301, None, "<p>x</p>"), (302, "odd", "<p>y</p>")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    assert bag(found, "page_id", "text") == plain(rows)
    assert found.filter("n_deleted > 0").count() > 75


def test_extract(spark):
    soup = lambda n, own: f"<div>Site name</div><div>Menu of this site</div><p>Story {n}</p><p>{own}</p><div>About us, all rights reserved</div>"
    rows = [(i, f"http://h.example/{'ab'[i % 2]}/{i}?q={i}", soup(i, f"Only here {i * 37}"), "x") for i in range(12)]
    rows += [(20, "https://one.example/x", "<div>alone</div>", "x"), (21, None, None, "x"), (22, "::odd", "<p>odd</p>", "x"), (23, "http://h.example/a/2", rows[2][2], "x"), (2, rows[2][1], rows[2][2], "x")]
    rows += [(30, "http://k.example/p/1", "<article><p>shared</p><p>mine</p></article><p>out</p>", "x"), (31, "http://k.example/p/2", "<article><p>shared</p><p>other</p></article><p>out</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(3)
    found = html.extract(pages)
    assert found.count() == len(rows)
    got = {r["page_id"]: r for r in found.collect()}
    for i in [*range(12)]:
        if i != 2:
            assert got[i]["text"] == f"Story {i}\nOnly here {i * 37}" and got[i]["n_deleted"] == 3
    assert got[20]["text"] == "alone" and got[21]["text"] == "" and got[22]["text"] == "odd"
    assert got[30]["text"] == "shared\nmine" and got[31]["text"] == "shared\nother" and got[30]["n_shared"] == 2
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.extract(pages.filter("false")).count() == 0
    assert bag(html.extract(pages.repartition(5)), "page_id", "text") == bag(found, "page_id", "text")


def test_pairs_are_nearest(spark):
    urls = [f"http://h.example/{a}/{b}" for a in ("x", "y", "zz") for b in (1, 12, 123, 5, 55)] + ["http://g.example/x/1"]
    table = spark.createDataFrame(list(enumerate(urls)), "key long, url string")
    paired = {r["key"]: r["other"] for r in html.pairs(table).collect()}
    assert len(urls) - 1 not in paired and len(paired) == len(urls) - 1
    prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for k, o in paired.items():
        assert prefix(urls[k], urls[o]) == max(prefix(urls[k], urls[j]) for j in range(len(urls) - 1) if j != k)


def test_copies_and_mostly_shared_pages(spark):
    site = "<div>Site name</div><div>Menu of this site</div>"
    page = lambda own: f"{site}<p>{own}</p><p>more of {own}</p><p>end of {own}</p>"
    rows = [(i, f"http://h.example/n/{i}", page(f"story {i}")) for i in range(6)]
    # copies under other queries, schemes and paths, more than any neighbour reaches
    rows += [(10 + i, f"http{'s' * (i % 2)}://h.example/n/2?from={i}", rows[2][2]) for i in range(5)] + [(20, "http://h.example/n/2b", rows[2][2])]
    many = [f"<p>line {j}</p>" for j in range(19)]
    rows += [(30 + i, f"http://m.example/{i}", "".join([*many[:9], f"<p>own {i}</p>", *many[9:]])) for i in range(5)]
    rows += [(40 + i, f"http://two.example/{i}", "".join([*many, f"<p>own {i}</p>"])) for i in range(2)]
    # a near copy (one line in 22 differs) isn't taken for the site's text
    body = "".join(f"<p>passage {j}</p>" for j in range(19))
    rows += [(50, "http://c.example/a", page("first")), (51, "http://c.example/b", f"{site}{body}<p>read at noon</p>"), (52, "http://c.example/b2", f"{site}{body}<p>read at night</p>"), (53, "http://c.example/c", page("last"))]
    rows += [(60, "http://e.example/b", f"{site}{body}<p>read at noon</p>"), (61, "http://e.example/b2", f"{site}{body}<p>read at night</p>"), (62, "http://e.example/c", page("last"))]
    for parts in (1, 6):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
        story = lambda own: f"{own}\nmore of {own}\nend of {own}"
        assert len(got) == len(rows)
        assert all(got[i] == story(f"story {i}") for i in range(6))
        assert all(got[i] == got[2] for i in (10, 11, 12, 13, 14, 20))
        assert all(got[30 + i] == f"own {i}" for i in range(5)) and all(got[40 + i] == f"own {i}" for i in range(2))
        passages = "\n".join(f"passage {j}" for j in range(19))
        assert [got[i] for i in (51, 52)] == [got[i] for i in (60, 61)] == [f"{passages}\nread at noon", f"{passages}\nread at night"]


def test_second_neighbours(spark):
    urls = [f"http://h.example/{i:03}" for i in range(40)] + ["http://g.example/1", "http://g.example/2", "http://f.example/1"]
    near = {r["key"]: (r["other"], r["second"]) for r in html.pairs(spark.createDataFrame(list(enumerate(urls)), "key long, url string")).collect()}
    assert near[40] == (41, None) and near[41] == (40, None) and 42 not in near and len(near) == 42
    assert near[0] == (1, 2) and near[39] == (38, 37) and all(set(near[i]) == {i - 1, i + 1} for i in range(1, 39))


def test_teasers_are_not_the_text(spark):
    def page(n, tag):
        text = "".join(f"<p>Paragraph {j} of the long story number {n * 37}</p>" for j in range(6))
        return f"<div>Site name</div><{tag}>{text}</{tag}><article class='card'>Seen everywhere</article><article class='card'>Teaser {n}</article><div>All rights reserved</div>"

    rows = [(i, f"http://{tag}.example/{i}", page(i, tag)) for tag, ids in (("div", range(4)), ("main", range(4, 8))) for i in ids]
    rows += [(9, "http://alone.example/", "<div>Menu</div><article><p>Its own text</p></article>")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        story = "\n".join(f"Paragraph {j} of the long story number {i * 37}" for j in range(6))
        assert got[i]["text"] == (f"{story}\nTeaser {i}" if i < 4 else f"{story}\nSeen everywhere\nTeaser {i}")
    assert got[0]["n_shared"] == 3 == got[0]["n_deleted"] and got[9]["text"] == "Its own text"
