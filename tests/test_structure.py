"""Structure of pages: the scan against a plain tree, people and addresses by source, listings of three kinds."""

import json
import random

from leadlake.sources import structure
from leadlake.sources.markup import Zone, elements, scanned
from pyspark.sql import functions as F


def table(spark, *pages):
    return spark.createDataFrame([(i, h, "x", 1) for i, h in enumerate(pages)], "page_id long, html string, text string, pos int")


def tree(rng, depth=0):
    """A random tree and its markup: (tag, class, children or text)."""
    if depth > 4 or rng.random() < 0.3:
        return f"t{rng.randrange(99)}"
    return (rng.choice(["div", "span", "b", "em", "section"]), rng.choice(["", "team", "foot", "card x"]), [tree(rng, depth + 1) for _ in range(rng.randint(0, 4))])


def markup(t):
    return t + " " if isinstance(t, str) else f'<{t[0]} class="{t[1]}">' + "".join(map(markup, t[2])) + f"</{t[0]}>"


def walked(t, rows, parent=-1, depth=0, near=None):
    pos = len(rows)
    if isinstance(t, str):
        rows.append([pos, "#text", parent, pos, depth, t, near])
        return [t]
    near = pos if "team" in t[1] else near
    rows.append([pos, t[0], parent, pos, depth, None, near])
    words = []
    texts = []
    for c in t[2]:  # neighbouring texts are one
        if isinstance(c, str) and texts and isinstance(texts[-1], str):
            texts[-1] += " " + c
        else:
            texts.append(c)
    for c in texts:
        words += walked(c, rows, pos, depth + 1, near)
    rows[pos][3], rows[pos][5] = len(rows) - 1, " ".join(words)
    return words


def test_scan_equals_a_plain_tree():
    rng = random.Random(1)
    for _ in range(200):
        t = ("div", "", [tree(rng) for _ in range(5)])
        want = []
        walked(t, want)
        got = [[r[0], r[1], r[2], r[3], r[4], r[6], r[8].get("team")] for r in scanned(markup(t), {"team": Zone("team")}, 10**6)]
        assert got == want


def test_scan_of_broken_markup():
    tags = lambda h: [(r[1], r[2]) for r in scanned(h, {})]
    assert tags("<ul><li>a<li>b</ul></div>c") == [("ul", -1), ("li", 0), ("#text", 1), ("li", 0), ("#text", 3), ("#text", -1)]
    assert tags("<p>a<div>b<br>c") == [("p", -1), ("#text", 0), ("div", -1), ("#text", 2), ("br", 2), ("#text", 2)]
    assert tags("<b><i>x</b>y") == [("b", -1), ("i", 0), ("#text", 1), ("#text", -1)]
    assert tags("") == tags("<!-- <p>x</p> -->") == []
    assert [r[6] for r in scanned("<script>if (a < b) { '<p>' }</script><p>x &amp; y", {})] == ["if (a < b) { '<p>' }", "x & y", "x & y"]
    deep = scanned("<div>" * 20_000 + "x", {})
    assert len(deep) == 20_001 and deep[0][6] == "x"


def test_elements_of_empty_and_null_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a"), (3, "<p>a")], "page_id long, html string")
    assert sorted((r.page_id, r.tag) for r in elements(df, {}).collect()) == [(3, "#text"), (3, "#text"), (3, "p"), (3, "p")]
    assert elements(df.limit(0), {}).count() == 0


def test_people_by_every_source(spark):
    person = {"@graph": [{"employee": [{"name": "Ruth Taylor", "jobTitle": "Osteopath"}]}], "founder": "Ann Taylor"}
    pages = [
        '<meta name="Author" content="Emma Jones">',
        f'<script type="application/ld+json">{json.dumps(person)}</script>',
        "<p>Our director: Laura Evans, here</p>",
        "<p>The Director</p><h3>Helen Taylor</h3>",
        '<div class="our-team"><h3>Emma Jones</h3></div>',
        "<h4>Emma Taylor</h4><p>lead therapist</p>",
        "<h1>Emma Evans</h1><h2>The Clinic</h2>",
        "<i>for Laura Taylor only</i>",
        "<title>Helen Jones | Home</title>",
        "<h2>Emma Jones</h2><p>Osteopath</p><h2>Laura Evans</h2><h2>Helen Taylor</h2><em>Owner</em>",
        '<img alt="Emma Jones"><p>run by Laura Evans since May</p><div class="person"><b>Helen Taylor</b><b>Ruth Taylor</b></div>',
        '<script type="application/ld+json">{"founder": {"name": "Emma Jones"}</script>',
        None,
        "<h2>Book Now</h2><p>Director</p>",
    ]
    out = structure.people_by_structure(person_pages=table(spark, *pages)).collect()
    got = {}
    for r in out:
        got.setdefault(r.page_id, set()).add((r.source, r.name))
    has = lambda i, *s: set(s) <= got.get(i, set())
    assert got[0] == {("author", "Emma Jones")}
    assert got[1] == {("linked_name", "Ruth Taylor"), ("linked_name", "Ann Taylor"), ("linked_person", "Ruth Taylor")}
    assert has(2, ("role_text", "Laura Evans")) and has(3, ("role_text", "Helen Taylor")) and has(4, ("about_section", "Emma Jones"), ("team_section", "Emma Jones"))
    assert has(5, ("heading_role", "Emma Taylor")) and has(6, ("heading_first_name", "Emma Evans")) and has(7, ("text_pair", "Laura Taylor")) and has(8, ("title", "Helen Jones"))
    assert {(r.name, r.title) for r in out if r.page_id == 9 and r.source == "heading_team"} == {("Emma Jones", "Osteopath"), ("Laura Evans", "Owner"), ("Helen Taylor", "Owner")}
    assert has(10, ("image", "Emma Jones"), ("sentence", "Laura Evans"), ("card", "Helen Taylor")) and not has(10, ("card", "Ruth Taylor"))
    assert 11 not in got and 12 not in got
    assert not any(name == "Book Now" for found in got.values() for _, name in found)
    main = {r.page_id: (r.source, r.name) for r in out if r.main_contact}
    assert main[0] == ("author", "Emma Jones") and main[4] == ("about_section", "Emma Jones") and main[8] == ("text_pair", "Helen Jones")
    assert all(r.title == "Osteopath" for r in out if r.source == "linked_person")


def nested(rng, depth=0):
    """A random value and the addresses that count in it."""
    kind = rng.choice(["text", "number", "list", "object", "object"]) if depth < 5 else "text"
    if kind == "text":
        return rng.choice(["x", "some@where.org"])
    if kind == "number":
        return rng.randrange(5)
    if kind == "list":
        return [nested(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["email", "contactPoint", "a", "@graph"]): nested(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def mails(v, key=None, inside=False):
    """Texts with an address whose own key, or whose list's, is email or contactPoint."""
    if isinstance(v, dict):
        return {m for k, x in v.items() for m in mails(x, k)}
    if isinstance(v, list):
        return {m for x in v for m in mails(x, key)}
    return {v} if isinstance(v, str) and "@" in v and key in ("email", "contactPoint") else set()


def test_linked_addresses_at_any_depth(spark):
    rng = random.Random(3)
    values = []
    for i in range(120):
        values.append(json.loads(json.dumps(nested(rng)).replace("some@", f"p{i}@")))
    bodies = [json.dumps(v) for v in values] + ['{"email":"a@b.org"', ""]
    pages = [f'<p>x</p><script type="application/ld+json">{b}</script>' for b in bodies]
    got = {}
    for r in structure.linked_emails(linked_pages=table(spark, *pages)).collect():
        got.setdefault(r.page_id, set()).add(r.email)
    assert got == {i: mails(v) for i, v in enumerate(values) if mails(v)}


def test_addresses_by_where_they_stand(spark):
    pages = [
        'a@x.org <a href="mailto:b@x.org?subject=1">b</a><footer>c@x.org<a href="MAILTO:d@x.org">d</a></footer><img alt="mail e@x.org">',
        '<div id="my-contact"><p>f@x.org</p></div><p>f@x.org</p><div data-m="g@x.org">noreply@x.org</div>',
        "<p>none</p>",
        None,
    ]
    got = {(r.page_id, r.email): r.source_rank for r in structure.block_emails(linked_pages=table(spark, *pages)).collect()}
    want = {(0, "a@x.org"): 4, (0, "b@x.org"): 1, (0, "c@x.org"): 2, (0, "d@x.org"): 2, (0, "e@x.org"): 3, (1, "f@x.org"): 2, (1, "g@x.org"): 3}
    assert {k: v for k, v in got.items() if not k[1].startswith("noreply")} == want


def test_listings_of_three_kinds(spark):
    pages = [
        ("registry", '<ul><li class="type-company"><a href="/1"> Acme  Ltd</a><p>1 High St</p><span class="meta">Active</span></li><li class="type-company"><a href="/2">Dead Ltd</a><span class="meta">Dissolved 2020</span></li><li class="type-company"><a href="/3">Bare Ltd</a></li></ul>'),
        ("directory", '<div class="businessCapsule"><h2>Zed</h2><a href="https://zed.org">x</a><address>2 Low Rd</address></div><div class="businessCapsule"><a class="businessCapsule--name">Yan</a><span class="address">3 Mid Rd</span><p class="businessCapsule--description">about</p></div><div class="businessCapsule">none</div>'),
        ("search", '<div class="g"><a href="https://acme.org"><h3>Acme - Home</h3></a><div class="VwiC3b">text</div></div><div class="g"><a href="https://www.youtube.com/x"><h3>Video</h3></a></div><div class="g"><a href="/x"><h3>Own</h3></a></div>'),
        ("search", "<p>nothing</p>"),
        ("registry", "".join(f'<li class="type-company"><a href="/{i}">C{i}</a></li>' for i in range(9))),
    ]
    df = spark.createDataFrame([(i, k, h) for i, (k, h) in enumerate(pages)], "page_id long, kind string, html string")
    got = sorted(tuple(r) for r in structure.listing_layouts(listing_pages=df).select("page_id", "place", "name", "link", "address", "description").collect())
    assert [g for g in got if g[0] != 4] == [
        (0, 1, "Acme Ltd", "/1", "1 High St", None), (0, 2, "Bare Ltd", "/3", None, None),
        (1, 1, "Zed", "https://zed.org", "2 Low Rd", None), (1, 2, "Yan", None, "3 Mid Rd", "about"),
        (2, 1, "Acme", "https://acme.org", None, "text"),
    ]
    assert [g[2] for g in got if g[0] == 4] == [f"C{i}" for i in range(5)]
    assert structure.listing_layouts({"most": 7}, listing_pages=df.where(F.col("page_id") == 4)).count() == 7
