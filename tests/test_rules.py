"""Rule fixtures: expected values are derived by reading the rules."""

import pytest
from leadlake.functions import emails as E
from leadlake.functions import keys as K
from leadlake.functions import names as N
from leadlake.functions.dialect import DUCK, SPARK


def both(spark, expression, cols, rows):
    """The expression over the rows on Spark, after a check that DuckDB agrees."""
    import duckdb

    schema = ", ".join(f"{c} string" for c in cols)
    spark.createDataFrame(rows, schema).createOrReplaceTempView("fx")
    found = {tuple(r[: len(cols)]): r[len(cols)] for r in spark.sql(f"SELECT *, {expression(SPARK)} AS out FROM fx").collect()}
    values = ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    other = duckdb.sql(f"SELECT *, {expression(DUCK)} AS out FROM (VALUES {values}) fx({', '.join(cols)})").fetchall()
    assert found == {tuple(r[: len(cols)]): r[len(cols)] for r in other}
    return [found[tuple(r)] for r in rows]


NAMES = [
    ("Emma Jones", "valid:"), ("Dr Emma Jones", "valid:"), ("", "invalid:short"), (None, "invalid:short"), ("X", "invalid:short"), ("Jane Doe", "invalid:placeholder"), ("Emma", "invalid:one_word"),
    ("Emma Jones 2", "invalid:digit"), ("Dr BSc", "invalid:no_core"), ("Anna Beth Carol Diana Emma", "review:many_words"), ("Woking Clinic's", "invalid:business_word"), ("Woking Clinics.", "invalid:business_word"),
    ("Emma Director", "review:role_suffix"), ("Spire Harpenden", "invalid:brand_prefix"), ("Emma Brrt", "invalid:vowelless"), ("Emma Strngthsan", "review:few_vowels"), ("J O", "invalid:few_letters"), ("Ed Xu", "valid:"),
    ("Anna Achschmtt", "review:few_vowels"), ("Annabel Rschtkova", "review:consonant_run"), ("Emma Schlrose", "review:leading_consonants"), ("Emma Mcbride", "valid:"), ("Emma Hadkins", "review:odd_letters"), ("Emma Jooones", "review:triple_letter"),
]


def test_name_verdicts(spark):
    got = both(spark, lambda d: N.verdict(d, "n"), ["n"], [(n,) for n, _ in NAMES])
    assert list(zip((n for n, _ in NAMES), got)) == NAMES


CONTACTS = [("Emma Jones", True), ("Em", False), ("Owner", False), ("Front Desk", False), ("Emma", False), ("Emma Xq", False), ("Emma Owner", False), ("Sussex Jones", False), ("Emma Emma", False), ("Emma 2nd", False), ("Emma House", False), ("Anna Beth Carol Diana Emma", False), ("Emma Brrt", False), ("Anna Achschmtt", False), ("Dr. Jo Li", True)]


def test_contact_validity(spark):
    assert both(spark, lambda d: N.contact_valid(d, "n"), ["n"], [(n,) for n, _ in CONTACTS]) == [v for _, v in CONTACTS]


def test_suspicious_names(spark):
    rows = [("Emma Jones", False), ("", True), ("Emma Emma", True), ("Strngth Jones", True), ("Aaa Jones", True), ("Xqanu Jones", True)]
    assert both(spark, lambda d: N.suspicious(d, "n"), ["n"], [(n,) for n, _ in rows]) == [v for _, v in rows]


def test_vanity_and_domain_names(spark):
    rows = [("Acme Therapy", "Acme Therapy", True), ("Therapy Acme", "The Acme Therapy Ltd", True), ("Acme", "Acme Therapy", True), ("Emma Jones", "Acme Therapy", False), ("", "Acme", False), ("Ac", "Ace", False)]
    assert both(spark, lambda d: N.vanity(d, "n", "c"), ["n", "c"], [r[:2] for r in rows]) == [r[2] for r in rows]
    rows = [("Acme Therapy", "acmetherapy.co.uk", True), ("acme", "acme.com", True), ("Acme Therapy", "acme-therapy.com", True), (None, "acme.com", False)]
    assert both(spark, lambda d: N.domain_name(d, "n", "s"), ["n", "s"], [r[:2] for r in rows]) == [r[2] for r in rows]


def test_titles_and_registry_names(spark):
    rows = [("Dr Emma Jones Director", "Emma Jones"), ("Emma Jones - Physio", "Emma Jones"), ("Emma Jones (BSc)", "Emma Jones"), ("Dr Emma", "Dr Emma"), ("Emma Jones | Clinic", "Emma Jones")]
    assert both(spark, lambda d: N.without_titles(d, "n"), ["n"], [r[:1] for r in rows]) == [r[1] for r in rows]
    rows = [("O'BRIEN-SMITH, Anna Maria", "Anna Maria O'Brien-Smith"), ("anna smith", "Anna Smith")]
    assert both(spark, lambda d: N.person_format(d, "n"), ["n"], [r[:1] for r in rows]) == [r[1] for r in rows]


def test_suspects(spark):
    rows = [
        ("Book Now", "x", "", None, "ui_artifact"), ("High Street", "x", "", None, "address_fragment"), ("Nurse", "x", "", None, "role_only_name"), ("Acme", "Acme Ltd", "", None, "company_name_echo"),
        ("emmaJones Therapist At", "x", "", None, "concatenated_text"), ("Emma Jones", "x", "vanity_name_match", None, "flagged_in_notes"), ("Emma Jones", "x", "", "2", "low_confidence"), ("Dr Jones", "x", "", None, "title_only"),
        ("Emma Brrt", "x", "", None, "failed_validation"), ("Emma Jones", "x", "", "4", None), (None, "x", "", None, None),
        # a valid name that begins with a known first name is a person's, whatever street words it holds
        ("Emma Park", "x", "", None, None), ("Grace Hill", "x", "", None, None), ("David Green", "x", "", None, None), ("Sarah Lane", "x", "", None, None), ("Zelda Lane", "x", "", None, "address_fragment"), ("Emma GU7", "x", "", None, "address_fragment"),
    ]
    call = lambda d: N.suspect(d, "n", "c", d.split("t", ";"), "CAST(f AS DOUBLE)")
    assert both(spark, call, ["n", "c", "t", "f"], [r[:4] for r in rows]) == [r[4] for r in rows]


def test_found_emails(spark):
    rows = [("write to a.b@site.co.uk, or c@d.org", "a.b@site.co.uk;c@d.org"), ("x@y.zz now", "x@y.zz"), ("x@y.com and x@y.zz", "x@y.com"), ("none", ""), ("a@b.png", ""), ("a@wixpress.com b@c.com", "b@c.com")]
    assert both(spark, lambda d: d.join(E.found(d, "t"), ";"), ["t"], [r[:1] for r in rows]) == [r[1] for r in rows]


def test_cleaned_emails(spark):
    rows = [("<b>Info@Site.co.uk</b>", "info@site.co.uk"), ("1x@y.com", "x@y.com"), ("nothing", None), ("a@sentry.io", None), ("[a@b.org]", "a@b.org")]
    assert both(spark, lambda d: E.cleaned(d, "e"), ["e"], [r[:1] for r in rows]) == [r[1] for r in rows]


def test_cleaned_as_published(spark):
    rows = [("x@a.org.uk", "x@a.org"), ("x@mail.medical.com", "x@mail.me"), ("x@b.comcall", "x@b.com"), ("x@b.zz", "x@b.zz")]
    assert both(spark, lambda d: E.cleaned(d, "e", compat=True), ["e"], [r[:1] for r in rows]) == [r[1] for r in rows]
    assert both(spark, lambda d: E.cleaned(d, "e"), ["e"], [("x@a.org.uk",), ("x@mail.medical.com",)]) == ["x@a.org.uk", "x@mail.medical.com"]


def test_strictly_cleaned_emails(spark):
    rows = [
        (" Emma@Site.co.uk ", "emma@site.co.uk"), ("noreply@a.com", None), ("emma@sentry.io", None), ("who.we@a.com", None), ("logo@a.svg", None), ("a" * 65 + "@b.com", None), ("a@" + "b" * 250 + ".com", None), ("sentry.fan@a.com", "sentry.fan@a.com"), (None, None),
    ]
    assert both(spark, lambda d: E.cleaned_strictly(d, "e"), ["e"], [r[:1] for r in rows]) == [r[1] for r in rows]


def test_email_kinds(spark):
    rows = [("info@a.com", True, True), ("salesman@a.com", False, True), ("emma@a.com", False, False), (None, False, False)]
    assert both(spark, lambda d: E.generic(d, "e"), ["e"], [r[:1] for r in rows]) == [r[1] for r in rows]
    assert both(spark, lambda d: E.generic_prefix(d, "e"), ["e"], [r[:1] for r in rows]) == [r[2] for r in rows]


def test_gibberish_and_mismatch(spark):
    rows = [("xkcd@a.com", True), ("info@a.com", False), ("emma.jones@a.com", False), ("emma.wltn@a.com", True)]
    assert both(spark, lambda d: E.gibberish(d, "e"), ["e"], [r[:1] for r in rows]) == [r[1] for r in rows]
    rows = [("emma.jones@a.com", "Emma Jones", True), ("peter.smith@a.com", "Emma Jones", False), ("e.jones@a.com", "Emma Jones", True), ("peter.smith@gmail.com", "Emma Jones", True), ("info@a.com", "Emma Jones", True), (None, "Emma", True), ("peter.smith@a.com", None, True)]
    assert both(spark, lambda d: E.matches_contact(d, "e", "n"), ["e", "n"], [r[:2] for r in rows]) == [r[2] for r in rows]


def test_guesses(spark):
    rows = [("Emma O'Brien", "a.com", "emma.obrien@a.com;e.obrien@a.com;emma@a.com;obrien@a.com;emma_obrien@a.com;emmaobrien@a.com;emmao@a.com;eo@a.com"), ("Emma", "a.com", ""), ("Emma Jones", "local", "")]
    assert both(spark, lambda d: d.join(E.guesses(d, "n", "s"), ";"), ["n", "s"], [r[:2] for r in rows]) == [r[2] for r in rows]


def test_domain_match(spark):
    rows = [("a@x.co.uk", "https://www.x.co.uk/p", "exact"), ("a@m.x.com", "http://x.com", "registrable"), ("a@y.co.uk", "http://x.co.uk", None), ("a@gmail.com", "http://x.com", "free_mail"), ("a@acmehome.com", "http://acme.org", "core"), ("a@jonesdental.com", "http://thejonesclinic.org", "brand"), ("a", "http://x.com", None), ("a@x.com", None, None)]
    assert both(spark, lambda d: E.domain_match(d, "e", "u"), ["e", "u"], [r[:2] for r in rows]) == [r[2] for r in rows]


def test_domain_match_by_two_labels(spark):
    assert both(spark, lambda d: E.domain_match(d, "e", "u", compat=True), ["e", "u"], [("a@y.co.uk", "http://x.co.uk")]) == ["registrable"]


def test_likeness_of_names(spark):
    from leadlake.operators.texts import like_name

    rows = [
        ("Emma Jones", True), ("Dr. Emma Jones BSc", True), ("Emma", False), ("Dr Emma", False), ("emma Jones", False), ("Emma Clinic", False), ("Zorg Brrt", False), ("Emma Brrt", True), ("EMMA JONES", True), ("ZORA JONES", False), ("Zora Jones", True),
        ("Zora O'Brien-Hall", True), ("Zora J Jones", True), ("Emma Jones2", False), ("Emma Jones and Sons of Woking", False), ("E J", False), (None, False),
    ]
    assert both(spark, lambda d: like_name(d, "n"), ["n"], [r[:1] for r in rows]) == [r[1] for r in rows]


def test_place_locations(spark):
    from leadlake.operators.texts import place_location

    rows = [("1 High St, Godalming , GU7 1AA, UK", "1 High St, Godalming, GU7 1AA"), ("Woking", "Woking"), ("Woking, UK, x", "Woking, UK"), ("a, b, c, d", "b, c, d"), ("a, b", "a, b"), ("lone", "lone"), ("", "T"), (None, "T")]
    assert both(spark, lambda d: place_location(d, "a", "'T'"), ["a"], [r[:1] for r in rows]) == [r[1] for r in rows]


def test_descriptions_and_headings(spark):
    from leadlake.operators.texts import meta, sector_text

    rows = [("<meta name=\"description\" content=\"It's yoga\">", "It's yoga"), ("<meta content='yoga' name='description'>", "yoga"), ("<meta property=\"og:description\" content=\"x\">", ""), ("", "")]
    assert both(spark, lambda d: meta(d, "description"), ["html"], [r[:1] for r in rows]) == [r[1] for r in rows]
    pages = [(1, "", "yoga studio"), (2, "<meta property='og:description' content='yoga studio'>", ""), (3, "<h1>a</h1><h1><b>Yoga</b> studio</h1>", ""), (4, "<h1>a</h1><h1>b</h1><h1>yoga studio</h1>", "")]
    got = {r.page_id: r.sector for r in sector_text(page_text=spark.createDataFrame(pages, "page_id long, html string, text string")).collect()}
    assert got[1] == got[2] == got[3] != got[4] == "General Wellness"


@pytest.mark.parametrize(("url", "key", "host"), [("https://www.A.com/", "a.com", "a.com"), ("http://x.org:80/p?q", "x.org:80/p?q", "x.org"), ("www.b.com#t", "b.com#t", "b.com"), ("", None, "")])
def test_keys(spark, url, key, host):
    assert both(spark, lambda d: K.website_key(d, "u"), ["u"], [(url,)]) == [key]
    assert both(spark, lambda d: K.host(d, "u"), ["u"], [(url,)]) == [host]


def test_protected_addresses(spark):
    from leadlake.operators.texts import decoded

    rows = [("427b7a", "98"), ("11707f7051777e7e3f72", "ana@foo.c")]
    assert both(spark, lambda d: decoded(d, "c"), ["c"], [r[:1] for r in rows]) == [r[1] for r in rows]
