"""Operators on small tables; expected values are derived by reading the rules."""

import random

from pyspark.sql import functions as F

from leadlake.functions.rules import PARKED
from leadlake.operators import filters, joins, merges, reports, sets, texts, windows

LEAD = "lead_id string, ingest_seq long, company_name string, website string, contact_name string, contact_names array<string>, email string, location string, contact_verified boolean, contact_source string, company_status string, refinement_notes array<string>, confidence_score double, personal_email_guesses array<string>"


def leads(spark, *rows):
    base = dict(company_name="Acme Therapy", website="https://acme.org", contact_name=None, contact_names=[], email=None, location=None, contact_verified=None, contact_source=None, company_status="active", refinement_notes=[], confidence_score=None, personal_email_guesses=[])
    full = [{"lead_id": str(i), "ingest_seq": i, **base, **r} for i, r in enumerate(rows)]
    names = [f.split()[0] for f in LEAD.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], LEAD)


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in sorted(df.collect(), key=lambda r: int(r.lead_id))]


def test_doubtful_names_are_resolved(spark):
    rows = [
        dict(contact_name="Emma"),  # one word: doubtful, not fake
        dict(contact_name="Emma Jones"),
        dict(contact_name="Book Now"),
        dict(contact_name="Book Now", contact_source="companies_house"),
        dict(contact_name="Book Now", contact_names=["Xy", "Acme Therapy", "Helen Brown", "Dr Ruth Evans"]),
        dict(contact_name="Emma Jones", confidence_score=1.0),
        dict(contact_name="High Street", contact_names=["Helen Brown"]),
        dict(),
    ]
    got = column(windows.resolve_contact(leads=leads(spark, *rows)), "action", "contact_name")
    assert got == [("kept_no_replacement", "Emma"), ("kept", "Emma Jones"), ("cleared", None), ("kept_verified", "Book Now"), ("replaced", "Dr Ruth Evans"), ("kept_no_replacement", "Emma Jones"), ("replaced", "Helen Brown"), ("kept", None)]


def test_found_contacts_are_accepted_or_not(spark):
    rows = [
        dict(contact_name="Book Now"),
        dict(contact_name="Emma Jones"),
        dict(contact_name="Emma", refinement_notes=["single_name_only"]),
        dict(contact_name="Emma Jones", website="https://emmajones.co.uk"),
        dict(contact_name="Emma Jones", company_name="Emma Jones Ltd", contact_names=["Emma Jones", "Helen Evans"]),
        dict(contact_name="Emma Jones", company_name="Emma Jones Ltd"),
        dict(contact_name="Xqanu Jones", contact_names=["Xqanu Jones", "Helen Evans"]),
        dict(contact_name="Xqanu Jones", contact_names=["Xqanu Jones"]),
        dict(contact_name="Xqanu Jones", email="a@b.org"),
        dict(),
    ]
    got = column(merges.accept_contact(leads=leads(spark, *rows)), "outcome", "contact", "verified", "guessed_email")
    assert got == [
        ("rejected_garbage", None, False, None), ("accepted", "Emma Jones", True, "emma.jones@acme.org"), ("accepted", "Emma", False, None), ("rejected_domain", None, False, None),
        ("vanity_replaced", "Helen Evans", True, "helen.evans@acme.org"), ("left", None, False, None), ("suspicious_replaced", "Helen Evans", True, "helen.evans@acme.org"),
        ("flagged", "Xqanu Jones", True, "xqanu.jones@acme.org"), ("accepted", "Xqanu Jones", True, None), ("none", None, False, None),
    ]


def test_contacts_are_promoted(spark):
    rows = [
        dict(contact_name="Dr Emma Jones Director"),
        dict(contact_name="Woking Clinic", contact_names=["Clinic Room", "Dr Helen Brown - Physio"]),
        dict(contact_name="Woking Clinic", company_name="Becky Brown Counselling"),
        dict(contact_name="Woking Clinic"),
        dict(),
    ]
    got = column(windows.promote_contact(leads=leads(spark, *rows)), "contact_name", "contact_from", "name_review_needed")
    assert got == [("Emma Jones", "own", False), ("Helen Brown", "other", False), ("Becky Brown", "company", False), ("Woking Clinic", "own", True), (None, "own", False)]


def test_garbage_reasons(spark):
    rows = [("Dylan House Evans", None), ("Yvonne House", "name_plus_garbage"), ("Zelda House", "garbage_word"), (None, "empty"), ("nan", "empty"), ("Book Emma", "verb_prefix"), ("Emma Jones", None)]
    got = {r.reason: r.n for r in texts.garbage_names(leads=leads(spark, *(dict(contact_name=n) for n, _ in rows))).collect()}
    want = {}
    for _, r in rows:
        want[r or "ok"] = want.get(r or "ok", 0) + 1
    assert got == want


def test_site_addresses(spark):
    site = "https://www.acme.co.uk"
    mails = ["zoe@gmail.com", "ann@mail.acme.co.uk", "emma@acme.co.uk", "bea@acme.co.uk", "info@gmail.com", "hello@acme.co.uk", "x@other.org"]
    df = spark.createDataFrame([("1", site, m) for m in mails] + [("2", site, "zoe@gmail.com"), ("2", site, "ann@mail.acme.co.uk"), ("3", site, "x@other.org"), ("4", None, "a@b.org")], "lead_id string, website string, email string")
    got = {(r.lead_id, r.kind): r.email for r in windows.choose_site_email(site_emails=df).collect()}
    assert got == {("1", "personal"): "bea@acme.co.uk", ("1", "generic"): "hello@acme.co.uk", ("2", "personal"): "ann@mail.acme.co.uk"}


def test_principals_by_preference(spark):
    day = "2020-01-0"
    officers = spark.createDataFrame([("0", 1, "A", "secretary", day + "9", None), ("0", 2, "B", "director", day + "1", None), ("0", 3, "C", "director", day + "2", None), ("0", 4, "D", "director", day + "3", day + "4"), ("1", 5, "E", "secretary", day + "1", None), ("2", 6, "F", "secretary", day + "1", None), ("3", 7, "G", "director", day + "1", day + "2")], "company_number string, pos long, name string, role string, appointed_on string, resigned_on string")
    control = spark.createDataFrame([("0", 1, "P", None), ("1", 2, "Q", None), ("2", 3, "R", "2021-01-01"), ("3", 4, "S", None)], "company_number string, pos long, name string, ceased_on string")
    got = joins.principal_for_lead(leads=leads(spark, *[{}] * 5), officers=officers.selectExpr("company_number", "pos", "name", "role", "CAST(appointed_on AS DATE) AS appointed_on", "CAST(resigned_on AS DATE) AS resigned_on"), controllers=control.selectExpr("company_number", "pos", "name", "CAST(ceased_on AS DATE) AS ceased_on"))
    assert column(got, "lead_id", "principal") == [("0", "C"), ("1", "Q"), ("2", "F"), ("3", "S")]


PLACE = "place_id string, pos long, display_name string, address string"
STOP = {"ltd", "limited", "plc", "llp", "uk", "the", "and", "co", "group"}


def plain_place(lead, places):
    """Three passes over the places in order."""
    import re

    words = lambda x: {w for w in re.sub("[^a-z0-9 ]", "", x.lower()).split() if w not in STOP}
    town = (lead["location"] or "").split(",")[0].strip().split()
    near = lambda p: re.search(r"\bGU[0-9]{1,2}\b", p[3] or "", re.I) or (town and len(town[0]) > 2 and town[0].lower() in (p[3] or "").lower())
    cn, surname = words(lead["company_name"]), (lead["contact_name"] or "").lower().split()[-1:]
    tests = (
        lambda p: cn and len(cn & words(p[2])) / len(cn) >= 0.5,
        lambda p: any(len(w) >= 4 for w in cn & words(p[2])) and near(p),
        lambda p: surname and len(surname[0]) >= 4 and surname[0] in p[2].lower() and near(p),
    )
    return next(((p[0], t) for t, test in enumerate(tests, 1) for p in places if test(p)), None)


def test_places_are_linked_however_common_the_words(spark):
    rng = random.Random(4)
    vocabulary = ["acme", "therapy", "zed", "clinic", "hill", "yoga", "brown", "spa", "ltd", "the", "7", "gym", "dental", "surrey", *(f"word{i}" for i in range(60))]
    name = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))).title()
    places = [(f"p{i}", i, name() + rng.choice(["", "low Surgery", " & Co"]), rng.choice(["Woking, GU7 2AB", "Farnham", "Guildford Road", None, "1 GU12"])) for i in range(150)]
    places += [(f"q{i}", 200 + i, "Zed Clinic", "Leeds") for i in range(251)] + [("r", 500, "Brownlow Surgery", "GU1 1AA")]
    rows = [dict(company_name=name(), location=rng.choice([None, "Woking, GU7", "Farnham", "Le", ""]), contact_name=rng.choice([None, "Ann Brown", "Bo Li", "Ruth Hill"])) for _ in range(120)]
    rows += [dict(company_name="Zed Clinic", location=None, contact_name=None), dict(company_name="Qqq", location=None, contact_name="Ann Brown"), dict(company_name="Ltd", location=None, contact_name=None)]
    got = {r.lead_id: (r.place_id, r.tier) for r in joins.link_places(leads=leads(spark, *rows), places=spark.createDataFrame(places, PLACE)).collect()}
    want = {str(i): plain_place(r, places) for i, r in enumerate(rows)}
    assert got == {k: v for k, v in want.items() if v} and len({t for _, t in got.values()}) == 3


def test_registry_titles_contain_names_or_lie_in_them(spark):
    titles = ["Acme Holdings Limited", "Zed", "The Acme Therapy Company", "Dead Acme", "Zed Clinic Ltd"]
    existing = leads(spark, *(dict(company_name=t, company_status="dissolved" if "Dead" in t else "active") for t in titles))
    rows = [("Acme Therapy Ltd", "2"), ("cme Hold", "0"), ("Zed Clinic", "1"), ("Ltd", None), ("Dead Acme", None), ("Acme inc.", "0"), ("Nothing", None)]
    got = {r.lead_id: r.number for r in joins.link_registry_by_name(leads=leads(spark, *(dict(company_name=n) for n, _ in rows)), existing=existing).collect()}
    assert got == {str(i): n for i, (_, n) in enumerate(rows) if n}


def test_containment_equals_all_pairs_and_takes_long_titles(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab ü") for _ in range(n)).strip() or "a"
    titles = [text(rng.choice([1, 3, 6, 20, 40])) for _ in range(60)] + ["x" * 10_000 + "acme hold" + "yz" * 300, "the acme holdings of the whole long street"]
    names = [text(rng.choice([1, 2, 4, 9, 17, 33])) for _ in range(80)] + ["acme hold", "x" * 10_000, "qq the acme holdings of the whole long street qq", "acme holx"]
    got = {r.lead_id: int(r.number) for r in joins.link_registry_by_name(leads=leads(spark, *(dict(company_name=n) for n in names)), existing=leads(spark, *(dict(company_name=t) for t in titles))).collect()}
    want = {}
    for i, n in enumerate(names):
        found = [j for j, t in enumerate(titles) if n.strip() and (n.strip() in t or t in n.strip())]
        if found:
            want[str(i)] = found[0]
    assert got == want


def test_answers_by_kind(spark):
    answers = [("0", 2, "REJECTED"), ("0", 1, "CONFIRMED"), ("1", 1, "REJECTED"), ("2", 1, "UNCERTAIN"), ("3", 1, "FOUND: Laura Evans | Director"), ("4", 1, "FOUND: Acme Therapy"), ("5", 1, "FOUND: Book"), ("6", 1, '{"score": 8}'), ("8", 1, "False: a product"), ("9", 1, "REAL person"), ("10", 1, '{"score": 0, "reason": "near", "sector": "spa", "tag": "studio"}'), ("11", 1, '{"sector": "Yoga", "tag": "studio"}'), ("12", 1, "{broken")]
    verdicts = spark.createDataFrame(answers, "lead_id string, answered_at int, answer string")
    own = leads(spark, *[dict(contact_name="Emma Jones", confidence_score=c) for c in (3.0, 3.0, None, 1.0, *[3.0] * 9)]).selectExpr("*", "1 AS ai_score", "CASE WHEN lead_id = '11' THEN 'office' ELSE 'unit8' END AS category")
    out = merges.verdict_rules(leads=own, verdicts=verdicts)
    got = column(out, "contact_name", "verified", "confidence", "ai_score", "outcome")
    emma = ("Emma Jones", None, 3.0, 1, "none")
    assert got == [
        ("Emma Jones", True, 3.0, 1, "none"), (None, False, 3.0, 1, "none"), ("Emma Jones", None, 1.0, 1, "none"), ("Laura Evans", False, 1.0, 1, "found"), ("Emma Jones", None, 3.0, 1, "invalid_name"), ("Emma Jones", None, 3.0, 1, "invalid_name"), ("Emma Jones", None, 3.0, 8, "none"), emma,
        (None, None, 3.0, 1, "none"), ("Emma Jones", True, 3.0, 1, "none"), emma, emma, emma,
    ]
    assert column(out, "ai_reason", "ai_sector", "tag")[10:] == [("near", None, "studio"), (None, "Yoga", None), (None, None, None)]


def test_word_lists_are_the_callers(spark):
    own = leads(spark, dict(contact_name="Emma Jones"), dict(contact_name="Zed Yoga"), dict(contact_name=" zed  Smith"), dict(), dict(contact_name=""))
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    found = lambda first, business: column(joins.name_word_lists(leads=own, first_names=first, business_words=business), "lead_id", "known_first", "no_business_word")
    assert found(words("emma"), words("yoga", "clinic")) == [("0", True, True), ("1", False, False), ("2", False, True), ("4", False, True)]
    assert found(words("zed"), words("smith", "jones")) == [("0", False, False), ("1", True, True), ("2", True, False), ("4", False, True)]
    assert found(words(), words()) == [("0", False, True), ("1", False, True), ("2", False, True), ("4", False, True)]
    plan = joins.name_word_lists(leads=own, first_names=words("a"), business_words=words("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2


def test_sources_by_priority_and_fallback(spark):
    from leadlake.sources import pages

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "lead_id string")
    own = spark.createDataFrame([("1", "unit8"), ("2", "office"), ("3", "unit8")], "lead_id string, category string")
    runs = lambda *x: spark.createDataFrame(list(x), "source string, failed boolean")
    found = lambda r: {x.lead_id: x.source_rank for x in pages.merge_sources(leads=own, newcomers=ids("3", "4"), fallback_leads=ids("1", "9"), source_runs=r).collect()}
    assert found(runs(("directory", False), ("search", True), ("directory", None))) == found(runs()) == {"1": 1, "3": 1, "4": 2}
    assert found(runs(("directory", False), ("directory", True))) == {"1": 1, "3": 1, "4": 2, "9": 3}


def test_addresses_over_extractors_and_pages(spark):
    html = ['x <a href="mailto:A@b.org?s=1">w</a>', '<script type="application/ld+json">{"email": "mailto:a@b.org"}</script>', "<p>c@b.org", "<p>none", None]
    pages = spark.createDataFrame([(i, "b.org" if i < 3 else "z.org", h) for i, h in enumerate(html)], "page_id long, host string, html string")
    got = sorted(tuple(r) for r in sets.merge_emails(rich_pages=pages).collect())
    assert got == [("b.org", "a@b.org", 3, 0), ("b.org", "c@b.org", 1, 2)]


def test_known_addresses_come_first(spark):
    rows = [("info@acme.org", False), ("emma@acme.org", None), ("emma@acme.org", True), (None, None), ("1@x", False)]
    own = leads(spark, *(dict(contact_name="Emma Jones", email=m) for m, _ in rows)).join(spark.createDataFrame([(str(i), g) for i, (_, g) in enumerate(rows)], "lead_id string, email_guessed boolean"), "lead_id")
    got = {}
    for r in texts.email_guesses(leads=own).orderBy("place").collect():
        got.setdefault(r.lead_id, []).append(r.email)
    plain = ["emma.jones", "e.jones", "emma", "jones", "emma_jones", "emmajones", "emmaj", "ej"]
    at = lambda *x: [f"{n}@acme.org" for n in x]
    assert got["0"] == at("info", *plain) and got["1"] == at("emma", *(p for p in plain if p != "emma"))
    assert got["2"] == got["3"] == got["4"] == at(*plain)


def test_search_by_one_text_and_what_is_given(spark):
    rows = [(6, "local", "Mach", "office"), (6, "exclude", None, "office"), (None, None, "x", "unit8"), (3, "review", "x", "office")]
    own = leads(spark, *(dict(company_name=n, location=p) for n, p in (("Zed Gym", "Woking"), ("Woking Clinic", None), ("Zed", "Woking, GU1"), ("Wok", None))))
    own = own.join(spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "lead_id string, ai_score int, geo_relevance string, sector string, category string"), "lead_id")
    found = lambda **o: column(filters.search_leads(o, leads=own), "lead_id")
    assert found() == ["0"]
    assert found(geo="") == ["0", "1"]
    assert found(search="mach", geo="") == ["0"]
    assert found(category=None, least=None) == ["0", "2", "3"]
    assert found(category=None, least=None, search="", geo="") == ["0", "1", "2", "3"]
    assert found(category=None, least=None, search="", geo="exclude") == ["1"]
    assert found(category=None, least=0, geo="") == ["0", "1", "3"]
    assert found(search="gym woking", geo="") == []


def test_cohorts_of_leads_never_enriched_or_given_up(spark):
    own = leads(spark, dict(), dict(), dict(), dict(contact_name="Emma Jones", confidence_score=2.0, email="a@b.org"), dict(website="https://instagram.com/x", contact_name="nan"))
    more = [(None, None, False), ("2024-06-05", False, None), (None, True, None), ("2024-06-04", None, True), (None, None, None)]
    own = own.join(spark.createDataFrame([(str(i), *r) for i, r in enumerate(more)], "lead_id string, day string, missing_name_final boolean, email_guessed boolean").selectExpr("lead_id", "CAST(day AS DATE) AS last_enriched_date", "missing_name_final", "email_guessed"), "lead_id")
    found = lambda **o: sorted((r.lead_id, r.cohort) for r in filters.cohorts(o, leads=own).collect())
    assert found() == [("0", "A"), ("3", "B"), ("3", "C")]
    assert found(force=True) == [("0", "A"), ("1", "A"), ("3", "B"), ("3", "C")]


def test_unknown_attempts_are_none(spark):
    own = leads(spark, dict(), dict(), dict(contact_name="Emma Jones")).withColumn("enrichment_status", F.lit("x")).join(spark.createDataFrame([("0", None), ("1", 2), ("2", 5)], "lead_id string, enrichment_attempts int"), "lead_id")
    assert column(filters.unreachable(leads=own), "missing_final", "status") == [(False, "x"), (True, "missing_name_final"), (False, "x")]


DUP = "lead_id string, ingest_seq long, company_name string, website string, website_verified string, contact_name string, email string, contact_email string, generic_email string, principal_name string, personal_email_guesses array<string>, phone string, ai_score int"


def test_survivors_by_band_of_data_points(spark):
    full = ("yes", "Emma Jones", "emma@acme.org", None, "info@acme.org", "Ruth Evans", ["a@b.org"], "1", None)
    bare, some = (None, None, None, None, None, None, [], None, 8), ("yes", "Emma Jones", None, None, None, None, [], None, None)
    rows = [("Acme", "acme.org", bare), (" acme", "https://acme.org", full), ("Zed", "zed.org", some), ("ZED", "zed.org", ("yes", "Emma Jones", None, None, None, "Ruth Evans", [], None, None)), ("Zed", None, bare), ("Solo", None, bare)]
    dup = spark.createDataFrame([(str(i), i, n, w, *r) for i, (n, w, r) in enumerate(rows)], DUP)
    got = {r.lead_id: r.first_seq for r in windows.dedupe_keep_best_score(leads_dup=dup).collect()}
    # the full row beats the bare one with the better model score; of two of one band (4 and 5 points) the first stays
    assert got == {"1": 0, "2": 2, "4": 4, "5": 5}
    plan = windows.dedupe_keep_best_score(leads_dup=dup)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_candidates_by_role(spark):
    rows = [
        dict(contact_name="Book Now", contact_names=["Helen Brown - Therapist", "Laura Evans, Managing Director", "Ruth Taylor (Owner)"]),
        dict(contact_name="Book Now", contact_names=["Helen Brown", "Dr Ruth Evans", "Laura Taylor | Head of care"]),
        dict(contact_name="Book Now", contact_names=["Ann Taylor"], location="Laura Evans"),
        dict(contact_name="Book Now", contact_names=["Ann Taylor"], location="Xqanu Jones"),  # looks made up
        dict(contact_name="Book Now", contact_names=[], location="Xqanu Jones"),
    ]
    own = leads(spark, *rows).withColumnRenamed("location", "found_contact")
    got = column(windows.resolve_contact({"main": "found_contact"}, leads=own), "action", "contact_name", "candidates")
    assert got == [
        ("replaced", "Ruth Taylor", "Ruth Taylor; Laura Evans; Helen Brown"), ("replaced", "Laura Taylor", "Laura Taylor; Dr Ruth Evans; Helen Brown"),
        ("replaced", "Laura Evans", "Laura Evans; Ann Taylor"), ("replaced", "Ann Taylor", "Ann Taylor"), ("cleared", None, None),
    ]
    assert column(windows.resolve_contact(leads=own), "contact_name")[2:] == ["Ann Taylor", "Ann Taylor", None]


REFINE = DUP + ", contact_names array<string>, team_email_guesses array<string>, enrichment_source array<string>, refinement_notes array<string>, principal_email_guess string, category string"


def refined(spark, *rows, known=()):
    from leadlake.plans import pipelines

    base = dict(company_name="Acme", website="https://acme.org", website_verified=None, contact_name=None, email=None, contact_email=None, generic_email=None, principal_name=None, personal_email_guesses=[], phone=None, ai_score=None, contact_names=[], team_email_guesses=[], enrichment_source=[], refinement_notes=[], principal_email_guess=None, category="unit8")
    names = [f.split()[0] for f in REFINE.split(", ")]
    table = lambda rs: spark.createDataFrame([tuple({"lead_id": str(i), "ingest_seq": i, **base, "company_name": f"Acme {i}", **r}[n] for n in names) for i, r in enumerate(rs)], REFINE)
    return {r.lead_id: r for r in pipelines.refine(leads=table(rows), existing=table(known)).collect()}


def test_refinement_of_addresses_and_web_presence(spark):
    got = refined(
        spark,
        dict(email="info@acme.org", contact_name="Emma Jones"),
        dict(email="xkqz@acme.org", contact_name="Emma Jones"),
        dict(email="laura.evans@acme.org", contact_name="Emma Jones"),
        dict(website="https://instagram.com/acme", email="info@acme.org"),
        dict(website="https://facebook.com/acme"),
        dict(website=None, enrichment_source=["https://www.facebook.com/x"], email="emma@gmail.com", generic_email="team@acme.org"),
        dict(contact_name="Emma Jones", contact_names=["Emma Jones", "Laura Evans", "Woking Clinic"]),
        dict(category="office"),
    )
    assert set(got) == set("0123456")
    r = got["0"]
    # the shared address leaves `email`; the site's own `info@` takes the empty shared field
    assert (r.contact_email, r.generic_email, r.email_type, r.personal_guesses.split(" | ")[0]) == (None, "info@acme.org", "both", "emma.jones@acme.org")
    assert (got["1"].contact_email, got["1"].notes) == (None, "gibberish_email_cleared:xkqz@acme.org")
    assert (got["2"].contact_email, got["2"].name_review_needed, got["2"].notes, got["2"].email_type) == ("laura.evans@acme.org", True, "email_contact_mismatch:laura.evans@acme.org", "both")
    r = got["3"]
    assert (r.excluded, r.website_verified, r.generic_email, r.notes, r.missing_email) == (True, "no", "info@acme.org", "excluded:no_web_no_fb", False)
    assert (got["4"].excluded, got["4"].website_verified, got["4"].missing_email, got["4"].points) == (False, "facebook", True, 1)
    assert (got["5"].excluded, got["5"].facebook_url, got["5"].email_type, got["5"].points) == (False, "https://www.facebook.com/x", "both", 3)
    assert (got["6"].team_guesses, got["6"].data_score) == ("Laura Evans: laura.evans@acme.org", "medium")
    assert got["6"].points == 2 + 2 + 1 + 1  # site, contact, shared address, guesses


def test_refinement_of_principals_and_survivors(spark):
    known = [dict(company_name="acme 0", principal_name="Emma Jones", principal_email_guess="e@acme.org"), dict(company_name="acme 1", principal_name="Woking Clinic", principal_email_guess="b@acme.org"), dict(company_name="ACME 2", principal_name="Ruth Evans", principal_email_guess="r@acme.org")]
    got = refined(spark, dict(contact_name="Emma Jones"), dict(), dict(website="https://facebook.com/a", contact_name="Ruth Evans"), dict(company_name="Same", phone="1"), dict(company_name=" same ", phone="2"), known=known)
    assert (got["0"].principal_name, got["0"].principal_guess) == ("Emma Jones", None)  # one person with guesses of their own
    assert (got["1"].principal_name, got["1"].principal_guess) == (None, None)
    assert (got["2"].principal_name, got["2"].principal_guess, got["2"].personal_guesses) == ("Ruth Evans", None, "r@acme.org")
    assert set(got) == {"0", "1", "2", "3"}


def test_lists_and_details_of_a_later_run(spark):
    fields = ["phone", "generic_email", "linkedin", "employee_count", "sector"]
    schema = "lead_id string, contact_names array<string>, personal_email_guesses array<string>, " + ", ".join(f"{f} string" for f in fields)
    own = spark.createDataFrame([("0", ["A"], [], "1", " ", None, None, "s"), ("1", ["A"], ["g"], *[None] * 5), ("2", None, None, *[None] * 5)], schema)
    later = spark.createDataFrame([("0", ["B"], ["h"], "2", "i@j", "l", "9", "t"), ("1", ["B", "C"], ["h"], None, "", "l", None, "t")], schema)
    assert column(merges.longer_list(leads=own, later=later), "contact_names", "guesses") == [("A", "h"), ("B; C", "g"), ("", "")]
    assert column(merges.fill_if_empty(leads=own, later=later), *fields) == [("1", "i@j", "l", "9", "s"), (None, None, "l", None, "t"), (None,) * 5]


def test_discovery_funnel(spark):
    sites = [("u1", 1), ("u2", 1), ("u3", 1), (None, 1), ("u5", 2)]
    leads = spark.createDataFrame([("Acme Therapy Ltd", s, p) for s, p in sites], "company_name string, website string, site_pattern int")
    long = "acme therapy in guildford " + "word " * 120
    pages = spark.createDataFrame([(1, "u1", long), (2, "u2", f"acme {PARKED[0]} " + long), (5, "u5", "word " * 120)], "page_id long, url string, text string")
    got = {r.pattern: r for r in reports.discovery_funnel(leads=leads, page_text=pages).collect()}
    assert set(got) == {"all", "1", "2"}
    r = got["all"]
    assert (r.attempted, r.resolved, r.validated, r.high, r.medium, r.low) == (5, 4, 1, 1, 0, 0)
    assert (r.no_name_match, r.parked, r.get_failed, r.pct_false) == (1, 1, 1, 75.0)
    assert (r.calls, r.cost, r.projected_sites, r.projected_cost) == (4, 0.076, 0, 0.019)
    assert (got["2"].attempted, got["2"].no_name_match) == (1, 1)


def test_addresses_by_position(spark):
    docs = spark.createDataFrame([(1, "a@b.com then c@d.org"), (2, "none"), (3, None), (4, "x@sentry.io @")], "doc_id long, text string")
    got = [tuple(r) for r in texts.extract_emails(mailed_documents=docs).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "a@b.com"), (1, 1, "c@d.org")]
