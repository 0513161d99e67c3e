"""The staged waterfall: each lead ends at the first source that completes it, as a plain loop over the sources does."""

from leadlake.plans import waterfall

LEAD = "lead_id string, company_name string, website string, contact_name string, email string, contact_names array<string>, generic_email string, personal_email_guesses array<string>, enrichment_source array<string>, principal_name string, email_guessed boolean"


def found(spark, rows, pages=(), officers=(), verdicts=()):
    base = dict(company_name="Acme", website="https://acme.org", contact_name=None, email=None, contact_names=[], generic_email=None, personal_email_guesses=[], enrichment_source=[], principal_name=None, email_guessed=None)
    names = [f.split()[0] for f in LEAD.split(", ")]
    leads = spark.createDataFrame([tuple({"lead_id": str(i), **base, **r}[n] for n in names) for i, r in enumerate(rows)], LEAD)
    page_text = spark.createDataFrame(list(pages), "url string, text string")
    own = spark.createDataFrame([(n, i, name, "director", None, None) for i, (n, name) in enumerate(officers)], "company_number string, pos long, name string, role string, appointed_on date, resigned_on date")
    control = spark.createDataFrame([], "company_number string, pos long, name string, ceased_on date")
    said = spark.createDataFrame(list(verdicts), "lead_id string, answered_at int, answer string")
    return waterfall.waterfall_stages(leads=leads, page_text=page_text, officers=own, controllers=control, verdicts=said)


def test_each_lead_ends_at_the_first_source_that_completes_it(spark):
    rows = [
        dict(contact_name="Emma Jones", email="e@acme.org", contact_names=["Emma Jones"], generic_email="i@acme.org"),
        dict(website=None),
        dict(website=None, enrichment_source=["https://facebook.com/x"]),
        dict(website="https://a.org"),
        dict(website="https://b.org"),
        dict(website="https://c.org", principal_name="Ruth Evans"),
        dict(website="https://d.org"),
        dict(website="https://e.org", contact_name="nan", email="x@e.org"),
        dict(website="https://www.instagram.com/f"),
        dict(website="https://g.org", company_name="Laura Evans Ltd"),
    ]
    pages = [("https://a.org", "Laura Evans, Director"), ("https://b.org", "write to hello@b.org"), ("https://e.org", "Acme Clinic, Owner"), ("https://g.org", "Laura Evans, Owner of all"), ("https://www.instagram.com/f", "Laura Evans, Owner f@f.org")]
    officers = [("4", "JONES, Emma"), ("0", "NEVER, Asked"), ("9", "TAYLOR, Helen")]
    verdicts = [("6", 2, "FOUND: Helen Brown | Owner"), ("6", 1, "FOUND: Emma Taylor | Owner"), ("7", 1, "FOUND: Ann Taylor"), ("8", 1, "REJECTED")]
    out = found(spark, rows, pages, officers, verdicts)
    got = {r.lead_id: (r.stage, r.contact, r.contact_from, r.email, r.guessed) for r in out.collect()}
    assert got == {
        "0": ("own", "Emma Jones", "own", "e@acme.org", False),
        "1": ("excluded", None, None, None, False),
        "2": ("left", None, None, None, False),
        "3": ("website", "Laura Evans", "website", "laura.evans@a.org", True),
        "4": ("registry", "Emma Jones", "registry", "hello@b.org", False),
        "5": ("registry", "Ruth Evans", "registry", "ruth.evans@c.org", True),
        "6": ("verdict", "Emma Taylor", "verdict", "emma.taylor@d.org", True),
        "7": ("verdict", "Ann Taylor", "verdict", "x@e.org", False),
        "8": ("left", None, None, None, False),
        "9": ("registry", "Helen Taylor", "registry", "helen.taylor@g.org", True),
    }
    assert {r.stage: r.n for r in waterfall.sizes(out).collect()} == {"own": 1, "excluded": 1, "left": 2, "website": 1, "registry": 3, "verdict": 2}


def test_empty_tables(spark):
    assert found(spark, []).count() == 0
    assert found(spark, [dict()]).select("stage").collect()[0][0] == "left"
