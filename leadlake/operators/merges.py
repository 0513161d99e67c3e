"""Update and merge rules."""

from __future__ import annotations

from ..functions import emails as E
from ..functions import names as N
from ..functions import rules as R
from ..functions.keys import blank, host, normal
from .core import operator
from .joins import LINK_SIDES, link_places


def replaced_email(d) -> str:
    """Rows with the email after a found one: a new personal address replaces the old, which becomes a guess; a shared one only replaces a guessed, bad or missing one."""
    weak = f"(email IS NULL OR coalesce(email_guessed, false) OR coalesce({d.holds('lower(email)', R.BAD_EMAILS)}, false))"
    personal = f"(found IS NOT NULL AND NOT {E.generic(d, 'found')})"
    shared = f"(found IS NOT NULL AND {E.generic(d, 'found')})"
    old = f"CASE WHEN email IS NOT NULL AND NOT {d.has('personal_email_guesses', 'email')} THEN email || ';' ELSE '' END"
    return f"""SELECT lead_id, CASE WHEN {personal} AND found <> coalesce(email, '') THEN 'replaced' WHEN {personal} THEN 'kept' WHEN {shared} AND {weak} THEN 'generic_in' WHEN {shared} THEN 'stored_generic' ELSE 'none' END AS action,
        CASE WHEN {personal} OR ({shared} AND {weak}) THEN found ELSE email END AS email, CASE WHEN {personal} OR ({shared} AND {weak}) THEN false ELSE email_guessed END AS email_guessed,
        CASE WHEN {shared} AND NOT {weak} THEN found ELSE generic_email END AS generic_email,
        CASE WHEN {personal} AND found <> coalesce(email, '') THEN {old} ELSE '' END || {d.join('personal_email_guesses', ';')} AS guesses FROM (SELECT l.*, f.found FROM leads l LEFT JOIN found_emails f ON f.lead_id = l.lead_id) t"""


@operator("U1", "leads", "found_emails")
def replace_email(d):
    """The email after a found one (one a lead)."""
    return replaced_email(d)


@operator("U3", "leads")
def accept_contact(d):
    """Acceptance of a found contact: invalid names are rejected (a single name passes where the notes say so), domain names too, vanity and suspicious ones replaced by a better team member where there is one; with the contact and the address it lets guess."""
    site = host(d, "website")
    valid = lambda w: N.contact_valid(d, w)
    fair = d.at(d.filter("contact_names", "w", f"{valid('w')} AND NOT {N.vanity(d, 'w', 'company_name')}"), "1")
    real = d.at(d.filter("contact_names", "w", f"{valid('w')} AND NOT {N.suspicious(d, 'w')}"), "1")
    single = d.some("refinement_notes", "x", "contains(x, 'single_name_only')")
    outcome = f"""CASE WHEN name IS NULL THEN 'none' WHEN NOT {valid('name')} AND NOT {single} THEN 'rejected_garbage' WHEN {N.domain_name(d, 'name', site)} THEN 'rejected_domain'
        WHEN {N.vanity(d, 'name', 'company_name')} THEN CASE WHEN fair IS NULL THEN 'left' ELSE 'vanity_replaced' END
        WHEN {N.suspicious(d, 'name')} AND {d.size('contact_names')} > 0 THEN CASE WHEN real IS NULL THEN 'flagged' ELSE 'suspicious_replaced' END ELSE 'accepted' END"""
    chosen = "CASE WHEN outcome IN ('accepted', 'flagged') THEN name WHEN outcome = 'vanity_replaced' THEN fair WHEN outcome = 'suspicious_replaced' THEN real END"
    return f"""SELECT lead_id, outcome, contact, contact IS NOT NULL AND NOT single AS verified, CASE WHEN email IS NULL THEN {d.at(E.guesses(d, 'contact', 'site'), '1')} END AS guessed_email FROM (SELECT lead_id, email, site, single, outcome, {chosen} AS contact FROM (
        SELECT lead_id, email, name, fair, real, site, single, {outcome} AS outcome FROM (SELECT *, {normal(d, 'contact_name')} AS name, {fair} AS fair, {real} AS real, {site} AS site, {single} AS single FROM leads) a) b) c"""


@operator("U4", "leads", "later")
def longer_list(d):
    """Contacts and guesses of a later run replace a lead's own only if its list is empty or theirs is strictly longer; null lists are empty."""
    kept = lambda c: d.join(f"CASE WHEN coalesce({d.size(f'n.{c}')}, 0) > coalesce({d.size(f'l.{c}')}, 0) THEN n.{c} ELSE coalesce(l.{c}, {d.text_array()}) END", "; ")
    return f"SELECT l.lead_id, {kept('contact_names')} AS contact_names, {kept('personal_email_guesses')} AS guesses FROM leads l LEFT JOIN later n ON n.lead_id = l.lead_id"


@operator("U5", "leads")
def backfill_principal(d):
    return f"SELECT lead_id, coalesce({normal(d, 'contact_name')}, principal_name) AS contact_name, coalesce(email, principal_email_guess) AS email, email IS NULL AND principal_email_guess IS NOT NULL AS email_guessed FROM leads"


@operator("U6", "leads", "later")
def fill_if_empty(d):
    """Missing phone, shared address, profile, number of employees and sector from a later run's row; blanks are missing."""
    filled = ", ".join(f"coalesce({blank(f'l.{c}')}, {blank(f'n.{c}')}) AS {c}" for c in ("phone", "generic_email", "linkedin", "employee_count", "sector"))
    return f"SELECT l.lead_id, {filled} FROM leads l LEFT JOIN later n ON n.lead_id = l.lead_id"


@operator("U7", "leads")
def promote_email(d):
    """Empty email: first guess, marked as guessed, else the shared address."""
    return f"SELECT lead_id, coalesce(email, {d.at('personal_email_guesses', '1')}, generic_email) AS email, CASE WHEN email IS NULL AND {d.size('personal_email_guesses')} > 0 THEN true ELSE coalesce(email_guessed, false) END AS email_guessed FROM leads"


@operator("U8", "leads", "places", sides=LINK_SIDES)
def apply_place(d):
    """Website of the linked place; only when it has one, the phone if the lead has none, and the rating. The source is tagged on hit and miss."""
    came = blank("p.website")
    rating = f"CAST({d.even('p.rating', 1)} AS STRING) || '/5' || CASE WHEN p.reviews IS NOT NULL THEN ' (' || CAST(p.reviews AS STRING) || ' reviews)' ELSE '' END"
    return f"""SELECT l.lead_id, m.place_id, coalesce({came}, l.website) AS website, CASE WHEN {came} IS NOT NULL THEN coalesce({blank('l.phone')}, p.phone) ELSE l.phone END AS phone, CASE WHEN {came} IS NOT NULL AND p.rating IS NOT NULL THEN {rating} END AS rating,
        {d.join(d.distinct(("list_append(l.enrichment_source, 'places_lookup')" if d.duck else "array_append(l.enrichment_source, 'places_lookup')")), ';')} AS source
        FROM leads l LEFT JOIN ({link_places.sql(d)}) m ON m.lead_id = l.lead_id LEFT JOIN places p ON p.place_id = m.place_id"""


@operator("U9", "leads")
def count_attempt(d, day: str = "2024-07-01"):
    """One more attempt, on the given day."""
    return f"SELECT lead_id, coalesce(enrichment_attempts, 0) + 1 AS attempts, DATE '{day}' AS last_enriched_date FROM leads"


@operator("U10", "leads")
def tag_source(d):
    both = ("list_append(enrichment_source, 'website_discovery')" if d.duck else "array_append(enrichment_source, 'website_discovery')")
    return f"SELECT lead_id, {d.join(d.distinct(both), ';')} AS source FROM leads"


def cleared(d, reason: str) -> str:
    return f"CASE WHEN {reason} IS NULL THEN contact_name END"


@operator("U11", "leads")
def clear_name(d):
    """Names with a garbage reason are cleared and noted; empty ones have nothing to clear."""
    from .texts import garbage

    return f"SELECT lead_id, {cleared(d, 'reason')} AS contact_name, CASE WHEN reason IS NULL THEN contact_verified ELSE false END AS verified, {d.join('refinement_notes', '; ')} || CASE WHEN reason IS NULL THEN '' ELSE '; name_cleared:' || reason END AS notes FROM (SELECT *, nullif({garbage(d)}, 'empty') AS reason FROM leads) t"


@operator("U12", "leads", "verdicts")
def verdict_rules(d):
    """The first answer of each kind by time.

    A found name is set if valid and not the company's (its role too, unverified);
    a confirmed one is verified, a rejected one cleared, an uncertain one loses
    confidence; an answer to a check for false names clears the name if it begins
    with FALSE and verifies it else; of a score, the number, the reason, a sector of
    over three letters and, for wellness leads, the tag are taken over.
    """
    name, role = "trim(split_part(substr(found, 7), '|', 1))", "nullif(trim(split_part(substr(found, 7), '|', 2)), '')"
    first = lambda test: f"min_by(answer, CASE WHEN {test} THEN answered_at END)"
    checks = " OR ".join(d.starts("upper(answer)", d.lit(w)) for w in ("FALSE", "REAL"))
    asked = f"SELECT lead_id, {first(d.starts('upper(answer)', d.lit('FOUND:')))} AS found, {first(d.starts('answer', d.lit('{')))} AS scored, {first(d.word('answer', ['CONFIRMED', 'REJECTED', 'UNCERTAIN']))} AS said, {first(checks)} AS checked FROM verdicts GROUP BY lead_id"
    ok = f"coalesce({N.contact_valid(d, 'name')} AND NOT {N.vanity(d, 'name', 'company_name')}, false)"
    false = f"coalesce({d.starts('upper(checked)', d.lit('FALSE'))}, false)"
    text = lambda field: f"nullif(trim({d.json('scored', field)}), '')"
    return f"""SELECT lead_id, CASE WHEN named THEN name WHEN said = 'REJECTED' OR {false} THEN NULL ELSE contact_name END AS contact_name, CASE WHEN named THEN role END AS contact_role,
        CASE WHEN named THEN false WHEN {false} THEN NULL WHEN said = 'CONFIRMED' OR checked IS NOT NULL THEN true WHEN said = 'REJECTED' THEN false ELSE contact_verified END AS verified,
        CASE WHEN said = 'UNCERTAIN' THEN greatest(1.0, coalesce(confidence_score, 2) - 1) ELSE confidence_score END AS confidence,
        coalesce(nullif({d.number(d.json('scored', 'score'), 'INT')}, 0), ai_score) AS ai_score, {text('reason')} AS ai_reason, CASE WHEN length({text('sector')}) > 3 THEN {text('sector')} END AS ai_sector, CASE WHEN category = 'unit8' THEN {text('tag')} END AS tag,
        CASE WHEN found IS NULL THEN 'none' WHEN ok THEN 'found' WHEN {N.contact_valid(d, 'name')} THEN 'vanity_rejected' ELSE 'invalid_name' END AS outcome
        FROM (SELECT *, found IS NOT NULL AND ok AS named FROM (SELECT *, {ok} AS ok FROM (SELECT l.*, v.found, v.scored, v.said, v.checked, {name} AS name, {role} AS role FROM leads l LEFT JOIN ({asked}) v ON v.lead_id = l.lead_id) a) b) c"""
