"""Keys and small text expressions shared by the rules."""

from __future__ import annotations

from .dialect import Dialect
from .rules import SOCIAL


def name_key(name: str) -> str:
    return f"lower(trim({name}))"


def website_key(d: Dialect, url: str) -> str:
    """Lower case, without schemes, `www.` and closing slashes; empty is null."""
    return f"nullif({d.rep(d.rep(f'lower({url})', 'https?://|www\\.'), '/+$')}, '')"


def domain(d: Dialect, url: str) -> str:
    return f"split_part({d.rep(url, 'https?://|www\\.')}, '/', 1)"


def host(d: Dialect, url: str) -> str:
    """The domain without port, query and fragment."""
    return f"lower({d.rep(domain(d, url), '[:?#].*$')})"


def lead_key(name: str, email: str) -> str:
    return f"{name_key(name)} || '|' || lower(trim(coalesce({email}, '')))"


def name_location_key(name: str, location: str) -> str:
    """Null unless both parts are there."""
    return f"nullif({name_key(name)}, '') || '|' || nullif(lower(trim({location})), '')"


def blank(x: str) -> str:
    return f"nullif(trim({x}), '')"


def normal(d: Dialect, x: str) -> str:
    """Null for empty, blank, `nan` and `None`."""
    return f"CASE WHEN lower(trim({x})) IN ('', 'nan', 'none') THEN NULL ELSE trim({x}) END"


def social(d: Dialect, url: str) -> str:
    return f"coalesce({d.holds(f'lower({url})', SOCIAL)}, false)"


def facebook(d: Dialect, url: str) -> str:
    return f"coalesce({d.holds(f'lower({url})', ['facebook.com', 'fb.com'])}, false)"


def local(email: str) -> str:
    return f"lower(split_part({email}, '@', 1))"


def letters(d: Dialect, x: str) -> str:
    return d.rep(f"lower({x})", "[^a-z]")


def vowels(d: Dialect, x: str) -> str:
    return f"length({d.rep(x, '[^aeiouy]')})"


def tokens(d: Dialect, x: str, stop) -> str:
    """Distinct lower-case words without the stop words."""
    words = d.split(f"trim({d.rep(f'lower({x})', '[^a-z0-9]+', ' ')})", " +")
    return d.distinct(d.filter(words, "w", f"w <> '' AND NOT {d.word('w', stop)}"))
