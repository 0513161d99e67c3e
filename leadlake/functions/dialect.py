"""Rules are written once as SQL text; the few spellings that differ between engines are looked up here.

`SPARK` is what the library runs.  `DUCK` spells the same expression for the
independent engine that the tests and the driver compare with.
"""

from __future__ import annotations

import re


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Dialect:
    duck = False
    staged = False  # whether sides that a statement reads often have been written as tables

    def lit(self, text: str) -> str:
        """A string literal; backslashes stay as they are."""
        return "r" + ('"' + text + '"' if "'" in text else "'" + text + "'")

    def array(self, items) -> str:
        return "array(" + ", ".join(self.lit(i) for i in items) + ")"

    def match(self, a: str, pattern: str) -> str:
        return f"regexp_like({a}, {self.lit(pattern)})"

    def rep(self, a: str, pattern: str, new: str = "") -> str:
        return f"regexp_replace({a}, {self.lit(pattern)}, {self.lit(new)})"

    def squeeze(self, a: str) -> str:
        """Runs of white space as one blank; single blanks are left where they are."""
        return self.rep(a, "\\s{2,}|[\\t\\n\\x0B\\f\\r]", " ")

    def extract(self, a: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({a}, {self.lit(pattern)}, {group})"

    def extract_all(self, a: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({a}, {self.lit(pattern)}, {group})"

    def split(self, a: str, pattern: str) -> str:
        return f"split({a}, {self.lit(pattern)})"

    def filter(self, a: str, var: str, test: str) -> str:
        return f"filter({a}, {var} -> {test})"

    def map(self, a: str, var: str, value: str) -> str:
        return f"transform({a}, {var} -> {value})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def at(self, a: str, i: str) -> str:
        """Element i from 1; null past the end."""
        return f"try_element_at({a}, CAST({i} AS INT))"

    def let(self, a: str, var: str, value: str) -> str:
        """`value`, in which `var` stands for a that is worked out once."""
        return self.at(self.map(self.wrap(a), var, value), "1")

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def minus(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def slice(self, a: str, start: str, length: str) -> str:
        return f"slice({a}, CAST({start} AS INT), CAST({length} AS INT))"

    def explode(self, a: str) -> str:
        return f"explode({a})"

    def even(self, a: str, digits: int = 0) -> str:
        """Half-even rounding."""
        return f"CAST(bround({a}, {digits}) AS DOUBLE)"

    def number(self, a: str, kind: str) -> str:
        return f"try_cast({a} AS {kind})"

    def day(self, a: str) -> str:
        return f"CAST({a} AS DATE)"

    def starts(self, a: str, b: str) -> str:
        return f"startswith({a}, {b})"

    def tuple(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def sequence(self, low: str, high: str) -> str:
        return f"sequence({low}, {high})"

    def text_array(self) -> str:
        return "CAST(array() AS ARRAY<STRING>)"

    def wrap(self, a: str) -> str:
        """An array of one value."""
        return f"array({a})"

    def first(self, a: str, var: str, test: str) -> str:
        """Place of the first element that passes; one past the end if none does."""
        return f"coalesce(nullif(CAST(array_position({self.map(a, var, f'CASE WHEN {test} THEN 1 ELSE 0 END')}, 1) AS INT), 0), {self.size(a)} + 1)"

    def json(self, a: str, path: str) -> str:
        return f"get_json_object({a}, {self.lit('$.' + path)})"

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})"

    def from_hex(self, a: str) -> str:
        """Two hexadecimal digits as an integer."""
        return f"CAST(conv({a}, 16, 10) AS INT)"

    def to_hex(self, a: str) -> str:
        return f"lpad(lower(hex({a})), 2, '0')"

    def some(self, a: str, var: str, test: str) -> str:
        return f"({self.size(self.filter(a, var, test))} > 0)"

    def word(self, a: str, words) -> str:
        """Whether a is one of the words."""
        return f"{a} IN ({', '.join(self.lit(w) for w in words)})"

    def holds(self, a: str, words) -> str:
        """Whether a contains any of the words."""
        return self.match(a, "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("\\&", "&").replace("'", "\\x27") for w in words))


class Duck(Dialect):
    duck = True

    def lit(self, text):
        return quote(text)

    def array(self, items):
        return "[" + ", ".join(self.lit(i) for i in items) + "]::VARCHAR[]"

    def match(self, a, pattern):
        return f"regexp_matches({a}, {self.lit(pattern)})"

    def rep(self, a, pattern, new=""):
        return f"regexp_replace({a}, {self.lit(pattern)}, {self.lit(new.replace('$', chr(92)))}, 'g')"

    def squeeze(self, a):
        return self.rep(a, "\\s+", " ")

    def split(self, a, pattern):
        return f"string_split_regex({a}, {self.lit(pattern)})"

    def filter(self, a, var, test):
        return f"list_filter({a}, lambda {var}: {test})"

    def map(self, a, var, value):
        return f"list_transform({a}, lambda {var}: {value})"

    def size(self, a):
        return f"len({a})"

    def join(self, a, sep):
        return f"coalesce(array_to_string({a}, {self.lit(sep)}), '')"

    def at(self, a, i):
        return f"list_extract({a}, {i})"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def intersect(self, a, b):
        return self.distinct(f"list_filter({a}, lambda own_item: list_contains({b}, own_item))")

    def distinct(self, a):
        return f"list_filter({a}, lambda own_item, own_place: list_position({a}, own_item) = own_place)"

    def minus(self, a, b):
        return self.distinct(f"list_filter({a}, lambda own_item: NOT list_contains({b}, own_item))")

    def slice(self, a, start, length):
        return f"list_slice({a}, {start}, {start} + {length} - 1)"

    def explode(self, a):
        return f"unnest({a})"

    def even(self, a, digits=0):
        return f"round_even({a}, {digits})::DOUBLE"

    def number(self, a, kind):
        return f"try_cast({a} AS {kind})"

    def starts(self, a, b):
        return f"starts_with({a}, {b})"

    def tuple(self, **fields):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def sequence(self, low, high):
        return f"range({low}, {high} + 1)"

    def text_array(self):
        return "[]::VARCHAR[]"

    def wrap(self, a):
        return f"[{a}]"

    def first(self, a, var, test):
        return f"coalesce(nullif(list_position({self.map(a, var, f'CASE WHEN {test} THEN 1 ELSE 0 END')}, 1), 0), len({a}) + 1)"

    def xor(self, a, b):
        return f"xor({a}, {b})"

    def from_hex(self, a):
        return f"('0x' || {a})::INT"

    def to_hex(self, a):
        return f"printf('%02x', {a})"

    def json(self, a, path):
        return f"json_extract_string({a}, {self.lit('$.' + path)})"


SPARK, STAGED, DUCK = Dialect(), Dialect(), Duck()
STAGED.staged = True
