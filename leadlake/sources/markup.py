"""The structure of pages as a table of elements, from one linear scan of the markup.

The scan keeps a stack of open elements.  It knows void elements, elements that
end where the next of their kind begins, and ignores end tags that nothing opened;
what is open at the end is closed there.  It decides nothing about content: rules
read its table with Spark's own expressions.

`zones` names regular expressions over tag and class (or id); every element and
text carries, for each, the place of the nearest enclosing element that fits, itself
included.  So "inside a footer" or "cards of a list" are equalities, not searches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters up to which an element's text is given; longer ones only by length. Script bodies are given whole.
LONGEST = 300
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end where one of these begins inside the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "p": {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "footer"}}
KIND = "pos int, tag string, parent int, last int, depth int, attrs map<string,string>, text string, chars int, zones map<string,int>"


@dataclass(frozen=True)
class Zone:
    """Elements of some tags (all: None) whose tag is in `named`, or whose class (and id, if `ids`) holds the pattern."""

    pattern: str
    tags: frozenset[str] | None = None
    ids: bool = False
    named: frozenset[str] = frozenset()

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag in self.named:
            return True
        if self.tags is not None and tag not in self.tags:
            return False
        own = attrs.get("class", "") + ("\n" + attrs.get("id", "") if self.ids else "")
        return bool(own) and re.search(self.pattern, own, re.I) is not None


class _Scan(HTMLParser):
    def __init__(self, zones: dict[str, Zone], longest: int):
        super().__init__(convert_charrefs=True)
        self.zones, self.longest = zones, longest
        self.rows: list[list] = []
        self.open: list[int] = []  # places of open elements in rows
        self.count: dict[str, int] = {}
        self.texts: list[str] = []
        self.upto = [0]  # characters before each text
        self.begin: dict[int, int] = {}

    def _put(self, tag: str, attrs: dict[str, str]) -> int:
        parent = self.open[-1] if self.open else -1
        pos = len(self.rows)
        zones = dict(self.rows[parent][8]) if parent >= 0 else {}
        zones.update((name, pos) for name, z in self.zones.items() if z.fits(tag, attrs))
        self.rows.append([pos, tag, parent, pos, len(self.open), attrs, None, 0, zones])
        self.begin[pos] = len(self.texts)
        return pos

    def _close(self) -> None:
        pos = self.open.pop()
        row = self.rows[pos]
        self.count[row[1]] -= 1
        row[3] = len(self.rows) - 1
        self._text(row)

    def _text(self, row: list) -> None:
        first = self.begin.pop(row[0])
        row[7] = max(0, self.upto[-1] - self.upto[first] - 1)
        if row[7] <= self.longest and row[1] != "script":  # a script has its body already
            row[6] = " ".join(self.texts[first:])

    def handle_starttag(self, tag, attrs):
        while self.open and tag in ENDS.get(self.rows[self.open[-1]][1], ()):
            self._close()
        pos = self._put(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self._text(self.rows[pos])
        else:
            self.open.append(pos)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag):
        if self.count.get(tag):
            while self.rows[self.open[-1]][1] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        text = " ".join(data.split())
        if not text:
            return
        if self.open and self.rows[self.open[-1]][1] in ("script", "style"):
            row = self.rows[self.open[-1]]
            if row[1] == "script":
                row[6] = (row[6] or "") + data
            return
        pos = self._put("#text", {})
        self.texts.append(text)
        self.upto.append(self.upto[-1] + len(text) + 1)
        self.begin.pop(pos)
        self.rows[pos][6:8] = [text, len(text)]

    def done(self) -> list[list]:
        self.close()
        while self.open:
            self._close()
        return self.rows


def scanned(html: str, zones: dict[str, Zone], longest: int = LONGEST) -> list[list]:
    """Rows of one page: pos, tag, parent, last, depth, attrs, text, chars, zones; texts are rows of the tag `#text`."""
    scan = _Scan(zones, longest)
    scan.feed(html)
    return scan.done()


def elements(pages: DataFrame, zones: dict[str, Zone], page_id: str = "page_id", html: str = "html", longest: int = LONGEST) -> DataFrame:
    """page_id and the elements and texts of every page, in order.

    A null or empty page has none; repeated rows are scanned each time.  `text` is
    the whole text inside an element, blanks squeezed, null where it is longer than
    `longest`; scripts have their body; `last` is the place of the last descendant.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    map_of = lambda t: pa.map_(pa.string(), t)
    types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), map_of(pa.string()), pa.string(), pa.int32(), map_of(pa.int32())]
    names = [c.split()[0] for c in KIND.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a page at a time, so that memory follows the longest page
                rows = scanned(batch.column(1)[i].as_py() or "", zones, longest)
                if rows:
                    own = batch.column(0).take(pa.array([i] * len(rows), pa.int32()))
                    columns = list(zip(*rows, strict=True))
                    columns[5], columns[8] = ([list(m.items()) for m in columns[c]] for c in (5, 8))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["page_id", *names])

    return rows.mapInArrow(run, f"page_id {kind}, {KIND}")
