"""Page markup.

A page is read once, into an index of its tags: place, name, and the place of the end tag that belongs to each. Any number of
containers and attributes are then answered from intervals of the index, without going over the page again. Pages reach
Python in Arrow batches inside the map stage; there is no shuffle.
"""

from __future__ import annotations

import html.entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------
# Elements that never have an end tag.
VOID_ELEMENTS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
# Character references written without looking at the full table.
COMMON_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}
# ----------------------------------------------------------------------------------------------

# Comments, scripts and styles hold no page text; an empty tag keeps the text around them apart.
_HIDDEN = re.compile(r"(?isa)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>")
_TAG = re.compile(
    r"(?a)<(/?)(?:([a-zA-Z][^\s/>]*)|(?=[/!?]))(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)"
)
_VOID = frozenset(VOID_ELEMENTS)
_ENTITY = re.compile(r"&#?[a-zA-Z0-9]+;")
_NUMBER = re.compile(r"&#(?:[xX]0*([0-9a-fA-F]{1,6})|0*([0-9]{1,7}));")
_SPACES = re.compile(r"(?a)\s+")


@dataclass(frozen=True)
class Element:
    """Names an element by tag, by class, or by both."""

    tag: str | None = None
    cls: str | None = None


@lru_cache(maxsize=None)
def _attribute(name: str) -> re.Pattern:
    return re.compile(rf"(?isa)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


def _entity(found: re.Match) -> str:
    text = found[0]
    number = _NUMBER.fullmatch(text)
    if not number:
        return html.entities.html5.get(text[1:], text) if text[1] != "#" else text
    point = int(number[1], 16) if number[1] else int(number[2])
    return chr(point) if 0 < point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF else text


def plain(text: str) -> str:
    """The text with its character references replaced, each once, and without white space around it."""
    return (_ENTITY.sub(_entity, text) if "&" in text else text).strip()


class PageIndex:
    """The tags of a page in order, and for each start tag the place of its end tag.

    An end tag belongs to the last open start tag of its name, so unclosed paragraphs and the like do not matter; an element
    that is never closed reaches to the end of the page.
    """

    def __init__(self, page: str):
        self.page = page = _HIDDEN.sub("<!>", page)
        self.starts: list[int] = []
        self.stops: list[int] = []
        self.names: list[str] = []
        # Places of end tags by the place of their start tag, and of start tags by name.
        self.ends: dict[int, int] = {}
        self.by_name: dict[str, list[int]] = {}
        opened: dict[str, list[int]] = {}
        start, stop, named, ends, by_name = self.starts.append, self.stops.append, self.names.append, self.ends, self.by_name
        for at, found in enumerate(_TAG.finditer(page)):
            i, j = found.span()
            start(i)
            stop(j)
            closing, name = found.groups()
            name = name.lower() if name else ""
            if closing:
                named("")
                waiting = opened.get(name)
                if waiting:
                    ends[waiting.pop()] = at
                continue
            named(name)
            if name in by_name:
                by_name[name].append(at)
            else:
                by_name[name] = [at]
            if name and name not in _VOID:
                if name in opened:
                    opened[name].append(at)
                else:
                    opened[name] = [at]

    def attribute(self, at: int, name: str) -> str:
        """Value of an attribute of a tag, '' when absent."""
        found = _attribute(name).search(self.page, self.starts[at], self.stops[at])
        return found[1] or found[2] or found[3] or "" if found else ""

    def elements(self, element: Element, first: int = 0, last: int | None = None) -> Iterator[int]:
        """Start tags between two places that match, in order."""
        last = len(self.names) if last is None else last
        if element.tag is not None:
            among = self.by_name.get(element.tag, [])
            among = among[bisect_left(among, first) : bisect_left(among, last)]
        else:
            among = range(first, last)
        for at in among:
            if self.names[at] and self.names[at] not in _VOID:
                if element.cls is None or self._has_class(at, element.cls):
                    yield at

    def _has_class(self, at: int, cls: str) -> bool:
        if self.page.find(cls, self.starts[at], self.stops[at]) < 0:
            return False
        return f" {cls} " in f" {_SPACES.sub(' ', self.attribute(at, 'class'))} "

    def texts(self, container: Element, noise: Sequence[Element] = ()) -> list[str] | None:
        """Plain, non-empty texts inside the first element that matches ``container``, without the elements in it that match
        ``noise``; None when the page has no such element."""
        at = next(self.elements(container), None)
        if at is None:
            return None
        last = self.ends.get(at, len(self.starts))
        left_out = sorted(i for element in noise for i in self.elements(element, at + 1, last))
        found, i, skip = [], at, iter([*left_out, last])
        nearest = next(skip)
        while i < last:
            if i == nearest:
                # Texts go on after the end of what is left out, and so do the elements looked for in it.
                i = min(self.ends.get(i, last), last)
                while nearest < i:
                    nearest = next(skip)
                continue
            text = plain(self.page[self.stops[i] : self.starts[i + 1] if i + 1 < len(self.starts) else None])
            if text:
                found.append(text)
            i += 1
        return found

    def meta(self, key: str, value: str) -> str:
        """Plain content of the first meta tag whose attribute ``key`` equals ``value``, '' when absent."""
        for at in self.by_name.get("meta", ()):
            if self.attribute(at, key) == value:
                return plain(self.attribute(at, "content"))
        return ""


@dataclass(frozen=True)
class Texts:
    """A field that joins the texts of a container."""

    container: Element
    separator: str = ""
    noise: tuple[Element, ...] = ()

    def read(self, page: PageIndex) -> str | None:
        texts = page.texts(self.container, self.noise)
        return None if texts is None else self.separator.join(texts)


@dataclass(frozen=True)
class Meta:
    """A field that is the content of a meta tag, named by one of its attributes."""

    key: str
    value: str

    def read(self, page: PageIndex) -> str | None:
        return page.meta(self.key, self.value)


def page_fields(page: Column, **fields: Sequence[Texts | Meta]) -> Column:
    """A struct with one string per field: the first of its sources that is neither absent nor empty; else '' if any source
    is there, and NULL if none is. A NULL page counts as empty. Each page is indexed once for all fields."""

    @F.arrow_udf(", ".join(f"{name} string" for name in fields))
    def read(pages: pa.Array) -> pa.Array:
        columns: dict[str, list] = {name: [] for name in fields}
        for one in pages:
            index = PageIndex(one.as_py() or "")
            for name, sources in fields.items():
                value = None
                for source in sources:
                    found = source.read(index)
                    value = value if found is None else found
                    if found:
                        break
                columns[name].append(value)
        return pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in columns.values()], list(columns))

    # A deterministic function would be run again by every filter on a field that is pushed down.
    return read.asNondeterministic()(page)


def decode_entities(c: Column) -> Column:
    """Replace numeric and named character references, each once."""
    named = F.from_json(
        F.lit(json.dumps({f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";")})), "map<string,string>"
    )

    def one(piece: Column) -> Column:
        hexadecimal = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]{1,6});$", 1)
        decimal = F.regexp_extract(piece, r"^&#0*([0-9]{1,7});$", 1)
        point = F.when(hexadecimal != "", F.upper(hexadecimal)).when(decimal != "", F.hex(decimal.cast("long")))
        number = F.conv(point, 16, 10).cast("long")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32")
        result = F.when(~piece.startswith("&"), piece)
        for entity, value in COMMON_ENTITIES.items():
            result = result.when(piece == entity, F.lit(value))
        return result.when(valid, char).otherwise(F.coalesce(F.try_element_at(named, piece), piece))

    pieces = F.regexp_extract_all(c, F.lit(r"&#?[a-zA-Z0-9]+;|[^&]++|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)
