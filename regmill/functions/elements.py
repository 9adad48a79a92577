"""Elements of a page by their id: tags are matched with a stack, so that nested elements of any name are found whole.

A page is cut into tokens (tags, text, comments with scripts and styles). One pass over the tags keeps the open elements; an end
tag closes the last open element of its name and all inside it, unless a part of a table or a division is open in between
that outranks it. Cells, rows, items, options, terms and paragraphs end where the next of their kind, or what cannot stand
in them, begins. Attributes may stand in any order, in any case, in either quotes or none. What is left open ends with the page.
The pass is a small Python helper over Arrow batches: as an aggregate over an array it took most of the time of a page.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse_ws, decode_entities

#: All quantifiers over groups are possessive, so that long pages are not gone over again.
TOKEN = (
    r"[^<]++|<!--.*?(?:-->|\Z)|<script(?u:\b)[^>]*+>.*?(?:</script\s*+>|\Z)|<style(?u:\b)[^>]*+>.*?(?:</style\s*+>|\Z)|<[!?][^>]*+>?+"
    r"""|</?[a-z][^\s/>"']*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-z][^>]*+>?+|<"""
)
#: Tags that a task remembers, as pages of a kind repeat them, and the longest of them.
TAGS, LONGEST = 1 << 14, 256
_TAG = "</?[a-z]"
_SILENT = r"<(?:!|\?|(?:script|style)(?u:\b))"
_NAME = r"""</?([^\s/>"']+)"""
#: The value of the attribute called id, behind others.
_ID = r"""<[^\s/>]++(?:[\s/]++(?!id[\s=])[^\s=>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+))?+)*+[\s/]++id\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)"""

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: What an end tag must outrank, or equal, to close over it; all others have 0.
_RANKS = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "body": 6, "html": 7}
#: Opening the first ends an open second at the top.
_BLOCKS = ("p", "div", "table", "ul", "ol", "dl", "tr", "td", "th", "li", "h1", "h2", "h3", "h4", "h5", "h6", "form", "hr", "pre")
_ENDS = [(("td", "th"), ("td", "th")), (("tr",), ("td", "th", "tr")), (("li",), ("li",)), (("option",), ("option",)), (("dt", "dd"), ("dt", "dd")), (_BLOCKS, ("p",))]
_ENDED = frozenset((opened, top) for first, second in _ENDS for opened in first for top in second)

_FOUND = "array<struct<first:int,last:int,id:string,inner:string>>"
_FOUND_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("id", pa.string()), ("inner", pa.string())]))


def elements(html: Column | str, wanted: str) -> Column:
    """The elements of a page whose id matches a pattern, in the order in which they begin: first, last (tokens), id, inner.

    `inner` is what stands inside: text with its entities, and `<>` for each tag, comment, script and style.
    """
    token, tag, silent, named, ident = (re.compile(p, re.A | re.I | re.S) for p in (TOKEN, _TAG, _SILENT, _NAME, _ID))
    asked, void, ranks, ended = re.compile(wanted, re.S).fullmatch, frozenset(VOID), _RANKS, _ENDED

    known: dict[str, tuple | None] = {}

    def judged(t: str) -> tuple | None:
        """Of a tag its name, whether it ends an element or is one without contents, and its id if that is asked for; none for others."""
        if t in known:
            return known[t]
        found = None
        if tag.match(t) and not silent.match(t):
            name, end = named.match(t)[1].lower(), t[1] == "/"
            at = None if end else ident.match(t)
            value = at and (at[1][1:-1] if at[1][0] in "\"'" else at[1])
            found = name, end, name in void or t.endswith("/>"), value if value and asked(value) else None
        if len(t) <= LONGEST:
            if len(known) >= TAGS:
                known.clear()
            known[t] = found
        return found

    def gone_by_end(name: str, stack: list, held: dict) -> int:
        """How many open elements an end tag closes."""
        if not held.get(name):
            return 0
        rank, outranked = ranks.get(name, 0), False
        for back, (other, _, _) in enumerate(reversed(stack), 1):
            if other == name:
                return 0 if outranked else back
            outranked = outranked or ranks.get(other, 0) > rank

    def gone_by_begin(name: str, stack: list) -> int:
        """How many open elements a begin tag ends: none, the top or the top two."""
        if not stack or (name, stack[-1][0]) not in ended:
            return 0
        return 2 if len(stack) > 1 and (name, stack[-2][0]) in ended else 1

    def spans(tokens: list[str]) -> tuple[list, list]:
        stack, held, done, parts = [], {}, [], []
        for at, t in enumerate(tokens):
            if t[0] != "<":
                parts.append(t)
                continue
            parts.append("&lt;" if t == "<" else "<>")
            if not (found := judged(t)):
                continue
            name, end, single, value = found
            if end and stack and stack[-1][0] == name:
                gone = 1
            else:
                gone = gone_by_end(name, stack, held) if end else gone_by_begin(name, stack)
            if gone:
                for other, i, first in stack[len(stack) - gone :]:
                    held[other] -= 1
                    if i:
                        done.append((first, at, i))
                del stack[len(stack) - gone :]
            if end:
                continue
            if single:
                if value:
                    done.append((at, at, value))
            else:
                stack.append((name, value, at))
                held[name] = held.get(name, 0) + 1
        return sorted(done + [(first, len(tokens), i) for _, i, first in stack if i]), parts

    def of_batch(pages: list[bytes | None]) -> pa.Array:
        ends, first, last, idents, inner = [0], [], [], [], []
        for page in pages:
            found, parts = spans(token.findall(page.decode("utf-8", "replace"))) if page is not None else ((), ())
            for a, b, i in found:
                first.append(a)
                last.append(b)
                idents.append(i)
                inner.append("".join(parts[a + 1 : b]))
            ends.append(len(first))
        rows = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(idents, pa.string()), pa.array(inner, pa.string())], fields=list(_FOUND_ARROW.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=_FOUND_ARROW, mask=pa.array([p is None for p in pages], pa.bool_()))

    @F.arrow_udf(_FOUND)
    def of_pages(pages: pa.Array) -> pa.Array:
        return of_batch(pages.to_pylist())

    return of_pages(col(html).cast("binary"))


def first_of(found: Column, name: str) -> Column:
    """The first element with an id, or null."""
    return F.get(F.filter(found, lambda e: e["id"] == name), F.lit(0))


def inside(found: Column, outer: Column) -> Column:
    """The elements inside another; none if that is null."""
    return F.filter(found, lambda e: F.coalesce((e["first"] > outer["first"]) & (e["last"] <= outer["last"]) & (e["first"] < outer["last"]), F.lit(False)))


def text_of(element: Column) -> Column:
    """An element's text, white space collapsed, or null."""
    return collapse_ws(decode_entities(F.replace(element["inner"], F.lit("<>"), F.lit(""))))
