"""Labels and table rows of a page, cut out by regular expressions that cannot recurse deeply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elements import elements
from .text import bind, blank_to_null, col, collapse_ws, decode_entities

#: A span whose first attribute is a quoted label id and whose body is text and line breaks only. Possessive, so long bodies need no stack.
LABEL = r'(?i)<span\s+id="lbl[A-Za-z0-9]+"[^>]*>[^<]*+(?:<br\s*/?>[^<]*+)*+</span>'


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, whatever later steps do with it.

    It comes from a generator of one row: filters and projections above are not merged into it, as they are into a
    projection, where every mention of the column would compute it again.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _last_wins(entries: Column) -> Column:
    """A map of (key, value) structs; of equal keys the last counts."""

    def merged(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        repeated = F.size(F.array_distinct(keys)) < F.size(keys)
        last = lambda back: F.filter(es, lambda e, i: i == F.size(back) - F.array_position(back, e["key"]).cast("int"))
        return F.map_from_entries(F.when(repeated, bind(F.reverse(keys), last)).otherwise(es))

    return bind(entries, merged)


def label_map(html: Column | str) -> Column:
    """Label id -> text: breaks are blanks, white space collapsed, empty values kept, entities left as they are."""
    body = lambda m: collapse_ws(F.regexp_replace(F.regexp_extract(m, r"(?is)^<[^>]*>(.*)</span>$", 1), r"(?i)<br\s*/?>", " "))
    entry = lambda m: F.struct(F.regexp_extract(m, r'"([^"]*)"', 1).alias("key"), body(m).alias("value"))
    return _last_wins(F.transform(F.regexp_extract_all(col(html), F.lit(LABEL), F.lit(0)), entry))


#: White space other than a line feed.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}&&[^\n]]"
_ALL_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
#: What the text of an element may change by: tags, entities, white space other than single blanks inside.
_ROUGH = r"[<\x26\s\x1c-\x1f\x85\p{Z}&&[^ ]]|  |^ | $"


def lines_of(fragment: Column) -> Column:
    """The text of an element, one line for each text node; inside a line only blanks and tabs are collapsed, and blank lines inside stay."""
    return F.when(fragment.rlike(_ROUGH), _smooth(fragment)).otherwise(fragment)


def _smooth(fragment: Column) -> Column:
    nodes = decode_entities(F.regexp_replace(fragment, r"(?s)(?:<[^>]*+>)++", "\n"))
    broken = F.regexp_replace(nodes, r"\r\n|[\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", "\n")
    lines = F.regexp_replace(F.regexp_replace(broken, r"[ \t]+", " "), rf"{_BLANK}*\n{_BLANK}*", "\n")
    return F.regexp_replace(lines, rf"^{_ALL_BLANK}+|{_ALL_BLANK}+$", "")


def lobbyist_label_map(html: Column | str) -> Column:
    """Label id -> text of any element, nested ones too: entities decoded, one line for each text node, blank values left out."""
    found = F.transform(elements(html, "lbl.*"), lambda e: F.struct(e["id"].alias("key"), lines_of(e["inner"]).alias("value")))
    return _last_wins(F.filter(found, lambda e: e["value"] != ""))


def label_text(labels: Column | str, name: str) -> Column:
    """A label's text, null if blank or absent."""
    return blank_to_null(col(labels)[name])


def has_label(labels: Column | str, name: str) -> Column:
    return F.map_contains_key(col(labels), name)


def section(html: Column | str, element_id: str) -> Column:
    """From an element's id to the next section anchor or the footer, without comments; null if the id is not there."""
    page = col(html)
    at = F.regexp_instr(page, F.lit(rf"""(?i)\bid\s*=\s*["']?{element_id}["'\s>]"""))
    rest = F.substring(page, at, F.length(page))
    cut = F.get(F.split(rest, r"""(?i)<a\s+name=|\bid\s*=\s*["']?gnlfoot\b""", 2), F.lit(0))
    return F.when(page.contains(element_id) & (at > 0), F.regexp_replace(cut, r"(?s)<!--.*?-->", ""))


def rows_of(part: Column) -> Column:
    """The pieces of a section that begin with a table row's attributes."""
    pieces = F.split(part, r"(?i)<tr\b")
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def leaf_rows(html: Column | str, element_id: str) -> Column:
    """Rows of class row or rowalt in a section; the attribute name may be in any case, its value not."""
    return F.filter(rows_of(section(html, element_id)), lambda r: r.rlike(r"""^[^>]*\b(?i:class)\s*=\s*["']?(row|rowalt)["'\s>]"""))


def cells(row: Column) -> Column:
    """The texts of a row's cells."""
    pieces = F.split(row, r"(?i)<td\b")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), plain)


def plain(fragment: Column) -> Column:
    """The text behind the rest of an opening tag, up to the cell's or row's end: tags are blanks."""
    inner = F.regexp_replace(F.get(F.split(fragment, r"(?i)</(?:td|tr)\b", 2), F.lit(0)), r"^[^>]*>", "")
    return collapse_ws(decode_entities(F.regexp_replace(inner, r"(?s)<[^>]*>", " ")))


def row_text(row: Column) -> Column:
    """All text of a row."""
    inner = F.regexp_replace(F.get(F.split(row, r"(?i)</tr\b", 2), F.lit(0)), r"^[^>]*>", "")
    return collapse_ws(decode_entities(F.regexp_replace(inner, r"(?s)<[^>]*>", " ")))


def anchor_text(row: Column, id_pattern: str) -> Column:
    """The text of the first anchor whose id matches."""
    inner = F.regexp_extract(row, rf"""(?is)<a\b[^>]*\bid\s*=\s*["']?{id_pattern}\b[^>]*>(.*?)</a\b""", 1)
    return collapse_ws(decode_entities(F.regexp_replace(inner, r"(?s)<[^>]*>", "")))
