"""Text, date, key and display expressions. Blank strings stand for null throughout."""

from __future__ import annotations

import json
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense; Java's \s knows the ASCII blanks only.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column | str, use) -> Column:
    """use(value), with the value computed once: expressions inside a lambda are evaluated anew at every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse_ws(c: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACES, " "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def tolerant_date(c: Column | str) -> Column:
    """yyyy-M-d with a four-digit year and nothing around it; all else is null."""
    text = col(c)
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def shard_key(key: Column | str) -> Column:
    """The first two characters, upper-cased, filled up with zeros."""
    return F.rpad(F.substring(F.upper(col(key)), 1, 2), 2, "0")


def safe_key(key: Column | str) -> Column:
    """Characters other than letters, digits, dot, underscore and hyphen become underscores."""
    return F.regexp_replace(col(key), r"[^\p{L}\p{N}._-]", "_")


def page_path(registry: Column | str, kind: Column | str, key: Column | str) -> Column:
    """Where a landed page belongs: registry, shard, list folder for list pages, and file name."""
    name = safe_key(key)
    listed = col(kind) == "list"
    return F.concat_ws("/", col(registry), shard_key(name), F.when(listed, F.lit("_list")), F.concat(name, F.when(listed, ".list").otherwise(""), F.lit(".html.gz")))


def page_sha256(html: Column | str) -> Column:
    return F.sha2(col(html), 256)


def split_person_name(full: Column | str) -> tuple[Column, Column]:
    """First token, and the rest (null for a single token)."""
    parts = F.split(col(full), " ", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def quoted(c: Column | str) -> Column:
    """A string in quotes: single ones, unless it holds those and no double ones."""
    text = F.replace(col(c), F.lit("\\"), F.lit("\\\\"))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))


def human_bytes(n: Column | str) -> Column:
    """B, KB, MB, GB or TB by 1024, one decimal; halves go to the even digit."""
    size, out = col(n).cast("double"), None
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.format_string(f"%.1f{unit}", F.bround(size / 1024.0**power, 1))
        small = size < 1024.0 ** (power + 1)
        out = F.when(small, text) if out is None else out.otherwise(text) if unit == "TB" else out.when(small, text)
    return out


def location_label(city: Column | str, province: Column | str) -> Column:
    """City, and the province behind a comma; either may be missing."""
    return F.concat(F.coalesce(col(city), F.lit("")), F.coalesce(F.concat(F.lit(", "), F.trim(blank_to_null(province))), F.lit("")))


def address_block(address: Column | str) -> Column:
    """An address struct on lines: empty ones are left out, city and province share one."""
    a = col(address)
    part = lambda f: blank_to_null(a[f])
    town = blank_to_null(F.concat_ws(", ", part("city"), part("province_state")))
    return F.concat_ws("\n", *[part(f) for f in ("contact", "line1", "line2", "line3")], town, part("country"), part("postal_zip"))


def result_message(total: Column | str, limit: int, advice: str = "Refine your query.") -> Column:
    n = col(total)
    many = F.concat(F.lit(f"Showing first {limit} of "), n.cast("string"), F.lit(f" matches. {advice}"))
    few = F.concat(F.lit("Showing all "), n.cast("string"), F.when(n == 1, " match.").otherwise(" matches."))
    return F.when(n == 0, "No matches.").when(n <= limit, few).otherwise(many)


def display_title(contact: Column | str, firm: Column | str, number: Column | str) -> Column:
    return F.coalesce(blank_to_null(contact), blank_to_null(firm), col(number))


def contains_ignoring_case(c: Column | str, query: str) -> Column:
    """ILIKE '%query%': % and _ in the query are wildcards, a backslash is an ordinary character."""
    return F.ilike(col(c), F.lit("%" + query.replace("\\", "\\\\") + "%"))


def _by_initial(names: dict[str, str]) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for name, char in names.items():
        out.setdefault(name[0], {})[name] = char
    return out


#: Named entities with their semicolon, from the standard library's table, and those that need none, by first letter.
_NAMED = _by_initial({k: v for k, v in entities.html5.items() if k.endswith(";")})
_BARE = _by_initial({k: v for k, v in entities.html5.items() if not k.endswith(";")})
_BARE_NAMES = "|".join(sorted((k for k in entities.html5 if not k.endswith(";")), key=len, reverse=True))
#: Numbers that stand for the characters of an old code page.
_CODE_PAGE = _by_initial({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)})


def _found(table: dict[str, dict[str, str]], name: Column) -> Column:
    """The name's value in a table that the plan holds as one constant, or null."""
    some = F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,map<string,string>>"), F.substring(name, 1, 1))
    return F.try_element_at(some, name)


def _character(number: Column) -> Column:
    """The character of a code point: none for control and non-characters, the replacement character where there is no such point."""

    def of(point: Column) -> Column:
        wrong = point.isNull() | (point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
        silent = point.between(1, 8) | (point == 11) | point.between(14, 31) | (point == 127) | point.between(0xFDD0, 0xFDEF) | (F.pmod(point, F.lit(0x10000)) >= 0xFFFE)
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        old = F.when(point.between(0x80, 0x9F), _found(_CODE_PAGE, point.cast("string")))
        return F.when(wrong, "\ufffd").otherwise(F.coalesce(old, F.when(silent, "").otherwise(char)))

    return bind(number.try_cast("long"), of)


def _after_ampersand(piece: Column) -> Column:
    """A piece of text behind an ampersand, with the entity that it begins with decoded."""
    digits = F.regexp_extract(piece, "^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", 0)

    def numeric(d: Column) -> Column:
        number = F.rtrim(F.substring(d, F.lit(2), F.length(d)), F.lit(";"))
        hexadecimal = F.ltrim(F.lower(number), F.lit("x0"))
        point = F.when(F.lower(number).startswith("x"), F.when(hexadecimal == "", "0").when(F.length(hexadecimal) <= 8, F.conv(hexadecimal, 16, 10))).otherwise(number)
        return F.when(d != "", F.concat(_character(point), F.substring(piece, F.length(d) + 1, F.length(piece))))

    def after(name: Column, table: dict[str, dict[str, str]]) -> Column:
        return bind(name, lambda n: F.concat(_found(table, n), F.substring(piece, F.length(n) + 1, F.length(piece))))

    named = after(F.regexp_extract(piece, "^[A-Za-z0-9]+;", 0), _NAMED)
    bare = after(F.regexp_extract(piece, f"^(?:{_BARE_NAMES})", 0), _BARE)
    return F.coalesce(F.when(piece.startswith("#"), bind(digits, numeric)), named, bare, F.concat(F.lit("&"), piece))


def decode_entities(c: Column | str) -> Column:
    """Named, decimal and hexadecimal entities as characters, each decoded once, in the JVM."""

    def joined(pieces: Column) -> Column:
        later = F.transform(F.slice(pieces, 2, F.size(pieces) - 1), _after_ampersand)
        return F.when(F.size(pieces) > 1, F.concat(F.get(pieces, F.lit(0)), F.array_join(later, ""))).otherwise(F.get(pieces, F.lit(0)))

    return bind(c, lambda t: F.when(t.contains("&"), bind(F.split(t, "&"), joined)).otherwise(t))
