"""Lobbyist pages: registrations, and paged search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import labels as L
from ..functions.text import bind, blank_to_null, col, page_sha256, tolerant_date

#: Fixed value: the error text that goes to the log.
NO_NUMBER = "page is not a lobbySummary.aspx (no lblRegistrationNumber)"

#: Column -> label of the pages.
TEXTS = {
    "contact_name": "lblContactName",
    "contact_line1": "lblContactAddressCI",
    "contact_city": "lblContactCityCI",
    "contact_province_state": "lblContactProvince",
    "contact_postal_zip": "lblContactPostal",
    "firm_name": "lblFirmName",
    "firm_line1": "lblAddressF",
    "firm_city": "lblCityF",
    "firm_province_state": "lblProvinceStateF",
    "firm_postal_zip": "lblPostalZipCodeF",
    "particulars": "lblParticulars",
    "organization_description": "lblOrgDesc",
    "organization_membership": "lblOrgMembership",
}
DATES = {"registration_date": "lblRegistrationDate", "effective_date": "lblEffectiveDate", "amended_date": "lblAmendedDate", "approval_date": "lblApprovalDate"}


def lobbyist_type(labels: Column | str) -> Column:
    """The label, or what the registration number's prefix says."""
    m = col(labels)
    prefix = F.upper(F.get(F.split(m["lblRegistrationNumber"], "-", 2), F.lit(0)))
    return F.coalesce(m["lblLobbyistType"], F.when(prefix == "CL", "Consultant").when(prefix == "IHL", "In-House"))


def parse_lobbyists(pages: DataFrame) -> DataFrame:
    """pages (key, html, ...) with `lobbyist` (a struct, null on error) and `parse_error`."""
    labelled = L.once(pages, "labels", L.lobbyist_label_map("html"))
    m = F.col("labels")
    record = F.struct(
        m["lblRegistrationNumber"].alias("registration_number"), lobbyist_type(m).alias("lobbyist_type"), F.coalesce(m["lblstatus"], m["lblStatus"]).alias("status"),
        *[tolerant_date(m[x]).alias(c) for c, x in DATES.items()], *[m[x].alias(c) for c, x in TEXTS.items()], m.alias("raw_fields"),
    )
    judged = labelled.withColumn("parse_error", F.when(m["lblRegistrationNumber"].isNull(), NO_NUMBER))
    return judged.withColumn("lobbyist", F.when(F.col("parse_error").isNull(), record)).drop("labels")


def lobbyist_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("parse_error IS NULL").select("lobbyist.*", page_sha256("html").alias("source_html_sha256"))


def raw_fields_json(fields: Column | str) -> Column:
    """The label map as JSON; letters outside ASCII stay as they are."""
    return F.to_json(col(fields))


ANCHOR = r"""(?i)id\s*=\s*["']?rptSearchResults__ctl(\d+)_lbtRegNum\b"""
ANCHOR_ID = r"rptSearchResults__ctl\d+_lbtRegNum"


def search_hits(html: Column | str) -> Column:
    """The hits of a result page: seven cells at least."""
    rows = F.filter(L.rows_of(col(html)), lambda r: r.rlike(ANCHOR))

    def hit(r: Column, cells: Column) -> Column:
        cell = lambda i: blank_to_null(F.get(cells, F.lit(i)))
        names = ("registration_number", "name", "lobbyist_type", "client", "organization", "activity_date_text", "status")
        texts = [blank_to_null(L.anchor_text(r, ANCHOR_ID)), *[cell(i) for i in range(1, len(names))]]
        return F.struct(F.regexp_extract(r, ANCHOR, 1).try_cast("int").alias("row_index"), *[t.alias(n) for t, n in zip(texts, names, strict=True)], F.size(cells).alias("n"))

    return F.transform(F.filter(F.transform(rows, lambda r: L.bind(L.cells(r), lambda c: hit(r, c))), lambda h: h["n"] >= 7), lambda h: h.dropFields("n"))


def explode_hits(pages: DataFrame) -> DataFrame:
    return L.once(pages, "hits", search_hits("html")).select("key", F.explode("hits").alias("h")).select("key", "h.*")


def hit_row_indices(html: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(html), F.lit(ANCHOR), F.lit(1)), lambda x: x.try_cast("int"))


#: The ids of the counts on a result page.
TOTAL, VIEWING = "lblRecordsFound", "lblViewingRecords"


def page_marks(html: Column | str) -> Column:
    """total, first, last (of the records shown; null unless both are given) and more of a result page, from one pass over its elements.

    Use it behind `labels.once` where several of them are asked for.
    """

    def of(total: Column, shown: Column) -> Column:
        part = lambda i: F.when(shown.rlike(r"^\d+-\d+$"), F.regexp_extract(shown, r"^(\d+)-(\d+)$", i).try_cast("int"))
        number = total.try_cast("int")
        return F.struct(number.alias("total"), part(1).alias("first"), part(2).alias("last"), F.coalesce(part(2) < number, F.lit(False)).alias("more"))

    texts = lambda found: bind(E.text_of(E.first_of(found, TOTAL)), lambda t: bind(E.text_of(E.first_of(found, VIEWING)), lambda v: of(t, v)))
    return bind(E.elements(html, f"{TOTAL}|{VIEWING}"), texts)


def total_records(html: Column | str) -> Column:
    return page_marks(html)["total"]


def viewing_range(html: Column | str) -> Column:
    """first and last of the records shown, null unless both are given."""
    return bind(page_marks(html), lambda m: F.when(m["first"].isNotNull() & m["last"].isNotNull(), F.struct(m["first"], m["last"])))


def has_next_page(html: Column | str) -> Column:
    return page_marks(html)["more"]
