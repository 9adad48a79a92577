"""Company pages: detail records with their lists, and search-result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import labels as L
from ..functions.text import blank_to_null, col, collapse_ws, page_sha256, quoted, split_person_name, tolerant_date
from ..sources.schemas import ADDRESS

#: The closed sets, and the error texts that go to the log.
CORPORATION_TYPES = ("Company", "Condominium", "Co-operative")
CATEGORIES = ("Local", "Extra-Provincial")
NOT_DETAILS = "page is not a CompanyDetails.aspx (no lblCompanyName)"
NO_NUMBER = "lblCompanyNumber is empty"
NO_NAME = "lblCompanyName is empty"
BAD_TYPE = "unknown CorporationType: "

#: Column -> label of the pages.
SIMPLE_FIELDS = {
    "status": "lblStatus",
    "business_type": "lblBusinessType",
    "incorporation_jurisdiction": "lblIncorporationJurisdiction",
    "filing_type": "lblFilingType",
    "min_max_directors": "lblMinMaxDirectors",
    "additional_info": "lblAddInfo",
}
DATES = {"incorporation_date": "lblIncorporationDate", "registration_date": "lblRegistrationDate", "last_annual_return": "lblLastAnnualReturn"}
ADDRESS_LABELS = dict(zip(ADDRESS, ("Contact", "Address1", "Address2", "Address3", "City", "ProvinceState", "Country", "PostalZipCode"), strict=True))

DIRECTORS, PREVIOUS_NAMES, REMARKS, RESULTS = "pnlCurrentDirectors", "pnlPreviousCompanyNames", "tblHistoricalRemarks", "tableSearchResults"


def page_key(html: Column | str) -> Column:
    """The company number of a page that may otherwise be broken."""
    return blank_to_null(collapse_ws(F.regexp_extract(col(html), r'(?i)<span\s+id="lblCompanyNumber"[^>]*>([^<]*)</span>', 1)))


def pages_of(pages: DataFrame, number: str) -> DataFrame:
    """The pages that say they are a company's: one short match a page, before any label is extracted."""
    return pages.where(page_key("html") == number)


def address_struct(labels: Column | str, prefix: str) -> Column:
    return F.struct(*[L.label_text(labels, f"lbl{prefix}{x}").alias(c) for c, x in ADDRESS_LABELS.items()])


def address_is_empty(address: Column | str) -> Column:
    return F.coalesce(*[col(address)[c] for c in ADDRESS]).isNull()


def parse_error(labels: Column | str) -> Column:
    """Why a page yields no record, the first reason that holds; null for a good page."""
    m = col(labels)
    kind = F.coalesce(m["lblCorporationType"], F.lit(""))
    return (
        F.when(~L.has_label(m, "lblCompanyName") | ~L.has_label(m, "lblCompanyNumber"), NOT_DETAILS)
        .when(m["lblCompanyNumber"] == "", NO_NUMBER)
        .when(m["lblCompanyName"] == "", NO_NAME)
        .when(~kind.isin(*CORPORATION_TYPES), F.concat(F.lit(BAD_TYPE), quoted(kind)))
    )


def _seq(items: Column, make) -> Column:
    return F.transform(items, lambda x, i: F.struct((i + 1).cast("int").alias("seq"), *make(x)))


def directors(html: Column | str) -> Column:
    """seq, full, first and last name of the current directors."""
    rows = F.filter(L.leaf_rows(html, DIRECTORS), lambda r: F.size(F.split(r, r"(?i)<td\b")) == 2)
    names = F.transform(rows, lambda r: F.get(L.cells(r), F.lit(0)))
    chrome = lambda n: (n == "") | n.rlike("(?i)records found|viewing records|director name")

    def fields(n: Column) -> list[Column]:
        first, last = split_person_name(n)
        return [n.alias("full_name"), first.alias("first_name"), last.alias("last_name")]

    return _seq(F.filter(names, lambda n: ~chrome(n)), fields)


def previous_names(html: Column | str) -> Column:
    """seq, name and date of earlier names; header and count rows are dropped."""
    rows = F.transform(L.leaf_rows(html, PREVIOUS_NAMES), L.cells)
    named = F.filter(rows, lambda c: ~F.coalesce(F.get(c, F.lit(0)), F.lit("")).rlike("(?i)^$|^previous|^records found"))
    return _seq(named, lambda c: [F.get(c, F.lit(0)).alias("name"), tolerant_date(F.get(c, F.lit(1))).alias("effective_date")])


def remarks(html: Column | str, include_panel_text: bool = False) -> Column:
    """seq and text of historical remarks; with the panel's whole text first, if asked for."""
    texts = F.transform(L.leaf_rows(html, REMARKS), L.row_text)
    kept = F.filter(texts, lambda t: (t != "") & (F.lower(t) != "historical remarks"))
    if include_panel_text:
        whole = F.array_join(kept, " ")
        kept = F.when(F.size(kept) > 0, F.concat(F.array(whole), kept)).otherwise(kept)
    return _seq(kept, lambda t: [t.alias("remark")])


def parse_companies(pages: DataFrame, include_panel_text: bool = False) -> DataFrame:
    """pages (key, html, ...) with `company` (a struct, null on error) and `parse_error`. Labels are extracted once a page."""
    labelled = L.once(pages, "labels", L.label_map("html"))
    m = F.col("labels")
    text = lambda c: L.label_text(m, c)
    category = text("lblCategory")
    record = F.struct(
        text("lblCompanyNumber").alias("number"), text("lblCompanyName").alias("name"), text("lblCorporationType").alias("corporation_type"),
        F.when(category.isin(*CATEGORIES), category).alias("category"),
        *[text(x).alias(c) for c, x in SIMPLE_FIELDS.items()],
        *[tolerant_date(m[x]).alias(c) for c, x in DATES.items()],
        address_struct(m, "RO").alias("registered_office"), address_struct(m, "MA").alias("mailing_address"),
        (F.coalesce(m["lblMASameAsRegistered"], F.lit("")) != "").alias("ma_same_as_registered"),
        F.when(F.col("html").contains(DIRECTORS), directors("html")).alias("directors"),
        F.when(F.col("html").contains(PREVIOUS_NAMES), previous_names("html")).alias("previous_names"),
        F.when(F.col("html").contains(REMARKS), remarks("html", include_panel_text)).alias("remarks"),
    )
    judged = labelled.withColumn("parse_error", parse_error("labels"))
    return judged.withColumn("company", F.when(F.col("parse_error").isNull(), record)).drop("labels")


def company_rows(parsed: DataFrame, *more: str) -> DataFrame:
    """The flat parent rows of the good pages, with more columns of theirs."""
    c = F.col("company")
    plain = ["number", "name", "corporation_type", "category", *SIMPLE_FIELDS, *DATES, "ma_same_as_registered"]
    addresses = [c[s][a].alias(f"{p}_{a}") for s, p in (("registered_office", "ro"), ("mailing_address", "ma")) for a in ADDRESS]
    return parsed.where("parse_error IS NULL").select(*[c[x].alias(x) for x in plain], *addresses, page_sha256("html").alias("source_html_sha256"), *more)


#: Child table -> list of the record.
CHILD_LISTS = {"company_directors": "directors", "company_previous_names": "previous_names", "company_historical_remarks": "remarks"}


def child_rows(parsed: DataFrame, table: str) -> DataFrame:
    """The rows of one child table."""
    good = parsed.where("parse_error IS NULL").select(F.col("company.number").alias("company_number"), F.col("company")[CHILD_LISTS[table]].alias("listed"))
    items = L.once(good, "items", F.col("listed")).select("company_number", F.explode("items").alias("x"))
    return items.select("company_number", "x.*")


def _results(html: Column | str) -> Column:
    return L.section(html, RESULTS)


def search_totals(html: Column | str) -> Column:
    """total and viewing of a result page; 0 and 0-0 without a result table."""

    def measured(table: Column) -> Column:
        text = lambda name: E.text_of(E.first_of(table, name))
        return F.struct(F.coalesce(text("lblRecordsFound").try_cast("int"), F.lit(0)).alias("total"), F.coalesce(blank_to_null(text("lblViewingRecords")), F.lit("0-0")).alias("viewing"))

    # the same ids stand in other tables too
    within = lambda found: L.bind(E.inside(found, E.first_of(found, RESULTS)), measured)
    return L.bind(E.elements(html, f"{RESULTS}|lblRecordsFound|lblViewingRecords"), within)


def search_hits(html: Column | str) -> Column:
    """The hits of a result page: five cells at least, and a valid company number."""
    ident = r"rptCompanyNameSearchResults__ctl\d+_lbtCompanyNumber"
    anchor = r"""(?i)id\s*=\s*["']?rptCompanyNameSearchResults__ctl(\d+)_lbtCompanyNumber\b"""
    rows = F.filter(L.rows_of(_results(html)), lambda r: r.rlike(anchor))

    def hit(r: Column, cells: Column) -> Column:
        cell = lambda i: blank_to_null(F.get(cells, F.lit(i)))
        return F.struct(
            F.regexp_extract(r, anchor, 1).try_cast("int").alias("row_index"), blank_to_null(L.anchor_text(r, ident)).alias("name"), cell(1).alias("status"), cell(2).alias("number"),
            cell(3).alias("corporation_type"), cell(4).alias("date_text"), F.size(cells).alias("n"),
        )

    found = F.filter(F.transform(rows, lambda r: L.bind(L.cells(r), lambda c: hit(r, c))), lambda h: (h["n"] >= 5) & F.coalesce(h["number"].rlike("^[0-9]+[A-Z]*$"), F.lit(False)))
    return F.transform(found, lambda h: h.dropFields("n"))


def classify_page(url: Column | str, html: Column | str) -> Column:
    """details, hits or empty."""
    return F.when(col(url).contains("CompanyDetails.aspx"), "details").when(F.size(F.coalesce(search_hits(html), F.array())) > 0, "hits").otherwise("empty")


def explode_search_hits(pages: DataFrame) -> DataFrame:
    """One row for each hit: the page's key and the hit's fields."""
    return L.once(pages, "hits", search_hits("html")).select("key", F.explode("hits").alias("h")).select("key", "h.*")
