"""The registered queries, and the SQL over the given tables that must return the same rows.

Pages are rendered from the tables and parsed again; the SQL reads the tables and never sees a page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text
from ..operators import company, lobbyist, planning, search, upsert
from ..sources import files, pages, schemas, storage
from ..streaming.incremental import incremental_ingest, incremental_ingest_table
from ..streaming.manifest import ingest_changes
from ..streaming.outcomes import count_outcomes, outcomes_so_far
from . import render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query with its SQL; dates are reported as ISO text by both."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in dates})

        name = f.__name__.rstrip("_")  # where the operator itself has the name
        QUERIES[name] = run if dates else f
        if sql:
            as_text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLES[name] = f"SELECT * REPLACE ({as_text}) FROM ({sql})" if dates else sql
        return f

    return register


#: What the rendered company pages say, from the tables.
COMPANIES = r"""
WITH first_order AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS d FROM orders GROUP BY 1),
page AS (
  SELECT c_custkey AS k, c_custkey || CASE WHEN c_custkey % 50 = 0 THEN 'D' ELSE '' END AS key, c_nationkey, c_acctbal, c_mktsegment, n_name, r_name, d, c_name,
    CASE WHEN c_custkey % 83 = 0 THEN 'Trust' WHEN c_custkey % 10 = 0 THEN 'Condominium' WHEN c_custkey % 10 = 1 THEN 'Co-operative' ELSE 'Company' END AS kind,
    CASE WHEN c_custkey % 103 = 0 THEN 'page is not a CompanyDetails.aspx (no lblCompanyName)' WHEN c_custkey % 101 = 0 THEN 'lblCompanyNumber is empty'
      WHEN c_custkey % 97 = 0 THEN 'lblCompanyName is empty' WHEN c_custkey % 83 = 0 THEN 'unknown CorporationType: ''Trust''' END AS err
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN first_order ON o_custkey = c_custkey
), co AS (
  SELECT k, key AS number, CASE WHEN k % 7 = 0 THEN 'STUDIO "C" & ' ELSE '' END || c_name AS name, kind AS corporation_type,
    CASE WHEN k % 89 = 0 THEN NULL WHEN c_nationkey < 5 THEN 'Extra-Provincial' ELSE 'Local' END AS category,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Active' WHEN 'AUTOMOBILE' THEN 'Dissolved - Voluntary' WHEN 'MACHINERY' THEN 'Cancelled' WHEN 'HOUSEHOLD' THEN 'Discontinued'
      ELSE 'Dissolved (Prior To June 2004)' END AS status,
    CASE WHEN k % 43 = 0 THEN NULL ELSE d END AS incorporation_date, d + 30 AS registration_date, CASE WHEN k % 3 = 0 THEN d + 365 END AS last_annual_return,
    r_name || ' / ' || n_name AS incorporation_jurisdiction, '1 - ' || (k % 9 + 1) AS min_max_directors,
    'c/o ' || c_mktsegment AS ro_contact, CASE WHEN k % 4 <> 0 THEN 'Floor ' || (k % 7) END AS ro_line2, CAST(NULL AS VARCHAR) AS ro_line3, 'Canada' AS ro_country, 'A1A ' || (k % 10) AS ro_postal_zip,
    CASE WHEN c_acctbal >= 0 THEN 'B2B' END AS ma_postal_zip, 'With ' || c_mktsegment AS business_type, c_mktsegment AS additional_info,
    'Unit ' || k || ' Main Street' AS ro_line1, n_name AS ro_city, r_name AS ro_province_state,
    CASE WHEN c_acctbal >= 0 THEN n_name END AS ma_city, c_acctbal < 0 AS ma_same_as_registered, c_nationkey
  FROM page WHERE err IS NULL
)"""

DIRECTORS = (
    COMPANIES
    + r""", dirs AS (
  SELECT number AS company_number, CAST(row_number() OVER (PARTITION BY k ORDER BY s_suppkey) AS INT) AS seq, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' ' || n_name ELSE '' END AS full_name
  FROM co JOIN supplier ON floor(sqrt(s_suppkey)) = k JOIN nation ON n_nationkey = co.c_nationkey
)"""
)
NAMES = (
    COMPANIES
    + r""", names AS (
  SELECT number AS company_number, CAST(1 AS INT) AS seq, p_name AS name, DATE '2001-02-03' AS effective_date FROM co JOIN part ON p_partkey = k WHERE k % 13 = 0
  UNION ALL SELECT number, CAST(2 AS INT), p_name || ' & Söns', NULL FROM co JOIN part ON p_partkey = k + 1 WHERE k % 13 = 0
)"""
)
REMARKS = (
    COMPANIES
    + r""", rem AS (
  SELECT number AS company_number, CAST(1 AS INT) AS seq, 'Remark "' || k || '" on file' AS remark FROM co WHERE k % 11 = 0
  UNION ALL SELECT number, CAST(2 AS INT), 'Filed & closed © — café' FROM co WHERE k % 11 = 0
)"""
)
LOBBYISTS = r"""
WITH lob AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'XX' WHEN o_orderkey % 2 = 0 THEN 'CL' ELSE 'IHL' END || '-' || o_orderkey || '-' || o_custkey AS registration_number,
    CASE WHEN o_orderkey % 19 = 0 THEN 'Consultant Lobbyist' WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'Consultant' ELSE 'In-House' END AS lobbyist_type,
    o_orderstatus AS status, CAST(o_orderdate AS DATE) AS registration_date, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS effective_date,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Contact' || chr(160) || o_custkey END AS contact_name, c_name || chr(10) || '& Co' AS firm_name,
    'Priority:' || chr(10) || o_orderpriority || ' level' || chr(10) || 'mid' || chr(10) || chr(10) || 'café' || chr(10) || chr(10) || chr(10) || '– end' AS organization_description,
    strftime(o_orderdate, '%Y-%m-%d') AS reg_text, CASE WHEN o_orderkey % 23 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%-m-%-d') END AS eff_text
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 103 <> 0
)"""
#: The rows of the rendered search results.
HITS = r"""
WITH hit AS (
  SELECT 'n' || (c_custkey // 10 + 1) AS key, CAST(c_custkey % 10 + 1 AS INT) AS row_index, c_name || ' & Co' AS name, c_mktsegment AS status,
    c_custkey || CASE WHEN c_custkey % 50 = 0 THEN 'D' ELSE '' END AS number, 'Company' AS corporation_type, CASE WHEN c_custkey % 2 = 0 THEN '2004-7-3' END AS date_text, c_custkey AS k
  FROM customer WHERE c_custkey % 29 <> 0 AND c_custkey % 31 <> 0
)"""


def parsed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.parse_companies(render.company_pages(spark, sf_dir))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.company_rows(parsed_companies(spark, sf_dir))


def parsed_lobbyists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lobbyist.parse_lobbyists(render.lobbyist_pages(spark, sf_dir))


def lobbyists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lobbyist.lobbyist_rows(parsed_lobbyists(spark, sf_dir))


_PARSED = (
    "number, name, corporation_type, category, status, incorporation_date, registration_date, last_annual_return, incorporation_jurisdiction, min_max_directors, business_type, additional_info, "
    "ro_contact, ro_line1, ro_line2, ro_line3, ro_city, ro_province_state, ro_country, ro_postal_zip, ma_city, ma_postal_zip, ma_same_as_registered"
)


@query(COMPANIES + f" SELECT {_PARSED}, CAST(NULL AS VARCHAR) AS filing_type, ma_city IS NULL AS ma_empty FROM co", dates=('incorporation_date', 'registration_date', 'last_annual_return'))
def company_parse(spark, sf_dir):
    parsed = parsed_companies(spark, sf_dir).withColumn("ma_empty", company.address_is_empty("company.mailing_address"))
    return company.company_rows(parsed, "ma_empty").select(*_PARSED.split(", "), "filing_type", "ma_empty")


@query(COMPANIES + " SELECT key, err AS parse_error, err IS NULL AS parsed_ok, CASE WHEN k % 103 <> 0 AND k % 101 <> 0 THEN key END AS page_key FROM page")
def company_errors(spark, sf_dir):
    return parsed_companies(spark, sf_dir).select("key", "parse_error", F.col("parse_error").isNull().alias("parsed_ok"), company.page_key("html").alias("page_key"))


@query(
    DIRECTORS
    + " SELECT company_number, seq, full_name, split_part(full_name, ' ', 1) AS first_name, CASE WHEN contains(full_name, ' ') THEN substr(full_name, strpos(full_name, ' ') + 1) END AS last_name FROM dirs"
)
def directors(spark, sf_dir):
    return company.child_rows(parsed_companies(spark, sf_dir), "company_directors")


@query(NAMES + " SELECT * FROM names", dates=('effective_date',))
def previous_names(spark, sf_dir):
    return company.child_rows(parsed_companies(spark, sf_dir), "company_previous_names")


@query(REMARKS + " SELECT * FROM rem")
def remarks(spark, sf_dir):
    return company.child_rows(parsed_companies(spark, sf_dir), "company_historical_remarks")


@query(COMPANIES + " SELECT number, CASE WHEN k % 7 = 0 THEN 'STUDIO' ELSE c.name END AS first_token, CASE WHEN k % 7 = 0 THEN substr(c.name, 8) END AS rest FROM co c")
def split_names(spark, sf_dir):
    first, rest = text.split_person_name("name")
    return companies(spark, sf_dir).select("number", first.alias("first_token"), rest.alias("rest"))


@query(
    COMPANIES
    + """, lob AS (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 103 <> 0)
SELECT count(*) FILTER (corporation_type = 'Company') AS companies, count(*) FILTER (corporation_type = 'Condominium') AS condominiums,
  count(*) FILTER (corporation_type = 'Co-operative') AS co_operatives, (SELECT n FROM lob) AS lobbyists FROM co"""
)
def registry_counts(spark, sf_dir):
    return search.registry_counts(companies(spark, sf_dir), lobbyists(spark, sf_dir))


@query(COMPANIES + " SELECT corporation_type, count(*) AS n FROM co GROUP BY 1")
def count_by_type(spark, sf_dir):
    return search.count_by_type(companies(spark, sf_dir))


@query(
    DIRECTORS
    + NAMES.removeprefix(COMPANIES)
    + """ SELECT 'companies' AS label, count(*) AS n FROM co UNION ALL SELECT 'company_directors', count(*) FROM dirs UNION ALL SELECT 'company_previous_names', count(*) FROM names
UNION ALL SELECT 'lobbyist_registrations', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 103 <> 0
UNION ALL SELECT 'companies/detail', count(*) FROM customer UNION ALL SELECT 'companies/list', (count(*) + 9) // 10 FROM customer"""
)
def table_counts(spark, sf_dir):
    parsed = upsert.kept(parsed_companies(spark, sf_dir), "parsed")
    tables = {"companies": company.company_rows(parsed)} | {t: company.child_rows(parsed, t) for t in ("company_directors", "company_previous_names")}
    details = render.company_pages(spark, sf_dir).select(F.lit("companies").alias("registry"), F.lit("detail").alias("kind"))
    listed = render.company_list_pages(spark, sf_dir).select(F.lit("companies").alias("registry"), F.lit("list").alias("kind"))
    return search.table_counts(tables | {"lobbyist_registrations": lobbyists(spark, sf_dir)}, details.unionByName(listed))


_SHOWN = "number, name, corporation_type, category, status, incorporation_date, ro_city, ro_province_state"


@query(COMPANIES + f" SELECT {_SHOWN} FROM co WHERE name ILIKE '%studio%' OR number = 'studio' ORDER BY name, number LIMIT 50", dates=('incorporation_date',))
def search_companies(spark, sf_dir):
    return search.search_companies(companies(spark, sf_dir), " studio ")


@query(
    COMPANIES
    + """ SELECT count(*) AS total, CASE WHEN count(*) = 0 THEN 'No matches.' WHEN count(*) <= 50 THEN 'Showing all ' || count(*) || CASE WHEN count(*) = 1 THEN ' match.' ELSE ' matches.' END
ELSE 'Showing first 50 of ' || count(*) || ' matches. Refine your query to narrow it.' END AS message FROM co WHERE name ILIKE '%studio%' OR number = 'studio'"""
)
def search_companies_total(spark, sf_dir):
    total = search.match_total(search.company_matches(companies(spark, sf_dir), "studio"))
    return total.select("total", text.result_message("total", 50, "Refine your query to narrow it.").alias("message"))


@query(COMPANIES + f" SELECT {_SHOWN} FROM co WHERE name ILIKE '%100D%' OR number = '100D' ORDER BY name, number LIMIT 50", dates=('incorporation_date',))
def search_by_number(spark, sf_dir):
    return search.search_companies(companies(spark, sf_dir), "100D")


@query(
    COMPANIES
    + f" SELECT {_SHOWN} FROM co WHERE name ILIKE '%#_____1%5' AND (name ILIKE '%#_____1%5%' OR number = 'x') AND corporation_type = 'Company' AND status = 'Active' ORDER BY name, number LIMIT 500", dates=('incorporation_date',))
def search_filters(spark, sf_dir):
    found = search.company_matches(companies(spark, sf_dir), "#_____1%5", "Company", "Active").where(F.col("name").endswith("5"))
    return found.select(*search.COMPANY_COLUMNS).orderBy("name", "number").limit(search.limit_guard(500))


@query(r"SELECT doc_id, lang, source, n_chars FROM documents WHERE text ILIKE '%licen_e%' ORDER BY n_chars DESC, doc_id LIMIT 50")
def search_docs_ilike(spark, sf_dir):
    docs = render.table(spark, sf_dir, "documents").where(text.contains_ignoring_case("text", "licen_e"))
    return docs.select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query(COMPANIES + f" SELECT {_SHOWN} FROM co WHERE number = '50D'", dates=('incorporation_date',))
def company_lookup(spark, sf_dir):
    page = company.pages_of(render.company_pages(spark, sf_dir), "50D")
    return search.key_lookup(company.company_rows(company.parse_companies(page)), "number", "50D").select(*search.COMPANY_COLUMNS)


@query(DIRECTORS + " SELECT * FROM dirs WHERE company_number = '3' ORDER BY seq")
def lookup_directors(spark, sf_dir):
    page = company.pages_of(render.company_pages(spark, sf_dir), "3")
    found = company.child_rows(company.parse_companies(page), "company_directors")
    return search.lookup_children(found, "3").select("company_number", "seq", "full_name")


@query(
    DIRECTORS
    + NAMES.removeprefix(COMPANIES)
    + REMARKS.removeprefix(COMPANIES)
    + """ SELECT number, name, (SELECT string_agg(seq || ':' || full_name, '|' ORDER BY seq) FROM dirs WHERE company_number = number) AS directors,
(SELECT string_agg(seq || ':' || n.name || ':' || coalesce(CAST(effective_date AS VARCHAR), ''), '|' ORDER BY seq) FROM names n WHERE company_number = number) AS previous_names,
(SELECT string_agg(seq || ':' || remark, '|' ORDER BY seq) FROM rem WHERE company_number = number) AS remarks FROM co"""
)
def company_with_children(spark, sf_dir):
    parsed = upsert.kept(parsed_companies(spark, sf_dir), "parsed")
    return _lists_as_text(search.company_with_children(company.company_rows(parsed), *[company.child_rows(parsed, t) for t in company.CHILD_LISTS]))


def _lists_as_text(full: DataFrame) -> DataFrame:
    joined = lambda c, *f: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["seq"].cast("string"), *[F.coalesce(x[n].cast("string"), F.lit("")) for n in f])), "|").alias(c)
    return full.select("number", "name", joined("directors", "full_name"), joined("previous_names", "name", "effective_date"), joined("remarks", "remark"))


@query(ORACLES["company_with_children"])
def children_in_buckets(spark, sf_dir):
    """The same from stored tables that lie in the same buckets, so that the joins need no shuffle."""
    store = _store(spark, sf_dir)
    store.ingest(render.company_pages(spark, sf_dir), "company", log=False)
    where = storage.scratch(spark, "bucketed")
    saved = store.save_for_joins(where.rpartition("/")[2].replace("-", "_"), where)
    return _lists_as_text(search.company_with_children(saved["companies"], *[saved[t] for t in company.CHILD_LISTS]))


#: Patterns with and without wildcards, by number, too short for a trigram, of quotes, without a match.
_PATTERNS = (" studio ", "#_____1%5", "100D", "c\" & C", "7", "no such name")


@query(
    COMPANIES
    + " SELECT * FROM ("
    + ") UNION ALL SELECT * FROM (".join(f"SELECT '{p}' AS pattern, number, name, CASE WHEN k % 2 = 0 THEN 'Previous Name' ELSE status END AS status FROM co WHERE name ILIKE '%{p.strip()}%' OR number = '{p.strip()}' ORDER BY name, number LIMIT 50" for p in _PATTERNS)
    + ")"
)
def search_indexed(spark, sf_dir):
    """Searches of stored tables by the trigram index, which the second load keeps up."""
    store, all_pages = _store(spark, sf_dir), render.company_pages(spark, sf_dir)
    store.ingest(all_pages, "company")
    store.create_search_index()
    store.ingest(_without_lists(_even(all_pages)), "company")
    found = [search.search_companies(store.may_match("companies", p), p).select(F.lit(p).alias("pattern"), "number", "name", "status") for p in _PATTERNS]
    return reduce(DataFrame.unionByName, found)


@query(
    LOBBYISTS
    + """ SELECT registration_number, lobbyist_type, status, contact_name, firm_name, effective_date FROM lob WHERE contact_name ILIKE '%act_1%7%' OR firm_name ILIKE '%act_1%7%'
OR registration_number = 'act_1%7' ORDER BY effective_date DESC NULLS LAST, contact_name NULLS LAST, registration_number LIMIT 50""", dates=('effective_date',))
def search_lobbyists_indexed(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.ingest(render.lobbyist_pages(spark, sf_dir), "lobbyist")
    store.create_search_index()
    return search.search_lobbyists(store.may_match("lobbyist_registrations", "act_1%7"), "act_1%7")


_LOBBYIST = "registration_number, lobbyist_type, status, registration_date, effective_date, contact_name, firm_name, organization_description"


@query(LOBBYISTS + f" SELECT {_LOBBYIST}, CAST(NULL AS VARCHAR) AS firm_city FROM lob", dates=('registration_date', 'effective_date'))
def lobbyist_parse(spark, sf_dir):
    return lobbyists(spark, sf_dir).select(*_LOBBYIST.split(", "), "firm_city")


@query(LOBBYISTS + " SELECT lobbyist_type, count(*) AS n, count(contact_name) AS with_contact FROM lob GROUP BY 1")
def lobbyist_type(spark, sf_dir):
    return lobbyists(spark, sf_dir).groupBy("lobbyist_type").agg(F.count("*").alias("n"), F.count("contact_name").alias("with_contact"))


@query(LOBBYISTS + " SELECT registration_number, reg_text AS registration_text, eff_text AS effective_text, firm_name AS firm, CAST(6 + (contact_name IS NOT NULL)::INT + (k % 19 = 0)::INT AS INT) AS n_fields FROM lob")
def lobbyist_raw_json(spark, sf_dir):
    raw = lobbyists(spark, sf_dir).select("registration_number", lobbyist.raw_fields_json("raw_fields").alias("j"), F.size("raw_fields").alias("n_fields"))
    field = lambda name, label: F.get_json_object("j", f"$.{label}").alias(name)
    return raw.select("registration_number", field("registration_text", "lblRegistrationDate"), field("effective_text", "lblEffectiveDate"), field("firm", "lblFirmName"), "n_fields")


@query(
    """SELECT 'CL-' || o_orderkey AS registration_number, o_orderpriority AS city, CASE WHEN o_orderkey % 5 = 0 THEN 'open' || chr(10) || 'still' ELSE o_orderstatus END AS status,
'a' || chr(10) || 'b' || chr(10) || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'c' || chr(10) || '<' || chr(10) || 'd' AS organization_description, CAST(o_orderdate AS DATE) AS amended_date,
CASE WHEN o_orderkey % 5 = 0 THEN 'next' END AS particulars, CAST(5 + (o_orderkey % 5 = 0)::INT AS INT) AS n_fields FROM orders""", dates=('amended_date',))
def lobbyist_nested(spark, sf_dir):
    found = lobbyist.lobbyist_rows(lobbyist.parse_lobbyists(render.nested_pages(spark, sf_dir)))
    return found.select("registration_number", F.col("firm_city").alias("city"), "status", "organization_description", "amended_date", "particulars", F.size("raw_fields").alias("n_fields"))


@query(
    LOBBYISTS
    + """ SELECT registration_number, lobbyist_type, status, contact_name, firm_name, effective_date FROM lob WHERE contact_name ILIKE '%contact_1%' OR firm_name ILIKE '%contact_1%'
OR registration_number = 'Contact_1' ORDER BY effective_date DESC NULLS LAST, contact_name NULLS LAST, registration_number LIMIT 50""", dates=('effective_date',))
def search_lobbyists(spark, sf_dir):
    return search.search_lobbyists(lobbyists(spark, sf_dir), "Contact_1")


@query(LOBBYISTS + " SELECT registration_number, coalesce(contact_name, firm_name, registration_number) AS title FROM lob")
def display_titles(spark, sf_dir):
    return lobbyists(spark, sf_dir).select("registration_number", text.display_title("contact_name", "firm_name", "registration_number").alias("title"))


@query("SELECT CASE WHEN o_orderkey % 103 = 0 THEN 'err' ELSE 'ok' END AS outcome, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def lobbyist_errors(spark, sf_dir):
    return parsed_lobbyists(spark, sf_dir).groupBy(F.when(F.col("parse_error") == lobbyist.NO_NUMBER, "err").otherwise("ok").alias("outcome")).agg(F.count("*").alias("n"))


@query(HITS + " SELECT key, row_index, name, status, number, corporation_type, date_text FROM hit")
def list_hits(spark, sf_dir):
    return company.explode_search_hits(render.company_list_pages(spark, sf_dir)).select("key", "row_index", "name", "status", "number", "corporation_type", "date_text")


@query("SELECT 'CL-' || c_custkey AS registration_number, CAST(c_custkey // 10 + 1 AS INT) AS page_no, CAST(c_custkey % 10 + 1 AS INT) AS row_index FROM customer")
def lobbyist_index(spark, sf_dir):
    return planning.lobbyist_index(render.lobbyist_list_pages(spark, sf_dir))


@query("SELECT 'p' || (c_custkey // 10 + 1) AS key, 'CL-' || c_custkey AS registration_number, c_name AS name, c_mktsegment AS organization, '2020-01-02' AS activity_date_text, CAST(NULL AS VARCHAR) AS client FROM customer")
def lobbyist_hits(spark, sf_dir):
    keyed = render.lobbyist_list_pages(spark, sf_dir).withColumn("key", F.concat(F.lit("p"), F.col("page_no").cast("string")))
    return lobbyist.explode_hits(keyed).select("key", "registration_number", "name", "organization", "activity_date_text", "client")


@query(
    """WITH t AS (SELECT count(*) AS n FROM customer), p AS (SELECT c_custkey // 10 AS p, count(*) AS rows FROM customer GROUP BY 1)
SELECT CAST(p + 1 AS INT) AS page_no, CAST(n AS INT) AS total, CAST(p * 10 + 1 AS INT) AS first, CAST(p * 10 + rows AS INT) AS last, p * 10 + rows < n AS has_next, CAST(rows AS INT) AS hits FROM p, t"""
)
def paging(spark, sf_dir):
    marked = L.once(render.lobbyist_list_pages(spark, sf_dir), "marks", lobbyist.page_marks("html"))
    return marked.select("page_no", "marks.total", "marks.first", "marks.last", F.col("marks.more").alias("has_next"), F.size(lobbyist.hit_row_indices("html")).alias("hits"))


@query("WITH t AS (SELECT count(*) AS n FROM customer), p AS (SELECT c_custkey // 10 AS p, count(*) AS r FROM customer GROUP BY 1) SELECT 'n' || (p + 1) AS key, CAST(n AS INT) AS total, (p * 10 + 1) || '-' || (p * 10 + r) AS viewing FROM p, t")
def search_totals(spark, sf_dir):
    return L.once(render.company_list_pages(spark, sf_dir), "totals", company.search_totals("html")).select("key", "totals.total", "totals.viewing")


@query(r"SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark, sf_dir):
    return render.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link"))


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def page_hash(spark, sf_dir):
    return render.table(spark, sf_dir, "pages").select("page_id", text.page_sha256("html").alias("sha256"))


@query(COMPANIES + ", h AS (SELECT DISTINCT 'n' || (c_custkey // 10 + 1) AS key FROM customer) SELECT key, 'details' AS kind, CASE WHEN k % 103 <> 0 AND k % 101 <> 0 THEN key ELSE 's' || key END AS saved_id FROM page UNION ALL SELECT key, 'hits', NULL FROM h UNION ALL SELECT CAST(page_id AS VARCHAR), 'empty', NULL FROM pages")
def classify_responses(spark, sf_dir):
    details = render.company_pages(spark, sf_dir).select("key", F.concat(F.lit("s"), "key").alias("number"), "url", "html")
    listed = render.company_list_pages(spark, sf_dir).select("key", F.col("key").alias("number"), "url", "html")
    other = render.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), F.lit("0").alias("number"), "url", "html")
    return planning.classify_responses(details.unionByName(listed).unionByName(other)).select("key", "kind", "saved_id")


@query(HITS + " SELECT key AS list_key, row_index, number FROM hit")
def drill_targets(spark, sf_dir):
    return planning.drill_targets(render.company_list_pages(spark, sf_dir))


# -- loads ------------------------------------------------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> upsert.Store:
    return upsert.Store(spark, storage.scratch(spark, "store"))


def _even(pages_: DataFrame) -> DataFrame:
    return pages_.where("c_custkey % 2 = 0")


def _without_lists(pages_: DataFrame) -> DataFrame:
    """The same pages without their director and remark sections, and with a new status."""
    bare = F.regexp_replace("html", r'(?s)<a name="(Directors|Remarks)"></a>.*?(?=<a name=|<div id="gnlfoot")', "")
    return pages_.withColumn("html", F.regexp_replace(bare, r'(="lblStatus"[^>]*>)[^<]*', "$1Previous Name"))


def two_runs(spark: SparkSession, sf_dir: str) -> upsert.Store:
    """All companies, then the even ones again in another state."""
    store, all_pages = _store(spark, sf_dir), render.company_pages(spark, sf_dir)
    store.ingest(all_pages, "company")
    store.ingest(_without_lists(_even(all_pages)), "company")
    return store


@query(COMPANIES + " SELECT number, name, CASE WHEN k % 2 = 0 THEN 'Previous Name' ELSE status END AS status, ro_city FROM co")
def upsert_replace(spark, sf_dir):
    return two_runs(spark, sf_dir).table("companies").select("number", "name", "status", "ro_city")


@query(
    COMPANIES
    + """, lob AS (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 103 <> 0)
SELECT count(*) FILTER (corporation_type = 'Company') AS companies, count(*) FILTER (corporation_type = 'Condominium') AS condominiums,
  count(*) FILTER (corporation_type = 'Co-operative') AS co_operatives, (SELECT n FROM lob) AS lobbyists FROM co"""
)
def registry_counts_kept(spark, sf_dir):
    """The counts that loads keep up: all companies, the even ones again, and the lobbyists."""
    return search.counted_registries(_counted_store(spark, sf_dir).counts())


@query(
    DIRECTORS
    + NAMES.removeprefix(COMPANIES)
    + REMARKS.removeprefix(COMPANIES)
    + """ SELECT 'companies' AS label, count(*) AS n FROM co UNION ALL SELECT 'company_directors', count(*) FROM dirs JOIN co ON company_number = number WHERE k % 2 = 1
UNION ALL SELECT 'company_previous_names', count(*) FROM names UNION ALL SELECT 'company_historical_remarks', count(*) FROM rem JOIN co ON company_number = number WHERE k % 2 = 1
UNION ALL SELECT 'lobbyist_registrations', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 103 <> 0
UNION ALL SELECT 'ingest_log', (SELECT count(*) + count(*) FILTER (c_custkey % 2 = 0) FROM customer) + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey)
UNION ALL SELECT 'r/detail', count(*) FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT 'r/list', count(*) FROM pages WHERE page_id % 2 = 0"""
)
def table_counts_kept(spark, sf_dir):
    """The same of every table, and of pages that are landed, landed again, and in part removed."""
    root, found = storage.scratch(spark, "landed"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    landed = lambda kind: found.select(F.lit("r").alias("registry"), F.lit(kind).alias("kind"), F.col("page_id").cast("string").alias("key"), "html", "url")
    pages.land_pages(landed("detail"), root)
    pages.count_pages(spark, root)
    pages.land_pages(landed("list").where("key % 2 = 0").unionByName(landed("detail").where("key % 5 = 0")), root)
    pages.remove_pages(spark, root, landed("detail").where("key % 3 = 0").select("registry", "kind", "key"))
    return search.counted_tables(_counted_store(spark, sf_dir).counts(), pages.page_counts(spark, root))


def _counted_store(spark: SparkSession, sf_dir: str) -> upsert.Store:
    store, all_pages = _store(spark, sf_dir), render.company_pages(spark, sf_dir)
    store.ingest(all_pages, "company")
    store.create_counts()
    store.ingest(_without_lists(_even(all_pages)), "company")
    store.ingest(render.lobbyist_pages(spark, sf_dir), "lobbyist")
    return store


@query(COMPANIES + " SELECT number, name, CASE WHEN k % 2 = 0 THEN 'Previous Name' ELSE status END AS status, ro_city FROM co")
def upsert_merged(spark, sf_dir):
    """The same after the runs were merged into a base."""
    store = two_runs(spark, sf_dir)
    store.merge()
    return store.table("companies").select("number", "name", "status", "ro_city")


@query(
    DIRECTORS
    + NAMES.removeprefix(COMPANIES)
    + REMARKS.removeprefix(COMPANIES)
    + """ SELECT 'directors' AS child, count(*) AS n FROM dirs JOIN co ON company_number = number WHERE k % 2 = 1
UNION ALL SELECT 'names', count(*) FROM names UNION ALL SELECT 'remarks', count(*) FROM rem JOIN co ON company_number = number WHERE k % 2 = 1"""
)
def children_shrink(spark, sf_dir):
    store = two_runs(spark, sf_dir)
    tables = {"directors": "company_directors", "names": "company_previous_names", "remarks": "company_historical_remarks"}
    return search.table_counts({k: store.table(v) for k, v in tables.items()}).withColumnRenamed("label", "child")


@query(
    COMPANIES
    + """, runs AS (SELECT key, err, k FROM page UNION ALL SELECT key, err, k FROM page WHERE k % 2 = 0)
SELECT coalesce(err, 'ok') AS outcome, count(*) AS n, count(DISTINCT key) AS keys, (SELECT count(*) FROM runs) AS last_id FROM runs GROUP BY 1"""
)
def log_two_runs(spark, sf_dir):
    log = two_runs(spark, sf_dir).table("ingest_log")
    last = log.agg(F.max("id").alias("last_id"), F.lit(1).alias("_one"))
    found = log.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("record_key").alias("keys"))
    return found.withColumn("_one", F.lit(1)).join(last, "_one").drop("_one")


@query(COMPANIES + " SELECT count(*) FILTER (err IS NULL) AS ok, count(*) FILTER (err IS NOT NULL) AS err FROM page")
def ingest_ok_err_counts(spark, sf_dir):
    return upsert.ok_err_counts(upsert.log_rows(parsed_companies(spark, sf_dir), "company"))


@query(COMPANIES + " SELECT number, CASE WHEN k % 3 = 0 THEN 'zz' || number ELSE number END AS key FROM co")
def dedupe_batch(spark, sf_dir):
    pages_ = render.company_pages(spark, sf_dir)
    copies = pages_.withColumn("key", F.concat(F.lit("zz"), "key"))
    older = pages_.withColumn("key", F.concat(F.lit("aa"), "key"))
    batch = pages_.where("c_custkey % 3 <> 0").unionByName(copies).unionByName(older)
    return upsert.dedupe_batch(company.parse_companies(batch), F.col("company.number")).select(F.col("company.number").alias("number"), "key")


@query(LOBBYISTS + " SELECT registration_number, lobbyist_type, effective_date, firm_name FROM lob", dates=('effective_date',))
def ingest_lobbyists(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.ingest(render.lobbyist_pages(spark, sf_dir), "lobbyist")
    return store.table("lobbyist_registrations").select("registration_number", "lobbyist_type", "effective_date", "firm_name")


@query(
    COMPANIES
    + """ SELECT 'number is null' AS rule, count(*) FILTER (k % 6 = 1) AS violations FROM co UNION ALL SELECT 'name is null', count(*) FILTER (k % 5 = 1) FROM co
UNION ALL SELECT 'corporation_type is null', count(*) FILTER (corporation_type = 'Condominium') FROM co UNION ALL SELECT 'ma_same_as_registered is null', count(*) FILTER (ma_same_as_registered IS NULL) FROM co
UNION ALL SELECT 'ingested_at is null', count(*) FILTER (number IS NULL) FROM co
UNION ALL SELECT 'number repeated', count(*) FILTER (k % 4 = 2 AND k % 6 <> 1) + (count(*) FILTER (k % 6 = 1) > 1)::INT FROM co"""
)
def constraints(spark, sf_dir):
    """Some numbers, names and types are taken away, and some rows stand twice."""
    found = companies(spark, sf_dir).withColumn("k", F.regexp_extract("number", "^[0-9]+", 0).cast("long"))
    broken = found.withColumns({"number": F.expr("if(k % 6 = 1, null, number)"), "name": F.expr("if(k % 5 = 1, null, name)"), "corporation_type": F.expr("nullif(corporation_type, 'Condominium')")})
    planted = broken.unionByName(found.where("k % 4 = 2 AND k % 6 <> 1").withColumns({"name": F.lit("again"), "corporation_type": F.lit("Company")}))
    return schemas.check_constraints(schemas.conform(planted, "companies"), "companies")


@query(COMPANIES + " SELECT number, name, status, incorporation_date, ma_same_as_registered FROM co", dates=('incorporation_date',))
def incremental_ingest_(spark, sf_dir):
    folder, marks, store = storage.scratch(spark, "arrivals"), storage.scratch(spark, "marks"), _store(spark, sf_dir)
    all_pages = render.company_pages(spark, sf_dir)
    for batch in (_even(all_pages), all_pages.where("c_custkey % 2 = 1")):
        batch.select("key", "html").write.mode("append").parquet(folder)
        incremental_ingest_table(spark, folder, store, "company", marks)
    return store.table("companies").select("number", "name", "status", "incorporation_date", "ma_same_as_registered")


@query(COMPANIES + " SELECT number, CASE WHEN number = '3' THEN 'Previous Name' ELSE status END AS status, (SELECT count(*) FROM page) AS logged FROM co")
def ingest_one_page(spark, sf_dir):
    """All pages, then one of them again in another state, which is not logged."""
    store, all_pages = _store(spark, sf_dir), render.company_pages(spark, sf_dir)
    store.ingest(all_pages, "company")
    again = _without_lists(all_pages.where("key = '3'")).select("key", "html").first()
    store.ingest_one("company", again.key, again.html)
    logged = store.table("ingest_log").agg(F.count("*").alias("logged"), F.lit(1).alias("_one"))
    return store.table("companies").select("number", "status", F.lit(1).alias("_one")).join(logged, "_one").drop("_one")


@query(
    COMPANIES
    + """ SELECT 'companies' AS label, count(*) AS n FROM co UNION ALL SELECT 'lobbyist_registrations', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 103 <> 0
UNION ALL SELECT 'company log', count(*) FROM page UNION ALL SELECT 'lobbyist log', count(*) FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def ingest_all(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.ingest_all(render.company_pages(spark, sf_dir), render.lobbyist_pages(spark, sf_dir))
    logged = {f"{kind} log": store.table("ingest_log").where(F.col("kind") == kind) for kind in ("company", "lobbyist")}
    return search.table_counts({n: store.table(n) for n in ("companies", "lobbyist_registrations")} | logged)


@query(COMPANIES + " SELECT number, name, status FROM co")
def incremental_ingest_files(spark, sf_dir):
    folder, marks, store = storage.scratch(spark, "arrivals"), storage.scratch(spark, "marks"), _store(spark, sf_dir)
    all_pages = render.company_pages(spark, sf_dir)
    for batch in (_even(all_pages), all_pages.where("c_custkey % 2 = 1")):
        pages.write_files(batch.select("html"), folder)
        incremental_ingest(spark, folder, store, "company", marks, suffix=pages.WRITTEN)
    return store.table("companies").select("number", "name", "status")


def _overwrite(spark: SparkSession, at: str, html: DataFrame) -> None:
    """Put one page in the place of a file, under its old name."""
    made = storage.scratch(spark, "again")
    pages.write_files(html.coalesce(1), made)
    fs, path = storage.path_of(spark, made)
    new = next(s.getPath() for s in fs.listStatus(path) if s.getPath().getName().endswith(pages.WRITTEN))
    old = storage.path_of(spark, at)[1]
    fs.delete(old, False)
    fs.rename(new, old)


@query(
    COMPANIES
    + """ SELECT number, CASE WHEN k IN (2, 4, 6) THEN 'Previous Name' ELSE status END AS status, (SELECT count(*) FROM page) AS new_files, 3 AS changed, 1 AS removed, (SELECT count(*) + 3 FROM page) AS logged FROM co"""
)
def changed_files(spark, sf_dir):
    """A folder of pages, then three of them fetched again under their old names, and one removed."""
    folder, store, all_pages = storage.scratch(spark, "fetched"), _store(spark, sf_dir), upsert.kept(render.company_pages(spark, sf_dir), "rendered")
    pages.write_files(all_pages.select("html"), folder)
    first = ingest_changes(spark, folder, store, "company", suffix=pages.WRITTEN)
    names = pages.scan_files(spark, folder, pages.WRITTEN).select("path", company.page_key("html").alias("key")).where(F.col("key").isin("2", "4", "6", "8"))
    at = {r.key: r.path for r in names.collect()}
    for key in ("2", "4", "6"):
        _overwrite(spark, at[key], _without_lists(all_pages.where(F.col("key") == key)).select("html"))
    fs, path = storage.path_of(spark, at["8"])
    fs.delete(path, False)
    second = ingest_changes(spark, folder, store, "company", suffix=pages.WRITTEN)
    one = F.lit(1).alias("_one")
    counts = first.agg(F.count_if(F.col("change") == "new").alias("new_files"), one).join(second.agg(F.count_if(F.col("change") == "changed").alias("changed"), F.count_if(F.col("change") == "removed").alias("removed"), one), "_one")
    logged = store.table("ingest_log").agg(F.count("*").alias("logged"), one)
    return store.table("companies").select("number", "status", one).join(counts, "_one").join(logged, "_one").drop("_one")


# -- raw zone ---------------------------------------------------------------------------------------------------


@query("SELECT rpad(substr(upper(regexp_replace(url, '[^\\p{L}\\p{N}._-]', '_', 'g')), 1, 2), 2, '0') AS shard, count(*) AS n FROM pages GROUP BY 1".replace("\\\\", "\\"))
def shard_counts(spark, sf_dir):
    keys = render.table(spark, sf_dir, "pages").select(text.safe_key("url").alias("key"))
    return keys.groupBy(text.shard_key("key").alias("shard")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g') AS key, 'web/' || rpad(substr(upper(regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g')), 1, 2), 2, '0') || '/' || regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g') || '.html.gz' AS path FROM pages")
def safe_keys(spark, sf_dir):
    return render.table(spark, sf_dir, "pages").select("page_id", text.safe_key("url").alias("key"), text.page_path(F.lit("web"), F.lit("detail"), "url").alias("path"))


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def csv_round_trip(spark, sf_dir):
    where = storage.scratch(spark, "csv")
    docs = render.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    files.write_typed_csv(docs, where)
    return files.read_typed_csv(spark, where, docs.schema)


@query("SELECT CAST(page_id AS VARCHAR) AS key, CASE WHEN page_id % 2 = 0 THEN 'again' ELSE sha256(html) END AS content FROM pages")
def land_and_scan(spark, sf_dir):
    where = storage.scratch(spark, "landed")
    raw = render.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), "html", "url", F.lit("web").alias("registry"), F.lit("detail").alias("kind"))
    pages.land_pages(raw, where)
    pages.land_pages(raw.where("CAST(key AS INT) % 2 = 0").withColumn("html", F.lit("again")), where)
    return pages.landed(spark, where).select("key", F.when(F.col("html") == "again", "again").otherwise(text.page_sha256("html")).alias("content"))


@query("SELECT CAST(page_id AS VARCHAR) AS key FROM pages WHERE page_id % 3 = 0")
def pages_dropped(spark, sf_dir):
    manifest = render.table(spark, sf_dir, "pages").select(F.lit("detail").alias("kind"), F.col("page_id").cast("string").alias("key"))
    # every third page, and keys that no page has
    unwanted = manifest.where("CAST(key AS BIGINT) % 3 = 0").withColumn("key", F.explode(F.array("key", F.concat(F.lit("absent-"), "key"))))
    return pages.drop_pages(manifest, unwanted)[1].select("key")


@query(
    """SELECT 'left in web' AS what, count(*) FILTER (page_id % 3 <> 0) AS n, sum(page_id) FILTER (page_id % 3 <> 0)::BIGINT AS ids FROM pages UNION ALL SELECT 'left in other', count(*), sum(page_id)::BIGINT FROM pages
UNION ALL SELECT 'removed', count(*) FILTER (page_id % 3 = 0), sum(page_id) FILTER (page_id % 3 = 0)::BIGINT FROM pages"""
)
def pages_removed(spark, sf_dir):
    """Pages of two registries; every third of one is removed, and keys that no page has; then all is merged and read again."""
    where, key = storage.scratch(spark, "landed"), F.col("page_id").cast("string").alias("key")
    raw = render.table(spark, sf_dir, "pages").select(key, "html", "url", F.explode(F.array(F.lit("web"), F.lit("other"))).alias("registry"), F.lit("detail").alias("kind"))
    pages.land_pages(raw, where)
    unwanted = raw.where("registry = 'web' AND CAST(key AS BIGINT) % 3 = 0").withColumn("key", F.explode(F.array("key", F.concat(F.lit("absent-"), "key"))))
    gone = pages.remove_pages(spark, where, unwanted)
    pages.merge_pages(spark, where)
    left = pages.landed(spark, where).select(F.concat(F.lit("left in "), "registry").alias("what"), "key")
    return left.unionByName(gone.select(F.lit("removed").alias("what"), "key")).groupBy("what").agg(F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("ids"))


@query("SELECT sum(octet_length(encode(html)) + 1)::BIGINT AS bytes FROM pages")
def landing_size(spark, sf_dir):
    where = storage.scratch(spark, "files")
    render.table(spark, sf_dir, "pages").select("html").write.text(where)
    return pages.landing_size(spark, where).select("bytes")


@query("SELECT DISTINCT CAST(o_custkey AS INT) AS number FROM orders WHERE o_orderkey % 4 = 0")
def error_log_round_trip(spark, sf_dir):
    where = storage.scratch(spark, "errors")
    orders = render.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("number"), F.lit("time\nout").alias("error"), F.col("o_orderdate").alias("attempted_at"))
    files.append_error_log(orders.withColumn("kind", F.when(F.col("o_orderkey") % 4 == 0, "error").otherwise("detail")), where)
    orders.select(F.when(F.col("o_orderkey") % 2 == 0, "not json").otherwise('{"error": "none"}').alias("value")).write.mode("append").text(where)
    return files.read_error_log(spark, where)


def _dealt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the pages, dealt to all tasks: a file for each is made, which takes a task longer than its text."""
    return render.table(spark, sf_dir, "pages").select("html").repartition(spark.sparkContext.defaultParallelism)


@query("SELECT sha256(html || chr(10)) AS content, count(*) AS n, count(*) AS keys FROM pages GROUP BY 1")
def scan_detail_pages(spark, sf_dir):
    """A folder of gzipped pages; list pages below it are not read."""
    where, html = storage.scratch(spark, "raw"), _dealt_pages(spark, sf_dir)
    pages.write_files(html, where)
    pages.write_files(html, f"{where}/_list")
    return pages.scan_detail_pages(spark, where, suffix=pages.WRITTEN).groupBy(text.page_sha256("html").alias("content")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("SELECT sha256(html || chr(10)) AS content, 2 * count(*) AS n, 2 * count(*) AS keys FROM pages GROUP BY 1")
def scan_list_pages(spark, sf_dir):
    """Two list folders, each named itself."""
    folders, html = [f"{storage.scratch(spark, 'raw')}/_list" for _ in range(2)], _dealt_pages(spark, sf_dir)
    for where in folders:
        pages.write_files(html, where)
    return pages.scan_list_pages(spark, *folders, suffix=pages.WRITTEN).groupBy(text.page_sha256("html").alias("content")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


# -- planning ---------------------------------------------------------------------------------------------------


@query("SELECT CAST(i AS VARCHAR) AS key FROM range(1, (SELECT count(*) + 100 FROM customer)) t(i) WHERE i NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)")
def frontier(spark, sf_dir):
    manifest = render.company_pages(spark, sf_dir).select("key")
    return planning.crawl_frontier(spark, manifest, 1, render.table(spark, sf_dir, "customer").count() + 100)


@query(ORACLES["frontier"])
def frontier_bitmaps(spark, sf_dir):
    manifest = render.company_pages(spark, sf_dir).select("key")
    return planning.bitmap_frontier(spark, manifest, 1, render.table(spark, sf_dir, "customer").count() + 100)


_OUTCOMES = """WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'detail' WHEN 1 THEN 'hits' WHEN 2 THEN 'empty' WHEN 3 THEN 'cached' WHEN 4 THEN 'error' END AS kind, o_orderkey % 4 AS ids FROM orders)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("detail", "hits", "empty", "cached", "error", None)]), (k % 6).cast("int"))
    ids = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: i.cast("string"))
    return render.table(spark, sf_dir, "orders").select(k.alias("number"), kind.alias("kind"), F.slice(ids, 2, 9).alias("ids_saved"), F.lit("x").alias("error"), F.col("o_orderdate").alias("attempted_at"))


@query(
    _OUTCOMES
    + """ SELECT count(*) AS attempted, count(*) FILTER (kind = 'detail') AS details, count(*) FILTER (kind = 'hits') AS multi_hit_pages,
CAST(sum(CASE WHEN kind = 'hits' THEN greatest(0, ids - 1) ELSE 0 END) AS BIGINT) AS suffixed_drilled, count(*) FILTER (kind = 'empty') AS empty, count(*) FILTER (kind = 'cached') AS cached,
count(*) FILTER (kind IS NULL OR kind = 'error') AS errors FROM o"""
)
def outcome_stats(spark, sf_dir):
    return planning.outcome_stats(_outcomes(spark, sf_dir))


@query(ORACLES["outcome_stats"])
def running_outcomes(spark, sf_dir):
    """The same counters from a stream, after three arrivals."""
    folder, where, marks = (storage.scratch(spark, name) for name in ("arrivals", "counters", "marks"))
    for i in range(3):
        _outcomes(spark, sf_dir).where(F.col("number") % 3 == i).select("kind", "ids_saved").write.mode("append").parquet(folder)
        count_outcomes(spark, folder, where, marks)
    return outcomes_so_far(spark, where)


@query(_OUTCOMES + " SELECT count(*) FILTER (kind = 'detail') AS details, count(*) FILTER (kind = 'empty') AS skipped, count(*) FILTER (kind IS NULL OR kind NOT IN ('detail', 'empty')) AS errors FROM o")
def lobbyist_outcome_stats(spark, sf_dir):
    return planning.lobbyist_outcome_stats(_outcomes(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "empty", "skipped").otherwise(F.col("kind"))))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 6 = 4")
def retry_list(spark, sf_dir):
    where = storage.scratch(spark, "errors")
    files.append_error_log(_outcomes(spark, sf_dir).join(render.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), "o_custkey"), "number").withColumn("number", F.col("o_custkey")), where)
    return planning.retry_list(files.read_error_log(spark, where))


@query("SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(*) AS INT) AS total, true AS complete FROM customer")
def index_complete(spark, sf_dir):
    return planning.index_complete(render.lobbyist_list_pages(spark, sf_dir))


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey // 10 + 1 AS p FROM customer WHERE (c_custkey // 10 + 1) % 7 NOT IN (3, 4)), d AS (SELECT DISTINCT p FROM c),
last AS (SELECT max(p) AS l, (SELECT max(c_custkey // 10 + 1) FROM customer) AS whole FROM d), back AS (SELECT p, coalesce(lag(p) OVER (ORDER BY p), 0) AS b FROM d)
SELECT 'missing' AS problem, b + 1 AS first, p - 1 AS last, CAST(NULL AS VARCHAR) AS registration_number, 1 AS times FROM back WHERE p > b + 1
UNION ALL SELECT 'fetched again', p, p, NULL, 2 FROM d WHERE p % 5 = 0
UNION ALL SELECT 'repeated', min(p), max(p), 'CL-' || k, 2 FROM (SELECT k, p FROM c UNION ALL SELECT k, 1000000 + p FROM c WHERE p % 6 = 1) GROUP BY k HAVING count(*) > 1
UNION ALL SELECT 'no end', 1000000 + max(p), 1000000 + max(p), NULL, 1 FROM d, last WHERE p % 6 = 1 HAVING max(p) < max(whole)
UNION ALL SELECT 'end', p, p, NULL, 1 FROM d, last WHERE p = whole AND EXISTS (SELECT 1 FROM d WHERE d.p % 6 = 1)
UNION ALL SELECT 'missing', l + 1, 1000000 + (SELECT min(p) FROM d WHERE p % 6 = 1) - 1, NULL, 1 FROM last WHERE EXISTS (SELECT 1 FROM d WHERE d.p % 6 = 1)
UNION ALL SELECT 'missing', 1000000 + b + 1, 1000000 + p - 1, NULL, 1 FROM (SELECT p, lag(p) OVER (ORDER BY p) AS b FROM d WHERE p % 6 = 1) WHERE p > b + 1"""
)
def index_gaps(spark, sf_dir):
    """Some pages are missing, some were fetched twice, and some stand a second time under far numbers, with the same entries."""
    whole = render.lobbyist_list_pages(spark, sf_dir).withColumn("page_no", F.col("page_no").cast("long")).where("page_no % 7 NOT IN (3, 4)")
    far = whole.where("page_no % 6 = 1").withColumn("page_no", F.col("page_no") + 1_000_000)
    return planning.index_gaps(whole.unionByName(whole.where("page_no % 5 = 0")).unionByName(far))


@query(
    """SELECT CAST(c_custkey // 10 + 1 AS INT) AS page_no, string_agg((c_custkey % 10 + 1) || ':CL-' || c_custkey, ' ' ORDER BY c_custkey) AS entries
FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1"""
)
def work_plan(spark, sf_dir):
    landed = render.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("CL-"), F.col("c_custkey").cast("string")).alias("key"))
    plan = planning.page_work_plan(lobbyist_index(spark, sf_dir), landed)
    entry = lambda e: F.concat_ws(":", e["row_index"].cast("string"), e["registration_number"])
    return plan.select("page_no", F.array_join(F.transform("entries", entry), " ").alias("entries"))


# -- display ----------------------------------------------------------------------------------------------------


@query(COMPANIES + " SELECT number, ro_city || ', ' || ro_province_state AS location, concat_ws(chr(10), ro_contact, ro_line1, ro_line2, ro_city || ', ' || ro_province_state, ro_country, ro_postal_zip) AS address FROM co")
def location_labels(spark, sf_dir):
    office = F.col("company.registered_office")
    good = parsed_companies(spark, sf_dir).where("parse_error IS NULL")
    return good.select(F.col("company.number").alias("number"), text.location_label(office["city"], office["province_state"]).alias("location"), text.address_block(office).alias("address"))


@query(
    """WITH s AS (SELECT doc_id, n_chars * n_chars AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1fB', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1fKB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1fMB', n / 1048576.0::DOUBLE)
ELSE printf('%.1fGB', n / 1073741824.0::DOUBLE) END AS size FROM s"""
)
def human_bytes(spark, sf_dir):
    return render.table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query(
    DIRECTORS
    + NAMES.removeprefix(COMPANIES)
    + REMARKS.removeprefix(COMPANIES)
    + """, held AS (SELECT 'companies' AS name, 32 AS columns, count(*) AS n, count(DISTINCT number) AS keys, 0 AS nulls FROM co
UNION ALL SELECT 'company_directors', 5, count(*), count(DISTINCT company_number || '/' || seq), 0 FROM dirs
UNION ALL SELECT 'company_previous_names', 4, count(*), count(DISTINCT company_number || '/' || seq), 0 FROM names
UNION ALL SELECT 'company_historical_remarks', 3, count(*), count(DISTINCT company_number || '/' || seq), 0 FROM rem
UNION ALL SELECT 'lobbyist_registrations', 23, 0, 0, 0 UNION ALL SELECT 'ingest_log', 7, count(*), count(*), 0 FROM page)
SELECT name, CAST(columns AS INT) AS columns, n, keys, CAST(nulls AS BIGINT) AS nulls FROM held"""
)
def table_schemas(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.ingest(render.company_pages(spark, sf_dir), "company")
    return schemas.table_report({name: store.table(name) for name in schemas.TABLES})
