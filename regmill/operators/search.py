"""Searches, lookups and reports over the tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case

MAX_LIMIT, DEFAULT_LIMIT = 500, 50
COMPANY_COLUMNS = ["number", "name", "corporation_type", "category", "status", "incorporation_date", "ro_city", "ro_province_state"]
LOBBYIST_COLUMNS = ["registration_number", "lobbyist_type", "status", "contact_name", "firm_name", "effective_date"]


def limit_guard(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must lie in 1..{MAX_LIMIT}: {limit}")
    return limit


def compose_and(clauses: list[Column]) -> Column:
    """All clauses; every row if there are none."""
    return reduce(and_, clauses, F.lit(True))


def name_or_number_match(query: str | None) -> list[Column]:
    q = (query or "").strip()
    return [contains_ignoring_case("name", q) | (F.col("number") == q)] if q else []


def contact_firm_reg_match(query: str | None) -> list[Column]:
    q = (query or "").strip()
    return [contains_ignoring_case("contact_name", q) | contains_ignoring_case("firm_name", q) | (F.col("registration_number") == q)] if q else []


def equals_if_given(column: str, value: str | None) -> list[Column]:
    return [F.col(column) == value] if value else []


def company_matches(companies: DataFrame, q: str | None = None, corporation_type: str | None = None, status: str | None = None) -> DataFrame:
    return companies.where(compose_and(name_or_number_match(q) + equals_if_given("corporation_type", corporation_type) + equals_if_given("status", status)))


def search_companies(companies: DataFrame, q: str | None = None, corporation_type: str | None = None, status: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first matches by name; the number breaks ties."""
    return company_matches(companies, q, corporation_type, status).select(*COMPANY_COLUMNS).orderBy("name", "number").limit(limit_guard(limit))


def lobbyist_matches(lobbyists: DataFrame, q: str | None = None) -> DataFrame:
    return lobbyists.where(compose_and(contact_firm_reg_match(q)))


def search_lobbyists(lobbyists: DataFrame, q: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The latest matches; contact name, null last, and registration number break ties."""
    order = [F.desc_nulls_last("effective_date"), F.asc_nulls_last("contact_name"), F.asc("registration_number")]
    return lobbyist_matches(lobbyists, q).select(*LOBBYIST_COLUMNS).orderBy(*order).limit(limit_guard(limit))


def match_total(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("total"))


def key_lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """The row with a key, or no row."""
    return table.where(F.col(key) == value)


def lookup_children(child: DataFrame, number: str) -> DataFrame:
    return child.where(F.col("company_number") == number).orderBy("seq")


def _children(child: DataFrame, into: str) -> DataFrame:
    fields = [c for c in child.columns if c != "company_number"]
    return child.groupBy(F.col("company_number").alias("number")).agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in fields if c != "seq"]))).alias(into))


def company_with_children(companies: DataFrame, directors: DataFrame, names: DataFrame, remarks: DataFrame) -> DataFrame:
    """One row for each company, with its lists in order."""
    out = companies
    for child, into in ((directors, "directors"), (names, "previous_names"), (remarks, "remarks")):
        out = out.join(_children(child, into), "number", "left")
    return out


def count_by_type(companies: DataFrame) -> DataFrame:
    return companies.groupBy("corporation_type").agg(F.count("*").alias("n"))


def registry_counts(companies: DataFrame, lobbyists: DataFrame) -> DataFrame:
    """One row with the count of each registry; the two sides are single rows."""
    kind = lambda k, name: F.count_if(F.col("corporation_type") == k).alias(name)
    left = companies.agg(kind("Company", "companies"), kind("Condominium", "condominiums"), kind("Co-operative", "co_operatives"), F.lit(1).alias("_one"))
    right = lobbyists.agg(F.count("*").alias("lobbyists"), F.lit(1).alias("_one"))
    return left.join(right, "_one").drop("_one")


def table_counts(tables: dict[str, DataFrame], landed: DataFrame | None = None) -> DataFrame:
    """Rows of each table, and pages of each registry and kind, as one report."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n") for name, df in tables.items()]
    if landed is not None:
        parts.append(landed.groupBy(F.concat_ws("/", "registry", "kind").alias("label")).agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def counted_types(counts: DataFrame) -> DataFrame:
    """count_by_type from counts (table, value, n) that loads keep up."""
    return counts.where("table = 'companies' AND n > 0").select(F.col("value").alias("corporation_type"), "n")


def counted_registries(counts: DataFrame) -> DataFrame:
    """registry_counts from counts that loads keep up."""
    of = lambda where, name: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).alias(name)
    kind = lambda k, name: of((F.col("table") == "companies") & (F.col("value") == k), name)
    return counts.agg(kind("Company", "companies"), kind("Condominium", "condominiums"), kind("Co-operative", "co_operatives"), of(F.col("table") == "lobbyist_registrations", "lobbyists"))


def counted_tables(counts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """table_counts from counts that loads keep up, and counts (label, n) of landed pages."""
    report = counts.groupBy(F.col("table").alias("label")).agg(F.sum("n").alias("n"))
    return report if pages is None else report.unionByName(pages)
