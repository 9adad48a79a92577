"""The tables: schemas, keys, required columns and defaults."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDRESS = ("contact", "line1", "line2", "line3", "city", "province_state", "country", "postal_zip")


@dataclass(frozen=True)
class Table:
    name: str
    columns: str
    key: tuple[str, ...]
    required: tuple[str, ...]
    parent: str = ""  # of a child table: the column with the parent's key

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


#: The columns of the tables.
COMPANIES = """
number string, name string, corporation_type string, category string, status string,
incorporation_date date, registration_date date, last_annual_return date,
business_type string, incorporation_jurisdiction string, filing_type string, min_max_directors string, additional_info string,
ro_contact string, ro_line1 string, ro_line2 string, ro_line3 string, ro_city string, ro_province_state string, ro_country string, ro_postal_zip string,
ma_contact string, ma_line1 string, ma_line2 string, ma_line3 string, ma_city string, ma_province_state string, ma_country string, ma_postal_zip string,
ma_same_as_registered boolean, ingested_at timestamp, source_html_sha256 string
"""
DIRECTORS = "company_number string, seq int, full_name string, first_name string, last_name string"
PREVIOUS_NAMES = "company_number string, seq int, name string, effective_date date"
REMARKS = "company_number string, seq int, remark string"
LOBBYISTS = """
registration_number string, lobbyist_type string, status string,
registration_date date, effective_date date, amended_date date, approval_date date,
contact_name string, contact_line1 string, contact_city string, contact_province_state string, contact_postal_zip string,
firm_name string, firm_line1 string, firm_city string, firm_province_state string, firm_postal_zip string,
particulars string, organization_description string, organization_membership string,
raw_fields map<string,string>, ingested_at timestamp, source_html_sha256 string
"""
LOG = "id long, kind string, record_key string, parsed_ok boolean, error string, ingested_at timestamp, source_html_sha256 string"


TABLES = {
    t.name: t
    for t in (
        Table("companies", COMPANIES, ("number",), ("number", "name", "corporation_type", "ma_same_as_registered", "ingested_at")),
        Table("company_directors", DIRECTORS, ("company_number", "seq"), ("company_number", "seq", "full_name"), "company_number"),
        Table("company_previous_names", PREVIOUS_NAMES, ("company_number", "seq"), ("company_number", "seq", "name"), "company_number"),
        Table("company_historical_remarks", REMARKS, ("company_number", "seq"), ("company_number", "seq", "remark"), "company_number"),
        Table("lobbyist_registrations", LOBBYISTS, ("registration_number",), ("registration_number", "ingested_at")),
        Table("ingest_log", LOG, ("id",), ("id", "kind", "record_key", "parsed_ok", "ingested_at")),
    )
}
CHILDREN = [t for t in TABLES.values() if t.parent]


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; a missing ingest time is now, a missing flag false, other missing columns null."""
    defaults = {"ingested_at": F.current_timestamp(), "ma_same_as_registered": F.lit(False)}

    def one(f: T.StructField):
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        value = value.cast(f.dataType)
        return (F.coalesce(value, defaults[f.name]) if f.name in defaults else value).alias(f.name)

    return df.select(*[one(f) for f in TABLES[table].schema])


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """Violations by rule: required columns that are null, and keys that occur more than once."""
    spec = TABLES[table]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in spec.required])
    stacked = nulls.select(F.explode(F.array(*[F.struct(F.lit(f"{c} is null").alias("rule"), F.col(c).alias("violations")) for c in spec.required])).alias("v")).select("v.*")
    repeated = df.groupBy(*spec.key).count().agg(F.count_if(F.col("count") > 1).alias("violations"))
    return stacked.unionByName(repeated.select(F.lit(f"{', '.join(spec.key)} repeated").alias("rule"), "violations"))


def table_report(tables: dict[str, DataFrame]) -> DataFrame:
    """What each table holds: its columns, rows (n), distinct keys, and nulls in required columns."""
    parts = []
    for name, df in tables.items():
        spec = TABLES[name]
        nulls = reduce(add, [F.count_if(F.col(c).isNull()) for c in spec.required])
        found = df.agg(F.count("*").alias("n"), F.count_distinct(*spec.key).alias("keys"), nulls.alias("nulls"))
        parts.append(found.select(F.lit(name).alias("name"), F.lit(len(df.columns)).alias("columns"), "n", "keys", "nulls"))
    return reduce(DataFrame.unionByName, parts)
