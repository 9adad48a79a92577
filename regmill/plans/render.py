"""Registry pages rendered from the business tables, so that the operators have pages to read.

Every third page writes its attributes in mixed case and without quotes; some values are padded or broken on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Small rows that become large pages, of a table that may be one small file: not for one task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def _grows(rows: DataFrame) -> DataFrame:
    """The side of a join that grows with the tables. By the bytes of its file, and fewer columns, Spark would take it for small and build its
    hash table on the driver: several hundred MB of keys for a file of 50 MB."""
    return rows.hint("merge")


def _odd(key: Column) -> Column:
    return key % 3 == 0


def _label(key: Column, name: str, value: Column, broken: Column | None = None) -> Column:
    head = F.when(_odd(key), f'<SPAN Id="{name}" CLASS=v>').otherwise(f'<span id="{name}" class="v">')
    return F.concat(head, F.coalesce(value, F.lit("")), F.lit("</span>\n"))


STATUS = {"BUILDING": "Active", "AUTOMOBILE": "Dissolved - Voluntary", "MACHINERY": "Cancelled", "HOUSEHOLD": "Discontinued"}
OTHER_STATUS = "Dissolved (Prior To June 2004)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    first = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("date").alias("first_order"))
    placed = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.join(_grows(first), "c_custkey", "left")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier, at the company whose key is the root of its own: lists get longer and longer."""
    at = F.floor(F.sqrt(F.col("s_suppkey").cast("double"))).cast("long").alias("c_custkey")
    return table(spark, sf_dir, "supplier").groupBy(at).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("suppliers"))


def company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, html, url and c_custkey of one detail page for each customer."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = _dealt(
        _customers(spark, sf_dir)
        .join(_grows(_suppliers(spark, sf_dir)), "c_custkey", "left")
        .join(_grows(parts.select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("name1"))), "c_custkey", "left")
        .join(_grows(parts.select((F.col("p_partkey") - 1).alias("c_custkey"), F.col("p_name").alias("name2"))), "c_custkey", "left"),
        "c_custkey",
    )
    k = F.col("c_custkey")
    every = lambda n: k % n == 0
    label = lambda name, value: _label(k, name, value)
    number = F.concat(k.cast("string"), F.when(every(50), "D").otherwise(""))
    status = F.lit(OTHER_STATUS)
    for segment, value in STATUS.items():
        status = F.when(F.col("c_mktsegment") == segment, value).otherwise(status)
    date = F.col("first_order")
    incorporated = F.when(every(43), "not a date").when(every(41), F.date_format(date, "yyyy-M-d")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    kind = F.when(every(83), "Trust").when(k % 10 == 0, "Condominium").when(k % 10 == 1, "Co-operative").otherwise("Company")
    category = F.when(every(89), "Foreign").when(F.col("c_nationkey") < 5, "Extra-Provincial").otherwise("Local")
    labels = F.concat(
        label("lblCompanyName", F.when(every(97), "  ").otherwise(F.concat(F.when(every(7), 'STUDIO "C" & ').otherwise(""), F.col("c_name")))),
        label("lblCompanyNumber", F.when(every(101), "").otherwise(number)),
        label("lblCorporationType", kind), label("lblCategory", category), label("lblStatus", status), label("lblIncorporationDate", incorporated),
        label("lblRegistrationDate", F.date_format(F.date_add(date, 30), "yyyy-MM-dd")), label("lblLastAnnualReturn", F.when(every(3), F.date_format(F.date_add(date, 365), "yyyy-M-d"))),
        label("lblIncorporationJurisdiction", F.concat(F.col("r_name"), F.lit(" / "), F.col("n_name"))), label("lblMinMaxDirectors", F.concat(F.lit("1 -\n"), (k % 9 + 1).cast("string"))),
        label("lblBusinessType", F.concat(F.lit("\n  With "), F.col("c_mktsegment"), F.lit("\t"))), label("lblFilingType", F.lit(" ")),
        label("lblROAddress1", F.concat(F.lit("Unit "), k.cast("string"), F.lit("<br>Main Street<BR/>"))),
        label("lblROContact", F.concat(F.lit("c/o "), F.col("c_mktsegment"))), label("lblROAddress2", F.when(every(4), "").otherwise(F.concat(F.lit("Floor "), (k % 7).cast("string")))), label("lblROAddress3", F.lit("\u00a0")),
        label("lblROCountry", F.lit("Canada")), label("lblROPostalZipCode", F.concat(F.lit("A1A "), (k % 10).cast("string"))), label("lblMAPostalZipCode", F.when(F.col("c_acctbal") >= 0, F.lit("B2B"))),
        label("lblROCity", F.concat(F.when(every(5), " ").otherwise(""), F.col("n_name"), F.lit("<br />"))),
        label("lblROProvinceState", F.concat(F.col("r_name"), F.lit(" "))),
        F.when(F.col("c_acctbal") >= 0, label("lblMACity", F.col("n_name"))).otherwise(label("lblMASameAsRegistered", F.lit("Same as Registered Office"))),
        F.lit('<span id="lblAddInfo">old</span><span id="lblAddInfo">'), F.col("c_mktsegment"), F.lit("</span>"),
    )
    row_head = F.when(_odd(k), "<TR CLASS=row>").otherwise('<tr class="rowalt">')

    def director(s: Column) -> Column:
        full = F.concat(s["s_name"], F.when(s["s_suppkey"] % 2 == 0, F.concat(F.lit("<br>"), F.col("n_name"))).otherwise(""))
        return F.concat(row_head, F.when(_odd(k), "<TD nowrap>").otherwise("<td>"), full, F.lit("</td></tr>\n"))

    listed = F.array_join(F.transform(F.coalesce("suppliers", F.array().cast("array<struct<s_suppkey:bigint,s_name:string>>")), director), "")
    directors = F.concat(
        F.lit('<a name="Directors"></a><div id="pnlCurrentDirectors"><table><tr class="ROW"><td>Director Name</td></tr><tr class="row"><td>Records Found</td><td></td></tr>'),
        listed, F.lit("</table></div>\n"),
    )
    names = F.when(
        every(13),
        F.concat(
            F.lit('<a name="Names"></a><div id=pnlPreviousCompanyNames><table><tr class="row"><td>Previous Company Name</td><td>Date</td></tr>'),
            row_head, F.lit("<td>"), F.col("name1"), F.lit("</td><td>2001-02-03</td></tr>"), row_head, F.lit("<td>"), F.col("name2"), F.lit(" &amp; S&ouml;ns</td><td>&nbsp;</td></tr></table></div>\n"),
        ),
    ).otherwise("")
    remarks = F.when(
        every(11),
        F.concat(
            F.lit('<a name="Remarks"></a><table id="tblHistoricalRemarks"><tr class="row"><td><table><tr class="row"><td>Historical Remarks</td></tr><!-- <tr class="row"><td>no</td></tr> -->'),
            row_head, F.lit('<td>Remark "'), k.cast("string"), F.lit('" on file</td></tr>'), row_head, F.lit("<td>Filed &amp;\n closed &copy; &#8212; caf&eacute;</td></tr></table></td></tr></table>\n"),
        ),
    ).otherwise("")
    html = F.concat(F.lit("<html><body>\n"), F.when(every(103), "").otherwise(labels), directors, names, remarks, F.lit('<div id="gnlfoot"><table><tr class="row"><td>footer</td></tr></table></div></body></html>'))
    return rows.select(number.alias("key"), html.alias("html"), F.lit("https://registry.example/CompanyDetails.aspx").alias("url"), "c_custkey")


def lobbyist_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, html and o_orderkey of one registration for each order."""
    # both dealt by the join's key, so that the orders are shuffled once
    rows = _dealt(table(spark, sf_dir, "orders"), "o_custkey").join(_grows(_dealt(table(spark, sf_dir, "customer"), "c_custkey")), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    prefix = F.when(k % 17 == 0, "XX").when(k % 2 == 0, "CL").otherwise("IHL")
    number = F.concat_ws("-", prefix, k.cast("string"), F.col("o_custkey").cast("string"))
    head = lambda name: F.when(k % 3 == 0, f"<P ID='{name}' class=x>").otherwise(f'<p class="x" id="{name}">')
    label = lambda name, value: F.concat(head(name), value, F.lit("</p>\n"))
    html = F.concat(
        F.lit("<html><body>\n"),
        F.when(k % 103 == 0, label("lblRegistrationNumber", F.lit(" "))).otherwise(label("lblRegistrationNumber", number)),
        F.when(k % 19 == 0, label("lblLobbyistType", F.lit("Consultant Lobbyist"))).otherwise(""),
        label("lblStatus", F.col("o_orderstatus")), label("lblRegistrationDate", F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.when(k % 23 == 0, label("lblEffectiveDate", F.lit("soon"))).otherwise(label("lblEffectiveDate", F.date_format("o_orderdate", "yyyy-M-d"))),
        F.when(k % 5 == 0, "").otherwise(label("lblContactName", F.concat(F.lit("Contact&nbsp;"), F.col("o_custkey").cast("string")))),
        label("lblFirmName", F.concat(F.lit("<b>"), F.col("c_name"), F.lit("</b> &amp; Co"))), label("lblCityF", F.lit("  ")),
        label("lblOrgDesc", F.concat(F.lit("Priority:<br>  "), F.col("o_orderpriority"), F.lit(" \t level <br/><br/>mid\n\n caf&eacute; <br>\n<br> &#x2013; end"))), F.lit("</body></html>"),
    )
    return rows.select(number.alias("key"), html.alias("html"), "o_orderkey")


def _opening(key: Column, name: str) -> Column:
    """A begin tag with an id, in shapes that browsers take: other attributes before it, other quotes or none, other elements."""
    return F.when(key % 3 == 0, f"<SPAN class=\"v\" id='{name}'>").when(key % 3 == 1, f'<div title="a > b" ID = {name}>').otherwise(f'<span id="{name}">')


def _closing(key: Column) -> Column:
    return F.when(key % 3 == 1, "</DIV>").otherwise("</span>")


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, html and o_orderkey of registrations whose labels stand in labels and hold elements of their own kind, one for each order."""
    k, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    label = lambda name, *parts: F.concat(_opening(k, name), *parts, _closing(k))
    inner = label("lblAmendedDate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    body = F.concat(
        F.lit("<table><tr><td>"), label("lblRegistrationNumber", F.lit("CL-"), text("o_orderkey")), F.lit("<td id=lblCityF>"), F.col("o_orderpriority"), F.lit("<tr><td>"),
        label("lblOrgDesc", F.lit("a"), _opening(k, "x"), F.lit("b<br>"), inner, _closing(k), F.lit("c <script>var t = '<p id=lblNone>no</p>';</script>&lt;<!-- <b id=\"lblNone\">no</b> -->d")),
        F.lit("</table>"), F.when(k % 5 == 0, F.lit("<p id='lblStatus'>open <br>still<p id='lblParticulars'>next")).otherwise(label("lblStatus", F.col("o_orderstatus"))),
    )
    return _dealt(table(spark, sf_dir, "orders"), "o_orderkey").select(F.concat(F.lit("CL-"), text("o_orderkey")).alias("key"), body.alias("html"), "o_orderkey")


PAGE = 10


def _pages_of(rows: DataFrame, key: str, line: Column, head: Column, tail: str) -> DataFrame:
    """Pages of PAGE rows by key, with the table's total and the range shown; a page is one small group."""
    total = rows.agg(F.count("*").alias("total"), F.lit(1).alias("_one"))
    grouped = rows.select(F.col(key).alias("k"), line.alias("line"), F.floor(F.col(key) / PAGE).alias("p")).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("ls"))
    first, last = F.col("p") * PAGE + 1, F.col("p") * PAGE + F.size("ls")
    mark = lambda name, value: F.concat(_opening(F.col("p"), name), F.lit("<!-- x --><i> </i>"), value, _closing(F.col("p")))
    shown = F.concat(mark("lblViewingRecords", F.concat(first.cast("string"), F.lit("-<b>"), last.cast("string"), F.lit("</b>"))), mark("lblRecordsFound", F.col("total").cast("string")))
    html = F.concat(head, shown, F.array_join(F.transform("ls", lambda x: x["line"]), ""), F.lit(tail))
    return grouped.withColumn("_one", F.lit(1)).join(total, "_one").select((F.col("p") + 1).cast("int").alias("page_no"), html.alias("html"))


def company_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, page_no, url and html of search results: all customers, ten a page."""
    rows = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    number = F.concat(F.when(k % 29 == 0, "X").otherwise(""), k.cast("string"), F.when(k % 50 == 0, "D").otherwise(""))
    cell = lambda c: F.concat(F.when(_odd(k), "<TD>").otherwise('<td class="c">'), c, F.lit("</td>"))
    anchor = F.concat(F.lit('<a id="rptCompanyNameSearchResults__ctl'), (k % PAGE + 1).cast("string"), F.lit('_lbtCompanyNumber" href="#">'), F.col("c_name"), F.lit(" &#38; <b>Co</b></a> (note)"))
    line = F.concat(
        F.when(_odd(k), "<TR CLASS=row>").otherwise('<tr class="row">'), cell(anchor), cell(F.col("c_mktsegment")), cell(F.concat(F.lit("<b> "), number, F.lit("</b>"))),
        cell(F.lit("Company")), F.when(k % 31 == 0, "").otherwise(cell(F.when(k % 2 == 0, "2004-7-3").otherwise("&nbsp;"))), F.lit("</tr>\n"),
    )
    pages = _pages_of(rows, "c_custkey", line, F.lit('<html><table id="tableSearchResults"><tr><td>'), '</table><div id="gnlfoot"></div></html>')
    return pages.select(F.concat(F.lit("n"), F.col("page_no").cast("string")).alias("key"), "page_no", F.lit("https://registry.example/CompanyNameNumberSearch.aspx").alias("url"), "html")


def lobbyist_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_no and html of lobbyist search results: all customers, ten a page."""
    k = F.col("c_custkey")
    cells = [F.col("c_name"), F.lit("Consultant"), F.lit(" "), F.col("c_mktsegment"), F.lit("2020-01-02"), F.lit("Active")]
    anchor = F.concat(F.lit('<a id="rptSearchResults__ctl'), (k % PAGE + 1).cast("string"), F.lit('_lbtRegNum">CL-'), k.cast("string"), F.lit("</a> &sect;"))
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in (anchor, *cells)], F.lit("</tr>"))
    return _pages_of(table(spark, sf_dir, "customer"), "c_custkey", line, F.lit("<html><table>"), "</table></html>")
