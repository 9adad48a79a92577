"""Extraction from hand-made pages."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from regmill.functions import elements as E
from regmill.functions import labels as L
from regmill.operators import company, lobbyist, planning
from regmill.plans import queries as registry
from regmill.plans import render


def one(spark, make, html):
    return spark.createDataFrame([(html,)], "html string").select(make("html").alias("v")).first().v


def test_label_map(spark):
    html = (
        '<span id="lblA"> x <br> y<BR/>z </span><SPAN ID="lblB" class=c></SPAN><span id="lblC">a<b>b</b></span><span class="c" id="lblD">no</span>'
        "<span id='lblE'>no</span><span id=\"lblA\">last &amp; best</span><!-- <span id=\"lblF\">in a comment</span> --><span id=\"other\">no</span>"
    )
    assert one(spark, L.label_map, html) == {"lblB": "", "lblA": "last &amp; best", "lblF": "in a comment"}
    assert one(spark, L.label_map, "") == {}


def test_label_map_takes_long_bodies(spark):
    found = one(spark, L.label_map, '<span id="lblA">' + "x" * 200_000 + "</span>" + '<span id="lblB">' + "<br>" * 50_000 + "y</span>")
    assert len(found["lblA"]) == 200_000 and found["lblB"] == "y"


def test_lobbyist_label_map(spark):
    html = '<p class="q" id="lblA">one<br/>  two \t 2 <b>three &amp; 4</b></p><div id="lblA"> </div><span id="LBLB">no</span><td id="lblC"><br></td><span id="xlblD">no</span>'
    assert one(spark, L.lobbyist_label_map, html) == {"lblA": "one\ntwo 2\nthree & 4"}


@pytest.mark.parametrize(
    "html,labels",
    [
        ('<div id="lblOrgDesc">a<div>b</div>c</div>', {"lblOrgDesc": "a\nb\nc"}),
        ('<div id="lblA">x <span id="lblB">y</span></div>', {"lblA": "x\ny", "lblB": "y"}),
        ("<p id='lblA'>q</p><P x=1 ID = lblB>r</P>", {"lblA": "q", "lblB": "r"}),
        ("""<DIV title="a > id='lblX' b" data-id="lblZ" ID=lblQ>1 < 2 <!-- <b id="lblC">c</b> --><script>x="<p id=lblS>"</script>z</DIV>""", {"lblQ": "1 < 2\nz"}),
        ("<table><tr><td id=lblA>a<td id=lblB>b<tr><td id=lblC>c</table>d", {"lblA": "a", "lblB": "b", "lblC": "c"}),
        ('<span id="lblA">x<div>y</span>z</div>w</span>v', {"lblA": "x\ny\nz\nw"}),
        ('<p id="lblA">a<p id="lblB">b<div>c</div>', {"lblA": "a", "lblB": "b"}),
        ("</b></i><ul><li id=lblA>q<li id=lblB>r</ul><b id=lblC>open", {"lblA": "q", "lblB": "r", "lblC": "open"}),
        ('<input id="lblI"/>t<span id="lblT"/>u<br id=lblU>', {}),
        ('<p id="lbl1" x="unclosed>a</p><p id="lbl2">b</p>', {"lbl1": "a", "lbl2": "b"}),
        ('<i id="lblA">x<b id="lblB">y</i>z', {"lblA": "x\ny", "lblB": "y"}),
    ],
)
def test_labels_of_any_shape(spark, html, labels):
    assert one(spark, L.lobbyist_label_map, html) == labels


def test_labels_of_large_pages(spark):
    html = '<div id="lblA">' + "x" * 700_000 + "<i>" * 500 + "</i>" * 500 + '<span id="lblB">' + "y z " * 1000 + "</span>" + "<p>t</p>" * 3000 + "</div>"
    found = one(spark, L.lobbyist_label_map, html)
    assert len(found["lblB"]) == 3999 and len(found["lblA"]) == 700_000 + 1 + 3999 + 3000 * 2


def test_labels_of_deeply_nested_pages(spark):
    start = time.monotonic()
    found = one(spark, L.lobbyist_label_map, "<div id='lblA'>" + "<i>" * 20_000 + "x" + "</i>" * 20_000 + "</div><p id=lblB>y")
    assert found == {"lblA": "x", "lblB": "y"} and time.monotonic() - start < 60


def test_rendered_pages_are_dealt_to_all_tasks(spark, sf):
    for pages in (render.company_pages, render.lobbyist_pages, render.nested_pages):
        assert pages(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_lobbyist_text_keeps_blank_lines_and_hard_blanks(spark):
    html = '<div id="lblA">\u00a0 a\n\n b&nbsp;c \r\n<br/>\n<br/><i></i> caf&eacute;&#233;&#x2013;\t \t1 &copy 2 &amp;lt;\u00a0</div>'
    assert one(spark, L.lobbyist_label_map, html) == {"lblA": "a\n\nb\u00a0c\n\n\n\ncaféé– 1 © 2 &lt;"}


LABELS = '<span id="lblCompanyName">{name}</span><span id="lblCompanyNumber">{number}</span><span id="lblCorporationType">{kind}</span>'


@pytest.mark.parametrize(
    "html,error",
    [
        (LABELS.format(name="N", number="1", kind="Company"), None),
        ("<html></html>", company.NOT_DETAILS),
        ('<span id="lblCompanyName">N</span>', company.NOT_DETAILS),
        (LABELS.format(name="N", number=" ", kind="Company"), company.NO_NUMBER),
        (LABELS.format(name=" ", number="", kind="x"), company.NO_NUMBER),
        (LABELS.format(name="<br>", number="1", kind="x"), company.NO_NAME),
        (LABELS.format(name="N", number="1", kind="It's"), 'unknown CorporationType: "It\'s"'),
        (LABELS.format(name="N", number="1", kind=""), "unknown CorporationType: ''"),
        (None, None),
    ],
)
def test_error_ladder(spark, html, error):
    assert one(spark, lambda c: company.parse_error(L.label_map(c)), html) == error or html is None


def test_company_fields(spark):
    html = LABELS.format(name="N &amp; Co", number="2D", kind="Condominium") + (
        '<span id="lblCategory">Elsewhere</span><span id="lblIncorporationDate">2004-7-3</span><span id="lblRegistrationDate"> </span><span id="lblROCity">T<br></span>'
        '<span id="lblMASameAsRegistered">Same</span>'
    )
    df = spark.createDataFrame([("k", html)], "key string, html string")
    c = company.parse_companies(df).first().company
    assert (c.number, c.name, c.category, c.incorporation_date, c.registration_date) == ("2D", "N &amp; Co", None, datetime.date(2004, 7, 3), None)
    assert c.registered_office.city == "T" and c.ma_same_as_registered and c.directors is None
    flags = company.parse_companies(df).select(company.address_is_empty("company.mailing_address").alias("m"), company.address_is_empty("company.registered_office").alias("r")).first()
    assert (flags.m, flags.r) == (True, False)


PANEL = '<a name="D"></a><div id="pnlCurrentDirectors"><table>{rows}</table></div><a name="x"></a><table><tr class="row"><td>foreign</td></tr></table>'


def test_directors(spark):
    rows = (
        '<TR CLASS=row><TD nowrap>Ann<BR>Lee &amp; Son</TD></TR><tr class="ROW"><td>not</td></tr><tr class=rowing><td>not</td></tr>'
        '<tr valign="top" class="rowalt"><td>\n Single </td></tr><tr class="row"><td>2 Records Found</td></tr><tr class="row"><td>a</td><td>b</td></tr><tr class="row"><td> </td></tr>'
        '<!-- <tr class="row"><td>hidden</td></tr> --><tr class="row"><td>DIRECTOR NAME</td></tr>'
    )
    found = one(spark, company.directors, PANEL.format(rows=rows))
    assert [(d.seq, d.full_name, d.first_name, d.last_name) for d in found] == [(1, "Ann Lee & Son", "Ann", "Lee & Son"), (2, "Single", "Single", None)]
    assert not one(spark, company.directors, "<html></html>")


def test_previous_names_and_remarks(spark):
    names = '<div id=pnlPreviousCompanyNames><table><tr class="row"><td>Previous Name</td></tr><tr class="row"><td>Old "A" Ltd</td><td>2001-02-03</td></tr><tr class="rowalt"><td>B</td></tr></table></div><div id="gnlfoot">'
    assert [(n.seq, n.name, n.effective_date) for n in one(spark, company.previous_names, names)] == [(1, 'Old "A" Ltd', datetime.date(2001, 2, 3)), (2, "B", None)]
    panel = '<table id="tblHistoricalRemarks"><tr class="row"><td><table><tr class="row"><td>Historical Remarks</td></tr><tr class="row"><td>one</td></tr><tr class="rowalt"><td>two\n 2</td></tr></table></td></tr></table><div id="gnlfoot">'
    assert [r.remark for r in one(spark, company.remarks, panel)] == ["one", "two 2"]
    assert [r.remark for r in one(spark, lambda c: company.remarks(c, include_panel_text=True), panel)] == ["one two 2", "one", "two 2"]


HITS = """<table id="tableSearchResults"><tr><td><span id="lblRecordsFound"> 12 </span><span id="lblViewingRecords">1-10</span></td></tr>
<TR class=row><TD><a id="rptCompanyNameSearchResults__ctl1_lbtCompanyNumber">N</a></TD><td>Active</td><td>1D</td><td>Company</td><td>&nbsp;</td></tr>
<tr><td><a id="rptCompanyNameSearchResults__ctl2_lbtCompanyNumber">N</a></td><td>Active</td><td>D1</td><td>Company</td><td>2</td></tr>
<tr><td><a id="rptCompanyNameSearchResults__ctl3_lbtCompanyNumber">N</a></td><td>Active</td><td>1</td><td>Company</td></tr></table>"""


def test_search_hits_and_classification(spark):
    assert [tuple(h) for h in one(spark, company.search_hits, HITS)] == [(1, "N", "Active", "1D", "Company", None)]
    assert tuple(one(spark, company.search_totals, HITS)) == (12, "1-10")
    assert tuple(one(spark, company.search_totals, "<p>")) == (0, "0-0")
    kind = lambda url, html: one(spark, lambda c: company.classify_page(F.lit(url), c), html)
    assert [kind("x/CompanyDetails.aspx?a", HITS), kind("x", HITS), kind("x", "<p>"), kind("x", '<table id="tableSearchResults"></table>')] == ["details", "hits", "empty", "empty"]


def test_hit_names_are_the_anchors_text(spark):
    row = '<table id="tableSearchResults"><tr><td>x <a href="#" id="rptCompanyNameSearchResults__ctl4_lbtCompanyNumber">N&eacute; <b>&amp;</b> Co</a> note</td><td></td><td>1</td><td>Company</td><td></td></tr></table>'
    assert [(h.row_index, h.name, h.status) for h in one(spark, company.search_hits, row)] == [(4, "Né & Co", None)]
    cells = "<td>c</td>" * 6
    row = f'<tr><td><a id="rptSearchResults__ctl2_lbtRegNum">CL-1</a> (old)</td>{cells}</tr>'
    assert [(h.row_index, h.registration_number, h.name) for h in one(spark, lobbyist.search_hits, row)] == [(2, "CL-1", "c")]


def extractions(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("regexp_extract_all")


def test_labels_are_extracted_once_a_page(spark, sf):
    for name, most in (("search_lobbyists", 1), ("directors", 1), ("search_companies", 1), ("lobbyist_parse", 1), ("company_parse", 1), ("company_with_children", 0)):
        assert extractions(registry.QUERIES[name](spark, sf)) <= most, name


def test_page_key(spark):
    assert one(spark, company.page_key, '<SPAN id="lblCompanyNumber" c=1> 2D\n</SPAN><span id="lblCompanyNumber">3</span>') == "2D"
    assert one(spark, company.page_key, '<span id="lblCompanyNumber"> </span>') is None


def test_lobbyists(spark):
    html = '<span id="lblRegistrationNumber">cl-1-2</span><span id="lblstatus">A</span><span id="lblStatus">B</span><p id="lblOrgDesc">x<br>y é</p>'
    rows = lobbyist.parse_lobbyists(spark.createDataFrame([("k", html), ("n", "<p>")], "key string, html string")).orderBy("key").collect()
    r = rows[0].lobbyist
    assert (r.registration_number, r.lobbyist_type, r.status, r.organization_description) == ("cl-1-2", "Consultant", "A", "x\ny é")
    assert rows[1].lobbyist is None and rows[1].parse_error == lobbyist.NO_NUMBER
    json = spark.createDataFrame([(r.raw_fields,)], "m map<string,string>").select(lobbyist.raw_fields_json("m").alias("j")).first().j
    assert "é" in json and "\\n" in json


def test_lobbyist_paging(spark):
    page = lambda shown, total: f'<span id="lblViewingRecords">{shown}</span><span id="lblRecordsFound">{total}</span>'
    assert tuple(one(spark, lobbyist.viewing_range, page("1-10", "727"))) == (1, 10)
    assert [one(spark, lobbyist.has_next_page, page(*x)) for x in (("1-10", "727"), ("721-727", "727"), ("x", "7"), ("1-2", "many"))] == [True, False, False, False]
    assert one(spark, lobbyist.total_records, page("", "n/a")) is None


def test_marks_of_any_shape(spark):
    html = '<SPAN class="x" id="lblRecordsFound"> 1<b>2</b> </SPAN><b ID=lblViewingRecords>1-<!-- x -->10</b><i id="lblRecordsFound">99</i>'
    assert tuple(one(spark, lobbyist.page_marks, html)) == (12, 1, 10, True)
    assert (one(spark, lobbyist.total_records, html), tuple(one(spark, lobbyist.viewing_range, html)), one(spark, lobbyist.has_next_page, html)) == (12, (1, 10), True)
    assert one(spark, lobbyist.viewing_range, html.replace("10", "x")) is None
    table = "<p id=lblRecordsFound>7</p><TABLE x=y id='tableSearchResults'><tr><td><b id='lblRecordsFound'>3</b><table><tr><td></table><i id=lblViewingRecords>1-3</i></table><p id=lblViewingRecords>no</p>"
    assert tuple(one(spark, company.search_totals, table)) == (3, "1-3")
    assert tuple(one(spark, company.search_totals, "<p id=lblRecordsFound>7</p>")) == (0, "0-0")


def test_index_is_complete_or_not(spark):
    anchor = '<tr><td><a id="rptSearchResults__ctl{0}_lbtRegNum">CL-{0}</a></td>' + "<td>c</td>" * 6 + "</tr>"
    page = lambda n, shown, hits: (n, f'<span id="lblViewingRecords">{shown}</span><span id="lblRecordsFound">3</span><table>{"".join(anchor.format(h) for h in hits)}</table>')
    complete = lambda *rows: planning.index_complete(spark.createDataFrame(rows, "page_no int, html string")).first().complete
    first, last = page(1, "1-2", (1, 2)), page(2, "3-3", (3,))
    assert complete(first, last)
    assert complete(last, first, last)
    ten = lambda n, at, shown: (n, page(n, shown, range(at, at + 10))[1].replace(">3<", ">30<"))
    pages = [ten(1, 1, "1-10"), ten(2, 11, "11-20"), ten(3, 21, "21-30")]
    assert complete(*pages) and not complete(pages[0], pages[0], pages[2]) and not complete(pages[0], (2, pages[0][1]), pages[2]) and not complete(*pages[1:])
    faults = planning.index_gaps(spark.createDataFrame([pages[0], pages[0], pages[2], (9, pages[1][1]), (12, pages[1][1])], "page_no int, html string")).collect()
    assert sorted((f.problem, f.first, f.last) for f in faults if f.problem != "repeated") == [("end", 3, 3), ("fetched again", 1, 1), ("missing", 2, 2), ("missing", 4, 8), ("missing", 10, 11), ("no end", 12, 12)]
    assert sorted(f.registration_number for f in faults if f.problem == "repeated") == sorted(f"CL-{i}" for i in range(11, 21))
    assert planning.index_gaps(spark.createDataFrame([], "page_no int, html string")).count() == 0
    numbers = spark.createDataFrame([(n,) for n in (2, 3, 7, 7, 50, 0)], "page_no long").repartition(3)
    assert sorted(map(tuple, planning.missing_ranges(numbers).collect())) == [(1, 1), (4, 6), (8, 49)]
    assert not complete(first) and not complete(last) and not complete(first, page(3, "3-3", (3,))) and not complete(first, page(2, "3-3", ()))


def test_pages_of_one_company(spark):
    pages = spark.createDataFrame([("a", LABELS.format(name="N", number=n, kind="Company")) for n in ("1", " 2D ", "3")], "key string, html string")
    assert [c.company.number for c in company.parse_companies(company.pages_of(pages, "2D")).collect()] == ["2D"]


def test_planning(spark):
    pages = spark.createDataFrame([("69236", HITS)], "key string, html string")
    assert [tuple(r) for r in planning.drill_targets(pages).collect()] == [("69236", 1, "1D")]
    assert planning.saved_ids(pages).first().ids_saved == ["69236[list]", "1D"]
    outcomes = spark.createDataFrame([("detail", None), ("hits", ["l", "a", "b"]), ("hits", []), ("boom", None), (None, None), ("cached", None)], "kind string, ids_saved array<string>")
    assert tuple(planning.outcome_stats(outcomes).first()) == (6, 1, 2, 2, 0, 1, 2)
    manifest = spark.createDataFrame([("2",), ("4",)], "key string")
    assert sorted(r.key for r in planning.crawl_frontier(spark, manifest, 1, 6).collect()) == ["1", "3", "5"]
    assert planning.crawl_frontier(spark, manifest, 1, 6, rescrape=True).count() == 5


def test_the_frontier_by_bitmaps(spark):
    keys = ["2", "02", "+3", "4D", "x", None, "-1", "0", "32768", "32769", "65536", "65537", "9223372036854775808", "2"]
    manifest = spark.createDataFrame([(k,) for k in keys], "key string").unionByName(spark.range(100_000, 140_000).selectExpr("CAST(id AS STRING) AS key"))
    for start, stop in ((1, 10), (-3, 4), (-40_000, -39_990), (32_760, 32_780), (65_530, 65_545), (99_990, 140_010), (7, 7), (9, 3)):
        got = sorted(r.key for r in planning.bitmap_frontier(spark, manifest, start, stop).collect())
        assert got == sorted(r.key for r in planning.crawl_frontier(spark, manifest, start, stop).collect())
    assert planning.number_bitmaps(manifest).count() == 6


def test_tags_that_a_task_remembers_are_forgotten_when_they_are_many(spark, monkeypatch):
    html = "".join(f"<p class=c{i % 7} id=lblA{i % 5}>x{i}</p><br id=lblB{i}>" for i in range(60)) + "<P ID=lblLong title='" + "y" * 300 + "'>z"
    want = [tuple(e) for e in one(spark, lambda h: E.elements(h, "lbl.*"), html)]
    assert len(want) == 121 and want[-1][2:] == ("lblLong", "z")
    monkeypatch.setattr(E, "TAGS", 2)
    assert [tuple(e) for e in one(spark, lambda h: E.elements(h, "lbl.*"), html)] == want


def test_text_that_nothing_is_done_to_is_left_as_it_is(spark):
    texts = ["", " ", "a", "a b", "a  b", " a", "a ", "a\n", "\u00a0a", "a\u2003b", "a\x85", "a\tb", "a&amp;b", "a<>b", "a\x1cb", "a\x00b", "\u2028", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.lines_of(F.col("t")).alias("a"), L._smooth(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and [r.a for r in rows][2:5] == ["a", "a b", "a b"]
