import datetime
import html

import pytest
from pyspark.sql import functions as F

from regmill.functions import text
from regmill.operators.search import limit_guard


def values(spark, make, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_collapse_ws_knows_unicode_blanks(spark):
    assert values(spark, text.collapse_ws, ["  a \n\t b ", " a　b ", "\x1ca\x85b", "", None]) == ["a b", "a b", "a b", "", None]


def test_tolerant_date(spark):
    d = datetime.date
    got = values(spark, text.tolerant_date, ["2004-07-03", "2004-7-3", " 2004-7-3", "04-7-3", "2004-13-1", "2004-02-30", "not a date", "", None, "12004-1-1"])
    assert got == [d(2004, 7, 3), d(2004, 7, 3)] + [None] * 8


def test_keys_and_paths(spark):
    assert values(spark, text.shard_key, ["2D", "7", "abc", "", "é1"]) == ["2D", "70", "AB", "00", "É1"]
    assert values(spark, text.safe_key, ["a/b c", "é.x-1_2", "IHL-867"]) == ["a_b_c", "é.x-1_2", "IHL-867"]
    assert values(spark, lambda c: text.page_path(F.lit("companies"), F.lit("list"), c), ["12D"]) == ["companies/12/_list/12D.list.html.gz"]


def test_names_and_quotes(spark):
    assert values(spark, lambda c: text.split_person_name(c)[0], ["A B C", "A"]) == ["A", "A"]
    assert values(spark, lambda c: text.split_person_name(c)[1], ["A B C", "A"]) == ["B C", None]
    for x in ["x", "it's", 'say "a"', "both ' and \"", "back\\slash"]:
        assert values(spark, text.quoted, [x]) == [repr(x)]


def test_human_bytes(spark):
    sizes = ["0", "1023", "1024", "1280", "1536", "1048576", "5368709120", str(3 * 1024**4), str(5000 * 1024**4)]
    assert values(spark, lambda c: text.human_bytes(c.cast("long")), sizes) == ["0.0B", "1023.0B", "1.0KB", "1.2KB", "1.5KB", "1.0MB", "5.0GB", "3.0TB", "5000.0TB"]


def test_messages_and_labels(spark):
    total = lambda c: text.result_message(c.cast("long"), 2)
    assert values(spark, total, ["0", "1", "2", "3"]) == ["No matches.", "Showing all 1 match.", "Showing all 2 matches.", "Showing first 2 of 3 matches. Refine your query."]
    assert values(spark, lambda c: text.location_label(F.lit("St"), c), [" NL ", "", None]) == ["St, NL", "St", "St"]
    assert values(spark, lambda c: text.location_label(c, F.lit("NL")), [None, "A"]) == [", NL", "A, NL"]
    assert values(spark, lambda c: text.display_title(c, F.lit("f"), F.lit("n")), ["", "c"]) == ["f", "c"]


def test_address_block(spark):
    row = spark.sql("SELECT named_struct('contact','c','line1','','line2',null,'line3','l3','city','T','province_state','NL','country','CA','postal_zip',null) AS a, named_struct('contact','','line1','','line2','','line3','','city','','province_state','','country','','postal_zip','') AS b")
    r = row.select(text.address_block("a").alias("a"), text.address_block("b").alias("b")).first()
    assert (r.a, r.b) == ("c\nl3\nT, NL\nCA", "")


def test_ilike_wildcards_and_backslash(spark):
    find = lambda q: values(spark, lambda c: text.contains_ignoring_case(c, q), ["Foo Bar", "100%", "a\\b", None])
    assert find("o b") == [True, False, False, None]
    assert find("f_o") == [True, False, False, None]
    assert find("\\") == [False, False, True, None]


def test_entities(spark):
    texts = ["a &amp; b", "&amp;lt;", "x&nbsp;y", "R & D", None, "&eacute;&#233;&#xE9;&#x2014; &copy 2020 &#150; &#0; &#x110000; &#xD800; &notit; &bogus; &#; &#x; &", "&NotEqualTilde;x&#38;amp;", "&AMP;&ampx;", "&#1;&#xfffe;z"]
    assert values(spark, text.decode_entities, texts) == [x if x is None else html.unescape(x) for x in texts]


def test_limit_guard():
    assert limit_guard(1) == 1 and limit_guard(500) == 500
    for bad in (0, 501):
        with pytest.raises(ValueError):
            limit_guard(bad)
