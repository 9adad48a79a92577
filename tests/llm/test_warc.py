import base64
import hashlib
import random

from regmill.llm import queries, warc


def expected(rows, least=0):
    largest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            body = (html or "").encode()
            largest[body] = max(largest.get(body, page_id), page_id)
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit = page_id is not None and len(body) >= least and page_id < largest[body]
        yield page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", largest[body] if revisit else None


def check(spark, rows, least=0):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_and_index(df, least).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expected(rows, least), key=key)
    order = [(r.part, r.place) for r in got]
    assert order == sorted(order)
    history = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in got]
    assert history == sorted(history)


def test_round_trip(spark):
    hot = "<html>the same page</html>"
    rows = [(i, f"http://www.a{i % 3}.example.com/x?{i % 5}", hot if i % 3 else f"<p>{i} é \r\n\r\nWARC/1.1\r\n</p>") for i in range(60)]
    rows += [(100, None, None), (101, "no scheme", ""), (None, "http://b/ \r\nInjected: x", hot), (59, "http://b/", hot), (103, "HTTP://user@B:8080/Q#f", "x")]
    check(spark, rows)
    check(spark, rows, least=20)


def test_a_page_larger_than_an_archive_and_many_ranges(spark, tmp_path, monkeypatch):
    """Archives stay within their bytes but for one that holds a single larger record; small ranges merge to the same history."""
    rows = [(i, f"http://h{i % 7}.org/{i % 3}", f"<p>{i} " + "x" * (i % 5 * 700)) for i in range(200)] + [(500, "http://h1.org/0", "y" * 300_000), (501, "http://h1.org/0", "z" * 90_000)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, part string, archive int").repartition(2)
    folder = str(tmp_path / "warc")
    warc.write(df, folder, archive_bytes=40_000)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "warc").iterdir() if f.name.startswith("part-"))
    assert sum(n > 40_000 for n in sizes) == 2 and len(sizes) > 10
    got = warc.merge(warc.read(spark, folder), rows_per_range=20).collect()
    assert len({r.part for r in got}) > 5 and len(got) == len(rows)
    history = [(r.url_key, r.captured_at, r.page_id) for r in got]
    assert history == sorted(history) and [(r.part, r.place) for r in got] == sorted((r.part, r.place) for r in got)


def test_the_merge_takes_runs_in_their_own_order(spark, tmp_path):
    """Pieces are put together by the run and the place in it: a run that is in no order makes a history that is in none."""
    rows = [(i, f"http://h{i * 7 % 10}.org/", "x") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write(df, str(tmp_path / "w"))
    runs = warc.read(spark, str(tmp_path / "w"))
    history = lambda captures: [(r.url_key, r.captured_at, r.page_id) for r in warc.merge(captures).collect()]
    assert history(runs) == sorted(history(runs))
    turned = history(runs.selectExpr("* except (in_run)", "-in_run as in_run"))
    assert sorted(turned) == history(runs) != turned


def test_record_ids_differ(spark, tmp_path):
    df = spark.createDataFrame([(None, "http://a.b", "x"), (None, "http://a.b", "x"), (4, "http://a.b", "x"), (4, "http://a.b", "x"), (3, "http://a.b", "x")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    heads = [h for f in (tmp_path / "w").glob("part-*") for _, _, h, _ in warc.records(f.read_bytes())]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == 5 and {h["warc-refers-to"] for h in heads if "warc-refers-to" in h} <= set(ids)


def test_empty(spark):
    assert warc.archive_and_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_on_pages(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op2_warc(spark, sf).collect()}
    assert got == set(expected(rows))


def test_loser_tree():
    rng = random.Random(5)
    for k in range(0, 12):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("HTTP://www.Example.com:80/A?b#c") == "com,example)/a?b"
    assert warc.url_key("https://m.x.org") == "org,x,m)/"
