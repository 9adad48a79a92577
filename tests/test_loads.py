"""Raw zone, files, replace-by-key loads and the stream."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from regmill.operators import company, planning, search, upsert
from regmill.sources import counts, files, pages, storage
from regmill.sources.schemas import TABLES, check_constraints, conform
from regmill.streaming.incremental import incremental_ingest
from regmill.plans import queries as registry
from regmill.streaming import incremental, manifest
from regmill.streaming.manifest import ingest_changes
from regmill.streaming.outcomes import OUTCOMES, count_outcomes, outcomes_so_far


def page(number, name="N", directors=(), kind="Company"):
    rows = "".join(f'<tr class="row"><td>{d}</td></tr>' for d in directors)
    return f'<span id="lblCompanyName">{name}</span><span id="lblCompanyNumber">{number}</span><span id="lblCorporationType">{kind}</span><div id="pnlCurrentDirectors"><table>{rows}</table></div><div id="gnlfoot">'


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, html string")


def state(store, name):
    drop = ["ingested_at", "id", "source_html_sha256"]
    return sorted(map(str, (r.asDict() for r in store.table(name).drop(*drop).collect())))


@pytest.fixture
def store(spark, tmp_path):
    return upsert.Store(spark, str(tmp_path / "tables"))


def test_loading_twice_changes_the_log_only(spark, store):
    batch = frame(spark, [("1", page("1", directors=["A B", "C"])), ("2", page("2")), ("bad", "<p>")])
    assert store.ingest(batch, "company") == 1
    before = {n: state(store, n) for n in TABLES}
    assert store.ingest(batch, "company") == 2
    after = {n: state(store, n) for n in TABLES}
    assert {n for n in TABLES if before[n] != after[n]} == {"ingest_log"}
    log = store.table("ingest_log").orderBy("id").collect()
    assert [r.id for r in log] == [1, 2, 3, 4, 5, 6] and [r.record_key for r in log] == ["1", "2", "bad"] * 2
    assert upsert.ok_err_counts(store.table("ingest_log")).first() == (4, 2)
    assert {r.rule: r.violations for r in check_constraints(store.table("companies"), "companies").collect() if r.violations} == {}


def test_children_shrink_and_failed_pages_keep_rows(spark, store):
    store.ingest(frame(spark, [("1", page("1", directors=["A B", "C"])), ("2", page("2", directors=["D"]))]), "company")
    store.ingest(frame(spark, [("1", page("1", "New")), ("2", page("2", kind="?"))]), "company")
    assert {(r.number, r.name) for r in store.table("companies").collect()} == {("1", "New"), ("2", "N")}
    assert [(r.company_number, r.full_name) for r in store.table("company_directors").collect()] == [("2", "D")]


def test_two_pages_of_one_number(spark, store):
    store.ingest(frame(spark, [("z", page("7", "late")), ("7", page("7", "own")), ("a", page("8", "low")), ("b", page("8", "high"))]), "company")
    assert {(r.number, r.name) for r in store.table("companies").collect()} == {("7", "own"), ("8", "high")}
    assert store.table("ingest_log").count() == 4


def test_single_pages_and_kinds(spark, store):
    store.ingest_one("company", "1", page("1"))
    store.ingest_one("lobbyist", "x", '<p id="lblRegistrationNumber">CL-1</p>')
    assert store.table("companies").count() == store.table("lobbyist_registrations").count() == 1
    assert store.table("ingest_log").count() == 0
    with pytest.raises(ValueError, match="unknown ingest kind"):
        store.ingest_one("other", "1", "")


def test_constraints_report_violations(spark):
    rows = spark.createDataFrame([("1", None, "Company"), ("1", "N", None)], "number string, name string, corporation_type string")
    found = {r.rule: r.violations for r in check_constraints(conform(rows, "companies"), "companies").collect()}
    assert (found["name is null"], found["corporation_type is null"], found["number repeated"], found["ingested_at is null"]) == (1, 1, 1, 0)


def test_company_with_children_and_lookup(spark, store):
    store.ingest(frame(spark, [("1", page("1", directors=["A B", "C"])), ("2", page("2"))]), "company")
    t = store.table
    full = {r.number: r for r in search.company_with_children(t("companies"), t("company_directors"), t("company_previous_names"), t("company_historical_remarks")).collect()}
    assert [(d.seq, d.full_name) for d in full["1"].directors] == [(1, "A B"), (2, "C")] and full["2"].directors is None
    assert search.key_lookup(t("companies"), "number", "3").count() == 0
    assert [r.full_name for r in search.lookup_children(t("company_directors"), "1").collect()] == ["A B", "C"]


def _gz(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode(), mtime=0))


def test_scans_of_gzipped_files(spark, tmp_path):
    _gz(tmp_path / "companies/2D/2D.html.gz", "line 1\nline 2 é\n")
    _gz(tmp_path / "companies/10/100%25+ x.html.gz", "x")
    _gz(tmp_path / "companies/12/_list/12.list.html.gz", "listed")
    found = {r.key: r.html for r in pages.scan_detail_pages(spark, str(tmp_path / "companies")).collect()}
    assert found == {"2D": "line 1\nline 2 é\n", "100%25+ x": "x"}
    assert [(r.key, r.html) for r in pages.scan_list_pages(spark, str(tmp_path / "companies/12/_list")).collect()] == [("12", "listed")]
    assert tuple(pages.landing_size(spark, str(tmp_path / "none")).first()) == (0, 0)


def test_landing_replaces_by_key(spark, tmp_path):
    a = str(tmp_path / "a")
    make = lambda rows: spark.createDataFrame(rows, "registry string, kind string, key string, html string, url string")
    pages.land_pages(make([("c", "detail", "00", "one", ""), ("c", "list", "00", "l", ""), ("c", "detail", "9/", "other", "")]), a)
    pages.land_pages(make([("c", "detail", "00", "two", ""), ("c", "detail", "00", "three", "")]), a)
    assert len(storage.Tables(spark, a).state()["tables"]["pages"]["runs"]) == 2
    got = sorted((r.kind, r.key, r.html, r.shard) for r in pages.landed(spark, a).collect())
    assert got == [("detail", "00", "two", "00"), ("detail", "9_", "other", "9_"), ("list", "00", "l", "00")]
    assert [r.html for r in pages.landed_page(spark, a, "c", "detail", "9/").collect()] == ["other"]
    kept, gone = pages.drop_pages(pages.landed(spark, a).where("key = '00'"), spark.createDataFrame([("list", "00"), ("list", "x")], "kind string, key string"))
    assert (kept.count(), gone.count()) == (1, 1)


def test_removed_pages_are_gone_before_and_after_a_merge(spark, tmp_path):
    a = str(tmp_path / "a")
    make = lambda rows: spark.createDataFrame(rows, "registry string, kind string, key string, html string, url string")
    keys = lambda *rows: spark.createDataFrame(rows, "registry string, kind string, key string")
    left = lambda: sorted((r.registry, r.kind, r.key, r.html) for r in pages.landed(spark, a).collect())
    assert pages.remove_pages(spark, a, keys(("c", "detail", "1"))).count() == 0 and left() == []
    pages.land_pages(make([(r, k, n, r + k + n, "") for r in "cd" for k in ("detail", "list") for n in ("1", "2/")]), a)
    pages.merge_pages(spark, a)
    gone = pages.remove_pages(spark, a, keys(("c", "detail", "2/"), ("c", "detail", "2/"), ("c", "list", "9"), ("d", "list", "1"))).collect()
    assert sorted(map(tuple, gone)) == [("c", "detail", "2_"), ("d", "list", "1")]
    want = sorted((r, k, n, r + k + n.replace("_", "/")) for r in "cd" for k in ("detail", "list") for n in ("1", "2_") if (r, k, n) not in (("c", "detail", "2_"), ("d", "list", "1")))
    assert left() == want and pages.landed_page(spark, a, "d", "list", "1").count() == 0
    pages.merge_pages(spark, a)
    assert left() == want and [r.html for r in pages.landed_page(spark, a, "d", "list", "2/").collect()] == ["dlist2/"]
    pages.land_pages(make([("d", "list", "1", "back", "")]), a)
    assert ("d", "list", "1", "back") in left() and pages.has_page(keys(("d", "list", "1"), ("x", "list", "1")), pages.landed(spark, a)).count() == 1


def test_csv_and_error_log(spark, tmp_path):
    schema = "a string, d date, b boolean, n int"
    rows = spark.sql("SELECT 'say \"x\",\n\\\\ y' AS a, date'2004-07-03' AS d, true AS b, 1 AS n UNION ALL SELECT null, null, false, null UNION ALL SELECT 'é', null, null, 3")
    files.write_typed_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(str, files.read_typed_csv(spark, str(tmp_path / "csv"), schema).collect())) == sorted(map(str, rows.collect()))
    log = tmp_path / "log"
    log.mkdir()
    (log / "e.jsonl").write_text('{"number": 7, "error": "x"}\n\nnot json\n{"error": "y"}\n{"number": "3"}\n{"number": 7}\n{"number": 1.5}\n')
    assert [r.number for r in files.read_error_log(spark, str(log)).collect()] == [3, 7]
    assert files.read_error_log(spark, str(tmp_path / "none")).count() == 0


def test_csv_keeps_white_space_at_the_ends_and_empty_texts(spark, tmp_path):
    texts = [None, "", "\\", "\\\\", "\\\n", "\\N", " ", "  a", "a  ", "\ta\n", "\n", "\r\n", "\ra\r", "\u00a0a\u2003", "\x00a\x00", '"', '""', ',",\n"', "null"]
    rows = spark.createDataFrame([(i, t, d) for i, t in enumerate(texts) for d in texts], "n int, a string, `b.c` string").repartition(3)
    files.write_typed_csv(rows, str(tmp_path / "csv"))
    got = files.read_typed_csv(spark, str(tmp_path / "csv"), rows.schema)
    assert got.columns == rows.columns and sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))


def test_stream_takes_new_files_once(spark, store, tmp_path):
    raw, marks = tmp_path / "raw", str(tmp_path / "marks")
    _gz(raw / "1/1.html.gz", page("1"))
    _gz(raw / "1/_list/1.list.html.gz", page("9"))
    incremental_ingest(spark, str(raw), store, "company", marks)
    _gz(raw / "2/2.html.gz", page("2", "two\nlines"))
    incremental_ingest(spark, str(raw), store, "company", marks)
    assert {(r.number, r.name) for r in store.table("companies").collect()} == {("1", "N"), ("2", "two lines")}
    assert store.table("ingest_log").count() == 2
    incremental_ingest(spark, str(raw), store, "company", marks)
    assert store.versions.current() == 2


def _names(store, name="companies"):
    return {(r.number, r.name) for r in store.table(name).collect()}


def test_a_load_writes_in_proportion_to_itself(spark, store):
    store.ingest(frame(spark, [(str(i), page(str(i), f"name {i}", directors=["A B"])) for i in range(4000)]), "company")
    store.merge()
    before, base = store.versions.state(), store.versions.state()["tables"]["companies"]["base"]
    store.ingest(frame(spark, [("7", page("7", "New")), ("70", page("70", "New", directors=["X", "Y"]))]), "company")
    after = store.versions.state()
    written = [x for t in after["tables"].values() for r in t["runs"] for x in (r["rows"], r["keys"])]
    assert after["tables"]["companies"]["base"] == base and all(20 * x["bytes"] < base["bytes"] for x in written if "companies" in x["folder"] or "keys" in x["folder"])
    assert len(after["appended"]["ingest_log"]) == len(before["appended"]["ingest_log"]) + 1
    assert [r.id for r in store.table("ingest_log").orderBy("id").collect()] == list(range(1, 4003))
    assert store.table("companies").count() == 4000 and store.table("company_directors").count() == 4000
    assert store.rows_of("companies", "7").first().name == "New" and store.rows_of("company_directors", "7").count() == 0
    assert sorted(r.full_name for r in store.rows_of("company_directors", "70").collect()) == ["X", "Y"]
    assert store.rows_of("companies", "none").count() == 0


def test_bases_have_as_many_buckets_as_their_bytes_ask_for(spark, tmp_path):
    store = upsert.Store(spark, str(tmp_path / "small"), bucket_bytes=20_000)
    store.ingest(frame(spark, [(str(i), page(str(i), f"name {i}")) for i in range(3000)]), "company", log=False)
    store.merge()
    base = store.versions.state()["tables"]["companies"]["base"]
    assert 4 <= base["buckets"] <= 64 and base["buckets"] == 1 << (base["buckets"].bit_length() - 1)
    assert store.table("companies").count() == 3000 and store.rows_of("companies", "77").first().name == "name 77"
    read = store.rows_of("companies", "77").inputFiles()
    assert 0 < len(read) < base["buckets"] and len({f.split("_bucket=")[1].split("/")[0] for f in read}) == 1


def test_many_small_loads_are_folded_and_merged(spark, store, monkeypatch):
    monkeypatch.setattr(storage, "RUNS", 3)
    store.ingest(frame(spark, [(str(i), page(str(i), f"n{i}", directors=["A"])) for i in range(300)]), "company")
    store.merge()
    want = {(str(i), f"n{i}") for i in range(300)}
    for n in range(7):
        store.ingest(frame(spark, [(str(n), page(str(n), f"new {n}")), ("5", page("5", f"last {n}", directors=["B"] * n))]), "company")
        want = {x for x in want if x[0] not in (str(n), "5")} | {(str(n), f"new {n}"), ("5", f"last {n}")} - ({("5", "new 5")} if n == 5 else set())
        held = store.versions.state()["tables"]["companies"]
        assert len(held["runs"]) <= 3 and held["base"]
    found = {k: v for k, v in _names(store)}
    assert {k: v for k, v in found.items() if k != "5"} == {k: v for k, v in want if k != "5"} and len(found) == 300 and found["5"] == "last 6"
    assert store.table("company_directors").where("company_number = '5'").count() == 6 and len(store.versions.state()["appended"]["ingest_log"]) <= 4
    assert store.table("ingest_log").count() == 300 + 14 and store.table("ingest_log").agg(F.count_distinct("id")).first()[0] == 314


def test_two_loads_at_one_time(spark, store, tmp_path):
    """The second to publish goes on top of the first; a state that is published as it was is refused."""
    store.ingest(frame(spark, [("1", page("1"))]), "company")
    late, calls = store.versions.state(), []

    def change(state):
        if not calls:  # another load comes first
            calls.append(store.ingest(frame(spark, [("2", page("2")), ("1", page("1", "other"))]), "company"))
        store.versions.add(state, "companies", None, store.versions.write_keys(spark.createDataFrame([("1",)], "number string"), "company"))

    assert store.versions.commit(change) == 3 and _names(store) == {("2", "N")}
    with pytest.raises(storage.Conflict):
        store.versions.publish(late)
    (tmp_path / "tables/_versions/.broken").write_text("{")  # what a load leaves that breaks off while it publishes
    assert store.ingest(frame(spark, [("3", page("3"))]), "company") == 4 and store.table("companies").count() == 2


def test_a_load_during_a_merge_stays_on_top(spark, store, monkeypatch):
    store.ingest(frame(spark, [("1", page("1")), ("2", page("2"))]), "company")
    commit, first = store.versions.commit, []

    def late(change):
        if not first:
            first.append(1)
            store.ingest(frame(spark, [("2", page("2", "New"))]), "company")
        return commit(change)

    monkeypatch.setattr(store.versions, "commit", late)
    store.versions.merge("companies", TABLES["companies"].schema, ("number",))
    held = store.versions.state()["tables"]["companies"]
    assert held["base"] and len(held["runs"]) == 1 and _names(store) == {("1", "N"), ("2", "New")}


def test_sweeping_keeps_what_versions_list(spark, store):
    for n in range(3):
        store.ingest(frame(spark, [("1", page("1", f"n{n}")), (str(n), page(str(n)))]), "company")
    spark.range(3).write.parquet(f"{store.versions.root}/data/companies/broken")  # a load that broke off
    earlier = store.table("companies")  # a reader of the version before the merge
    store.merge()
    assert store.versions.sweep(keep=100) == [] and earlier.count() == 3
    gone = store.versions.sweep(keep=100, grace=0)
    assert gone == ["data/companies/broken"] and earlier.count() == 3
    gone = store.versions.sweep(keep=1, grace=0)
    assert len(gone) > 6 and store.versions.sweep(keep=1, grace=0) == [] and store.versions._numbers() == [store.versions.current()]
    assert len(_names(store)) == 3 and store.table("ingest_log").count() == 6
    assert store.ingest(frame(spark, [("9", page("9"))]), "company") and store.table("companies").count() == 4


def test_replacing_rows_of_plain_frames(spark):
    old = conform(spark.createDataFrame([("1", "a", "Company"), ("2", "b", "Company")], "number string, name string, corporation_type string"), "companies")
    new = old.where("number = '2'").withColumn("name", F.lit("c"))
    assert {(r.number, r.name) for r in upsert.upsert_parent(old, new, "companies").collect()} == {("1", "a"), ("2", "c")}
    children = conform(spark.createDataFrame([("1", 1, "x"), ("2", 1, "y"), ("2", 2, "z")], "company_number string, seq int, full_name string"), "company_directors")
    kept = upsert.replace_children(children, new, "number", children.where("seq = 5"), "company_directors")
    assert [(r.company_number, r.seq) for r in kept.collect()] == [("1", 1)]


def test_a_replayed_batch_changes_nothing(spark, store):
    batch = frame(spark, [("1", page("1"))])
    assert store.ingest(batch, "company", batch=("s", 0)) == 1
    assert store.ingest(batch, "company", batch=("s", 0)) == 1
    assert store.ingest(batch, "company", batch=("s", 1)) == 2
    assert store.table("ingest_log").count() == 2


def test_everything_at_once(spark, store):
    lobby = frame(spark, [("x", '<p id="lblRegistrationNumber">CL-1</p>'), ("y", "<p>")])
    store.ingest_all(frame(spark, [("1", page("1"))]), lobby)
    assert store.table("companies").count() == store.table("lobbyist_registrations").count() == 1
    assert store.table("ingest_log").where("kind = 'lobbyist' AND NOT parsed_ok").count() == 1


def test_search_order_and_totals(spark):
    rows = [(str(i), f"N{i % 3}", "Company", None, "Active" if i % 2 else None) for i in range(6)]
    df = spark.createDataFrame(rows, "number string, name string, corporation_type string, category string, status string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("incorporation_date", "ro_city", "ro_province_state")})
    assert [r.number for r in search.search_companies(df, limit=4).collect()] == ["0", "3", "1", "4"]
    assert search.match_total(search.company_matches(df, " n1 ", "Company", "Active")).first().total == 1
    assert search.company_matches(df, "").count() == 6 and search.company_matches(df, "5").count() == 1


def test_searches_by_trigrams_equal_scans(spark, tmp_path):
    store = upsert.Store(spark, str(tmp_path / "t"), bucket_bytes=8_000)
    names = ["Acme \\ Sons", "STUDIO One", "studio_two", "100% pure", "É&B Öl", "ab", "", "x" * 500, "ΟΔΟΣ", "plain acme"]
    html = lambda i, name: (str(i), page(str(i), name))
    store.ingest(frame(spark, [html(i, f"{names[i % 10]} {i % 7}" if names[i % 10] else "n") for i in range(600)]), "company", log=False)
    store.merge()
    store.create_search_index()
    assert store.create_search_index() == store.versions.current()
    store.ingest(frame(spark, [html(3, "renamed studio"), html(11, "zebra"), html(900, "new zebra")]), "company", log=False)
    patterns = ["studio", "acme", "dio_t%wo", "100% p", "\\ so", "é&b", "ab", "a", "zebra", "xxx", "οδος", "ΟΔΟΣ 3", "11", "900", "no such", "", None, " studio one 1 ", "%", "_"]

    def equal():
        for q in patterns:
            may = store.may_match("companies", q)
            got = sorted((r.number, r.name) for r in search.company_matches(may, q).collect())
            assert got == sorted((r.number, r.name) for r in search.company_matches(store.table("companies"), q).collect()), q

    equal()
    found = store.may_match("companies", "new zebra")
    assert len(found.inputFiles()) < len(store.table("companies").inputFiles()) and found.count() <= 2
    store.merge()
    equal()


def _changes(df):
    return sorted((r.path.rpartition("/")[2], r.change) for r in df.collect())


def test_a_page_fetched_again_under_its_name_is_found(spark, store, tmp_path):
    raw = tmp_path / "raw"
    for n in "1234":
        _gz(raw / f"{n}/{n}.html.gz", page(n))
    _gz(raw / "5/a[5]+ b.html.gz", page("5"))
    assert [c for _, c in _changes(ingest_changes(spark, str(raw), store, "company"))] == ["new"] * 5
    assert _changes(ingest_changes(spark, str(raw), store, "company")) == [] and store.versions.current() == 1
    _gz(raw / "1/1.html.gz", page("1", "a new name"))
    os.utime(raw / "2/2.html.gz", (1, 1))  # touched, with the same content
    (raw / "3/3.html.gz").unlink()
    kept_time, other = (raw / "4/4.html.gz").stat(), gzip.compress(page("4").encode())
    (raw / "4/4.html.gz").write_bytes(bytes(len(other)) if len(other) == kept_time.st_size else bytes(kept_time.st_size))  # not to be read: no gzip file
    os.utime(raw / "4/4.html.gz", ns=(kept_time.st_atime_ns, kept_time.st_mtime_ns))
    _gz(raw / "5/a[5]+ b.html.gz", page("5", "five again"))
    _gz(raw / "6/6.html.gz", page("6"))
    found = _changes(ingest_changes(spark, str(raw), store, "company"))
    assert [(n[0], c) for n, c in found] == [("1", "changed"), ("2", "touched"), ("3", "removed"), ("6", "new"), ("a", "changed")]
    assert _names(store) == {("1", "a new name"), ("2", "N"), ("3", "N"), ("4", "N"), ("5", "five again"), ("6", "N")}
    assert store.table("ingest_log").count() == 8  # five, and then three
    assert _changes(ingest_changes(spark, str(raw), store, "company")) == []
    assert _changes(ingest_changes(spark, str(tmp_path / "none"), store, "company")) == []


def test_changes_that_break_off_are_taken_up_again(spark, store, tmp_path, monkeypatch):
    raw, whole, calls = tmp_path / "raw", store.ingest, []
    for n in "123":
        _gz(raw / f"{n}.html.gz", page(n))

    def breaks(*args, **more):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return whole(*args, **more)

    monkeypatch.setattr(store, "ingest", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        ingest_changes(spark, str(raw), store, "company", files_per_batch=1)
    assert store.table("companies").count() == 1
    assert [c for _, c in _changes(ingest_changes(spark, str(raw), store, "company", files_per_batch=1))] == ["new"] * 2
    assert store.table("companies").count() == 3 and store.table("ingest_log").count() == 3


def test_children_in_the_same_buckets_are_joined_without_a_shuffle(spark, store, tmp_path):
    store.ingest(frame(spark, [(str(i), page(str(i), directors=["B A", f"C {i}"][: i % 3])) for i in range(40)]), "company")
    saved = store.save_for_joins("joined", str(tmp_path / "joined"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        full = search.company_with_children(saved["companies"], *[saved[t] for t in company.CHILD_LISTS])
        plan = full._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
        got = {r.number: [d.full_name for d in r.directors or []] for r in full.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for t in ("companies", *company.CHILD_LISTS):
            spark.sql(f"DROP TABLE joined_{t}")
    assert got == {str(i): ["B A", f"C {i}"][: i % 3] for i in range(40)}


def test_running_counters_survive_a_restart(spark, tmp_path):
    folder, where, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    rows = [("hits", ["a", "b", "c"]), ("detail", []), (None, None), ("empty", []), ("odd", ["x"]), ("cached", []), ("hits", [])]
    assert outcomes_so_far(spark, where).first() == (0,) * 7
    seen = []
    for part in (rows[:3], rows[3:4], rows[4:]):
        spark.createDataFrame(part, OUTCOMES).write.mode("append").parquet(folder)
        count_outcomes(spark, folder, where, marks)
        seen += part
        assert outcomes_so_far(spark, where).first() == planning.outcome_stats(spark.createDataFrame(seen, OUTCOMES)).first()
    count_outcomes(spark, folder, where, marks)
    assert outcomes_so_far(spark, where).first().attempted == 7


def test_counts_are_kept_up(spark, store, monkeypatch):
    with pytest.raises(ValueError, match="not counted"):
        store.counts()
    store.ingest(frame(spark, [("1", page("1", directors=["A B", "C"])), ("2", page("2", kind="Condominium")), ("bad", "<p>")]), "company")
    store.create_counts()

    def same():
        noted = store.counts()
        assert not noted.inputFiles() and "FileScan" not in noted._jdf.queryExecution().toString()
        assert {(r.corporation_type, r.n) for r in search.counted_types(noted).collect()} == {(r.corporation_type, r.n) for r in search.count_by_type(store.table("companies")).collect()}
        assert search.counted_registries(noted).first() == search.registry_counts(store.table("companies"), store.table("lobbyist_registrations")).first()
        assert set(search.counted_tables(noted).collect()) == set(search.table_counts({n: store.table(n) for n in TABLES}).collect())
        logged = {r.value: r.n for r in noted.where("table = 'ingest_log'").collect()}
        assert logged.get("company ok", 0) == store.table("ingest_log").where("kind = 'company' AND parsed_ok").count()

    same()
    # a number that changes its type, a list that shrinks, a failed page of a stored number, a number that is new
    store.ingest(frame(spark, [("1", page("1", kind="Co-operative", directors=["A B"])), ("2", "<p>"), ("3", page("3"))]), "company")
    same()
    for _ in range(2):  # a replay counts nothing
        store.ingest(frame(spark, [("4", page("4"))]), "company", batch=("s", 1))
    store.merge()
    same()
    monkeypatch.setattr(counts, "FEW", 2)  # by a join with the keys
    store.ingest(frame(spark, [(str(i), page(str(i), kind="Condominium", directors=["X"])) for i in range(9)]), "company")
    same()
    # rows taken away by their keys
    gone = store.versions.write_keys(spark.createDataFrame([("1",), ("nowhere",)], "number string"), "gone")
    store.publish({"companies": (None, gone), "company_directors": (None, gone)})
    same()
    assert store.create_counts() == store.versions.current()


def test_counts_of_loads_at_one_time(spark, store):
    store.create_counts()
    other = store.versions.write_keys(spark.createDataFrame([("1",)], "number string"), "companies")
    commit = store.versions.commit

    def late(change):
        store.versions.commit = commit
        store.ingest(frame(spark, [("1", page("1", kind="Condominium"))]), "company")  # another load of the same number is first
        return commit(change)

    store.versions.commit = late
    store.ingest(frame(spark, [("1", page("1")), ("2", page("2"))]), "company")
    assert {(r.corporation_type, r.n) for r in search.counted_types(store.counts()).collect()} == {("Company", 2)}
    store.publish({"companies": (None, other)})
    assert {(r.corporation_type, r.n) for r in search.counted_types(store.counts()).collect()} == {("Company", 1)}


def test_counts_of_many_values_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counts, "VALUES", 3)
    landed = lambda n: spark.range(n).selectExpr("concat('r', id) AS registry", "'k' AS kind", "'1' AS key", "'h' AS html", "'u' AS url")
    pages.land_pages(landed(3), str(tmp_path / "l"))
    pages.count_pages(spark, str(tmp_path / "l"))
    assert {(r.label, r.n) for r in pages.page_counts(spark, str(tmp_path / "l")).collect()} == {("r0/k", 1), ("r1/k", 1), ("r2/k", 1)}
    with pytest.raises(ValueError, match="more than 3 values"):
        pages.land_pages(landed(4), str(tmp_path / "l"))


def test_a_folder_is_listed_once_and_only_named_files_are_read(spark, tmp_path):
    for name in ("it's \\ 1", "b"):
        (tmp_path / f"{name}.html.gz").write_bytes(gzip.compress(name.encode()))
    (path,) = (r.path for r in manifest.listing(spark, str(tmp_path)).collect() if "it" in r.path)
    read = manifest._read(spark, str(tmp_path), [path], ".html.gz")
    assert [r.html for r in read.collect()] == ["it's \\ 1"]
    assert len(read.inputFiles()) == 2  # the folder, not a name for each file, is what the reader is given
    assert registry._dealt_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_batch_of_files_is_listed_by_few_tasks(spark, store, tmp_path, monkeypatch):
    raw, whole, groups, cost = tmp_path / "raw", store.ingest, set(), incremental.OPEN_COST
    for n in range(200):
        _gz(raw / f"{n}.html.gz", page(n))

    def ingest(found, *args, **more):
        groups.add(spark.sparkContext.getLocalProperty("spark.jobGroup.id"))
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        return whole(found, *args, **more)

    monkeypatch.setattr(store, "ingest", ingest)
    before = {k: spark.conf.get(k) for k in (incremental.LISTING, cost)}
    incremental_ingest(spark, str(raw), store, "company", str(tmp_path / "marks"))
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for g in groups for j in tracker.getJobIdsForGroup(g) for s in tracker.getJobInfo(j).stageIds]
    assert groups and stages and max(s.numTasks for s in stages if s) < 200  # not one for each file
    assert {k: spark.conf.get(k) for k in before} == before and store.table("companies").count() == 200
    spark.conf.set(cost, "64k")
    try:  # what is lower already stays
        with incremental._at_most(spark, {cost: 256 << 10}):
            assert spark.conf.get(cost) == str(64 << 10)
        assert spark.conf.get(cost) == "64k"
    finally:
        spark.conf.unset(cost)


def test_page_files_are_made_without_a_process_for_each(spark, tmp_path):
    rows = spark.createDataFrame([("é",), ("same",), ("same",), (None,), ("a\nb",)], "html string").coalesce(1)
    raw = tmp_path / "a b%20c"
    for _ in range(2):
        pages.write_files(rows, f"file://{raw}")
    made = list(raw.iterdir())
    assert len(made) == 10 and not [f for f in made if f.suffix != ".gz"]  # no checksum files, which Hadoop makes
    assert sorted(gzip.decompress(f.read_bytes()).decode() for f in made) == sorted(2 * ["é\n", "same\n", "same\n", "\n", "a\nb\n"])
    pages.write_files(rows.limit(0), str(tmp_path / "none"))
    assert pages.scan_detail_pages(spark, str(tmp_path / "none"), suffix=pages.WRITTEN).count() == 0
    assert pages.scan_detail_pages(spark, str(raw), suffix=pages.WRITTEN).count() == 10


def test_a_task_that_is_tried_again_makes_the_same_files(spark, tmp_path):
    rows = spark.createDataFrame([("x",), ("y",), ("y",)], "html string")
    for order in ("html", F.desc("html")):
        rows.coalesce(1).sortWithinPartitions(order).mapInArrow(pages._files_of(str(tmp_path), "run"), "files long").collect()
    assert sorted(gzip.decompress(f.read_bytes()) for f in tmp_path.iterdir()) == [b"x\n", b"y\n", b"y\n"]


def test_other_stores_get_page_files_by_spark(spark, tmp_path, monkeypatch):
    class Far:
        def getUri(self):
            return self

        def getScheme(self):
            return "far"

    monkeypatch.setattr(pages, "path_of", lambda spark, folder: (Far(), None))
    pages.write_files(spark.createDataFrame([("x",), ("y",)], "html string").coalesce(1), str(tmp_path / "out"))
    assert sorted(r.html for r in pages.scan_detail_pages(spark, str(tmp_path / "out"), suffix=pages.WRITTEN).collect()) == ["x\n", "y\n"]


def _odd_names(at):
    for name in ("it's \\ 1", "100%25+ x", "a[5]+ b", "é~ü", "q?r#s;t", "x\xa0y z", "a@b&c=d,e!$()*", '{}|^`"<>', "漢字😀", "tab\tx", "deep/er/1", "_hid/2", ".hid/3", "deep/_list/4", "k=v/5", "_k=v/6"):
        _gz(at / f"{name}.html.gz", name)
    _gz(at / ".7.html.gz", "7")
    _gz(at / "_8.html.gz", "8")
    (at / "other.txt").write_text("no page")


def test_tasks_list_and_read_a_local_folder_as_spark_does(spark, tmp_path, monkeypatch):
    _odd_names(tmp_path / "a b")
    both = lambda: (sorted(manifest.listing(spark, str(tmp_path)).collect()), sorted(pages.scan_files(spark, str(tmp_path), pages.DETAIL).collect()))
    found = both()
    assert manifest.listing(spark, str(tmp_path)).inputFiles() == []  # no listing of Spark's, which the driver holds
    assert pages.scan_detail_pages(spark, str(tmp_path)).inputFiles() == []
    for module in (manifest, pages):
        monkeypatch.setattr(module, "local_path", lambda spark, folder: None)
    assert found == both() and len(found[0]) == 13


def test_a_stream_of_local_pages_holds_paths_in_a_table(spark, store, tmp_path, monkeypatch):
    raw, marks, whole, batches = tmp_path / "raw", str(tmp_path / "marks"), store.ingest, []
    monkeypatch.setattr(store, "ingest", lambda found, *args, **more: (batches.append(found.count()), whole(found, *args, **more)))
    for n in range(7):
        _gz(raw / f"{n % 2}/{n} +%20.html.gz", page(str(n)))
    for _ in range(2):
        incremental_ingest(spark, str(raw), store, "company", marks, files_per_batch=3)
    _gz(raw / "8.html.gz", page("8"))
    incremental_ingest(spark, str(raw), store, "company", marks, files_per_batch=3)
    assert sorted(batches) == [1, 1, 3, 3] and store.table("ingest_log").count() == 8
    assert {r.number for r in store.table("companies").collect()} == set("01234568")
    assert sorted(r.path.rpartition("/")[2][0] for r in spark.read.parquet(f"{marks}/paths").collect()) == sorted("01234568")


def test_paths_come_in_parts_of_a_size(spark):
    paths = spark.range(0, 1000, numPartitions=7).selectExpr("CAST(id AS STRING) AS path")
    for size, want in ((300, [300, 300, 300, 100]), (1000, [1000]), (10**6, [1000])):
        parts = [[r.path for r in p.collect()] for p in manifest.in_parts(paths, size)]
        assert [len(p) for p in parts] == want and len({x for p in parts for x in p}) == 1000
    assert list(manifest.in_parts(paths.limit(0), 5)) == []


def test_the_last_run_is_read_without_a_join(spark, store):
    plan = lambda name: store.table(name)._jdf.queryExecution().executedPlan().toString()
    store.ingest(frame(spark, [(n, page(n, directors=["A"])) for n in "123"]), "company")
    assert not any("Join" in plan(n) for n in ("companies", "company_directors"))
    store.ingest(frame(spark, [("1", page("1", "New")), ("4", page("4"))]), "company")
    assert _names(store) == {("1", "New"), ("2", "N"), ("3", "N"), ("4", "N")} and sorted(r.company_number for r in store.table("company_directors").collect()) == ["2", "3"]
    tables, key = store.versions, ("number",)
    gone = tables.write_keys(spark.createDataFrame([("2",), (None,)], "number string"), "companies")
    tables.commit(lambda now: tables.add(now, "companies", None, gone))
    assert _names(store) == {("1", "New"), ("3", "N"), ("4", "N")}
    tables.fold("companies", TABLES["companies"].schema, key)
    assert _names(store) == {("1", "New"), ("3", "N"), ("4", "N")} and "Join" not in plan("companies")
