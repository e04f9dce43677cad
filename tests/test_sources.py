import json
from datetime import date, datetime

import pytest
from emberbasin.operators import fires, text
from emberbasin.operators.freesql import run_select
from emberbasin.schemas import FIRES
from emberbasin.sources import files, tables
from emberbasin.streaming import ingest
from emberbasin.streaming.rolling import rolling_emissions


def detection(uid, day=10, age=1.0):
    return (uid, 1.0, 2.0, 300.0, 280.0, 5.0, datetime(2024, 1, day, 9), "N", "v", "high", "D", age)


@pytest.fixture
def fire_table(spark, tmp_path):
    name = f"main.fires_{tmp_path.name.replace('-', '_')}"
    return tables.create_fire_table(spark, name, str(tmp_path / "fires"))


def test_appending_keeps_each_key_once_with_its_first_age(spark, rows, fire_table):
    first = spark.createDataFrame([detection("a"), detection("a", age=3.0), detection("b", 11)], FIRES)
    tables.append_detections(first, fire_table)
    again = spark.createDataFrame([detection("a", age=9.0), detection("c", 12)], FIRES)
    tables.append_detections(again, fire_table)
    tables.append_detections(again, fire_table)
    stored = spark.table(fire_table)
    assert rows(stored, "uid", "hours_old") == [("a", 1.0), ("b", 1.0), ("c", 1.0)]
    assert stored.where("acq_day = date'2024-01-11'").count() == 1
    assert stored.schema["frp_mw"].metadata["comment"].startswith("fire radiative power")


def test_time_conditions_prune_day_partitions(spark, fire_table):
    batch = spark.createDataFrame([detection(str(d), d) for d in range(1, 29)], FIRES)
    stored = tables.append_detections(batch, fire_table)
    now = datetime(2024, 1, 29)
    asked = {
        "on date": (fires.count_on_date(stored, "2024-01-10"), 1),
        "last days": (fires.count_last_days(stored, 2, now), 2),
        "by date": (fires.fires_by_date(stored, "2024-01-05", "2024-01-07"), 3),
        "in box": (fires.fires_in_box(stored, 0, 5, 0, 5, start_date="2024-01-27"), 2),
        "windows": (fires.count_windows(stored, [24, 72], now), 2),
        "days": (fires.count_days(stored, ["2024-01-03"], [("2024-01-08", "2024-01-09")]), 2),
    }
    for name, (answer, size) in asked.items():
        plan = answer._jdf.queryExecution().executedPlan().toString()
        filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
        assert "acq_day" in filters.split("PartitionFilters: [")[1].split("]")[0], name
        found = answer.collect()
        assert size == (found[0].fire_count if len(found) == 1 else len(found)), name


def test_copies_within_a_batch_may_stay(spark, fire_table):
    batch = spark.createDataFrame([detection("a"), detection("a")], FIRES)
    assert tables.append_detections(batch, fire_table, within_batch=False).count() == 2


def test_append_by_name_with_missing_columns(spark, fire_table):
    batch = spark.createDataFrame([detection("a")], FIRES).select("frp_mw", "acquisition_timestamp", "uid")
    row = tables.append_detections(batch, fire_table).first()
    assert (row.uid, row.frp_mw, row.latitude) == ("a", 5.0, None)


def test_empty_batch(spark, fire_table):
    assert tables.append_detections(spark.createDataFrame([], FIRES), fire_table).count() == 0


def test_export_numbers_go_on_from_the_highest(spark, tmp_path):
    df, day = spark.range(3), date(2024, 1, 31)
    assert files.export_numbered(df, str(tmp_path), "x", day).endswith("x_2024-01-31_P1")
    (tmp_path / "x_2024-01-31_P9.csv").write_text("id\n1\n")
    (tmp_path / "x_2024-01-30_P40.csv").write_text("id\n1\n")
    assert files.export_numbered(df, str(tmp_path), "x", day).endswith("_P10")
    assert files.next_export_path(spark, str(tmp_path), "x", day).endswith("_P11")


def page(rows):
    return json.dumps({"features": [{"attributes": r} for r in rows]}, indent=1)


def feed_row(i, time="1704879000"):
    return {"OBJECTID": i, "latitude": i / 10, "longitude": 1.5, "frp": 2.0, "acq_date": "d", "acq_time": time, "confidence": "high", "satellite": "N", "hours_old": 4}


def test_landed_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text(page([feed_row(1), feed_row(2)]))
    (tmp_path / "p2.json").write_text(page([]))
    assert files.read_feed_pages(spark, str(tmp_path)).count() == 2
    (tmp_path / "p3.json").write_text('{"error": {"code": 400}}')
    with pytest.raises(Exception, match="no 'features'"):
        files.read_feed_pages(spark, str(tmp_path)).collect()


def test_stream_takes_late_and_repeated_pages_once(spark, rows, tmp_path, fire_table):
    landing = tmp_path / "landing"
    landing.mkdir()

    def run():
        feed = ingest.stream_feed_pages(spark, str(landing))
        ingest.start_ingest(feed, fire_table, str(tmp_path / "check"), available_now=True).awaitTermination()
        spark.catalog.refreshTable(fire_table)
        return spark.table(fire_table).count()

    (landing / "a.json").write_text(page([feed_row(1), feed_row(1), feed_row(2, "1704879000000")]))
    assert run() == 2
    old = "1604879000"
    (landing / "b.json").write_text(page([feed_row(1), feed_row(3), feed_row(4, old)]))
    assert run() == 4
    assert run() == 4
    tables.append_detections(spark.createDataFrame([detection("z")], FIRES), fire_table)
    (landing / "c.json").write_text(page([feed_row(5), feed_row(3), feed_row(2, "1704879000000")]))
    assert run() == 6


def test_rolling_windows_come_out_after_the_watermark(spark, rows, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([detection("a", 1), detection("b", 1), detection("c", 20)], FIRES).write.parquet(path)
    stream = rolling_emissions(spark.readStream.schema(FIRES).parquet(path))
    query = stream.writeStream.format("memory").queryName("rolled").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("rolled"), "window_start", "fire_count") == [(datetime(2024, 1, 1, 9), 2)]


def test_raw_csv_types_despite_missing_marks(spark, rows, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,t,e\n1,1.5,x,\nNA,nan,N/A,\n3, 2 ,7,NULL\n")
    df = files.read_raw_csv(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "t": "string", "e": "double"}
    assert rows(df) == [(1, 1.5, "x", None), (3, 2.0, "7", None), (None, None, None, None)]


def test_loading_and_catalog(spark, rows, tmp_path):
    csv = tmp_path / "csv"
    csv.write_text("pfaf_id,v\n1,2.5\n")
    database = f"db_{tmp_path.name.replace('-', '_')}"
    paths = {f"{database}.one": str(csv), f"{database}.two": str(tmp_path / "none")}
    with pytest.raises(RuntimeError, match="one"):
        tables.ensure_tables(spark, paths, read_only=True)
    assert tables.ensure_tables(spark, paths) == [f"{database}.one"]
    assert tables.ensure_tables(spark, {f"{database}.one": str(csv)}) == []
    assert tables.load_tables(spark, paths) == [f"{database}.one"]
    spark.range(1).createOrReplaceTempView("a_view")
    assert rows(tables.list_datasets(spark, [database])) == [(f"{database}.one",)]
    assert f"{database}.one" in [r[0] for r in rows(tables.list_datasets(spark))]
    info = tables.dataset_info(spark, f"{database}.one")
    assert rows(info, "rows", "column", "type") == [(1, "pfaf_id", "int"), (1, "v", "double")]
    assert tables.dataset_info(spark, f"{database}.two") is None
    assert tables.table_exists(spark, f"{database}.one") and not tables.table_exists(spark, "nothing")


def test_water_tables_from_raw_files(spark, tmp_path):
    annual, monthly, future = (str(tmp_path / x) for x in ("annual", "monthly", "future"))
    open(annual, "w").write("pfaf_id,name_0,name_1,gid_0,area_km2,bws_raw\n1,A,p,g,2.5,-9999\n1,A,p,g,2.5,-9999\n2,,p,g,1.0,3\n")
    open(monthly, "w").write("pfaf_id,bws_01_raw,bws_01_cat\n1,1.5,2\n1,1.5,2\n2,9999,NA\n")
    open(future, "w").write("pfaf_id,bau30_ws_x_r\n1,9999\n2,4\n")
    made = tables.build_water_tables(spark, annual, monthly, future)
    counts = {r["table"]: r["rows"] for r in tables.row_counts({m: spark.table(f"main.{m}") for m in made}).collect()}
    assert counts == {"Baseline_Annual": 3, "Baseline_Monthly": 2, "Future_Annual": 1, "Region_Lookup": 1}


def test_documents_and_lines(spark, rows, tmp_path):
    content = "# A\r\nb\n\nc\n"
    (tmp_path / "doc.md").write_bytes(content.encode())
    docs = files.read_documents(spark, str(tmp_path))
    assert rows(files.document_lines(docs), "position", "line") == list(enumerate(content.splitlines()))


@pytest.mark.parametrize("content", ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc\x0bd\x0ce\x85f g h\x1ci"])
def test_lines_are_pythons(spark, rows, content):
    docs = spark.createDataFrame([(1, content)], "doc_id int, text string")
    assert [r[0] for r in rows(files.document_lines(docs).orderBy("position"), "line", ordered=True)] == content.splitlines()


def test_outline(spark):
    lines = ["  # Head", "nothing", "a Fire here ", "VIIRS", "viirs", "## Sub"] + [f"fire {i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "")], "doc_id int, text string")
    found = {r.doc_id: r for r in text.outlines(docs).collect()}
    wanted = [x.strip() for x in lines if x.strip().startswith("#") or "VIIRS" in x or "fire" in x.lower()]
    assert found[1].outline == "\n".join(wanted[:20]) and found[1].line_count == 20
    assert (found[2].outline, found[2].line_count) == ("", 0)


def test_snippets(spark):
    docs = spark.createDataFrame([(1, "x" * 2001), (2, "y" * 2000), (3, ""), (4, None)], "doc_id int, text string")
    found = {r.doc_id: r for r in text.snippets(docs).collect()}
    assert found[1].content == "x" * 2000 + "\n\n... (Text truncated. Total characters: 2001)"
    assert [found[i].full_text_available for i in (1, 2, 3, 4)] == [False, True, True, True]
    assert [found[i].char_count for i in (1, 2, 3, 4)] == [2001, 2000, 0, 0]
    assert found[3].warning and found[4].warning and not found[2].warning


def test_routing(spark, rows):
    asked = spark.createDataFrame([("Any WILDFIRES?",), ("the aquifer",), ("hello",)], "text string")
    assert rows(text.route_topics(asked)) == [
        ("Any WILDFIRES?", True, False), ("hello", False, False), ("the aquifer", False, True),
    ]
    off = text.route_topics(asked, enabled={"water": False})
    assert off.where("ask_water").count() == 0
    assert text.needed_words(["fires", "fire", "Wildfire", "smoke"]) == ["fire", "smoke"]


def test_place_mentions(spark):
    questions = {
        "Are there fires near Los Angeles area today": "Los Angeles",
        "fires in Kenya?": "Kenya",
        "What is burning around Cape Town, South Africa": "Cape Town",
        "at home": None,
    }
    df = spark.createDataFrame([(q,) for q in questions], "text string")
    assert {r.text: r.place for r in text.place_mentions(df).collect()} == questions


@pytest.mark.parametrize(
    "sql",
    ["DROP TABLE t", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT 1; DROP TABLE t", "", "selection"],
)
def test_free_sql_refuses_commands(spark, sql):
    with pytest.raises(Exception):
        run_select(spark, sql)


def test_free_sql(spark, rows):
    t = spark.range(3)
    assert rows(run_select(spark, " select max(id) m from t -- end", {"t": t})) == [(2,)]
    assert rows(run_select(spark, "WITH a AS (SELECT id FROM t) SELECT * FROM a ORDER BY id DESC LIMIT 2;", {"t": t}), ordered=True) == [(2,), (1,)]


def test_query_frame_and_views(spark):
    df = spark.range(4)
    tables.register_views({"four": df})
    assert spark.table("four").count() == 4
    assert tables.query_frame(df, "SELECT count(*) AS n FROM {df}").first().n == 4
    assert tables.head(df, 2, ["id"]).count() == 2
