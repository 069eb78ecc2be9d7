import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from tidemark import sources as S
from tidemark import streaming


def test_store_replaces_partitions(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    assert not store.exists("t")
    store.write(spark.createDataFrame([(1, "2024-01-01"), (2, "all")], "v int, dt string"), "t")
    store.write(spark.createDataFrame([(3, "all")], "v int, dt string"), "t")
    assert sorted((r.v, r.dt) for r in store.read("t").collect()) == [(1, "2024-01-01"), (3, "all")]
    assert store.read("t", "all").count() == 1 and store.exists("t")


def test_zipped_csv(spark, tmp_path):
    head = "# Timestamp;Type of mobile;MMSI;Latitude;Longitude;Extra"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", head + "\n01/01/2024 00:00:00;Class A;1;55.0;10.0;x\nbroken;row\nbroken;too\n01/01/2024 00:00:01;Class A;2;55.0;10.0;x\n")
    out = S.read_zipped_csv(spark, str(tmp_path / "a.zip")).collect()
    assert [(r.mmsi, r.lat, r.sog) for r in out if not r.bad] == [("1", "55.0", None), ("2", "55.0", None)] and sum(r.bad for r in out) == 2
    assert sum(r.bad for r in S.read_zipped_csv(spark, str(tmp_path / "a.zip"), chunk=1).collect()) == 2


def test_headers_and_sniffing():
    assert S.header_map(["# Timestamp", "MMSI", "Latitude", "Longitude", "Draft", "Ship name", "shiptype", "Nav status", "Size A", "Call sign"]) == {"timestamp": 0, "mmsi": 1, "lat": 2, "lon": 3, "draught": 4, "name": 5, "ship_type": 6, "nav_status": 7, "a": 8, "callsign": 9}
    assert S.header_map(["time", "mmsi", "lat", "long", "type", "Mobile type", "Data source"]) == {"timestamp": 0, "mmsi": 1, "lat": 2, "lon": 3, "mobile_type": 5, "data_source": 6}
    assert S.header_map(list(S.PUBLISHED.values())) == {n: i for i, n in enumerate(S.PUBLISHED)}
    extra, lacking = S.drift(["Timestamp", "MMSI", "lat", "lon", "odd"])
    assert extra == ["odd"] and "Draught" in lacking
    try:
        S.header_map(["mmsi", "lat"])
        raise AssertionError
    except ValueError as e:
        assert "timestamp" in str(e)
    assert S.sniff("a;b;c,d\n1;2;3\n4;5;6,7,8\n".encode()) == ("utf-8-sig", ";")
    assert S.sniff("é,b\n1,2\n".encode("latin-1")) == ("latin-1", ",") and S.sniff("a,é".encode()[:-1]) == ("utf-8-sig", ",") and S.sniff(b"") == ("utf-8-sig", ",")


def test_listings(spark):
    from datetime import date

    from tidemark.sources import listing as G

    pages = spark.createDataFrame([("<a href='x/d-2024-03-01.zip'>1</a><a href=\"d-2024-03.zip\">2</a><a href='odd.zip'>3</a><a href='n.txt'>4</a>",), ("<Key>p/d-2024-03-02.zip</Key><NextContinuationToken>t</NextContinuationToken>",)], "text string")
    got = {r["name"]: (r.kind, r.start, r.end) for r in G.listed(pages).collect()}
    assert got == {"d-2024-03-01.zip": ("daily", date(2024, 3, 1), date(2024, 3, 1)), "d-2024-03-02.zip": ("daily", date(2024, 3, 2), date(2024, 3, 2)), "d-2024-03.zip": ("monthly", date(2024, 3, 1), date(2024, 3, 31)), "odd.zip": ("unknown", None, None)}
    days = G.files_for_days(G.listed(pages), "2024-03-01", "2024-03-04")
    assert [(r.day.day, r.kind) for r in days.orderBy("day").collect()] == [(1, "daily"), (2, "daily"), (3, "monthly"), (4, "monthly")]
    done, ran = spark.createDataFrame([(date(2024, 3, 1),)], "day date"), []
    assert G.bulk_run(days, done, lambda link, d: ran.append((link, len(d))))["done"] == 3 and sorted(n for _, n in ran) == [1, 2]

    def broken(link, d):
        raise OSError("no")

    assert len(G.bulk_run(days, done, broken, stop=1)["failed"]) == 1
    assert G.pages_of(lambda p, t: "<NextContinuationToken>2</NextContinuationToken>" if t is None else "end", "s") == ["<NextContinuationToken>2</NextContinuationToken>", "end"]
    assert G.first_of(["a", "b"], lambda p: p if p == "b" else broken(p, 0)) == "b"
    assert G.window_start(date(2024, 1, 1), date(2025, 12, 31), 1.0, 1e6, 0, 0) == date(2024, 1, 1)
    assert G.window_start(date(2024, 1, 1), date(2025, 12, 31), 1.0, 120, 0, 0, short=True) == date(2025, 9, 23)


def test_changes_text():
    text = """03/05/2024
The following vessels have been added:
ORYX (IMO 9321483)
 owned by X; 
LARK (a.k.a. B) IMO 9462017 -to-
LARK II IMO 9462017.

04/01/2024 The following have been removed:
TERN IMO 9505950."""
    assert [x[:3] for x in S.parse_changes(text)] == [("2024-03-05", "add", 9321483), ("2024-03-05", "modify", 9462017), ("2024-04-01", "remove", 9505950)]


def test_xml_and_json(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<R><DistinctParty FixedRef='7'><Name>A</Name></DistinctParty><SanctionsEntry ProfileID='7'><EntryEvent><Date><Year>2024</Year><Month>5</Month><Day>1</Day></Date></EntryEvent><EntryEvent><Date><Year>2024</Year><Month>6</Month><Day>2</Day></Date></EntryEvent></SanctionsEntry></R>")
    got = S.read_parties(spark, str(tmp_path / "s.xml")).orderBy("date").collect()
    assert [(r.party, r.date) for r in got] == [("7", dt.date(2024, 5, 1)), ("7", dt.date(2024, 6, 2))]
    lines = [{"id": "v", "schema": "Vessel", "properties": {"imoNumber": ["IMO9321483"], "name": ["A"]}}, {"id": "s", "schema": "Sanction", "properties": {"entity": ["v"], "startDate": ["2024-05-01"], "programId": ["P"]}}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, lines)))
    vessels, actions = S.read_entities(spark, str(tmp_path / "e.json"))
    assert [(r.number, r["name"]) for r in vessels.collect()] == [(9321483, "A")] and actions.first().date == dt.date(2024, 5, 1)


def test_streams_agree_with_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=m)) for k in (1, 2) for m in (0, 30, 61, 200)]
    spark.createDataFrame(rows, "k int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming.sessions(stream, "k", "ts", late="1 minute").writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = streaming.sessions(spark.read.parquet(str(tmp_path / "in")), "k", "ts")
    pick = lambda df: sorted((r.k, r.start, r.n) for r in df.collect())
    assert pick(spark.table("sess")) == pick(want) and len(pick(want)) == 6
    once = streaming.deduplicated(spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in")), ["k"], "ts")
    q = once.withColumn("dt", F.to_date("ts").cast("string"))
    streaming.overwrite_days(q, str(tmp_path / "out"), str(tmp_path / "ck")).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_late_rows_buckets_and_reruns(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "k int, ts timestamp, dt string"
    src, out, ck = (str(tmp_path / x) for x in ("in2", "out2", "ck2"))
    spark.createDataFrame([(1, t0, "2024-01-01"), (2, t0 + dt.timedelta(days=5), "2024-01-06")], schema).coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming.buckets(read(), "k", "ts").writeStream.format("memory").queryName("buck").outputMode("append").option("checkpointLocation", str(tmp_path / "ckb")).trigger(availableNow=True)
    q.start().awaitTermination(120)
    first = spark.table("buck").count()
    streaming.overwrite_days(read(), out, ck).start().awaitTermination(120)
    again = sorted(map(tuple, spark.read.parquet(out).select("k", "dt").collect()), key=str)
    streaming.overwrite_days(read(), out, str(tmp_path / "ck3")).start().awaitTermination(120)  # a rerun from the start
    assert sorted(map(tuple, spark.read.parquet(out).select("k", "dt").collect()), key=str) == again and len(again) == 2
    # a row later than the watermark doesn't come back into a closed bucket
    assert [(r.k, r.n) for r in spark.table("buck").collect()] == [(1, 1)] and first == 1
