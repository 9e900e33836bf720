import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from wayfold.functions import codec
from wayfold.plans.engine import Engine
from wayfold.plans.federation import Federation, Source, filter_sql
from wayfold.sources import files, folding, timeseries
from wayfold.sources.jdbc import OVERWRITE, REPLACE, Store


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def vertices(line):
    return [tuple(v) for v in line]


def test_resolve(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x")
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "sub").mkdir()
    assert [p.rsplit("/", 1)[1] for p in files.resolve(spark, str(tmp_path))] == ["a.csv", "b.csv"]
    assert files.resolve(spark, f"{tmp_path}/a.csv") == [f"{tmp_path}/a.csv"]
    for bad in (f"{tmp_path}/sub", f"{tmp_path}/none"):
        with pytest.raises(files.SourceError):
            files.resolve(spark, bad)


def test_lenient_instants(spark):
    texts = ["2020-06-01", "2020-06-01 08", "2020-06-01 08:30", "2020-06-01 08:30:05.250", "no"]
    got = [r["m"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(files.millis("t").alias("m")).collect()]
    assert got == [1590969600000, 1590998400000, 1591000200000, 1591000205250, None]


def test_trips_and_regions(spark, tmp_path):
    (tmp_path / "t").mkdir()
    rows = ["1,10,2020-06-01 08:00:00.000,2020-06-01 08:00:01.500,1,1,2,2", "1,10,2020-06-01 08:00:01.500,2020-06-01 08:00:03,2,2,3,3", "2,11,2020-06-01,2020-06-01 01,5,5,6,6"]
    (tmp_path / "t/trips.csv").write_text("Moid,Tripid,Tstart,Tend,Xstart,Ystart,Xend,Yend\n" + "\n".join(rows + rows[:1]) + "\n")
    got = {r["trip_id"]: (r["moid"], vertices(r["polyline"])) for r in files.trips(spark, f"{tmp_path}/t").collect()}
    base = 1590998400000
    assert got[10] == (1, [(1, 1, base), (2, 2, base + 1500), (3, 3, base + 3000)]) and got[11][1][1] == (6, 6, 1590969600000 + 3600000)
    edges = "1,1,0,0,0,2\n1,2,0,2,2,2\n1,3,2,2,0,0\n"
    (tmp_path / "r.csv").write_text("RegionId,SegNo,XStart,YStart,XEnd,YEnd\n" + edges * 2)
    (region,) = files.regions(spark, f"{tmp_path}/r.csv").collect()
    assert [tuple(p) for p in region["polygon"][0]] == [(0, 0), (0, 2), (2, 2), (0, 0)]


def test_flat_tables(spark, tmp_path):
    texts = {"points": "Id,X,Y\n1,13.5,52.5\n", "instants": "Id,Instant\n1,2020-06-01 08:00:00.250\n", "periods": "Id,Begin,End\n1,2020-06-01 08:00:00.000,2020-06-02\n", "licences": "Licence,Id\nB-X 1,7\n", "datamcar": "Moid,Licence,Type,Model\n1,B-X 1,truck,M\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {n: files.TABLES[n](spark, f"{tmp_path}/{n}").first() for n in texts}
    assert tuple(got["points"]["point"]) == (13.5, 52.5) and got["instants"]["instant"].microsecond == 250000 and got["periods"]["end_period"].day == 2
    assert tuple(got["licences"]) == (7, "B-X 1") and tuple(got["datamcar"]) == (1, "B-X 1", "truck", "M")
    (tmp_path / "bad").write_text("Id,X,Y\nx,1,2\n")
    with pytest.raises(Exception):
        files.points(spark, f"{tmp_path}/bad").collect()


def test_taxi(spark, tmp_path):
    head = "TRIP_ID,CALL_TYPE,ORIGIN_CALL,ORIGIN_STAND,TAXI_ID,TIMESTAMP,DAY_TYPE,MISSING_DATA,POLYLINE\n"
    (tmp_path / "x.csv").write_text(head + '"a","C","","5","20","100","A","False","[[1.5,2.5],[x,4]]"\n"b","B","7","","21","200","A","TRUE","[]"\n')
    a, b = files.taxi(spark, f"{tmp_path}/x.csv").orderBy("trip_id").collect()
    assert vertices(a["polyline"]) == [(1.5, 2.5, 100), (0, 4, 115)] and a["origin_call"] is None and a["missing_data"] is False
    assert b["polyline"] == [] and b["missing_data"] is True
    (tmp_path / "y.csv").write_text(head + '"a","C","","5","20","100","A","False","[[1.5]]"\n')
    with pytest.raises(Exception, match="not a pair"):
        files.taxi(spark, f"{tmp_path}/y.csv").collect()


def test_birds(spark, tmp_path):
    cells = lambda i, lon, t: f"{i},{lon},51,{t},true,,,,,,,4,,,,,,,,,,,gps,Bird,T1,B1,S"
    (tmp_path / "b.csv").write_text("h\n" + "\n".join([cells(2, 3.5, "2018-05-01 00:00:10.000"), cells(1, 3.25, "2018-05-01 00:00:05.500"), cells(3, "", "2018-05-01 00:00:20")]) + "\n")
    (bird,) = files.birds(spark, f"{tmp_path}/b.csv").collect()
    assert vertices(bird["polyline"]) == [(3.25, 51, 1525132805), (3.5, 51, 1525132810)]
    assert [e["event_id"] for e in bird["events"]] == [1, 2, 3] and bird["events"][2]["location_long"] is None and len(bird["events"][0]) == 23


def test_fold_source(spark, tmp_path):
    folding.register(spark)
    for name, trip in (("a.csv", 1), ("b.csv", 2)):
        (tmp_path / name).write_text(f"h\n9,{trip},0,1,0,0,1,1\n9,{trip},1,2,1,1,2,2\n")
    schema = "trip_id BIGINT, moid BIGINT, polyline ARRAY<STRUCT<x:DOUBLE,y:DOUBLE,m:DOUBLE>>"
    df = spark.read.format("wayfold_fold").schema(schema).options(path=str(tmp_path), fold="wayfold.sources.folding:adjacent_trips").load()
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r["trip_id"], vertices(r["polyline"])) for r in df.collect()) == [(t, [(0, 0, 0), (1, 1, 1), (2, 2, 2)]) for t in (1, 2)]


@pytest.fixture(scope="module")
def store(spark, engine, tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "d"
    s = Store(spark, f"jdbc:derby:{path};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    s.execute(["CREATE TABLE TRIPS (TRIP_ID BIGINT PRIMARY KEY, MOID BIGINT, POLYLINE VARCHAR(4000))", "CREATE TABLE CARS (MOID BIGINT, KIND VARCHAR(20))", "INSERT INTO CARS VALUES (1, 'truck'), (2, 'bus')"])
    return s


def test_jdbc_modes(spark, engine, store):
    rows = engine.sql("SELECT id AS TRIP_ID, id AS MOID, trajectory_from_text(concat('LINESTRING M(0 0 0, 1 1 ', id, ')')) AS POLYLINE FROM range(1, 4)")
    store.write(rows, "TRIPS")
    back = store.table("TRIPS").withColumn("t", F.expr("wkb_to_trajectory(unhex(POLYLINE))"))
    assert sorted((r["TRIP_ID"], vertices(r["t"])[1]) for r in back.collect()) == [(i, (1, 1, i)) for i in (1, 2, 3)]
    store.write(rows.where("TRIP_ID = 3").withColumn("MOID", F.lit(30)).unionByName(rows.where("TRIP_ID = 1").withColumn("TRIP_ID", F.lit(9))), "TRIPS", REPLACE, ["TRIP_ID"])
    assert sorted((r["TRIP_ID"], r["MOID"]) for r in store.table("TRIPS").collect()) == [(1, 1), (2, 2), (3, 30), (9, 1)]
    store.write(rows.where("TRIP_ID < 3"), "TRIPS", OVERWRITE)
    assert store.table("TRIPS").count() == 2
    with pytest.raises(ValueError, match="no column"):
        store.write(rows.withColumnRenamed("MOID", "OTHER"), "TRIPS")
    with pytest.raises(ValueError):
        store.table("TRIPS; DROP TABLE TRIPS")


def test_catalog_and_pushdown(spark, store):
    store.catalog("wfdb")
    df = spark.sql("SELECT KIND FROM wfdb.APP.CARS WHERE MOID > 1")
    assert [r[0] for r in df.collect()] == ["bus"]
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "MOID > 1" in plan


def test_federation(spark, engine, store):
    store.write(engine.sql("SELECT id AS TRIP_ID, id AS MOID, trajectory_from_text(concat('LINESTRING M(0 0 0, 1 1 ', id * 1000, ')')) AS POLYLINE FROM range(1, 3)"), "TRIPS", OVERWRITE)
    fed = Federation(engine)
    fed.add(Source("db.app", store))
    whole = "SELECT c.KIND, count(*) AS N FROM db.app.TRIPS t JOIN db.app.CARS c ON t.MOID = c.MOID GROUP BY c.KIND"
    source, text = fed.whole(whole)
    assert "db.app" not in text and source.store is store
    assert sorted(map(tuple, fed.sql(whole).collect())) == [("bus", 1), ("truck", 1)]
    spark.range(1, 3).withColumnRenamed("id", "MOID").createOrReplaceTempView("here")
    mixed = "SELECT t.TRIP_ID, duration(wkb_to_trajectory(unhex(t.POLYLINE))) AS D FROM db.app.TRIPS t JOIN here h ON t.MOID = h.MOID"
    assert fed.whole(mixed) is None and fed.whole("SELECT duration(t.POLYLINE) AS D FROM db.app.TRIPS t") is None
    assert sorted(map(tuple, fed.sql(mixed).collect())) == [(1, 1000), (2, 2000)]
    near = "SELECT t.TRIP_ID FROM db.app.TRIPS t WHERE passes_point(t.POLYLINE, t.P, {})"
    fed.sources["db.app"].shipped = frozenset({"passes_point"})
    assert fed.whole(near.format("0.0")) and not fed.whole(near.format("5"))


def test_filter_text():
    assert filter_sql("t", "contained", "'strict'", "'POLYGON((0 0,0 1,1 1,0 0))'") == "ST_Contains(ST_GeomFromText('POLYGON((0 0,0 1,1 1,0 0))', 4326), t)"
    assert filter_sql("t", "contained", "'relaxed'", "p") is None and filter_sql("t", "leaves", "'x'") is None and filter_sql("t", "st_length") == "st_length(t)"


class Handler(http.server.BaseHTTPRequestHandler):
    seen: list = []
    rows = [{"trip_id": 1, "moid": 2, "index": i, "x": float(i), "y": 0.0, "time": 1000 * i} for i in (1, 0, 2)]

    def do_GET(self):
        self.seen.append(urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["q"][0])
        self.send_response(200)
        self.end_headers()
        self.wfile.write("\n".join(json.dumps(r) for r in self.rows).encode())

    def do_POST(self):
        self.seen.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
        self.send_response(200)
        self.end_headers()
        if "match" in self.path:
            self.wfile.write(json.dumps({"paths": [{"points": {"coordinates": [[1, 2], [3, 4]]}}]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_series(spark, engine, server):
    (trip,) = timeseries.trips(spark, url=server, db="d").where("trip_id = 1").collect()
    assert vertices(trip["polyline"]) == [(0, 0, 0), (1, 0, 1000), (2, 0, 2000)]
    assert "FROM trips" in Handler.seen[-1] and "trip_id = 1" in Handler.seen[-1]
    df = engine.sql("SELECT 1 AS trip_id, 2 AS moid, trajectory_from_text('LINESTRING M(1 2 3, 4 5 6)') AS polyline")
    assert [r["line"] for r in timeseries.trip_lines(df).collect()] == ["trips,trip_id=1,moid=2 index=0i,x=1.0,y=2.0 3", "trips,trip_id=1,moid=2 index=1i,x=4.0,y=5.0 6"]
    flat = spark.sql("SELECT 'a b' AS k, 'x\"y' AS s, 5 AS n, 1.5D AS d")
    assert timeseries.lines(flat, "cars", ["k"], ["s", "n", "d"]).first()["line"] == 'cars,k=a\\ b s="x\\"y",n=5i,d=1.5 0'
    timeseries.write(timeseries.trip_lines(df), server, "d")
    assert "trips,trip_id=1,moid=2 index=0i,x=1.0,y=2.0 3" in Handler.seen[-1]


def test_map_match(spark, engine, server):
    spark.udf.register("match_here", codec.map_matcher(codec.http_client(f"{server}/match")))
    row = engine.sql("SELECT match_here(trajectory_from_text('LINESTRING M(1 1 1000, 2 2 2000)')) AS a, match_here(trajectory_from_text('LINESTRING M(1 1 1000)')) AS b").first()
    assert [tuple(p) for p in row["a"]] == [(1, 2), (3, 4)] and row["b"] is None
    assert "<time>1970-01-01T00:00:01.000Z</time>" in next(s for s in Handler.seen[::-1] if "gpx" in s)
    spark.udf.register("match_none", codec.map_matcher(codec.http_client("http://127.0.0.1:9/match", timeout_s=1)))
    assert engine.sql("SELECT match_none(trajectory_from_text('LINESTRING M(1 1 1000, 2 2 2000)')) AS a").first()["a"] is None


def test_sessions(spark, tmp_path):
    from wayfold.streaming.trips import sessions

    rows = [(1, "2024-01-01 00:00:00", 0.0), (1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 02:00:00", 2.0), (2, "2024-01-01 00:00:00", 3.0)]
    positions = spark.createDataFrame(rows, "moid long, ts string, x double").selectExpr("moid", "CAST(ts AS TIMESTAMP) AS ts", "x", "x AS y")
    assert sorted((r["moid"], r["n"]) for r in sessions(positions).collect()) == [(1, 1), (1, 2), (2, 1)]
    positions.write.parquet(f"{tmp_path}/in")
    stream = sessions(spark.readStream.schema(positions.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["moid"], r["n"]) for r in spark.table("sess").collect()} == {(1, 2), (2, 1)}


def test_database_that_several_processes_read(spark, engine, tmp_path):
    """One process writes, any may read: texts, nulls and all three modes come back as they were, through scans with pushdown."""
    from wayfold.sources.jdbc import Embedded

    db = Embedded.create(spark, f"file://{tmp_path}/e")
    db.execute(["CREATE TABLE T (ID BIGINT PRIMARY KEY, S VARCHAR(100), D DOUBLE, B TIMESTAMP)"])
    rows = [(1, 'a "quoted", text', 1.5, "2024-01-01 00:00:00.25"), (2, "", None, None), (3, None, -2.0, "2024-01-02 03:04:05"), (4, " two\nlines ", 0.0, None), (5, "back\\slash é", 1e-300, None)]
    df = spark.createDataFrame(rows, "ID long, S string, D double, B string").withColumn("B", F.expr("CAST(B AS TIMESTAMP)")).repartition(2)
    db.write(df.where("ID < 4"), "T")
    db.write(df.where("ID > 3").unionByName(df.where("ID = 1").withColumn("D", F.lit(7.5))), "T", REPLACE, ["ID"])
    shared = db.published()
    want = sorted(tuple(r) for r in df.withColumn("D", F.expr("IF(ID = 1, 7.5D, D)")).collect())
    assert sorted(tuple(r) for r in shared.table("T").collect()) == want
    db.write(df.where("ID = 2"), "T", OVERWRITE)
    assert [r["ID"] for r in db.published().table("T").where("S = ''").collect()] == [2]


@pytest.mark.parametrize("name", ["src_jdbc_modes", "src_jdbc_pushed"])
def test_database_queries_without_a_local_master(spark, monkeypatch, name):
    from wayfold.plans import source_queries

    data = "/root/testdata/sf0.001"
    want = sorted(map(tuple, source_queries.QUERIES[name](spark, data).collect()))
    monkeypatch.setattr(source_queries, "_one_process", lambda s: False)
    assert sorted(map(tuple, source_queries.QUERIES[name](spark, data).collect())) == want and want


@pytest.mark.parametrize("shared", [False, True])
def test_replace_finds_keys_by_an_index(spark, tmp_path, shared):
    """Rows to be replaced were compared with every staged row, and texts passed through CLOBs."""
    import time

    from wayfold.sources.jdbc import Embedded

    db = Embedded.create(spark, f"file://{tmp_path}/e") if shared else Store(spark, f"jdbc:derby:{tmp_path}/d;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    db.execute(["CREATE TABLE T (ID BIGINT PRIMARY KEY, N BIGINT, S VARCHAR(1000))"])
    seen, execute = [], db.execute
    db.execute = lambda statements, **more: (seen.extend(statements), execute(statements, **more))
    rows = spark.range(24_000).selectExpr("id AS ID", "id AS N", "repeat('x', 200) AS S")
    db.write(rows.where("ID < 12000"), "T", OVERWRITE)
    began = time.time()
    db.write(rows.where("ID >= 6000").withColumn("N", F.lit(-1)), "T", REPLACE, ["ID"])
    assert time.time() - began < 60 and any(s.startswith("CREATE INDEX") for s in seen) and not any("CLOB" in s for s in seen)
    back = (db.published() if shared else db).table("T", ("ID", 0, 24_000, 3))
    assert back.rdd.getNumPartitions() == 3
    assert tuple(back.selectExpr("count(*)", "count(DISTINCT ID)", "sum(IF(N = -1, 1, 0))", "sum(IF(N = ID AND ID < 6000, 1, 0))", "min(length(S))").first()) == (24_000, 24_000, 18_000, 6_000, 200)


def test_embedded_writes_hold_or_leave_the_table(spark, tmp_path):
    """No rows empty the table on overwrite; a failed import leaves what was there, and no scratch files stay."""
    import os

    from wayfold.sources.jdbc import Embedded

    db = Embedded.create(spark, f"file://{tmp_path}/e")
    db.execute(["CREATE TABLE T (ID BIGINT PRIMARY KEY, S VARCHAR(10))"])
    df = spark.createDataFrame([(1, "a"), (2, None)], "ID long, S string")
    db.write(df, "T", OVERWRITE)
    with pytest.raises(Exception):
        db.write(df.unionByName(df), "T", OVERWRITE)
    with pytest.raises(Exception):
        db.write(df.withColumn("ID", F.lit(1)).unionByName(df), "T", REPLACE, ["ID"])
    assert sorted(map(tuple, db.table("T").collect())) == [(1, "a"), (2, None)]
    db.write(df.where("ID > 5"), "T", REPLACE, ["ID"])
    assert db.table("T").count() == 2
    db.write(df.where("ID > 5"), "T", OVERWRITE)
    assert db.table("T").count() == 0 and os.listdir(f"{tmp_path}/e") == ["db"]
