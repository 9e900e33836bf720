import pytest

from wayfold.plans import crop
from wayfold.plans.engine import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.sql("SELECT 1 AS id, trajectory_from_text('LINESTRING M(1 1 10, 2 2 20, 3 3 30, 4 4 40)') AS t UNION ALL SELECT 2, NULL").createOrReplaceTempView("lines")
    return e


def pieces(engine, expr):
    row = engine.sql(f"SELECT crop(t, {expr}) FROM lines WHERE id = 1").first()
    return [[v["m"] for v in p] for p in row["crop"]]


CASES = [
    ("during('0','5')", []), ("during('41','50')", []), ("during('20','30')", [[20, 30]]), ("during('15','35')", [[20, 30]]),
    ("not_during('0','5')", [[10, 20, 30, 40]]), ("not_during('41','50')", [[10, 20, 30, 40]]), ("not_during('20','30')", [[10], [40]]), ("not_during('15','35')", [[10], [40]]), ("not_during('0','50')", []),
    ("follows('41')", []), ("follows('9')", [[10, 20, 30, 40]]), ("follows('20')", [[30, 40]]), ("follows('25')", [[30, 40]]),
    ("precedes('41')", [[10, 20, 30, 40]]), ("precedes('9')", []), ("precedes('20')", [[10]]), ("precedes('25')", [[10, 20]]),
    ("not_during('20','30') AND follows('15')", [[40]]), ("during('10','20') OR during('20','30')", [[10, 20], [20, 30]]),
    ("during('10','20') OR during('20','30') AND follows('15')", [[20], [20, 30]]), ("during('10','20') OR (during('20','30') AND follows('25'))", [[10, 20], [30]]),
]


@pytest.mark.parametrize(("expr", "want"), CASES)
def test_times(engine, expr, want):
    assert pieces(engine, expr) == want


def test_regions(engine, spark):
    square = "POLYGON((0 0,3 0,3 3,0 3,0 0))"
    run = lambda name, wkt: [[v["m"] for v in p] for p in engine.sql(f"SELECT t, crop(t, {name}('{square}')) AS c FROM (SELECT trajectory_from_text('{wkt}') AS t)").first()["c"]]
    assert run("contained", "LINESTRING M(-1 -1 10, 1 1 20, 4 4 30, 2 2 40, 4 1 50)") == [[20], [40]]
    assert run("not_contained", "LINESTRING M(1 1 10, 4 4 20, 2 2 30, -1 1 40, -2 1 50)") == [[20], [40, 50]]


def test_front_door(engine, spark):
    assert engine.sql("SELECT id, CROP(t, during('10','20')) FROM lines WHERE id = 2").first()["crop"] == []
    row = engine.sql("SELECT l.id, crop(l.t, follows('30')) AS a, crop(l.t, precedes('20')) AS b FROM lines l WHERE 'crop(' <> '' AND id = 1 -- crop(x").first()
    assert [[v["m"] for v in p] for p in row["a"]] == [[40]] and [[v["m"] for v in p] for p in row["b"]] == [[10]]
    row = engine.sql("SELECT subpolyline_between(t, CAST(timestamp_millis(15) AS TIMESTAMP_NTZ), CAST(timestamp_millis(30) AS TIMESTAMP_NTZ)) AS part, crop(part, during('0','25')) AS c FROM lines WHERE id = 1").first()
    assert [[v["m"] for v in p] for p in row["c"]] == [[15, 20]]
    assert engine.sql("SELECT arrow_cast(1500, 'Timestamp(Millisecond, None)') AS v").first()["v"].microsecond == 500000
    engine.attach("csv.berlinmod.trips", spark.table("lines"))
    assert engine.sql("SELECT count(*) AS n FROM csv.berlinmod.trips t WHERE t.id = 1").first()["n"] == 1
    assert "csv.berlinmod.trips" in {r["name"] for r in engine.list_tables().collect()}
    assert "Physical Plan" in engine.plan("SELECT crop(t, during('0','5')) FROM lines")
    assert engine.answer("SELECT id FROM lines WHERE id = 1") == {"data": [{"id": 1}], "schema": {"id": "int"}}


def test_file_tables(engine, spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x.parquet")
    assert engine.sql(f"SELECT count(*) AS n FROM '{tmp_path}/x.parquet'").first()["n"] == 3


@pytest.mark.parametrize("expr", ["during('1')", "nothing('1')", "during('2','1')", "during(1, 2)", "contained('LINE(1 1)')", "during('1','2') AND", "during('a','b')"])
def test_errors(expr):
    with pytest.raises(crop.CropError):
        crop.compile_crop("t", expr)


def test_frame_api(spark, engine):
    out = crop.crop(spark.table("lines"), "t", "follows('30')")
    assert out.columns == ["id", "t", "crop"]
