import itertools
import random

from pyspark.sql import functions as F

from wayfold.functions import registry
from wayfold.operators import proximity

POINTS = "point_id long, point struct<x: double, y: double>"
LINES = "line_id long, t array<struct<x: double, y: double, m: double>>"


def test_cells_follow_positions_not_rows(spark):
    """A thousand points at each of sixteen positions make the same sixteen spots, cells and broadcast as one at each."""
    rows = [(16 * k + i, (float(i % 4), float(i // 4))) for k in range(1000) for i in range(16)]
    many, one = (proximity.spots_of(spark.createDataFrame(r, POINTS)) for r in (rows, rows[:16]))
    assert (many.n, many.cell) == (one.n, one.cell) == (16, 0.75)
    lines = spark.createDataFrame([(1, [(0.0, 0.0, 0.0), (3.0, 0.0, 10.0)])], LINES)
    assert lines.transform(lambda d: proximity.lines_at_points(d, spark.createDataFrame(rows, POINTS), 0.0, "line_id", "point_id")).count() == 4000
    plan = proximity.lines_at_spots(lines, many, 0.0, "line_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sightings_against_all_pairs(spark, monkeypatch):
    """Fast, slow and resting vehicles, several ids at one place and time, all broadcast or all shuffled."""
    registry.register(spark)
    rnd = random.Random(4)
    at = lambda: (rnd.randrange(8) / 8, rnd.randrange(8) / 8)
    lines = []
    for i in range(40):
        m, t = 0, []
        for _ in range(rnd.randint(1, 6)):
            t.append((*(t[-1][:2] if t and rnd.random() < 0.3 else at()), float(m)))
            m += rnd.choice([8, 800, 8000, 80_000_000])
        lines.append((i, t))
    points = [(i, (rnd.randrange(16) / 16, rnd.randrange(16) / 16)) for i in range(300)]
    instants = sorted({int(v[2]) + rnd.choice([0, 1, 2, 4, 400, 4000, 40_000_000]) for _, t in lines for v in t})
    want = set()
    for (i, t), im in itertools.product(lines, instants):
        for (ax, ay, am), (bx, by, bm) in [*zip(t, t[1:], strict=False), (t[-1], t[-1])]:
            if am <= im < bm or am == im == bm:
                f = 0.0 if am == im else (im - am) / (bm - am)
                x, y = ax + f * (bx - ax), ay + f * (by - ay)
                want |= {(i, qx, qy, float(im)) for _, (qx, qy) in points if (qx, qy) == (x, y)}
    df, q = spark.createDataFrame(lines, LINES), spark.createDataFrame([(k, m) for k, m in enumerate(instants)] * 2, "instant_id long, m long")
    q = q.select("instant_id", F.expr("CAST(timestamp_millis(m) AS TIMESTAMP_NTZ)").alias("instant"))
    for small in (proximity.SMALL, 0):
        monkeypatch.setattr(proximity, "SMALL", small)
        out = proximity.sightings_at(df, proximity.spots_of(spark.createDataFrame(points, POINTS)), q, "line_id", len(instants))
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want and len(want) > 100


def test_q5_makes_trips_of_the_sampled_vehicles_only(spark):
    from wayfold.plans import benchmark

    plan = benchmark.QUERIES["q5"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2 and "Join Inner, (licence1" in plan and "broadcast" in plan


def test_sightings_of_vehicles_that_coincide(spark, tmp_path):
    """Four copies of the events at the same places and times: every pair with every point and instant, by one exchange for the distinct rows and the pairs."""
    import duckdb

    from wayfold.plans import benchmark

    spark.read.parquet("/root/testdata/sf0.01/events.parquet").selectExpr("*", "explode(sequence(0, 3)) AS k").selectExpr("event_id + k * 1024000 AS event_id", "ts", "user_id + k * 1000 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("q11", "q12"):
        df = benchmark.QUERIES[name](spark, str(tmp_path))
        want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({benchmark.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 100
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(licence" not in plan and plan.index("explode(ids") < plan.index("explode(instants")
