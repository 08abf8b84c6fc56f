"""Every registered query of the watershed operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from talweg.plans.oracles import ORACLES
from talweg.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    key = lambda r: tuple(str(v) for v in r)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    theirs = sorted(con.sql(ORACLES[name]).select(*[f'"{c}"' for c in cols]).fetchall(), key=key)
    assert mine == theirs


def test_entry_lists_every_query_with_sql():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.oracle_sql())


def test_drains_to_every_cell(spark, sf):
    import __spark_entry__
    from talweg.plans.queries import flow

    down = {r["node"]: r["down"] for r in flow(spark, sf).select("node", "down").collect()}

    def way(n):
        while n is not None:
            yield n
            n = down[n]

    got = __spark_entry__.queries()["drains_to_every"](spark, sf).collect()
    assert sorted(r["source"] for r in got) == sorted(down) and len({r["target"] for r in got}) == 1
    assert all(r["drains"] == (r["target"] in way(r["source"])) for r in got)


def test_scene_choice_of_many_scenes(spark, tmp_path):
    """Requests of more than five scenes, whose order by cloud isn't that of their numbers."""
    events = spark.range(9000).selectExpr("id AS event_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 30 AS int)) AS ts", "id * 7 % 900 AS user_id")
    events.write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    mine = sorted(tuple(r) for r in QUERIES["scene_choice"](spark, str(tmp_path)).collect())
    assert mine == sorted(c.sql(ORACLES["scene_choice"]).fetchall()) and len(mine) == 50


def test_nearest_meets_few_places_however_many_there_are(spark):
    """The cells follow the places: a point's candidates don't grow with them, crowded or not, and the answers are those of all pairs."""
    from pyspark.sql import functions as F

    from talweg.operators import layers

    for most in (500, 20_000):
        n = spark.range(most)
        x, y = F.col("id") * 7919 % 40_009 * 1.0, F.col("id") * 104_729 % 39_989 * 1.0
        places = n.select(F.col("id").alias("place_id"), F.concat(F.lit("p"), "id").alias("name"), F.when(F.col("id") % 2 == 0, x / 100).otherwise(x).alias("px"), F.when(F.col("id") % 2 == 0, y / 100).otherwise(y).alias("py"))
        cell = layers.sparse_cell(places)
        met = layers.within(n.select("id", (x + 0.5).alias("x"), (y + 0.5).alias("y")), places, "id", "name", cell).count()
        cells = places.groupBy(F.floor(F.col("px") / cell), F.floor(F.col("py") / cell)).count()
        assert cells.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] <= 5 and met > 0
    some = spark.range(60).select("id", (F.col("id") * 641.5).alias("x"), (F.col("id") * 911 % 40_000 * 1.0).alias("y"))
    got = {r["id"]: r["place_id"] for r in layers.nearest(some, places.withColumnRenamed("px", "x").withColumnRenamed("py", "y")).collect()}
    rows = places.collect()
    assert got == {p["id"]: min(rows, key=lambda r: ((r["px"] - p["x"]) ** 2 + (r["py"] - p["y"]) ** 2, r["place_id"]))["place_id"] for p in some.collect()}


def test_tile_work_is_spread_over_tasks(spark, sf):
    """Areas that a reader puts into one task are dealt to all cores before their tiles and sheets are found."""
    from talweg.operators import tiles
    from talweg.plans.fixtures import boxes

    one = boxes(spark, sf).coalesce(1)
    for found in (tiles.select(one, size=3), tiles.sheets(one)):
        assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rounds_of_a_fill_join_border_cells_only(spark, monkeypatch):
    """What wakes a block is looked up among the cells at block borders, not among all."""
    from pyspark.sql import functions as F

    from talweg.operators import hydro

    rounds, useful = [], hydro.useful

    def watched(edge, state, block):
        inner = state.where(F.pmod("row", F.lit(block)).between(1, block - 2) & F.pmod("col", F.lit(block)).between(1, block - 2))
        rounds.append(inner.count())
        return useful(edge, state, block)

    monkeypatch.setattr(hydro, "useful", watched)
    cells = spark.range(256).selectExpr("cast(id div 16 as int) AS row", "cast(id % 16 as int) AS col", "id * 7919 % 1009 AS z")
    hydro.fill(cells, 8, whole=True).count()
    assert rounds and not any(rounds)


def test_rounds_of_a_fill_write_blocks_not_cells(spark, monkeypatch):
    """From the first round on no table holds a row for each cell: rows of fills are those of blocks, and of border cells to lower."""
    from talweg.operators import hydro

    written, cut = [], hydro.checkpointed

    def watched(df, *more):
        done = cut(df, *more)
        written.append(done.count())
        return done

    monkeypatch.setattr(hydro, "checkpointed", watched)
    cells = spark.range(1600).selectExpr("cast(id div 40 as int) AS row", "cast(id % 40 as int) AS col", "id * 7919 % 1009 AS z")
    assert hydro.fill(cells, 8, whole=True, spill=False).count() == 1600
    assert len(written) > 4 and max(written) <= 25


def test_fill_of_doubles_steps_over_zero(spark):
    """Steps up by the next double, below zero, over it and from minus zero on, over block borders."""
    import math
    import struct

    from talweg.operators import hydro
    from test_watershed import heap_fill

    tiny = struct.unpack("d", struct.pack("q", 1))[0]
    z = {(r, c): [-3 * tiny, -0.0, -2 * tiny, -1.5, tiny, 1e300][r * 7919 % 101 * (c + 3) % 6] for r in range(20) for c in range(19) if (r, c) != (9, 9)}
    z |= {(r, c): -5 * tiny for r in range(3, 16) for c in range(3, 6)}
    cells = spark.createDataFrame([(*k, v) for k, v in z.items()], "row int, col int, z double")
    for spill in (False, True):
        got = {(x["row"], x["col"]): (x["z"], x["f"]) for x in hydro.fill(cells, 8, spill=spill).collect()}
        assert got == {k: (z[k], v) for k, v in heap_fill(z).items()} and any(math.isclose(v, 0, abs_tol=9 * tiny) and v > z[k] for k, (_, v) in got.items())


def test_flow_takes_places_from_numbers(spark, sf, monkeypatch):
    """Rows and columns of a flow come without a join of all cells; they are those of the numbers, below zero too."""
    from talweg.operators import hydro
    from talweg.plans import queries

    plans, cut = [], queries.checkpointed
    monkeypatch.setattr(queries, "checkpointed", lambda df, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, *more))
    queries.flow(spark, sf)
    assert plans[-1].count("Join") <= 1  # what enters blocks
    spots = [(0, 0), (3, -1), (-2, 5), (-1, -(1 << 31)), ((1 << 31) - 1, (1 << 31) - 1)]
    got = hydro.placed(spark.createDataFrame(spots, "r int, c int").withColumn("node", hydro.node("r", "c")))
    assert all((x["row"], x["col"]) == (x["r"], x["c"]) for x in got.collect())


def test_a_grid_is_made_by_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """Rows are dealt to more tasks the more there are; prices are rounded as ever, halves away from zero."""
    from pyspark.sql import functions as F

    from talweg.plans import fixtures

    monkeypatch.setattr(fixtures, "ROWS", 100, raising=False)
    rows = spark.range(4000).selectExpr("id * 7919 % 100003 AS l_orderkey", "id * 104729 % 100019 AS l_partkey", "IF(id % 50 = 7, NULL, (id * 37 % 1001 - 500) / 2D) AS l_extendedprice")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    want: dict = {}
    for x in rows.collect():
        at, v = (x["l_orderkey"] % 40, x["l_partkey"] % 40), x["l_extendedprice"]
        want[at] = min((w for w in (want.get(at), v and int(abs(v) + 0.5) * (1 if v > 0 else -1)) if w is not None), default=None)
    cells = fixtures.dem(spark, str(tmp_path), 3)
    assert {(x["row"], x["col"]): x["z"] for x in cells.collect()} == {k: v if v is None else 3 * v for k, v in want.items()}
    made = cells.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(made) >= 30 and max(x["count"] for x in made) < 100


def watched_cuts(monkeypatch, plan):
    """The plans, by `plan` of what Spark made of each, of all that the flow's operators cut."""
    from talweg.operators import hydro

    plans, cut = [], hydro.checkpointed
    monkeypatch.setattr(hydro, "checkpointed", lambda df, *more: plans.append(plan(df._jdf.queryExecution()).toString()) or cut(df, *more))
    return plans


def test_a_channel_is_sought_among_channel_cells(spark, monkeypatch):
    """Cells below the threshold are left out before children are compared; the channel is that of a plain walk up."""
    from talweg.operators import hydro

    down = {i: (i - 1) // 2 if i else None for i in range(64)} | {64: 40, 65: 64, 66: None}
    acc = {i: 1 for i in down}
    for i in sorted(down, reverse=True):
        if down[i] is not None:
            acc[down[i]] += acc[i]
    flow = spark.createDataFrame([(i, down[i], acc[i]) for i in down], "node long, down long, acc long")
    for threshold in (1, 2, 5, 1000):
        plans = watched_cuts(monkeypatch, lambda q: q.optimizedPlan())
        want, at = [], 0
        while at is not None:
            want.append((at, len(want)))
            at = max((i for i in down if down[i] == at and acc[i] >= threshold), key=lambda i: (acc[i], -i), default=None)
        assert sorted(map(tuple, hydro.main_channel(flow, 0, threshold).collect())) == sorted(want)
        assert threshold == 1 or plans[0].index("Aggregate") < plans[0].index(f">= {threshold}")


def test_one_target_meets_cells_without_a_shuffle(spark, monkeypatch):
    """The target that all pairs share goes to the cells as one row, not as what is distinct among all pairs once more."""
    from talweg.operators import hydro

    plans = watched_cuts(monkeypatch, lambda q: q.sparkPlan())
    edges = spark.range(2000).selectExpr("id AS node", "IF(id % 50 = 0, NULL, id - 1) AS down")
    pairs = edges.selectExpr("node AS source", "IF(node < 0, 0L, 100L) AS target")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100)
    try:
        got = hydro.drains_to(edges, pairs, 8).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {x["source"] for x in got if x["drains"]} == set(range(100, 150)) and len(got) == 2000
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
