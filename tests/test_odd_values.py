"""Queries against their SQL on small tables of values that fall on edges: straight views, halves, exact touches."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from cairn.functions import formats
from cairn.plans.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from tests_support import rows_of


def agree(spark, folder, name, table, columns):
    """Both results of a query over one table, checked to be equal."""
    found = pa.table(columns)
    pq.write_table(found, f"{folder}/{table}.parquet")
    got = QUERIES[name](spark, f"file://{folder}")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        want = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        rows = rows_of(names, want.fetchall())
    assert rows_of(got.columns, got.collect()) == rows
    return rows


def test_camera_offsets_straight_up_and_of_no_length(spark, tmp_path):
    """19 k + 9 has no dy; of 7 such ids one has no dz."""
    ids = [19 * k + 9 for k in range(7)] + [0, 1]
    rows = agree(spark, tmp_path, "camera_offsets", "events", {"event_id": ids, "value": [50.0] * len(ids)})
    assert sum("nan" in r for r in rows) == 7


def test_one_decimal_by_the_binary_value(spark):
    """As C's printf, and so Python's, rounds it."""
    rng = random.Random(4)
    values = [26.25, 26.35, 0.15, 0.25, 0.35, 0.45, 0.05, 9.95, 99.95, 3.0, 1234567.85, *[rng.randrange(14400) / 20 for _ in range(500)], *[rng.uniform(0, 72) for _ in range(500)]]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", formats.tenths(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in got] == [(v, f"{v:.1f}") for v in values]


def test_recode_chain_of_mirrored_tiles(spark, tmp_path):
    """Tiles of four equal quadrants, whose interpolated heights often equal the true ones, or miss them by a last bit."""
    rng = random.Random(6)
    tiles = []
    for _ in range(120):
        part = [[rng.choice((-0.3, 0.1, 0.4, 0.7)) for _ in range(4)] for _ in range(4)]
        tiles.append([part[y % 4][x % 4] for y in range(8) for x in range(8)])
    rows = agree(spark, tmp_path, "recode_chain", "embeddings", {"vec_id": list(range(120)), "embedding": pa.array(tiles, pa.list_(pa.float32()))})
    assert sum("'quadrant'" in r for r in rows) == 90


def test_terrain_picks_of_a_ray_that_touches_an_edge(spark, tmp_path):
    """Ray 37011 meets the line from -135 to 79 at y = 18502 exactly, with lower ground on both sides; the SQL's roots lie beyond their cells by a last bit."""
    ids = list(range(36976, 37024))
    tiles = np.full((len(ids), 8, 8), -0.2995)
    tiles[ids.index(36995), 6, 1:3] = -0.1345, 0.0795
    assert np.floor(tiles.astype(np.float32).astype(float)[ids.index(36995), 6, 1:3] * 1000).tolist() == [-135, 79]
    rows = agree(spark, tmp_path, "terrain_picks", "embeddings", {"vec_id": ids, "embedding": pa.array(tiles.reshape(-1, 64).tolist(), pa.list_(pa.float32()))})
    assert len(rows) == len(ids)


def test_osgb_to_wgs_far_off_the_grid(spark, tmp_path):
    """Northings far beyond the pole, where the last bits of a latitude show in the result."""
    keys, customers, prices = zip(*[(1050069, 112618, 94374.05), (1050071, 110774, 93817.01), (1050121, 112325, 436612.67), (1050128, 110215, 71157.92)])
    agree(spark, tmp_path, "osgb_to_wgs", "orders", {"o_orderkey": keys, "o_custkey": customers, "o_totalprice": prices})
