"""Repeated rows of vectors against the query's own SQL."""

import duckdb
import numpy as np

from cairn.llm.queries import ORACLE_SQL, op5_exact_top_k


def test_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(350)]
    rows += rows[:20] * 2 + [(100, rows[100][1]), (5, rows[6][1]), (200, rows[3][1]), (7, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in op5_exact_top_k(spark, f"file://{tmp_path}").select("query_id", "rank", "vec_id", "score").collect())
    want = sorted(con.sql("SELECT query_id, rank, vec_id, score FROM (" + ORACLE_SQL["op5_exact_top_k"] + ")").fetchall())
    assert got == want and len(got) == 40
