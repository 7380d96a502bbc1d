"""What tests of queries share: DuckDB over the smallest tables, and rows in a form that compares."""

import math
import os

import duckdb


class Tables:
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

    def connection(self):
        con = duckdb.connect()
        for t in "nation customer supplier part orders lineitem events embeddings".split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{self.folder}/{t}.parquet'")
        return con


db = Tables()


def rows_of(columns, found):
    """Rows with columns by name, floats rounded, sorted."""
    at = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: round(v, 5) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(str(tuple(cell(r[i]) for i in at)) for r in found)
