"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space, as a Java and Python regular expression class.
SPACE = r"[\x20\x09-\x0D]"


#: A key counts as hot if it has more than 1/SHARE of all rows; so at most SHARE keys are.
SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cairn-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder and cut its lineage, so later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def unused(columns: list[str], name: str) -> str:
    """name, or name after underscores, such that no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_counted(rows: DataFrame, table: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Inner join of rows with table, which says in n_rows how many rows have the key; n_rows goes.

    Keys with more than 1/share of all rows, at most `share` in number, meet
    their rows by broadcast, so these stay where they are; the others are
    shuffled.  rows and table are read more than once: pass checkpoints or
    cheap scans.
    """
    total, most = table.agg(F.sum("n_rows"), F.max("n_rows")).first()
    if (most or 0) * share <= (total or 0):
        return rows.join(table.drop("n_rows"), key)
    hot = F.col("n_rows") * share > total
    many, few = F.broadcast(table.filter(hot).drop("n_rows")), table.filter(~hot).drop("n_rows")
    return rows.join(many, key).unionByName(rows.join(many.select(key).distinct(), key, "left_anti").join(few, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_bytes(text: Column) -> Column:
    """UTF-8 length; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver as an Arrow table, which takes no Python worker to read."""
    fields = T.StructType.fromDDL(schema)
    table = pa.Table.from_pylist([dict(zip(fields.names, r)) for r in rows], to_arrow_schema(fields))
    return spark.createDataFrame(table, fields)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ship(spark: SparkSession, build, *args) -> Broadcast:
    """Broadcast what builds a value (of a size that args bound); see shipped()."""
    return spark.sparkContext.broadcast({"parts": cloudpickle.dumps((build, args))})


def shipped(sent: Broadcast):
    """The value of ship(): each Python worker builds it once, at first use."""
    held = sent.value
    if "value" not in held:
        build, args = cloudpickle.loads(held["parts"])
        held["value"] = build(*args)
    return held["value"]


def small(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about `most` bytes, so that what is made of one stays small; a row is never cut."""
    for batch in batches:
        rows = max(1, int(most * batch.num_rows / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
