"""Rasters from files: half-float tiles, cleaned windows, and listings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.grids import nodata_clean

def half_tiles(found: DataFrame, width: int, height: int) -> DataFrame:
    """(path, bits, whole): half-float patterns of raw tiles (path, content); whole says whether a tile has all its pixels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bits = [np.frombuffer(c, "<u2", len(c) // 2).astype(np.int32) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "bits": bits, "whole": [len(b) == width * height for b in bits]})

    return found.select("path", "content").mapInPandas(run, "path string, bits array<int>, whole boolean")


def clean_windows(windows: DataFrame, limit: float = 3000.0, fill: float = -200.0) -> DataFrame:
    """Windows with any valid sample, those above the limit filled."""
    return nodata_clean(windows, "pixels", limit, fill)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of files whose name fits a pattern, hidden ones left out; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return files.filter(~F.startswith("name", F.lit(".")))
