"""What several operators share: tables written to the cluster's shared folder, connected components, bounded batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.scratch import shared_folder

def _write(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/palimpsest/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read from there, which cuts its lineage."""
    return _write(df)[0]


def _removed(spark: SparkSession, path: str) -> None:
    """Takes away a table of ours that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(taken: list[str], name: str) -> str:
    """``name``, or one like it that no column has, case aside."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def in_parts(frames: Iterator[pd.DataFrame], text: str = "text", most: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """Rows in parts of about ``most`` characters, one row at least; Spark itself bounds a batch by rows and bytes."""
    for frame in frames:
        sizes = frame[text].str.len().fillna(0).to_numpy(np.int64).cumsum()
        at = 0
        while at < len(frame):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield frame.iloc[at:end]
            at = end


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (columns a, b): rows (id, component) for every id on an edge.

    ``component`` is the smallest id that can be reached. Each round hangs larger neighbours, then smaller ones, on the
    smallest neighbour; the number of rounds grows with the logarithm of the longest path. Every round is two partial
    minimum aggregations and two joins, so a hub is pre-aggregated on the map side and its join side can be split.
    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now, path = _write(now.distinct())
    if now.isEmpty():
        return now.selectExpr("u as id", "v as component")
    before = None
    for _ in range(most_rounds):
        both = now.union(now.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").selectExpr("v as u", "m as v")
        old = path
        now, path = _write(small.union(lower.selectExpr("u", "m as v")).distinct())
        _removed(now.sparkSession, old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )


def map_rows(rows: DataFrame, each: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, key: str = "doc_id") -> DataFrame:
    """``rows.mapInPandas(each, schema)`` for rows whose long ``key`` may be null: pandas sees it as text, since it would make floats of such numbers."""
    coded = schema.replace(f"{key} long", f"{key} string")
    out = rows.withColumn(key, F.col(key).cast("string")).mapInPandas(each, coded)
    return out.withColumn(key, F.col(key).cast("long"))
