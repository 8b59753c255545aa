"""What the corpus operators share: shared-folder tables, document keys, Arrow batch helpers, components.

Conventions used by every operator here
---------------------------------------
* A null text is an empty text.  Null ids are kept and stay null.
* Only the named input columns are read, so extra columns can't clash with the columns an operator adds.
  Operators that hand documents back carry the whole input row in one struct until the end.
* Two rows with the same id *and* the same text are one document: both get the same answer.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python step takes from an Arrow batch at once; bounds a worker's memory, not the input.
SLICE_ROWS = 512
_SAVED: dict[str, list[DataFrame]] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df itself, or dealt out evenly where its files can't be split into a part for each core: a small table in one file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only on one machine without any."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="screenpulse-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/screenpulse-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._screenpulse_path = path
    _SAVED.setdefault(spark.sparkContext.applicationId, []).append(out)
    return out


def forget_all(spark: SparkSession) -> None:
    """Delete every table that saved() wrote in this session; for when their results have been used."""
    for df in _SAVED.pop(spark.sparkContext.applicationId, []):
        forget(df)


def saved_so_far(spark: SparkSession) -> int:
    return len(_SAVED.get(spark.sparkContext.applicationId, []))


def forget_since(spark: SparkSession, mark: int, but: DataFrame) -> None:
    """Delete the tables that were written after saved_so_far() gave mark, except one: for when that one is all that is needed."""
    every = _SAVED.get(spark.sparkContext.applicationId, [])
    for df in every[mark:]:
        if df is not but:
            forget(df)
    every[mark:] = [df for df in every[mark:] if df is but]


def forget(df: DataFrame) -> None:
    """Delete a table that saved() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_screenpulse_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_key(text: Column | str) -> Column:
    """64-bit hash of a text; with the id it names a document across scans."""
    c = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(c, F.lit("")))


def rows_with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`row` (the whole input row) beside `k_id` and `k_text`."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_col].alias("k_id"), text_key(docs[text_col]).alias("k_text"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["k_id"].eqNullSafe(b["k_id"]) & (a["k_text"] == b["k_text"])


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[..., dict[str, list]], ddl: str, schema: pa.Schema) -> DataFrame:
    """fn gets the columns of a slice as lists and returns the output columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict(fn(*(c.to_pylist() for c in part.columns)), schema=schema)

    return df.mapInArrow(run, ddl)


def connected_components(edges: DataFrame) -> DataFrame:
    """(u long, v long) -> (node, root): root is the least node of the component; nodes that are their own root are left out.

    Alternates large-star and small-star steps until the edges stay the same.  A hot node's edges are joined,
    never gathered: its least neighbour comes from a partial aggregation and AQE can split the join.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = state(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, large["u"] == least["c"])
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = saved(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        forget(now)
        now, before = small, mark
        mark = state(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


