"""What several operators share: the shared folder, text passes over Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one in local runs and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` wrote and that nothing reads any more."""
    spark = df.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath() == base.toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """All columns of `docs` as one struct `row`, beside `columns`: names of the one never clash with those of the others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def map_text(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], fn: Callable[[list[bytes | None]], list], keep: Iterable[str] | None = None) -> DataFrame:
    """Append the columns that `fn` computes from the texts of one Arrow batch.

    The text goes to Python as UTF-8 bytes; every other column passes through as it is. `fn` gets the
    list of texts and returns one list or array for each of `fields`. `keep`: the columns to pass through.
    """
    kept = [c for c in (df.columns if keep is None else keep)]
    source = df.select(*[F.col(c) for c in kept], F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, t) for n, t in fields]])
    kinds = [to_arrow_type(t) for _, t in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(b.column(b.num_columns - 1).to_pylist())
            arrays = [b.column(i) for i in range(b.num_columns - 1)]
            arrays += [pa.array(m, type=k) for m, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def explode_text(df: DataFrame, columns: list, fields: list[tuple[str, T.DataType]], fn: Callable[[list[list]], list]) -> DataFrame:
    """Any number of rows for a batch: `fn` gets the batch's columns as lists and returns one list or array per field."""
    source = df.select(*columns)
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn([c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array(m, type=k) for m, k in zip(made, kinds, strict=True)], names=[n for n, _ in fields])

    return source.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long) as (node, root), root the smallest node of the component.

    Alternates large-star and small-star contraction (Kiveris et al., 2014), each round a few shuffles on
    edges only; every round is written to the shared folder and the round before deleted. A hub's edges meet only its single minimum, so
    the joins on a hub can be split by adaptive skew handling. Nodes without an edge are not returned.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "components")
    before = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        old, e = e, materialize(small, "components")
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def long_bits(value: int) -> int:
    """The signed 64-bit integer with the bits of an unsigned one."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value
