"""What the corpus operators share: input normalisation, checkpoints, grouping of whole partitions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def session(df: DataFrame) -> SparkSession:
    """The session of a frame, whose Python workers can import this package."""
    spark = df.sparkSession
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share, else the one that the context has been given.

    Where both are unset, a local master gets a temporary folder; a cluster is refused one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexsieve-checkpoint-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


_own: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialise in checkpoint_folder()."""
    spark = session(df)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string), one row per id.

    Rows whose id is null or no integer are left out and a null text counts as empty. Of rows that share an id, the one
    whose text hashes lowest stands for all. Other columns are not looked at, whatever their names.
    """
    session(docs)
    rows = docs.select(
        docs[id_col].try_cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    ).filter("doc_id is not null")
    twice = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return rows
    repeated = rows.join(twice.hint("shuffle_hash"), "doc_id", "left_semi")
    best = repeated.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return rows.join(twice.hint("shuffle_hash"), "doc_id", "left_anti").unionByName(best)


def whole_partitions(
    df: DataFrame, keys: list[str | Column], make: Callable[[pa.Table], Iterator[pa.RecordBatch] | pa.Table], schema: str, parts: int | None = None, numbered: bool = False
) -> DataFrame:
    """Bring rows of equal keys together and pass each partition, whole, to make(). numbered: the only key is the number of the partition."""
    session(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        out = make(pa.Table.from_batches(held))
        yield from out.to_batches(max_chunksize=20_000) if isinstance(out, pa.Table) else out

    if numbered:
        spread = df.repartitionById(parts, keys[0])
    else:
        spread = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return spread.mapInArrow(run, schema)


def keep_columns(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """docs restricted by ids(doc_id) with its own columns, names and order."""
    key = "__lexsieve_id"
    right = ids.select(F.col("doc_id").alias(key))
    return docs.join(right, docs[id_col].try_cast("bigint") == right[key], how)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of an undirected edge list (a, b), root being the least node of each component.

    Alternating large-star and small-star rounds over the edge table, each checkpointed, until the
    table stops changing; the number of rounds grows with the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        )
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def one_row_per_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each id, chosen as in texts(); rows with a null id all stay."""
    from pyspark.sql import Window

    twice = docs.filter(docs[id_col].isNotNull()).groupBy(docs[id_col].alias("__lexsieve_twice")).count().filter("count > 1").select("__lexsieve_twice")
    if twice.isEmpty():
        return docs
    cond = docs[id_col] == twice["__lexsieve_twice"]
    once = docs.join(twice.hint("shuffle_hash"), cond, "left_anti")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text), text, F.xxhash64(*[c for c in docs.columns]))
    best = docs.join(twice.hint("shuffle_hash"), cond, "left_semi").withColumn("__lexsieve_nth", F.row_number().over(order)).filter("__lexsieve_nth = 1").drop("__lexsieve_nth")
    return once.unionByName(best)
