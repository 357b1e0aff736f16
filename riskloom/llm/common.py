"""Pieces that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """16 bytes that name a row by id and text; never NULL, equal only for repeated rows."""
    ident = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(ident, F.lit(":"), text_or_empty(text_column))))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and gives the
    planner a true size, so that it broadcasts only what is below its threshold.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def keep_rows(docs: DataFrame, kept_keys: DataFrame, key: Column, key_name: str) -> DataFrame:
    """Rows of ``docs`` whose key is among ``kept_keys``; columns and repeats unchanged."""
    (name,) = fresh(docs, "_row_key")
    wanted = kept_keys.select(F.col(key_name).alias(name)).distinct()
    return docs.withColumn(name, key).join(wanted, name, "left_semi").drop(name)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`saved` table; for tables whose readers have all been written themselves."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


HOT_SHARE = 1000  # a key is hot if it has more than a thousandth of the rows: there are fewer than so many
SALTS = 64


def attach(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``per_key`` (one row per value of ``key``, ``count`` rows of ``rows`` each).

    NULL keys meet. Hot keys (fewer than HOT_SHARE of them) are broadcast, so that no
    task receives more than a thousandth of the rows for one key.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    (other,) = fresh(rows, f"_{key}")
    hot = per_key.filter(F.col(count) * HOT_SHARE > total).withColumnRenamed(key, other).drop(count)
    cold = per_key.filter(F.col(count) * HOT_SHARE <= total).withColumnRenamed(key, other).drop(count)
    same = F.col(key).eqNullSafe(F.col(other))
    near = rows.join(F.broadcast(hot), same)
    rest = rows.join(F.broadcast(hot.select(other)), same, "left_anti").join(cold, same)
    return near.unionByName(rest).drop(other)


def spread_join(many: DataFrame, few: DataFrame, key: str, salt_by: str, counts: DataFrame) -> DataFrame:
    """Inner join on ``key``; rows of ``many`` with a hot key are dealt over SALTS tasks by ``salt_by``.

    ``counts``: key, n (rows of ``many``). The rows of ``few`` of a hot key are copied to
    all of its tasks.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    salt, hot_key = fresh(many.select(*many.columns, *[F.lit(0).alias(c) for c in few.columns if c not in many.columns]), "_salt", "_hot")
    hot = F.broadcast(counts.filter(F.col("n") * HOT_SHARE > total).select(F.col(key).alias(hot_key)))
    here = F.when(F.col(hot_key).isNotNull(), F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).otherwise(0)
    there = F.when(F.col(hot_key).isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(salt, here).drop(hot_key)
    right = few.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(salt, F.explode(there)).drop(hot_key)
    return left.join(right, [key, salt]).drop(salt)


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: fewer rows than Spark's default (a setting of one's own stays)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)
