"""Helpers that the text operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character list and as a Java character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the group tables that `attach` broadcasts; the bound does not depend on the data.
HOT_GROUPS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, there is a local one on a local master only, where there are no other machines."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or f"file://{tempfile.gettempdir()}/skein-{os.getpid()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    A lost executor then costs the running tasks only, and a plan that uses the
    table twice does not compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete a table made by `written` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores put before it until no column of df has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], payload: list[str], weight: str, row_id: Column) -> DataFrame:
    """Left-join what was aggregated for each group back to its rows, whatever the largest group holds.

    The HOT_GROUPS groups with most rows (a bound that the data don't move) meet
    their rows by broadcast, so no key of the shuffle join behind that holds
    over one in HOT_GROUPS of the rows. Rows already served pass it spread by a
    salt of `row_id`; the salt of all others is nought, worked out from the keys
    because the optimizer would drop a constant from the shuffle's keys. Keys
    are not null.
    """
    hot = groups.orderBy(F.col(weight).desc(), *keys).limit(HOT_GROUPS).select(*keys, F.struct(*payload).alias("_hot"))
    nought = F.pmod(F.xxhash64(*keys), F.lit(1))
    salt = F.when(F.col("_hot").isNull(), nought).otherwise(1 + F.pmod(F.xxhash64(row_id), F.lit(4096)))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt)
    cold = groups.select(*keys, nought.alias("_salt"), F.struct(*payload).alias("_cold")).hint("merge")
    joined = salted.join(cold, [*keys, "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    return joined.select(*rows.columns, *(F.col(f"_got.{p}").alias(p) for p in payload))
