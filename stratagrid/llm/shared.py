"""Helpers that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD_BREAK = "[ \\t-\\r]+"
#: Of a join: the share of rows that makes a key hot, as a divisor, and the rows that never do.
PARTS, LEAST = 1000, 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share. Where the session names none, a
    folder of this machine is taken if all tasks run on it too, and else an error raised."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(spark, "_llm_shared_dir", None)
        if not found:
            found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
            spark._llm_shared_dir = found
    return f"{found.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables and archives that this application has put into the shared folder. Results that still
    read them can't be used any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return the reader of it: lineage is cut there,
    so a lost executor costs no more than the stages since, and columns can be pruned on each reading."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def n_words_of(text: Column) -> Column:
    """How many such runs there are, without building them: a word starts where a blank is followed by none."""
    return F.regexp_count(text, F.lit("[^ \\t-\\r]++")).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash_unit(column: Column, salt: int) -> Column:
    """A repeatable number in [0, 1) for each value."""
    return (F.xxhash64(column, F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right by keys, without one task for all rows of a frequent key. counts has the keys (no
    row twice) and n, how many rows of left have them; keys that no row of right has may be left out.

    A key with more than a share of 1 / PARTS of all n, and more than LEAST rows, is hot: its rows are dealt out
    over salts, each of about that share, and right's rows of it go to every salt. There are less than PARTS such
    keys and 2 * PARTS salts, whatever the input, so the hot keys are broadcast."""
    salt, salts = unused([*left.columns, *right.columns], "salt", "salts")
    part = max((counts.agg(F.sum("n")).first()[0] or 0) / PARTS, float(LEAST))
    hot = counts.filter(F.col("n") > part).select(*keys, F.ceil(F.col("n") / part).cast("int").alias(salts))
    hot = materialise(hot, "hot")
    if hot.isEmpty():
        return left.join(right, list(keys), how)
    hot = F.broadcast(hot)
    dealt = left.join(hot, list(keys), "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(salts)), F.lit(0)).cast("int"))
    copied = right.join(hot, list(keys), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))
    return dealt.drop(salts).join(copied.drop(salts), [*keys, salt], how).drop(salt)


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that are none of names, ignoring case."""
    taken = {c.lower() for c in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of df has, ignoring case."""
    return unused(df.columns, *wanted)
