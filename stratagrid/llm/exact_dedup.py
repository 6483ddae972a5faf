"""Exact deduplication that stands skew: combine locally, merge salted digest groups, combine the salts' winners.

Texts are equal when they are identical after lower-casing A-Z only; a null text counts as empty. Of equal
texts the row with the largest doc_id stays; a null doc_id is below all others. Rows that agree in doc_id and
text are told apart by their place in one reading of the input, and the last stays: exactly one, even where another
reading brings the rows in another order. An empty input gives an empty result, texts
of any length are compared whole. Columns may have any names; only doc_id and text are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialise, spread_join, text_or_empty

SALTS = 16


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(text_or_empty(text)).alias("content"))
    return rows.withColumn("row_no", F.monotonically_increasing_id()).withColumn("digest", F.sha2("content", 256))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """For each row of docs: doc_id, row_no, digest, keep_id, group_size, tied (rows of its group share a
    doc_id, so row_no decides) and kept.

    Only texts whose digest occurs twice travel with their content. They are grouped by digest and content:
    in each task, then over (digest, salt), then over the salts' winners, so that a group that holds a third
    of all rows reaches any one task as no more rows than there are salts and tasks."""
    rows = _rows(docs, doc_id, text)
    seen = materialise(rows.select("doc_id", "row_no", "digest"), "digests")
    by_id = seen.groupBy("digest", "doc_id").agg(F.count("*").alias("n"), F.max("row_no").alias("row_no"))
    repeated = by_id.groupBy("digest").agg(F.sum("n").alias("n"), (F.max("n") > 1).alias("tied"), F.max(F.struct("doc_id", "row_no")).alias("best"))
    repeated = repeated.filter("n > 1").drop("n")
    # The few digests travel once per salt, so that the many rows of one are dealt out over all salts.
    salted = repeated.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    local = (
        rows.withColumn("salt", F.pmod("row_no", F.lit(salts)).cast("int"))
        .join(salted, ["digest", "salt"])
        .groupBy("digest", "salt", "content")
        .agg(F.max("best").alias("best"), F.max(F.struct("doc_id", "row_no")).alias("own"), F.count("*").alias("n"), F.max("tied").alias("tied"))
    )
    groups = local.groupBy("digest", "content").agg(F.max("best").alias("best"), F.max("own").alias("own"), F.sum("n").alias("group_size"), F.max("tied").alias("tied"))
    groups = materialise(groups, "groups")
    found = ["digest", "doc_id", "row_no", "best", "group_size", "tied"]
    # Where a digest stands for several contents, each row's content is compared once more.
    several = groups.groupBy("digest").count().filter("count > 1").select("digest")
    if several.isEmpty():
        out = spread_join(seen, groups.drop("content", "own"), ["digest"], groups.select("digest", F.col("group_size").alias("n")), "left").select(*found)
    else:
        single = groups.join(several, "digest", "left_anti").drop("content", "own")
        out = seen.join(several, "digest", "left_anti").join(single, "digest", "left").select(*found)
        apart = groups.join(several, "digest", "left_semi").withColumn("best", F.col("own"))
        out = out.unionByName(rows.join(apart, ["digest", "content"]).select(*found))
    alone = F.col("best").isNull()
    out = out.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")))
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (~F.col("tied") | (F.col("row_no") == F.col("best.row_no"))))
    return out.select("doc_id", "row_no", "digest", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce("tied", F.lit(False)).alias("tied"), stays.alias("kept"))


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, dropped ones too."""
    return classes(docs, doc_id, text).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.sha2(ascii_lower(text_or_empty(text)), 256).alias("sha")).withColumn("no", F.monotonically_increasing_id())
    stays = classes(docs, doc_id, text).filter("kept")
    stays = materialise(stays.select("digest", "doc_id", "tied"), "stays")
    same = (whole["sha"] == stays["digest"]) & whole["id"].eqNullSafe(stays["doc_id"])
    if stays.filter("tied").isEmpty():
        return whole.join(stays, same, "left_semi").select("row.*")
    # Where ids repeat within a group, one of its rows as this reading has them.
    found = whole.join(stays, same)
    last = found.filter("tied").groupBy("sha", "id").agg(F.max_by("row", "no").alias("row"))
    return found.filter(~F.col("tied")).select("row.*").unionByName(last.select("row.*"))
