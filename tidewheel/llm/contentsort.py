"""Exact duplicates by sorting content.

Sampled splitters range-partition the normalised text, an external sort inside each partition places equal
texts side by side, and neighbours are compared in full. The splitters are cut from the first SPLIT_CHARS
code points, so what the driver samples is short however long texts are; a hash of the whole text parts texts that
begin alike. A range cannot split one key, so the key ends in a salt of the id: a text that a third of the rows share
is spread over as many sorted groups as the session has shuffle partitions (SALTS at least), each of which is reduced
to one head; heads of the same text, told by SHA-256, then settle the survivor together.

Cases: a null text counts as empty and empty texts are copies of each other; rows that repeat an id and its
text all carry that id as keep_id and are all marked kept; a null id survives only where its text has no
other id; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import ascii_lower, body, partitions, saved

#: Sorted groups that copies of one text are spread over, at least.
SALTS = 32
#: Code points of a text that range splitters are cut from.
SPLIT_CHARS = 32


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", salts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; keep: which id of equal texts stays (max or min)."""
    best, order = (F.max, F.col("doc_id").desc_nulls_last()) if keep == "max" else (F.min, F.col("doc_id").asc_nulls_last())
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(body(text_col)).alias("_text"))
    salts = salts or max(SALTS, partitions(docs.sparkSession))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    rows = rows.withColumns({"_lead": F.substring("_text", 1, SPLIT_CHARS), "_tie": F.xxhash64("_text")})
    by_content = rows.repartitionByRange("_lead", "_tie", "_salt").sortWithinPartitions("_lead", "_tie", "_salt", "_text", order)
    place = Window.partitionBy("_lead", "_tie", "_salt", "_text").orderBy(order)
    near = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = by_content.select(
        "doc_id", "_salt", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
        F.first("doc_id").over(near).alias("_keep"), F.count(F.lit(1)).over(near).alias("_n"), (F.row_number().over(place) == 1).alias("_head"),
    )
    local = saved(local, "content-sort")
    same = Window.partitionBy("text_sha256")
    heads = local.where("_head").select("text_sha256", "_salt", best("_keep").over(same).alias("keep_id"), F.sum("_n").over(same).alias("group_size"))
    return local.join(heads, ["text_sha256", "_salt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that content_sort keeps, with all their columns."""
    ids = content_sort(docs, id_col, text_col, **how).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).distinct()
    digest = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256)
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_kept_id"]) & (digest == ids["_kept_text"]), "left_semi")
