"""Markdown: sections of documents and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sections(docs: DataFrame, min_level: int = 1) -> DataFrame:
    """id, first_line, heading, level, body of each section; a heading is 1 to 6 signs and a blank. Text before the first heading counts if it isn't blank.

    Lines of one document are handled in its own row, so no shuffle is needed.
    """
    lines = F.split("text", "\n")
    is_head = lambda x: x.rlike(r"^#{%d,6}\s" % min_level)
    rows = docs.select("id", lines.alias("lines"))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | is_head(F.col("lines")[i.cast("int")]))
    rows = rows.withColumn("starts", starts).select("id", "lines", "starts", F.posexplode("starts").alias("k", "first_line"))
    stop = F.coalesce(F.try_element_at("starts", F.col("k") + 2), F.size("lines"))
    head = F.col("lines")[F.col("first_line")]
    headed = is_head(head)
    body_from = F.when(headed, F.col("first_line") + 1).otherwise(F.col("first_line"))
    body = F.trim(F.array_join(F.slice("lines", body_from + 1, stop - body_from), "\n"))
    out = rows.select("id", "first_line", F.when(headed, F.trim(F.regexp_replace(head, r"^#+\s+", ""))).alias("heading"), F.when(headed, F.length(F.regexp_extract(head, r"^(#+)", 1))).otherwise(0).alias("level"), body.alias("body"))
    return out.where((F.col("level") > 0) | (F.col("body") != ""))


def exported(rows: DataFrame) -> DataFrame:
    """id, text: sections (id, first_line, heading, level, body) as one Markdown text each."""
    part = F.concat_ws("\n", F.when(F.col("level") > 0, F.concat(F.expr("repeat('#', level)"), F.lit(" "), "heading")), "body")
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first_line", part.alias("part")))).alias("parts")).select("id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n").alias("text"))
