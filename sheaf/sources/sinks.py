"""Rows as documents: relationship parts, report JSON and text, QA tables, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import xml_escaped

#: Fixed value: the namespace of relationship parts.
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"


def _attribute(value: Column) -> Column:
    return F.replace(xml_escaped(value), F.lit('"'), F.lit("&quot;"))


def relationship_parts(rels: DataFrame, key: str) -> DataFrame:
    """key, xml: one part from its rows (rel_id, type, target, external), by id."""
    mode = F.when(F.col("external"), ' TargetMode="External"').otherwise("")
    line = F.concat(F.lit('<Relationship Id="'), _attribute(F.col("rel_id")), F.lit('" Type="'), _attribute(F.col("type")), F.lit('" Target="'), _attribute(F.col("target")), F.lit('"'), mode, F.lit("/>"))
    lines = F.array_sort(F.collect_list(F.struct("rel_id", line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    return rels.groupBy(key).agg(F.concat(F.lit(f'<Relationships xmlns="{RELATIONSHIPS}">'), body, F.lit("</Relationships>")).alias("xml"))


def report_json(report: DataFrame, order: str) -> DataFrame:
    """One JSON line per row, keys in the order of the columns, rows in the order given."""
    return report.orderBy(order).select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value"))


def report_text(report: DataFrame, feature: str, status: str, count: str, message: str) -> DataFrame:
    said = F.format_string("%-24s %-12s %6d  %s", F.col(feature), F.col(status).cast("string"), F.col(count), F.coalesce(F.col(message), F.lit("")))
    return report.orderBy(feature).select(F.rtrim(said).alias("value"))


def sidecars(files: DataFrame, source: str, result: str) -> DataFrame:
    """path and a JSON object with the hashes of what went in and came out."""
    hashes = F.struct(F.sha2(F.col(source), 256).alias("input_sha256"), F.sha2(F.col(result), 256).alias("output_sha256"), F.length(result).alias("output_bytes"))
    return files.select("path", F.to_json(hashes).alias("sidecar"))


def qa_tables(results: DataFrame, folder: str, order: str) -> None:
    """results as CSV and JSON under ``folder``, each committed as a whole by Spark."""
    results.orderBy(order).write.mode("overwrite").option("header", True).csv(f"{folder}/results.csv")
    results.orderBy(order).write.mode("overwrite").json(f"{folder}/results.json")
