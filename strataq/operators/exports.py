"""Reports and sidecars as text: rows of lines, or a document per asset, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import xml_escape


def chat_lines(messages: DataFrame, session: str, order: str, role: str, text: str, at: str | None = None) -> DataFrame:
    """(session, order, line): a Markdown heading per message, with its time, and its text below."""
    head = F.concat(F.lit("### "), F.initcap(role)) if at is None else F.concat(F.lit("### "), F.initcap(role), F.lit(" — "), F.date_format(at, "yyyy-MM-dd HH:mm"))
    return messages.select(session, order, F.concat(head, F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit("\n")).alias("line"))


def write_lines(lines: DataFrame, group: str, order: str, folder: str) -> None:
    """A text folder per group, its lines in order; a group's rows are sorted within tasks, not gathered."""
    lines.repartitionByRange(group, order).sortWithinPartitions(group, order).select(group, "line").write.partitionBy(group).text(folder)


def report_lines(entries: DataFrame, kind: str, name: str, reason: str) -> DataFrame:
    """(line) of a scan report: entries by kind, name and reason."""
    return entries.select(F.concat_ws("\t", kind, name, F.coalesce(reason, F.lit(""))).alias("line")).orderBy("line")


def _element(name: str, c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  <{name}>"), xml_escape(c), F.lit(f"</{name}>\n"))).otherwise("")


def sidecars(assets: DataFrame, key: str, fields: dict[str, str], tags: DataFrame | None = None) -> DataFrame:
    """(key, xml): a description of each asset with some of its columns as elements, and its tags in order."""
    body = F.concat(*(_element(f"dc:{n}", F.col(c).cast("string")) for n, c in fields.items()))
    rows = assets
    if tags is not None:
        named = tags.groupBy(F.col("asset_id").alias("__t")).agg(F.array_sort(F.collect_set("name")).alias("__names"))
        rows = rows.join(named, F.col(key) == F.col("__t"), "left")
        body = F.concat(body, F.concat_ws("", F.transform(F.coalesce("__names", F.array().cast("array<string>")), lambda n: F.concat(F.lit("  <dc:subject>"), xml_escape(n), F.lit("</dc:subject>\n")))))
    return rows.select(key, F.concat(F.lit('<rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/">\n'), body, F.lit("</rdf:Description>\n")).alias("xml"))
