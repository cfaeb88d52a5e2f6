"""Chunks of clauses: short clauses folded into their parent, breadcrumbs, and clauses put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.operators.structure import ancestors


def breadcrumbs(clauses: DataFrame) -> DataFrame:
    """(clause_id, parent_path): the titles of a clause's ancestors from the root on, joined by `` > ``."""
    named = ancestors(clauses).join(clauses.select(F.col("clause_id").alias("ancestor_id"), "title"), "ancestor_id")
    got = named.groupBy("clause_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("n"), "title"))).alias("up"))
    return got.select("clause_id", F.array_join("up.title", " > ").alias("parent_path"))


def chunks(clauses: DataFrame, least: int, most: int) -> DataFrame:
    """(chunk_id, document_id, clause_id, source_clause_ids, parent_path, text, char_count, rule).

    A clause of fewer than ``least`` characters goes into the parent it has here, in the order of the document and
    under its own title; a chunk's text is its breadcrumb, its anchor's title, a blank line and the bodies. The rule
    is ``single`` or ``merged``, or ``oversized`` for a chunk of more than ``most`` characters, which a splitter has
    to cut. A short clause whose parent is short too goes to that parent's chunk only if the parent stays.
    """
    own = clauses.select("clause_id", "document_id", "parent_id", "title", "text", "page_start")
    sized = own.withColumn("short", F.char_length(F.coalesce("text", F.lit(""))) < least)
    parents = sized.select(F.col("clause_id").alias("parent_id"), F.col("short").alias("parent_short"))
    placed = sized.join(parents, "parent_id", "left")
    folded = F.col("short") & (F.col("parent_short") == F.lit(False))
    placed = placed.withColumn("anchor", F.when(folded, F.col("parent_id")).otherwise(F.col("clause_id")))
    body = F.when(F.col("clause_id") == F.col("anchor"), F.coalesce("text", F.lit(""))).otherwise(F.concat_ws("\n", "title", F.nullif("text", F.lit(""))))
    part = F.struct((F.col("clause_id") != F.col("anchor")).alias("after"), "page_start", "clause_id", body.alias("body"))
    units = placed.groupBy("document_id", "anchor").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max(F.when(F.col("clause_id") == F.col("anchor"), F.col("title"))).alias("title"))
    units = units.join(breadcrumbs(clauses).withColumnRenamed("clause_id", "anchor"), "anchor", "left")
    header = F.concat_ws("\n", "parent_path", "title")
    bodies = F.array_join(F.filter("parts.body", lambda x: x != ""), "\n")
    text = F.when(bodies == "", header).otherwise(F.concat(header, F.lit("\n\n"), bodies))
    size = F.char_length(text)
    rule = F.when(size > most, "oversized").when(F.size("parts") > 1, "merged").otherwise("single")
    return units.select(F.col("anchor").alias("chunk_id"), "document_id", F.col("anchor").alias("clause_id"), F.col("parts.clause_id").alias("source_clause_ids"), F.coalesce("parent_path", F.lit("")).alias("parent_path"), text.alias("text"), size.alias("char_count"), rule.alias("rule"))


def without_breadcrumb(parent_path: str, text: str):
    """A chunk's text for display: its first line is dropped if it is the breadcrumb."""
    return F.when((F.col(parent_path) != "") & F.startswith(text, F.concat(parent_path, F.lit("\n"))), F.expr(f"substring({text}, char_length({parent_path}) + 2)")).otherwise(F.col(text))


def hydrated(wanted: DataFrame, chunked: DataFrame, group: str, order: str) -> DataFrame:
    """(group, clause_id, place, text): the clauses asked for that exist, in the order asked, with their chunks'
    display texts in chunk order."""
    sources = chunked.select(F.explode("source_clause_ids").alias("clause_id"), "chunk_id", without_breadcrumb("parent_path", "text").alias("shown"))
    got = sources.join(wanted.select("clause_id").distinct(), "clause_id", "left_semi").groupBy("clause_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "shown"))).alias("c"))
    there = wanted.join(got, "clause_id")
    return there.select(group, "clause_id", F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("place"), F.array_join("c.shown", "\n").alias("text"))
