"""Clause trees, order within documents, line statistics and boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx


def distinct_clauses(clauses: DataFrame) -> DataFrame:
    """Each clause once; repeated rows are equal in every column, so any may stay."""
    return clauses.dropDuplicates(["clause_id"])


def lines(clauses: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, line_no, line): the lines of each text, numbered from 0."""
    return clauses.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def ancestors(clauses: DataFrame) -> DataFrame:
    """(clause_id, ancestor_id, distance): a path names its ancestors, so no recursion is needed.

    Ancestors that are no clause of the table are left out.
    """
    own = clauses.select("clause_id", "document_id", "path")
    parts = own.withColumn("steps", F.size(F.split("path", "/")))
    up = parts.where("steps > 1").select("clause_id", "document_id", "path", "steps", F.explode(F.sequence(F.lit(1), F.col("steps") - 1)).alias("depth"))
    named = up.select("clause_id", F.concat("document_id", F.lit(":"), F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/")).alias("ancestor_id"), (F.col("steps") - F.col("depth")).alias("distance"))
    return named.join(own.select(F.col("clause_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("clause_id", "ancestor_id", "distance")


def document_order() -> Window:
    return Window.partitionBy("document_id").orderBy("page_start", "clause_id")


def page_gap(a_start: str, a_end: str, b_start: str, b_end: str):
    """Pages between two ranges, 0 if they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(a_start, b_start) - F.least(a_end, b_end))


def linked(clauses: DataFrame, source_type: str, target_type: str, most_pages: int = 3) -> DataFrame:
    """(source_id, target_id, edge, gap): targets of one document near a source, each by its strongest edge.

    Edge 1: the same parent; edge 2: the source's text names the target's number; edge 3: pages close by. Clauses
    of two different bundle sections are never linked; an unknown section fits any.
    """
    a = clauses.where(F.col("clause_type") == source_type).select(F.col("clause_id").alias("source_id"), "document_id", F.col("parent_id").alias("a_parent"), F.col("bundle_section").alias("a_bundle"), F.col("page_start").alias("a_start"), F.col("page_end").alias("a_end"), tx.cross_references("text").alias("a_refs"))
    b = clauses.where(F.col("clause_type") == target_type).select(F.col("clause_id").alias("target_id"), "document_id", F.col("parent_id").alias("b_parent"), F.col("bundle_section").alias("b_bundle"), F.col("page_start").alias("b_start"), F.col("page_end").alias("b_end"), F.regexp_extract("title", r"^([0-9]+(?:\.[0-9]+)*)", 1).alias("b_number"))
    both = a.join(b, "document_id").where("a_bundle is null or b_bundle is null or a_bundle = b_bundle")
    gap = page_gap("a_start", "a_end", "b_start", "b_end")
    edge = F.when(F.col("a_parent") == F.col("b_parent"), 1).when(F.array_contains("a_refs", F.col("b_number")), 2).when(gap <= most_pages, 3)
    return both.select("source_id", "target_id", edge.alias("edge"), gap.alias("gap")).where("edge is not null")


def running_line_keys(clauses: DataFrame, share: float, least: int = 2) -> DataFrame:
    """(document_id, line_key, clauses): digit-masked lines found in at least this share of a document's clauses."""
    key = tx.mask_digits(tx.squeeze(tx.fold("line")))
    seen = lines(clauses, ["document_id", "clause_id"]).select("document_id", "clause_id", key.alias("line_key")).where("line_key <> ''").distinct()
    total = clauses.groupBy("document_id").agg(F.count("*").alias("n"))
    return seen.groupBy("document_id", "line_key").agg(F.count("*").alias("clauses")).join(total, "document_id").where((F.col("clauses") >= F.col("n") * share) & (F.col("clauses") >= least)).select("document_id", "line_key", "clauses")


def segment(lines_in_order: DataFrame, document: str, position: str, line: str) -> DataFrame:
    """(document, heading_no, label, title, parent_label, depth, first, body_lines): headings found in a document's lines.

    A heading is a dotted number closed by a full stop and a capitalised title; the lines up to the next heading are
    its body. Lines before the first heading belong to heading 0 without a label. Documents are segmented side by
    side; a document's lines are one window.
    """
    heading = F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+)*)\.\s+\p{Lu}", 1)
    w = Window.partitionBy(document).orderBy(position)
    marked = lines_in_order.withColumn("_label", F.nullif(heading, F.lit(""))).withColumn("heading_no", F.sum(F.when(F.col("_label").isNotNull(), 1).otherwise(0)).over(w))
    each = marked.groupBy(document, "heading_no").agg(F.max("_label").alias("label"), F.min_by(line, F.struct(F.col("_label").isNull(), F.col(position))).alias("_line"), F.min(position).alias("first"), F.count_if(F.col("_label").isNull()).alias("body_lines"))
    parent = F.when(F.instr("label", ".") > 0, F.regexp_replace("label", r"\.[0-9]+$", ""))
    return each.select(document, "heading_no", "label", F.when(F.col("label").isNotNull(), F.col("_line")).alias("title"), parent.alias("parent_label"), F.size(F.split("label", r"\.")).alias("depth"), "first", "body_lines")


def folded_units(clauses: DataFrame, least: int) -> DataFrame:
    """(document_id, unit_id, parts, chars): clauses shorter than ``least`` folded into the parent they have here.

    A short clause without a parent in the table stands alone.
    """
    own = clauses.select("clause_id", "document_id", "parent_id", F.char_length("text").alias("chars"))
    known = own.select(F.col("clause_id").alias("parent_id"), F.lit(True).alias("has_parent"))
    placed = own.join(known, "parent_id", "left")
    unit = F.when((F.col("chars") < least) & F.col("has_parent"), F.col("parent_id")).otherwise(F.col("clause_id"))
    return placed.groupBy("document_id", unit.alias("unit_id")).agg(F.count("*").alias("parts"), F.sum("chars").alias("chars"))
