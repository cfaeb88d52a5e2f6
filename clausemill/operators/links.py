"""Filters on metadata, links between clauses of one document, and places reserved in a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators.structure import ancestors, page_gap

FIELDS = ("susep_process", "cnpj", "product_line", "clause_type")


def admits(wanted: str = "f", row: str = "c", strict_bundle: bool = False) -> Column:
    """Whether a row passes every constraint of a filter; a null constraint asks nothing.

    A row of unknown bundle section passes a filter on the section unless ``strict_bundle``.
    """
    ok = F.lit(True)
    for name in FIELDS:
        ok = ok & (F.col(f"{wanted}.{name}").isNull() | F.col(f"{wanted}.{name}").eqNullSafe(F.col(f"{row}.{name}")))
    bundle = F.col(f"{wanted}.bundle_section")
    same = bundle.eqNullSafe(F.col(f"{row}.bundle_section"))
    return ok & (bundle.isNull() | (same if strict_bundle else same | F.col(f"{row}.bundle_section").isNull()))


def admitted(filters: DataFrame, clauses: DataFrame, key: str, strict_bundle: bool = False) -> DataFrame:
    """(key, clause_id): the clauses each filter admits.

    Filters with a process, or else a firm, meet only clauses of that process or firm; a filter with neither asks
    for whole kinds of clauses, and such filters are joined by what they ask for.
    """
    f, c = filters.alias("f"), clauses.alias("c")
    rest = admits(strict_bundle=strict_bundle)
    cases = (("f.susep_process is not null", "susep_process"), ("f.susep_process is null and f.cnpj is not null", "cnpj"), ("f.susep_process is null and f.cnpj is null and f.product_line is not null", "product_line"), ("f.susep_process is null and f.cnpj is null and f.product_line is null and f.clause_type is not null", "clause_type"))
    out = None
    for case, on in cases:
        one = f.where(case).join(c, (F.col(f"f.{on}") == F.col(f"c.{on}")) & rest).select(f"f.{key}", "c.clause_id")
        out = one if out is None else out.unionByName(one)
    return out


def sections(clauses: DataFrame) -> DataFrame:
    """(clause_id, section_id, chain): the topmost ancestor, and the clause with its ancestors, nearest first."""
    up = ancestors(clauses).groupBy("clause_id").agg(F.sort_array(F.collect_list(F.struct("distance", "ancestor_id"))).alias("up"))
    own = clauses.select("clause_id").join(up, "clause_id", "left")
    chain = F.concat(F.array("clause_id"), F.coalesce(F.col("up.ancestor_id"), F.array().cast("array<string>")))
    return own.select("clause_id", F.element_at(chain, -1).alias("section_id"), chain.alias("chain"))


def tree_distance(a: str, b: str) -> Column:
    """Edges between two clauses over their nearest common ancestor, 0 if they have none; from their chains."""
    shared = F.array_intersect(a, b)
    first = F.element_at(shared, 1)
    return F.when(F.size(shared) > 0, F.array_position(a, first) + F.array_position(b, first) - 2).otherwise(F.lit(0)).cast("int")


def section_links(clauses: DataFrame, source_type: str, target_type: str, most_pages: int = 1) -> DataFrame:
    """(source_id, target_id, edge, tree_distance, gap): targets linked to a source, each by its best edge.

    Edge 0: the source's text names the target's number; 1: both lie under one topmost clause; 2: their pages are at
    most ``most_pages`` apart. A source of a known bundle section takes targets of that or of no section. Documents
    are joined by their id, so a document's sources meet its targets and no others.
    """
    tree = sections(clauses)
    own = clauses.join(tree, "clause_id")
    pick = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("section_id", "chain", "bundle_section", "page_start", "page_end")]
    a = own.where(F.col("clause_type") == source_type).select(F.col("clause_id").alias("source_id"), "document_id", tx.cross_references("text").alias("a_refs"), *pick("a"))
    b = own.where(F.col("clause_type") == target_type).select(F.col("clause_id").alias("target_id"), "document_id", F.regexp_extract("title", r"^([0-9]+(?:\.[0-9]+)*)", 1).alias("number"), *pick("b"))
    both = a.join(b, "document_id").where("source_id <> target_id and (a_bundle_section is null or b_bundle_section is null or a_bundle_section = b_bundle_section)")
    gap = page_gap("a_page_start", "a_page_end", "b_page_start", "b_page_end")
    same = F.col("a_section_id") == F.col("b_section_id")
    edge = F.when(F.array_contains("a_refs", F.col("number")), 0).when(same, 1).when(gap <= most_pages, 2)
    distance = F.when(edge == 1, tree_distance("a_chain", "b_chain")).otherwise(F.lit(0))
    return both.select("source_id", "target_id", edge.alias("edge"), distance.alias("tree_distance"), gap.alias("gap")).where("edge is not null")


def reserve(ranking: DataFrame, types: DataFrame, links: DataFrame, group: str, k: int, slots: int, source_type: str, target_type: str) -> DataFrame:
    """(group, clause_id, rank): rankings in which linked targets hold up to ``slots`` of the k places.

    For the sources of a ranking, the best linked targets outside it are appended; the last entries that are
    neither source nor target make room, and where none is left the ranking stays as it is.
    """
    ranked = ranking.select(group, "clause_id", "rank").join(types.select("clause_id", "clause_type"), "clause_id")
    kept = F.col("clause_type").isin(source_type, target_type)
    from_end = Window.partitionBy(group, kept).orderBy(F.desc("rank"))
    ranked = ranked.withColumn("last", F.when(~kept, F.row_number().over(from_end)))
    room = ranked.groupBy(group).agg((F.lit(k) - F.count("*")).alias("free"), F.count("last").alias("movable"))
    offered = ranked.where(F.col("clause_type") == source_type).join(links, F.col("clause_id") == F.col("source_id")).groupBy(group, "target_id").agg(F.min(F.struct("edge", "tree_distance", "gap")).alias("best"))
    fresh = offered.join(ranked.select(group, F.col("clause_id").alias("target_id")), [group, "target_id"], "left_anti")
    fresh = fresh.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("best", "target_id"))).where(F.col("place") <= min(slots, k))
    wanted = fresh.groupBy(group).agg(F.count("*").alias("wanted"))
    plan = room.join(wanted, group, "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    plan = plan.withColumn("gone", F.least(F.greatest(F.col("wanted") - F.col("free"), F.lit(0)), F.col("movable"))).select(group, "gone", F.least("wanted", F.col("free") + F.col("gone")).alias("added"))
    stay = ranked.join(plan, group).where("last is null or last > gone").select(group, "clause_id", F.lit(0).alias("part"), F.col("rank").alias("place"))
    put = fresh.join(plan, group).where("place <= added").select(group, F.col("target_id").alias("clause_id"), F.lit(1).alias("part"), "place")
    return stay.unionByName(put).select(group, "clause_id", F.row_number().over(Window.partitionBy(group).orderBy("part", "place")).alias("rank"))
