"""The queries of the text-preparation problems, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.sources.tables import table
from clausemill.storage import stash

CAPACITY = 2048
_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_clause")


def _filings(spark: SparkSession, sf_dir: str, *modes: str) -> DataFrame:
    """Ids of the filings read in one of these extraction modes, each once."""
    mode = F.lower(F.regexp_replace("extraction_mode", r"^\s+|\s+$", ""))
    return table(spark, sf_dir, "manifest").where(mode.isin(*modes)).select(F.col("id").alias("document_id")).distinct()


def _excess(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from clausemill.llm.repeated_lines import excess_lines

    own = _clauses(spark, sf_dir).join(_filings(spark, sf_dir, "text"), "document_id", "left_semi").select("clause_id", "cnpj", "text")
    return own, excess_lines(own, "clause_id", "cnpj", "text", min_docs=8, min_chars=15)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least eight clauses of an insurer, whether or not the ratio calls them excess."""
    return _excess(spark, sf_dir)[1].where("n_within >= 8").select("clause_id", "line_no").distinct()


def p1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the repeated lines of each insurer occur, by what the test says of them."""
    found = _excess(spark, sf_dir)[1]
    return found.groupBy("cnpj", "scope", "excess").agg(F.count("*").alias("occurrences"), F.countDistinct("clause_id").alias("clauses"), F.max("n_within").alias("most_within"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausemill.llm.repeated_lines import without_excess

    own, found = _excess(spark, sf_dir)
    return without_excess(own, "clause_id", "text", found.where("excess"))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from clausemill.llm.near_duplicates import near_pairs

    own = _clauses(spark, sf_dir).select("clause_id", F.regexp_replace("susep_process", "[^0-9]", "").alias("process"), "text")
    return near_pairs(own, "clause_id", "process", "text", threshold=0.6, width=3)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)[0].select(F.col("a").alias("clause_id_a"), F.col("b").alias("clause_id_b")).distinct()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each clause that has a reworded copy under another process."""
    from clausemill.llm.near_duplicates import near_groups

    _, members, links = _near(spark, sf_dir)
    return near_groups(members, links).withColumnRenamed("id", "clause_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausemill.llm.passages import shared_passages

    return shared_passages(_clauses(spark, sf_dir), "clause_id", "document_id", "text", span=300)


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each clause that has a shared passage stands in other documents too."""
    own = p3_found(spark, sf_dir).groupBy("clause_id").agg(F.count("*").alias("passages"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    sizes = _clauses(spark, sf_dir).groupBy("clause_id").agg(F.max(F.char_length("text")).alias("text_chars"))
    return own.join(sizes, "clause_id").withColumn("share", F.col("shared_chars") / F.col("text_chars"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausemill.llm.splitting import pieces

    return pieces(_clauses(spark, sf_dir), "clause_id", "text", ["document_id"], limit=3000, overlap=300)


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each cut clause its pieces hold without their overlaps, and how many break the limits."""
    solid = F.char_length(F.regexp_replace(F.expr("substring(piece, own_start - start_pos + 1)"), _BLANK, ""))
    broken = (F.char_length("piece") > 3000) | (F.col("own_start") - F.col("start_pos") > 300)
    return _pieces(spark, sf_dir).groupBy("clause_id").agg(F.sum(solid).alias("solid_chars"), F.count_if(broken).alias("broken"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.bool_and(F.col("rule") == "item"), "item").otherwise("window")
    return _pieces(spark, sf_dir).groupBy("clause_id").agg(rule.alias("cut_rule"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two split counts of each filing that has any clause."""
    own = _pieces(spark, sf_dir).groupBy("document_id").agg(F.count_if(F.col("rule") == "item").alias("item"), F.count_if(F.col("rule") == "window").alias("window"))
    every = _clauses(spark, sf_dir).select("document_id").distinct()
    return every.join(own, "document_id", "left").select("document_id", F.coalesce("item", F.lit(0)).alias("item_boundary_split_count"), F.coalesce("window", F.lit(0)).alias("sliding_window_split_count"))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausemill.llm.scan_repair import repair

    own = _clauses(spark, sf_dir).select("clause_id", "document_id", "insurer", "text")
    scanned = own.join(_filings(spark, sf_dir, "ocr_required", "partial"), "document_id", "left_semi")
    clean = own.join(_filings(spark, sf_dir, "text"), "document_id", "left_semi")
    return repair(scanned, clean, "clause_id", "document_id", "insurer", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _repaired(spark, sf_dir).select("clause_id", F.explode("kinds").alias("k"))
    return one.select("clause_id", F.col("k.line_no").alias("line_no"), F.col("k.kind").alias("kind")).distinct()


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scanned clause as continuous paragraphs."""
    return _repaired(spark, sf_dir).select("clause_id", F.col("repaired").alias("text"))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausemill.llm.personal import find_personal

    def texts(name: str, key: str, column: str, flag: bool = False) -> DataFrame:
        mark = F.col("pii_flag") if flag else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col(key).alias("record_id"), F.col(column).alias("text"), mark.alias("pii_flag"))

    every = texts("claim", "claim_id", "raw_text").unionByName(texts("product_claim_mismatch", "claim_id", "narrative")).unionByName(texts("product_claim_mismatch_draft", "row_id", "narrative", True))
    return find_personal(every, "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _personal(spark, sf_dir).select("source_table", "record_id", F.explode("details").alias("d"))
    return one.select("source_table", "record_id", F.col("d.pii_type").alias("pii_type"), F.col("d.start_pos").alias("start_pos")).distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with placeholders, next to the flag that came with it and the types found; repeated rows stay."""
    return _personal(spark, sf_dir).select("source_table", "record_id", "pii_flag", F.array_sort(F.array_distinct("details.pii_type")).alias("found"), "redacted")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausemill.llm.tokenize_corpus import token_ids

    return token_ids(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausemill.llm.packing import pack
    from clausemill.llm.tokenize_corpus import token_counts

    return pack(token_counts(table(spark, sf_dir, "documents")), "doc_id", "n_tokens", CAPACITY)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    per = p8_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("size").alias("used"), F.count("*").alias("pieces"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("used").alias("fullest"), (F.sum("used") / (F.count("*") * CAPACITY)).alias("share_used"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What containers of 2,048 characters hold: every character once, none over its capacity."""
    from clausemill.llm.packing import pack

    own = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("chars"))
    packed = stash(pack(own, "doc_id", "chars", 2048), "packed")
    over = packed.groupBy("container_id").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > 2048).alias("overfull"))
    return packed.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("doc_id", "piece_no").alias("pieces"), F.sum("size").cast("long").alias("chars")).crossJoin(over)  # one row each


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausemill.llm.subjects import subject_shares

    return subject_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), "doc_id", "text", "subject")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).where("sentences * 5 >= of_sentences").select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of each area, of areas without documents too."""
    found = _shares(spark, sf_dir).where("sentences * 5 >= of_sentences").groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.sum("sentences").alias("sentences"))
    return table(spark, sf_dir, "subject_area").select("subject").distinct().join(found, "subject", "left").fillna(0, ["documents", "sentences"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_lines, p1_clean, p2_found, p2_groups, p3_found, p3_shares, p4_found, p4_pieces, p4_cover, p4_counts, p5_found, p5_text, p6_found, p6_redacted, p7_ids, p8_containers, p8_fill, p8_totals, p9_found, p9_composition)}


_SPACE = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"
_NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(line)), '\d+', '#', 'g'), '{_SPACE}+', ' ', 'g'), '^[^a-z0-9#]+|[^a-z0-9#]+$', '', 'g')"
_P1 = f"""WITH t AS (SELECT DISTINCT clause_id, cnpj, text FROM parsed_clause WHERE document_id IN (SELECT id FROM manifest WHERE lower(trim(extraction_mode)) = 'text')),
l AS (SELECT clause_id, cnpj, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM t),
n AS (SELECT clause_id, cnpj, line_no, {_NORMAL} AS said FROM l),
r AS (SELECT cnpj, said FROM n WHERE length(said) >= 15 GROUP BY 1, 2 HAVING count(DISTINCT clause_id) >= 8)
SELECT DISTINCT clause_id, line_no FROM n JOIN r USING (cnpj, said)"""
_P4 = rf"""WITH t AS (SELECT DISTINCT clause_id, text FROM parsed_clause WHERE length(text) > 3000),
l AS (SELECT clause_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM t),
m AS (SELECT clause_id, line, line_no, regexp_matches(line, '^(?:[A-Za-z]{{1,2}}\)|[•–-]){_SPACE}+[^\s\x{{a0}}]') AS item FROM l),
p AS (SELECT clause_id, line, item, sum(item::INT) OVER (PARTITION BY clause_id ORDER BY line_no) AS piece FROM m),
s AS (SELECT clause_id, piece, bool_or(item) AS item, sum(length(line) + 1) - 1 AS size FROM p GROUP BY 1, 2)
SELECT clause_id, CASE WHEN bool_or(item) AND max(size) <= 3000 THEN 'item' ELSE 'window' END AS cut_rule FROM s GROUP BY 1"""


_P4_COVER = r"SELECT DISTINCT clause_id, length(regexp_replace(text, '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')) AS solid_chars, 0::BIGINT AS broken FROM parsed_clause WHERE length(text) > 3000"
_P8 = "SELECT count(*) AS documents, sum(greatest(1, (coalesce(length(text), 0) + 2047) // 2048))::BIGINT AS pieces, sum(length(text))::BIGINT AS chars, 0::BIGINT AS overfull FROM documents"


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can say it over whole tables; the other queries are tested in tests/llm."""
    return {"p1_found": _P1, "p4_found": _P4, "p4_cover": _P4_COVER, "p8_totals": _P8}
