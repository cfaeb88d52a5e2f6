"""The engine's queries by name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.functions import arrow as ar
from clausemill.functions import numbers as nm
from clausemill.functions import text as tx
from clausemill.functions.stemming import stem_terms
from clausemill.operators import approximate as ap
from clausemill.operators import retrieval as rt
from clausemill.operators import structure as st
from clausemill.operators import tables as tb
from clausemill.sources.files import build_manifest, checked
from clausemill.sources.tables import table
from clausemill.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# what several SQL texts share
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
FOLD = f"lower(translate({{0}}, '{tx.ACCENTED}', '{tx.PLAIN}'))"
SQUEEZE = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
CLAUSES = "c AS (SELECT DISTINCT ON (clause_id) * FROM parsed_clause)"
DATE = r"CASE WHEN {0} LIKE '____-__-__' THEN try_strptime({0}, '%Y-%m-%d')::DATE WHEN {0} LIKE '__/__/____' THEN try_strptime({0}, '%d/%m/%Y')::DATE END"
FILINGS = f"f AS (SELECT DISTINCT ON (id) id, product_line, cnpj, susep_process, process_year, trim(lower(extraction_mode)) AS extraction_mode, {DATE.format('version_start_date')} AS version_start, try_cast(page_count AS INTEGER) AS pages FROM manifest ORDER BY id, version_start_date NULLS LAST, page_count NULLS LAST, extraction_mode)"
EVERY_QUESTION = "q AS (SELECT DISTINCT row_id AS question, document_id, product_line, primary_clause_title AS asked, reference_clause_ids FROM product_claim_mismatch_draft)"
QUESTIONS = EVERY_QUESTION[:-1] + " WHERE CAST(split_part(row_id, '-', 2) AS BIGINT) % 20 = 0)"


def clauses(spark: SparkSession, d: str) -> DataFrame:
    return st.distinct_clauses(table(spark, d, "parsed_clause"))


def filings(spark: SparkSession, d: str) -> DataFrame:
    """Each filing once, typed: the earliest spelling of its rows stays."""
    own = table(spark, d, "manifest")
    one = tb.latest(own, "id", F.col("version_start_date").asc_nulls_last(), F.col("page_count").asc_nulls_last(), F.col("extraction_mode").asc())
    return one.select("id", "product_line", "cnpj", "susep_process", "process_year", F.trim(F.lower("extraction_mode")).alias("extraction_mode"), nm.two_form_date("version_start_date").alias("version_start"), F.expr("try_cast(page_count as int)").alias("pages"))


def every_question(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "product_claim_mismatch_draft")
    return own.select(F.col("row_id").alias("question"), "document_id", "product_line", F.col("primary_clause_title").alias("asked"), "reference_clause_ids").distinct()


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One question in twenty."""
    return every_question(spark, d).where("cast(split_part(question, '-', 2) as bigint) % 20 = 0")


# ---- scans, schemas, constraints -------------------------------------------------------------------------------


@_query(f"WITH {FILINGS} SELECT id, product_line, extraction_mode, strftime(version_start, '%Y-%m-%d') AS version_start, pages FROM f")
def q_filings(spark: SparkSession, d: str) -> DataFrame:
    return filings(spark, d).select("id", "product_line", "extraction_mode", F.date_format("version_start", "yyyy-MM-dd").alias("version_start"), "pages")


@_query(f"WITH {FILINGS} SELECT CASE WHEN extraction_mode IN ('text','partial') THEN 'extract' WHEN extraction_mode = 'ocr_required' THEN 'ocr' ELSE 'unknown' END AS route, count(*) AS filings, sum(pages)::BIGINT AS pages FROM f GROUP BY 1")
def q_route(spark: SparkSession, d: str) -> DataFrame:
    route = F.when(F.col("extraction_mode").isin("text", "partial"), "extract").when(F.col("extraction_mode") == "ocr_required", "ocr").otherwise("unknown")
    return filings(spark, d).groupBy(route.alias("route")).agg(F.count("*").alias("filings"), F.sum("pages").alias("pages"))


@_query(f"WITH {CLAUSES} SELECT document_id, count(*) AS rows FROM c GROUP BY ROLLUP (document_id)")
def q_build_manifest(spark: SparkSession, d: str) -> DataFrame:
    return build_manifest(clauses(spark, d), "document_id")


_RULES = {"has_text": "length(trim(text)) > 0", "pages_in_order": "page_start >= 1 and page_end >= page_start", "known_source": "source in ('text', 'ocr')", "confidence_in_range": "confidence is null or confidence between 0 and 1", "id_names_document": "clause_id = concat(document_id, ':', path)", "process_has_17_digits": "length(regexp_replace(susep_process, '[^0-9]', '')) = 17", "parent_above": "parent_id is null or length(parent_id) < length(clause_id)"}


@_query("WITH c AS (SELECT * FROM parsed_clause) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({p.replace(chr(39) + '[^0-9]' + chr(39) + ', ' + chr(39) * 2, chr(39) + '[^0-9]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39))}, false)) AS violations FROM c" for n, p in _RULES.items()))
def q_constraint_report(spark: SparkSession, d: str) -> DataFrame:
    return checked(table(spark, d, "parsed_clause"), _RULES)


@_query("SELECT clause_id, count(*) AS copies FROM parsed_clause GROUP BY clause_id HAVING count(*) > 1")
def q_repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_clause").groupBy("clause_id").agg(F.count("*").alias("copies")).where("copies > 1")


# ---- identifiers -----------------------------------------------------------------------------------------------

_DIGITS = "regexp_replace(susep_process, '[^0-9]', '', 'g')"


@_query(f"SELECT DISTINCT {_DIGITS} AS digits, substr({_DIGITS},1,5)||'.'||substr({_DIGITS},6,6)||'/'||substr({_DIGITS},12,4)||'-'||substr({_DIGITS},16,2) AS formatted, substr({_DIGITS},12,4) AS year FROM parsed_clause WHERE length({_DIGITS}) = 17")
def q_processes(spark: SparkSession, d: str) -> DataFrame:
    digits = nm.process_digits("susep_process")
    own = table(spark, d, "parsed_clause").select(digits.alias("digits"), nm.process_formatted("susep_process").alias("formatted"), F.substring(digits, 12, 4).alias("year"))
    return own.where("digits is not null").distinct()


def _mod11_sql(digits: str, weights: list[int]) -> str:
    total = "+".join(f"CAST(substr({digits},{i + 1},1) AS INTEGER)*{w}" for i, w in enumerate(weights))
    return f"CASE WHEN ({total})%11 < 2 THEN '0' ELSE CAST(11-({total})%11 AS VARCHAR) END"


_W1 = [*range(5, 1, -1), *range(9, 1, -1)]


@_query(f"WITH b AS (SELECT DISTINCT cnpj FROM parsed_clause), o AS (SELECT cnpj, {_mod11_sql('cnpj', _W1)} AS one FROM b), t AS (SELECT cnpj, one, substr(cnpj,1,12)||one AS base FROM o) SELECT cnpj, substr(cnpj,13,2) = one || {_mod11_sql('base', [6, *_W1])} AS valid FROM t")
def q_cnpj_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_clause").select("cnpj").distinct().select("cnpj", nm.cnpj_valid("cnpj").alias("valid"))


@_query(f"WITH n AS (SELECT cnpj, {SQUEEZE.format(FOLD.format('insurer'))} AS name, count(*) AS rows FROM parsed_clause GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cnpj ORDER BY rows DESC, name) AS k, sum(rows) OVER (PARTITION BY cnpj) AS total FROM n) SELECT cnpj, name, rows, total::BIGINT AS total FROM r WHERE k = 1")
def q_insurer_names(spark: SparkSession, d: str) -> DataFrame:
    """The usual name of each company, and how many of its rows bear it."""
    named = table(spark, d, "parsed_clause").groupBy("cnpj", tx.squeeze(tx.fold("insurer")).alias("name")).agg(F.count("*").alias("rows"))
    w = Window.partitionBy("cnpj")
    return named.withColumn("total", F.sum("rows").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("rows"), "name"))).where("k = 1").select("cnpj", "name", "rows", "total")


# ---- joins -----------------------------------------------------------------------------------------------------


@_query(f"WITH {CLAUSES}, {FILINGS} SELECT f.product_line, c.clause_type, CASE WHEN CAST(c.filing_year AS INTEGER) <= 2010 THEN 'until_2010' WHEN CAST(c.filing_year AS INTEGER) <= 2015 THEN '2011_2015' WHEN CAST(c.filing_year AS INTEGER) <= 2020 THEN '2016_2020' ELSE 'from_2021' END AS era, count(*) AS clauses, sum(length(c.text))::BIGINT AS chars FROM c JOIN f ON f.id = c.document_id GROUP BY 1, 2, 3")
def q_provenance(spark: SparkSession, d: str) -> DataFrame:
    own = clauses(spark, d).select("document_id", "clause_type", nm.era(F.col("filing_year").cast("int")).alias("era"), F.char_length("text").alias("chars"))
    return own.join(filings(spark, d).select(F.col("id").alias("document_id"), "product_line"), "document_id").groupBy("product_line", "clause_type", "era").agg(F.count("*").alias("clauses"), F.sum("chars").alias("chars"))


@_query("SELECT m.id, m.product_line FROM (SELECT DISTINCT id, product_line FROM manifest) m WHERE NOT EXISTS (SELECT 1 FROM parsed_clause p WHERE p.document_id = m.id)")
def q_filings_without_clauses(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "manifest").select("id", "product_line").distinct()
    return own.join(table(spark, d, "parsed_clause").select(F.col("document_id").alias("id")), "id", "left_anti")


@_query("SELECT DISTINCT m.claim_id, r.clause_id FROM product_claim_mismatch m, unnest(m.reference_clause_ids) AS r(clause_id) WHERE NOT EXISTS (SELECT 1 FROM parsed_clause p WHERE p.clause_id = r.clause_id)")
def q_unknown_references(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "product_claim_mismatch").select("claim_id", F.explode("reference_clause_ids").alias("clause_id")).distinct()
    return cited.join(table(spark, d, "parsed_clause").select("clause_id"), "clause_id", "left_anti")


@_query(f"WITH {CLAUSES}, g AS (SELECT document_id, trim(text) AS body, count(*) AS copies, min(clause_id) AS first_id FROM c WHERE length(trim(text)) >= 30 GROUP BY 1, 2 HAVING count(*) > 1) SELECT document_id, first_id, copies FROM g")
def q_twins(spark: SparkSession, d: str) -> DataFrame:
    own = clauses(spark, d).where(F.char_length(F.trim("text")) >= 30)
    return own.groupBy("document_id", F.trim("text").alias("body")).agg(F.count("*").alias("copies"), F.min("clause_id").alias("first_id")).where("copies > 1").select("document_id", "first_id", "copies")


_TITLE_KEY = SQUEEZE.format(FOLD.format(r"regexp_replace(title, '^\s*[0-9]+(\.[0-9]+)*[.)]?\s*', '')"))


@_query(f"WITH {CLAUSES} SELECT {_TITLE_KEY} AS title_key, count(*) AS clauses, count(DISTINCT document_id) AS documents FROM c WHERE {_TITLE_KEY} <> '' GROUP BY 1")
def q_shared_titles(spark: SparkSession, d: str) -> DataFrame:
    own = clauses(spark, d).select("document_id", tx.title_key("title").alias("title_key")).where("title_key is not null")
    return own.groupBy("title_key").agg(F.count("*").alias("clauses"), F.countDistinct("document_id").alias("documents"))


# ---- trees and order -------------------------------------------------------------------------------------------


@_query("WITH RECURSIVE c AS (SELECT DISTINCT ON (clause_id) clause_id, parent_id FROM parsed_clause), up AS (SELECT clause_id, parent_id AS ancestor_id, 1 AS distance FROM c WHERE parent_id IS NOT NULL UNION ALL SELECT up.clause_id, c.parent_id, up.distance + 1 FROM up JOIN c ON c.clause_id = up.ancestor_id WHERE c.parent_id IS NOT NULL) SELECT up.clause_id, up.ancestor_id, up.distance FROM up WHERE up.ancestor_id IN (SELECT clause_id FROM c)")
def q_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return st.ancestors(clauses(spark, d))


@_query(f"WITH {CLAUSES} SELECT c.clause_id, p.title || ' > ' || c.title AS breadcrumb FROM c JOIN c p ON p.clause_id = c.parent_id")
def q_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    own = clauses(spark, d)
    up = own.select(F.col("clause_id").alias("parent_id"), F.col("title").alias("above"))
    return own.select("clause_id", "parent_id", "title").join(up, "parent_id").select("clause_id", F.concat("above", F.lit(" > "), "title").alias("breadcrumb"))


@_query(f"WITH {CLAUSES}, n AS (SELECT parent_id, count(*) AS children FROM c WHERE parent_id IS NOT NULL GROUP BY 1) SELECT c.document_id, count(*) AS roots, sum(coalesce(n.children, 0))::BIGINT AS children, max(coalesce(n.children, 0)) AS most_children FROM c LEFT JOIN n ON n.parent_id = c.clause_id WHERE c.parent_id IS NULL GROUP BY 1")
def q_tree_shape(spark: SparkSession, d: str) -> DataFrame:
    own = clauses(spark, d).select("clause_id", "parent_id", "document_id")
    n = own.where("parent_id is not null").groupBy(F.col("parent_id").alias("clause_id")).agg(F.count("*").alias("children"))
    roots = own.where("parent_id is null").join(n, "clause_id", "left").select("document_id", F.coalesce("children", F.lit(0)).alias("children"))
    return roots.groupBy("document_id").agg(F.count("*").alias("roots"), F.sum("children").alias("children"), F.max("children").alias("most_children"))


@_query(f"WITH {CLAUSES}, w AS (SELECT clause_id, clause_type, lag(clause_type) OVER o AS before_type, lead(clause_id) OVER o AS next_id, page_start - lag(page_end) OVER o AS page_step FROM c WINDOW o AS (PARTITION BY document_id ORDER BY page_start, clause_id)) SELECT clause_id, next_id, coalesce(before_type <> clause_type, true) AS type_changes, page_step FROM w")
def q_neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = st.document_order()
    return clauses(spark, d).select("clause_id", F.lead("clause_id").over(w).alias("next_id"), F.coalesce(F.lag("clause_type").over(w) != F.col("clause_type"), F.lit(True)).alias("type_changes"), (F.col("page_start") - F.lag("page_end").over(w)).alias("page_step"))


@_query(f"WITH {CLAUSES}, o AS (SELECT clause_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_start, clause_id) AS k FROM c WHERE parent_id IS NULL) SELECT a.clause_id, b.clause_id AS neighbour_id, b.k - a.k AS offset_rows FROM o a JOIN o b ON a.document_id = b.document_id AND a.k <> b.k AND abs(a.k - b.k) <= 3")
def q_root_window(spark: SparkSession, d: str) -> DataFrame:
    """Root clauses up to three places before or after each root clause."""
    w = st.document_order()
    near = w.rowsBetween(-3, 3)
    own = clauses(spark, d).where("parent_id is null").withColumn("k", F.row_number().over(w))
    got = own.withColumn("near", F.collect_list(F.struct("clause_id", "k")).over(near)).select("clause_id", "k", F.explode("near").alias("o"))
    return got.where("o.k <> k").select("clause_id", F.col("o.clause_id").alias("neighbour_id"), (F.col("o.k") - F.col("k")).alias("offset_rows"))


_REFS = r"list_distinct(regexp_extract_all(text, '(?i)cl[áa]usulas?\s+([0-9]+(?:\.[0-9]+)*)', 1))"


@_query(f"WITH {CLAUSES} SELECT clause_id, r.number FROM c, unnest({_REFS}) AS r(number)")
def q_cross_references(spark: SparkSession, d: str) -> DataFrame:
    return clauses(spark, d).select("clause_id", F.explode(tx.cross_references("text")).alias("number"))


@_query(
    f"WITH {CLAUSES}, a AS (SELECT *, {_REFS} AS refs FROM c WHERE clause_type = 'coverage'), b AS (SELECT *, regexp_extract(title, '^([0-9]+(?:\\.[0-9]+)*)', 1) AS number FROM c WHERE clause_type = 'exclusion'), "
    "j AS (SELECT a.clause_id AS source_id, b.clause_id AS target_id, greatest(0, greatest(a.page_start, b.page_start) - least(a.page_end, b.page_end)) AS gap, a.parent_id AS ap, b.parent_id AS bp, list_contains(a.refs, b.number) AS named FROM a JOIN b ON a.document_id = b.document_id AND (a.bundle_section IS NULL OR b.bundle_section IS NULL OR a.bundle_section = b.bundle_section)), "
    "e AS (SELECT source_id, target_id, gap, CASE WHEN ap = bp THEN 1 WHEN named THEN 2 WHEN gap <= 3 THEN 3 END AS edge FROM j) SELECT source_id, target_id, edge, gap FROM e WHERE edge IS NOT NULL"
)
def q_linked_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return st.linked(clauses(spark, d), "coverage", "exclusion")


@_query(
    f"WITH {CLAUSES}, a AS (SELECT *, {_REFS} AS refs FROM c WHERE clause_type = 'coverage'), b AS (SELECT *, regexp_extract(title, '^([0-9]+(?:\\.[0-9]+)*)', 1) AS number FROM c WHERE clause_type = 'exclusion'), "
    "j AS (SELECT a.clause_id AS source_id, a.document_id, b.clause_id AS target_id, greatest(0, greatest(a.page_start, b.page_start) - least(a.page_end, b.page_end)) AS gap, a.parent_id AS ap, b.parent_id AS bp, list_contains(a.refs, b.number) AS named FROM a JOIN b ON a.document_id = b.document_id AND (a.bundle_section IS NULL OR b.bundle_section IS NULL OR a.bundle_section = b.bundle_section)), "
    "e AS (SELECT *, CASE WHEN ap = bp THEN 1 WHEN named THEN 2 WHEN gap <= 3 THEN 3 END AS edge FROM j), r AS (SELECT source_id, target_id, edge, gap, row_number() OVER (PARTITION BY source_id ORDER BY edge, gap, target_id) AS k FROM e WHERE edge IS NOT NULL) SELECT source_id, target_id, edge FROM r WHERE k = 1"
)
def q_coretrieve(spark: SparkSession, d: str) -> DataFrame:
    """For each coverage the one exclusion a reserved place would hold."""
    own = st.linked(clauses(spark, d), "coverage", "exclusion")
    return own.groupBy("source_id").agg(F.min(F.struct("edge", "gap", "target_id")).alias("m")).select("source_id", F.col("m.target_id").alias("target_id"), F.col("m.edge").alias("edge"))


# ---- lines and boilerplate -------------------------------------------------------------------------------------

_LINES = f"{CLAUSES}, l AS (SELECT document_id, clause_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM c)"


@_query(f"WITH {_LINES}, k AS (SELECT DISTINCT document_id, clause_id, regexp_replace({SQUEEZE.format(FOLD.format('line'))}, '[0-9]+', '#', 'g') AS line_key FROM l), n AS (SELECT document_id, count(*) AS n FROM c GROUP BY 1) SELECT k.document_id, k.line_key, count(*) AS clauses FROM k JOIN n USING (document_id) WHERE k.line_key <> '' GROUP BY 1, 2, n.n HAVING count(*) >= 0.3 * n.n AND count(*) >= 2")
def q_running_lines(spark: SparkSession, d: str) -> DataFrame:
    return st.running_line_keys(clauses(spark, d), 0.3)


_ITEM_SQL = r"regexp_matches(line, '^([A-Za-z]{1,2}\)|[•–-])\s+\S')"


@_query(f"WITH {_LINES} SELECT document_id, count(*) AS lines, count(*) FILTER (WHERE trim(line) = '') AS blank, count(*) FILTER (WHERE {_ITEM_SQL}) AS items, count(*) FILTER (WHERE regexp_matches(line, '\\.{{4,}}\\s*[0-9]{{1,4}}\\s*$')) AS dot_leaders, count(*) FILTER (WHERE regexp_matches(line, '[0-9]{{1,4}}\\s*$')) AS number_ends FROM l GROUP BY 1")
def q_line_profile(spark: SparkSession, d: str) -> DataFrame:
    own = st.lines(clauses(spark, d), ["document_id", "clause_id"])
    return own.groupBy("document_id").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") == "").alias("blank"), F.count_if(tx.list_item("line")).alias("items"), F.count_if(tx.dot_leader("line")).alias("dot_leaders"), F.count_if(F.regexp_like("line", F.lit(r"[0-9]{1,4}\s*$"))).alias("number_ends"))


@_query(f"WITH {_LINES}, m AS (SELECT clause_id, line_no, {_ITEM_SQL} AS item FROM l), g AS (SELECT clause_id, item, line_no - row_number() OVER (PARTITION BY clause_id, item ORDER BY line_no) AS island FROM m) SELECT clause_id, count(DISTINCT island) AS runs, count(*) AS items FROM g WHERE item GROUP BY 1")
def q_item_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of item lines that follow each other, of each clause."""
    own = st.lines(clauses(spark, d), ["clause_id"]).where(tx.list_item("line"))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("clause_id").orderBy("line_no"))
    return own.withColumn("island", island).groupBy("clause_id").agg(F.countDistinct("island").alias("runs"), F.count("*").alias("items"))


@_query(f"WITH {_LINES}, n AS (SELECT clause_id, line, lead(line) OVER (PARTITION BY clause_id ORDER BY line_no) AS following FROM l) SELECT clause_id, count(*) AS rejoins FROM n WHERE regexp_matches(line, '\\p{{L}}-$') AND regexp_matches(following, '^\\p{{Ll}}') GROUP BY 1")
def q_rejoins(spark: SparkSession, d: str) -> DataFrame:
    own = st.lines(clauses(spark, d), ["clause_id"])
    ahead = F.lead("line").over(Window.partitionBy("clause_id").orderBy("line_no"))
    return own.withColumn("following", ahead).where(tx.rejoins("line", "following")).groupBy("clause_id").agg(F.count("*").alias("rejoins"))


# ---- classification and agreement ------------------------------------------------------------------------------

# fixed values: ordered title rules
_TYPES = (("exclusion", "^(riscos? excluidos?|prejuizos nao indenizaveis|bens nao compreendidos|situacoes sem amparo|perda de direitos|exclusoes)"), ("definition", "^(definicoes|glossario|conceitos|termos usados)"), ("coverage", "^(cobertura|riscos cobertos|garantias|danos a terceiros|assistencia)"), ("procedure", "^(liquidacao|aviso de sinistro|regulacao|vistoria|documentos)"), ("condition", "^(obrigacoes|cancelamento|pagamento|vigencia|alteracao|franquia)"))
_TYPE_CASE = "CASE " + " ".join(f"WHEN regexp_matches({_TITLE_KEY}, '{p}') THEN '{n}'" for n, p in _TYPES) + " ELSE 'other' END"


def _ruled():
    case = None
    for name, pattern in _TYPES:
        hit = F.regexp_like(tx.title_key("title"), F.lit(pattern))
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise("other")


@_query(f"WITH {CLAUSES} SELECT clause_type, {_TYPE_CASE} AS ruled, count(*) AS clauses FROM c GROUP BY 1, 2")
def q_rule_confusion(spark: SparkSession, d: str) -> DataFrame:
    return clauses(spark, d).groupBy("clause_type", _ruled().alias("ruled")).agg(F.count("*").alias("clauses"))


@_query(f"WITH {CLAUSES}, p AS (SELECT clause_type AS t, {_TYPE_CASE} AS r FROM c), x AS (SELECT DISTINCT t AS kind FROM p) SELECT kind, count(*) FILTER (WHERE t = kind) AS support, round(coalesce(count(*) FILTER (WHERE t = kind AND r = kind)::DOUBLE / nullif(count(*) FILTER (WHERE r = kind), 0), 0), 6) AS precision_, round(coalesce(count(*) FILTER (WHERE t = kind AND r = kind)::DOUBLE / nullif(count(*) FILTER (WHERE t = kind), 0), 0), 6) AS recall_ FROM p, x GROUP BY kind")
def q_class_rates(spark: SparkSession, d: str) -> DataFrame:
    counts = clauses(spark, d).groupBy(F.col("clause_type").alias("t"), _ruled().alias("r")).agg(F.count("*").alias("n"))
    as_true = counts.select(F.col("t").alias("kind"), "n", F.lit(0).alias("said"), F.when(F.col("t") == F.col("r"), F.col("n")).otherwise(0).alias("right"))
    as_said = counts.select(F.col("r").alias("kind"), F.lit(0).alias("n"), F.col("n").alias("said"), F.lit(0).alias("right"))
    each = as_true.unionByName(as_said).groupBy("kind").agg(F.sum("n").alias("support"), F.sum("said").alias("said"), F.sum("right").alias("right")).where("support > 0")
    return each.select("kind", "support", F.round(F.coalesce(F.try_divide("right", "said"), F.lit(0.0)), 6).alias("precision_"), F.round(F.coalesce(F.try_divide("right", "support"), F.lit(0.0)), 6).alias("recall_"))


_REFSET = "list_distinct(list_filter(string_split(d.reference_clause_ids, ';'), lambda x: trim(x) <> ''))"


@_query(f"WITH p AS (SELECT DISTINCT claim_id, reference_clause_ids FROM product_claim_mismatch), d AS (SELECT DISTINCT finalized_claim_id, reference_clause_ids FROM product_claim_mismatch_draft WHERE finalized_claim_id IS NOT NULL), j AS (SELECT p.claim_id, list_distinct(p.reference_clause_ids) AS a, {_REFSET} AS b FROM p JOIN d ON d.finalized_claim_id = p.claim_id) SELECT claim_id, len(a) AS final_refs, len(b) AS draft_refs, round(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS jaccard, round(2.0 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 6) AS f1 FROM j")
def q_reference_agreement(spark: SparkSession, d: str) -> DataFrame:
    final = table(spark, d, "product_claim_mismatch").select("claim_id", F.array_distinct("reference_clause_ids").alias("a")).distinct()
    draft = table(spark, d, "product_claim_mismatch_draft").where("finalized_claim_id is not null").select(F.col("finalized_claim_id").alias("claim_id"), F.col("reference_clause_ids").alias("r")).distinct()
    both = final.join(draft, "claim_id").withColumn("b", F.array_distinct(F.filter(F.split("r", ";"), lambda x: F.trim(x) != "")))
    same = F.size(F.array_intersect("a", "b"))
    return both.select("claim_id", F.size("a").alias("final_refs"), F.size("b").alias("draft_refs"), F.round(F.try_divide(same, F.size(F.array_union("a", "b"))), 6).alias("jaccard"), F.round(F.try_divide(2.0 * same, F.size("a") + F.size("b")), 6).alias("f1"))


@_query("WITH v AS (SELECT source, lang, count(*) AS votes, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY votes DESC, first) AS k, count(*) OVER (PARTITION BY source) AS kinds FROM v) SELECT source, lang, votes, kinds = 1 AS unanimous FROM r WHERE k = 1")
def q_majority_language(spark: SparkSession, d: str) -> DataFrame:
    return tb.majority(table(spark, d, "documents").where("lang is not null"), "source", "lang", "doc_id")


# fixed values: what the reviewers wrote for yes
_YES = ("yes", "y", "sim", "s", "true", "1", "ok")


@_query(f"SELECT product_line, count(*) AS drafts, count(*) FILTER (WHERE lower(trim(approved)) IN {_YES}) AS approved, round(avg(CASE WHEN finalized_claim_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS final_share FROM (SELECT DISTINCT * FROM product_claim_mismatch_draft) GROUP BY GROUPING SETS ((product_line), ())")
def q_draft_outcomes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "product_claim_mismatch_draft").distinct()
    return own.rollup("product_line").agg(F.count("*").alias("drafts"), F.count_if(F.lower(F.trim("approved")).isin(*_YES)).alias("approved"), F.round(F.avg(F.when(F.col("finalized_claim_id").isNull(), 0.0).otherwise(1.0)), 6).alias("final_share"))


_NO_WORD = r"[^\p{L}\p{N}_]"
_PII = (*((n, f"(?:^|{_NO_WORD}){p}(?:{_NO_WORD}|$)") for n, p in tx.SHAPES), ("possible_proper_name", rf"(?:^|[^\p{{L}}\p{{N}}_\s]|[^.!?]\s|^\s){tx.TWO_NAMES}(?:{_NO_WORD}|$)"))


@_query("WITH d AS (SELECT DISTINCT row_id, narrative FROM product_claim_mismatch_draft) SELECT row_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(narrative, '{p}') THEN '{n}' END" for n, p in _PII) + "], lambda x: x IS NOT NULL), ';') AS flags FROM d")
def q_shape_flags(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "product_claim_mismatch_draft").select("row_id", "narrative").distinct()
    return own.select("row_id", F.array_join(tx.personal_flags("narrative"), ";").alias("flags"))


# ---- lexical retrieval -----------------------------------------------------------------------------------------

_CORPUS = f"{CLAUSES}, k AS (SELECT clause_id, document_id, product_line, {TOKENS.format(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || text')} AS words FROM c)"
_BM25 = (
    f"{_CORPUS}, {QUESTIONS}, a AS (SELECT DISTINCT question, unnest({TOKENS.format('asked')}) AS term FROM q), s AS (SELECT count(*) AS n, avg(len(words)) AS avg_len FROM k), "
    "p AS (SELECT clause_id, len, term, count(*) AS tf FROM (SELECT clause_id, len(words) AS len, unnest(words) AS term FROM k) WHERE term IN (SELECT term FROM a) GROUP BY 1, 2, 3), "
    "i AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, s GROUP BY term, n), "
    "b AS (SELECT a.question, p.clause_id, round(sum(i.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.len / s.avg_len))), 9) AS score FROM a JOIN p USING (term) JOIN i USING (term), s GROUP BY 1, 2)"
)
_BM25_EVERY = _BM25.replace(QUESTIONS, EVERY_QUESTION)


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return clauses(spark, d).select("clause_id", "document_id", "product_line", F.concat_ws(" ", "title", "text").alias("body"))


def _top(spark: SparkSession, d: str, asked: DataFrame, per: str | None = None) -> DataFrame:
    """The ten best clauses of each question, or documents by their best clause; repeated rows count once there."""
    own = table(spark, d, "parsed_clause").select("clause_id", "document_id", F.concat_ws(" ", "title", "text").alias("body"))
    return rt.best_bm25(own, "clause_id", "body", asked, "question", "asked", 10, per)


@_query(f"WITH {_CORPUS}, t AS (SELECT clause_id, unnest(words) AS term FROM k) SELECT term, count(*) AS tf, count(DISTINCT clause_id) AS df FROM t GROUP BY 1")
def q_terms(spark: SparkSession, d: str) -> DataFrame:
    return rt.postings(_corpus(spark, d), "clause_id", "body").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@_query(f"WITH {_CORPUS}, t AS (SELECT DISTINCT clause_id, unnest(words) AS term FROM k), s AS (SELECT count(*) AS n FROM k) SELECT term, round(ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM t, s GROUP BY term, n")
def q_idf(spark: SparkSession, d: str) -> DataFrame:
    own = _corpus(spark, d)
    df = rt.postings(own, "clause_id", "body").groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(own.agg(F.count("*").alias("n")))).select("term", F.round(rt.inverse_frequency(F.col("df"), F.col("n")), 6).alias("idf"))  # one row on the right


@_query(f"WITH {_BM25_EVERY}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, clause_id) AS rank FROM b) SELECT question, clause_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, every_question(spark, d)).select("question", "clause_id", F.round("score", 6).alias("score"), "rank")


_FILTERED = f"{_BM25}, g AS (SELECT b.question, b.clause_id, b.score FROM b JOIN q ON q.question = b.question JOIN k ON k.clause_id = b.clause_id AND k.document_id = q.document_id)"


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    """Scores with the statistics of the whole corpus, of the question's own document only."""
    return rt.bm25(_corpus(spark, d), "clause_id", "body", questions(spark, d).select("question", "document_id", "asked"), "question", "asked", scope="document_id")


@_query(f"WITH {_FILTERED}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, clause_id) AS rank FROM g) SELECT question, clause_id, rank FROM r WHERE rank <= 10")
def q_bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rt.best(_filtered(spark, d), "question", "clause_id", "score", 10).select("question", "clause_id", "rank")


@_query(f"WITH {_BM25_EVERY}, r AS (SELECT b.question, k.document_id, b.clause_id, b.score, row_number() OVER (PARTITION BY b.question, k.document_id ORDER BY b.score DESC, b.clause_id) AS n FROM b JOIN k USING (clause_id)), t AS (SELECT question, document_id, row_number() OVER (PARTITION BY question ORDER BY score DESC, clause_id) AS rank FROM r WHERE n = 1) SELECT question, document_id, rank FROM t WHERE rank <= 10")
def q_bm25_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their best clause."""
    return _top(spark, d, every_question(spark, d), "document_id").select("question", "document_id", "rank")


_TRUTH = "t AS (SELECT DISTINCT question, product_line, trim(unnest(string_split(reference_clause_ids, ';'))) AS clause_id FROM q)"
_MEASURES = (
    f"{_FILTERED}, {_TRUTH}, r AS (SELECT question, clause_id, row_number() OVER (PARTITION BY question ORDER BY score DESC, clause_id) AS rank FROM g), n AS (SELECT question, product_line, count(*) AS relevant FROM t WHERE clause_id <> '' GROUP BY 1, 2), "
    "h AS (SELECT r.question, count(*) AS hits, min(rank) AS first, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM r JOIN t USING (question, clause_id) WHERE rank <= 10 GROUP BY 1), "
    "m AS (SELECT n.question, n.product_line, coalesce(hits::DOUBLE / relevant, 0) AS recall, coalesce(1.0::DOUBLE / first, 0) AS rr, coalesce(dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda x: 1.0::DOUBLE / log2(x + 1))), 0) AS ndcg FROM n LEFT JOIN h USING (question))"
)


@_query(f"WITH {_MEASURES} SELECT product_line, count(*) AS questions, round(avg(recall), 6) AS recall_at_10, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_10 FROM m GROUP BY GROUPING SETS ((product_line), ())")
def q_retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d)
    truth = asked.select("question", F.explode(F.split("reference_clause_ids", ";")).alias("clause_id")).select("question", F.trim("clause_id").alias("clause_id")).where("clause_id <> ''")
    each = rt.measures(rt.best(_filtered(spark, d), "question", "clause_id", "score", 10), truth, "question", "clause_id", 10)
    return each.join(asked.select("question", "product_line"), "question").rollup("product_line").agg(F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("recall_at_10"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg_at_10"))


@_query(f"WITH {_BM25_EVERY}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, clause_id) AS rank FROM b) SELECT q.product_line, count(*) AS retrieved, round(avg(CASE WHEN split_part(r.clause_id, ':', 1) <> q.document_id THEN 1.0 ELSE 0.0 END), 6) AS foreign_rate FROM r JOIN q USING (question) WHERE rank <= 10 GROUP BY 1")
def q_foreign_rate(spark: SparkSession, d: str) -> DataFrame:
    asked = every_question(spark, d)
    top = _top(spark, d, asked).join(asked.select("question", "document_id", "product_line"), "question")
    return top.groupBy("product_line").agg(F.count("*").alias("retrieved"), F.round(F.avg(F.when(F.substring_index("clause_id", ":", 1) != F.col("document_id"), 1.0).otherwise(0.0)), 6).alias("foreign_rate"))


# ---- vector retrieval ------------------------------------------------------------------------------------------

_VECTORS = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.vec_id AS question, a.label AS asked_label, b.vec_id, b.label, round(list_cosine_similarity({0}), 9) AS score FROM e a, e b WHERE a.vec_id % 20 = 0)"
_WHOLE = _VECTORS.format("a.v, b.v")


def _near(spark: SparkSession, d: str, k: int, part: tuple[int, int] | None = None) -> DataFrame:
    own = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", part[0], part[1]).alias("embedding") if part else F.col("embedding"))
    asked = own.where("vec_id % 20 = 0")
    return rt.nearest(own, "vec_id", "embedding", asked, "vec_id", "embedding", k)


@_query(f"WITH {_WHOLE}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS rank FROM x) SELECT question, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def q_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 10).select("question", "vec_id", F.round("score", 6).alias("score"), "rank")


@_query(f"WITH {_WHOLE}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS n FROM x), o AS (SELECT question, label, min(n) AS n FROM r WHERE n <= 40 GROUP BY 1, 2), z AS (SELECT question, label, row_number() OVER (PARTITION BY question ORDER BY n) AS rank FROM o) SELECT question, label, rank FROM z WHERE rank <= 5")
def q_dense_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Labels by their nearest vector among the first 40."""
    top = _near(spark, d, 40).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return rt.roll_up(top.select("question", "label", F.col("rank").alias("n")), "question", "label", "n", 5).select("question", "label", "rank")


_LEGS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.vec_id AS question, b.vec_id, round(list_cosine_similarity(a.v[1:32], b.v[1:32]), 9) AS s1, round(list_cosine_similarity(a.v[33:64], b.v[33:64]), 9) AS s2 FROM e a, e b WHERE a.vec_id % 20 = 0), y AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY s1 DESC, vec_id) AS r1, row_number() OVER (PARTITION BY question ORDER BY s2 DESC, vec_id) AS r2 FROM x)"


@_query(f"WITH {_LEGS}, f AS (SELECT question, vec_id, round(CASE WHEN r1 <= 100 THEN 1.0::DOUBLE / (60 + r1) ELSE 0 END + CASE WHEN r2 <= 100 THEN 1.0::DOUBLE / (60 + r2) ELSE 0 END, 12) AS score FROM y WHERE r1 <= 100 OR r2 <= 100), z AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS rank FROM f) SELECT question, vec_id, rank FROM z WHERE rank <= 10")
def q_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two legs of depth 100, over either half of the vector, fused by reciprocal ranks."""
    legs = [_near(spark, d, 100, (1, 32)), _near(spark, d, 100, (33, 32))]
    return rt.reciprocal_rank_fusion(legs, "question", "vec_id", 10).select("question", "vec_id", "rank")


@_query(f"WITH {_LEGS}, a AS (SELECT question, vec_id, s1, (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w) AS p FROM y WHERE r1 <= 100 WINDOW w AS (PARTITION BY question)), b AS (SELECT question, vec_id, s2, (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) AS p FROM y WHERE r2 <= 100 WINDOW w AS (PARTITION BY question)), f AS (SELECT question, vec_id, round(sum(p * 0.5::DOUBLE), 9) AS score FROM (SELECT question, vec_id, p FROM a UNION ALL SELECT question, vec_id, p FROM b) GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS rank FROM f) SELECT question, vec_id, rank FROM z WHERE rank <= 10")
def q_weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    legs = [(_near(spark, d, 100, (1, 32)), 0.5), (_near(spark, d, 100, (33, 32)), 0.5)]
    return rt.weighted_fusion(legs, "question", "vec_id", 10).select("question", "vec_id", "rank")


# ---- aggregates ------------------------------------------------------------------------------------------------


def _rank_sql(values: str, share: float) -> str:
    return f"list_sort(list({values}))[least(floor(count({values}) * {share})::BIGINT, count({values}) - 1) + 1]"


@_query(f"WITH {CLAUSES}, n AS (SELECT document_id, length(text) AS n FROM c) SELECT document_id, count(*) AS clauses, min(n) AS least, {_rank_sql('n', 0.5)} AS p50, {_rank_sql('n', 0.9)} AS p90, max(n) AS most, round(avg(n), 6) AS mean FROM n GROUP BY 1")
def q_length_summary(spark: SparkSession, d: str) -> DataFrame:
    own = clauses(spark, d).select("document_id", F.char_length("text").alias("n"))
    sums = own.groupBy("document_id").agg(F.count("*").alias("clauses"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))
    return sums.join(rt.nearest_ranks(own, "document_id", "n", {"p50": 0.5, "p90": 0.9}), "document_id")


@_query(f"WITH {CLAUSES}, n AS (SELECT document_id, count(*) AS n FROM c GROUP BY 1), r AS (SELECT document_id, max(clause_count) AS reported FROM chunk_report GROUP BY 1) SELECT coalesce(n.document_id, r.document_id) AS document_id, n.n AS clauses, r.reported, CASE WHEN r.reported IS NULL THEN 'missing' WHEN n.n IS NULL THEN 'gone' WHEN n.n <> r.reported THEN 'outdated' ELSE 'current' END AS state FROM n FULL JOIN r ON n.document_id = r.document_id")
def q_report_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether each filing's line of the earlier report still holds."""
    now = clauses(spark, d).groupBy("document_id").agg(F.count("*").alias("clauses"))
    then = table(spark, d, "chunk_report").groupBy("document_id").agg(F.max("clause_count").alias("reported"))
    state = F.when(F.col("reported").isNull(), "missing").when(F.col("clauses").isNull(), "gone").when(F.col("clauses") != F.col("reported"), "outdated").otherwise("current")
    return now.join(then, "document_id", "full_outer").select("document_id", "clauses", "reported", state.alias("state"))


@_query("SELECT event_type, count(*) AS n, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS median, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS spread FROM events GROUP BY GROUPING SETS ((event_type), ())")
def q_value_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))


@_query("WITH g AS (SELECT g / 10.0 AS floor_ FROM range(0, 11) AS t(g)) SELECT round(floor_, 1)::DOUBLE AS floor_, count(*) FILTER (WHERE confidence >= floor_) AS kept, count(*) FILTER (WHERE confidence >= floor_ AND source = 'ocr') AS kept_ocr FROM g, (SELECT confidence, source FROM parsed_clause WHERE confidence IS NOT NULL) GROUP BY 1")
def q_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How many rows would stay at each floor of confidence; one pass, the eleven floors are columns first."""
    own = table(spark, d, "parsed_clause").where("confidence is not null")
    floors = [g / 10 for g in range(11)]
    one = own.agg(*[F.count_if(F.col("confidence") >= f).alias(f"a{i}") for i, f in enumerate(floors)], *[F.count_if((F.col("confidence") >= f) & (F.col("source") == "ocr")).alias(f"b{i}") for i, f in enumerate(floors)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("floor_"), F.col(f"a{i}").alias("kept"), F.col(f"b{i}").alias("kept_ocr")) for i, f in enumerate(floors)])).alias("x")).select("x.*")


# ---- sampling and apportionment --------------------------------------------------------------------------------


@_query(f"WITH {CLAUSES}, r AS (SELECT clause_id, clause_type, source, row_number() OVER (PARTITION BY clause_type, source ORDER BY md5(clause_id), clause_id) AS n, count(*) OVER (PARTITION BY clause_type, source) AS of_ FROM c) SELECT clause_id, clause_type, source FROM r WHERE n <= greatest(1, round_even(of_ * 0.05, 0))")
def q_quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return tb.quota_sample(clauses(spark, d).select("clause_id", "clause_type", "source"), ["clause_type", "source"], "clause_id", 0.05)


@_query(f"WITH {CLAUSES}, n AS (SELECT clause_type, count(*) AS clauses FROM c GROUP BY 1), x AS (SELECT *, 100.0::DOUBLE * clauses / sum(clauses) OVER () AS x FROM n), f AS (SELECT *, floor(x)::BIGINT AS f FROM x), r AS (SELECT *, row_number() OVER (ORDER BY round(x - f, 9) DESC, clause_type) AS r, 100 - sum(f) OVER () AS rest FROM f) SELECT clause_type, clauses, f + CASE WHEN r <= rest THEN 1 ELSE 0 END AS seats FROM r")
def q_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    counts = clauses(spark, d).groupBy("clause_type").agg(F.count("*").alias("clauses"))
    return tb.largest_remainder(counts, "clause_type", "clauses", 100)


@_query("WITH m AS (SELECT DISTINCT id, product_line FROM manifest) SELECT id, product_line, row_number() OVER (PARTITION BY product_line ORDER BY id) AS turn FROM m")
def q_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return tb.round_robin(table(spark, d, "manifest").select("id", "product_line").distinct(), "product_line", "id")


# ---- merges and reads ------------------------------------------------------------------------------------------


@_query("WITH o AS (SELECT DISTINCT ON (row_id) row_id AS id, product_line, expected_verdict FROM product_claim_mismatch_draft WHERE finalized_claim_id IS NULL ORDER BY row_id), n AS (SELECT DISTINCT ON (row_id) row_id AS id, 'approved' AS product_line, expected_verdict FROM product_claim_mismatch_draft ORDER BY row_id) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.product_line ELSE o.product_line END AS product_line, CASE WHEN o.id IS NOT NULL THEN o.expected_verdict ELSE n.expected_verdict END AS expected_verdict FROM o FULL JOIN n ON o.id = n.id")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "product_claim_mismatch_draft").select(F.col("row_id").alias("id"), "product_line", "expected_verdict", "finalized_claim_id")
    old = own.where("finalized_claim_id is null").drop("finalized_claim_id").dropDuplicates(["id"])
    new = own.select("id", F.lit("approved").alias("product_line"), "expected_verdict").dropDuplicates(["id"])
    return tb.upsert(old, new, "id", ["expected_verdict"])


@_query("WITH o AS (SELECT DISTINCT claim_id FROM product_claim_mismatch), n AS (SELECT DISTINCT claim_id FROM claim) SELECT claim_id FROM o UNION ALL SELECT claim_id FROM n WHERE claim_id NOT IN (SELECT claim_id FROM o)")
def q_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "product_claim_mismatch").select("claim_id").distinct()
    return tb.insert_ignore(old, table(spark, d, "claim").select("claim_id").distinct(), ["claim_id"])


@_query("WITH r AS (SELECT claim_id, policy_ref, strftime(submitted_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS submitted, row_number() OVER (PARTITION BY regexp_replace(policy_ref, '[^0-9]', '', 'g') ORDER BY submitted_at DESC, claim_id) AS n FROM (SELECT DISTINCT claim_id, policy_ref, submitted_at FROM claim) WHERE policy_ref IS NOT NULL) SELECT claim_id, policy_ref, submitted FROM r WHERE n = 1")
def q_latest_claims(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "claim").where("policy_ref is not null").select("claim_id", "policy_ref", "submitted_at").distinct()
    keyed = own.withColumn("process", F.regexp_replace("policy_ref", "[^0-9]", ""))
    return tb.latest(keyed, "process", F.desc("submitted_at"), F.asc("claim_id")).select("claim_id", "policy_ref", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("submitted"))


@_query("SELECT claim_id, strftime(submitted_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS submitted FROM (SELECT DISTINCT claim_id, submitted_at FROM claim) ORDER BY submitted_at DESC, claim_id LIMIT 20 OFFSET 20")
def q_second_page(spark: SparkSession, d: str) -> DataFrame:
    """A paged read: the second page of 20."""
    own = table(spark, d, "claim").select("claim_id", "submitted_at").distinct().orderBy(F.desc("submitted_at"), "claim_id").offset(20).limit(20)
    return own.select("claim_id", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("submitted"))


@_query("SELECT DISTINCT substr(sha256(text), 1, 16) AS key, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def q_content_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a content-addressed cache: each distinct text once."""
    return table(spark, d, "documents").where("text is not null").select(F.substring(F.sha2("text", 256), 1, 16).alias("key"), F.char_length("text").alias("chars")).distinct()


@_query("SELECT event_type, (props::JSON->>'k')::INTEGER % 10 AS bucket, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def q_json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))


@_query("SELECT DISTINCT ON (id) id, lower(filename) AS filename, trim(BOTH '-' FROM regexp_replace(" + FOLD.format("selection_rationale") + ", '[^a-z0-9]+', '-', 'g')) AS slug, substr(sha256(id || '|' || filename), 1, 16) AS fingerprint FROM manifest ORDER BY id, filename")
def q_slugs(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "manifest").select("id", F.lower("filename").alias("filename"), tx.slug("selection_rationale").alias("slug"), tx.fingerprint("id", "filename").alias("fingerprint"))
    return own.dropDuplicates(["id"])


# ---- event windows (batch; the same functions run on streams) ---------------------------------------------------


@_query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def q_event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling(table(spark, d, "events"), "1 hour").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@_query("WITH b AS (SELECT time_bucket(INTERVAL 10 minute, ts) AS b FROM events), s AS (SELECT b - k * INTERVAL 10 minute AS w FROM b, range(0, 3) AS t(k)) SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS events FROM s GROUP BY 1")
def q_event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ev.sliding(table(spark, d, "events"), "30 minutes", "10 minutes").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@_query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, s")
def q_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(table(spark, d, "events"), "30 minutes").withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


@_query("SELECT count(DISTINCT event_id) AS events, count(*) AS rows FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events)")
def q_event_dedup(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", "ts")
    twice = own.unionByName(own)
    return ev.without_repeats(twice).agg(F.count("*").alias("events")).crossJoin(F.broadcast(twice.agg(F.count("*").alias("rows"))))  # one row on either side


# ---- segmentation, folding, approximate search, text forms ------------------------------------------------------

_NUMBER = "regexp_extract(title, '^([0-9]+(?:\\.[0-9]+)*)', 1)"


@_query(f"WITH {CLAUSES} SELECT document_id, {_NUMBER} AS label, CASE WHEN contains({_NUMBER}, '.') THEN regexp_replace({_NUMBER}, '\\.[0-9]+$', '') END AS parent_label, len(string_split({_NUMBER}, '.')) AS depth, len(string_split(text, chr(10))) AS body_lines FROM c")
def q_segment(spark: SparkSession, d: str) -> DataFrame:
    """Documents written out line by line and segmented again; the clauses they were made of come back."""
    w = Window.partitionBy("document_id").orderBy(F.col("path_order"), "clause_id")
    own = clauses(spark, d).select("document_id", "clause_id", "title", "text", F.transform(F.split("path", "[/.]"), lambda x: x.cast("int")).alias("path_order"))
    written = own.withColumn("k", F.row_number().over(w)).select("document_id", "k", F.posexplode(F.concat(F.array("title"), F.split("text", "\n", -1))).alias("n", "line"))
    return st.segment(written.withColumn("position", F.struct("k", "n")), "document_id", "position", "line").select("document_id", "label", "parent_label", "depth", "body_lines")


@_query(f"WITH {CLAUSES}, u AS (SELECT c.document_id, CASE WHEN length(c.text) < 500 AND p.clause_id IS NOT NULL THEN c.parent_id ELSE c.clause_id END AS unit_id, length(c.text) AS chars FROM c LEFT JOIN c p ON p.clause_id = c.parent_id), g AS (SELECT document_id, unit_id, count(*) AS parts, sum(chars) AS chars FROM u GROUP BY 1, 2) SELECT document_id, count(*) FILTER (WHERE parts = 1 AND chars <= 3000) AS single_units, count(*) FILTER (WHERE parts > 1 AND chars <= 3000) AS merged_units, count(*) FILTER (WHERE chars > 3000) AS oversized_units FROM g GROUP BY 1")
def q_folded_units(spark: SparkSession, d: str) -> DataFrame:
    units = st.folded_units(clauses(spark, d), 500)
    return units.groupBy("document_id").agg(F.count_if((F.col("parts") == 1) & (F.col("chars") <= 3000)).alias("single_units"), F.count_if((F.col("parts") > 1) & (F.col("chars") <= 3000)).alias("merged_units"), F.count_if(F.col("chars") > 3000).alias("oversized_units"))


@_query()
def q_approximate_topk(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings")
    return ap.search(own, "vec_id", "embedding", own.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)


@_query(f"WITH {_WHOLE}, r AS (SELECT question, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS rank FROM x) SELECT count(*) AS of_neighbours, true AS enough FROM r WHERE rank <= 10")
def q_approximate_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index finds nine tenths of the exact ten nearest."""
    exact = _near(spark, d, 10).select("question", "vec_id")
    found = q_approximate_topk(spark, d).select("question", "vec_id", F.lit(1).alias("hit"))
    each = exact.join(found, ["question", "vec_id"], "left")
    return each.agg(F.count("*").alias("of_neighbours"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


@_query(f"WITH {_BM25_EVERY}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, clause_id) AS n FROM b), z AS (SELECT r.question, r.clause_id, r.n, len(list_intersect(list_distinct({TOKENS.format('q.asked')}), list_distinct({TOKENS.format('c.title')}))) AS shared FROM r JOIN q USING (question) JOIN c USING (clause_id) WHERE n <= 10), o AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY shared DESC, n) AS rank FROM z) SELECT question, clause_id, shared, rank FROM o")
def q_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best rescored by words shared with the title; ties keep the order they had."""
    asked = every_question(spark, d)
    top = _top(spark, d, asked).withColumnRenamed("rank", "n")
    said = clauses(spark, d).select("clause_id", "title")
    both = top.join(said, "clause_id").join(asked.select("question", "asked"), "question")
    shared = F.size(F.array_intersect(F.array_distinct(tx.tokens("asked")), F.array_distinct(tx.tokens("title"))))
    w = Window.partitionBy("question").orderBy(F.desc("shared"), "n")
    return both.withColumn("shared", shared).withColumn("rank", F.row_number().over(w)).select("question", "clause_id", "shared", "rank")


@_query()
def q_text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the compatibility form or the layout rules change, by source."""
    own = table(spark, d, "documents").where("text is not null")
    changed = own.select("source", (ar.compatible("text") != F.col("text")).alias("form"), (tx.normalize_layout("text") != F.col("text")).alias("layout"), (F.length(ar.letters_only("text")) < F.length("text")).alias("beyond_ascii"))
    return changed.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("form").alias("form_changes"), F.count_if("layout").alias("layout_changes"), F.count_if("beyond_ascii").alias("beyond_ascii"))


@_query("SELECT coalesce(lower(trim(lang)), 'none') AS lang, count(*) AS documents, count(*) FILTER (WHERE n_chars IS DISTINCT FROM length(text)) AS wrong_lengths, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS blank FROM documents GROUP BY 1")
def q_document_audit(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents")
    return own.groupBy(F.coalesce(F.lower(F.trim("lang")), F.lit("none")).alias("lang")).agg(F.count("*").alias("documents"), F.count_if(~F.col("n_chars").eqNullSafe(F.char_length("text"))).alias("wrong_lengths"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))


@_query("WITH d AS (SELECT DISTINCT text, doc_id, source FROM documents WHERE length(trim(text)) >= 30) SELECT substr(sha256(text), 1, 16) AS key, count(*) AS copies, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM d GROUP BY text HAVING count(*) > 1")
def q_equal_documents(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").where(F.char_length(F.trim("text")) >= 30).select(F.sha2("text", 256).alias("h"), "doc_id", "source")
    return own.groupBy("h").agg(F.count("*").alias("copies"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_id")).where("copies > 1").select(F.substring("h", 1, 16).alias("key"), "copies", "sources", "first_id")


@_query()
def q_stems(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the corpus under their folded stems; each distinct term is stemmed once."""
    found = rt.postings(_corpus(spark, d), "clause_id", "body").groupBy("term").agg(F.count("*").alias("df"))
    return stem_terms(found, "term").groupBy(tx.fold("stem").alias("stem")).agg(F.count("*").alias("terms"), F.max("df").alias("most_df"))
