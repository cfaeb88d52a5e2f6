"""Queries on filters, links, rankings with reserved places, chunks and clauses put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.operators import chunks as ch
from clausemill.operators import links as lk
from clausemill.operators import retrieval as rt
from clausemill.plans import catalogue as base
from clausemill.plans.catalogue import _FILTERED, CLAUSES, QUESTIONS, TOKENS, _query, clauses, questions
from clausemill.sources.tables import table

_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """Clauses with the process by its digits, as filters compare it."""
    return clauses(spark, d).withColumn("susep_process", F.regexp_replace("susep_process", "[^0-9]", ""))


def _nothing(*names: str) -> list:
    return [F.lit(None).cast("string").alias(n) for n in names]


# ---- filters ---------------------------------------------------------------------------------------------------


@_query(f"WITH {CLAUSES}, {QUESTIONS}, m AS (SELECT DISTINCT id, {_DIGITS.format('susep_process')} AS process, cnpj FROM manifest) SELECT q.question, count(*) AS admitted, count(CASE WHEN c.document_id <> q.document_id THEN 1 END) AS of_other_filings FROM (SELECT DISTINCT question, document_id FROM q) q JOIN m ON m.id = q.document_id JOIN c ON {_DIGITS.format('c.susep_process')} = m.process AND c.cnpj = m.cnpj GROUP BY 1")
def q_filter_default(spark: SparkSession, d: str) -> DataFrame:
    """Each question's filter by the process and firm of its filing."""
    filings = table(spark, d, "manifest").select(F.col("id").alias("document_id"), F.regexp_replace("susep_process", "[^0-9]", "").alias("susep_process"), "cnpj").distinct()
    filters = questions(spark, d).select("question", "document_id").distinct().join(filings, "document_id").select("question", F.col("document_id").alias("own"), "susep_process", "cnpj", *_nothing("product_line", "clause_type", "bundle_section"))
    own = _keyed(spark, d)
    hits = lk.admitted(filters, own, "question").join(own.select("clause_id", "document_id"), "clause_id").join(filters.select("question", "own"), "question")
    return hits.groupBy("question").agg(F.count("*").alias("admitted"), F.count_if(F.col("document_id") != F.col("own")).alias("of_other_filings"))


@_query(f"WITH {CLAUSES}, p AS (SELECT DISTINCT {_DIGITS.format('policy_ref')} AS process FROM claim WHERE length({_DIGITS.format('policy_ref')}) = 17) SELECT p.process, count(c.clause_id) AS admitted FROM p LEFT JOIN c ON {_DIGITS.format('c.susep_process')} = p.process GROUP BY 1")
def q_filter_policy(spark: SparkSession, d: str) -> DataFrame:
    """An explicit process filters alone."""
    process = F.regexp_replace("policy_ref", "[^0-9]", "")
    asked = table(spark, d, "claim").select(process.alias("process")).where("length(process) = 17").distinct()
    filters = asked.select("process", F.col("process").alias("susep_process"), *_nothing("cnpj", "product_line", "clause_type", "bundle_section"))
    hits = lk.admitted(filters, _keyed(spark, d), "process").groupBy("process").count()
    return asked.join(hits, "process", "left").select("process", F.coalesce("count", F.lit(0)).alias("admitted"))


_BUNDLES = f"WITH {CLAUSES}, f AS (SELECT DISTINCT clause_type, bundle_section FROM c WHERE bundle_section IS NOT NULL) SELECT f.clause_type, f.bundle_section, count(*) AS lenient, count(CASE WHEN c.bundle_section = f.bundle_section THEN 1 END) AS strict FROM f JOIN c ON c.clause_type = f.clause_type AND (c.bundle_section = f.bundle_section OR c.bundle_section IS NULL) GROUP BY 1, 2"


@_query(_BUNDLES)
def q_filter_bundle(spark: SparkSession, d: str) -> DataFrame:
    """What a filter on type and section admits, with and without rows of unknown section."""
    own = _keyed(spark, d)
    kinds = own.where("bundle_section is not null").select("clause_type", "bundle_section").distinct()
    filters = kinds.select(F.concat_ws("|", "clause_type", "bundle_section").alias("f_id"), *_nothing("susep_process", "cnpj", "product_line"), "clause_type", "bundle_section")
    count = lambda strict, name: lk.admitted(filters, own, "f_id", strict).groupBy("f_id").agg(F.count("*").alias(name))
    both = filters.select("f_id", "clause_type", "bundle_section").join(count(False, "lenient"), "f_id").join(count(True, "strict"), "f_id")
    return both.select("clause_type", "bundle_section", "lenient", "strict")


# ---- links and reserved places ---------------------------------------------------------------------------------

_TREE = f"{CLAUSES}, up AS (SELECT a.clause_id, b.clause_id AS ancestor_id, len(string_split(a.path, '/')) - len(string_split(b.path, '/')) AS distance FROM c a JOIN c b ON a.document_id = b.document_id AND starts_with(a.path, b.path || '/')), tr AS (SELECT c.clause_id, [c.clause_id] || coalesce(list(ancestor_id ORDER BY distance) FILTER (WHERE ancestor_id IS NOT NULL), []) AS chain FROM c LEFT JOIN up USING (clause_id) GROUP BY c.clause_id)"
_LINKS = (
    f"{_TREE}, cv AS (SELECT c.*, tr.chain, {base._REFS} AS refs FROM c JOIN tr USING (clause_id) WHERE clause_type = 'coverage'), ex AS (SELECT c.*, tr.chain, regexp_extract(title, '^([0-9]+(?:\\.[0-9]+)*)', 1) AS number FROM c JOIN tr USING (clause_id) WHERE clause_type = 'exclusion'), "
    "j AS (SELECT a.clause_id AS source_id, b.clause_id AS target_id, greatest(0, greatest(a.page_start, b.page_start) - least(a.page_end, b.page_end)) AS gap, list_contains(a.refs, b.number) AS named, a.chain[-1] = b.chain[-1] AS same, a.chain AS ac, b.chain AS bc FROM cv a JOIN ex b ON a.document_id = b.document_id AND (a.bundle_section IS NULL OR b.bundle_section IS NULL OR a.bundle_section = b.bundle_section)), "
    "l AS (SELECT source_id, target_id, gap, CASE WHEN named THEN 0 WHEN same THEN 1 WHEN gap <= 1 THEN 2 END AS edge, CASE WHEN NOT named AND same THEN list_position(ac, list_filter(ac, lambda x: list_contains(bc, x))[1]) + list_position(bc, list_filter(ac, lambda x: list_contains(bc, x))[1]) - 2 ELSE 0 END AS tree_distance FROM j)"
)


@_query(f"WITH {_TREE} SELECT clause_id, chain[-1] AS section_id, len(chain) AS depth FROM tr")
def q_sections(spark: SparkSession, d: str) -> DataFrame:
    return lk.sections(clauses(spark, d)).select("clause_id", "section_id", F.size("chain").alias("depth"))


@_query(f"WITH {_LINKS} SELECT source_id, target_id, edge, tree_distance, gap FROM l WHERE edge IS NOT NULL")
def q_section_links(spark: SparkSession, d: str) -> DataFrame:
    return lk.section_links(clauses(spark, d), "coverage", "exclusion")


_STACK = (
    f"WITH {_LINKS}, {_FILTERED.replace(CLAUSES + ', ', '', 1)}, r AS (SELECT question, clause_id, row_number() OVER (PARTITION BY question ORDER BY score DESC, clause_id) AS rank FROM g), "
    "y AS (SELECT r.*, c.clause_type, c.clause_type IN ('coverage', 'exclusion') AS kept FROM r JOIN c USING (clause_id) WHERE rank <= 5), z AS (SELECT *, CASE WHEN NOT kept THEN row_number() OVER (PARTITION BY question, kept ORDER BY rank DESC) END AS last FROM y), "
    "room AS (SELECT question, 5 - count(*) AS free, count(last) AS movable FROM z GROUP BY 1), o AS (SELECT z.question, l.target_id, min((l.edge, l.tree_distance, l.gap)) AS best FROM z JOIN l ON l.source_id = z.clause_id WHERE l.edge IS NOT NULL GROUP BY 1, 2), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY best, target_id) AS place FROM o WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.question = o.question AND z.clause_id = o.target_id)), w AS (SELECT question, count(*) AS wanted FROM n WHERE place <= 2 GROUP BY 1), "
    "pl AS (SELECT question, free, least(greatest(coalesce(wanted, 0) - free, 0), movable) AS gone, coalesce(wanted, 0) AS wanted FROM room LEFT JOIN w USING (question)), "
    "u AS (SELECT z.question, z.clause_id, 0 AS part, z.rank AS place FROM z JOIN pl USING (question) WHERE z.last IS NULL OR z.last > pl.gone UNION ALL SELECT n.question, n.target_id, 1, n.place FROM n JOIN pl USING (question) WHERE n.place <= least(pl.wanted, pl.free + pl.gone) AND n.place <= 2) "
    "SELECT question, clause_id, row_number() OVER (PARTITION BY question ORDER BY part, place) AS rank FROM u"
)


@_query(_STACK)
def q_full_stack(spark: SparkSession, d: str) -> DataFrame:
    """Five clauses for each question from its own filing, up to two places for exclusions of the coverages found."""
    own = clauses(spark, d)
    ranked = rt.best(base._filtered(spark, d), "question", "clause_id", "score", 5)
    return lk.reserve(ranked, own, lk.section_links(own, "coverage", "exclusion"), "question", 5, 2, "coverage", "exclusion")


_DOCS = f"k AS (SELECT d.doc_id, {TOKENS.format('coalesce(d.text, ' + chr(39) * 2 + ')')} AS words, e.embedding::DOUBLE[] AS v FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"


@_query(
    f"WITH {_DOCS}, a AS (SELECT DISTINCT doc_id AS question, unnest(words) AS term FROM k WHERE doc_id % 20 = 0), s AS (SELECT count(*) AS n, avg(len(words)) AS avg_len FROM k), p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS len, unnest(words) AS term FROM k) WHERE term IN (SELECT term FROM a) GROUP BY 1, 2, 3), "
    "i AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, s GROUP BY term, n), b AS (SELECT a.question, p.doc_id, round(sum(i.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.len / s.avg_len))), 6) AS score FROM a JOIN p USING (term) JOIN i USING (term), s GROUP BY 1, 2), "
    "l1 AS (SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM b), x AS (SELECT a.doc_id AS question, b.doc_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM k a, k b WHERE a.doc_id % 20 = 0), l2 AS (SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM x), "
    "f AS (SELECT question, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM l1 WHERE rank <= 100 UNION ALL SELECT * FROM l2 WHERE rank <= 100) GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM f) SELECT question, doc_id, rank FROM z WHERE rank <= 10"
)
def q_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have a vector: a lexical and a vector leg of depth 100 for each twentieth one, fused by rank."""
    both = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    corpus = both.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    asked = corpus.where("doc_id % 20 = 0").select(F.col("doc_id").alias("question"), F.col("body").alias("asked"))
    words = rt.bm25(corpus, "doc_id", "body", asked, "question", "asked").withColumn("score", F.round("score", 6))
    near = rt.nearest(both, "doc_id", "embedding", both.where("doc_id % 20 = 0"), "doc_id", "embedding", 100)
    return rt.reciprocal_rank_fusion([rt.best(words, "question", "doc_id", "score", 100), near], "question", "doc_id", 10).select("question", "doc_id", "rank")


@_query(f"WITH {base._WHOLE}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS rank FROM x WHERE label = asked_label) SELECT question, vec_id, rank FROM r WHERE rank <= 10")
def q_vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of the question's own label; the filter applies before the ranking."""
    own = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return rt.nearest(own, "vec_id", "embedding", own.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, same="label").select("question", "vec_id", "rank")


# ---- chunks ----------------------------------------------------------------------------------------------------

_CHUNKS = (
    f"{CLAUSES}, s AS (SELECT clause_id, document_id, parent_id, title, text, page_start, path, length(coalesce(text, '')) < 400 AS short FROM c), p AS (SELECT s.*, CASE WHEN s.short AND b.short = false THEN s.parent_id ELSE s.clause_id END AS anchor FROM s LEFT JOIN s b ON b.clause_id = s.parent_id), "
    "y AS (SELECT *, CASE WHEN clause_id = anchor THEN coalesce(text, '') ELSE concat_ws(chr(10), title, nullif(text, '')) END AS body FROM p), "
    "crumb AS (SELECT a.clause_id, string_agg(b.title, ' > ' ORDER BY length(b.path)) AS parent_path FROM c a JOIN c b ON a.document_id = b.document_id AND starts_with(a.path, b.path || '/') GROUP BY 1), "
    "u AS (SELECT document_id, anchor, list(clause_id ORDER BY clause_id <> anchor, page_start, clause_id) AS sources, coalesce(string_agg(body, chr(10) ORDER BY clause_id <> anchor, page_start, clause_id) FILTER (WHERE body <> ''), '') AS bodies, max(CASE WHEN clause_id = anchor THEN title END) AS title FROM y GROUP BY 1, 2), "
    "h AS (SELECT u.*, coalesce(parent_path, '') AS parent_path, concat_ws(chr(10), parent_path, title) AS header FROM u LEFT JOIN crumb ON crumb.clause_id = u.anchor), "
    "k AS (SELECT anchor AS chunk_id, document_id, sources, parent_path, CASE WHEN bodies = '' THEN header ELSE header || chr(10) || chr(10) || bodies END AS text FROM h), "
    "w AS (SELECT *, length(text)::INT AS char_count, CASE WHEN length(text) > 3000 THEN 'oversized' WHEN len(sources) > 1 THEN 'merged' ELSE 'single' END AS rule FROM k)"
)


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return ch.chunks(clauses(spark, d), 400, 3000)


@_query(f"WITH {_CHUNKS} SELECT chunk_id, array_to_string(sources, ';') AS source_clause_ids, parent_path, char_count, rule, md5(text) AS text_md5 FROM w")
def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).select("chunk_id", F.array_join("source_clause_ids", ";").alias("source_clause_ids"), "parent_path", "char_count", "rule", F.md5("text").alias("text_md5"))


@_query(f"WITH {_CHUNKS} SELECT document_id, count(*) AS chunk_count, count(CASE WHEN rule = 'single' THEN 1 END) AS single_count, count(CASE WHEN rule = 'merged' THEN 1 END) AS merged_count, count(CASE WHEN rule = 'oversized' THEN 1 END) AS oversized_count, min(char_count) AS min_char_count, {base._rank_sql('char_count', 0.5)} AS p50_char_count, {base._rank_sql('char_count', 0.9)} AS p90_char_count, max(char_count) AS max_char_count FROM w GROUP BY 1")
def q_chunk_report(spark: SparkSession, d: str) -> DataFrame:
    own = _chunked(spark, d)
    ranks = rt.nearest_ranks(own, "document_id", "char_count", {"p50_char_count": 0.5, "p90_char_count": 0.9})
    count = lambda rule: F.count_if(F.col("rule") == rule).alias(f"{rule}_count")
    sums = own.groupBy("document_id").agg(F.count("*").alias("chunk_count"), count("single"), count("merged"), count("oversized"), F.min("char_count").alias("min_char_count"), F.max("char_count").alias("max_char_count"))
    return sums.join(ranks, "document_id")


@_query(f"WITH {_CHUNKS}, {QUESTIONS}, r AS (SELECT DISTINCT question, trim(unnest(string_split(reference_clause_ids, ';'))) AS clause_id, unnest(range(len(string_split(reference_clause_ids, ';')))) AS i FROM q), v AS (SELECT unnest(sources) AS clause_id, chunk_id, CASE WHEN parent_path <> '' AND starts_with(text, parent_path || chr(10)) THEN text[length(parent_path) + 2:] ELSE text END AS shown FROM w), g AS (SELECT clause_id, string_agg(shown, chr(10) ORDER BY chunk_id) AS text FROM v GROUP BY 1) SELECT question, clause_id, row_number() OVER (PARTITION BY question ORDER BY i) AS place, md5(text) AS text_md5 FROM r JOIN g USING (clause_id)")
def q_hydrate(spark: SparkSession, d: str) -> DataFrame:
    """The clauses each question refers to, in the order given, from their chunks."""
    wanted = questions(spark, d).select("question", F.posexplode(F.split("reference_clause_ids", ";")).alias("i", "clause_id")).select("question", "i", F.trim("clause_id").alias("clause_id")).distinct()
    return ch.hydrated(wanted, _chunked(spark, d), "question", "i").select("question", "clause_id", "place", F.md5("text").alias("text_md5"))
