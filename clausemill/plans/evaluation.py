"""Queries on evaluation groups, logs, caches, partitions, numbering and text that is searched by pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.functions import numbers as nm
from clausemill.functions import text as tx
from clausemill.operators import retrieval as rt
from clausemill.operators import structure as st
from clausemill.operators import tables as tb
from clausemill.plans import catalogue as base
from clausemill.plans.catalogue import _FILTERED, CLAUSES, FILINGS, QUESTIONS, _query, clauses, filings, questions
from clausemill.sources.tables import table

_DRAFTS = "d AS (SELECT DISTINCT * FROM product_claim_mismatch_draft)"


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_claim_mismatch_draft").distinct()


# ---- evaluation groups -----------------------------------------------------------------------------------------

_HITS = f"{_FILTERED}, r AS (SELECT question, clause_id, row_number() OVER (PARTITION BY question ORDER BY score DESC, clause_id) AS rank FROM g), t AS (SELECT DISTINCT question, product_line, document_id, trim(unnest(string_split(reference_clause_ids, ';'))) AS clause_id FROM q), h AS (SELECT t.*, coalesce(r.rank <= 10, false) AS hit FROM t LEFT JOIN r USING (question, clause_id) WHERE t.clause_id <> '')"


def _reference_hits(spark: SparkSession, d: str) -> DataFrame:
    """(question, product_line, document_id, clause_id, hit): each reference, and whether the first ten hold it."""
    asked = questions(spark, d)
    refs = asked.select("question", "product_line", "document_id", F.explode(F.split("reference_clause_ids", ";")).alias("clause_id")).withColumn("clause_id", F.trim("clause_id")).where("clause_id <> ''").distinct()
    top = rt.best(base._filtered(spark, d), "question", "clause_id", "score", 10).select("question", "clause_id", F.lit(True).alias("found"))
    return refs.join(top, ["question", "clause_id"], "left").withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")


@_query(f"WITH {_HITS}, {FILINGS}, x AS (SELECT h.*, f.extraction_mode FROM h LEFT JOIN f ON f.id = h.document_id) SELECT product_line, extraction_mode, count(*) AS total, count(CASE WHEN hit THEN 1 END) AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS micro_recall FROM x GROUP BY GROUPING SETS ((product_line), (extraction_mode), ())")
def q_micro_recall(spark: SparkSession, d: str) -> DataFrame:
    """Hits over all references, as a whole, by product line and by the filing's extraction mode."""
    own = _reference_hits(spark, d).join(filings(spark, d).select(F.col("id").alias("document_id"), "extraction_mode"), "document_id", "left")
    measure = (F.count("*").alias("total"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("micro_recall"))
    return own.groupingSets([["product_line"], ["extraction_mode"], []], "product_line", "extraction_mode").agg(*measure)


@_query(f"WITH {_HITS}, e AS (SELECT question, product_line, bool_and(hit) AS every, bool_or(hit) AS one FROM h GROUP BY 1, 2) SELECT product_line, count(*) AS questions, round(avg(CASE WHEN every THEN 1.0 ELSE 0.0 END), 6) AS all_found, round(avg(CASE WHEN one THEN 1.0 ELSE 0.0 END), 6) AS any_found FROM e GROUP BY 1")
def q_found_rates(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose references are all found, and those with any found."""
    each = _reference_hits(spark, d).groupBy("question", "product_line").agg(F.bool_and("hit").alias("every"), F.bool_or("hit").alias("some"))
    share = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 6).alias(name)
    return each.groupBy("product_line").agg(F.count("*").alias("questions"), share("every", "all_found"), share("some", "any_found"))


@_query(f"WITH {_DRAFTS}, x AS (SELECT DISTINCT row_id, trim(unnest(string_split(pii_flag, ';'))) AS label FROM d) SELECT label, count(*) AS drafts, row_number() OVER (ORDER BY count(*) DESC, label) AS place FROM x WHERE label <> '' GROUP BY 1")
def q_label_histogram(spark: SparkSession, d: str) -> DataFrame:
    own = _drafts(spark, d).select("row_id", F.explode(F.split("pii_flag", ";")).alias("label")).select("row_id", F.trim("label").alias("label")).where("label <> ''").distinct()
    counts = own.groupBy("label").agg(F.count("*").alias("drafts"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("drafts"), "label")))  # a row for each label


@_query(f"WITH {_DRAFTS} SELECT expected_verdict, coalesce(nullif(trim(review_verdict), ''), 'null') AS reviewed, count(*) AS drafts, count(CASE WHEN trim(review_verdict) = expected_verdict THEN 1 END) AS agreed FROM d GROUP BY 1, 2")
def q_null_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Expected against reviewed verdicts, a missing review in a column of its own."""
    said = F.trim("review_verdict")
    return _drafts(spark, d).groupBy("expected_verdict", F.coalesce(F.nullif(said, F.lit("")), F.lit("null")).alias("reviewed")).agg(F.count("*").alias("drafts"), F.count_if(said == F.col("expected_verdict")).alias("agreed"))


_OPTIONAL = ("reference_clause_texts", "selection_notes", "draft_notes", "pii_flag", "authored_at", "review_verdict")


@_query(f"WITH {_DRAFTS} SELECT expected_verdict, " + ", ".join(f"round(avg(CASE WHEN {c} IS NULL OR {c} = '' THEN 1.0 ELSE 0.0 END), 6) AS no_{c}" for c in _OPTIONAL) + " FROM d GROUP BY GROUPING SETS ((expected_verdict), ())")
def q_null_shares(spark: SparkSession, d: str) -> DataFrame:
    share = [F.round(F.avg((F.col(c).isNull() | (F.col(c) == "")).cast("double")), 6).alias(f"no_{c}") for c in _OPTIONAL]
    return _drafts(spark, d).rollup("expected_verdict").agg(*share)


@_query(f"WITH {CLAUSES} SELECT type_source, clause_type, count(confidence) AS n, coalesce(round(min(confidence), 3), 0) AS least, coalesce(round(avg(confidence), 6), 0) AS mean, coalesce(round(max(confidence), 3), 0) AS most FROM c GROUP BY 1, 2")
def q_confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rounded figures by group, zeros where a group has no value."""
    c = F.col("confidence")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return clauses(spark, d).groupBy("type_source", "clause_type").agg(F.count(c).alias("n"), zero(F.round(F.min(c), 3)).alias("least"), zero(F.round(F.avg(c), 6)).alias("mean"), zero(F.round(F.max(c), 3)).alias("most"))


# ---- tables: caches, logs, batches, partitions -----------------------------------------------------------------


@_query("WITH held AS (SELECT DISTINCT sha256(narrative) AS key FROM product_claim_mismatch), asked AS (SELECT sha256(narrative) AS key, count(*) AS n FROM product_claim_mismatch_draft WHERE narrative IS NOT NULL GROUP BY 1) SELECT CAST(coalesce(sum(CASE WHEN held.key IS NOT NULL THEN n END), 0) AS BIGINT) AS hits, CAST(coalesce(sum(CASE WHEN held.key IS NULL THEN n END), 0) AS BIGINT) AS misses, count(CASE WHEN held.key IS NULL THEN 1 END) AS fills, (SELECT count(*) FROM held) AS held_before FROM asked LEFT JOIN held USING (key)")
def q_cache_fill(spark: SparkSession, d: str) -> DataFrame:
    """A cache keyed by content: requests it answers, requests it does not, and entries they add, each once."""
    held = table(spark, d, "product_claim_mismatch").select(F.sha2("narrative", 256).alias("key")).where("key is not null").distinct()
    return tb.cache_report(table(spark, d, "product_claim_mismatch_draft").select(F.sha2("narrative", 256).alias("key")), held, "key")


_LOG = "o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events WHERE event_id % 3 <> 0), n AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_id % 3 = 0), t AS (SELECT user_id, max(sequence) AS top FROM o GROUP BY 1)"


@_query(f"WITH {_LOG} SELECT n.user_id, n.event_id, coalesce(t.top, -1) + k AS sequence FROM n LEFT JOIN t USING (user_id)")
def q_append_log(spark: SparkSession, d: str) -> DataFrame:
    """Every third event appended to the log of the others: its place in its user's sequence."""
    every = table(spark, d, "events").select("user_id", "event_id", "ts")
    old = every.where("event_id % 3 <> 0").withColumn("sequence", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return tb.append_sequence(old, every.where("event_id % 3 = 0"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "sequence")


@_query("WITH r AS (SELECT document_id, clause_id, row_number() OVER (PARTITION BY document_id ORDER BY clause_id) - 1 AS k FROM (SELECT DISTINCT document_id, clause_id FROM parsed_clause)) SELECT document_id, k // 8 AS batch, count(*) AS members, min(clause_id) AS first_id FROM r GROUP BY 1, 2")
def q_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of eight clauses in the order of their ids, filing by filing."""
    w = Window.partitionBy("document_id").orderBy("clause_id")
    own = clauses(spark, d).select("document_id", "clause_id").withColumn("batch", F.floor((F.row_number().over(w) - 1) / 8))
    return own.groupBy("document_id", "batch").agg(F.count("*").alias("members"), F.min("clause_id").alias("first_id"))


@_query(f"WITH {CLAUSES}, p AS (SELECT regexp_replace(susep_process, '[^0-9]', '', 'g') AS process, cnpj, count(*) AS n FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY n, process, cnpj) AS k, count(*) OVER () AS parts FROM p) SELECT 'smallest' AS probe, process, cnpj, n FROM r WHERE k = 1 UNION ALL SELECT 'median', process, cnpj, n FROM r WHERE k = parts // 2 + 1 UNION ALL SELECT 'largest_under_10', process, cnpj, n FROM (SELECT * FROM p WHERE n < 10 ORDER BY n DESC, process, cnpj LIMIT 1)")
def q_partition_probes(spark: SparkSession, d: str) -> DataFrame:
    """The smallest and the median partition by process and firm, and the largest of fewer than ten clauses.

    Partitions are counted by size first, so that the ordered window holds a row for each different size.
    """
    parts = clauses(spark, d).groupBy(F.regexp_replace("susep_process", "[^0-9]", "").alias("process"), "cnpj").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("n").agg(F.count("*").alias("many"))
    placed = sizes.select("n", "many", F.sum("many").over(Window.orderBy("n")).alias("upto")).crossJoin(F.broadcast(sizes.agg(F.sum("many").alias("parts"))))  # a row for each size, one row
    middle = placed.where("upto > parts div 2").agg(F.min(F.struct("n", (F.expr("parts div 2") - F.col("upto") + F.col("many")).alias("skip"))).alias("m")).select("m.n", "m.skip")
    within = parts.join(F.broadcast(middle), "n").withColumn("k", F.row_number().over(Window.orderBy("process", "cnpj")) - 1).where("k = skip")
    pick = lambda rows, name: rows.agg(F.min(F.struct("by", "process", "cnpj", "n")).alias("m")).where("m is not null").select(F.lit(name).alias("probe"), "m.process", "m.cnpj", "m.n")
    small, under = parts.withColumn("by", F.col("n")), parts.where("n < 10").withColumn("by", -F.col("n"))
    return pick(small, "smallest").unionByName(within.select(F.lit("median").alias("probe"), "process", "cnpj", "n")).unionByName(pick(under, "largest_under_10"))


@_query("WITH m AS (SELECT DISTINCT id, regexp_replace(susep_process, '[^0-9]', '', 'g') AS process, nullif(trim(susep_subramo), '') AS subramo, nullif(trim(source_url), '') AS url, process_year FROM manifest), o AS (SELECT *, last_value(subramo IGNORE NULLS) OVER w AS kept_subramo, last_value(url IGNORE NULLS) OVER w AS kept_url, row_number() OVER (PARTITION BY process ORDER BY process_year DESC, id DESC, subramo DESC NULLS FIRST, url DESC NULLS FIRST) AS back FROM m WINDOW w AS (PARTITION BY process ORDER BY process_year, id, subramo NULLS LAST, url NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT process, kept_subramo, kept_url FROM o WHERE back = 1")
def q_field_merge(spark: SparkSession, d: str) -> DataFrame:
    """Of each process the latest value of every field, an earlier one where the latest filing has none."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = table(spark, d, "manifest").select("id", F.regexp_replace("susep_process", "[^0-9]", "").alias("process"), blank("susep_subramo").alias("subramo"), blank("source_url").alias("url"), "process_year").distinct()
    at = lambda c: F.max_by(c, F.struct("process_year", "id", c)).alias(f"kept_{c}")
    merged = [own.where(F.col(c).isNotNull()).groupBy("process").agg(at(c)) for c in ("subramo", "url")]
    return own.select("process").distinct().join(merged[0], "process", "left").join(merged[1], "process", "left")


@_query("SELECT id, filename, filename = regexp_replace(susep_process, '[^0-9]', '', 'g') || '-' || id || '.pdf' AS fits FROM (SELECT DISTINCT id, filename, susep_process FROM manifest)")
def q_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Whether a filing's file is named after its process and id."""
    own = table(spark, d, "manifest").select("id", "filename", "susep_process").distinct()
    return own.select("id", "filename", (F.col("filename") == F.concat(F.regexp_replace("susep_process", "[^0-9]", ""), F.lit("-"), "id", F.lit(".pdf"))).alias("fits"))


@_query("WITH x AS (SELECT DISTINCT cnpj, lpad(regexp_replace(cnpj, '[^0-9]', '', 'g'), 14, '0') AS d FROM manifest WHERE length(regexp_replace(cnpj, '[^0-9]', '', 'g')) IN (13, 14)) SELECT cnpj, d[1:2] || '.' || d[3:5] || '.' || d[6:8] || '/' || d[9:12] || '-' || d[13:14] AS punctuated FROM x")
def q_cnpj_punctuated(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "manifest").select("cnpj").distinct()
    return own.select("cnpj", nm.cnpj_formatted("cnpj").alias("punctuated")).where("punctuated is not null")


@_query(f"WITH {CLAUSES} SELECT cnpj, count(DISTINCT upper(trim(insurer))) AS spellings, count(DISTINCT product_line) AS lines FROM c GROUP BY 1 HAVING count(DISTINCT upper(trim(insurer))) > 0")
def q_dependency_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a firm's number determines its name once case and blanks are set aside."""
    return clauses(spark, d).groupBy("cnpj").agg(F.countDistinct(F.upper(F.trim("insurer"))).alias("spellings"), F.countDistinct("product_line").alias("lines")).where("spellings > 0")


@_query("WITH d AS (SELECT DISTINCT row_id FROM product_claim_mismatch_draft) SELECT split_part(row_id, '-', 1) AS series, count(*) AS rows_held, max(CAST(split_part(row_id, '-', 2) AS BIGINT)) + 1 AS next_number FROM d GROUP BY 1")
def q_next_ids(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "product_claim_mismatch_draft").select("row_id").distinct()
    return own.groupBy(F.split_part("row_id", F.lit("-"), F.lit(1)).alias("series")).agg(F.count("*").alias("rows_held"), (F.max(F.split_part("row_id", F.lit("-"), F.lit(2)).cast("bigint")) + 1).alias("next_number"))


# ---- pages, numbering, boilerplate -----------------------------------------------------------------------------


@_query(f"WITH {CLAUSES}, {FILINGS} SELECT c.clause_id, greatest(1, c.page_start - 2) AS from_page, least(coalesce(f.pages, c.page_end + 2), c.page_end + 2) AS to_page FROM c LEFT JOIN f ON f.id = c.document_id")
def q_page_window(spark: SparkSession, d: str) -> DataFrame:
    """The clause's pages with a margin of two, inside the filing."""
    pages = filings(spark, d).select(F.col("id").alias("document_id"), "pages")
    last = F.col("page_end") + 2
    return clauses(spark, d).join(pages, "document_id", "left").select("clause_id", F.greatest(F.lit(1), F.col("page_start") - 2).alias("from_page"), F.least(F.coalesce("pages", last), last).alias("to_page"))


@_query(f"WITH {CLAUSES}, p AS (SELECT document_id, page_start, sum(length(text)) AS chars FROM c GROUP BY 1, 2), s AS (SELECT document_id, count(*) AS pages, avg(chars) AS mean, avg(CASE WHEN chars < 400 THEN 1.0 ELSE 0.0 END) AS low FROM p GROUP BY 1) SELECT document_id, pages, round(mean, 6) AS mean_chars, round(low, 6) AS low_share, CASE WHEN mean < 200 THEN 'ocr_required' WHEN low > 0.10 THEN 'partial' ELSE 'text' END AS layer FROM s")
def q_text_layer(spark: SparkSession, d: str) -> DataFrame:
    """What a filing's pages say of its text layer: too little text, some poor pages, or text."""
    pages = clauses(spark, d).groupBy("document_id", "page_start").agg(F.sum(F.char_length("text")).alias("chars"))
    each = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.avg("chars").alias("mean"), F.avg((F.col("chars") < 400).cast("double")).alias("low"))
    layer = F.when(F.col("mean") < 200, "ocr_required").when(F.col("low") > 0.10, "partial").otherwise("text")
    return each.select("document_id", "pages", F.round("mean", 6).alias("mean_chars"), F.round("low", 6).alias("low_share"), layer.alias("layer"))


_NUMBERED = f"{CLAUSES}, h AS (SELECT clause_id, document_id, page_start, regexp_extract(title, '^([0-9]+(?:\\.[0-9]+)*)', 1) AS label FROM c), n AS (SELECT clause_id, document_id, label, lead(label) OVER w AS next_label, lag(label) OVER w AS before_label FROM h WHERE label <> '' WINDOW w AS (PARTITION BY document_id ORDER BY page_start, clause_id))"


@_query(f"WITH {_NUMBERED} SELECT clause_id, label, coalesce(next_label = '1', false) AS restarts_next, coalesce(label = CASE WHEN before_label LIKE '%.%' THEN regexp_extract(before_label, '^(.*)\\.[0-9]+$', 1) || '.' ELSE '' END || CAST(CAST(regexp_extract(before_label, '([0-9]+)$', 1) AS BIGINT) + 1 AS VARCHAR), false) AS follows FROM n")
def q_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Whether a heading's number follows the one before, and whether numbering starts again after it."""
    w = st.document_order()
    own = clauses(spark, d).withColumn("label", F.regexp_extract("title", r"^([0-9]+(?:\.[0-9]+)*)", 1)).where("label <> ''")
    own = own.withColumn("next_label", F.lead("label").over(w)).withColumn("before_label", F.lag("label").over(w))
    return own.select("clause_id", "label", F.coalesce(F.col("next_label") == "1", F.lit(False)).alias("restarts_next"), F.coalesce(F.col("label") == tx.next_label("before_label"), F.lit(False)).alias("follows"))


_SLUG = "regexp_replace(regexp_replace(" + base.FOLD.format("regexp_replace(title, '^[0-9.]+\\s*', '')") + ", '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@_query(f"WITH {CLAUSES}, s AS (SELECT document_id, {_SLUG} AS slug, count(*) AS times, count(CASE WHEN regexp_extract(title, '^([0-9]+)', 1) = '1' THEN 1 END) AS firsts FROM c WHERE parent_id IS NULL GROUP BY 1, 2) SELECT document_id, slug, times, firsts = times AS all_restart FROM s WHERE times > 1")
def q_repeated_titles(spark: SparkSession, d: str) -> DataFrame:
    """Top titles a filing holds more than once, and whether each of them starts a numbering."""
    slug = tx.slug(F.regexp_replace("title", r"^[0-9.]+\s*", ""))
    own = clauses(spark, d).where("parent_id is null").groupBy("document_id", slug.alias("slug")).agg(F.count("*").alias("times"), F.count_if(F.regexp_extract("title", "^([0-9]+)", 1) == "1").alias("firsts"))
    return own.where("times > 1").select("document_id", "slug", "times", (F.col("firsts") == F.col("times")).alias("all_restart"))


# ---- text searched by pattern ----------------------------------------------------------------------------------

#: Terms looked for, as stems without accents.
TERMS = ("franquia", "vistoria", "guincho", "granizo", "roubo", "colisao", "perito", "reboque")
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN contains(folded, '{t}') THEN '{t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL)"


@_query(f"WITH {CLAUSES}, f AS (SELECT clause_id, {base.FOLD.format('text')} AS folded FROM c) SELECT clause_id, array_to_string({_FOUND}, ';') AS terms, len({_FOUND}) AS n FROM f WHERE len({_FOUND}) > 0")
def q_term_hits(spark: SparkSession, d: str) -> DataFrame:
    own = clauses(spark, d).select("clause_id", tx.terms_held(tx.fold("text"), TERMS).alias("held"))
    return own.where("size(held) > 0").select("clause_id", F.array_join("held", ";").alias("terms"), F.size("held").alias("n"))


_CLUSTER = r"(?:franquia|vistoria|guincho|granizo|roubo|colisao|perito|reboque)"


@_query(f"WITH {CLAUSES}, f AS (SELECT clause_id, {base.FOLD.format('text')} AS folded FROM c) SELECT clause_id, regexp_matches(folded, '{_CLUSTER}(?s:.){{0,80}}{_CLUSTER}(?s:.){{0,80}}{_CLUSTER}') AS clustered FROM f WHERE len(regexp_extract_all(folded, '{_CLUSTER}')) >= 3")
def q_term_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clauses that hold three of the terms or more, and whether three stand close together."""
    own = clauses(spark, d).select("clause_id", tx.fold("text").alias("folded"))
    close = F.col("folded").rlike(rf"{_CLUSTER}(?s:.){{0,80}}{_CLUSTER}(?s:.){{0,80}}{_CLUSTER}")
    return own.where(F.regexp_count("folded", F.lit(_CLUSTER)) >= 3).select("clause_id", close.alias("clustered"))


@_query(f"WITH {CLAUSES}, p AS (SELECT clause_id, text, regexp_extract(text, '[0-9]+ (?:dias|horas|meses|km)') AS hit FROM c), s AS (SELECT *, strpos(text, hit) AS found_at FROM p WHERE hit <> '') SELECT clause_id, hit, found_at, text[greatest(1, found_at - 300):found_at + length(hit) + 299] AS snippet FROM s")
def q_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The first measure a clause names, with 300 characters on either side."""
    hit = F.regexp_extract("text", "[0-9]+ (?:dias|horas|meses|km)", 0)
    own = clauses(spark, d).select("clause_id", "text", hit.alias("hit")).where("hit <> ''").withColumn("found_at", F.instr("text", F.col("hit")))
    return own.select("clause_id", "hit", "found_at", F.expr("substring(text, greatest(1, found_at - 300), found_at + char_length(hit) + 300 - greatest(1, found_at - 300))").alias("snippet"))


@_query(f"WITH {CLAUSES}, l AS (SELECT clause_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS s FROM c) SELECT clause_id, len(s) AS steps, md5(array_to_string(list_transform(range(1, len(s) + 1), lambda i: i || '. ' || s[i]), chr(10))) AS numbered_md5 FROM l")
def q_numbered_text(spark: SparkSession, d: str) -> DataFrame:
    """A clause's lines as a numbered list."""
    steps = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    own = clauses(spark, d).where("text is not null").select("clause_id", steps.alias("s"))
    return own.select("clause_id", F.size("s").alias("steps"), F.md5(tx.numbered("s")).alias("numbered_md5"))


@_query(f"WITH {QUESTIONS}, {CLAUSES}, r AS (SELECT DISTINCT question, trim(unnest(string_split(reference_clause_ids, ';'))) AS clause_id FROM q) SELECT r.question, r.clause_id, c.clause_type, c.susep_process, c.insurer, c.product_line, c.filing_year FROM r JOIN c USING (clause_id)")
def q_with_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Referenced clauses with where they come from."""
    refs = questions(spark, d).select("question", F.explode(F.split("reference_clause_ids", ";")).alias("clause_id")).select("question", F.trim("clause_id").alias("clause_id")).distinct()
    return refs.join(clauses(spark, d), "clause_id").select("question", "clause_id", "clause_type", "susep_process", "insurer", "product_line", "filing_year")
