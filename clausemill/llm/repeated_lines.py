"""Problem 1: lines repeated across the documents of one source.

Method: the frequency of each line within a source is compared with its frequency outside by the log-likelihood
ratio. A line that all sources repeat alike shows no such excess; its count within the source is compared, by the
ratio of two Poisson rates, with the corpus rate, the mean number of documents that hold a line. The stronger ratio
counts, at twice its p-value. The false-discovery rate over all candidates, every line of every source, is
controlled by the step-up rule of Benjamini and Hochberg, on a histogram of the ratio whose size does not depend on
the data. Lines that pass are anti-joined from each document, which is put together again by position.

Line keys are 96-bit hashes of the normalised line, computed for whole batches on flat arrays. Counting goes
through a distinct aggregation (line, source, document), so a line of a third of all documents is summed up in
parts. The keys of candidate lines are broadcast only below ``BROADCAST_ROWS``; above, the join shuffles.

Cases: null and empty texts have no lines that count; rows with a null source or document id are not counted and
keep their text; repeated rows count once and give one row; extra columns are kept out; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.arrow import slices
from clausemill.llm.textarrays import DIGIT, Hasher, codepoints, fold_table
from clausemill.storage import stash

BROADCAST_ROWS = 500_000
BATCH_CHARS = 1_000_000
#: The ratio is binned in steps of STEP up to BINS of them.
STEP, BINS = 0.05, 8_000


def line_keys(texts: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line that counts: its text, its number, and two hashes of its normalised form."""
    raw, starts = codepoints(texts)
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    folded = fold_table()[raw]
    first_char = np.zeros(len(raw), dtype=bool)
    first_char[starts[:-1][np.diff(starts) > 0]] = True
    newline = raw == 10
    # the newlines of the text so far, the number of a character's line
    total = np.cumsum(newline, dtype=np.int32)
    before = np.r_[np.int32(0), total][starts[:-1]]
    keep = folded != 0
    folded, text_of, line_no, first_char = folded[keep], text_of[keep], (total - newline)[keep], first_char[keep]
    line_no = line_no - before[text_of]
    fresh = np.r_[True, (line_no[1:] != line_no[:-1]) | (text_of[1:] != text_of[:-1])]
    run = (folded == DIGIT) | (folded == 32)
    again = np.zeros(len(folded), dtype=bool)
    again[1:] = run[1:] & (folded[1:] == folded[:-1]) & ~fresh[1:]
    stay = ~again & (folded != 10)
    folded, text_of, line_no = folded[stay], text_of[stay], line_no[stay]
    folded[folded == DIGIT] = 35  # one # for a run of digits; a # in the text stays beside it
    inner = ((folded >= 97) & (folded <= 122)) | (folded == 35)
    at = np.flatnonzero(inner)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    lead = np.r_[True, (line_no[at[1:]] != line_no[at[:-1]]) | (text_of[at[1:]] != text_of[at[:-1]])]
    head = at[lead]
    tail = at[np.r_[lead[1:], True]] + 1
    long = tail - head >= min_chars
    head, tail = head[long], tail[long]
    one = Hasher(folded, 0).of(head, tail).view(np.int64)
    two = Hasher(folded, 1).of(head, tail).view(np.int64)
    return text_of[head], line_no[head], one, (two >> np.int64(32)).astype(np.int32)


def keyed_lines(documents: DataFrame, id_col: str, source_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, source, line_no, h1, h2): every line that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_CHARS):
            of, line_no, one, two = line_keys(batch.column("text").to_pylist(), min_chars)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("source").take(take), pa.array(line_no.astype(np.int64)), pa.array(one), pa.array(two)], names=["id", "source", "line_no", "h1", "h2"])

    picked = documents.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    picked = picked.where("id is not null and source is not null and length(text) >= 1")
    return picked.mapInArrow(run, "id string, source string, line_no bigint, h1 bigint, h2 int")


def log_p(llr: float) -> float:
    """Natural logarithm of the chance that a chi-square of one degree exceeds ``llr``."""
    if llr <= 0:
        return 0.0
    p = math.erfc(math.sqrt(llr / 2))
    return math.log(p) if p > 1e-290 else -llr / 2 - 0.5 * math.log(math.pi * llr / 2)


def excess_lines(documents: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int = 8, min_chars: int = 15, fdr: float = 0.05) -> DataFrame:
    """(id, source, line_no, n_within, n_outside, llr, scope, excess): lines of at least ``min_docs`` documents.

    ``excess`` says whether the line passes the test; ``scope`` is ``source`` where the comparison with other
    sources alone passes it, ``shared`` where only the comparison with the corpus rate does, ``none`` where
    neither does.
    """
    lines = keyed_lines(documents, id_col, source_col, text_col, min_chars)
    hashed = lines.select(F.xxhash64("source").alias("s"), "h1", "h2", F.xxhash64("id").alias("d"))
    per = stash(hashed.groupBy("s", "h1", "h2").agg(F.countDistinct("d").alias("n")), "lines")
    overall = per.groupBy("h1", "h2").agg(F.sum("n").alias("n_all"), F.max("n").alias("top"))
    pairs, standing = per.agg(F.count("*"), F.sum("n")).first()
    distinct_lines = overall.count()
    sizes = documents.where(F.col(id_col).isNotNull() & F.col(source_col).isNotNull()).groupBy(F.xxhash64(F.col(source_col).cast("string")).alias("s")).agg(F.countDistinct(F.xxhash64(F.col(id_col).cast("string"))).alias("docs"))
    sizes = stash(sizes, "sizes")
    all_docs = sizes.agg(F.sum("docs")).first()[0] or 0
    # a line written once repeats nothing: it counts among the candidates, with a p-value of 1
    tested = per.where("n >= 2").join(overall.where("top >= 2").select("h1", "h2", "n_all"), ["h1", "h2"]).join(sizes, "s")
    k1, k2 = F.col("n").cast("double"), (F.col("n_all") - F.col("n")).cast("double")
    n1, n2 = F.col("docs").cast("double"), F.lit(float(all_docs)) - F.col("docs")
    p = (k1 + k2) / (n1 + n2)

    def part(k, n, q):
        """k ln q + (n - k) ln(1 - q), with 0 ln 0 = 0."""
        return F.when(k > 0, k * F.log(q)).otherwise(0.0) + F.when(n > k, (n - k) * F.log1p(-q)).otherwise(0.0)

    against = 2 * (part(k1, n1, k1 / n1) + F.when(n2 > 0, part(k2, n2, k2 / n2)).otherwise(0.0) - part(k1, n1, p) - F.when(n2 > 0, part(k2, n2, p)).otherwise(0.0))
    more = (n2 > 0) & (k1 * n2 > k2 * n1)
    rate = F.lit((standing or 0) / max(1, distinct_lines))
    usual = F.when(k1 > rate, 2 * (k1 * F.log(k1 / rate) - (k1 - rate))).otherwise(0.0)
    both = tested.select("s", "h1", "h2", F.col("n").alias("n_within"), (F.col("n_all") - F.col("n")).alias("n_outside"), F.when(more, F.greatest(against, F.lit(0.0))).otherwise(0.0).alias("own"), usual.alias("usual"))
    scored = stash(both.withColumn("llr", F.greatest("own", "usual")), "tested")
    cell = lambda c: F.least(F.floor(F.col(c) / STEP), F.lit(BINS)).cast("int")
    bins = {b: n for b, n in scored.groupBy(cell("llr").alias("bin")).count().collect()}
    limit = step_up(bins, fdr, pairs)
    scope = F.when(cell("own") >= limit, "source").when(cell("llr") >= limit, "shared").otherwise("none")
    kept = scored.where(F.col("n_within") >= min_docs).select("s", "h1", "h2", "n_within", "n_outside", "llr", scope.alias("scope"), (cell("llr") >= limit).alias("excess"))
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    found = lines.withColumn("s", F.xxhash64("source")).join(kept, ["s", "h1", "h2"])
    return found.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "line_no", "n_within", "n_outside", "llr", "scope", "excess").distinct()


def step_up(bins: dict[int, int], fdr: float, candidates: int) -> int:
    """The weakest bin of the ratio whose largest p-value still meets the step-up rule over all candidates.

    p-values are doubled for having two looks; ``BINS + 1`` if no bin meets the rule.
    """
    passed, best = 0, BINS + 1
    for b in sorted(bins, reverse=True):
        passed += bins[b]
        if log_p(b * STEP) + math.log(2) <= math.log(fdr * passed / max(1, candidates)):
            best = b
    return best


def without_excess(documents: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """(id, text, removed INT): each text without its excess lines; repeated rows give one row.

    Lines kept stay in order; a text all of whose lines go becomes empty; a null text and a text under a null id
    stay as they are. The lines of texts that have any are anti-joined with the found ones and put together again
    by position; other texts are not taken apart.
    """
    gone = found.select(F.col(id_col).alias("id"), "line_no").distinct()
    base = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    base = base.join(gone.groupBy("id").agg(F.count("*").alias("n")), "id", "left")
    whole = base.where("n is null or text is null").select("id", "text", F.lit(0).alias("removed"))
    lines = base.where("n is not null and text is not null").select("id", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    every = lines.withColumn("line_no", F.col("line_no").cast("bigint"))
    stay = every.join(gone, ["id", "line_no"], "left_anti").groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    mended = every.groupBy("id", "key").agg(F.count("*").alias("n")).join(stay, ["id", "key"], "left")
    text = F.coalesce(F.array_join("l.line", "\n"), F.lit(""))
    parted = mended.select("id", text.alias("text"), (F.col("n") - F.coalesce(F.size("l"), F.lit(0))).cast("int").alias("removed"))
    return whole.unionByName(parted).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "removed")
