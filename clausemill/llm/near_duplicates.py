"""Problem 2: texts that share most of their content, across a collection too large for pairwise comparison.

Method: odd sketches. Of each distinct text, MinHash samples of its word shingles (one per bin of a one-permutation
hash, empty bins borrowing from the next) are folded into a bitmap of parities; the population count of two bitmaps'
exclusive or estimates how many samples differ. Candidates come from banded MinHash over the same shingles that the
similarity counts, so the chance to find a pair follows from its similarity alone, however its edits lie; short
texts have further bands. Pairs whose sizes rule the threshold out, or whose estimate is far below it, by a margin
of several standard errors, are dropped within their bucket; the rest are compared exactly.

Copies of one text are one node, so a group of copies costs no more than one text until the pairs are written.
Bucket joins emit each pair of texts once and are split at run time if a bucket is large.

Cases: null, empty and shorter-than-a-shingle texts have no pair; rows with a null id are ignored, a null partition
key counts as one key; repeated rows count once; extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.arrow import slices
from clausemill.llm.textarrays import Hasher, distinct, firsts, mix, word_table
from clausemill.storage import drop, shuffles_deleted, stash

BROADCAST_ROWS = 300_000
BATCH_CHARS = 600_000
#: Parts in which the places of bands are shuffled.
TURNS = 3
SAMPLES = 128
BITS = 512
#: A band of r minima agrees with the chance J^r for two texts at similarity J. Five rows and 60 bands find a pair at
#: exactly 0.6 with 1 - (1 - 0.6^5)^60 = 99.2 %, at 0.65 with 99.9 %, and a pair at 0.1 once in 1,700; short texts
#: have 24 bands of three besides.
ROWS, BANDS = 5, 60
SHORT, SHORT_ROWS, SHORT_BANDS = 40, 3, 24
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return _WORDS.findall(text.lower())


def _shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside a text, and the text it is of."""
    n = len(words) - width + 1
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[k : k + n]
        h ^= h >> np.uint64(31)
    inside = of[:n] == of[width - 1 :]
    return mix(h[inside]), of[:n][inside]


def _minima(h: np.ndarray, of: np.ndarray, texts: int, count: int, seed: int) -> np.ndarray:
    """texts x count minima of ``h`` under as many hash functions; 0 for texts without shingles."""
    out = np.zeros((texts, count), dtype=np.uint32)
    if not len(h):
        return out
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    rng = np.random.default_rng(seed)
    for k, (a, b) in enumerate(rng.integers(1, 1 << 63, size=(count, 2), dtype=np.uint64)):
        x = ((h ^ b) * (a | np.uint64(1))) >> np.uint64(32)
        out[of[starts], k] = np.minimum.reduceat(x, starts)
    return out


def _bands(minima: np.ndarray, rows: int) -> np.ndarray:
    """One 32-bit key for each band of ``rows`` minima."""
    key = np.zeros((len(minima), minima.shape[1] // rows), dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x100000001B3) + minima[:, r::rows] + np.uint64(1))
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def odd_sketches(h: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """texts x BITS/64 words: parities of the folded MinHash samples."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(texts * SAMPLES, empty)
    if len(h):
        bins = of.astype(np.uint64) * np.uint64(SAMPLES) + (h >> np.uint64(57))
        low = h & np.uint64((1 << 40) - 1)
        key = np.sort(bins << np.uint64(40) | low)
        slot = (key >> np.uint64(40)).astype(np.int64)
        lead = np.r_[True, slot[1:] != slot[:-1]]
        best[slot[lead]] = key[lead] & np.uint64((1 << 40) - 1)
    best = best.reshape(texts, SAMPLES)
    twice = np.concatenate([best, best], axis=1) != empty
    place = np.where(twice, np.arange(2 * SAMPLES), 2 * SAMPLES - 1)
    nxt = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :SAMPLES]
    filled = np.take_along_axis(best, nxt % SAMPLES, axis=1)
    samples = mix(filled * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64))
    bit = (samples % np.uint64(BITS)).astype(np.int64) + np.arange(texts)[:, None] * BITS
    parity = (np.bincount(bit.ravel(), minlength=texts * BITS) & 1).astype(np.uint8).reshape(texts, BITS)
    return np.packbits(parity, axis=1).view(np.int64).reshape(texts, BITS // 64)


def signatures(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: key of its word sequence, number of different shingles, sketch, bands, short bands (0 rows if long)."""
    joined = "\n".join(t.lower() for t in texts) + "\n"
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begin = np.r_[0, np.cumsum(lengths)]
    inside = word_table()[flat]
    heads, tails = np.flatnonzero(firsts(inside)), np.flatnonzero(firsts(~inside))
    tails = tails[tails > heads[0]] if len(heads) else tails[:0]
    words = Hasher(flat).of(heads, tails[: len(heads)]) if len(heads) else np.zeros(0, dtype=np.uint64)
    bounds = np.searchsorted(heads, begin)
    key = Hasher(words, 1).of(bounds[:-1], bounds[1:]).view(np.int64)
    narrow, of = _shingles(words, bounds, width)
    n = np.bincount((distinct(of.astype(np.uint64) << np.uint64(40) | narrow >> np.uint64(24)) >> np.uint64(40)).astype(np.int64), minlength=len(texts))
    bands = _bands(_minima(narrow, of, len(texts), ROWS * BANDS, 7), ROWS)
    few = np.isin(of, np.flatnonzero(n <= SHORT))
    short_bands = _bands(_minima(narrow[few], of[few], len(texts), SHORT_ROWS * SHORT_BANDS, 3), SHORT_ROWS)
    return key, n, odd_sketches(narrow, of, len(texts)), bands, short_bands


def sign(records: DataFrame, id_col: str, part_col: str, text_col: str, width: int) -> DataFrame:
    """(id, part, tk, n, s0.., bands): one row per record that has a shingle; bands ARRAY<INT>, a key at each place."""
    names = [f"s{i}" for i in range(BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # texts whose bands this task has given; copies need them once
        for batch in slices(batches, "text", BATCH_CHARS):
            key, n, sketch, long, short = signatures(batch.column("text").to_pylist(), width)
            has = np.flatnonzero(n > 0)
            every = np.concatenate([long, short], axis=1)
            # a long text has no short band
            use = np.concatenate([np.ones((len(n), BANDS), dtype=bool), np.repeat((n <= SHORT)[:, None], SHORT_BANDS, 1)], axis=1)[has]
            fresh = []
            for k in key[has].tolist():
                fresh.append(k not in seen)
                seen.add(k)
            use &= np.array(fresh, dtype=bool)[:, None]
            if len(seen) > 500_000:
                seen.clear()
            offsets = np.r_[0, np.cumsum(use.sum(axis=1))].astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(every[has][use]))
            take = pa.array(has)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("part").take(take), pa.array(key[has]), pa.array(n[has].astype(np.int32)), *[pa.array(np.ascontiguousarray(sketch[has, i])) for i in range(BITS // 64)], bands], names=["id", "part", "tk", "n", *names, "bands"])

    picked = records.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text")).where("id is not null and length(text) > 0")
    return picked.mapInArrow(run, "id string, part string, tk bigint, n int, " + ", ".join(f"{s} bigint" for s in names) + ", bands array<int>")


def jaccard(a: str, b: str, width: int) -> float:
    """Exact similarity of two texts' shingle sets."""
    x, y = words_of(a), words_of(b)
    p = set(zip(*[x[k:] for k in range(width)]))
    q = set(zip(*[y[k:] for k in range(width)]))
    return len(p & q) / len(p | q) if p or q else 0.0


def _alike(threshold: float) -> Column:
    """Whether the sketches of columns a0.. and b0.., of na and nb shingles, may be of texts as similar as the threshold."""
    words = range(BITS // 64)
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in words), F.lit(0))
    # expected parities of m toggles over BITS bits: BITS/2 (1 - (1 - 2/BITS)^m)
    toggles = F.log(F.greatest(F.lit(1e-9), 1 - 2 * apart / F.lit(float(BITS)))) / F.log(F.lit(1 - 2.0 / BITS))
    estimate = 1 - toggles / (2.0 * SAMPLES)
    margin = 4.5 * F.sqrt(0.5 / F.least(F.lit(float(SAMPLES)), F.greatest("na", "nb")))
    return estimate >= F.lit(threshold) - margin


def candidate_pairs(signed: DataFrame, threshold: float) -> DataFrame:
    """(ta, tb): pairs of different texts, ta < tb, that share a band and whose sizes and sketches allow the threshold.

    The places of bands are taken in ``TURNS`` parts, one after the other; each part's shuffle is deleted once its
    pairs are written, so the disk holds one part at a time. Pairs that meet by chance grow with the square of the
    texts, so they are compared where they meet and not written: most bands are one text's alone and fall away, the
    others are given their sketches before they are joined.
    """
    spark, found = signed.sparkSession, []
    words = range(BITS // 64)
    with shuffles_deleted(spark):
        nodes = stash(signed.select("tk", "n", *[f"s{i}" for i in words]).dropDuplicates(["tk"]), "nodes")
    for turn in range(TURNS):
        # copies in different tasks meet in their bucket; one partitioning serves the removal of copies and the count
        placed = signed.select("tk", F.posexplode("bands").alias("place", "key")).where(F.col("place") % TURNS == turn)
        band = F.shiftleft(F.col("place").cast("bigint"), 32).bitwiseOR(F.col("key").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
        banded = placed.select("tk", band.alias("band")).repartition("band").dropDuplicates(["band", "tk"])
        shared = banded.withColumn("texts", F.count("*").over(Window.partitionBy("band"))).where("texts > 1").select("tk", "band")
        with shuffles_deleted(spark):
            shared = stash(shared, "shared")
        spread = shared.join(nodes, "tk").repartition("band")
        left, right = (spread.withColumnsRenamed({"tk": f"t{x}", "n": f"n{x}"} | {f"s{i}": f"{x}{i}" for i in words}) for x in "ab")
        # two sets are no more similar than the smaller is to the larger in size
        size_fits = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9)
        pairs = left.join(right, "band").where(F.expr("ta < tb") & size_fits & _alike(threshold)).select("ta", "tb").distinct()
        with shuffles_deleted(spark):
            found.append(stash(pairs, "pairs"))
        drop(shared)
    with shuffles_deleted(spark):
        every = stash(functools.reduce(DataFrame.unionByName, found).distinct(), "pairs")
    for one in [*found, nodes]:
        drop(one)
    return every


def linked_texts(signed: DataFrame, pairs: DataFrame, records: DataFrame, id_col: str, text_col: str, threshold: float, width: int) -> DataFrame:
    """(ta, tb, similarity): those of the pairs of texts, by text key, at least as similar as the threshold."""
    keys = pairs.select(F.col("ta").alias("tk")).unionByName(pairs.select(F.col("tb").alias("tk"))).distinct()
    reps = stash(signed.select("tk", "id").join(keys, "tk", "left_semi").groupBy("tk").agg(F.min("id").alias("id")), "reps")
    small = reps.count() <= BROADCAST_ROWS
    texts = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(reps) if small else reps, "id")
    texts = stash(texts.select("tk", "text").dropDuplicates(["tk"]), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [jaccard(a, b, width) for a, b in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("ta"), batch.column("tb"), pa.array(got, type=pa.float64())], names=["ta", "tb", "similarity"])

    both = pairs.join(texts.withColumnsRenamed({"tk": "ta", "text": "xa"}), "ta").join(texts.withColumnsRenamed({"tk": "tb", "text": "xb"}), "tb")
    exact = both.select("ta", "tb", "xa", "xb").mapInArrow(run, "ta bigint, tb bigint, similarity double")
    return stash(exact.where(F.col("similarity") >= threshold), "links")


def near_pairs(records: DataFrame, id_col: str, part_col: str, text_col: str, threshold: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of records of different parts, a < b; the members (id, part, tk); the links."""
    banded = stash(sign(records, id_col, part_col, text_col, width), "banded")
    pairs = candidate_pairs(banded, threshold)
    signed = stash(banded.drop("bands"), "signed")
    drop(banded)
    links = linked_texts(signed, pairs, records, id_col, text_col, threshold, width)
    drop(pairs)
    members = signed.select("id", "part", "tk").distinct()
    ma, mb = members.select(F.col("id").alias("ia"), F.col("part").alias("pa"), F.col("tk").alias("ta")), members.select(F.col("id").alias("ib"), F.col("part").alias("pb"), F.col("tk").alias("tb"))
    close = links.join(ma, "ta").join(mb, "tb").where("pa <> pb and ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
    equal = ma.join(mb, F.col("ta") == F.col("tb")).where("ia < ib and pa <> pb").select(F.col("ia").alias("a"), F.col("ib").alias("b"), F.lit(1.0).alias("similarity"))
    return close.unionByName(equal), members, links


def near_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_links): one row per record that has a similar or equal record in another part.

    A class joins texts over links between texts; ``n_links`` counts the other texts a record's text is linked to.
    Texts whose linked and equal records all lie in one part have no class.
    """
    from clausemill.llm.components import components

    parts = members.groupBy("tk").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    a, b = parts.select(F.col("tk").alias("ta"), F.col("low").alias("la"), F.col("high").alias("ha")), parts.select(F.col("tk").alias("tb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    across = stash(links.join(a, "ta").join(b, "tb").where("not (la = ha and lb = hb and la = lb)").select("ta", "tb"), "across")
    classes = components(across, "ta", "tb")
    degree = across.select(F.col("ta").alias("tk")).unionByName(across.select(F.col("tb").alias("tk"))).groupBy("tk").agg(F.count("*").alias("n_links"))
    own = parts.where("low <> high").select("tk")
    rows = members.join(classes.withColumnRenamed("node", "tk"), "tk", "left").join(degree, "tk", "left").join(own.withColumn("copies", F.lit(True)), "tk", "left")
    return rows.where("component is not null or copies").select("id", F.coalesce("component", "tk").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).distinct()
