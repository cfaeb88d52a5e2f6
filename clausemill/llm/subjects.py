"""Problem 9: the subject areas of each document.

Method: normalised tf-idf vectors of documents are clustered by bisecting k-means. A leaf is described by its
discriminative terms: the words and word pairs whose document frequency inside the leaf exceeds that outside by
``ODDS``. A sentence is spread over the leaves by the log odds of the discriminative terms it holds; a document is
the mixture of its sentences' leaves. Labels only name leaves: the labelled documents' own leaf mixtures say which
area each leaf stands for, in a few rounds in which a document of two areas shares each leaf out among them. A
sentence whose terms speak for no leaf belongs to no area.

Terms are cut once, for whole batches on flat arrays, and kept by sentence; each later pass reads those arrays.
Document frequencies, clusters and leaf counts run over all documents. What reaches the driver is bounded by
``DIMENSIONS`` times the leaves and by ``LABELLED`` labelled documents, a sample by hash of the id from which
leaves are named.

Cases: null, empty and blank texts have no area; broken encodings, markup and control characters are repaired
before reading; a document without known terms has no area; repeated ids count as documents of their own and their
areas are united; extra columns are ignored; without labels no area is assigned.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.textarrays import Hasher, distinct, mix
from clausemill.storage import drop, stash

DIMENSIONS = 1 << 18
CLUSTER_DIMENSIONS = 1 << 12
LEAVES = 128
ITERATIONS = 4
#: At most about so many labelled documents name the leaves.
LABELLED = 20_000
ODDS = 1.5
_TAG = re.compile(r"<[^>\n]{1,120}>")
_CONTROL = re.compile("[­​-‏⁠﻿\x00-\x08\x0b-\x1f\x7f]")


def repaired(text: str) -> str:
    """Text with its encoding mended, markup and control characters gone, in composed form."""
    if "Ã" in text or "â€" in text:
        for wrong in ("cp1252", "latin-1"):
            try:
                text = text.encode(wrong).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", html.unescape(text))
    return unicodedata.normalize("NFKC", _CONTROL.sub("", text.replace("\r", "\n")))


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each byte: 1 for a letter, 2 for white space, 3 for a newline, 4 for the end of a sentence."""
    out = np.zeros(256, dtype=np.uint8)
    out[97:123], out[[32, 9, 11, 12]], out[10], out[[33, 46, 63]] = 1, 2, 3, 4
    return out


def cut_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all sentences' words and pairs of neighbouring words, each once a sentence, one after another;
    where each sentence ends among them; how many sentences each text has; and how many terms each text has.

    A sentence ends at white space after ``.``, ``!`` or ``?`` and at a newline; one without a word of two letters
    or more doesn't count.
    """
    bare = [unicodedata.normalize("NFD", repaired(t).lower()).encode("ascii", "ignore") for t in texts]
    flat = np.frombuffer(b"\n".join(bare) + b"\n", dtype=np.uint8)
    kind = _classes()[flat]
    letter = kind == 1
    change = np.diff(np.r_[0, letter.astype(np.int8), 0])
    start, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    wide = stop - start >= 2
    start, stop = start[wide], stop[wide]
    ends = np.zeros(len(flat), dtype=bool)
    ends[1:] = ((kind[1:] == 2) | (kind[1:] == 3)) & (kind[:-1] == 4)
    ends |= kind == 3
    sentence = np.cumsum(ends)[start] if len(start) else np.zeros(0, dtype=np.int64)
    bounds = np.cumsum([len(b) + 1 for b in bare])
    of = np.searchsorted(bounds, start, side="right")
    word = Hasher(flat).of(start, stop)
    joined = (sentence[1:] == sentence[:-1]) & (of[1:] == of[:-1]) if len(start) else np.zeros(0, dtype=bool)
    pair = mix(word[:-1][joined] * np.uint64(0x9E3779B97F4A7C15) + word[1:][joined]) if len(start) else word
    _, number = np.unique(of.astype(np.int64) << 40 | sentence, return_inverse=True) if len(start) else (None, np.zeros(0, dtype=np.int64))
    half = np.uint64(DIMENSIONS // 2)  # words have even buckets, pairs odd ones
    every = np.concatenate([word % half * np.uint64(2), pair % half * np.uint64(2) + np.uint64(1)])
    number = np.concatenate([number, number[1:][joined]]) if len(start) else number
    key = distinct(number.astype(np.int64) * DIMENSIONS + every.astype(np.int64))
    term, number = (key % DIMENSIONS).astype(np.int32), key // DIMENSIONS
    last = np.flatnonzero(np.r_[number[1:] != number[:-1], True]) + 1 if len(key) else np.zeros(0, dtype=np.int64)
    sentence_of = np.zeros(len(last), dtype=np.int64)
    if len(start):
        owner = np.zeros(int(number.max()) + 1, dtype=np.int64)
        _, first = np.unique(of.astype(np.int64) << 40 | sentence, return_index=True)
        owner[:] = of[first]
        sentence_of = owner
    per_text = np.bincount(sentence_of, minlength=len(texts))
    terms_of = np.bincount(sentence_of[number], minlength=len(texts)) if len(key) else np.zeros(len(texts), dtype=np.int64)
    return term, last, per_text, terms_of


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.astype(np.int32)))


def _cut(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, sizes): the buckets of each document by sentence, and how many each sentence has."""
    from clausemill.llm.arrow import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            term, last, per_text, terms_of = cut_terms(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(term, terms_of), _lists(np.diff(np.r_[0, last]), per_text)], names=["id", "terms", "sizes"])

    picked = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, terms array<int>, sizes array<int>").where("size(terms) > 0")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 500 documents, so that a table of their terms by leaves stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            yield batch.slice(start, 500)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and which row each is of."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), sizes)


def _counts(tables: DataFrame, columns: int) -> np.ndarray:
    """Sums of (place, n) over all tasks as a DIMENSIONS x columns table; each task has summed its own part."""
    got = tables.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMENSIONS * columns, dtype=np.float32)
    out[got.column("place").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(DIMENSIONS, columns)


def _held(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Each document's terms once: the term and its row."""
    term, row = _flat(batch.column("terms"))
    key = distinct(row.astype(np.int64) * DIMENSIONS + term)
    return key % DIMENSIONS, key // DIMENSIONS


def _summed(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["place", "n"])


class LeafMixtures:
    """Spreads sentences over leaves by the discriminative terms they hold."""

    def __init__(self, row_of: np.ndarray, odds: np.ndarray, least: float = 1.6):
        # row_of: place of a term in odds, -1 for a term that speaks for no leaf
        self.row_of, self.odds, self.least = row_of, odds, least

    def sentences(self, term: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """sentences x leaves shares; a row of zeros for a sentence that speaks for no leaf."""
        place = self.row_of[term]
        of = np.repeat(np.arange(len(sizes)), sizes)
        keep = place >= 0
        place, of = place[keep], of[keep]
        score = np.zeros((len(sizes), self.odds.shape[1]), dtype=np.float32)
        if len(place):
            lead = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            score[of[lead]] = np.add.reduceat(self.odds[place], lead, axis=0)
        top = score.max(axis=1, keepdims=True) if score.size else score[:, :1]
        share = np.exp(score - top) * (top >= self.least)
        return share / np.maximum(share.sum(axis=1, keepdims=True), 1e-9)


def fit_mixtures(cut: DataFrame, leaves: int = LEAVES) -> tuple[LeafMixtures, int]:
    """The mixtures of the leaves that bisecting k-means finds over all documents, and how many leaves there are."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_held(batch)[0], minlength=DIMENSIONS)
        yield _summed(total)

    total = cut.count()
    spread = _counts(cut.select("terms").mapInArrow(frequencies, "place bigint, n bigint"), 1)[:, 0]
    usable = (spread >= 3) & (spread <= 0.2 * total)

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, row = _held(batch)
            keep = usable[term]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(term[keep], np.bincount(row[keep], minlength=batch.num_rows))], names=["id", "terms"])

    kind = cut.schema["id"].dataType.simpleString()
    known = stash(cut.select("id", "terms").mapInArrow(useful, f"id {kind}, terms array<int>").where("size(terms) > 0"), "useful")
    held = known.count()
    clusters = min(leaves, max(2, held // 40))
    if held >= 80:
        # words alone give the direction; pairs follow them
        said = F.transform(F.filter("terms", lambda t: t % 2 == 0), lambda t: t.cast("string"))
        hashed = HashingTF(inputCol="said", outputCol="tf", numFeatures=CLUSTER_DIMENSIONS, binary=True).transform(known.withColumn("said", said))
        weighed = IDF(inputCol="tf", outputCol="weighed").fit(hashed).transform(hashed)
        vectors = stash(Normalizer(inputCol="weighed", outputCol="features").transform(weighed).select("terms", "features"), "vectors")
        model = BisectingKMeans(k=clusters, maxIter=ITERATIONS, seed=1, distanceMeasure="cosine", featuresCol="features", predictionCol="leaf", minDivisibleClusterSize=20.0).fit(vectors)
        placed = model.transform(vectors).select("terms", "leaf")
        n_leaves = len(model.clusterCenters())
    else:
        placed, n_leaves, vectors = known.select("terms", F.lit(0).alias("leaf")), 1, known

    def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, row = _flat(batch.column("terms"))
            leaf = batch.column("leaf").to_numpy().astype(np.int64)
            place, n = np.unique(np.concatenate([term.astype(np.int64) * n_leaves + leaf[row], DIMENSIONS * n_leaves + leaf]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n)], names=["place", "n"])

    got = placed.mapInArrow(by_leaf, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    drop(vectors)
    drop(known)
    terms = np.flatnonzero(usable)
    row = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    row[terms], row[DIMENSIONS] = np.arange(len(terms)), len(terms)  # the last row holds the leaves' sizes
    term, leaf = np.divmod(got.column("place").to_numpy(), n_leaves)
    inside = np.zeros((len(terms) + 1, n_leaves), dtype=np.float32)
    inside[row[term], leaf] = got.column("n").to_numpy()
    size, inside = inside[-1], inside[:-1]
    outside = spread[terms][:, None] - inside
    odds = np.log((inside + 0.1) / (size + 1)) - np.log((outside + 0.1) / np.maximum(1.0, held - size + 1))
    odds = np.where((inside >= 2) & (odds > ODDS), odds, 0.0).astype(np.float32)
    speaks = odds.max(axis=1) > 0
    row_of = np.full(DIMENSIONS, -1, dtype=np.int32)
    row_of[terms[speaks]] = np.arange(int(speaks.sum()))
    return LeafMixtures(row_of, odds[speaks]), n_leaves


def name_leaves(mixtures: np.ndarray, areas_of: np.ndarray, rounds: int = 8) -> np.ndarray:
    """leaves x areas: how far each leaf stands for each area, from labelled documents.

    ``mixtures`` is documents x leaves, ``areas_of`` documents x areas (1 for an area of the document). A leaf
    starts with the areas of the documents that hold it; then each document shares each of its leaves out among its
    own areas in proportion to what the leaf stands for, so two areas that come together are told apart by the
    documents that have one. A leaf no labelled document holds stands for nothing.
    """
    own = areas_of / np.maximum(1, areas_of.sum(axis=1, keepdims=True))
    base = np.maximum(own.sum(axis=0), 1e-9)
    names = (mixtures.T @ own) / base
    for _ in range(rounds):
        names /= np.maximum(names.sum(axis=1, keepdims=True), 1e-9)
        now = np.zeros_like(names)
        for area in range(areas_of.shape[1]):
            has = areas_of[:, area] > 0
            # share of this area among the document's areas, leaf by leaf
            rest = areas_of[has] @ names.T
            part = np.divide(names[:, area], rest, out=np.zeros_like(rest), where=rest > 0)
            now[:, area] = (mixtures[has] * part).sum(axis=0)
        names = now / base
    return names / np.maximum(names.sum(axis=1, keepdims=True), 1e-9)


def subject_shares(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, leaves: int = LEAVES) -> DataFrame:
    """(id, area, sentences, of_sentences) for every area that any sentence of the document is about."""
    cut = stash(_cut(documents, id_col, text_col), "cut")
    kind = cut.schema["id"].dataType.simpleString()
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("area")).where("id is not null and area is not null").distinct()
    empty = cut.select("id").limit(0).select("id", F.lit("").alias("area"), F.lit(0).cast("long").alias("sentences"), F.lit(0).cast("long").alias("of_sentences")).withColumnsRenamed({"id": id_col, "area": label_col})
    areas = [r[0] for r in known.select("area").distinct().orderBy("area").collect()]
    n_labelled = known.select("id").distinct().count()
    if not areas or cut.isEmpty():
        return empty
    mixtures, n_leaves = fit_mixtures(cut, leaves)

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            term, _ = _flat(batch.column("terms"))
            sizes, row = _flat(batch.column("sizes"))
            share = mixtures.sentences(term, sizes)
            total = np.zeros((batch.num_rows, share.shape[1]), dtype=np.float32)
            np.add.at(total, row, share)
            yield pa.RecordBatch.from_arrays([batch.column("areas"), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), share.shape[1]).cast(pa.list_(pa.float32()))], names=["areas", "mixture"])

    step = max(1, -(-n_labelled // LABELLED))
    grouped = known.groupBy("id").agg(F.collect_set("area").alias("areas")).where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0)
    labelled = cut.join(grouped, "id").select("areas", "terms", "sizes").mapInArrow(mixed, "areas array<string>, mixture array<float>").toArrow()
    if not labelled.num_rows:
        return empty
    of = np.array([[a in own for a in areas] for own in labelled.column("areas").to_pylist()], dtype=np.float32)
    names = name_leaves(np.stack(labelled.column("mixture").to_numpy()), of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            term, _ = _flat(batch.column("terms"))
            sizes, row = _flat(batch.column("sizes"))
            about = mixtures.sentences(term, sizes) @ names
            best = about.argmax(axis=1)
            sure = about[np.arange(len(best)), best] > 0.5
            n = len(areas)
            counts = np.bincount(row[sure] * n + best[sure], minlength=batch.num_rows * n)
            of_sentences = np.bincount(row, minlength=batch.num_rows)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at // n)), pa.array([areas[a] for a in (at % n).tolist()], type=pa.string()), pa.array(counts[at].astype(np.int64)), pa.array(of_sentences[at // n].astype(np.int64))], names=["id", "area", "sentences", "of_sentences"])

    return cut.mapInArrow(run, f"id {kind}, area string, sentences bigint, of_sentences bigint").withColumnsRenamed({"id": id_col, "area": label_col})
