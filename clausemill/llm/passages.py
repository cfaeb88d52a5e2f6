"""Problem 3: long spans that stand word for word in records of different documents.

Method: prefix-partitioned suffix trees over sampled suffixes. A suffix is kept where its first ``k`` characters
hash lowest among neighbouring ones, chosen so that every stretch of ``span`` characters holds the start of a kept
suffix and its first k characters. Suffixes are split by those characters; groups of one document fall away at
once. Each remaining group is a subtree: its suffixes are sorted, neighbouring common prefixes give the internal
nodes, and a node reaches as far left as its leaves agree. A node deep enough in both directions is a repeat.
A group beyond ``GROUP`` suffixes is split by longer prefixes: for each step of depth that its nodes can have, its
suffixes are grouped anew by the longest stretch that leaves under such a node must share, which reaches right to
the step's depth and left by what the span still needs. Each of these groups is a subtree of its own. Where even
one of them is beyond GROUP, hundreds of suffixes share nearly a whole span; the prefix then grows to the span
itself, whose node needs no tree, as it is a repeat once two documents hold it. That is counted by an aggregation
that sums in parts; so no task holds a group larger than GROUP.

Every kept suffix of every text takes part; nothing is capped. Positions are code points.

Cases: null, empty and short texts have no passage; rows with a null id or document are ignored; repeated rows
count once, as they are of one document; of two texts under one id each gives its own runs; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.arrow import slices
from clausemill.llm.textarrays import Hasher, codepoints, distinct, mix
from clausemill.storage import stash

BROADCAST_ROWS = 400_000
BATCH_CHARS = 400_000
GROUP = 400
#: By how many characters the prefixes of a large group grow.
STEP = 30


def prefix_length(span: int) -> int:
    return max(1, span * 2 // 5)


def steps(span: int) -> list[tuple[int, int, int]]:
    """(right, below, left) for every step of depth: leaves that share right to below characters, the latter not
    included, and a whole span with what stands left of them, share ``right`` and ``left`` of them at least."""
    edges = [*range(prefix_length(span), span, STEP), span]
    return [*((r, e, span - e + 1) for r, e in zip(edges, edges[1:])), (span, span + 1, 0)]


def _sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """``best`` of every window of this width."""
    done = 1
    while 2 * done <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    return best(values[: -(width - done)], values[width - done :]) if width > done else values


def sampled(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every kept suffix: its text, its place in it, the hash of its prefix. Texts have at least ``span``."""
    k = prefix_length(span)
    width = span - k + 1
    flat, begin = codepoints(texts)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = Hasher(flat).windows(k)
    h[h == top] -= np.uint64(1)
    lowest = _sliding(h, width, np.minimum)
    for end in begin[1:-1].tolist():
        lowest[max(0, end - span + 1) : end] = 0  # these stretches reach into the next text
    padded = np.zeros(len(h) + width - 1, dtype=np.uint64)
    padded[width - 1 : width - 1 + len(lowest)] = lowest
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    of = np.searchsorted(begin, at, side="right") - 1
    return of, at - begin[of], h[at]


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def subtree_repeats(docs: list, lefts: list[str], rights: list[str], span: int) -> list[tuple[int, int] | None]:
    """For each suffix how far left and right of its start it is repeated in another document, or None.

    ``lefts`` are reversed; ``rights`` begin at the suffix.
    """
    n = len(docs)
    out: list[tuple[int, int] | None] = [None] * n

    def note(x: int, left: int, right: int) -> None:
        if left + right >= span:
            got = out[x]
            out[x] = (left, right) if got is None else (max(got[0], left), max(got[1], right))

    if n == 2:
        if docs[0] != docs[1]:
            left, right = common(lefts[0], lefts[1]), common(rights[0], rights[1])
            note(0, left, right)
            note(1, left, right)
        return out
    order = sorted(range(n), key=lambda i: rights[i])
    depth = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    # internal nodes as (depth, first leaf, last leaf), from the neighbouring depths
    nodes, stack = [], []
    for i, d in enumerate([*depth, -1]):
        start = i
        while stack and stack[-1][0] >= d:
            level, start = stack.pop()
            if level > d:
                nodes.append((level, start, i))
        if d >= 0:
            stack.append((d, start))
    by_left = sorted(range(n), key=lambda i: lefts[i])
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    for level, first, last in nodes:
        leaves = sorted(order[first : last + 1], key=rank.__getitem__)
        if all(docs[x] == docs[leaves[0]] for x in leaves):
            continue
        shared = [common(lefts[a], lefts[b]) for a, b in zip(leaves, leaves[1:])]
        for way in (1, -1):
            line = leaves[::way]
            step = shared[::way]
            reach = -1  # no leaf of another document before this one
            for t in range(1, len(line)):
                if docs[line[t - 1]] != docs[line[t]]:
                    reach = step[t - 1]
                elif reach >= 0:
                    reach = min(reach, step[t - 1])
                if reach >= 0:
                    note(line[t], reach, level)
    return out


def shared_passages(records: DataFrame, id_col: str, doc_col: str, text_col: str, span: int = 300, group: int = GROUP) -> DataFrame:
    """(id, start_pos, end_pos): maximal runs in which every character lies in a stretch of ``span`` characters
    that also stands in a record of another document."""
    k = prefix_length(span)
    reach = span - k
    own = records.select(F.col(id_col).cast("string").alias("id"), F.col(doc_col).cast("string").alias("doc"), F.col(text_col).alias("text")).where((F.char_length("text") >= span) & F.col("id").isNotNull() & F.col("doc").isNotNull())
    # two texts under one id are two texts
    own = own.withColumn("c", F.xxhash64("id", "text")).withColumn("id", F.concat_ws(":", "c", "id"))
    hashed = own.select("c", F.xxhash64("doc").alias("d"), "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_CHARS):
            of, at, h = sampled(batch.column("text").to_pylist(), span)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("c").take(take), batch.column("d").take(take), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["c", "d", "pos", "h"])

    suffixes = stash(hashed.mapInArrow(sample, "c bigint, d bigint, pos int, h bigint"), "suffixes")
    groups = stash(suffixes.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", (F.col("n") > group).alias("hot")), "groups")
    few = groups.count() <= BROADCAST_ROWS
    hits = suffixes.join(F.broadcast(groups) if few else groups, "h")
    by_text = stash(hits.groupBy("c").agg(F.sort_array(F.collect_set(F.struct("pos", "h", "hot"))).alias("marks")), "marks")
    if by_text.count() <= BROADCAST_ROWS:
        own = own.join(F.broadcast(by_text.select("c")), "c", "left_semi")
    own = own.dropDuplicates(["c"])
    marked = own.join(by_text, "c").select("c", "id", F.xxhash64("doc").alias("d"), "text", F.col("marks.pos").alias("pos"), F.col("marks.h").alias("h"), F.col("marks.hot").alias("hot"))
    bands = steps(span)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            got: list[tuple] = []
            for i, (text, pos, h, hot) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "pos", "h", "hot")))):
                for p, key, much in zip(pos, h, hot):
                    if not much:
                        rows.append(i)
                        got.append((key, p, text[max(0, p - reach) : p][::-1], text[p : p + span]))
            take = pa.array(rows, type=pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("d").take(take), *[pa.array([g[n] for g in got], type=t) for n, t in enumerate(kinds)]], names=["id", "d", "h", "pos", "left", "right"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            found = subtree_repeats([x[1] for x in held], [x[4] for x in held], [x[5] for x in held], span)
            for x, f in zip(held, found):
                if f:
                    out.append((x[0], x[3] - f[0], x[3] + f[1]))

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], type=t) for n, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["id", "s", "e"])
            out.clear()
            return got

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "d", "h", "pos", "left", "right"))):
                if held and held[-1][2] != row[2]:
                    close()
                    held.clear()
                held.append(row)
            yield flush()
        if held:
            close()
        yield flush()

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every suffix of a large group under the longer prefix of each step."""
        for batch in batches:
            for i, (text, pos, hot) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "pos", "hot")))):
                at = np.array([p for p, much in zip(pos, hot) if much], dtype=np.int64)
                if not len(at):
                    continue
                hasher = Hasher(codepoints([text])[0], 0)
                for step, (right, _, left) in enumerate(bands):
                    fit = at[(at >= left) & (at + right <= len(text))]
                    key = mix(hasher.of(fit - left, fit + right) + np.uint64(step)).view(np.int64)
                    take = pa.array(np.full(len(fit), i))
                    yield pa.RecordBatch.from_arrays([batch.column("c").take(take), batch.column("d").take(take), pa.array(fit.astype(np.int32)), pa.array(np.full(len(fit), step, dtype=np.int32)), pa.array(key)], names=["c", "d", "pos", "step", "h"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole spans around the suffixes whose group stays large, those of the step's depths only."""
        for batch in batches:
            for i, (text, pos, step, hot) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "pos", "step", "hot")))):
                parts = [np.arange(p - span + bands[n][0], p - span + bands[n][1]) for p, n, much in zip(pos, step, hot) if much]
                if not parts:
                    continue
                starts = distinct(np.concatenate(parts))
                starts = starts[(starts >= 0) & (starts + span <= len(text))]
                flat, _ = codepoints([text])
                one = Hasher(flat, 0).of(starts, starts + span).view(np.int64)
                two = Hasher(flat, 1).of(starts, starts + span).view(np.int64)
                take = pa.array(np.full(len(starts), i))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("d").take(take), pa.array(one), pa.array(two), pa.array(starts)], names=["id", "d", "h1", "h2", "s"])

    def by_trees(of: DataFrame) -> DataFrame:
        small = of.where(F.exists("hot", lambda x: ~x)).mapInArrow(contexts, "id string, d bigint, h bigint, pos int, left string, right string")
        return small.repartition("h").sortWithinPartitions("h").mapInArrow(trees, "id string, s bigint, e bigint")

    runs = by_trees(marked)
    if groups.where("hot").limit(1).count():
        split = stash(marked.where(F.exists("hot", lambda x: x)).mapInArrow(longer, "c bigint, d bigint, pos int, step int, h bigint"), "longer")
        parts = split.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", (F.col("n") > group).alias("hot"))
        again = split.join(parts, "h").groupBy("c").agg(F.sort_array(F.collect_set(F.struct("pos", "step", "h", "hot"))).alias("marks"))
        deeper = stash(own.join(again, "c").select("id", F.xxhash64("doc").alias("d"), "text", *[F.col(f"marks.{x}").alias(x) for x in ("pos", "step", "h", "hot")]), "deeper")
        runs = runs.unionByName(by_trees(deeper))
        wide = stash(deeper.where(F.exists("hot", lambda x: x)).mapInArrow(spans, "id string, d bigint, h1 bigint, h2 bigint, s bigint"), "spans")
        both = wide.groupBy("h1", "h2").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("h1", "h2")
        runs = runs.unionByName(wide.join(both, ["h1", "h2"], "left_semi").select("id", "s", (F.col("s") + span).alias("e")))
    ordered = runs.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("r"))

    def join(done, x):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(last["e"] >= x["s"], grown).otherwise(F.concat(done, F.array(x)))

    merged = ordered.select("id", F.explode(F.aggregate(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 1, 1), join)).alias("x"))
    whose = F.expr("substring(id, instr(id, ':') + 1)")
    return merged.select(whose.alias(id_col), F.col("x.s").alias("start_pos"), F.col("x.e").alias("end_pos")).distinct()
