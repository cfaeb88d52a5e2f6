"""Problem 7: encoding a whole corpus with a public byte-level BPE vocabulary.

Method: batched numpy merge rounds. The words of many documents that no earlier batch has met lie in one flat
array of symbols. Each round looks all neighbouring pairs up by binary search over the sorted pair keys, takes
the lowest rank of each word and merges every occurrence of that pair, until no word has a pair left. Words
met before are read from a cache of the Python worker, which is bounded in entries and starts afresh when full.

Cases: a null and an empty text give an empty list; strings of special tokens are ordinary text; a repeated row
gives a repeated row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator below.
VOCABULARIES = os.environ.get("CLAUSEMILL_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the vocabulary's own pre-tokenizer splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 300_000
BATCH_CHARS = 4_000_000
_WIDTH = np.int64(1 << 20)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file.

    Bytes that print as they are keep their character; the others take the characters from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTable:
    """Merge rules as sorted arrays: key of a pair, its rank, the id it becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys = left * _WIDTH + right
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each word has. Words are not empty."""
        none = len(self.keys)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            keys = symbols[:-1] * _WIDTH + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), none - 1)
            known = (self.keys[at] == keys) & (owner[:-1] == owner[1:])
            rank = np.full(len(symbols), none, dtype=np.int64)
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            each = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            finished = each == none
            if finished.any():
                done_symbols.append(symbols[finished])
                done_owner.append(owner[finished])
                keep = ~finished
                symbols, owner, rank, each = symbols[keep], owner[keep], rank[keep], each[keep]
                if not len(symbols):
                    break
            hit = rank == each
            # of touching hits (a run of one symbol) every second one counts, from the left
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run_start) % 2 == 0
            first = np.flatnonzero(hit)
            symbols[first] = self.merged[rank[first]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[first + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        if not done_symbols:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        flat, owners = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owners, kind="stable")
        return flat[order], np.bincount(owners, minlength=len(words))


@functools.lru_cache(maxsize=2)
def _table(path: str) -> PairTable:
    return PairTable(path)


_cache: dict[str, dict[str, list[int]]] = {}
_pieces = regex.compile(SPLIT)


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of each text; an empty list for null and empty texts."""
    table, cache = _table(path), _cache.setdefault(path, {})
    split = [_pieces.findall(t) if t else [] for t in texts]
    fresh = list({w for words in split for w in words if w not in cache})
    if len(cache) + len(fresh) > CACHED_WORDS:
        cache.clear()
        fresh = list({w for words in split for w in words})
    if fresh:
        flat, sizes = table.encode([w.encode("utf-8", "surrogatepass") for w in fresh])
        ids, start = flat.tolist(), 0
        for word, size in zip(fresh, sizes.tolist()):
            cache[word] = ids[start : start + size]
            start += size
    return [[i for w in words for i in cache[w]] for words in split]


def token_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row; no shuffle, one pass over the two columns."""
    from clausemill.llm.arrow import ragged, slices

    path = f"{folder}/{vocabulary}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_CHARS):
            ids = encode_texts(batch.column("text").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column("id"), ragged(ids, pa.int32())], names=["id", "ids"])

    picked = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, n_tokens INT) of every row, as :func:`token_ids` would have them."""
    path = f"{folder}/{vocabulary}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from clausemill.llm.arrow import slices

        for batch in slices(batches, "text", BATCH_CHARS):
            sizes = [len(x) for x in encode_texts(batch.column("text").to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, type=pa.int32())], names=["id", "n_tokens"])

    picked = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n_tokens int").withColumnRenamed("id", id_col)
