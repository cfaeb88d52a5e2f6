import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from clausemill.llm import packing
from clausemill.llm.tokenize_corpus import VOCABULARIES, encode_texts, token_counts, token_ids

PATH = f"{VOCABULARIES}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


CASES = ["", None, " ", "a", "aaaaaaa" * 30, "Olá, mundo!  <|endoftext|>\n\n x", "é" * 50, "\x00\x01", "zero​width", "I'll we've 123 4567", "🙂👍🏽", " " * 300, "ﬁ ½ ² ́"]


def test_same_ids_as_the_library(reference):
    assert [list(x) for x in encode_texts(CASES, PATH)] == [reference.encode(t or "", add_special_tokens=False).ids for t in CASES]


@settings(max_examples=60, deadline=None)
@given(some.text(max_size=60))
def test_any_text(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encode_texts([text], PATH)[0] == reference.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (2, None, 6), (3, "", 7)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in token_ids(df).collect())
    assert [g[0] for g in got] == [1, 2, 2, 3] and got[1][1] == [] == got[3][1]
    assert token_ids(df.where("false")).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}[1] == 2


@settings(max_examples=80, deadline=None)
@given(some.dictionaries(some.integers(1, 40), some.integers(1, 30), max_size=20))
def test_plan_uses_each_item_once(histogram):
    plan = packing.plan_patterns(histogram, 40)
    used: dict[int, int] = {}
    for pattern, times in plan:
        assert sum(pattern) <= 40 and times > 0
        for s in pattern:
            used[s] = used.get(s, 0) + times
    assert used == histogram


def test_exact_fills_are_found():
    plan = packing.plan_patterns({30: 2, 10: 2, 25: 1, 9: 1, 6: 1, 20: 1, 8: 1, 7: 1, 5: 1}, 40)
    assert sorted(sum(p) for p, n in plan for _ in range(n))[-4:] == [40, 40, 40, 40]


def test_containers(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 7, 7, 7, 30, 63, 64, 65, 200, 129]) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(400, None)], "k long, n int")
    rows = packing.pack(df, "k", "n", 64, bucket_rows=20).toPandas()
    assert rows.groupby("container_id")["size"].sum().max() <= 64
    assert {i: n for i, n in rows.groupby("k")["size"].sum().items()} == {**dict(enumerate(sizes)), 400: 0}
    pieces = rows.groupby("k").size()
    assert all(pieces[i] == max(1, -(-s // 64)) for i, s in enumerate(sizes))
    assert np.isin(rows[rows["size"] == 0].container_id, [0]).all()
    used = rows.groupby("container_id")["size"].sum()
    assert len(used) <= -(-sum(sizes) // 64) + 3
    assert packing.pack(df.where("false"), "k", "n", 64).count() == 0
