import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from clausemill.llm import near_duplicates as nd
from clausemill.llm.components import components
from clausemill.llm import passages
from clausemill.llm.passages import sampled, shared_passages, subtree_repeats

WORDS = [f"palavra{i}" for i in range(4000)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    base = [sentence(rng, rng.choice([12, 40, 160, 300])) for _ in range(40)]
    rows = []
    for i, text in enumerate(base):
        rows.append((f"a{i}", f"p{i % 3}", text))
        for j in range(3):
            rows.append((f"b{i}.{j}", f"p{(i + j) % 4}", edited(rng, text, 0.03 * j)))
    rows += [rows[0], ("n", "p0", None), ("e", "p1", ""), ("s", "p1", "duas palavras"), (None, "p1", base[0]), ("q", None, base[1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k string, part string, text string, similarity int")
    pairs, members, links = nd.near_pairs(df, "k", "part", "text", 0.6, 3)
    got = {(r["a"], r["b"]) for r in pairs.select("a", "b").distinct().collect()}
    own = {k: (p or "", t) for k, p, t in rows if k and t}
    want = {(a, b) for a in own for b in own if a < b and own[a][0] != own[b][0] and nd.jaccard(own[a][1], own[b][1], 3) >= 0.6}
    assert got <= want
    assert len(got) >= 0.97 * len(want)
    groups = {r["id"]: r["class_id"] for r in nd.near_groups(members, links).collect()}
    assert all(groups[a] == groups[b] for a, b in got)
    none = nd.near_pairs(df.where("false"), "k", "part", "text", 0.6, 3)[0]
    assert none.count() == 0


def test_candidates_in_turns_leave_no_shuffle_files(spark, monkeypatch):
    rng = random.Random(5)
    base = [sentence(rng, rng.choice([20, 120])) for _ in range(30)]
    rows = [(f"a{i}", "p", t) for i, t in enumerate(base)] + [(f"b{i}", "q", edited(rng, t, 0.02)) for i, t in enumerate(base)]
    signed = nd.sign(spark.createDataFrame(rows, "k string, part string, text string"), "k", "part", "text", 3)
    files = lambda: set(re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before, got = files(), []
    for turns in (1, 3):
        monkeypatch.setattr(nd, "TURNS", turns)
        got.append({tuple(r) for r in nd.candidate_pairs(signed, 0.6).collect()})
    assert got[0] == got[1] and len(got[0]) >= 10
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_pairs_that_meet_by_chance_are_not_written(spark):
    rng = random.Random(6)
    notice = sentence(rng, 40)
    unlike = [f"{sentence(rng, 55)} {notice} {sentence(rng, 55)}" for _ in range(300)]
    texts = unlike + [edited(rng, t, 0.02) for t in unlike[:10]]
    df = spark.createDataFrame([(str(i), str(i), t) for i, t in enumerate(texts)], "k string, part string, text string")
    pairs = nd.candidate_pairs(nd.sign(df, "k", "part", "text", 3), 0.6)
    assert 10 <= pairs.count() <= 20


def test_evenly_edited_pairs_at_the_threshold_are_found(spark):
    rng, rows = random.Random(8), []
    for i in range(300):
        text = sentence(rng, 136)
        rows += [(f"a{i}", "p", text), (f"b{i}", "q", " ".join(f"neu{i}x{k}" if k % 12 == 6 else w for k, w in enumerate(text.split())))]
    assert all(0.6 <= nd.jaccard(a[2], b[2], 3) < 0.61 for a, b in zip(rows[::2], rows[1::2]))
    got = nd.near_pairs(spark.createDataFrame(rows, "k string, part string, text string"), "k", "part", "text", 0.6, 3)[0].count()
    assert got >= 0.97 * 300


def test_sketches_estimate_similarity():
    rng = random.Random(1)
    a = sentence(rng, 400)
    for share in (0.0, 0.02, 0.1):
        b = edited(rng, a, share)
        _, _, sketch, _, _ = nd.signatures([a, b], 3)
        apart = np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum()
        toggles = np.log(max(1e-9, 1 - 2 * apart / nd.BITS)) / np.log(1 - 2 / nd.BITS)
        assert abs((1 - toggles / (2 * nd.SAMPLES)) - nd.jaccard(a, b, 3)) < 0.2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want


def brute(rows, span):
    where = defaultdict(set)
    for k, d, t in rows:
        for s in range(len(t) - span + 1):
            where[t[s : s + span]].add(d)
    out = set()
    for k, d, t in rows:
        run = None
        for s in range(len(t) - span + 1):
            if len(where[t[s : s + span]]) > 1:
                if run and s <= run[1]:
                    run[1] = s + span
                else:
                    if run:
                        out.add((k, *run))
                    run = [s, s + span]
        if run:
            out.add((k, *run))
    return out


@pytest.mark.parametrize("group, step", [(1, 30), (3, 5), (6, 9), (400, 30)])
def test_passages_against_brute_force(spark, group, step, monkeypatch):
    """Whatever the bound on groups, so with trees of one prefix, of longer ones, and with prefixes of whole spans."""
    monkeypatch.setattr(passages, "STEP", step)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    common = [" ".join(word() for _ in range(25)) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [rng.choice(common)[rng.randint(0, 20) : rng.randint(60, 120)] if rng.random() < 0.6 else " ".join(word() for _ in range(15)) for _ in range(4)]
        rows.append((f"k{i}", f"d{i % 13}", " ".join(parts)))
    rows += [("p1", "d90", "x" * 150), ("p2", "d91", "y" + "x" * 90), ("short", "d92", "abc")]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[0], ("n", "d1", None), ("e", "d1", ""), (None, "d1", rows[1][2]), ("k3", "d77", rows[1][2])]], "k string, doc string, text string, start_pos int")
    got = {tuple(r) for r in shared_passages(df, "k", "doc", "text", 40, group).collect()}
    assert got == brute([*rows, ("k3", "d77", rows[1][2])], 40)
    assert shared_passages(df.where("false"), "k", "doc", "text", 40).count() == 0


@settings(max_examples=100, deadline=None)
@given(some.lists(some.text(alphabet="ab", min_size=12, max_size=60), min_size=1, max_size=4))
def test_every_stretch_holds_a_kept_suffix(texts):
    span = 12
    of, at, h = sampled(texts, span)
    kept = defaultdict(set)
    for i, p in zip(of.tolist(), at.tolist()):
        kept[i].add(p)
    for i, t in enumerate(texts):
        for s in range(len(t) - span + 1):
            assert any(s <= p <= s + span - 4 for p in kept[i])


def test_subtree_of_equal_contexts():
    assert subtree_repeats(["a", "a"], ["x", "x"], ["yyyy", "yyyy"], 4) == [None, None]
    assert subtree_repeats(["a", "b", "a"], ["x", "x", "q"], ["yyyy", "yyyz", "yyyy"], 4) == [(1, 3), (1, 3), None]
