import pyspark.sql.functions as F
import pytest

from clausemill.functions import text as tx
from clausemill.operators import approximate as ap
from clausemill.operators import chunks as ch
from clausemill.operators import links as lk
from clausemill.operators import retrieval as rt
from clausemill.operators import tables as tb

CLAUSES = "clause_id string, document_id string, parent_id string, path string, clause_type string, bundle_section string, page_start int, page_end int, title string, text string, susep_process string, cnpj string, product_line string"


def clause(path, kind="other", bundle=None, page=1, text="", title=None, process="p", cnpj="c", line="auto"):
    parent = f"d:{path.rsplit('/', 1)[0]}" if "/" in path else None
    return (f"d:{path}", "d", parent, path, kind, bundle, page, page, title or f"{path.rsplit('/', 1)[-1]}. T", text, process, cnpj, line)


def test_a_filter_admits_unknown_sections_unless_strict(spark):
    rows = spark.createDataFrame([clause("1", bundle="x"), clause("2"), clause("3", bundle="y"), clause("4", bundle="x", process="q"), clause("5", bundle="x", cnpj=None)], CLAUSES)
    shape = "f string, susep_process string, cnpj string, product_line string, clause_type string, bundle_section string"
    filters = spark.createDataFrame([("by_process", "p", None, None, None, "x"), ("by_firm", None, "c", None, None, "x"), ("by_line", None, None, "auto", None, None), ("by_type", None, None, None, "coverage", None)], shape)
    read = lambda strict: {k: {r["clause_id"][2:] for r in lk.admitted(filters, rows, "f", strict).collect() if r["f"] == k} for k in ("by_process", "by_firm", "by_line", "by_type")}
    assert read(False) == {"by_process": {"1", "2", "5"}, "by_firm": {"1", "2", "4"}, "by_line": {"1", "2", "3", "4", "5"}, "by_type": set()}
    assert read(True) == {"by_process": {"1", "5"}, "by_firm": {"1", "4"}, "by_line": {"1", "2", "3", "4", "5"}, "by_type": set()}


def test_links_take_the_best_edge_and_the_tree_distance(spark):
    rows = [clause("1", "coverage", text="ver cláusula 9"), clause("1/1.1"), clause("1/1.1/1.1.1", "exclusion"), clause("1/1.2", "exclusion", bundle="x"), clause("9", "exclusion", page=40), clause("3", "exclusion", page=2), clause("4", "exclusion", page=9)]
    got = {(r["target_id"][2:], r["edge"], r["tree_distance"], r["gap"]) for r in lk.section_links(spark.createDataFrame(rows, CLAUSES), "coverage", "exclusion").collect()}
    assert got == {("1/1.1/1.1.1", 1, 2, 0), ("1/1.2", 1, 1, 0), ("9", 0, 0, 39), ("3", 2, 0, 1)}


@pytest.mark.parametrize(
    "ranked, links, slots, want",
    [
        (["c1", "o1", "e1", "o2"], ["e2", "e3"], 1, ["c1", "o1", "e1", "e2"]),  # the last other clause goes
        (["c1", "o1", "e1", "o2"], ["e2", "e3"], 2, ["c1", "e1", "e2", "e3"]),
        (["c1", "e1", "c2", "e4"], ["e2"], 2, ["c1", "e1", "c2", "e4"]),  # none can go
        (["c1", "o1"], ["e2", "e3"], 2, ["c1", "o1", "e2", "e3"]),  # there is room
        (["c1", "o1", "c2"], ["e2", "e3"], 2, ["c1", "c2", "e2", "e3"]),  # room for one, one goes
        (["o1", "o2", "o3", "o4"], ["e2"], 1, ["o1", "o2", "o3", "o4"]),  # no coverage, no link
        (["c1", "e2", "o1", "o2"], ["e2"], 1, ["c1", "e2", "o1", "o2"]),  # linked already
    ],
)
def test_reserved_places(spark, ranked, links, slots, want):
    types = spark.createDataFrame([(f"{k}{i}", {"c": "coverage", "e": "exclusion", "o": "other"}[k]) for k in "ceo" for i in range(1, 6)], "clause_id string, clause_type string")
    ranking = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ranked)], "question string, clause_id string, rank int")
    linked = spark.createDataFrame([("c1", e, 1, 0, i) for i, e in enumerate(links)], "source_id string, target_id string, edge int, tree_distance int, gap int")
    got = lk.reserve(ranking, types, linked, "question", 4, slots, "coverage", "exclusion").orderBy("rank").collect()
    assert [r["clause_id"] for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_chunks_and_back(spark):
    rows = [clause("1", text="x" * 30, title="1. Um"), clause("1/1.1", text="curto", title="1.1. Dois"), clause("1/1.2", text=None, title="1.2. Vazio"), clause("1/1.3", text="y" * 40, title="1.3. Tres"), clause("2", text="z", title="2. So")]
    df = spark.createDataFrame(rows, CLAUSES)
    got = {r["chunk_id"][2:]: r for r in ch.chunks(df, 20, 60).collect()}
    assert set(got) == {"1", "1/1.3", "2"} and got["1"]["source_clause_ids"] == ["d:1", "d:1/1.1", "d:1/1.2"]
    assert got["1"]["text"] == "1. Um\n\n" + "x" * 30 + "\n1.1. Dois\ncurto\n1.2. Vazio" and got["1"]["rule"] == "oversized"
    assert got["1/1.3"]["text"].startswith("1. Um\n1.3. Tres\n\n") and got["1/1.3"]["parent_path"] == "1. Um" and got["2"]["rule"] == "single"
    wanted = spark.createDataFrame([("q", 0, "d:1/1.3"), ("q", 1, "nothing"), ("q", 2, "d:2")], "question string, i int, clause_id string")
    back = ch.hydrated(wanted, ch.chunks(df, 20, 60), "question", "i").orderBy("place").collect()
    assert [(r["clause_id"], r["place"]) for r in back] == [("d:1/1.3", 1), ("d:2", 2)] and back[0]["text"].startswith("1.3. Tres")
    assert ch.chunks(df.where("false"), 20, 60).count() == 0


def test_log_and_cache(spark):
    old = spark.createDataFrame([("a", 0), ("a", 1)], "g string, sequence int")
    new = spark.createDataFrame([("a", 5), ("a", 3), ("b", 9)], "g string, at int")
    assert {(r["g"], r["at"], r["sequence"]) for r in tb.append_sequence(old, new, "g", ["at"]).collect()} == {("a", 3, 2), ("a", 5, 3), ("b", 9, 0)}
    asked = spark.createDataFrame([("x",), ("x",), ("y",), ("y",), (None,)], "k string")
    assert tuple(tb.cache_report(asked, spark.createDataFrame([("x",)], "k string"), "k").first()) == (2, 2, 1, 1)
    assert tuple(tb.cache_report(asked.where("false"), asked.where("false"), "k").first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_blocks_and_filters_give_what_brute_force_gives(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rt, "BLOCK_ROWS", 7)
    monkeypatch.setattr(rt, "BATCH_VECTORS", 11)
    monkeypatch.setattr(rt, "ASKED_VECTORS", broadcast)
    rows = [(i, [float((i * 7) % 13), float((i * 5) % 11), 1.0], i % 3 if i % 10 else None) for i in range(90)] + [(90, None, 1)]
    vectors = spark.createDataFrame(rows, "id long, v array<float>, label int")
    for same in (None, "label"):
        got = {}
        for r in rt.nearest(vectors, "id", "v", vectors.where("id % 4 = 0"), "id", "v", 3, same).collect():
            got.setdefault(r["question"], []).append((r["rank"], r["id"]))
        size = lambda v: sum(x * x for x in v) ** 0.5
        for q, v, a in rows:
            if v is None or q % 4 or same and a is None:
                assert q not in got
                continue
            near = sorted((-round(sum(x * y for x, y in zip(v, w)) / size(v) / size(w), 9), k) for k, w, b in rows if w and (not same or a == b))[:3]
            assert [k for _, k in sorted(got[q])] == [k for _, k in near]


def test_index_reaches_the_recall_asked_for(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(1500)], "id long, v array<double>")
    asked = vectors.where("id % 20 = 0")
    exact = {(r["question"], r["id"]) for r in rt.nearest(vectors, "id", "v", asked, "id", "v", 10).collect()}
    found = {(r["question"], r["id"]) for r in ap.search(vectors, "id", "v", asked, "id", "v", 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_labels_and_lists(spark):
    got = spark.range(1).select(tx.next_label(F.lit("1.9")), tx.next_label(F.lit("4")), tx.next_label(F.lit("x")), tx.numbered(F.array(F.lit("a"), F.lit("b"))), tx.terms_held(F.lit("o guincho"), ("vistoria", "guincho"))).first()
    assert tuple(got) == ("1.10", "5", None, "1. a\n2. b", ["guincho"])


def test_nearest_ranks_by_counts(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, None)] + [("b", 4)], "g string, v int")
    assert {tuple(r) for r in rt.nearest_ranks(rows, "g", "v", {"p50": 0.5, "p90": 0.9}).collect()} == {("a", 5, 9), ("b", 4, 4)}
