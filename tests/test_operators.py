"""Hand-computed cases of the operators."""

import math

from pyspark.sql import functions as F

from clausemill.functions import numbers as nm
from clausemill.functions import text as tx
from clausemill.operators import retrieval as rt
from clausemill.operators import structure as st
from clausemill.operators import tables as tb
from clausemill.sources import files
from clausemill.streaming import events as ev


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_text_expressions(spark):
    assert one(spark, tx.fold(F.lit("Ação ÉTICA"))) == "acao etica"
    assert one(spark, tx.tokens(F.lit("A casa-mãe, nº 3"))) == ["a", "casa", "mãe", "nº", "3"]
    assert one(spark, tx.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, tx.slug(F.lit("  Órgão / Teste "))) == "orgao-teste"
    assert one(spark, tx.slug(F.lit("!!!"))) == "part"
    assert one(spark, tx.dot_leader(F.lit("Foro ..... 12"))) is True
    assert one(spark, tx.list_item(F.lit("a) x"))) is True
    assert one(spark, tx.list_item(F.lit(" a) x"))) is False
    assert one(spark, tx.title_key(F.lit("2.1. Perda de  Direitos"))) == "perda de direitos"
    assert one(spark, tx.cross_references(F.lit("ver Cláusula 3.1 e cláusulas 4, clausula 3.1"))) == ["3.1", "4"]
    assert one(spark, tx.normalize_layout(F.lit("a b­c “d”"))) == 'a bc "d"'


def test_nearest_rank_takes_the_third_of_four(spark):
    assert one(spark, nm.nearest_rank(F.array(*[F.lit(v) for v in (4, 1, 3, 2)]), 0.5)) == 3
    assert one(spark, nm.nearest_rank(F.array().cast("array<int>"), 0.5)) is None


def test_dates_and_identifiers(spark):
    assert str(one(spark, nm.two_form_date(F.lit("24/11/2008")))) == "2008-11-24"
    assert one(spark, nm.two_form_date(F.lit("n/d"))) is None
    assert one(spark, nm.process_formatted(F.lit("90414001204201196"))) == "90414.001204/2011-96"
    assert one(spark, nm.cnpj_valid(F.lit("11.222.333/0001-81"))) is True
    assert one(spark, nm.cnpj_valid(F.lit("11.222.333/0001-82"))) is False
    assert one(spark, nm.cnpj_valid(F.lit("x"))) is None


def test_bm25_by_hand(spark):
    corpus = spark.createDataFrame([("a", "gato preto"), ("b", "gato gato"), ("c", "cão"), ("d", None)], "k string, t string")
    asked = spark.createDataFrame([("q", "gato gato")], "q string, a string")
    got = {r["k"]: r["score"] for r in rt.bm25(corpus, "k", "t", asked, "q", "a").collect()}
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    mean = 5 / 4
    want = {k: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 2 / mean)) for k, tf in (("a", 1), ("b", 2))}
    assert set(got) == {"a", "b"} and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_best_bm25_equals_all_scored_pairs(spark, monkeypatch):
    said = ["a b c", "b", "a a c d", "b b", "", None, "c c c b", "a"]
    corpus = spark.createDataFrame([(f"k{i:02d}", f"g{i % 7}", said[i % len(said)]) for i in range(60)], "k string, g string, t string")
    asked = spark.createDataFrame([("q1", "a b"), ("q2", "B, a"), ("q3", "d"), ("q4", "x"), ("q5", None), ("q6", "b b c x"), ("q7", "a b")], "q string, a string")
    scored = rt.bm25(corpus, "k", "t", asked, "q", "a")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(rt.best(scored, "question", "k", "score", 3).select("question", "k", "score", "rank"))
    firsts = rt.best(scored.join(corpus.select("k", "g"), "k").groupBy("question", "g").agg(F.min(F.struct((-F.col("score")).alias("s"), "k")).alias("m")), "question", "g", "m", 99)
    best_of = {}
    for q, g, m, _ in firsts.collect():
        best_of.setdefault(q, []).append((m["s"], m["k"], g))
    want_groups = sorted((q, g, r + 1) for q, own in best_of.items() for r, (_, _, g) in enumerate(sorted(own)[:3]))
    twice = corpus.unionByName(corpus.where("k < 'k20'")).repartition(5)
    assert len(want) > 12
    for rows_at_once, words in ((4096, 200_000), (3, 4)):  # small batches, and several passes
        monkeypatch.setattr(rt, "TEXT_ROWS", rows_at_once)
        monkeypatch.setattr(rt, "ASKED_ROWS", words)
        assert rows(rt.best_bm25(twice, "k", "t", asked, "q", "a", 3).select("question", "k", "score", "rank")) == want
        assert rows(rt.best_bm25(twice, "k", "t", asked, "q", "a", 3, per="g").select("question", "g", "rank")) == want_groups


def test_best_bm25_of_questions_without_a_key(spark):
    corpus = spark.createDataFrame([("k1", "a b"), ("k2", "c")], "k string, t string")
    asked = spark.createDataFrame([(None, "c"), ("q1", "a"), ("q2", "a")], "q string, a string")
    got = rt.best_bm25(corpus, "k", "t", asked, "q", "a", 3).select("question", "k", "rank").collect()
    assert {tuple(r) for r in got} == {(None, "k2", 1), ("q1", "k1", 1), ("q2", "k1", 1)} and len(got) == 3


def test_fusion_and_measures(spark):
    left = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "g string, k string, rank int")
    right = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "g string, k string, rank int")
    got = [r["k"] for r in rt.reciprocal_rank_fusion([left, right], "g", "k", 3).orderBy("rank").collect()]
    assert got == ["y", "x", "z"]
    truth = spark.createDataFrame([("q", "x"), ("q", "w"), ("none", "v")], "g string, k string")
    rows = {r["g"]: r for r in rt.measures(left, truth, "g", "k", 2).collect()}
    assert rows["q"]["recall"] == 0.5 and rows["q"]["reciprocal_rank"] == 1.0
    assert abs(rows["q"]["ndcg"] - 1 / (1 + 1 / math.log2(3))) < 1e-12
    assert rows["none"]["recall"] == rows["none"]["ndcg"] == 0.0


def test_nearest_skips_null_vectors_and_works_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK_ROWS", 2)
    rows = [(i, [float(i % 3), 1.0]) for i in range(7)] + [(7, None)]
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    got = rt.nearest(vectors, "id", "v", vectors, "id", "v", 2).collect()
    assert {r["question"] for r in got} == set(range(7))
    best = {r["question"]: r["id"] for r in got if r["rank"] == 1}
    assert best == {0: 0, 3: 0, 6: 0, 1: 1, 4: 1, 2: 2, 5: 2}
    assert rt.nearest(vectors, "id", "v", vectors.where("false"), "id", "v", 2).count() == 0


def test_tree_and_links(spark):
    rows = [("d:1", "d", None, "1", "coverage", None, 1, 2, "1. A", "cláusula 2"), ("d:1/1.1", "d", "d:1", "1/1.1", "exclusion", None, 2, 2, "1.1. B", ""), ("d:2", "d", None, "2", "exclusion", "x", 9, 9, "2. C", "")]
    df = spark.createDataFrame(rows, "clause_id string, document_id string, parent_id string, path string, clause_type string, bundle_section string, page_start int, page_end int, title string, text string")
    assert [tuple(r) for r in st.ancestors(df).collect()] == [("d:1/1.1", "d:1", 1)]
    got = {(r["target_id"], r["edge"]) for r in st.linked(df, "coverage", "exclusion").collect()}
    assert got == {("d:1/1.1", 3)} or ("d:1/1.1", 3) in got


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "v1"), ("b", 2, "v2")], "k string, n int, v string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "v4")], "k string, n int, v string")
    got = {tuple(r) for r in tb.upsert(old, new, "k", ["v"]).collect()}
    assert got == {("a", 1, "v1"), ("b", 3, "v2"), ("c", 4, "v4")}
    assert tb.insert_ignore(old, new, ["k"]).count() == 3
    seats = {r["k"]: r["seats"] for r in tb.largest_remainder(spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "k string, n int"), "k", "n", 4).collect()}
    assert sum(seats.values()) == 4 and seats["a"] == 2


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("01", "a\nb", None), ("02", 'say "x"', "z")], "id string, t string, u string")
    files.write_json_lines(rows, f"{tmp_path}/j")
    assert {tuple(r) for r in files.read_json_lines(spark, f"{tmp_path}/j", rows.schema).collect()} == {tuple(r) for r in rows.collect()}
    files.write_parquet(rows, f"{tmp_path}/p", "id")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    (tmp_path / "m.csv").write_text('id,name\n007,"a ""b"""\n')
    assert tuple(files.read_strings(spark, f"{tmp_path}/m.csv", ["id", "name"]).first()) == ("007", 'a "b"')


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ev.tumbling(ev.late_bound(ev.read_events(spark, f"{tmp_path}/in"), "60 days"), "1 day")
    query = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in ev.tumbling(events, "1 day").collect()}
    assert {tuple(r) for r in spark.table("tumbled").collect()} == want
    once = ev.without_repeats(ev.read_events(spark, f"{tmp_path}/in"), "60 days").select("event_id")
    ev.run_once(once, f"{tmp_path}/out", f"{tmp_path}/cp")
    ev.run_once(ev.without_repeats(ev.read_events(spark, f"{tmp_path}/in"), "60 days").select("event_id"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()


def test_session_windows_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    query = ev.sessions(ev.late_bound(ev.read_events(spark, f"{tmp_path}/in"), "1 day"), "30 minutes").writeStream.format("memory").queryName("sessions_seen").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("sessions_seen").count() > 0
