"""Every query with SQL gives the rows that SQL gives."""

import glob
import math
import os

import duckdb
import pytest

from clausemill.plans import catalogue, evaluation, linking  # noqa: F401 - the last two add queries


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "None" if math.isnan(value) else repr(round(value, 5) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs


def test_entry_has_rows(spark, data):
    assert catalogue.queries()["q_bm25_topk"](spark, data).limit(1).count() == 1


@pytest.mark.parametrize("name", ["q_rerank", "q_bm25_topk", "q_foreign_rate", "q_bm25_rollup"])
def test_no_table_of_scored_pairs(spark, data, monkeypatch, name):
    monkeypatch.setattr(catalogue.rt, "bm25", lambda *a, **k: pytest.fail("every question is paired with every text that shares a word"))
    assert catalogue.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["q_bm25_rollup", "q_bm25_topk", "q_rerank"])
def test_every_question_is_asked(spark, data, duck, name):
    asked = {r[0] for r in duck.execute("SELECT DISTINCT row_id FROM product_claim_mismatch_draft").fetchall()}
    assert {r["question"] for r in catalogue.queries()[name](spark, data).select("question").distinct().collect()} == asked


def test_foreign_rate_asks_every_question(spark, data, duck, tmp_path):
    drafts = duck.execute("SELECT count(DISTINCT row_id) FROM product_claim_mismatch_draft").fetchone()[0]
    rates = catalogue.queries()["q_foreign_rate"](spark, data)
    assert rates.agg({"retrieved": "sum"}).first()[0] >= 10 * drafts
    # a question that names no document finds nothing foreign
    os.symlink(f"{data}/parsed_clause.parquet", tmp_path / "parsed_clause.parquet")
    duck.execute(f"COPY (SELECT * REPLACE (CASE WHEN row_id < 'mismatch-00000010' THEN NULL ELSE document_id END AS document_id) FROM product_claim_mismatch_draft) TO '{tmp_path}/product_claim_mismatch_draft.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for name in ("parsed_clause", "product_claim_mismatch_draft"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(catalogue.oracle_sql()["q_foreign_rate"]).fetchall()
    got = catalogue.queries()["q_foreign_rate"](spark, str(tmp_path)).select("product_line", "retrieved", "foreign_rate").collect()
    assert sorted(map(tuple, got)) == sorted(want)
