import re
import unicodedata
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as some

from clausemill.llm.repeated_lines import excess_lines, line_keys, step_up, without_excess
from clausemill.llm.splitting import cut, item_tree, pieces


def norm(line):
    line = "".join(c for c in unicodedata.normalize("NFD", line.lower()) if not unicodedata.combining(c))
    line = re.sub(r"\s+", " ", re.sub(r"\d+", "#", line))
    return re.sub(r"^[^a-z0-9#]+|[^a-z0-9#]+$", "", line)


@settings(max_examples=150, deadline=None)
@given(some.lists(some.text(alphabet="aÁb 1#\n\t -é́ ", max_size=30), min_size=1, max_size=4))
def test_line_keys_follow_the_definition(texts):
    of, no, one, two = line_keys(texts, 3)
    got = {(int(a), int(b)): (int(c), int(d)) for a, b, c, d in zip(of, no, one, two)}
    want = {(i, j): norm(x) for i, t in enumerate(texts) for j, x in enumerate(t.split("\n")) if len(norm(x)) >= 3}
    assert set(got) == set(want)
    by = defaultdict(set)
    for k, v in want.items():
        by[v].add(got[k])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_found_and_removed(spark):
    notice = "Este material é de uso exclusivo da casa 12."
    rows = [(f"a{i}", "s1", f"texto único número {chr(97 + i) * 20}\n{notice.upper() if i % 2 else notice}\nfim") for i in range(10)]
    rows += [(f"b{i}", "s2", f"outro escrito diferente {chr(97 + i) * 20}\ntodas as casas dizem isto aqui") for i in range(9)]
    rows += [rows[0], ("n", None, notice), (None, "s1", notice), ("e", "s1", ""), ("z", "s1", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, source string, text string, n_within int")
    found = excess_lines(df, "id", "source", "text", min_docs=8)
    got = {(r["id"], r["line_no"]) for r in found.collect()}
    assert got == {(f"a{i}", 1) for i in range(10)} | {(f"b{i}", 1) for i in range(9)}
    assert {r["excess"] for r in found.collect()} == {True} and {r["scope"] for r in found.collect()} == {"source"}
    out = without_excess(df, "id", "text", found).collect()
    clean = {r["id"]: r["text"] for r in out}
    assert len(out) == len(rows) - 1 and clean[None] == notice and clean["n"] == notice
    assert clean["a0"] == "texto único número " + "a" * 20 + "\nfim" and clean["e"] == "" and clean["z"] is None
    assert excess_lines(df.where("false"), "id", "source", "text").count() == 0


def test_lines_at_the_usual_rate_are_rejected(spark):
    """Where every line stands in 8 documents of each of three sources, none is in excess; a notice that one source
    alone adds to 12 of its documents is, and so is one that all sources repeat far beyond the others."""
    say = lambda n: "a linha comum que se chama " + chr(97 + n % 26) * 9 + chr(97 + n // 26) * 9
    rows = []
    for source in range(3):
        for doc in range(64):
            lines = [say((doc + step) % 64) for step in (0, 1, 3, 7, 12, 20, 30, 44)]
            lines += ["aviso que somente uma casa escreve"] if source == 0 and doc < 12 else []
            lines += ["aviso que todas as casas escrevem"]
            rows.append((f"{source}-{doc}", f"s{source}", "\n".join(lines)))
    df = spark.createDataFrame(rows, "id string, source string, text string")
    found = excess_lines(df, "id", "source", "text", min_docs=8).collect()
    text = {r[0]: r[2].split("\n") for r in rows}
    said = {(text[r["id"]][r["line_no"]], r["scope"], r["excess"]) for r in found}
    assert {x for x in said if x[2]} == {("aviso que somente uma casa escreve", "source", True), ("aviso que todas as casas escrevem", "shared", True)}
    assert {x[0] for x in said if not x[2]} == {say(n) for n in range(64)}


def test_step_up_is_the_textbook_rule():
    assert step_up({}, 0.05, 0) == 8001
    assert step_up({400: 1, 0: 1}, 0.05, 2) == 400
    assert step_up({0: 5}, 0.05, 5) == 8001
    assert step_up({400: 1}, 0.05, 10_000) == 8001  # a ratio of 20 is no surprise among ten thousand candidates


@settings(max_examples=200, deadline=None)
@given(some.text(alphabet="ab.; \n-)•c", max_size=400), some.integers(20, 60))
def test_pieces_cover_the_text(text, limit):
    overlap = limit // 6
    got = cut(text, limit, overlap)
    at = 0
    for start, own, end, rule in got:
        assert start <= own <= end and end - start <= limit and (at == 0 or at - start <= overlap)
        assert text[at:own].strip() == ""
        at = end
    assert text[at:].strip() == ""


def test_rules(spark):
    item = "\n".join(f"a) {'palavra ' * 30}" for _ in range(20))
    plain = "frase curta. " * 400
    mixed = "a) x\n" + "frase curta. " * 400 + "\nb) fim"
    rows = [("i", item, 1), ("i", item, 1), ("p", plain, 2), ("m", mixed, 3), ("s", "curto", 4), ("n", None, 5), (None, plain, 6), ("b", "x" * 9000, 7)]
    out = pieces(spark.createDataFrame(rows, "id string, text string, piece int"), "id", "text", []).toPandas()
    rules = out.groupby("id")["rule"].agg(set).to_dict()
    assert rules["i"] == {"item"} and rules["p"] == {"window"} and rules["b"] == {"window"} and "window" in rules["m"]
    assert set(rules) == {"i", "p", "m", "b"} and out.piece.str.len().max() <= 3000
    late = out[(out.id == "p") & (out.piece_no > 0)]
    assert (late.own_start > late.start_pos).all()


def test_subtrees_that_fit_stay_whole():
    """Bullets nest under their letter: the second letter's subtree goes into one piece, not into the room left."""
    one, two = "a) " + "x" * 40, "b) " + "y" * 20
    text = "\n".join([one, two, "- " + "p" * 20, "- " + "q" * 20, "c) " + "z" * 60])
    root = item_tree(text)
    assert [len(n.children) for n in root.children] == [0, 2, 0]
    got = [(text[s:e], r) for _, s, e, r in cut(text, 80, 10)]
    assert [r for _, r in got] == ["item"] * 3 and got[1][0].startswith("b)") and got[1][0].endswith("q" * 20)
    # numbered headings are cut before sentences are
    head = "1 Um\n" + "aaa. " * 12 + "\n1.1 Dois\n" + "bbb. " * 12 + "\n2 Tres\n" + "ccc. " * 12
    assert [head[s:e].split("\n")[0] for _, s, e, _ in cut(head, 90, 10)] == ["1 Um", "1.1 Dois", "2 Tres"]


def test_deep_nesting_and_many_items():
    text = "\n".join(("a) x" if i % 2 else "- y") for i in range(6000))
    got = cut(text, 3000, 300)
    assert all(r == "item" and e - s <= 3000 for s, _, e, r in got) and got[-1][2] == len(text)
