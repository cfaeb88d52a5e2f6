import random
import re

import numpy as np
import pyarrow.parquet as pq

from clausemill.llm import personal, scan_repair, subjects
from clausemill.llm.personal_training import MARKED, RULES, UNMARKED, alternatives, carrier, fold, training_texts

WORDING = ["o segurado deverá comunicar o sinistro à seguradora no prazo contratado", "a franquia consta do quadro-resumo entregue ao titular", "o guincho seguirá até a oficina referenciada mais próxima"]


def clean_rows():
    return [(f"c{i}", f"d{i}", "Casa Seguros S.A.", "\n".join([*(w.capitalize() + "." for w in WORDING), f"Texto {i}."])) for i in range(12)]


def test_scan_lines(spark):
    text = "O segurado deverá cornunicar o sin-\nistro à seguradora no prazo contratad0. A franquia consta do quadro-\nCasa Seguros S.A.  3\n- 4 -\nresumo entregue ao titular."
    rows = [("s1", "x1", "Casa Seguros S.A.", text), ("s1", "x1", "Casa Seguros S.A.", text), ("s2", "x2", "", ""), ("s3", "x2", None, None), (None, "x2", None, text)]
    schema = "k string, doc string, owner string, text string, kinds int"
    scanned = spark.createDataFrame([(*r, 1) for r in rows], schema)
    clean = spark.createDataFrame([(*r, 1) for r in clean_rows()], schema)
    got = {r["k"]: r for r in scan_repair.repair(scanned, clean, "k", "doc", "owner", "text").collect()}
    assert set(got) == {"s1", "s2", "s3"} and got["s2"]["repaired"] == "" and got["s3"]["repaired"] is None
    kinds = {(x["line_no"], x["kind"]) for x in got["s1"]["kinds"]}
    assert kinds == {(0, "misread"), (0, "split_word"), (1, "misread"), (2, "furniture"), (3, "furniture")}
    assert got["s1"]["repaired"] == "O segurado deverá comunicar o sinistro à seguradora no prazo contratado. A franquia consta do quadro-resumo entregue ao titular."
    assert scan_repair.repair(scanned.where("false"), clean.where("false"), "k", "doc", "owner", "text").count() == 0


def scanned_rows(n):
    """Clauses with planted damage, and what was planted: (id, line_no, kind)."""
    rng = random.Random(4)
    nouns = ["veículo", "segurado", "contrato", "sinistro", "guincho", "documento", "pagamento", "reboque"]
    verbs = ["comunicará", "apresentará", "registrará", "suspenderá"]
    say = lambda: f"o {rng.choice(nouns)} {rng.choice(verbs)} o {rng.choice(nouns)} ao {rng.choice(nouns)} indicado"
    clean = [(f"c{i}", f"d{i}", "Casa Seguros S.A.", ". ".join(say() for _ in range(4))) for i in range(60)]
    rows, planted = [], set()
    for i in range(n):
        lines = []
        for no in range(6):
            words = say().split()
            kind = rng.choice(["plain", "misread", "furniture", "split"])
            if kind == "misread":
                at = rng.choice([k for k, w in enumerate(words) if "m" in w or "d" in w and len(w) > 3])
                words[at] = words[at].replace("m", "rn", 1) if "m" in words[at] else words[at].replace("d", "cl", 1)
                planted.add((f"s{i}", no, "misread"))
            if kind == "furniture":
                words = rng.choice([["Casa", "Seguros", "S.A.", str(no)], ["Página", str(no), "de", "9"], ["Folheto", "Azul", "Rev.", str(no)]])
                planted.add((f"s{i}", no, "furniture"))
            if kind == "split" and no < 5:
                words = [*words[:-1], "regu-"]
                lines.append(" ".join(words))
                planted.add((f"s{i}", no, "split_word"))
                continue
            if lines and lines[-1].endswith("regu-") and kind != "furniture":
                words = ["lamento", *words]
            lines.append(" ".join(words))
        if lines[-1].endswith("regu-") or any(x.endswith("regu-") and (k + 1 == len(lines) or not lines[k + 1].startswith("lamento")) for k, x in enumerate(lines)):
            planted = {p for p in planted if p[0] != f"s{i}"}
            continue
        rows.append((f"s{i}", f"x{i}", " CASA seguros S.A.", "\n".join(lines)))
    clean += [(f"r{i}", f"r{i}", "Casa Seguros S.A.", f"o regulamento {i} vale") for i in range(4)]
    return rows, clean, planted


def test_planted_damage_is_found(spark):
    """Whether the answers are broadcast or joined by text, and however often the clean texts are given."""
    rows, clean, planted = scanned_rows(60)
    schema = "k string, doc string, owner string, text string"
    scanned, right = spark.createDataFrame(rows, schema), spark.createDataFrame(clean, schema)
    twice = right.unionByName(right.selectExpr("concat('again', k) as k", "concat('again', doc) as doc", "owner", "text"))
    found = []
    for texts, bound in ((right, 1000), (right, 0), (twice, 1000)):
        got = scan_repair.repair(scanned, texts, "k", "doc", "owner", "text", broadcast_rows=bound).collect()
        found.append({(r["k"], x["line_no"], x["kind"]) for r in got for x in r["kinds"]})
    assert found[0] == found[1] == found[2]
    assert len(found[0] & planted) >= 0.97 * len(planted) and len(found[0] & planted) >= 0.97 * len(found[0])


def test_words_and_pairs_beyond_what_is_broadcast_count(spark, monkeypatch):
    rows, clean, _ = scanned_rows(25)
    clean += [(f"w{i}", f"w{i}", None, f"o dia mai vem {i} e depois mai vem {i}") for i in range(6)] + [(f"v{i}", f"v{i}", None, f"ele passa mal hoje {i}") for i in range(4)]
    rows += [("pair", "xp", None, "ele passa ma1 hoje")]
    schema = "k string, doc string, owner string, text string"
    scanned, right = spark.createDataFrame(rows, schema), spark.createDataFrame(clean, schema)
    found = []
    for common, bound in ((30_000, 1000), (1, 1000), (1, 0), (30_000, 0)):
        monkeypatch.setattr(scan_repair, "COMMON_WORDS", common)
        got = scan_repair.repair(scanned, right, "k", "doc", "owner", "text", pair_rows=bound).collect()
        found.append({(r["k"], r["repaired"], *((x["line_no"], x["kind"]) for x in r["kinds"])) for r in got})
    assert found[0] == found[1] == found[2] == found[3]
    assert ("pair", "ele passa mal hoje", (0, "misread")) in found[0]


def test_parts_of_the_vocabulary_answer_as_one_trie_does(spark):
    words = ["segurado", "segurada", "sinistro", "comunicar", "mão-de-obra", "ano", "reboque", "dano", "rebocado", "outro"]
    tokens = ["scgurado", "5inistro", "cornunicar", "mâo-dc-obra", "an0", "rebogue", "clano", "0utro", "xutro", "segurado", "reb0qu3"]
    vocabulary = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    forms = spark.createDataFrame([(t,) for t in tokens], "form string")
    trie = scan_repair.Trie(words)
    want = {}
    for t in tokens:
        got = scan_repair.candidates_in(trie, t)
        low = min((g[0] for g in got), default=0)
        if t not in words and got:
            want[t] = {(c, w) for tier, c, w in got if tier == low}
    for part_words in (40_000, 0.02):
        out = {r["form"]: r for r in scan_repair.answers_for(forms, vocabulary, part_words).collect()}
        assert out.pop("segurado")["known"] and {f: {(c["cost"], c["word"]) for c in r["cands"]} for f, r in out.items()} == want


def test_trie_finds_all_words_within_the_distance():
    import random

    rng = random.Random(1)

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(200)})
    trie = scan_repair.Trie(words)
    for _ in range(150):
        token, distance = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))), rng.randint(0, 3)
        assert sorted(trie.within(token, distance)) == [w for w in words if far(w, token) <= distance]


def test_known_misreadings():
    assert scan_repair.explained("comum", "cornum") == 1
    assert scan_repair.explained("data", "clat@") == 2
    assert scan_repair.explained("casa", "cosa") is None


def test_personal_on_held_out_carriers():
    """No alternative of a rule of four or more is in both parts, so no carrier of the texts below was trained on."""
    assert all(not set(alternatives(r, False)) & set(alternatives(r, True)) for r, every in RULES.items() if len(every) > 3)
    model = personal.trained()
    lexicon = personal.Lexicon(*personal.case_counts([t for t, _ in training_texts(2000, seed=99, held_out=True)[0]]))
    right = wrong = missed = 0
    for text, spans in training_texts(300, seed=99, held_out=True)[0]:
        got = {(s, k) for s, _, k in personal.details(text, model, lexicon)}
        want = {(s, k) for s, _, k in spans}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert 2 * right / (2 * right + wrong + missed) > 0.9


def test_no_training_sentence_stands_in_the_tables(data):
    tables = []
    for name, column in (("claim", "raw_text"), ("product_claim_mismatch", "narrative"), ("product_claim_mismatch_draft", "narrative"), ("parsed_clause", "text"), ("documents", "text")):
        tables += pq.read_table(f"{data}/{name}.parquet", columns=[column])[column].to_pylist()
    said = "\n".join(fold(t) for t in tables if t)
    rng = random.Random(3)
    carriers = {carrier(rng, r, part) for r in {*MARKED, *UNMARKED} for part in (False, True) for _ in range(400)}
    parts = {p for c in carriers for p in re.split(r"\{\w+\}", fold(c).replace("number}", "n}")) if len(p) >= 18}
    assert len(parts) > 500
    # pieces of a carrier between its slots, and carriers of 18 or more fixed characters with their slots open
    assert not [p for p in parts if p in said]
    whole = [c for c in carriers if len(re.sub(r"\{\w+\}", "", c)) >= 18 and "{" in c]
    lines = set(re.split(r"(?<=[.!?:])\s+|\n", said))
    for c in whole:
        head = fold(c.split("{")[0])
        pattern = re.compile(r".{1,60}".join(map(re.escape, re.split(r"\{\w+\}", fold(c)))))
        assert not [x for x in lines if head in x and pattern.search(x)]


def test_personal_rows(spark):
    texts, _ = training_texts(200, seed=5)
    rows = [(str(i), t) for i, (t, _) in enumerate(texts)] + [("x", None), ("y", ""), ("z", "Meu e-mail é ana.costa@mail.example."), ("z", "Meu e-mail é ana.costa@mail.example.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, text string, bias int")
    out = personal.find_personal(df, "text").collect()
    by = {r["k"]: r for r in out}
    assert len(out) == len(rows) and by["x"]["redacted"] is None and by["x"]["details"] == [] and by["y"]["redacted"] == ""
    assert by["z"]["redacted"] == "Meu e-mail é [EMAIL]." and by["z"]["details"][0]["start_pos"] == 13
    assert personal.find_personal(df.where("false"), "text").count() == 0


def test_best_segmentation_is_the_greatest():
    weights = {"x": {"f": {"a": 2.0, "b": 3.0}}, "y": {"f": {"c": 2.5, "a": 2.0}, "p1": {"um": -9.0}}}
    model = personal.SegmentModel(weights)
    segments = [(0, 5, "x", [("f", "a")], 0, 0), (3, 8, "x", [("f", "b")], 1, 1), (8, 9, "y", [("f", "c")], 2, 2), (5, 8, "y", [("f", "a")], 1, 1)]
    assert [s[:2] for s in model.best(segments, ["^", "^", "^"])] == [(0, 5), (5, 8), (8, 9)]
    assert [s[:2] for s in model.best(segments, ["um", "dois", "tres"])] == [(3, 8), (8, 9)]
    chance = personal._marginals(segments, model.scores(segments, ["^", "^", "^"]))
    assert all(0 < p < 1 for p in chance) and chance[1] + chance[0] < 1


def test_subjects(spark):
    ends = [a + b for a in "bcdfgl" for b in "aeiou"]
    words = {area: " ".join(f"{stem}{e}" for e in ends) for area, stem in (("mar", "navi"), ("terra", "trat"), ("ar", "avio"), ("fogo", "bras"), ("gelo", "neva"))}
    rows, labels, n = [], [], 0
    for area, said in words.items():
        w = said.split()
        for i in range(120):
            n += 1
            said = " ".join(f"O {w[(i * 7 + k) % 30]} depende do {w[(i + 11 * k) % 30]}." for k in range(5))
            rows.append((n, f"{said} O arquivo foi recebido e numerado hoje.", 1))
            if i % 4 == 0:
                labels.append((n, area))
    rows += [(9001, None, 1), (9002, "", 1), (9003, "  \n", 1), (9004, "O arquivo foi recebido e numerado hoje.", 1), (9005, "O naviba e o navica. O tratba e o tratca.", 1), (9005, "O naviba e o navica.", 1)]
    df = spark.createDataFrame(rows, "k long, text string, sentences int")
    shares = subjects.subject_shares(df, spark.createDataFrame(labels + [(None, "mar"), (1, None)], "k long, area string"), "k", "text", "area")
    got = {}
    for r in shares.where("sentences * 5 >= of_sentences").collect():
        got.setdefault(r["k"], set()).add(r["area"])
    assert sum(got.get(k) == {list(words)[(k - 1) // 120]} for k in range(1, 601)) >= 570
    assert not {9001, 9002, 9003, 9004} & set(got) and got[9005] == {"mar", "terra"}
    none = subjects.subject_shares(df, spark.createDataFrame([], "k long, area string"), "k", "text", "area")
    assert none.count() == 0
    assert subjects.repaired("aÃ§Ã£o <b>x</b> &amp; y") == "ação  x  & y"


def test_areas_come_from_the_leaves(spark, monkeypatch):
    """With every leaf named after another one, the areas are wrong: nothing but the leaves decides."""
    words = {area: [f"{stem}{a}{b}" for a in "bcdfgl" for b in "aeiou"] for area, stem in (("mar", "navi"), ("terra", "trat"), ("ar", "avio"))}
    rows = [(100 * k + i, " ".join(f"O {w[(i * 7 + j) % 30]} depende do {w[(i + 11 * j) % 30]}." for j in range(5))) for k, w in enumerate(words.values()) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, text string")
    labels = spark.createDataFrame([(k, list(words)[k // 100]) for k, _ in rows if k % 5 == 0], "k long, area string")

    def right() -> int:
        got = subjects.subject_shares(df, labels, "k", "text", "area").where("sentences * 5 >= of_sentences").collect()
        return sum(r["area"] == list(words)[r["k"] // 100] for r in got)

    assert right() >= 285
    named = subjects.name_leaves
    monkeypatch.setattr(subjects, "name_leaves", lambda *a: np.roll(named(*a), 1, axis=1))
    assert right() < 30


def test_leaves_shared_by_two_areas_are_told_apart():
    mixtures = np.array([[1, 0, 0], [0, 1, 0], [0.5, 0.5, 0], [0.4, 0.6, 0]])
    areas = np.array([[1, 0], [0, 1], [1, 1], [1, 1]])
    names = subjects.name_leaves(mixtures, areas)
    assert names[0, 0] > 0.95 and names[1, 1] > 0.95 and names[2].sum() == 0


def test_terms_are_cut_by_sentence():
    term, last, per_text, terms_of = subjects.cut_terms(["", "Um dois. Dois três!\n\nx 1 2\nUm dois", "9", "quatro"])
    assert per_text.tolist() == [0, 3, 0, 1] and terms_of.tolist() == [0, 9, 0, 1] and last.tolist() == [3, 6, 9, 10]
    assert term[0:3].tolist() == term[6:9].tolist() and len(set(term.tolist())) == 6
    assert subjects.cut_terms([""])[0].tolist() == [] and subjects.cut_terms(["9", ""])[2].tolist() == [0, 0]


def test_clusters_are_fitted_on_every_document(spark, monkeypatch):
    seen = []

    class Watched(subjects.BisectingKMeans):
        def fit(self, dataset, params=None):
            seen.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(subjects, "BisectingKMeans", Watched)
    spoken = "concat_ws(' ', 'navio', concat('mar', substr('abcdefghij', 1 + id % 10, 1)), concat('rio', substr('klmnopqrst', 1 + id div 10 % 10, 1)))"
    df = spark.range(16_000).selectExpr("id as k", f"if(id < 15990, {spoken}, '12 34') as text")
    _, leaves = subjects.fit_mixtures(subjects._cut(df, "k", "text"), 2)
    assert seen == [15_990] and leaves == 2
