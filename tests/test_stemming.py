"""Words and stems of the published sample vocabulary."""

import pytest

from clausemill.functions.stemming import stem, stem_terms

SAMPLE = """
boa boa / boainain boainain / boas boas / boataria boat / boate boat / boates boat / boatos boat / bob bob / boba bob / bobagem bobag
bobagens bobagens / bobear bob / bobeira bobeir / bobinho bobinh / bobo bob / bobs bobs / boca boc / bocadas boc / bocadinho bocadinh
bocado boc / boçal boçal / bocarra bocarr / bode bod / bodoque bodoqu / body body / boemia boem / boêmio boêmi / bogotá bogot / boi boi
boiando boi / quiabo quiab / quicaram quic / quickly quickly / quieto quiet / quilate quilat / quilinhos quilinh / quilo quil
quilométricas quilométr / quilométricos quilométr / quilômetro quilômetr / química químic / químicos químic / quimioterapia quimioterap
quinhão quinhã / quinhentos quinhent / quintal quintal / quintessência quintessent / quintuplicou quintuplic / quinze quinz / quiosque quiosqu
""".replace("\n", " / ").split("/")


@pytest.mark.parametrize("pair", [p.split() for p in SAMPLE if p.strip()])
def test_sample(pair):
    assert stem(pair[0]) == pair[1]


def test_terms(spark):
    df = spark.createDataFrame([(1, "coberturas"), (2, "coberturas"), (3, "sinistro"), (4, None)], "k int, term string")
    got = {r["k"]: r["stem"] for r in stem_terms(df, "term", ["sinistro"]).collect()}
    assert got == {1: "cobertur", 2: "cobertur", 3: "sinistro", 4: None}
