import math
from collections import Counter

import pytest

from sparkdex.functions.analyzer import Analyzer
from sparkdex.functions.spanish_stemmer import stem

DOCS = ["El gato negro duerme", "El perro negro", "", "gato gato perro", "El perro negro", "Música y poesía", "MUSICA", "el foo-bar 3er"]


@pytest.mark.parametrize(
    "word, want",
    [("corriendo", "corr"), ("bibliotecas", "bibliotec"), ("rapidamente", "rapid"), ("cheque", "chequ"), ("recetas", "recet"), ("canciones", "cancion"), ("comprando", "compr"), ("nacionalidad", "nacional"), ("torre", "torr"), ("el", "el"), ("", "")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_spanish_profile():
    a = Analyzer("spanish")
    assert a.terms("¡El GATO, y las bibliotecas!") == ["gat", "bibliotec"]
    assert a.terms("foo-bar 3er d'or él más") == ["mas"]  # accented stop-words stay, whole tokens must be letters; "él" folds to a stop-word
    assert a.terms("") == a.terms(None) == []


def brute(docs, query, k):
    a = Analyzer("simple")
    tf = [Counter(a.terms(d)) for d in docs]
    df = Counter(t for c in tf for t in c)
    q = {t: (1 + math.log10(n)) * math.log10(len(docs) / df[t]) for t, n in Counter(a.terms(query)).items() if t in df}
    qn = math.sqrt(sum(v * v for v in q.values()))
    if not qn:
        return []
    out = []
    for i, c in enumerate(tf):
        if any(t in c for t in q):
            norm = math.sqrt(sum((1 + math.log10(n)) ** 2 for n in c.values()))
            s = sum(q[t] * (1 + math.log10(c[t])) * math.log10(len(docs) / df[t]) for t in q if t in c) / (qn * norm)
            out.append((round(s, 6), i))
    return [i for _, i in sorted(out, reverse=True)[:k]]


def test_ranking_matches_brute_force(engine):
    engine.sql("CREATE TABLE d (id INT, txt VARCHAR[60])")
    engine.insert("d", list(enumerate(DOCS)))
    engine.create_fts("d", ["txt"], "simple")
    for q in ("gato", "perro negro", "el", "musica poesia gato", "gato gato perro", "nada", "", "¿?"):
        r = engine.sql(f"SELECT id FROM d WHERE txt @@ '{q}' LIMIT 4")[0]
        assert [row[1] for row in r.rows()] == brute(DOCS, q, 4), q
    assert r.used_index == {"type": "FTS", "column": "txt"} and r.columns == ["score", "id"]
    engine.sql("INSERT INTO d VALUES (8, 'otro gato blanco')")  # the index follows
    assert 8 in [row[1] for row in engine.sql("SELECT id FROM d WHERE txt @@ 'gato'")[0].rows()]
    engine.sql("DELETE FROM d WHERE id = 3")
    assert 3 not in [row[1] for row in engine.sql("SELECT id FROM d WHERE txt @@ 'gato'")[0].rows()]


def test_one_index_over_several_columns(engine):
    engine.sql("CREATE TABLE m (a VARCHAR[20], b VARCHAR[20], n INT); INSERT INTO m VALUES ('rojo', 'verde', 1), ('azul', NULL, 2), ('verde', 'gris', 3)")
    engine.sql("CREATE FTS INDEX ON m(a, b)")
    assert [r[1] for r in engine.sql("SELECT n FROM m WHERE a @@ 'verde'")[0].rows()] == [3, 1]
    score = engine.sql("SELECT n FROM m WHERE b @@ 'azul'")[0].rows()[0][0]
    assert score == f"{math.log10(3) * math.log10(3) / math.log10(3):.6f}"


def test_empty_corpus(engine):
    engine.sql("CREATE TABLE z (a VARCHAR[5])")
    engine.sql("CREATE FTS INDEX ON z(a)")
    assert engine.sql("SELECT * FROM z WHERE a @@ 'x'")[0].rows() == []
