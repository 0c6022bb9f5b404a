import numpy as np
import pytest

from millrace.llm import quality as q

PROSE = "Bank podnosi stopę o 3,5% w skali roku, dlatego klient płaci więcej za ten sam kredyt.\nW praktyce rata rośnie do końca umowy."
LIST = "\n".join(f"- lokata Plus {i}" for i in range(30))
TABLE = "\n".join(f"| kurs Max | {i * 37} | {i},5 | 2020 |" for i in range(30))
JUNK = "\n".join("".join(chr(97 + (i * j) % 26) + "A9"[j % 2] for j in range(38)) for i in range(1, 20))


def _docs(spark):
    rows = [(i, t, 1.0, "x") for i, t in enumerate([PROSE, LIST, TABLE, JUNK] * 12)]
    rows += [(100, None, 1.0, "x"), (101, "", 1.0, "x"), (102, " \n ", 1.0, "x"), (103, PROSE + "\n" + TABLE, 1.0, "x"), (104, PROSE.replace("\n", " ") * 400, 1.0, "x"), (104, PROSE, 1.0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, prose_share double, h string")


def test_labels_and_edge_cases(spark):
    df = _docs(spark)
    got = q.statistics(df).collect()
    assert len(got) == df.count()
    rows = {r.doc_id: r for r in got if r.doc_id < 104}
    assert [rows[i][f"{k}_share"] > 0.9 for i, k in enumerate(("prose", "list", "table", "junk"))] == [True] * 4
    assert rows[100].n_words is None and rows[101].n_chars == 0 and rows[101].prose_share is None and rows[102].prose_share is None
    assert rows[103].table_share > 0.6
    found = {r[0] for r in q.no_prose(df).collect()}
    assert found == {i for i in range(48) if i % 4} | {103}
    assert q.no_prose(df.limit(0)).count() == 0


def test_counts_against_plain_python():
    text = "Ala ma 3 koty!\nTo jest: test - naprawdę?\n\n  koniec"
    got = q.line_counts([text, "x \U0001d538\U0001d539"], q.word_hashes(["ma", "ala", "naprawdę", "jest"]))
    c = {n: got.counts[:, i] for i, n in enumerate(q.COUNTS)}
    assert list(got.doc) == [0, 0, 0, 1]
    assert list(c["words"]) == [3, 4, 1, 2] and list(c["numbers"]) == [1, 0, 0, 0] and list(c["ends"]) == [1, 1, 0, 0]
    assert list(c["common"]) == [2, 2, 0, 0] and list(c["short"]) == [1, 0, 0, 1]


#: sentences in languages that the other documents of the corpus aren't written in
OTHERS = {
    "es": "El banco central subió los tipos de interés por tercera vez en el año y los hogares con hipotecas variables pagarán más.\nSegún el informe, la inflación se mantiene por encima de lo previsto, aunque el empleo sigue creciendo en casi todas las regiones.",
    "da": "Regeringen vil næste år ændre reglerne for boliglån, så unge familier får lettere ved at købe deres første bolig på landet.\nØkonomerne er ikke enige om, hvorvidt det vil få priserne til at stige, men de fleste tror på en rolig udvikling.",
    "fr": "Le gouvernement a présenté hier un projet de loi qui doit simplifier les démarches des épargnants et réduire les frais.\nLes associations saluent une avancée, mais elles regrettent que rien ne soit prévu pour les ménages les plus modestes.",
    "cs": "Vláda včera schválila návrh zákona, který má od příštího roku zvýšit příspěvek na bydlení pro rodiny s dětmi.\nPodle ministra to pomůže hlavně lidem ve velkých městech, kde nájmy rostou nejrychleji a mzdy jim nestačí.",
}


def test_prose_of_rare_languages_and_damaged_text(spark):
    rows = [(i, t) for i, t in enumerate([PROSE, LIST, TABLE, JUNK] * 30)]
    rows += [(1000 + i, t) for i, t in enumerate(OTHERS.values())]
    rows += [(2000 + i, t.encode().decode("cp1252", "replace")) for i, t in enumerate((PROSE * 3, OTHERS["cs"]))]
    got = {r.doc_id: r for r in q.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[1000 + i].prose_share > 0.9 for i in range(4)] == [True] * 4
    assert got[2001].prose_share < 0.5
    assert got[0].common_share > 0.5


def test_viterbi_agrees_with_enumeration():
    rng = np.random.default_rng(3)
    model = q.Model(np.log([0.4, 0.3, 0.2, 0.1]), np.log(rng.dirichlet(np.ones(4), 4)), [np.log(rng.dirichlet(np.ones(s), 4)) for s in q.SIZES])
    obs = np.stack([rng.integers(0, s, 9) for s in q.SIZES], axis=1).astype(np.int8)
    doc = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    got = q.viterbi(model, doc, obs)
    emit = model.score(obs)

    def path_score(path, at):
        return model.start[path[0]] + sum(emit[at + i, s] for i, s in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))

    for at, n in ((0, 4), (4, 1), (5, 4)):
        best = max(np.ndindex(*[4] * n), key=lambda p: path_score(p, at))
        assert path_score(best, at) == pytest.approx(path_score(tuple(got[at : at + n]), at))
