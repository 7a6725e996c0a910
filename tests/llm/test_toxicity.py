import random

import duckdb

from queuescope.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_fold():
    table = toxicity._Fold()
    for text, want in [
        ("Idiot", " idiot "), ("1D10T!", " idiot "), ("ｉｄｉｏｔ", " idiot "), ("іdіоt", " idiot "), ("ídïöt", " idiot "),
        ("i​diot", " idiot "), ("$tup!d", " stupid "), ("l0ser 1os3r", " ioser ioser "), ("stupid! ok", " stupid ok "), ("idіot,\n x", " idiot x "),
        ("", "  "), (None, "  "), ("日本 5", " 日本 s "),
    ]:
        assert toxicity.fold(text, table) == want, text


def plain_matches(lexicon, folded):
    out = {}
    safe = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
    for i in range(len(folded)):
        own = [(w, e) for e, w in lexicon.entries.items() if folded.startswith(e, i)]
        if own and not any(a <= i < b - 1 for a, b in safe):
            out[i] = max(w for w, _ in own)
    return out


def test_matches_agree_with_plain_search():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " tra": 1.0, " idiot ": 3.0, " b": 0.5}, (" trash can ",))
    automaton = lexicon.automaton()
    rng = random.Random(1)
    for _ in range(200):
        folded = " " + " ".join(rng.choice(["trash", "can", "idiot", "track", "b", "x", "cab"]) for _ in range(12)) + " "
        got = {s: w for s, _, w in lexicon.matches(folded, automaton)}
        assert got == plain_matches(lexicon, folded)
    assert lexicon.measures(" trash can ", automaton)[0] == 0
    assert lexicon.measures("  ", automaton) == (0, 0, 0.0)


def test_learns_words_stems_and_exceptions_but_not_copies():
    rng = random.Random(4)
    plain = [f"{a}{b}ar" for a in "bcdfg" for b in "aeiou"]

    def text(*extra):
        words = [rng.choice(plain) for _ in range(40)]
        for e in extra:
            words.insert(rng.randrange(len(words)), e)
        return " ".join(words)

    toxic = [text("nasty", "nasty", f"vilex{k % 7}y", f"vilex{k % 5}y") for k in range(40)]
    toxic += [text("rareword")] * 30
    clean = [text() for _ in range(150)] + [text("nasty gale") for _ in range(8)]
    lexicon = toxicity.learn(toxic + clean, [True] * len(toxic) + [False] * len(clean))
    assert " nasty " in lexicon.entries and " viiex" in lexicon.entries
    assert " rareword " not in lexicon.entries
    assert " nasty gaie " in lexicon.exceptions
    automaton, table = lexicon.automaton(), toxicity._Fold()
    points = [lexicon.score(*lexicon.measures(toxicity.fold(t, table), automaton)[1:]) for t in (toxic[0], clean[0], clean[-1])]
    assert points[0] >= 0.7 and max(points[1:]) < 0.5


def test_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, SF).collect()}
    label = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    held = [(r.predicted, label[i]) for i, r in got.items() if r.held_out and i in label]
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert sum(p == y == 1 for p, y in held) / sum(y for _, y in held) > 0.8


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x", 1), (1, None, 2), (1, "", 2), (1, "", 2), (2, "y " * 100_000, 3)], "doc_id int, text string, score int")
    none = spark.createDataFrame([], "doc_id int, toxic int")
    marked = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id int, toxic int")
    for labels in (none, marked):
        lexicon = toxicity.train(docs, labels)
        rows = toxicity.score(docs, lexicon).collect()
        assert len(rows) == 5 and all(0 <= r.score < 0.01 and r.hits == 0 for r in rows)
        assert toxicity.score(docs.limit(0), lexicon).collect() == []


def test_learns_from_whole_texts(spark, monkeypatch):
    start = "alpha beta gamma " * 1500
    rows = [(k, start + " ".join(f"{'zorg' if k % 2 else 'fine'} w{k}x{j}" for j in range(10))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert " zorg " in toxicity.train(docs, labels).entries
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1)
    assert toxicity.train(docs, labels).entries == {}
