import random
import zlib

import numpy as np
import pyarrow as pa

from tabulon.llm import toxicity as tox


def corpus(n=400):
    rng = random.Random(2)
    w = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(w) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "Moron!", "zorgle" + rng.choice(["x", "yy"])]))
        rows.append((i, " ".join(text), "en", 0.5))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_columns(spark):
    rows, labels = corpus()
    rows += [(900, None, "en", 0.0), (901, "", "en", 0.0), (None, "idiot", "en", 0.0), (3, rows[3][1], "en", 0.0)]
    got = tox.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels + [(None, 1, 1), (901, 0, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (sorted(tox.score(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert one == two


def test_clause_patterns():
    def marks(text):
        kinds = {w: k for k, words in tox.LEXICON.items() for w in words.split()}
        return tox.clause_patterns([kinds.get(w, tox.OTHER) for w in text.split()])

    assert marks("what an idiot") == [(tox.INSULT, 0)]
    assert marks("you are an idiot") == [(tox.INSULT, tox.TARGETED)]
    assert marks("an idiot like you") == [(tox.INSULT, tox.TARGETED)]
    assert marks("this is not stupid") == [(tox.INSULT, tox.NEGATED)]
    assert marks("this is not at all in any way stupid") == [(tox.INSULT, 0)]
    assert marks("somebody said this one and that one is trash") == [(tox.INSULT, tox.REPORTED)]
    assert marks("it said you are no idiot") == [(tox.INSULT, tox.TARGETED | tox.NEGATED | tox.REPORTED)]
    assert marks("i will kill you") == [(tox.THREAT, tox.TARGETED)]
    assert marks("nothing here") == []


def test_clauses_end_at_marks_and_texts():
    counts = tox.Grammar([]).counts(pa.array(["never. idiot", "never idiot", None, "you", "idiot"]))
    at = lambda *p: tox.PATTERNS.index(p)
    assert counts[0, at(tox.INSULT, 0)] == 1 and counts[1, at(tox.INSULT, tox.NEGATED)] == 1
    assert counts[2].sum() == counts[3].sum() == 0 and counts[4, at(tox.INSULT, 0)] == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tox.score(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    got = tox.score(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), none).collect()
    assert sorted((r.doc_id, r.predicted) for r in got) == [(1, 1), (2, 0)]


def found(text):
    counts = tox.Grammar([]).counts(pa.array([text]))[0]
    return {p: int(n) for p, n in zip(tox.PATTERNS, counts, strict=True) if n}


def test_reported_speech_negation_and_threats_in_sentences():
    T, N, R = tox.TARGETED, tox.NEGATED, tox.REPORTED
    assert found("He said: you are an idiot") == {(tox.INSULT, T | R): 1}
    assert found("you are an idiot, he said") == {(tox.INSULT, T | R): 1}
    assert found("\"You are an idiot\", she wrote") == {(tox.INSULT, T | R): 1}
    assert found("“You are an idiot!” she wrote.") == {(tox.INSULT, T | R): 1}
    assert found("She wrote “he left” and you are an idiot") == {(tox.INSULT, T): 1}
    assert found("I said you are an idiot") == {(tox.INSULT, T): 1}
    assert found("you are an idiot, I told everyone") == {(tox.INSULT, T): 1}
    assert found("you aren’t an idiot") == found("you aren't an idiot") == {(tox.INSULT, T | N): 1}
    assert found("I will kill the process you started") == {(tox.THREAT, 0): 1}
    assert found("you kill the process") == {(tox.THREAT, 0): 1}
    assert found("I will hurt your family: idiot") == {(tox.THREAT, T): 1, (tox.INSULT, 0): 1}
    assert found("you stupid pathetic idiot") == {(tox.INSULT, T): 1}


def brute_patterns(classes):
    """The same rules as regular expressions over a letter for each symbol."""
    import re

    text = "".join("oitgnrsalp:()"[c] for c in classes)
    out = []
    for i, c in enumerate(text):
        if c not in "itl" or (c in "il" and i and text[i - 1] in "il"):
            continue
        before, after, marks = text[:i], text[i + 1 :], 0
        elsewhere = c == "t" and after.startswith("a")
        near = r"g[^:()]{0,3}$"
        if re.search(near, before) and not elsewhere:
            marks |= tox.TARGETED
        if re.match(r"[^:()a]{0,3}g" if c == "t" else r"[^:()]{0,3}g", after):
            marks |= tox.TARGETED
        if re.search(r"n[^:()]{0,3}$", before):
            marks |= tox.NEGATED
        if re.fullmatch(rf"(?:[^r]|(?<=s)r|(?<!s)r[^(]*\([^)]*\))*(?<!s)r(?:[^(]*|[^(]*\([^)]*)", before):
            marks |= tox.REPORTED
        for m in re.finditer(r"(?=([p)])[^p):(rs]{0,2}r)", after):
            ahead = after[: m.start()]
            if m[1] == ")":
                good = "(" not in ahead
            elif ")" in ahead:
                at = ahead.rindex(")")
                good = not set(ahead[at:]) & set(":(") and "(" not in ahead[:at]
            else:
                good = not set(ahead) & set(":(")
            if good:
                marks |= tox.REPORTED
        out.append(({"i": tox.INSULT, "t": tox.THREAT, "l": tox.LEARNED}[c], marks))
    return out


def test_machines_against_regular_expressions():
    rng = random.Random(7)
    for _ in range(6000):
        tape = [rng.choice(range(13)) for _ in range(rng.randint(0, 14))]
        assert tox.clause_patterns(tape) == brute_patterns(tape), tape


def test_very_long_texts_and_composition():
    long = "word " * 200_000 + "you are an idiot"
    assert found(long) == {(tox.INSULT, tox.TARGETED): 1}
    rng = random.Random(1)
    a, b = tox._reach(tox.NEGATION, tox.NEGATED, (tox.INSULT,)), tox._phrase()
    for _ in range(200):
        tape = [rng.choice(range(13)) for _ in range(12)]
        assert (a @ b)(tape) == a(b(tape))


def test_marks_decide_where_words_do_not(spark):
    rng = random.Random(5)
    filler = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 20)))
    word = lambda: rng.choice("idiot moron fool clown".split())
    bad = [lambda: f"you are such a {word()}", lambda: f"what a {word()} you are"]
    fine = [lambda: f"he said: you are such a {word()}", lambda: f"you are not a {word()}", lambda: f"“you are a {word()}”, she wrote", lambda: f"a {word()}"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        rows.append((i, f"{filler()}. {rng.choice(bad if toxic else fine)()}. {filler()}."))
        labels.append((i, 1, toxic))
    got = tox.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r.predicted == r.doc_id % 2 for r in got if r.held_out]
    assert len(held) > 80 and np.mean(held) > 0.97
