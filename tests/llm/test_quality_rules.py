import random
import re

from sourcelode.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def texts():
    rnd = random.Random(7)
    out = [None, "", " \t\n", "a", "a\n\na\n \n", "x " * 40, "the # of $ <b>", "é b c\x0bd\re"]
    for n in (8, 9, 30, 200, 3000):
        out.append(" ".join(rnd.choice(["a", "b", "the", "Cé", "|", "dd\n", "e\tf"]) for _ in range(n)))
    block = " ".join(f"w{i}" for i in range(12))
    return [*out, f"{block} x {block} y {block}", f"{block}\n{block}", " ".join(f"u{i}" for i in range(400))]


def test_counts_against_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(None, "null id", None, None), (3, "a", "copy", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_words int")
    got = q.quality_rules(docs).collect()
    want = sorted(((i is not None, i or 0, *brute(t)) for i, t, _, _ in rows))
    assert want == sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_clean_prose_is_kept_and_junk_is_not(spark):
    clean = "The house of the mayor is on a hill and it was built for the people that live in the town near the river. " "They say that it is as old as the church."
    junk = "Foo*** bar$$$ baz### the&&& of%%% " * 10
    got = {r.doc_id: r.kept for r in q.quality_rules(spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_empty_table_and_no_user_functions(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = q.quality_rules(docs)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
