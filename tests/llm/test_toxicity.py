import random
from itertools import product

import pyarrow as pa
from pyspark.sql import functions as F

from entitylink.llm import toxicity as T
from tests.llm.helpers import awkward, documents

WORDS = "the of and to that with for this are from was have".split()


def corpus(n=500, seed=3):
    """Texts of one invented insult ("zorg") among others; every tenth label is wrong."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(1000, 1000 + n):
        own = [rng.choice(WORDS) + rng.choice(["", "a", "b", "c"]) for _ in range(40)]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(40), rng.choice(["zorg", "idiot"]))
        rows.append((k, " ".join(own) + "."))
        labels.append((k, int(toxic != (rng.random() < 0.05))))
    return rows, labels


def test_composition_runs_all_machines():
    machines = [T.INSULT, T.THREAT, T.TARGET, T.NEGATION, T.REPORT]
    table, outputs = T.composed(machines)
    for word in product(T.CLASSES, repeat=4):
        state, alone = 0, [m.start for m in machines]
        for c in word:
            want = []
            for k, m in enumerate(machines):
                alone[k], out = m.step(alone[k], c)
                want.append(out)
            at = T.CLASSES.index(c)
            assert outputs[state][at] == tuple(want)
            state = table[state][at]


def test_patterns_of_clauses():
    words = T.lexicon(T.hashes_of([]))

    def patterns(text):
        counts = T.pattern_counts(pa.array([text]), words)[0]
        return {T.PATTERNS[k]: int(c) for k, c in enumerate(counts) if c}

    assert patterns("what an IDIOT, he") == {("insult", False, False, False): 1, ("aimed",): 1}
    assert patterns("you are a moron") == {("insult", True, False, False): 1}
    assert patterns("you are not a moron") == {("insult", True, True, False): 1}
    assert patterns("he said: you moron") == {("insult", True, False, True): 1}
    assert patterns("I will hurt you") == {("threat", False, False, False): 1, ("aimed",): 1}
    assert patterns("that may hurt a bit") == {} and patterns("") == {} and patterns("idiots") == {}
    assert patterns("not. idiot") == {("insult", False, False, False): 1}
    assert T.PRIOR[1 + T.PATTERNS.index(("insult", True, True, False))] < T.PRIOR[1 + T.PATTERNS.index(("insult", True, False, False))]


def test_learns_words_and_scores_held_out_texts(spark):
    rows, labels = corpus()
    docs = documents(spark, rows + awkward())
    table = spark.createDataFrame(labels + [(None, 1), (1000, None), (1001, 7)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = T.trained(docs, table, ~T.held_out())
    assert int(T.hashes_of(["zorg"])[0]) in model.words[0].tolist()
    got = {r["doc_id"]: r for r in T.scored(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(T.held_out()).select("doc_id").collect()}
    text = dict(rows)
    for i in held & set(text):
        assert (got[i]["predicted"] == 1) == ("zorg" in text[i] or "idiot" in text[i])
    for i in (4, 5, 6, 9):
        assert 0 < got[i]["score"] < 0.3 and got[i]["predicted"] == 0
    kept = T.clean(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(got[i]["predicted"] == 0 for i, _ in rows) + len(awkward())
    again = T.trained(docs, table, ~T.held_out())
    assert (again.weights == model.weights).all() and (again.words[0] == model.words[0]).all()


def test_labels_held_out_teach_nothing(spark):
    rows, labels = corpus(200)
    docs = documents(spark, rows)
    flipped = [(i, 1 - y) for i, y in labels]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    other = spark.createDataFrame(flipped, "doc_id long, toxic int")
    mixed = table.where(~T.held_out()).unionByName(other.where(T.held_out()))
    assert (T.trained(docs, table, ~T.held_out()).weights == T.trained(docs, mixed, ~T.held_out()).weights).all()


def test_without_labels(spark):
    docs = documents(spark, [(1, "you moron"), (2, "hello"), (3, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in T.scored(docs, T.trained(docs, none, ~T.held_out())).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert T.scored(documents(spark, []), T.trained(documents(spark, []), none, ~T.held_out())).count() == 0
