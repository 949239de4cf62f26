import random
from itertools import product

import numpy as np

from siteaudit.llm import toxicity as tx


def prose(rng, n):
    return [rng.choice(["the", "of", "ran", "house", "tree", "Stone", "é", "moving", "water"]) + rng.choice(["", "er", "s"]) for _ in range(n)]


def corpus(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        w, bad = prose(rng, rng.randint(5, 120)), i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["Badword", "nasty", "veju" + rng.choice("abcdefgh"), "veju" + rng.choice("ijklmnop")]))
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, 1, int(bad)))
    rows += [(9001, None, 0.0), (9002, "", 0.0), (9003, "tree " * 100_000 + "nasty!", 0.0), (9003, "tree " * 100_000 + "nasty!", 0.0), (None, "water", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(spark)
    model = tx.fit(docs, labels)
    got = tx.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id", "left").withColumn("h", tx.held_out()).collect()
    held = [r for r in got if r["h"] and r["toxic"] is not None]
    assert len(held) > 60 and sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[9003]["score"] >= 0.5 and by[9003]["spans"][0]["start"] == 500_000
    assert by[9001]["score"] == by[9002]["score"] < 0.5 and by[None]["score"] < 0.5
    assert sum(r["doc_id"] == 9003 for r in got) == 2
    assert tx.score(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs, labels = corpus(spark)
    model = tx.fit(docs, labels.limit(0))
    assert all(r["score"] < 1e-6 for r in tx.score(docs, model).collect())


def test_marginals_equal_the_sum_over_paths():
    names = ["w:bad", "w:odd"]
    trans = np.array([[0.4, -1.0], [0.2, 0.7]])
    field = tx.Field(names, np.array([3.0, -0.5]), -2.0, trans)
    for words in ([b"bad"], [b"x", b"bad", b"odd"], [b"odd", b"x", b"x", b"x", b"bad", b"y"], [b"x"] * 5 + [b"bad"]):
        emit = [(-2.0 + {b"bad": 3.0, b"odd": -0.5}.get(w, 0.0)) for w in words]
        total, mass = 0.0, np.zeros(len(words))
        for path in product((0, 1), repeat=len(words)):
            p = np.exp(sum(e for e, y in zip(emit, path, strict=True) if y) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            mass += p * np.array(path)
        at, p = field.marginals(words)
        assert np.allclose(p, (mass / total)[at])
