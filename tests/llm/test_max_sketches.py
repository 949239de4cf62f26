import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siteaudit.llm import max_sketches as ms
from siteaudit.llm.words import WordIds

DOCS = "doc_id long, text string, key string, n int, sketch string, _key string, _doc long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "s", "u", 5) for r in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "item_id long, text string, q int")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, len(w), Counter(w)) for d, w in bags if w]
    n_docs, n_terms = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, n, c in bags:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d, s))
        scores.sort(key=lambda x: x[:2] + (x[2] or 0,))
        out += [(item, k + 1, d, s) for k, (_, _, d, s) in enumerate(scores[:10])]
    return Counter(out)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    text = lambda: " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))
    copy = text()
    docs = [(k, copy if rng.random() < 0.3 else text()) for k in range(n)]
    docs += [
        (900, None),
        (901, ""),
        (902, "... !"),
        (3, "w1 w2 of a repeated id"),
        (None, copy),
        (None, "w5 W6 w7"),
        (903, "W1, w2-w3 ünï Ünï " * 3000),
        (904, "w9 " * 400 + "w80"),
        docs[0],
        docs[0],
    ]
    items = [(k, text()) for k in range(12)] + [
        (20, None),
        (21, ""),
        (22, "unseen words only"),
        (23, copy),
        (23, "w1"),
        (24, "Ünï ünï w80"),
        (25, " ".join(words)),
        (None, "w7"),
    ]
    return docs, items


@pytest.mark.parametrize("rounds", [(64, 1024), (11, 12), (), (1,)])
def test_against_brute_force(spark, rounds):
    docs, items = corpus(len(rounds))
    got = ms.search(docs_of(spark, docs), items_of(spark, items), rounds=rounds)
    assert Counter(map(tuple, got.collect())) == brute(docs, items)


def test_blocks_of_items(spark):
    docs, items = corpus(9)
    got = ms.search(docs_of(spark, docs), items_of(spark, items), most_items=5)
    assert Counter(map(tuple, got.collect())) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(3, 10)
    assert ms.search(docs_of(spark, []), items_of(spark, items)).collect() == []
    assert ms.search(docs_of(spark, docs), items_of(spark, [])).collect() == []
    assert ms.search(docs_of(spark, [(1, None)]), items_of(spark, items)).collect() == []


def test_bounds_hold_for_every_document():
    """A sketch never bounds a score from below, and few bounds are loose."""
    rng = random.Random(5)
    docs, _ = corpus(5, 80)
    bags = [Counter(t.encode() for t in terms(text)) for _, text in docs if terms(text)]
    df = Counter(t for c in bags for t in c)
    found = ms.Index(None, None, None, len(bags), sum(sum(c.values()) for c in bags))
    block = [(q, Counter(rng.sample(sorted(df), 6))) for q in range(20)]
    queries = ms.Queries(block, dict(df), found)
    for c in bags:
        row = np.frombuffer(ms.sketch(c, WordIds()), np.uint8)[None, :]
        assert row.shape[1] == ms.width(len(c))
        bound = queries.bounds(row, np.array([sum(c.values())]))[0]
        exact = queries.score(list(c.elements()), range(len(block)))
        assert (bound >= np.array(exact)).all()
