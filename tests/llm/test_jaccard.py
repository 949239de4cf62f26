import random
from itertools import combinations

import numpy as np

from siteaudit.llm import jaccard as ja
from siteaudit.llm.components import components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=5):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(400)]
    hot = " ".join(rng.choice(voc) for _ in range(12))
    texts = []
    for k in range(90):
        base = [rng.choice(voc) for _ in range(rng.randint(6, 160))]
        texts.append(" ".join(base) + (" " + hot if k % 3 else ""))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(voc)
            texts.append(" ".join(copy) + (" " + hot if k % 3 else ""))
    near = [rng.choice(voc) for _ in range(120)]
    for _ in range(60):  # a large group of near copies
        copy = list(near)
        copy[rng.randrange(120)] = rng.choice(voc)
        texts.append(" ".join(copy))
    texts += ["", None, "  \n\t ", "one", "ONE", "a b c", "A b  c", texts[3], texts[3].upper(), "long " * 30_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, keys string")
    want = brute(rows)
    # usual sizes; then keys split and chunks met in pairs; then classes met in parts
    for sizes in ({}, {"block": 8, "chunk": 10}, {"block": 20, "class_shingles": 400}):
        got = sorted(tuple(r) for r in ja.components_of(docs, **sizes).collect())
        assert got == want


def test_nulls_repeats_and_no_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r[0]), r[1], str(r[2])) for r in ja.components_of(docs).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 0, "2"), ("None", 0, "None"), ("None", 2, "1")]
    assert ja.components_of(docs.limit(0)).count() == 0
    kept = sorted((str(r[0]), str(r[1])) for r in ja.one_of_each(docs).collect())
    assert kept == [("1", "a b c d e f"), ("2", "None"), ("None", "None"), ("None", "a b c d e f")]


def test_one_of_each_removes_rows_not_ids(spark):
    w, u = "w1 w2 w3 w4 w5 w6", "u1 u2 u3 u4 u5 u6"
    rows = [(1, w, "a", "b", "c"), (5, w, "a", "b", "c"), (5, u, "a", "b", "c"), (7, u, "a", "b", "c"), (1, u[:5], "a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, doc string, digest string")
    kept = ja.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0], r[1]) for r in kept.collect()) == [(1, u[:5]), (1, w), (5, u)]
    # one id, two classes: neither class takes the other's row
    both = spark.createDataFrame([(1, w), (1, u), (2, w), (2, u)], "doc_id long, text string")
    assert sorted((r[0], r[1]) for r in ja.one_of_each(both).collect()) == [(1, u), (1, w)]


def test_links_over_a_set_without_an_id(spark):
    words = [f"x{k}" for k in range(60)]
    a, b, c = (" ".join([*words[s : s + 46]]) for s in (0, 5, 10))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(42)} for t in (a, b, c)]
    linked = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert linked(sets[0], sets[1]) and linked(sets[1], sets[2]) and not linked(sets[0], sets[2])
    docs = spark.createDataFrame([(1, a), (None, b), (3, c), (None, "other words that link with nothing here")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ja.components_of(docs).collect()}
    assert got == {(1, 42): 1, (None, 42): 1, (3, 42): 1, (None, 3): None}


def test_tree_join_finds_what_all_pairs_find():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(120):
        base = rng.integers(0, 1 << 63, rng.integers(1, 90), dtype=np.uint64) * np.uint64(2)
        sets.append(np.unique(base))
        if rng.random() < 0.5:
            sets.append(np.unique(np.concatenate([base[: len(base) * 9 // 10], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    forest = ja.Forest(len(sets))
    for i, j in ja.links([ja.point(s) for s in sets], sizes, sets):
        forest.join(i, j)
    other = ja.Forest(len(sets))
    for i, j in combinations(range(len(sets)), 2):
        if ja.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j]):
            other.join(i, j)
    assert (forest.roots() == other.roots()).all()


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_blocks_of_the_same_sets_meet_once(spark):
    """Two near copies share 30 keys and a third set shares one of them: two blocks, not 30."""
    rows = [(1, 200, list(range(40))), (2, 200, list(range(2, 42))), (3, 200, [5, *range(100, 139)]), (4, 200, list(range(200, 240)))]
    sets = spark.createDataFrame(rows, "node long, n long, keys array<long>")
    got = {}
    for r in ja.blocks(sets).collect():
        got.setdefault(r["key"], []).append(r["node"])
    assert sorted(map(sorted, got.values())) == [[1, 2], [1, 2, 3]]
