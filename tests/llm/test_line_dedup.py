import random

from hypothesis import given
from hypothesis import strategies as st

from siteaudit.llm import line_dedup as ld


def brute(rows, least):
    """Every run of lines with enough words that starts earlier in the corpus goes."""
    docs = sorted({(d is None, d or 0, t) for d, t in rows if t})
    first, gone = {}, {}
    for k, (_, _, t) in enumerate(docs):
        parts = t.split("\n")
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                if sum(len(p.split()) for p in parts[i:j]) >= least:
                    run = tuple(parts[i:j])
                    if first.setdefault(run, (k, i)) != (k, i):
                        gone.setdefault(k, set()).update(range(i, j))
    left = {}
    for k, (null, d, t) in enumerate(docs):
        parts = t.split("\n")
        cut = gone.get(k, set())
        left[(None if null else d, t)] = (len(parts), len(cut), "\n".join(p for i, p in enumerate(parts) if i not in cut))
    return sorted(
        ((str(d), *left[(d, t)]) if t else (str(d), 0, 0, t) for d, t in rows), key=lambda r: tuple(map(str, r))
    )


def run(spark, rows, least):
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, a int, gone string")
    got = ld.dedup(docs, least)
    assert got.columns == [*docs.columns, "n_lines", "n_deleted"]
    return sorted(
        ((str(r["doc_id"]), r["n_lines"], r["n_deleted"], r["text"]) for r in got.collect()), key=lambda r: tuple(map(str, r))
    )


def test_against_brute_force(spark):
    rng = random.Random(1)
    lines = ["a b c", "d e", "f", "g h i j k", "", "l m n o", "p", "q r s t u v w"]
    rows = []
    for d in range(60):
        rows.append((d, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (70, rows[3][1]), (None, rows[5][1]), (None, "z z z z z z z z z\nf")]
    rows += [(72, None), (73, ""), (74, "same line\n" * 12), (75, "w " * 50_000 + "\n" + "a b c\nd e\nf\ng h i j k")]
    for least in (1, 6, 9):
        assert run(spark, rows, least) == brute(rows, least)


def test_no_rows_and_clean(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup(docs).count() == 0
    long = "\n".join(f"line {i} with some more words in it" for i in range(8))
    docs = spark.createDataFrame(
        [(1, long, 3), (2, long, 3), (3, "short\n" + long + "\nend", 3), (4, "short", 3)], "doc_id long, text string, n_chars long"
    )
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in ld.clean(docs).collect()}
    assert got == {1: (long, len(long)), 3: ("short\nend", 9), 4: ("short", 5)}


@given(st.lists(st.integers(0, 5), max_size=12), st.integers(1, 9))
def test_depths_are_the_shortest_runs(words, least):
    want = [set() for _ in words]
    n = len(words)
    for i in range(n):
        for j in range(i + 1, n + 1):
            if sum(words[i:j]) >= least and (sum(words[i : j - 1]) < least or sum(words[i + 1 : j]) < least):
                want[i].add(j - i)
    got = [set(d) for d in ld.depths(words, least)]
    for g, w in zip(got, want, strict=True):
        assert g <= w
    covered = {(i, i + d) for i, ds in enumerate(got) for d in ds}
    for i in range(n):
        for j in range(i + 1, n + 1):
            if sum(words[i:j]) >= least:
                inside = {p for a, b in covered if i <= a and b <= j for p in range(a, b)}
                assert inside == set(range(i, j))
