import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from siteaudit.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, path string, shard int, n_convs int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def rebuilt(rows):
    own = defaultdict(list)
    digest = lambda a, b: hashlib.sha256(f"{len(a.encode())}:{a}{b}".encode()).hexdigest()[:32]
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))  # the remainder takes the sign of c, as in SQL
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p] if p in kids else 0, leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def result(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def some_rows(seed, convs, hot=0.3):
    """Conversations of few distinct turns; a share of them are copies of one."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        n = 4 if rng.random() < hot else rng.randrange(1, 9)
        texts = ["same"] * n if n == 4 else [rng.choice(["a", "bb", "ccc", ""]) for _ in range(n)]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(texts)]
    return rows


EDGES = [
    (100, 0, "user", "head"),
    (100, 1, None, None),
    (100, None, "system", "null turn first"),
    (101, 0, "user", "head"),
    (150, 3, "user", "x"),
    (150, 3, "user", "x"),
    (150, 3, "assistant", "x"),
    (205, 0, "user", "no base"),
    (None, 0, "user", "nobody"),
    (-7, 0, "user", "below zero"),
    (300, 0, "user", "ü" * 200_000),
    (301, 0, "user", "ü" * 200_000),
]


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_against_brute_force(spark, shards):
    taken = {r[0] for r in EDGES}
    rows = [r for r in some_rows(shards, 260) if r[0] not in taken] + EDGES
    assert result(pt.trie(pt.rebuilt(frame(spark, rows)), shards=shards)) == brute(rows)


def test_copies_and_long_conversations_over_many_shards(spark):
    rows = [(c, t, "user", f"turn {t % 3}") for c in range(0, 120) for t in range(3)]
    rows += [(500 + c, t, "user", "deep") for c in range(3) for t in range(200 + c)]
    assert result(pt.trie(pt.rebuilt(frame(spark, rows)), shards=30)) == brute(rows)


def test_empty_table(spark):
    assert pt.trie(pt.rebuilt(frame(spark, []))).collect() == []


def test_pieces_make_the_same_digest(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(90)]
    assert result(pt.trie(pt.rebuilt(frame(spark, rows)), shards=9)) == brute(rows)


def test_common():
    a, b = b"x" * 16, b"y" * 16
    assert pt.common(b"", a) == 0
    assert pt.common(a, a + b) == 1
    assert pt.common(a + b + a, a + b + b) == 2
    assert pt.common(a * 1000 + b, a * 1000 + a) == 1000
    assert pt.common(a, b) == 0
