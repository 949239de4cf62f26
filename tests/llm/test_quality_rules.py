import random
from collections import Counter

from siteaudit.llm import divergence as dv
from siteaudit.llm import quality as ql
from siteaudit.llm.words import WordIds

SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c in SPACES:
            words += [now] if now else []
            now = ""
        else:
            now += c
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        dup += x in seen and any(c not in SPACES for c in x)
        seen.add(x)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def prose(rng, n, junk=""):
    voc = [a + b for a in ("ther", "on", "an", "er", "st") for b in ("ing", "ed", "ly", "ion", "ou", "re")]
    pick = lambda: rng.choice(voc) + rng.choice(voc) + rng.choice(voc)
    return " ".join(rng.choice(["the", "of", "and", "in", pick(), pick(), pick()]) + junk for _ in range(n)) + "."


def test_base_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "a b", "a b c a b c", "x\nx\n\n\nx y\nx", "# * a|b <c> d", "日本 語\x1cx\tz", prose(rng, 400)]
    texts += ["\n".join(rng.choice(["a b", "c", "d e f"]) for _ in range(30)), "w " * 60_000]
    for t in texts:
        assert dv.base(t, WordIds(3)) == brute(t)
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, words int")
    got = {r["doc_id"]: r for r in dv.verdicts(docs).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute(t)
        assert tuple(got[i][1:6]) == (n, chars, symbols, dup, rep)
        assert got[i]["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert dv.verdicts(docs.limit(0)).count() == 0


def test_far_texts_fail_and_near_ones_stay(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 150), "en") for i in range(60)]
    rows += [(100, prose(rng, 150, "***"), "en"), (101, prose(rng, 150).upper(), "en"), (102, prose(rng, 150), None), (103, prose(rng, 150), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in dv.verdicts(docs).collect()}
    assert [d for d, k in kept.items() if not k] == [100, 101]


def test_other_languages_are_learned_from_the_table(spark):
    rng = random.Random(9)
    han = [chr(0x4E00 + i) for i in range(300)]
    zh = lambda: "，".join("".join(rng.choices(han, k=rng.randrange(2, 6))) + " 的 是" for _ in range(60))
    made = ["".join(rng.choices("aeioukln", k=5)) for _ in range(400)]
    fi = lambda words=("ja", "on", "ei", "se"): " ".join(rng.choice(words if rng.random() < 0.4 else made) for _ in range(200))
    rows = [(i, zh(), "zh") for i in range(30)] + [(100 + i, fi(), "fi") for i in range(30)]
    rows += [(200, prose(rng, 150).upper(), "zh"), (201, fi(["zzq", "zzr"]), "fi"), (202, zh(), "few"), (203, zh(), None), (204, None, "zh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = dv.learned(docs)
    assert sorted(words) == ["fi", "zh"] and set(words["fi"][:4]) == {b"ja", b"on", b"ei", b"se"}
    assert all(len(w) <= dv.LISTED for w in words.values())
    got = {r["doc_id"]: r for r in dv.verdicts(docs).collect()}
    assert sorted(d for d, r in got.items() if not r["kept"]) == [200, 201, 204]
    assert got[202]["class_distance"] is got[203]["word_distance"] is None


def test_quality_learns_and_shrinks(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 120, "***" if bad else ""), f"s{i % 3}", "en", 0.5))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(900, None, None, None, 0.1), (901, "", "s0", "en", 0.1), (902, rows[1][1], "lonely", "xx", 0.1), (902, rows[1][1], "lonely", "xx", 0.1)]
    rows += [(903, "good words of the prose " * 30_000, "s1", "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, evidence double")
    marks = spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ql.verdicts(docs, marks).collect()}
    assert all(got[i]["kept"] == (i % 4 != 0) for i in range(300))
    total = sum(i % 4 != 0 for i in range(300)) / 300
    assert abs(got[902]["path_mean"] - total) < 0.2 and got[902]["kept"]
    kept = ql.filtered(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["kept"]}
    assert ql.verdicts(docs.limit(0), marks).count() == 0
    assert all(r["kept"] for r in ql.verdicts(docs, marks.limit(0)).collect())
