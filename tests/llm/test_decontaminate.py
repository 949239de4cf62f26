import hashlib
import re

from siteaudit.llm import decontaminate as de

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, ITEM), (2, "tiny item"), (3, None), (None, "nameless one"), (1, ITEM), (4, "..."), (10, "ünï cöde ñ")]
DOCS = [
    (1, "start " + ITEM.upper().replace(" ", ", ") + " end"),
    (2, "nothing of it"),
    (3, None),
    (4, ""),
    (5, "a Tiny\n\nITEM! and tiny, item"),
    (6, "the nameless one"),
    (7, "Beta gamma delta epsilon zeta eta theta iota kappa"),
    (1, "start " + ITEM.upper().replace(" ", ", ") + " end"),
    (8, "word " * 200_000 + ITEM),
    (None, "tiny item"),
    (9, "x ünï cöde ñ y"),
]


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w, hit, found = words(text), set(), set()
    for item, t in ITEMS:
        v = words(t)
        n = min(10, len(v))
        for s in range(len(v) - n + 1) if v else ():
            for k in range(len(w) - n + 1):
                if w[k : k + n] == v[s : s + n]:
                    hit.update(range(k, k + n))
                    if item is not None:
                        found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def frames(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, items string")
    return docs, spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, spans int")


def test_against_brute_force(spark):
    docs, items = frames(spark)
    for most in (de.BLOCK_BYTES, 60):  # one block of patterns, or one for each item
        got = de.decontaminate(docs, items, most=most).collect()
        rows = sorted(
            (str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got
        )
        assert rows == sorted((str(d), *brute(t)) for d, t in DOCS)


def test_offsets_lie_in_the_original(spark):
    docs, items = frames(spark)
    got = {r["doc_id"]: r for r in de.decontaminate(docs, items).collect()}
    text = dict(DOCS)
    cut = [text[5][s["start"] : s["end"]] for s in got[5]["spans"]]
    assert cut == ["Tiny\n\nITEM", "tiny, item"]
    assert [text[9][s["start"] : s["end"]] for s in got[9]["spans"]] == ["ünï cöde ñ"]


def test_clean_keeps_clean_documents(spark):
    docs, items = frames(spark)
    kept = sorted(str(r["doc_id"]) for r in de.clean(docs, items).collect())
    assert kept == sorted(str(d) for d, t in DOCS if not brute(t)[4])
    cut = {r["doc_id"]: r["text"] for r in de.clean(docs, items, spans_only=True).collect()}
    assert cut[5] == "a ! and " and cut[2] == "nothing of it" and None not in cut
    assert de.clean(docs, items).columns == docs.columns


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert de.decontaminate(docs.limit(0), items).count() == 0
    assert not any(r["contaminated"] for r in de.decontaminate(docs, items.limit(0)).collect())
