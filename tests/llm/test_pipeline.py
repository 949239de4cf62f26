"""The stages against brute force on a small corpus."""

import random

import corpus_pipeline as cp
import pytest

from siteaudit.llm import decontaminate as de
from siteaudit.llm.packing import codes
from siteaudit.llm.queries import vocabulary
from test_jaccard import brute as groups
from test_line_dedup import brute as lines


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(11)
    voc = ["the", "of", "and", "in"] + [a + b for a in ("ther", "on", "an", "er", "st", "qu") for b in ("ing", "ed", "ly", "ion")]
    text = lambda n, m=12, junk="": "\n".join(" ".join(rng.choice(voc) + junk for _ in range(m)) for _ in range(n))
    item, passage = text(1, 30), text(4, 16)
    rows = [(i, text(rng.randint(3, 12))) for i in range(80)]
    rows += [(100 + i, text(8, 12, "***")) for i in range(20)]
    rows += [(200 + i, text(3) + "\n" + passage + "\n" + text(2)) for i in range(5)]
    rows += [(300, text(3) + " " + item), (301, rows[4][1]), (302, rows[7][1].replace("the", "ther", 1))]
    near = text(1, 200).split(" ")
    for i in range(4):
        copy = list(near)
        copy[50 * i + 3] = f"new{i}"
        rows.append((400 + i, " ".join(copy)))
    docs = [(d, t, "en", f"src{d % 3}", len(t)) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    marks = [(d, int(not 100 <= d < 120), 0) for d, _ in rows if d % 2 == 0]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "benchmark_decontamination", "packing"]
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    good = stage["quality_classifier"](spark, docs, folder)
    assert pairs(good) == [r for r in pairs(docs) if not 100 <= r[0] < 120] and good.columns == docs.columns

    lined = stage["line_dedup"](spark, good, folder)
    want = [(int(d), t) for d, n, cut, t in lines(pairs(good), 30) if not (cut and cut == n)]
    assert pairs(lined) == sorted(want) and lined.columns == docs.columns

    single = stage["jaccard_join"](spark, lined, folder)
    stay = {d for d, n, c in groups(pairs(lined)) if n == 0 or d == c}
    assert pairs(single) == [r for r in pairs(lined) if r[0] in stay] and single.columns == docs.columns

    clean = stage["benchmark_decontamination"](spark, single, folder)
    bad = {r["doc_id"] for r in de.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect() if r["contaminated"]}
    assert 300 in bad and pairs(clean) == [r for r in pairs(single) if r[0] not in bad]

    packed = stage["packing"](spark, clean, folder).collect()
    texts = dict(pairs(clean))
    n = {d: len(b) // 4 + 1 for d, b in zip(texts, codes(vocabulary()).encode(list(texts.values())), strict=True)}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == n
    whole = cp.run(spark, folder)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_crc32"]) for r in packed)


def test_texts_are_measured_once(spark, folder):
    """Documents are judged by the bins that the fit made of them: no text goes to Python again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = dict(cp.STAGES)["quality_classifier"](spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "InArrow" in line and "text" in line]
