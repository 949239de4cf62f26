from siteaudit.llm import line_dedup, pseudonyms, quality
from siteaudit.llm.naming import unused

NAMES = "_raw _got raw got _key key _doc doc _t t _gone gone _copy copy _evidence evidence _host _path _h h _p p _mean mean".split()


def frame(spark, rows):
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(d, t, "s", "en", *(f"keep {n}" for n in NAMES)) for d, t in rows], schema)


def whole(df):
    return all(r[n] == f"keep {n}" for r in df.collect() for n in NAMES)


def test_unused():
    assert unused(["A", "_a", "b"], "a", "b", "c", "c") == ["__a", "_b", "c", "_c"]


def test_operators_keep_columns_of_any_name(spark):
    line = " ".join(f"word{k}" for k in range(40))
    docs = frame(spark, [(1, line), (2, "own\n" + line), (3, "mail bob@example.com please"), (4, None), (5, "")])
    made = pseudonyms.pseudonymised(docs)
    assert whole(made) and made.where("doc_id = 3").first()["kinds"] == ["email"]
    out = line_dedup.dedup(docs)
    assert whole(out) and {r["doc_id"]: r["n_deleted"] for r in out.collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality.filtered(docs, labels)
    assert kept.columns == docs.columns and whole(kept)
