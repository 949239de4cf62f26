"""Deletion of repeated line runs by a suffix array over line ids.

Every line is an id, every document a sequence of ids. Prefix doubling ranks the suffixes by
their first 1, 2, 4, ... lines: a round ranks the pair (rank here, rank ``h`` lines on) by
sorting the distinct pairs over ranges, so ranks keep the order of the suffixes and equal
prefixes get equal ranks. A suffix whose rank is held by nobody else has no repeat of that
length and leaves the next rounds, so tables shrink to what is repeated.

Suffixes of one rank at depth L are an interval of the suffix array whose longest common
prefix is L lines at least. A run of lines with ``min_words`` words or more is deleted wherever
the same run starts earlier in the corpus (by document id, nulls last, then by line). Every
such run is the union of the shortest runs of that many words that start at its lines or end
at its lines, so only those depths are looked up. Runs do not cross documents.

Edges: null texts stay null; empty texts and texts without repeats come back as they are;
rows equal in id and text are one document and come back alike; an empty table gives no rows.
``lines`` reads ``doc_id`` and ``text`` only and ``dedup`` keeps all other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.llm.naming import unused
from siteaudit.plans.session import cut

MIN_WORDS = 30


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def depths(words: list[int], least: int) -> list[list[int]]:
    """For each line the lengths of the runs from it on that are wanted: the shortest with
    ``least`` words, and those that are the shortest to end at some line."""
    upto = np.cumsum([0, *words])
    n = len(words)
    wanted: list[set[int]] = [set() for _ in range(n)]
    ahead = np.searchsorted(upto, upto[:-1] + least)
    for s in np.nonzero(ahead <= n)[0].tolist():
        wanted[s].add(int(ahead[s]) - s)
    back = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    for e in np.nonzero(back >= 0)[0].tolist():
        wanted[int(back[e])].add(e + 1 - int(back[e]))
    return [sorted(w) for w in wanted]


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, a, b, depth): ids of the lines in two halves, and the lengths of the runs
    from each line on that are looked up."""

    def run(batches):
        for batch in batches:
            left, right, deep = [], [], []
            for text in batch.column(2):
                parts = [p.encode("utf-8", "surrogatepass") for p in text.as_py().split("\n")]
                h = [xxhash.xxh3_128_intdigest(p) for p in parts]
                left.append([_signed(x >> 64) for x in h])
                right.append([_signed(x & (1 << 64) - 1) for x in h])
                deep.append(depths([len(p.split()) for p in parts], max(min_words, 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(left, pa.list_(pa.int64())),
                    pa.array(right, pa.list_(pa.int64())),
                    pa.array(deep, pa.list_(pa.list_(pa.int32()))),
                ],
                ["doc_id", "t", "a", "b", "depth"],
            )

    return (
        docs.where("length(text) > 0")
        .select(F.col("doc_id").cast("long"), F.md5("text").alias("t"), "text")
        .mapInArrow(run, "doc_id long, t string, a array<long>, b array<long>, depth array<array<int>>")
    )


def _ranked(pairs: DataFrame) -> DataFrame:
    """(x, y, r) of the pairs that occur twice or more; r keeps the order of (x, y)."""
    twice = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return cut(
        twice.repartitionByRange("x", "y")
        .sortWithinPartitions("x", "y")
        .select("x", "y", F.monotonically_increasing_id().alias("r"))
    )


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents as sequences, starts of later copies, the copies' first texts)."""
    made = cut(lines(docs, min_words))
    order = cut(
        made.select("doc_id", "t")
        .distinct()
        .repartitionByRange(F.col("doc_id").asc_nulls_last(), "t")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "t")
        .withColumn("seq", F.monotonically_increasing_id())
    )
    first = order.groupBy("t").agg(F.min("seq").alias("seq"))
    rows = (
        made.alias("m")
        .join(order.alias("o"), F.expr("m.t = o.t AND m.doc_id <=> o.doc_id"))
        .select("m.t", "seq", "a", "b", "depth")
        .join(first.alias("f"), ["t", "seq"])
    )
    state = rows.select("seq", F.posexplode(F.arrays_zip("a", "b", "depth")).alias("pos", "z")).select(
        "seq", "pos", F.col("z.a").alias("x"), F.col("z.b").alias("y"), F.col("z.depth").alias("depth")
    ).dropDuplicates(["seq", "pos"])
    repeated = cut(state.join(_ranked(state), ["x", "y"]).select("seq", "pos", "r", "depth"))
    wanted = cut(repeated.select("seq", "pos", "r", F.explode("depth").alias("depth")))
    state = repeated.select("seq", "pos", "r")
    deepest = wanted.agg(F.max("depth")).first()[0] or 0
    found = None
    h = 1
    while True:
        here = state.join(wanted.select("seq", "pos", "depth"), ["seq", "pos"]) if h > 1 else wanted
        here = here.where((F.col("depth") >= h) & (F.col("depth") < 2 * h))
        there = state.select("seq", F.col("pos").alias("at"), F.col("r").alias("r2"))
        runs = (
            here.withColumn("at", F.col("pos") + F.col("depth") - h)
            .join(there, ["seq", "at"])
            .select("seq", "pos", "depth", F.col("r").alias("x"), F.col("r2").alias("y"))
        )
        runs = cut(runs)
        interval = runs.groupBy("depth", "x", "y").agg(
            F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("copies")
        ).where("copies > 1")
        met = runs.join(interval, ["depth", "x", "y"])
        same = met.where("seq = first_seq").groupBy("depth", "x", "y").agg(F.min("pos").alias("first_pos"))
        later = met.where("seq > first_seq").select("seq", "pos", "depth").unionByName(
            met.where("seq = first_seq").join(same, ["depth", "x", "y"]).where("pos > first_pos").select("seq", "pos", "depth")
        )
        later = cut(later)
        found = later if found is None else found.unionByName(later)
        if deepest < 2 * h:
            break
        ahead = Window.partitionBy("seq").orderBy("pos").rangeBetween(h, h)
        pairs = state.withColumn("y", F.max("r").over(ahead)).where("y IS NOT NULL").withColumnRenamed("r", "x")
        state = cut(pairs.join(_ranked(pairs), ["x", "y"]).select("seq", "pos", "r"))
        h *= 2
    return order, found, first


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, gone): the line numbers, from 0, that go from each document that loses any."""
    order, later, first = repeats(docs, min_words)
    gone = (
        later.select("seq", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("depth") - 1)).alias("line"))
        .groupBy("seq")
        .agg(F.sort_array(F.collect_set("line")).alias("gone"))
    )
    # A later copy of a whole text loses every line that lies in a run long enough.
    firsts = order.join(first, ["t", "seq"], "left_semi").join(gone, "seq", "left").select("doc_id", "t", "gone")
    copies = order.join(first, ["t", "seq"], "left_anti").select("doc_id", "t", F.lit(True).alias("copy"))
    return firsts.where("gone IS NOT NULL").withColumn("copy", F.lit(False)).unionByName(
        copies.withColumn("gone", F.lit(None).cast("array<int>"))
    )


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the deleted lines taken out of ``text``, and n_lines and n_deleted added
    (columns of these names are replaced).

    A copy of a whole earlier text loses the lines that lie in runs of ``min_words`` words.
    """
    docs = docs.drop("n_lines", "n_deleted")
    names = docs.columns
    doc, t, lost_lines, copied, key = unused(names, "doc", "t", "gone", "copy", "key")
    gone = deletions(docs, min_words).withColumnsRenamed(
        {"doc_id": doc, "t": t, "gone": lost_lines, "copy": copied}
    )
    joined = docs.withColumn(key, F.md5("text")).join(
        gone, (F.col(key) == F.col(t)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left"
    )
    text = names.index("text")

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(len(names))]
            texts, total, cut_ = [], [], []
            for value, lost, copy in zip(
                cols[text].to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True
            ):
                parts = value.split("\n") if value else []
                if copy:
                    # every run long enough repeats; only a document short of words has none
                    lost = range(len(parts)) if sum(len(p.encode("utf-8", "surrogatepass").split()) for p in parts) >= max(min_words, 1) else ()
                lost = set(lost or ())
                total.append(len(parts))
                cut_.append(len(lost))
                texts.append("\n".join(p for i, p in enumerate(parts) if i not in lost) if lost else value)
            cols[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(total, pa.int64()), pa.array(cut_, pa.int64())], [*names, "n_lines", "n_deleted"]
            )

    out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType())])
    return joined.select(*names, lost_lines, copied).mapInArrow(run, out)


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents after ``dedup``, with their own columns; one that lost all its lines goes."""
    out = dedup(docs, min_words).where("NOT (n_deleted > 0 AND n_deleted = n_lines)").drop("n_lines", "n_deleted")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
