"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

A document classifier turns measures of the text into bins and the bins into log odds; it is a
logistic regression over the counts of labelled documents by combination of bins, so it reads
all labels and its table is bounded by the bins. Every document, labelled or not, then counts
for its host and its path with its label or else its probability. Hosts shrink toward the
global mean and paths toward their host, each by a strength (in documents) estimated from how
much the means differ beyond chance. The verdict adds the document's evidence to the log odds
of its path.

A path is told by ``path`` within ``host``; the corpus has no URLs, so the queries take
``source`` as host and ``lang`` as path. Null hosts and paths are groups of their own.

Edges: null and empty texts are texts without words; without labels the evidence is 0 and the
global mean 1, so everything is kept; a document labelled twice counts with its mean; repeated
rows count and are judged each; an empty table gives no rows; other columns pass through
``filtered`` and are not read otherwise.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.llm.divergence import PLACE, SPACES, base
from siteaudit.llm.naming import unused
from siteaudit.llm.words import LETTERS, WordIds, plain_words
from siteaudit.plans.session import cut, small

LEAST = 0.5  # a document stays from this probability on
RIDGE = 1.0
STRENGTHS = (2.0, 10_000.0)  # least and largest weight of a group's prior, in documents

EDGES = {
    "symbols": (0.001, 0.01, 0.03, 0.06, 0.15),
    "upper": (0.02, 0.05, 0.1, 0.2, 0.4),
    "repeated": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "copied_lines": (0.01, 0.1, 0.3, 0.6),
    "common": (0.02, 0.05, 0.1, 0.15, 0.25, 0.4),
    "word_length": (3.0, 4.0, 5.0, 6.5, 8.0, 11.0),
    "words": (1.0, 10.0, 30.0, 100.0, 1000.0),
}
SIZES = [len(e) + 1 for e in EDGES.values()]


def measures(text: str | None, ids: WordIds) -> list[float]:
    n, chars, symbols, copied, repeated = base(text, ids)
    raw = (text or "").encode("utf-8", "surrogatepass")
    upper = len(raw) - len(raw.translate(None, LETTERS))
    words = plain_words(text)
    listed = sum(map(PLACE.__contains__, words))
    lines = sum(bool(x.strip(SPACES)) for x in text.split("\n")) if text else 0
    return [
        symbols / max(1, chars),
        upper / max(1, chars),
        repeated / max(1, n),
        copied / max(1, lines),
        1 - (len(words) - listed) / len(words) if words else 0.0,
        chars / max(1, n),
        float(n),
    ]


def bins(text: str | None, ids: WordIds) -> int:
    """One number for the combination of bins."""
    code = 0
    for value, edges, size in zip(measures(text, ids), EDGES.values(), SIZES, strict=True):
        code = code * size + bisect_right(edges, value)
    return code


def one_hot(codes: np.ndarray) -> np.ndarray:
    parts, rest = [], codes.copy()
    for size in reversed(SIZES):
        parts.append(np.eye(size)[rest % size])
        rest //= size
    return np.hstack(parts[::-1])


def binned(docs: DataFrame, code: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, and its bins as ``code``."""
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at = rows.columns.index("text")
    made = [*(docs.schema[c] for c in keep), T.StructField(code, T.LongType())]
    names = [f.name for f in made]

    def run(batches):
        ids = WordIds()
        for batch in batches:
            codes = [bins(t.as_py(), ids) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(codes, pa.int64())], names)

    return rows.mapInArrow(run, T.StructType(made))


def fit_bins(codes: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights of the bins, log odds of the labels): Newton steps with a ridge."""
    width = sum(SIZES)
    if not len(codes) or not n.sum():
        return np.zeros(width), 0.0
    x = one_hot(codes)
    mean = float((good.sum() + 0.5) / (n.sum() + 1))
    prior = float(np.log(mean / (1 - mean)))
    w = np.zeros(width)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w + prior, -30, 30)))
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, x.T @ (good - n * p) - RIDGE * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w, prior


def _strength(groups: DataFrame, mean) -> DataFrame:
    """One row: how many documents a prior weighs, by the moments of the groups' means.

    Groups differ by chance p(1-p)/n; what they differ beyond that is the prior's variance.
    """
    p = F.least(F.greatest(mean, F.lit(1e-4)), F.lit(1 - 1e-4))
    off = F.col("s") / F.col("n") - p
    chance = p * (1 - p)
    beyond = F.sum(F.col("n") * off * off - chance) / F.sum("n")
    spread = F.sum(F.col("n") * chance) / F.sum("n")
    raw = F.when(beyond > 0, spread / beyond - 1).otherwise(STRENGTHS[1])
    return groups.groupBy().agg(
        F.coalesce(F.least(F.greatest(raw, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1])), F.lit(STRENGTHS[1])).alias("k")
    )


def posteriors(counted: DataFrame) -> DataFrame:
    """(host, path, host_mean, path_mean) from (host, path, value): one row a path.

    Values are summed by path before they are shuffled, so a hot host is a few partial sums.
    """
    paths = cut(counted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.groupBy().agg((F.sum("s") / F.sum("n")).alias("m"))
    hosts = hosts.join(F.broadcast(total))
    hosts = hosts.join(F.broadcast(_strength(hosts, F.col("m")))).select(
        "host", ((F.col("s") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k"))).alias("host_mean")
    )
    paths = paths.join(hosts.withColumnRenamed("host", "h"), F.expr("host <=> h")).drop("h")
    return paths.join(F.broadcast(_strength(paths, F.col("host_mean")))).select(
        "host",
        "path",
        "host_mean",
        ((F.col("s") + F.col("k") * F.col("host_mean")) / (F.col("n") + F.col("k"))).alias("path_mean"),
    )


class Model:
    def __init__(self, weights: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior

    def evidence(self, codes: np.ndarray) -> np.ndarray:
        return one_hot(codes) @ self.weights if len(codes) else np.zeros(0)


def fit(measured: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """(model, posteriors of the paths) from (doc_id, host, path, code)."""
    known = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg("quality").cast("double").alias("label"))
    )
    marked = cut(measured.join(known, "doc_id", "left"))
    table = (
        marked.where("label IS NOT NULL")
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
        .collect()
    )
    weights, prior = fit_bins(
        np.array([r["code"] for r in table], np.int64),
        np.array([r["n"] for r in table], float),
        np.array([r["good"] for r in table], float),
    )
    model = Model(weights, prior if table else 20.0)

    def run(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(model.evidence(batch.column(2).to_numpy()) + model.prior, -30, 30)))
            label = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.where(np.isnan(label), p, label))], ["host", "path", "value"]
            )

    counted = marked.select("host", "path", "code", "label").mapInArrow(run, "host string, path string, value double")
    return model, cut(posteriors(counted))


def _measured(coded: DataFrame, host: str, path: str, code: str) -> DataFrame:
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"),
        F.col(code).alias("code"),
    )


def _judged(rows: DataFrame) -> DataFrame:
    """``probability`` and ``kept`` from ``evidence`` and ``path_mean``."""
    m = F.least(F.greatest(F.col("path_mean"), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("evidence") + F.log(m / (1 - m))
    return rows.withColumn("probability", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("probability") >= LEAST)


def _with_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    side = small(paths.withColumnsRenamed({"host": "_h", "path": "_p"}))
    return rows.join(side, F.expr("host <=> _h AND path <=> _p")).drop("_h", "_p")


def verdicts(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, evidence, host_mean, path_mean, probability, kept) of each document."""
    keep = list(dict.fromkeys(["doc_id", host, path]))
    (code,) = unused(keep, "code")
    measured = _measured(cut(binned(docs, code, keep)), host, path, code)
    model, paths = fit(measured, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(model.evidence(batch.column(3).to_numpy()))],
                ["doc_id", "host", "path", "evidence"],
            )

    rows = measured.mapInArrow(run, "doc_id long, host string, path string, evidence double")
    return _judged(_with_paths(rows, paths)).drop("host", "path")


def filtered(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that are kept, with their own columns. Texts are read once and not shuffled.

    The documents are written with their bins, and those, not the texts, are judged.
    """
    names = docs.columns
    code, bin_, evidence, own_host, own_path, h, p, mean = unused(
        names, "code", "bin", "evidence", "host", "path", "h", "p", "mean"
    )
    coded = cut(binned(docs, code, names))
    measured = _measured(coded, host, path, code)
    model, paths = fit(measured, labels)

    def run(batches):
        for batch in batches:
            found = model.evidence(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [bin_, evidence])

    # As many rows as there are combinations of bins, whatever the table holds.
    by_bin = measured.select("code").distinct().mapInArrow(run, f"`{bin_}` long, `{evidence}` double")
    rows = coded.join(F.broadcast(by_bin), F.col(code) == F.col(bin_)).withColumns(
        {own_host: F.col(host).cast("string"), own_path: F.col(path).cast("string")}
    )
    side = small(paths.select(F.col("host").alias(h), F.col("path").alias(p), F.col("path_mean").alias(mean)))
    joined = rows.join(
        side, F.col(own_host).eqNullSafe(F.col(h)) & F.col(own_path).eqNullSafe(F.col(p))
    )
    m = F.least(F.greatest(F.col(mean), F.lit(1e-6)), F.lit(1 - 1e-6))
    return joined.where(1 / (1 + F.exp(-(F.col(evidence) + F.log(m / (1 - m))))) >= LEAST).select(*names)
