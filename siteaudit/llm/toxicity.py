"""Toxic spans by a linear-chain conditional random field.

Tokens are lower-cased words. The features of a token are the word and its first four, five
and six letters, as far as they are in a lexicon: features that occur in toxic documents far
more often than in clean ones, counted over the training documents. The two states are clean
and toxic. Labelled tokens come from labelled documents: a lexicon token of a toxic document is
toxic, every token of a clean one is clean; the field is fitted on windows around them.

To score a text, the chain runs over all of it. Tokens without features share one 2 x 2 step,
so a stretch of them is a power of that matrix and only lexicon tokens are visited one by one;
forward-backward marginals are exact. A document's score is a logistic function, fitted on the
training documents, of its largest marginal and of the sum of its marginals.

The fit reads at most ``SAMPLE`` labelled documents of each class (the first by a hash of
their ids); counts, windows and calibration come from these. Scores never read labels, lang,
source or doc_id.

Edges: null and empty texts get the score of a text without lexicon tokens; without labels
every score is 0; documents labelled twice count as toxic if any label says so; repeated rows
are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.words import WordIds, mixed, plain_words, shingles, space_words
from siteaudit.plans.session import cut

SAMPLE = 4_000
LEAST_DOCS, LEAST_SHARE = 4, 0.01  # a feature's documents and their share of the toxic ones
RATIO = 4.0
FOLDS = 3
LEXICON = 4_000
REACH = 4
ROUNDS = 150
PREFIXES = (4, 5, 6)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def features(word: bytes) -> list[str]:
    text = word.decode("utf-8", "surrogatepass")
    return [f"w:{text}", *(f"p:{text[:n]}" for n in PREFIXES if len(text) >= n)]


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(toxic, text) of at most ``most`` training documents of each class."""
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(~held_out())
    )
    first = [
        known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (1, 0)
    ]
    chosen = first[0].unionByName(first[1])  # 2 * most rows, so a broadcast is bounded
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    found = cut(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text"))

    def run(batches):
        ids = WordIds()
        for batch in batches:
            keys = []
            for text in batch.column(1):
                h = shingles(space_words(text.as_py()), ids)
                keys.append([int(mixed(h + np.uint64(k)).min()) >> 1 if len(h) else 0 for k in range(FOLDS)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([x[k] for x in keys], pa.int64()) for k in range(FOLDS))],
                ["toxic", "text", *(f"k{k}" for k in range(FOLDS))],
            )

    # Copies and near copies of one toxic text would make all its words look toxic: of texts
    # that share a least shingle, one stays.
    folded = found.mapInArrow(run, "toxic int, text string, " + ", ".join(f"k{k} long" for k in range(FOLDS)))
    for k in range(FOLDS):
        folded = folded.dropDuplicates([f"k{k}"])
    return cut(folded.select("toxic", "text"))


def lexicon(train: DataFrame, most: int = LEXICON) -> list[str]:
    """The features that tell toxic documents, best first; at most ``most``."""

    def run(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            docs = [0, 0]
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs[toxic] += 1
                counts[toxic].update({f for w in set(plain_words(text.as_py())) for f in features(w)})
            keys = sorted(set(counts[0]) | set(counts[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*keys, ""]),
                    pa.array([*(counts[1][k] for k in keys), docs[1]], pa.int64()),
                    pa.array([*(counts[0][k] for k in keys), docs[0]], pa.int64()),
                ],
                ["feature", "toxic", "clean"],
            )

    met = (
        train.mapInArrow(run, "feature string, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    total = met.where("feature = ''")
    rates = F.col("toxic") / F.col("nt") / ((F.col("clean") + 0.5) / (F.col("nc") + 0.5))
    rows = (
        met.where(f"feature <> '' AND toxic >= {LEAST_DOCS}")
        .join(F.broadcast(total.select(F.col("toxic").alias("nt"), F.col("clean").alias("nc"))))
        .withColumn("ratio", rates)
        .where(f"ratio >= {RATIO} AND toxic >= {LEAST_SHARE} * nt")
        .orderBy(F.desc("toxic"), "feature")
        .limit(most)
        .collect()
    )
    return [r["feature"] for r in rows]


class Lookup(dict):
    """word -> number of its set of features (0 for none); bounded."""

    def __init__(self, names: list[str], limit: int = 400_000):
        super().__init__()
        self.ids = {f: i for i, f in enumerate(names)}
        self.sets: list[tuple[int, ...]] = [()]
        self.number: dict[tuple[int, ...], int] = {(): 0}
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = tuple(self.ids[f] for f in features(word) if f in self.ids)
        if found not in self.number:
            self.number[found] = len(self.sets)
            self.sets.append(found)
        n = self[word] = self.number[found]
        return n

    def active(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """Places of the lexicon tokens and their features."""
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        at = np.nonzero(n)[0]
        return at, [self.sets[k] for k in n[at].tolist()]


def training_windows(train: DataFrame, names: list[str], reach: int = REACH):
    """(feature numbers, labels) of windows around lexicon tokens and one plain window a document."""
    width, deep = 2 * reach + 1, 1 + len(PREFIXES)

    def run(batches):
        look = Lookup(names)
        for batch in batches:
            feats, marks = [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = plain_words(text.as_py())
                at, sets = look.active(words)
                of = dict(zip(at.tolist(), sets, strict=True))
                for c in [*of, len(words) // 2]:
                    row, mark = np.full((width, deep), -1, np.int32), np.zeros(width, np.int8)
                    for k in range(width):
                        got = of.get(c - reach + k, ())
                        row[k, : len(got)] = got
                        mark[k] = bool(got) and toxic
                    feats.append(row.tobytes())
                    marks.append(mark.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(feats, pa.binary()), pa.array(marks, pa.binary())], ["f", "y"]
            )

    # Equal windows are folded, so what the fit reads is bounded by what differs in the sample.
    rows = (
        train.mapInArrow(run, "f binary, y binary")
        .groupBy("f", "y")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    x = np.array([np.frombuffer(r["f"], np.int32).reshape(width, deep) for r in rows]).reshape(-1, width, deep)
    y = np.array([np.frombuffer(r["y"], np.int8) for r in rows], np.int64).reshape(-1, width)
    return x, y, np.array([r["n"] for r in rows], float)


def _sweep(emit: np.ndarray, trans: np.ndarray):
    """Forward-backward over windows (rows, width, states): log Z, token and step marginals."""
    n, width, _ = emit.shape
    fwd, bwd = np.empty_like(emit), np.zeros_like(emit)
    fwd[:, 0] = emit[:, 0]
    for t in range(1, width):
        fwd[:, t] = np.logaddexp.reduce(fwd[:, t - 1][:, :, None] + trans, axis=1) + emit[:, t]
    for t in range(width - 2, -1, -1):
        bwd[:, t] = np.logaddexp.reduce(trans + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
    z = np.logaddexp.reduce(fwd[:, -1], axis=1)
    token = np.exp(fwd + bwd - z[:, None, None])
    steps = np.zeros((n, 2, 2))
    for t in range(1, width):
        steps += np.exp(
            fwd[:, t - 1][:, :, None] + trans + (emit[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]
        )
    return z, token, steps


def fit_field(x: np.ndarray, y: np.ndarray, n: np.ndarray, size: int, rounds: int = ROUNDS, ridge: float = 1e-3):
    """(weights, bias, transitions) that maximise the windows' likelihood, by Adam."""
    weights = np.zeros(size + 1)  # the last is for places without a feature and stays 0
    if not len(x):
        return weights[:-1], -10.0, np.zeros((2, 2))
    bias, trans = np.array(-4.0), np.zeros((2, 2))
    share = n / n.sum()
    slots = [np.zeros(size + 1), np.zeros(()), np.zeros((2, 2))]
    moments = [(s.copy(), s.copy()) for s in slots]
    onto = (y[:, :-1, None] == [0, 1])[:, :, :, None] & (y[:, 1:, None] == [0, 1])[:, :, None, :]
    seen = onto.sum(1)
    for step in range(1, rounds + 1):
        emit = np.zeros((*y.shape, 2))
        emit[:, :, 1] = weights[x].sum(2) + bias
        _, token, steps = _sweep(emit, trans)
        miss = (y - token[:, :, 1]) * share[:, None]
        g_w = np.bincount((x % (size + 1)).ravel(), np.repeat(miss.ravel(), x.shape[2]), size + 1)
        grads = [g_w - ridge * weights / max(1, size), miss.sum(), ((seen - steps) * share[:, None, None]).sum(0)]
        grads[0][-1] = 0
        values = []
        for (m, v), g, p in zip(moments, grads, (weights, bias, trans), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            values.append(p + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9))
        weights, bias, trans = values
        weights[-1] = 0
    return weights[:-1], float(bias), trans


class Field:
    """A fitted field, ready to run over whole texts."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float, trans: np.ndarray):
        self.names, self.weights, self.bias = names, weights, bias
        self.steps = np.exp(trans - trans[0, 0])
        self.plain = self.steps * np.array([1.0, np.exp(bias)])
        self.look = Lookup(names)
        self.powers: dict[int, np.ndarray] = {0: np.eye(2)}

    def power(self, n: int) -> np.ndarray:
        got = self.powers.get(n)
        if got is None:
            half = self.power(n // 2)
            got = half @ half @ (self.plain if n % 2 else np.eye(2))
            got = got / got.max()
            if len(self.powers) < 4096:
                self.powers[n] = got
        return got

    def marginals(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the lexicon tokens and the probability that each is toxic."""
        at, sets = self.look.active(words)
        if not len(at):
            return at, np.zeros(0)
        emit = np.array([[1.0, np.exp(min(60.0, self.bias + self.weights[list(s)].sum()))] for s in sets])
        gaps = np.diff(np.concatenate([[-1], at, [len(words)]])) - 1
        forward = np.empty((len(at), 2))
        a = None
        for i in range(len(at)):
            if a is None:
                # the first token of a text has no step before it
                a = emit[0] if gaps[0] == 0 else np.array([1.0, np.exp(self.bias)]) @ self.power(int(gaps[0]) - 1) @ self.steps * emit[0]
            else:
                a = a @ self.power(int(gaps[i])) @ self.steps * emit[i]
            a = a / a.sum()
            forward[i] = a
        backward = np.empty((len(at), 2))
        b = self.power(int(gaps[-1])) @ np.ones(2)
        for i in range(len(at) - 1, -1, -1):
            b = b / b.sum()
            backward[i] = b
            if i:
                b = self.power(int(gaps[i])) @ (self.steps @ (emit[i] * b))
        both = forward * backward
        return at, both[:, 1] / both.sum(1)


def evidence(p: np.ndarray) -> tuple[float, float]:
    """Of a document: the log odds of its largest marginal, and the log of their sum."""
    top = min(max(float(p.max(initial=0.0)), 1e-3), 1 - 1e-4)
    return float(np.log(top / (1 - top))), float(np.log(0.05 + p.sum()))


def fit_scale(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic weights (constant, largest, sum) by Newton steps with a small ridge."""
    if not len(x):
        return np.array([-20.0, 0.0, 0.0])
    full = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        curve = (full * (n * p * (1 - p))[:, None]).T @ full + 0.1 * np.eye(3)
        w = w + np.linalg.solve(curve, full.T @ (n * (y - p)) - 0.1 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """(names, weights, bias, transitions, scale), a model of bounded size."""
    train = sample(docs, labels, most)
    names = lexicon(train)
    weights, bias, trans = fit_field(*training_windows(train, names), len(names))

    def run(batches):
        field = Field(names, weights, bias, trans)
        for batch in batches:
            got = [evidence(field.marginals(plain_words(t.as_py()))[1]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([round(a, 2) for a, _ in got], pa.float64()),
                    pa.array([round(b, 2) for _, b in got], pa.float64()),
                ],
                ["toxic", "top", "total"],
            )

    rows = (
        train.mapInArrow(run, "toxic int, top double, total double")
        .groupBy("toxic", "top", "total")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    x = np.array([[r["top"], r["total"]] for r in rows]).reshape(-1, 2)
    scale = fit_scale(x, np.array([r["toxic"] for r in rows], float), np.array([r["n"] for r in rows], float))
    return names, weights, bias, trans, scale


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
SCORED = "doc_id long, score double, n_toxic long, spans array<struct<start:int,end:int,p:double>>"


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score, n_toxic, spans): spans are the characters of tokens more likely toxic than not."""
    names, weights, bias, trans, scale = model
    sent = docs.sparkSession.sparkContext.broadcast((names, weights, bias, trans, scale))

    def run(batches):
        field = Field(*sent.value[:4])
        w = sent.value[4]
        for batch in batches:
            scores, counts, spans = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                at, p = field.marginals(plain_words(text))
                top, total = evidence(p)
                scores.append(float(1 / (1 + np.exp(-np.clip(w[0] + w[1] * top + w[2] * total, -40, 40)))))
                marked = {int(i): float(v) for i, v in zip(at, p, strict=True) if v >= 0.5}
                counts.append(len(marked))
                spans.append(
                    [
                        {"start": m.start(), "end": m.end(), "p": marked[i]}
                        for i, m in enumerate(_WORD.finditer(text))
                        if i in marked
                    ]
                    if marked
                    else []
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN))],
                ["doc_id", "score", "n_toxic", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)
