"""Ranked lexical search by hashed max-sketches.

Each document's term impacts fold into a sketch: two hashes send a term to two coordinates, and a
coordinate keeps the largest term frequency that meets it. The impact of a term grows with its
frequency alone once the document is given, so the smaller of a term's two coordinates bounds its
impact from above, and a query's weighted sum bounds the score. The sketch is as wide as the
document needs (a power of two, eight coordinates or more a distinct term), so long documents are
bounded as tightly as short ones. Frequencies over 254 are stored as 255, which bounds like an
endless frequency.

Search goes in rounds. A round bounds all sketches for all queries of a block at once, takes each
query's next documents by descending bound and rescores them exactly from their texts; the tenth
best exact score is the threshold. When the bounds left lie below it, the query is done. After
``ROUNDS`` rounds everything still at or above the threshold is rescored at once, so results are exact.

Sizes: queries come in blocks of at most ``ITEMS`` items and ``TERMS`` terms, one block at a time;
what is broadcast is one block. Equal texts have equal scores and are bounded and rescored as one;
of a group of copies at most the ``k`` smallest ids can rank. Index tables are written once.

Edges: null, empty and termless documents have no term, do not count and never rank; an item
without terms has no result; each row of the items is an item of its own; repeated documents rank
each; a null doc_id ranks after the others of its score; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.words import WordIds, plain_words
from siteaudit.plans.session import cut, small

K = 10
ITEMS, TERMS = 1_000, 50_000
ROUNDS = (64, 1_024)  # documents a query takes in each round; then all that remain
LEAST_WIDTH, ROOM = 64, 8
VOCABULARY = 200_000  # terms counted in a task before their counts are handed on
CELLS = 2_000_000  # cells of documents x terms bounded at once
SCALE = 1_000_000_000
ENDLESS = SCALE // 1000

_INDEX = "key string, doc_id long, n long, sketch binary, term binary, df long"


def width(distinct: int) -> int:
    return max(LEAST_WIDTH, 1 << (ROOM * distinct - 1).bit_length())


def sketch(counts: Counter, ids: WordIds) -> bytes:
    """Coordinatewise maxima of the term frequencies, 255 standing for more than 254."""
    size = width(len(counts))
    h = ids.of(list(counts))
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), 255).astype(np.uint8)
    out = np.zeros(size, np.uint8)
    for at in coordinates(h, size):
        np.maximum.at(out, at, tf)
    return out.tobytes()


def coordinates(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(size - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def length_term(n, documents: int, terms: int):
    """m of a document with n terms, in whole numbers."""
    return 25 + (75 * n * documents) // terms


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf, m):
    return (SCALE * tf) // (1000 * tf + 8 * m)


def _sketched(batches):
    ids, seen = WordIds(), Counter()
    schema = pa.schema(
        [("key", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()),
         ("term", pa.binary()), ("df", pa.int64())]
    )

    def frequencies():
        part = pa.table({"term": pa.array(list(seen), pa.binary()), "df": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        for f in schema:
            if f.name not in part.column_names:
                part = part.append_column(f.name, pa.nulls(len(part), f.type))
        return part.select(schema.names).to_batches(max_chunksize=10_000)

    for batch in batches:
        rows = []
        for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
            words = plain_words(text)
            if not words:
                continue
            counts = Counter(words)
            seen.update(counts.keys())
            rows.append({"key": key, "doc_id": doc_id, "n": len(words), "sketch": sketch(counts, ids)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if len(seen) >= VOCABULARY:
            yield from frequencies()
    yield from frequencies()


@dataclass
class Index:
    """Sketches of all documents that have terms, and the document frequencies of all terms."""

    docs: DataFrame  # the documents themselves, for rescoring
    sketches: DataFrame  # key (digest of the text), doc_id, n, sketch
    frequencies: DataFrame  # term, df in parts
    documents: int
    terms: int


def index(docs: DataFrame) -> Index:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("key"))
    made = cut(source.where("text IS NOT NULL").mapInArrow(_sketched, _INDEX))
    sketches = made.where("term IS NULL").select("key", "doc_id", "n", "sketch")
    size = sketches.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
    return Index(source, sketches, made.where("term IS NOT NULL").select("term", "df"), size["n"], size["terms"] or 0)


def blocks(items: DataFrame, most_items: int = ITEMS, most_terms: int = TERMS):
    """Blocks of (item_id, term counts), read from the items one by one."""
    block, terms = [], set()
    for row in items.select("item_id", "text").toLocalIterator():
        counts = Counter(plain_words(row["text"]))
        if not counts:
            continue
        block.append((row["item_id"], counts))
        terms.update(counts)
        if len(block) >= most_items or len(terms) >= most_terms:
            yield block
            block, terms = [], set()
    if block:
        yield block


class Queries:
    """A block of queries: terms that occur, their coordinates and the weights by query."""

    def __init__(self, block: list, df: dict[bytes, int], found: Index):
        self.documents, self.terms = found.documents, found.terms
        self.vocabulary = sorted(df)
        at = {t: k for k, t in enumerate(self.vocabulary)}
        self.hashes = WordIds().of(self.vocabulary)
        self.weights = np.zeros((len(at), len(block)))
        # (term, weight x repeats) of each query
        self.queries: list[list[tuple[bytes, int]]] = []
        for q, (_, counts) in enumerate(block):
            mine = [(t, c * weight(self.documents, df[t])) for t, c in counts.items() if t in at]
            self.queries.append(mine)
            for t, w in mine:
                self.weights[at[t], q] = w

    def bounds(self, sketches: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Upper bounds of documents x queries; rows of one width. Sums stay below 2^53."""
        one, two = coordinates(self.hashes, sketches.shape[1])
        tf = np.minimum(sketches[:, one], sketches[:, two])
        d, t = np.nonzero(tf)
        f = tf[d, t].astype(np.int64)
        m = length_term(n.astype(object), self.documents, self.terms).astype(np.int64)
        most = np.zeros(tf.shape)
        most[d, t] = np.where(f == 255, ENDLESS, impact(f, m[d]))
        return most @ self.weights

    def score(self, words: list[bytes], wanted) -> list[int]:
        counts = Counter(words)
        m = length_term(len(words), self.documents, self.terms)
        return [sum(w * impact(counts[t], m) for t, w in self.queries[q] if t in counts) for q in wanted]


class Best:
    """The first ``most`` (bound descending, key ascending) of each query; all if ``most`` is None."""

    def __init__(self, most: int | None, queries: int):
        self.most, self.floor = most, np.zeros(queries)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, q, bound, key, doc_id) -> None:
        self.parts.append((q, bound, key, doc_id))
        self.held += len(q)
        if self.most is not None and self.held > 4 * self.most * len(self.floor):
            self.prune()

    def prune(self) -> None:
        if not self.parts:
            return
        q, bound, key, doc_id = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((key, -bound, q))
        q, bound, key, doc_id = q[order], bound[order], key[order], doc_id[order]
        # Copies of one text stand beside each other.
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (key[1:] != key[:-1])
        q, bound, key, doc_id = q[fresh], bound[fresh], key[fresh], doc_id[fresh]
        if self.most is not None:
            start = np.searchsorted(q, q)
            rank = np.arange(len(q)) - start
            last = rank == self.most - 1
            self.floor[q[last]] = bound[last]
            stay = rank < self.most
            q, bound, key, doc_id = q[stay], bound[stay], key[stay], doc_id[stay]
        self.parts, self.held = [(q, bound, key, doc_id)], len(q)


_FOUND = "q int, bound double, key string, doc_id long"


def _bounded(sent, most, floors, cursors):
    """Candidates of one round: bounds at or above the threshold, after the last round's end."""

    def run(batches):
        queries: Queries = sent.value
        best = Best(most, len(queries.queries))
        schema = pa.schema([("q", pa.int32()), ("bound", pa.float64()), ("key", pa.string()), ("doc_id", pa.int64())])
        at_bound = np.array([b for b, _ in cursors])
        at_key = np.array([k.encode() for _, k in cursors], "S32")

        def out():
            best.prune()
            for q, bound, key, doc_id in best.parts:
                ids = pa.array([None if x is None else int(x) for x in doc_id], pa.int64())
                yield from pa.table(
                    [pa.array(q, pa.int32()), pa.array(bound), pa.array([k.decode() for k in key], pa.string()), ids],
                    schema=schema,
                ).to_batches(max_chunksize=10_000)
            best.parts, best.held = [], 0

        for batch in batches:
            keys = np.array([k.encode() for k in batch.column("key").to_pylist()], "S32")
            _, first = np.unique(keys, return_index=True)
            raw, n = batch.column("sketch"), batch.column("n").to_numpy(zero_copy_only=False)
            ids = np.array(batch.column("doc_id").to_pylist(), object)
            sizes = np.array([len(raw[int(k)].as_buffer()) for k in first])
            for size in np.unique(sizes):
                rows = first[sizes == size]
                step = max(1, CELLS // max(len(queries.vocabulary), int(size), 1))
                for s in range(0, len(rows), step):
                    part = rows[s : s + step]
                    m = np.frombuffer(b"".join(raw[int(k)].as_py() for k in part), np.uint8).reshape(len(part), size)
                    b = queries.bounds(m, n[part])
                    d, q = np.nonzero((b > 0) & (b >= np.maximum(floors, best.floor)) & (b <= at_bound))
                    k = keys[part][d]
                    after = (b[d, q] < at_bound[q]) | (k > at_key[q])
                    d, q, k = d[after], q[after], k[after]
                    best.add(q, b[d, q], k, ids[part][d])
            if most is None:
                yield from out()
        yield from out()

    return run


def _rescored(sent):
    schema = pa.schema([("q", pa.int32()), ("key", pa.string()), ("score", pa.int64())])

    def run(batches):
        queries: Queries = sent.value
        for batch in batches:
            rows = []
            for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "wanted")), strict=True):
                scores = queries.score(plain_words(text), wanted)
                rows += [{"q": q, "key": key, "score": s} for q, s in zip(wanted, scores, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _one_block(found: Index, block: list, k: int, rounds) -> DataFrame | None:
    spark = found.docs.sparkSession
    terms = sorted({t for _, counts in block for t in counts})
    asked = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    df = {
        bytes(r["term"]): r["df"]
        for r in found.frequencies.join(F.broadcast(asked), "term")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
        .collect()  # at most the terms of the block
    }
    if not df:
        return None
    sent = spark.sparkContext.broadcast(Queries(block, df, found))
    floors = np.zeros(len(block))
    cursors = [(math.inf, "")] * len(block)
    scored: DataFrame | None = None
    for most in (*rounds, None):
        bounded = found.sketches.mapInArrow(_bounded(sent, most, floors, cursors), _FOUND)
        # A text is rescored once for a query, whichever of its copies is read.
        one = bounded.groupBy("q", "key").agg(F.max("bound").alias("bound"), F.min("doc_id").alias("doc_id"))
        if most is not None:
            order = Window.partitionBy("q").orderBy(F.desc("bound"), "key")
            one = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        taken = cut(one)
        rows = taken.count()
        if rows:
            wanted = taken.groupBy("key", "doc_id").agg(F.collect_list("q").alias("wanted"))
            wanted = small(wanted.select(F.col("key").alias("_key"), F.col("doc_id").alias("_doc"), "wanted"))
            texts = found.docs.join(
                wanted, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
            )
            fresh = texts.select("key", "text", "wanted").mapInArrow(_rescored(sent), "q int, key string, score long")
            fresh = cut(fresh.groupBy("q", "key").agg(F.max("score").alias("score")))
            scored = fresh if scored is None else scored.unionByName(fresh)
        if not rows or most is None:
            break
        order = Window.partitionBy("q").orderBy(F.desc("score"))
        tenth = scored.where("score > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
        for r in tenth.collect():  # one row a query
            floors[r["q"]] = r["score"]
        # Queries whose list ended before the round's size have nothing left.
        last = {r["q"]: r for r in taken.where(F.col("rank") == most).collect()}
        cursors = [(last[q]["bound"], last[q]["key"]) if q in last else (-1.0, "") for q in range(len(block))]
        if not last:
            break
    if scored is None:
        return None
    lowest = spark.createDataFrame([(q, int(f)) for q, f in enumerate(floors)], "q int, least long")
    winners = cut(
        scored.join(F.broadcast(lowest), "q").where((F.col("score") > 0) & (F.col("score") >= F.col("least"))).drop("least")
    )
    copies = found.sketches.select("key", "doc_id").join(small(winners.select("key").distinct()), "key", "left_semi")
    nth = Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last())
    copies = copies.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= k).drop("_n")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = winners.join(copies, "key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "q int, item_id long")
    return top.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, rounds=ROUNDS, most_items: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents."""
    found = index(docs)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items, most_items):
        made = _one_block(found, block, k, rounds) if found.documents else None
        if made is not None:
            out = out.unionByName(made)
    return out
