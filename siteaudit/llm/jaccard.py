"""N-gram Jaccard join over a count-vector R-tree.

A text becomes the set of its distinct five-word shingles. The shingles are hashed into groups
and the counts of the groups are a point; the overlap of two sets is at most the sum of the
smaller coordinates. Points are packed into an R-tree whose boxes bound whole subtrees the same
way, the tree is joined with itself, and what survives is verified on the sets.

In many dimensions boxes of unlike texts overlap, so one tree over a corpus would meet nearly
all pairs. The points are therefore dealt into blocks first, one tree a block:

* A set's first shingles in hash order are its keys: ``n // 4 + 1`` of them, at most 32. Two
  sets that link share a key: for fewer than 128 shingles always (the prefix bound), beyond
  that unless 32 shingles in hash order all miss a common part of three quarters, which is
  rarer than 2 ** -64, the rate at which 64-bit hashes of shingles collide anyway.
* A key held by more than ``block`` sets is split by the next shingle two sets may share, and
  what still has more than ``chunk`` sets into chunks that meet in pairs. No block drops a set.

A block reports links between points as a spanning forest, since only classes matter. Classes
of possible links are verified on whole sets; each set travels there once.
Equal sets are folded before all that.

Edges: null texts and texts without words have no shingles, link with nothing and stand for
themselves; repeated rows are equal sets; an empty table gives no rows; other columns are not
read. A null ``doc_id`` never names a component unless all its ids are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.components import components
from siteaudit.llm.naming import unused
from siteaudit.llm.words import WordIds, shingles, space_words
from siteaudit.plans.session import cut, small

SIZE = 5
KEYS = 32
DIMS = 64
LEAF = 32
BLOCK = CHUNK = 16_000  # sets that meet in one task: beyond, a key is split, then dealt into chunks
CLASS_SHINGLES = 3_000_000


def linked(common, n_a, n_b):
    """Jaccard of at least 0.75: 100 * both >= 75 * (a + b - both)."""
    return 7 * common >= 3 * (n_a + n_b)


def point(hashes: np.ndarray) -> bytes:
    """Counts of the groups, about eight shingles a group; empty where a count leaves a byte."""
    bits = max(6, int(len(hashes) // 8).bit_length())
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def folded(counts: np.ndarray, dims: int) -> np.ndarray:
    return counts.reshape(dims, -1).sum(1)


class Forest:
    """Union-find over the places of a block."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            above = up[up]
            if np.array_equal(above, up):
                return up
            up[:] = above

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def tree(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list]:
    """Order of the points and, level by level from the leaves, (highest, smallest n, largest n)."""
    order = np.lexsort((points[:, 0], points[:, 1], sizes))
    p, s = points[order], sizes[order]
    levels = []
    hi, lo_n, hi_n, step = p, s, s, LEAF
    while True:
        at = np.arange(0, len(hi), step)
        hi, lo_n, hi_n = np.maximum.reduceat(hi, at), np.minimum.reduceat(lo_n, at), np.maximum.reduceat(hi_n, at)
        levels.append((hi, lo_n, hi_n))
        step = 8
        if len(at) == 1:
            return order, levels


def joined_leaves(levels: list) -> Iterator[tuple[int, int]]:
    """Pairs of leaves whose boxes may hold a linked pair: the R-tree joined with itself."""
    todo = [(len(levels) - 1, 0, 0)]
    while todo:
        level, a, b = todo.pop()
        if level == 0:
            yield a, b
            continue
        hi, lo_n, hi_n = levels[level - 1]
        top = len(lo_n)
        for i in range(8 * a, min(8 * a + 8, top)):
            js = np.arange(max(i, 8 * b), min(8 * b + 8, top))
            if len(js):
                most = np.minimum(hi[i], hi[js]).sum(1)
                fits = linked(most, lo_n[i], lo_n[js]) & (4 * hi_n[i] >= 3 * lo_n[js])
                todo += [(level - 1, i, int(j)) for j in js[fits]]


def links(counts: list[bytes], sizes: np.ndarray, sets: list[np.ndarray] | None = None, sides=None):
    """A spanning forest of the linked places of one block, as pairs of places.

    Without ``sets`` a link means that the counts allow one; with them it is exact.
    ``sides``: two places of one and the same side, 0 or 1, need no test here (2 for a chunk
    that meets itself).
    """
    raw = [np.frombuffer(c, np.uint8).astype(np.int32) for c in counts]
    wild = 1 << 28
    points = np.stack([folded(r, DIMS) if len(r) else np.full(DIMS, wild // DIMS, np.int32) for r in raw])

    def test(i: int, j: int) -> bool:
        a, b = raw[i], raw[j]
        if len(a) and len(b):
            dims = min(len(a), len(b))
            if dims > DIMS and not linked(
                int(np.minimum(folded(a, dims), folded(b, dims)).sum()), sizes[i], sizes[j]
            ):
                return False
        if sets is None:
            return True
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return bool(linked(common, sizes[i], sizes[j]))

    out = []
    forest = Forest(len(counts))
    order, levels = tree(points, sizes)
    p, s = points[order], sizes[order]
    for a, b in joined_leaves(levels):
        ia, ib = order[LEAF * a : LEAF * a + LEAF], order[LEAF * b : LEAF * b + LEAF]
        roots = forest.roots()
        ra, rb = roots[ia], roots[ib]
        if ra[0] == rb[0] and (ra == ra[0]).all() and (rb == rb[0]).all():
            continue
        pa_, pb_ = p[LEAF * a : LEAF * a + LEAF], p[LEAF * b : LEAF * b + LEAF]
        most = np.minimum(pa_[:, None, :], pb_[None, :, :]).sum(2)
        fits = linked(most, s[LEAF * a : LEAF * a + LEAF][:, None], s[LEAF * b : LEAF * b + LEAF][None, :])
        fits &= ra[:, None] != rb[None, :]
        if sides is not None:
            fits &= (sides[ia][:, None] != sides[ib][None, :]) | (sides[ia][:, None] == 2)
        if a == b:
            fits &= np.triu(np.ones_like(fits), 1)
        for x, y in zip(*np.nonzero(fits), strict=True):
            i, j = int(ia[x]), int(ib[y])
            if forest.root(i) != forest.root(j) and test(i, j):
                forest.join(i, j)
                out.append((i, j))
    return out


def sketch(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, t, n, s1, s2, keys, counts) of each text: t is the text's digest, s1 and s2 name the
    set by 128 bits."""

    def run(batches):
        ids = WordIds()
        for batch in batches:
            n, s1, s2, keys, counts = [], [], [], [], []
            for text in batch.column(1):
                h = shingles(space_words(text.as_py()), ids, size)
                name = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                n.append(len(h))
                s1.append(int.from_bytes(name[:8], "little", signed=True))
                s2.append(int.from_bytes(name[8:], "little", signed=True))
                keys.append(h[: 2 * KEYS].view(np.int64))
                counts.append(point(h))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n, pa.int64()),
                    pa.array(s1, pa.int64()),
                    pa.array(s2, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(counts, pa.binary()),
                ],
                ["doc_id", "t", "n", "s1", "s2", "keys", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", F.md5("text").alias("t")).mapInArrow(
        run, "doc_id long, t string, n long, s1 long, s2 long, keys array<long>, counts binary"
    )


def _runs(batches, by: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition sorted by ``by``, one after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in by):
            change[0] = True
        starts = np.nonzero(change)[0].tolist()
        at = 0
        for k in starts:
            if k > at:
                held.append(batch.slice(at, k - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], k
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


LINKS = "u long, v long"


def _links_of(group: pa.Table, sets=None):
    nodes, sizes = group.column("node").to_numpy(), group.column("n").to_numpy()
    sides = group.column("side").to_numpy()
    found = links(
        group.column("counts").to_pylist(), sizes, sets, sides if (sides != 2).any() else None
    )
    return [(int(nodes[i]), int(nodes[j])) for i, j in found]


def _as_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _meet_blocks(batches):
    out: list = []
    for group in _runs(batches, ["key"]):
        if len(group) > 1:
            out += _links_of(group)
        if len(out) > 20_000:
            yield _as_batch(out)
            out = []
    yield _as_batch(out)


def chunked(rows: DataFrame, by: str, chunks, name) -> DataFrame:
    """Rows of groups too large for one task, dealt so that any two meet in some group.

    Adds ``side``: 2 for all rows of a group that is whole, else which of two chunks.
    """
    return (
        rows.withColumn("chunks", chunks)
        .withColumn("a", F.pmod(F.xxhash64("node", F.lit(11)), F.col("chunks")))
        .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
        .withColumn("side", F.when(F.col("a") == F.col("b"), 2).when(F.col("a") < F.col("b"), 0).otherwise(1))
        .withColumn(
            name,
            F.when(F.col("chunks") == 1, F.col(by)).otherwise(
                F.xxhash64(by, F.least("a", "b"), F.greatest("a", "b"))
            ),
        )
        .drop("chunks", "a", "b")
    )


def blocks(sets: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(key, node, side): the blocks whose points are to meet, each of bounded size."""
    first = sets.select(
        "node",
        F.explode(F.slice("keys", 1, F.least(F.floor(F.col("n") / 4) + 1, F.lit(KEYS)).cast("int"))).alias("key"),
    )
    met_by = first.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"),
    ).where("m > 1")
    # Near copies share many keys: of keys with the same sets, told by two digests, one is enough.
    once = F.when(F.col("m") > block, F.col("key"))
    shared = cut(met_by.groupBy("m", "x", "y", once.alias("hot")).agg(F.min("key").alias("key")).select("key", "m"))
    met = first.join(shared, "key")
    hot = met.where(F.col("m") > block).select("node", "key")
    finer = (
        hot.join(sets.select("node", "keys"), "node")
        .withColumn("at", F.array_position("keys", F.col("key")).cast("int"))
        .select("node", "key", F.explode(F.slice("keys", F.col("at") + 1, F.lit(KEYS))).alias("second"))
        .select("node", F.xxhash64("key", "second").alias("key"))
    )
    again = finer.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    split = finer.join(again, "key")
    rows = met.where(F.col("m") <= block).unionByName(split)
    return chunked(rows, "key", F.ceil(F.col("m") / chunk).cast("long"), "key").select("key", "node", "side")


def _classed(docs: DataFrame, size: int, block: int, chunk: int, class_shingles: int) -> DataFrame:
    """(doc_id, t, n, node, root, component_id) for each row; root names the class of the row's set."""
    sketches = cut(sketch(docs, size))
    sets = cut(
        sketches.where("n > 0")
        .groupBy("n", "s1", "s2")
        .agg(
            F.min("doc_id").alias("least_doc"),
            F.min(F.struct("t", "doc_id")).alias("at"),  # a row that holds the set
            F.first("keys").alias("keys"),
            F.first("counts").alias("counts"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    met = blocks(sets, block, chunk).join(sets.select("node", "n", "counts"), "node")
    maybe = (
        met.repartition("key").sortWithinPartitions("key").mapInArrow(_meet_blocks, LINKS)
    )
    classes = components(maybe)
    found = components(_verified(docs, sets, classes, size, class_shingles))

    whole = found.join(sets.select("node", "least_doc"), "node").groupBy("root").agg(
        F.min("least_doc").alias("component_id")
    )
    named = found.join(whole, "root").select("node", "root", "component_id")
    by_set = sets.select("n", "s1", "s2", "node", "least_doc").join(named, "node", "left").select(
        "n", "s1", "s2", "node", F.coalesce("root", "node").alias("root"),
        F.coalesce("component_id", "least_doc").alias("component_id"),
    )
    return sketches.select("doc_id", "t", "n", "s1", "s2").join(by_set, ["n", "s1", "s2"], "left")


def components_of(
    docs: DataFrame,
    size: int = SIZE,
    block: int = BLOCK,
    chunk: int = CHUNK,
    class_shingles: int = CLASS_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``. See the module's text."""
    return _classed(docs, size, block, chunk, class_shingles).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _verified(docs: DataFrame, sets: DataFrame, classes: DataFrame, size: int, most: int) -> DataFrame:
    """Exact links inside the classes of possible links; a set's text is fetched by digest and id."""
    inside = classes.select("node", F.col("root").alias("class")).join(
        sets.select("node", "n", "s1", "at", "counts"), "node"
    )
    sums = inside.groupBy("class").agg(F.sum("n").alias("total"))
    dealt = chunked(inside.join(sums, "class"), "class", F.ceil(F.col("total") / most).cast("long"), "part")
    texts = docs.select(F.md5("text").alias("t"), F.col("doc_id").cast("long").alias("doc"), "text")
    dealt = dealt.select("part", "side", "node", "n", "s1", "counts", "at")
    rows = dealt.join(
        texts, (F.col("at.t") == F.col("t")) & F.col("at.doc_id").eqNullSafe(F.col("doc"))
    ).drop("at", "t", "doc")

    def run(batches):
        ids = WordIds()
        out: list = []
        for group in _runs(batches, ["part"]):
            keep, sets_, seen = [], [], set()
            for k, (node, s1, text) in enumerate(
                zip(group.column("node").to_pylist(), group.column("s1").to_pylist(), group.column("text"), strict=True)
            ):
                if node in seen:  # a repeated row
                    continue
                h = shingles(space_words(text.as_py()), ids, size)
                name = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                if int.from_bytes(name[:8], "little", signed=True) == s1:
                    seen.add(node)
                    keep.append(k)
                    sets_.append(h)
            if len(keep) > 1:
                out += _links_of(group.drop_columns(["text"]).take(keep), sets_)
            if len(out) > 20_000:
                yield _as_batch(out)
                out = []
        yield _as_batch(out)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, LINKS)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class of linked texts left: that of the least id, and of
    the least text digest among equal ids.

    A document is a row's id and text together, so an id that repeats with another text loses
    nothing by the first one's copies. Documents without shingles or without an id stay. Rows of
    one id and text count once.
    """
    found = cut(_classed(docs, SIZE, BLOCK, CHUNK, CLASS_SHINGLES).where("n > 0").select("doc_id", "t", "root"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    first = found.groupBy("root").agg(F.min(row).alias("first"))
    judged = found.where("doc_id IS NOT NULL").join(first, "root").withColumn("stays", row == F.col("first"))
    key, doc, digest = unused(docs.columns, "key", "doc", "digest")

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias(doc), F.col("t").alias(digest))

    keyed = docs.withColumn(key, F.md5("text"))
    same = lambda side: (F.col(key) == side[digest]) & F.col("doc_id").cast("long").eqNullSafe(side[doc])
    gone = small(cut(named(judged.where("NOT stays")).distinct()))
    kept = keyed.join(gone, same(gone), "left_anti")
    again = cut(named(judged.where("stays").groupBy("doc_id", "t").count().where("count > 1")))
    if not again.limit(1).count():
        return kept.select(*docs.columns)
    twice = small(again)
    return (
        kept.join(twice, same(twice), "left_anti")
        .unionByName(kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
        .select(*docs.columns)
    )
