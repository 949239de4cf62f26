"""Prefix trie of conversations by a splitter skeleton.

Every conversation is a path of turn digests. A bounded sample of the paths gives the splitters of
a range partition; whatever prefix lies in two shards is a prefix of a splitter, so the trie of the
splitter paths (the skeleton) holds every node that a shard cannot finish alone. The skeleton is
broadcast. Each shard sorts its paths, walks them once with a stack and finishes all its other
nodes; of skeleton nodes it gives partial aggregates without their skeleton children. Those are
summed over the shards, added up from the leaves of the skeleton to its root, and joined back to
the nodes that hang below it.

Sizes: shards are ranges of (path, conv_id), which no two rows share, so a path that a third of all
conversations take is spread over many shards like any other. The sample holds ``SAMPLE`` paths a
shard; the skeleton holds one path between two shards and is all the driver sees. The ids that end
at a skeleton node are joined into pieces of ``PIECE`` ids in the shards; the digest reads those
pieces in order as a stream. A conversation is one record of 20 bytes a turn; its texts are
never gathered.

Edges: rows without a conv_id belong to no conversation; turns go by number, null first, equal
numbers by digest; a null role or text is the empty string; repeated rows are turns of their own;
a conversation without turns after the rebuild ends at the root; an empty table has no node; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.plans.session import cut

BLOCK = 16  # bytes of a turn's digest
SHARD_ROWS = 100_000
SAMPLE = 32  # sampled paths for each shard
PIECE = 256  # ids in a piece

_SHARD = (
    "kind int, owner int, conv_id long, depth long, parent_owner int, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "chars long, shard int, piece int, ids string"
)
NODE, PARTIAL, ENDS = 0, 1, 2


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex characters of SHA-256 over the role's length, the role and the text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole, 256), 1, 2 * BLOCK)


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): ordered array of (turn, digest, chars)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn"), turn_digest(role, text).alias("digest"), F.length(text).alias("chars")
        ).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns of the family's first conversation, then the own ones
    after the first h; h is the CRC-32 of the decimal id, modulo ``heads``. The family's first id
    is ``conv_id - conv_id % family``, with SQL's remainder (it takes the sign of the id)."""
    own = cut(own_turns(conversations))
    head = own.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, max(heads - 1, 1)).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % family
    none = F.slice("turns", 1, 0)
    return (
        own.withColumn("h", h)
        .withColumn("base", base)
        .join(head, "base", "left")
        .select(
            "conv_id",
            F.concat(
                F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
                F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
            ).alias("turns"),
        )
    )


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, chars) of (conv_id, turns)."""
    return turns.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // BLOCK
    lo, hi = 0, most // BLOCK  # a[:lo] is shared, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[: mid * BLOCK] == b[: mid * BLOCK]:
            lo = mid
        else:
            hi = mid
    return lo


class Skeleton:
    """The trie of the splitter paths: node (owner, depth), owner being the first splitter of
    that prefix."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.owners: list[list[int]] = []
        for k, (path, _) in enumerate(splitters):
            shared = common(splitters[k - 1][0], path) if k else -1
            before = self.owners[-1][: shared + 1] if k else []
            self.owners.append(before + [k] * (len(path) // BLOCK + 1 - len(before)))

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def parent(self, owner: int, depth: int) -> tuple[int, int]:
        return self.owners[owner][depth - 1], depth - 1

    def sides(self, shard: int) -> list[tuple[int, bytes]]:
        """The splitters left and right of a shard."""
        return [(k, self.splitters[k][0]) for k in (shard - 1, shard) if 0 <= k < len(self.splitters)]


def skeleton(ranged: DataFrame, shards: int, rows: int) -> Skeleton:
    """Splitters from a bounded sample: ``SAMPLE`` paths a shard, chosen by the hash of the id."""
    scale = 1 << 30
    share = min(scale, -(-shards * SAMPLE * scale // max(rows, 1)))
    some = (
        ranged.where(F.pmod(F.xxhash64("conv_id"), F.lit(scale)) < share)
        .select("path", "conv_id")
        .collect()
    )
    some = sorted((bytes(r["path"]), r["conv_id"]) for r in some)
    at = {k * len(some) // shards for k in range(1, shards)} if some else set()
    return Skeleton([some[k] for k in sorted(at)])


class _Node:
    __slots__ = ("children", "chars", "depth", "least", "leaves", "n", "owner", "parent", "saved", "sha")

    def __init__(self, depth, chars, owner, parent):
        self.depth, self.chars, self.owner, self.parent = depth, chars, owner, parent
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.sha = None


def _close(node: _Node) -> None:
    """Add a finished node to its parent; skeleton nodes are added up after the reduction."""
    if node.owner is not None:
        return
    node.leaves = node.leaves or 1
    node.saved += (node.n - 1) * node.chars
    up = node.parent
    if up is not None:
        up.n += node.n
        up.children += 1
        up.leaves += node.leaves
        up.saved += node.saved
        up.least = node.least if up.least is None else min(up.least, node.least)


def walk(rows: list[tuple[bytes, int, list[int]]], shard: int, tree: Skeleton) -> list[dict]:
    """The nodes of one shard; ``rows``: (path, conv_id, chars of each turn)."""
    rows.sort(key=lambda r: r[:2])
    sides = tree.sides(shard)
    nodes: list[_Node] = []
    stack: list[_Node] = []
    pieces: list[dict] = []
    held: list[int] = []

    def flush(node: _Node) -> None:
        if held:
            pieces.append({"kind": ENDS, "owner": node.owner, "depth": node.depth, "shard": shard,
                           "piece": len(pieces), "ids": ",".join(map(str, held))})
            held.clear()

    before: bytes | None = None
    for path, conv, chars in rows:
        if path != before:
            if stack and stack[-1].owner is not None:
                flush(stack[-1])
            keep = common(before, path) + 1 if before is not None else 0
            while len(stack) > keep:
                _close(stack.pop())
            owned = [(common(side, path), k) for k, side in sides]
            for depth in range(keep, len(path) // BLOCK + 1):
                owner = next((tree.owners[k][depth] for far, k in owned if far >= depth), None)
                node = _Node(depth, chars[depth - 1] if depth else 0, owner, stack[-1] if stack else None)
                nodes.append(node)
                stack.append(node)
            before = path
        end = stack[-1]
        end.n += 1
        end.least = conv if end.least is None else min(end.least, conv)
        if end.owner is not None:
            held.append(conv)
            if len(held) == PIECE:
                flush(end)
        elif end.sha is None:
            end.sha = hashlib.sha256(b"%d" % conv)
        else:
            end.sha.update(b",%d" % conv)
    if stack and stack[-1].owner is not None:
        flush(stack[-1])
    while stack:
        _close(stack.pop())
    nothing = hashlib.sha256().hexdigest()
    out = []
    for v in nodes:
        up = v.parent
        local = up is not None and up.owner is None
        out.append(
            {
                "kind": NODE if v.owner is None else PARTIAL,
                "owner": v.owner,
                "conv_id": v.least,
                "depth": v.depth,
                "parent_owner": None if up is None else up.owner,
                "parent_conv_id": up.least if local else None,
                "n_convs": v.n,
                "n_children": v.children,
                "n_leaves": v.leaves,
                "saved_tokens": v.saved,
                "ends_sha256": v.sha.hexdigest() if v.sha else nothing,
                "chars": v.chars,
            }
        )
    return out + pieces


def _digests(batches):
    """Digests of the pieces, which arrive in order, a node's together."""
    now, sha = None, None

    def row():
        return pa.RecordBatch.from_pylist(
            [{"owner": now[0], "depth": now[1], "ends": sha.hexdigest()}],
            schema=pa.schema([("owner", pa.int32()), ("depth", pa.int64()), ("ends", pa.string())]),
        )

    for batch in batches:
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids")), strict=True):
            if now != (owner, depth):
                if now is not None:
                    yield row()
                now, sha = (owner, depth), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if now is not None:
        yield row()


def _finished(partial: list, tree: Skeleton) -> list[tuple]:
    """Add the partial sums of the skeleton up from its leaves to its root."""
    total = {(r["owner"], r["depth"]): r.asDict() for r in partial}
    for owner, depth in sorted(total, key=lambda k: -k[1]):
        v = total[owner, depth]
        v["n_leaves"] = v["n_leaves"] if v["n_children"] else 1
        v["saved_tokens"] += (v["n_convs"] - 1) * v["chars"]
        if depth:
            up = total[tree.parent(owner, depth)]
            up["n_children"] += 1
            for c in ("n_convs", "n_leaves", "saved_tokens"):
                up[c] += v[c]
            up["conv_id"] = v["conv_id"] if up["conv_id"] is None else min(up["conv_id"], v["conv_id"])
    out = []
    for (owner, depth), v in total.items():
        up = total[tree.parent(owner, depth)]["conv_id"] if depth else None
        out.append((owner, depth, v["conv_id"], up, v["n_convs"], v["n_children"], v["n_leaves"], v["saved_tokens"]))
    return out


def trie(turns: DataFrame, shard_rows: int = SHARD_ROWS, shards: int | None = None) -> DataFrame:
    """One row a node of the trie over (conv_id, turns). See the module's text."""
    spark = turns.sparkSession
    ranged = cut(paths(turns))
    rows = ranged.count()
    if shards is None:
        shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // shard_rows))
    tree = skeleton(ranged, max(1, min(shards, rows)), rows)
    sent = spark.sparkContext.broadcast(tree)

    def numbered(batches):
        for b in batches:
            at = [sent.value.shard(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield b.append_column("shard", pa.array(at, pa.int32()))

    fields = {f.split()[0]: f.split()[1] for f in _SHARD.split(", ")}
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c, kinds[k]) for c, k in fields.items()])

    def local(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        found = zip(*(table.column(c).to_pylist() for c in ("path", "conv_id", "chars")), strict=True)
        return pa.Table.from_pylist(walk(list(found), shard, sent.value), schema=schema)

    made = cut(
        ranged.mapInArrow(numbered, "conv_id long, path binary, chars array<int>, shard int")
        .groupBy("shard")
        .applyInArrow(local, _SHARD)
    )
    partial = (
        made.where(F.col("kind") == PARTIAL)
        .groupBy("owner", "depth")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.max("chars").alias("chars"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
        .collect()  # the skeleton: one path between two shards
    )
    top = spark.createDataFrame(
        _finished(partial, tree),
        "owner int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long",
    )
    ends = (
        made.where(F.col("kind") == ENDS)
        .select("owner", "depth", "shard", "piece", "ids")
        .repartition("owner", "depth")
        .sortWithinPartitions("owner", "depth", "shard", "piece")
        .select("owner", "depth", "ids")
        .mapInArrow(_digests, "owner int, depth long, ends string")
    )
    columns = (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
    nothing = F.sha2(F.lit(""), 256)
    upper = top.join(ends, ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", nothing))
    over = F.broadcast(
        top.select(
            F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_up")
        )
    )
    lower = (
        made.where(F.col("kind") == NODE)
        .join(over, ["parent_owner", "depth"], "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    )
    return upper.select(*columns).unionByName(lower.select(*columns))
