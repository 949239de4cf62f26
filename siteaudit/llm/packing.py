"""Packing by minimum bin slack.

Texts are tokenised where they lie. A document's ids are cut at every full window; full
pieces are sequences of their own. The remainders (at most one a document) are dealt into
blocks of bounded size, and in each block one window after another is seeded with the longest
remainder left and filled with the multiset of the others whose sum comes closest to its
capacity: a subset-sum over a bitset held in one integer, with the counts of each length in
binary parts, and the chosen counts traced back through the bitsets kept for each step.

Edges: a null or empty text is one piece with the end id alone; repeated rows are packed each
for itself; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.plans.session import cut

WINDOW = 4096
END_ID = 2
BLOCK_PIECES = 20_000
CACHED_WORDS = 700_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, `offset` long"

_caches: dict = {}


class WordCodes:
    """Token ids of texts, word by word.

    The tokenizer never joins characters over white space, so the ids of a text are those of
    its blank-separated words in turn. Words met before are looked up; the table is emptied
    when it holds ``limit`` words. The tokenizer lowers case itself, so words are looked up in
    lower case, but for texts with a letter whose lower case is not a matter of that letter
    alone, or with what may be a special token. A word that ends in signs after a letter is its stem and the run of signs, as the
    tokenizer splits there too. Stems of letters alone are encoded many at once and told apart
    by the tokens that end words.
    """

    SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    AT_ONCE = 200

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _codes(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        got = self.tok.encode_batch_fast(other, add_special_tokens=False)
        out = {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(other, got, strict=True)}
        groups = [plain[i : i + self.AT_ONCE] for i in range(0, len(plain), self.AT_ONCE)]
        got = self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, got, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (np.nonzero(self.ends[ids])[0] + 1) * 4
            if len(ends) != len(group):  # a letter that the tokenizer knows otherwise
                alone = self.tok.encode_batch_fast(group, add_special_tokens=False)
                out |= {w: np.asarray(x.ids, "<u4").tobytes() for w, x in zip(group, alone, strict=True)}
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(group, ends.tolist(), strict=True):
                out[w] = raw[start:end]
                start = end
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known = self.known
        if len(known) >= self.limit:
            known.clear()
            known[""] = b""
        split = []
        for t in texts:
            t = (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
            if not ("\u0130" in t or "\u03a3" in t or "<|" in t):
                t = t.lower()
            split.append(t.split(" "))
        new = {w for words in split for w in words if w not in known}
        tails = {}
        stems = set()
        for w in new:
            stem = w.rstrip(self.SIGNS) if "<|" not in w else w
            if stem and stem != w and stem[-1].isalpha():
                tails[w] = (stem, w[len(stem) :])
                stems.update(x for x in tails[w] if x not in known)
            else:
                stems.add(w)
        known |= self._codes(list(stems))
        for w, (stem, tail) in tails.items():
            known[w] = known[stem] + known[tail]
        return [b"".join(map(known.__getitem__, words)) for words in split]


def codes(path: str) -> WordCodes:
    """One table of words for each Python worker, kept from task to task."""
    if path not in _caches:
        _caches[path] = WordCodes(path)
    return _caches[path]


def _batches(column: pa.ChunkedArray | pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list]]:
    """Runs of texts of about ``most`` characters, with the place of the first."""
    first, held, size = 0, [], 0
    for i, x in enumerate(column):
        s = x.as_py()
        held.append(s)
        size += len(s or "")
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Pieces of at most ``window`` ids: where each starts in its document, and its checksum."""

    def run(batches):
        table = codes(vocabulary)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[], [], [], [], []]
            for first, texts in _batches(batch.column(1)):
                for k, b in enumerate(table.encode(texts)):
                    b += end
                    total = len(b) // 4
                    for start in range(0, total, window):
                        part = b[4 * start : 4 * (start + window)]
                        row = (ids[first + k], start, len(part) // 4, zlib.crc32(part), total)
                        for col, v in zip(out, row, strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fill(lengths: list[int], window: int) -> list[list[int]]:
    """Places of ``lengths`` in windows, each window filled with the least slack it can get."""
    places = defaultdict(list)
    for i, n in enumerate(lengths):
        places[n].append(i)
    order = sorted(places, reverse=True)
    bins = []
    while order:
        top = order[0]
        chosen, room = [places[top].pop()], window - top
        bits, steps, mask = 1, [], (1 << (room + 1)) - 1
        for n in order:
            left = min(len(places[n]), room // n)
            part = 1
            while left > 0:
                take = min(part, left)
                steps.append((n, take, bits))
                bits |= (bits << (n * take)) & mask
                left, part = left - take, part * 2
            if bits >> room:
                break
        best = bits.bit_length() - 1
        for n, take, before in reversed(steps):
            if not before >> best & 1:
                chosen += [places[n].pop() for _ in range(take)]
                best -= n * take
        bins.append(chosen)
        order = [n for n in order if places[n]]
    return bins


def pack(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, block: int = BLOCK_PIECES
) -> DataFrame:
    """Pieces with the sequence and the offset that each takes. See the module's text."""
    made = cut(pieces(docs, vocabulary, window))
    numbered = made.withColumn("place", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == window).select(
        *made.columns,
        (F.col("place") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest = numbered.where(F.col("length") < window)
    blocks = max(1, -(-made.where(F.col("length") < window).count() // block))

    def one(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        at = table.column("block")[0].as_py()
        seq, off = [0] * len(lengths), [0] * len(lengths)
        for k, chosen in enumerate(fill(lengths, window)):
            used = 0
            for i in chosen:
                seq[i], off[i] = ((at << 32) + k) * 2, used
                used += lengths[i]
        return table.drop_columns(["block"]).append_column(
            "sequence_id", pa.array(seq, pa.int64())
        ).append_column("offset", pa.array(off, pa.int64()))

    packed = (
        rest.withColumn("block", F.pmod(F.hash("place"), F.lit(blocks)).cast("long"))
        .select(*made.columns, "block")
        .groupBy("block")
        .applyInArrow(one, PACKED)
    )
    return full.unionByName(packed)
