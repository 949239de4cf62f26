"""Benchmark decontamination with one automaton over the windows of the test items.

Items are normalised to words and cut into windows of ten words; the windows, framed by
blanks, are the patterns of an Aho-Corasick automaton. A document is normalised the same way
and read once; matches are mapped back to word numbers and to character offsets of the
original text.

The patterns travel to the tasks in blocks of at most ``BLOCK_BYTES`` and a benchmark beyond
that is scanned block after block in the same pass, so nothing unbounded is broadcast.

Edges: null and empty texts have no words and are clean; an item without words has no window;
an item without an id marks words and is not listed; repeated items count once by id; repeated
documents are scanned each; empty tables give empty or all-clean results; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.words import plain_words

WINDOW = 10
BLOCK_BYTES = 32_000_000

RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
    "contaminated boolean, items array<string>, spans array<struct<start:int,end:int>>"
)
_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_automata: dict = {}


def blocks(items: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES):
    """Blocks of {window: item ids}, each of bounded size, read from the items one by one."""
    block: dict[bytes, list[str]] = defaultdict(list)
    size = 0
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        words = plain_words(row["text"])
        for k in range(max(len(words) - window, 0) + 1 if words else 0):
            key = b" " + b" ".join(words[k : k + window]) + b" "
            if row["item_id"] is not None:
                block[key].append(str(row["item_id"]))
            else:
                block[key]
            size += len(key) + 16
        if size >= most:
            yield dict(block)
            block, size = defaultdict(list), 0
    if block:
        yield dict(block)


def automaton(patterns: dict[bytes, list[str]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for key, ids in patterns.items():
        made.add_word(key.decode("latin-1"), (len(key.split()), tuple(ids)))
    made.make_automaton()
    return made


def scan(words: list[bytes], machines) -> tuple[np.ndarray, set[str]]:
    """Which words lie in a match, and the items matched."""
    hit = np.zeros(len(words) + 1, np.int64)
    found: set[str] = set()
    if not words:
        return hit[:0] > 0, found
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts = None
    for machine in machines:
        for end, (n, ids) in machine.iter(line):
            if starts is None:
                starts = np.cumsum([0] + [len(w) + 1 for w in words])
            last = int(np.searchsorted(starts, end))  # words whose blank lies before the end
            hit[last - n] += 1
            hit[last] -= 1
            found.update(ids)
    return np.cumsum(hit[:-1]) > 0, found


def offsets(text: str, hit: np.ndarray) -> list[dict]:
    """Character spans of the original text that the hit words cover, runs joined."""
    spans: list[dict] = []
    before = False
    for m, h in zip(_WORD.finditer(text), hit, strict=True):
        if h and before:
            spans[-1]["end"] = m.end()
        elif h:
            spans.append({"start": m.start(), "end": m.end()})
        before = bool(h)
    return spans


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES
) -> DataFrame:
    """One row a document: words, hit words, items, spans. See the module's text."""
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(b) for b in blocks(items, window, most)]

    def run(batches):
        machines = []
        for b in sent:
            key = id(b.value)
            if key not in _automata:
                if len(_automata) > len(sent):
                    _automata.clear()
                _automata[key] = (b.value, automaton(b.value))  # keeps the value, so its id holds
            machines.append(_automata[key][1])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                words = plain_words(text)
                hit, found = scan(words, machines)
                n_hit, ids = int(hit.sum()), sorted(found)
                rows.append(
                    (
                        doc,
                        len(words),
                        n_hit,
                        len(ids),
                        hashlib.sha256(",".join(ids).encode()).hexdigest(),
                        n_hit > 0,
                        ids,
                        offsets(text, hit) if n_hit else [],
                    )
                )
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(_TYPE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def clean(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, spans_only: bool = False
) -> DataFrame:
    """The documents without those that hold a window of an item, with all their columns.

    With ``spans_only`` the hit spans are cut out of the texts instead, and only a text that was
    hit as a whole goes.
    """
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(b) for b in blocks(items, window)]
    names = docs.columns
    at = names.index("text")

    def run(batches):
        machines = [automaton(b.value) for b in sent]
        for batch in batches:
            texts, keep = [], []
            for text in batch.column(at):
                text = text.as_py()
                hit, _ = scan(plain_words(text), machines)
                keep.append(not hit.any() or (spans_only and not hit.all()))
                if spans_only and hit.any():
                    left, end = [], 0
                    for s in offsets(text, hit):
                        left.append(text[end : s["start"]])
                        end = s["end"]
                    text = "".join([*left, text[end:]])
                texts.append(text)
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    out = docs.mapInArrow(run, docs.schema)
    if spans_only and "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
