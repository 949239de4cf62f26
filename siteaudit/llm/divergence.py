"""Quality rules by distribution divergence.

Each text gives a histogram of character classes and one of its language's common words. The
languages' references are the median class shares and the mean word shares of all their
documents that pass the base rules. A text fails where its Jensen-Shannon distance (base 2, so 0 to
1) to the reference is too large. Short texts have ragged histograms, so each test has a least
length below which it passes everything.

``COMMON`` lists the common words of four languages. For any other language that ``LEAST_DOCS``
documents or more are marked with, they are learned from the table: its ``LISTED`` most frequent
words, of those that make up one word in ``LEAST_SHARE`` or more. A text without a language, or of
one that has fewer documents or none that pass the base rules, gets no verdict beyond the base
rules and is kept: its distances are null.

Edges: null and empty texts have no words and fail the base rule for short texts; repeated
rows are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.words import WordIds, plain_words, space_words, windows
from siteaudit.plans.session import cut

MIN_WORDS = 50
REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# Least lengths (characters, words) and largest distances of the two tests.
CLASS_CHARS, CLASS_DISTANCE = 200, 0.18
WORD_WORDS, WORD_DISTANCE = 80, 0.50

COMMON = {
    "en": "the of and to a in is that for it was on are as with at by from or an be this not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est dans qui par pour au sur pas plus ne se ce il".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más es".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
PLACE = {w.encode(): i for i, w in enumerate(WORDS)}

LEAST_DOCS = 20
LEAST_SHARE = 500
LISTED = 30

# Character classes by byte: lower case and digits, upper case, space, ordinary punctuation, other
# signs, first byte of a non-ASCII character. Later bytes of a character are not counted (6).
CLASSES = 6
_CLASS = np.full(256, 4, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("0") : ord("9") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
for _c in SPACES:
    _CLASS[ord(_c)] = 2
for _c in ".,;:?'\"()-+@/_=":
    _CLASS[ord(_c)] = 3
_CLASS[0x80:0xC0] = 6
_CLASS[0xC0:] = 5


def base(text: str | None, ids: WordIds) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = space_words(text, lower=False)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = text.split("\n")
    copies = Counter(lines) if len(set(lines)) < len(lines) else {}
    twice = sum(n - 1 for line, n in copies.items() if n > 1 and line.strip(SPACES))
    repeated = 0
    if len(words) >= 3:
        h = windows(ids.of(words), 3)
        sorted_h = np.sort(h)
        copied = sorted_h[1:][sorted_h[1:] == sorted_h[:-1]]
        if len(copied):  # few texts have any
            again = np.isin(h, copied)
            hit = np.zeros(len(words), bool)
            for k in range(3):
                hit[k : k + len(again)] |= again
            repeated = int(hit.sum())
    return len(words), chars, sum(map(text.count, SYMBOLS)), twice, repeated


def histograms(text: str | None, listed: Iterable[bytes] = PLACE) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the character classes, and of the listed words with all others last."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
    found = Counter(plain_words(text))
    words = np.array([found.get(w, 0) for w in listed] + [0])
    words[-1] = found.total() - words.sum()
    return classes, words


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of rows of shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


MEASURED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, lang string, classes array<double>, words array<double>, "
    "n_chars long, n_plain long"
)


def learned(docs: DataFrame) -> dict[str, list[bytes]]:
    """Common words, by language, of the languages of the table outside ``COMMON``.

    Words are counted in each batch before they are shuffled. At most ``LEAST_SHARE`` words of a
    language reach the driver, and only a table with such a language is read for them.
    """
    other = docs.select("text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & ~F.col("lang").isin(*COMMON)
    )
    known = other.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    names = [r["lang"] for r in known.select("lang").collect()]
    if not names:
        return {}

    def run(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(plain_words(text.as_py()))
            rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
            langs, words, counts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())],
                ["lang", "word", "n"],
            )

    counts = cut(
        other.where(F.col("lang").isin(*names))
        .mapInArrow(run, "lang string, word binary, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(total, "lang").where(F.col("n") * LEAST_SHARE >= F.col("total")).select("lang", "word", "n")
    out: dict[str, list[bytes]] = {name: [] for name in names}
    for r in sorted(frequent.collect(), key=lambda r: (-r["n"], bytes(r["word"]))):
        if len(out[r["lang"]]) < LISTED:
            out[r["lang"]].append(bytes(r["word"]))
    return out


def measure(docs: DataFrame, more: dict[str, list[bytes]] | None = None) -> DataFrame:
    """Base counts and histograms, as shares, of every document; ``more`` from ``learned``.

    A language of neither list is null in the result.
    """
    more = more or {}

    def run(batches):
        ids = WordIds()
        for batch in batches:
            rows = []
            for doc, text, lang in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True
            ):
                text = text.as_py()
                counts = base(text, ids)
                classes, words = histograms(text, more.get(lang, PLACE))
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEATED_PERCENT * counts[0]
                rows.append(
                    (
                        doc,
                        *counts,
                        failed,
                        lang if lang in COMMON or lang in more else None,
                        classes / max(1, classes.sum()),
                        words / max(1, words.sum()),
                        int(classes.sum()),
                        int(words.sum()),
                    )
                )
            cols = list(zip(*rows, strict=True)) or [[]] * 12
            shares = pa.list_(pa.float64())
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.string(), shares, shares, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)],
                [f.split()[0] for f in MEASURED.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).mapInArrow(run, MEASURED)


def references(measured: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Shares by language, medians of the classes and means of the words: a row for each
    language that ``measure`` names. A median is not moved by the junk among the documents."""
    mean = [F.percentile_approx(F.col("classes")[i], 0.5, 1000).alias(f"classes{i}") for i in range(CLASSES)]
    mean += [F.avg(F.get("words", F.lit(i))).alias(f"words{i}") for i in range(len(WORDS) + 1)]
    rows = measured.where("NOT base_failed AND lang IS NOT NULL").groupBy("lang").agg(*mean).collect()
    return {
        r["lang"]: (
            np.array(c := [r[f"classes{i}"] for i in range(CLASSES)]) / max(sum(c), 1e-9),
            np.array([v for i in range(len(WORDS) + 1) if (v := r[f"words{i}"]) is not None]),
        )
        for r in rows
    }


VERDICT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


def verdicts(docs: DataFrame) -> DataFrame:
    """Base counts, the two distances (null without a reference) and the verdict."""
    measured = cut(measure(docs, learned(docs)))
    refs = references(measured)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            classes = np.array(batch.column(8).to_pylist(), float).reshape(n, -1)
            words = batch.column(9)
            lang = np.array(batch.column(7).to_pylist(), object)
            dc, dw = np.full(n, np.inf), np.full(n, np.inf)
            for name, (ref_c, ref_w) in refs.items():
                mine = np.flatnonzero(lang == name)
                if len(mine):
                    dc[mine] = distance(classes[mine], ref_c)
                    dw[mine] = distance(np.array(words.take(pa.array(mine)).to_pylist(), float), ref_w)
            far = (dc > CLASS_DISTANCE) & np.isfinite(dc) & (batch.column(10).to_numpy() >= CLASS_CHARS)
            far |= (dw > WORD_DISTANCE) & np.isfinite(dw) & (batch.column(11).to_numpy() >= WORD_WORDS)
            failed = np.array(batch.column(6).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(7)],
                    pa.array(dc, pa.float64(), mask=~np.isfinite(dc)),
                    pa.array(dw, pa.float64(), mask=~np.isfinite(dw)),
                    pa.array(~failed & ~far),
                ],
                [f.split()[0] for f in VERDICT.split(", ")],
            )

    return measured.mapInArrow(run, VERDICT)
