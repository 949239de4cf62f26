import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siteaudit.llm import packing
from siteaudit.llm.queries import vocabulary

ODD = [
    "",
    None,
    "a",
    "It's don't x's 12 3.5 --- end... <|endoftext|> word,word",
    "tab\tand\r\nline   nbsp \x1c sep \x0b vt   ls",
    "İstanbul ΟΔΥΣΣΕΥΣ Straße ÉCOLE école ́x",
    "x***́ reed***, !!a!! ''s 's 't'll",
    "日本語 テキスト ñandú Ünïcode ǅ ﬁ",
    "w" * 5000 + " " + "the " * 9000,
]


def plain_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_codes_equal_the_tokenizer():
    table = packing.WordCodes(vocabulary(), 1000)
    for _ in range(2):
        got = table.encode(ODD)
        for b, ids in zip(got, plain_ids(ODD), strict=True):
            assert np.frombuffer(b, "<u4").tolist() == ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_word_codes_on_any_text(texts):
    got = packing.codes(vocabulary()).encode(texts)
    for b, ids in zip(got, plain_ids(texts), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == ids


def test_fill_reaches_the_least_slack():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        bins = packing.fill(lengths, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        left = set(range(len(lengths)))
        for b in bins:
            assert sum(lengths[i] for i in b) <= 20
            top = max(lengths[i] for i in left)
            rest = [lengths[i] for i in left]
            rest.remove(top)
            sums = {0}
            for n in rest:
                sums |= {s + n for s in sums if s + n <= 20 - top}
            assert sum(lengths[i] for i in b) == top + max(sums)
            left -= set(b)


def test_pack_round_trip(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(1, ODD[3], None, 0), (1, ODD[3], None, 0), (None, "b c", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, start long")
    got = packing.pack(docs, vocabulary(), block=3).collect()
    ids = defaultdict(list)
    for r, x in zip(rows, plain_ids([r[1] for r in rows]), strict=True):
        ids[r[0]].append(x + [2])
    seen = defaultdict(list)
    for r in got:
        assert any(
            len(x) == r["doc_tokens"]
            and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            for x in ids[r["doc_id"]]
        )
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    for parts in seen.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 4096


def test_pack_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, vocabulary()).count() == 0
