"""Image deltas over strips, against the pixels themselves."""

import math
import random

from pyspark.sql import functions as F

from siteaudit.operators import images as im

PAIR = (
    "case_id string, before_width int, before_height int, before_rgb binary, after_width int, after_height int, "
    "after_rgb binary, regions array<struct<id:string,kind:string,x:double,y:double,w:double,h:double>>, n string, top string"
)


def pair(rnd, name, w, h, regions):
    before = bytes(rnd.randrange(256) for _ in range(w * h * 3))
    after = bytes(v if rnd.random() < 0.6 else min(255, v + rnd.choice([3, 12, 90])) for v in before)
    return name, w, h, before, w, h, after, regions, "x", "y"


def clipped(r, w, h):
    edge = lambda v, most: min(max(v, 0), most)
    x0, y0 = edge(math.floor(r[2]), w), edge(math.floor(r[3]), h)
    return x0, y0, max(x0, edge(math.ceil(r[2] + r[4]), w)), max(y0, edge(math.ceil(r[3] + r[5]), h))


def by_hand(row):
    name, w, h, before, _, _, after, regions = row[:8]
    regions = regions or []
    cover = [clipped(r, w, h) for r in regions if r[1] == "ignored"]
    hidden = lambda x, y: any(a <= x < c and b <= y < d for a, b, c, d in cover)
    px = {}
    for y in range(h):
        for x in range(w):
            at = 3 * (y * w + x)
            d = [abs(before[at + c] - after[at + c]) for c in range(3)]
            px[x, y] = (min(255, sum(d)) > 30, hidden(x, y), d)
    live = [p for p, (c, i, _) in px.items() if c and not i]
    open_ = [v for _, i, d in px.values() if not i for v in d]
    box = ""
    if live:
        xs, ys = [x for x, _ in live], [y for _, y in live]
        box = f"{min(xs)},{min(ys)},{max(xs) + 1},{max(ys) + 1}"
    whole = (
        name, "ok", w * h, sum(c for c, _, _ in px.values()), sum(c and i for c, i, _ in px.values()), len(live), box,
        round(sum(open_) / len(open_), 6) if open_ else 0.0,
        round(math.sqrt(sum(v * v for v in open_) / len(open_)), 6) if open_ else 0.0,
        max((v for _, _, d in px.values() for v in d), default=0), before == after,
    )
    parts = []
    for r in regions:
        if r[1] == "semantic":
            x0, y0, x1, y1 = clipped(r, w, h)
            inside = [px[x, y] for x in range(x0, x1) for y in range(y0, y1) if not px[x, y][1]]
            hit = sum(c for c, _, _ in inside)
            parts.append((name, r[0], hit, len(inside), round(hit / len(inside), 8) if inside else 0.0))
    return whole, parts


def images(rnd):
    def regions():
        return [
            (f"r{i % 3}", rnd.choice(["ignored", "semantic", "semantic", "other"]), rnd.uniform(-4, 20), rnd.uniform(-4, 20),
             rnd.uniform(0, 12), rnd.uniform(0, 12))
            for i in range(rnd.randrange(6))
        ]

    rows = [pair(rnd, f"c{i}", rnd.choice([1, 7, 16]), rnd.choice([1, 5, 19]), regions()) for i in range(24)]
    rows += [rows[0], pair(rnd, "none", 7, 5, None), pair(rnd, "empty", 0, 0, [("r", "semantic", 0.0, 0.0, 1.0, 1.0)])]
    rows.append(pair(rnd, "hidden", 7, 5, [("all", "ignored", 0.0, 0.0, 9.0, 9.0), ("r", "semantic", 1.0, 1.0, 2.0, 2.0)]))
    rows.append(("equal", 2, 2, b"abcdefghijkl", 2, 2, b"abcdefghijkl", [], "x", "y"))
    return rows


BAD = [
    ("wide", 2, 1, b"abcdef", 1, 2, b"abcdef", [("r", "semantic", 0.0, 0.0, 1.0, 1.0)], "x", "y"),
    ("gone", 2, 1, b"abcdef", None, None, None, [], "x", "y"),
    ("short", 2, 1, b"abcdef", 2, 1, b"abc", None, "x", "y"),
]


def plain(df):
    return sorted(
        (r.case_id, r.status, r.total_pixels, r.raw_changed, r.ignored_changed, r.changed, r.bbox, round(r.mean_delta, 6),
         round(r.rms_delta, 6), r.max_delta, r.exact)
        for r in df.where("status = 'ok'").collect()
    )


def test_deltas_of_pairs_for_any_strip(spark):
    rows = images(random.Random(5))
    df = spark.createDataFrame(rows + BAD, PAIR)
    want = [by_hand(r) for r in rows]
    for strip in (1, 40, im.STRIP):
        whole, parts = im.image_deltas(im.strip_pairs(df, strip))
        assert plain(whole) == sorted(w for w, _ in want)
        assert sorted(map(tuple, parts.collect())) == sorted(p for _, ps in want for p in ps)
        bad = whole.where("status <> 'ok'").collect()
        assert sorted(r.case_id for r in bad) == ["gone", "short", "wide"]
        assert {(r.status, r.total_pixels, r.bbox, r.exact, r.band) for r in bad} == {("dimension_mismatch", *[None] * 4)}
    assert plain(im.pixel_delta(df)) == sorted(w for w, _ in want)
    assert im.pixel_delta(df.limit(0)).count() == im.region_delta(df.limit(0)).count() == 0


def test_images_that_arrive_as_strips(spark):
    rows = [r for r in images(random.Random(6)) if r[0] != "c0"]
    df = spark.createDataFrame(rows, PAIR)
    sides = [
        df.select("case_id", F.lit(s).alias("side"), *(F.col(f"{s}_{c}").alias(c) for c in ("width", "height", "rgb")))
        for s in ("before", "after")
    ]
    parts = im.strips(sides[0].unionByName(sides[1]), 40)
    assert parts.where("case_id = 'c1' AND octet_length(rgb) > 120").count() == 0
    whole, regions = im.image_deltas(im.joined_strips(parts, df.select("case_id", "regions")))
    want = [by_hand(r) for r in rows]
    assert plain(whole) == sorted(w for w, _ in want)
    assert sorted(map(tuple, regions.collect())) == sorted(p for _, ps in want for p in ps)
    # A case that lost a strip on one side or on both is not judged.
    tall = next(r[0] for r in rows if r[2] == 19 and r[1] == 16)
    for lost in (f"case_id = '{tall}' AND top > 10 AND side = 'after'", f"case_id = '{tall}' AND top > 10"):
        cut, inside = im.image_deltas(im.joined_strips(parts.where(f"NOT ({lost})"), df.select("case_id", "regions")))
        assert [r.case_id for r in cut.where("status <> 'ok'").collect()] == [tall]
        assert inside.where(F.col("case_id") == tall).count() == 0
