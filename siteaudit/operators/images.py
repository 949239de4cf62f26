"""Image-pair deltas over strips of pixel rows.

A pair is cut into strips by DataFrame functions (or arrives as strips, where an image is larger than
a record). Each strip is decoded once: numpy masks it, and summed-area tables give the counts of
every region from four corners. Spark adds up the strips, for images and for regions.

Edges: sides of different or missing size, bytes that do not fill the size and missing strips make a
``dimension_mismatch`` with null figures and no regions; an empty image is exact with no pixels; a
null list of regions is empty; repeated cases of ``strip_pairs`` stay rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.text import coverage_band
from siteaudit.plans.session import cut

# Pixels of a strip, and of the strips that are unpacked together.
STRIP = 1 << 20
TOGETHER = 1 << 22

BOXES = "array<struct<pos:int,id:string,ignored:boolean,x0:int,y0:int,x1:int,y1:int>>"
MEASURED = (
    "case_id string, pair bigint, width int, height int, same boolean, n bigint, raw bigint, changed bigint, open bigint, "
    "x0 int, y0 int, x1 int, y1 int, s1 bigint, s2 bigint, most int, "
    "regions array<struct<pos:int,id:string,changed:bigint,total:bigint>>"
)


def image_pairs(images: DataFrame) -> DataFrame:
    """Rows (case_id, side, width, height, rgb) to one row per case."""
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    cols = ["width", "height", "rgb"]
    return images.groupBy("case_id").agg(
        *[side(s, c).alias(f"{s}_{c}") for s in ("before", "after") for c in cols]
    )


def _cut_at(width: Column, height: Column, strip: int) -> Column:
    """First rows of an image's strips; an image without pixels has one."""
    rows = F.greatest(F.lit(1), F.floor(F.lit(strip) / F.greatest(width, F.lit(1))).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0)), rows),
        lambda top: F.struct(top.alias("top"), F.least(rows, height - top).alias("rows")),
    )


def _part(rgb: Column, width: Column, at: Column) -> Column:
    return F.substring(rgb, at["top"] * width * 3 + 1, at["rows"] * width * 3)


def strips(images: DataFrame, strip: int = STRIP) -> DataFrame:
    """images(case_id, side, width, height, rgb) to rows (case_id, side, width, height, top, rgb)."""
    w, h = F.col("width"), F.col("height")
    parts = F.transform(
        _cut_at(w, h, strip), lambda at: F.struct(at["top"].alias("top"), _part(F.col("rgb"), w, at).alias("rgb"))
    )
    sized = images.select("case_id", "side", w.cast("int").alias("width"), h.cast("int").alias("height"), "rgb")
    return sized.select("case_id", "side", "width", "height", F.inline(parts))


def _boxes(regions: Column, width: Column, height: Column) -> Column:
    """Regions in whole pixels, clipped to the image."""
    edge = lambda v, most: F.least(F.greatest(v, F.lit(0)), most).cast("int")

    def box(r, pos):
        x0, y0 = edge(F.floor(r["x"]), width), edge(F.floor(r["y"]), height)
        return F.struct(
            pos.alias("pos"), r["id"].alias("id"), (r["kind"] == "ignored").alias("ignored"), x0.alias("x0"), y0.alias("y0"),
            F.greatest(x0, edge(F.ceil(r["x"] + r["w"]), width)).alias("x1"),
            F.greatest(y0, edge(F.ceil(r["y"] + r["h"]), height)).alias("y1"),
        )

    known = F.filter(F.transform(regions, lambda r, i: F.struct(r.alias("r"), i.alias("i"))),
                     lambda x: x["r"]["kind"].isin("ignored", "semantic"))
    return F.coalesce(F.transform(known, lambda x: box(x["r"], x["i"])), F.array().cast(BOXES))


def _met(rows: DataFrame) -> DataFrame:
    """Boxes relative to the strip that they meet; the first strip keeps all, so each is listed."""
    top, rows_ = F.col("top"), F.col("rows")
    y = lambda v: F.least(F.greatest(v - top, F.lit(0)), rows_)
    near = F.filter("boxes", lambda b: (top == 0) | ((b["y0"] < top + rows_) & (b["y1"] > top)))
    return rows.withColumn(
        "boxes", F.transform(near, lambda b: b.withField("y0", y(b["y0"])).withField("y1", y(b["y1"])))
    ).select("case_id", "pair", "width", "height", "same", "top", "rows", "before", "after", "boxes")


def strip_pairs(pairs: DataFrame, strip: int = STRIP) -> DataFrame:
    """Strips of whole pairs, without a shuffle: one row a case with both sides and ``regions``."""
    w, h = F.col("before_width").cast("int"), F.col("before_height").cast("int")
    size = w.cast("bigint") * h * 3
    same = F.coalesce(
        (w == F.col("after_width")) & (h == F.col("after_height"))
        & (F.octet_length("before_rgb") == size) & (F.octet_length("after_rgb") == size),
        F.lit(False),
    )
    part = lambda c, at: F.when(same, _part(F.col(c), w, at))
    whole = F.array(F.struct(F.lit(0).alias("top"), F.lit(0).alias("rows")))
    parts = F.transform(
        F.when(same, _cut_at(w, h, strip)).otherwise(whole),
        lambda at: F.struct(
            at["top"].alias("top"), at["rows"].alias("rows"),
            part("before_rgb", at).alias("before"), part("after_rgb", at).alias("after"),
        ),
    )
    rows = pairs.select(
        F.col("case_id").cast("string").alias("case_id"), F.monotonically_increasing_id().alias("pair"), w.alias("width"),
        h.alias("height"), same.alias("same"), _boxes(F.col("regions"), w, h).alias("boxes"), parts.alias("parts"),
    )
    # The pair is numbered before its strips are rows of their own.
    return _met(rows.select("case_id", "pair", "width", "height", "same", "boxes", F.inline("parts")))


def joined_strips(parts: DataFrame, regions: DataFrame) -> DataFrame:
    """Strips of images larger than a record, met by case and place: ``strips`` rows of both sides and
    regions(case_id, regions). Both sides are cut alike; a strip without its fellow is a
    mismatch, and so is every strip without a case."""
    side = lambda s: parts.where(F.col("side") == s).select(
        "case_id", "top", F.struct(*(F.col(c).cast("int").alias(c) for c in ("width", "height"))).alias(f"{s}_size"),
        F.col("rgb").alias(s),
    )
    j = side("before").join(side("after"), ["case_id", "top"], "full_outer").join(regions, "case_id", "left")
    w, h = F.col("before_size.width"), F.col("before_size.height")
    line = F.greatest(w, F.lit(1)) * 3
    n = F.octet_length("before")
    same = F.coalesce(
        (F.col("before_size") == F.col("after_size")) & (n == F.octet_length("after")) & (n % line == 0)
        & (F.col("top") + n / line <= h),
        F.lit(False),
    )
    rows = j.select(
        F.col("case_id").cast("string").alias("case_id"), F.lit(0).cast("bigint").alias("pair"), w.alias("width"),
        h.alias("height"), same.alias("same"), F.col("top").cast("int").alias("top"),
        F.when(same, n / line).otherwise(0).cast("int").alias("rows"),
        F.when(same, F.col("before")).alias("before"), F.when(same, F.col("after")).alias("after"),
        _boxes(F.col("regions"), w, h).alias("boxes"),
    )
    return _met(rows)


def _corners(table: np.ndarray, k, x0, y0, x1, y1) -> np.ndarray:
    return table[k, y1, x1] - table[k, y0, x1] - table[k, y1, x0] + table[k, y0, x0]


def _summed(marks: np.ndarray) -> np.ndarray:
    """Summed-area tables of (image, row, column) marks, with a first row and column of zeros."""
    out = np.zeros((marks.shape[0], marks.shape[1] + 1, marks.shape[2] + 1), np.int64)
    np.cumsum(marks, axis=1, out=out[:, 1:, 1:])
    np.cumsum(out[:, 1:, 1:], axis=2, out=out[:, 1:, 1:])
    return out


def _measure(before: bytes, after: bytes, shape, box: dict[str, np.ndarray], threshold: int):
    """Figures of equally large strips, and counts of their boxes (``k`` is the strip)."""
    count, rows, width = shape
    a = np.frombuffer(before, np.uint8).reshape(count, rows, width, 3).astype(np.int16)
    diff = np.abs(a - np.frombuffer(after, np.uint8).reshape(count, rows, width, 3))
    raw = np.minimum(diff.sum(axis=3), 255) > threshold
    # Ignored boxes as corner marks, summed over the rows and columns they reach.
    marks = np.zeros((count, rows + 1, width + 1), np.int32)
    hide = box["ignored"] & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"])
    k, x0, y0, x1, y1 = (box[c][hide] for c in ("k", "x0", "y0", "x1", "y1"))
    for y, x, v in ((y0, x0, 1), (y0, x1, -1), (y1, x0, -1), (y1, x1, 1)):
        np.add.at(marks, (k, y, x), v)
    shown = marks.cumsum(axis=1).cumsum(axis=2)[:, :rows, :width] == 0
    live = raw & shown
    at = [box[c] for c in ("k", "x0", "y0", "x1", "y1")]
    of_box = _corners(_summed(live), *at), _corners(_summed(shown), *at)
    d = diff.astype(np.int64) * shown[..., None]
    cols, lines = live.any(axis=1), live.any(axis=2)
    first = lambda m: np.where(m.any(axis=1), m.argmax(axis=1), -1) if m.shape[1] else np.full(count, -1)
    last = lambda m: np.where(m.any(axis=1), m.shape[1] - m[:, ::-1].argmax(axis=1), -1) if m.shape[1] else np.full(count, -1)
    flat = diff.reshape(count, -1)
    figures = {
        "n": np.full(count, rows * width), "raw": raw.sum(axis=(1, 2)), "changed": live.sum(axis=(1, 2)),
        "open": shown.sum(axis=(1, 2)), "x0": first(cols), "y0": first(lines), "x1": last(cols), "y1": last(lines),
        "s1": d.sum(axis=(1, 2, 3)), "s2": (d * d).sum(axis=(1, 2, 3)),
        "most": flat.max(axis=1) if flat.shape[1] else np.zeros(count, np.int64),
    }
    return figures, of_box


FIGURES = ["n", "raw", "changed", "open", "x0", "y0", "x1", "y1", "s1", "s2", "most"]


def measured(rows: DataFrame, threshold: int = 30) -> DataFrame:
    """Figures of every strip and of the boxes within it; bounds are places in the image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            size = batch.num_rows
            same = np.array(col["same"].to_pylist(), bool)
            tops, high = col["top"].to_numpy(), col["rows"].to_numpy()
            wide = col["width"].fill_null(0).to_numpy()
            lists = col["boxes"]
            flat = lists.flatten()
            owner = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy()))
            box = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")}
            box["ignored"] = np.array(flat.field("ignored").to_pylist(), bool)
            got = {c: np.zeros(size, np.int64) for c in FIGURES}
            hit, total = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
            order = np.lexsort((high, wide))
            order = order[same[order]]
            start = 0
            while start < len(order):
                w, h = int(wide[order[start]]), int(high[order[start]])
                end = start + 1
                most = start + max(1, TOGETHER // max(1, w * h))
                while end < min(most, len(order)) and wide[order[end]] == w and high[order[end]] == h:
                    end += 1
                pick = order[start:end]
                place = np.full(size, -1)
                place[pick] = np.arange(len(pick))
                mine = np.flatnonzero(place[owner] >= 0)
                part = {c: v[mine] for c, v in box.items()} | {"k": place[owner[mine]]}
                sides = (b"".join(col[c][int(i)].as_py() for i in pick) for c in ("before", "after"))
                figures, of_box = _measure(*sides, (len(pick), h, w), part, threshold)
                for c, v in figures.items():
                    got[c][pick] = v
                hit[mine], total[mine] = of_box
                start = end
            seen = got["x0"] >= 0
            for c in ("y0", "y1"):
                got[c] += tops
            keep = ~box["ignored"] & same[owner]
            regions = pa.StructArray.from_arrays(
                [flat.field(c).filter(pa.array(keep)) for c in ("pos", "id")] + [pa.array(hit[keep]), pa.array(total[keep])],
                ["pos", "id", "changed", "total"],
            )
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=size))]).astype(np.int32)
            bounds = ("x0", "y0", "x1", "y1")
            yield pa.RecordBatch.from_arrays(
                [col[c] for c in ("case_id", "pair", "width", "height", "same")]
                + [
                    pa.array(got[c], pa.int32() if c in (*bounds, "most") else pa.int64(),
                             mask=~(seen & same) if c in bounds else None)
                    for c in FIGURES
                ]
                + [pa.ListArray.from_arrays(pa.array(ends), regions)],
                [f.split()[0] for f in MEASURED.split(", ")],
            )

    return rows.mapInArrow(run, MEASURED)


def _whole() -> Column:
    """Every strip has its fellow, and together they fill the image."""
    size = F.max("width").cast("bigint") * F.max("height")
    return F.every("same") & (F.sum("n") == size)


def image_figures(found: DataFrame) -> DataFrame:
    """Changed-pixel counts, bounds and channel statistics per image pair, from ``measured``."""
    g = found.groupBy("case_id", "pair").agg(
        F.coalesce(_whole(), F.lit(False)).alias("ok"),
        *[F.sum(c).alias(c) for c in ("n", "raw", "changed", "open", "s1", "s2")],
        *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1", "most")],
    )
    ok = lambda c, kind="bigint": F.when(F.col("ok"), c).cast(kind)
    mean = lambda c: F.when(F.col("open") > 0, F.col(c) / (F.col("open") * 3)).otherwise(0.0)
    d = g.select(
        "case_id",
        F.when(F.col("ok"), "ok").otherwise("dimension_mismatch").alias("status"),
        ok(F.col("n")).alias("total_pixels"),
        ok(F.col("raw")).alias("raw_changed"),
        ok(F.col("raw") - F.col("changed")).alias("ignored_changed"),
        ok(F.col("changed")).alias("changed"),
        ok(F.concat_ws(",", "x0", "y0", "x1", "y1"), "string").alias("bbox"),
        ok(mean("s1"), "double").alias("mean_delta"),
        ok(F.sqrt(mean("s2")), "double").alias("rms_delta"),
        ok(F.col("most"), "int").alias("max_delta"),
        ok(F.col("most") == 0, "boolean").alias("exact"),
    )
    share = F.when(F.col("total_pixels") > 0, 100 * F.col("changed") / F.col("total_pixels")).when(
        F.col("total_pixels") == 0, 0.0
    )
    return d.withColumn("band", F.when(share.isNotNull(), coverage_band(share)))


def region_figures(found: DataFrame) -> DataFrame:
    """Changed share of each semantic region outside ignored ones, from ``measured``."""
    whole = found.groupBy("case_id", "pair").agg(_whole().alias("ok")).where("ok")
    inside = found.select("case_id", "pair", F.inline("regions")).groupBy("case_id", "pair", "pos").agg(
        F.first("id").alias("region_id"), F.sum("changed").alias("changed"), F.sum("total").alias("total")
    )
    share = F.when(F.col("total") > 0, F.round(F.col("changed") / F.col("total"), 8)).otherwise(0.0)
    same = [inside["case_id"].eqNullSafe(whole["case_id"]), inside["pair"] == whole["pair"]]
    return inside.join(whole, same, "left_semi").select(
        "case_id", "region_id", "changed", "total", share.alias("changed_ratio")
    )


def image_deltas(rows: DataFrame, threshold: int = 30) -> tuple[DataFrame, DataFrame]:
    """(figures of images, figures of regions) of strips, decoded once."""
    found = cut(measured(rows, threshold))
    return image_figures(found), region_figures(found)


def pixel_delta(pairs: DataFrame, threshold: int = 30, strip: int = STRIP) -> DataFrame:
    """Figures of whole pairs (``strip_pairs``)."""
    return image_figures(measured(strip_pairs(pairs, strip), threshold))


def region_delta(pairs: DataFrame, threshold: int = 30, strip: int = STRIP) -> DataFrame:
    """Figures of the semantic regions of whole pairs; the strips are written once and read twice."""
    return region_figures(cut(measured(strip_pairs(pairs, strip), threshold)))


def manifest_status(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """complete / stale / blocked / missing per case, with the reasons."""
    e = expected.select("case_id", F.col("before_hash").alias("eb"), F.col("after_hash").alias("ea"))
    j = e.join(stored, "case_id", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("before_hash").isNull(), "no-before"),
            F.when(F.col("after_hash").isNull(), "no-after"),
            F.when(F.col("before_hash") != F.col("eb"), "before-changed"),
            F.when(F.col("after_hash") != F.col("ea"), "after-changed"),
            F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.concat(F.lit("error:"), "error")),
        )
    )
    missing = F.col("before_hash").isNull() & F.col("after_hash").isNull()
    status = (
        F.when(missing, "missing")
        .when(F.coalesce(F.col("error"), F.lit("")) != "", "blocked")
        .when(F.size(reasons) > 0, "stale")
        .otherwise("complete")
    )
    return j.select("case_id", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))
