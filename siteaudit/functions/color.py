"""CSS colours as linear-sRGB RGBA structs, in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGBA = "struct<r:double,g:double,b:double,a:double>"
WHITE = (1.0, 1.0, 1.0, 1.0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps nested formulas linear in size."""
    return F.get(F.transform(F.array(value), body), 0)


def clamp(v: Column) -> Column:
    return let(
        F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)),
        lambda x: F.when(x < 1e-7, 0.0).when(x > 1 - 1e-7, 1.0).otherwise(x),
    )


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def rgba_lit(values) -> Column:
    return rgba(*[F.lit(float(v)) for v in values])


def linear(v: Column) -> Column:
    return let(
        clamp(v),
        lambda x: F.when(x <= 0.04045, x / 12.92).otherwise(
            F.pow((x + 0.055) / 1.055, F.lit(2.4))
        ),
    )


def _num(t: Column) -> Column:
    return t.try_cast("double")


def _ratio(t: Column, scale: float = 1.0) -> Column:
    """A number as is, or a percentage of ``scale``."""
    pct = F.endswith(t, F.lit("%"))
    return F.when(pct, _num(F.regexp_replace(t, "%$", "")) / 100 * scale).otherwise(_num(t))


def _degrees(t: Column) -> Column:
    n = _num(F.regexp_replace(t, r"(?:turn|grad|rad|deg)$", ""))
    return (
        F.when(F.endswith(t, F.lit("turn")), n * 360)
        .when(F.endswith(t, F.lit("grad")), n * 0.9)
        .when(F.endswith(t, F.lit("rad")), F.degrees(n))
        .otherwise(n)
    )


def _oklab(lightness: Column, a: Column, b: Column, alpha: Column) -> Column:
    # OKLab to linear sRGB matrices.
    cone = [
        (0.3963377774, 0.2158037573),
        (-0.1055613458, -0.0638541728),
        (-0.0894841775, -1.2914855480),
    ]
    rows = [
        (4.0767416621, -3.3077115913, 0.2309699292),
        (-1.2684380046, 2.6097574011, -0.3413193965),
        (-0.0041960863, -0.7034186147, 1.707614701),
    ]
    lms = F.array(
        *[F.pow(lightness + ka * a + kb * b, F.lit(3.0)) for ka, kb in cone]
    )

    def mix(c: Column) -> Column:
        return rgba(*[clamp(x * c[0] + y * c[1] + z * c[2]) for x, y, z in rows], alpha)

    return let(lms, mix)


def _hue_channel(h: Column, s: Column, light: Column, n: int) -> Column:
    """Channel n (0, 8, 4) of HSL, h in degrees."""
    k = F.pmod(F.lit(float(n)) + h / 30, F.lit(12.0))
    amp = s * F.least(light, 1 - light)
    return light - amp * F.greatest(F.least(k - 3, 9 - k, F.lit(1.0)), F.lit(-1.0))


def normalize_color(text: Column) -> Column:
    """Computed colour text to linear RGBA; NULL when it cannot be resolved."""
    return let(F.lower(F.trim(text)), _normalize)


def normalize_colors(texts: Column) -> Column:
    """Array form: one expression for any number of colours."""
    return F.transform(F.transform(texts, lambda t: F.lower(F.trim(t))), _normalize)


# What browsers return for most colours; channel values come from a table of 256.
PLAIN = r"^rgba?\(\s*\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3}\s*(?:,\s*(?:0|1|0?\.\d+)\s*)?\)$"


def _srgb_table() -> Column:
    values = [i / 255 for i in range(256)]
    lin = [v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in values]
    return F.expr("array(" + ",".join(f"{v!r}D" for v in lin) + ")")


def _plain(t: Column) -> Column:
    byte = lambda x: F.get(_srgb_table(), F.least(x.cast("int"), F.lit(255)))
    return let(
        F.regexp_extract_all(t, F.lit(r"[0-9.]+"), F.lit(0)),
        lambda p: rgba(
            *[byte(F.get(p, i)) for i in range(3)],
            F.when(F.size(p) == 4, clamp(F.get(p, 3).cast("double"))).otherwise(1.0),
        ),
    )


def _normalize(t: Column) -> Column:
    call = F.regexp_extract(t, r"^(rgba?|hsla?|oklab|oklch|color)\(.*\)$", 1)
    return (
        F.when(t.rlike(PLAIN), _plain(t))
        .when(t == "transparent", rgba_lit((0, 0, 0, 0)))
        .when(F.startswith(t, F.lit("#")), let(F.regexp_extract(t, r"^#([0-9a-f]{3,8})$", 1), _hex))
        .when(call != "", let(_arguments(t, call), _function))
    )


def _hex(digits: Column) -> Column:
    def bytes_of(wide: Column) -> Column:
        byte = lambda i: F.conv(F.substring(wide, 2 * i + 1, 2), 16, 10).cast("double") / 255
        alpha = F.when(F.length(wide) == 8, byte(3)).otherwise(1.0)
        return F.when(
            F.length(wide).isin(6, 8), rgba(*[linear(byte(i)) for i in range(3)], alpha)
        )

    doubled = F.regexp_replace(digits, "(.)", "$1$1")
    return let(F.when(F.length(digits).isin(3, 4), doubled).otherwise(digits), bytes_of)


def _arguments(t: Column, call: Column) -> Column:
    """struct(kind, space, p array, alpha text or NULL, n) of a colour function."""
    body = F.replace(F.regexp_extract(t, r"^[a-z]+\((.*)\)$", 1), F.lit(","), F.lit(" "))

    def parts(x: Column) -> Column:
        space = F.regexp_extract(x, r"^\s*(srgb-linear|srgb)\s", 1)
        bare = F.regexp_replace(x, r"^\s*(?:srgb-linear|srgb)\s+", "")
        slash = x.contains("/")
        words = F.split(F.trim(F.substring_index(bare, "/", 1)), r"\s+")
        return let(
            words,
            lambda w: F.struct(
                call.alias("kind"),
                space.alias("space"),
                w.alias("p"),
                F.when(slash, F.trim(F.regexp_replace(x, r"^[^/]*/", "")))
                .when(F.size(w) == 4, F.get(w, 3))
                .alias("alpha"),
                F.when(~slash & (F.size(w) == 4), 3).otherwise(F.size(w)).alias("n"),
            ),
        )

    return let(body, parts)


def _function(f: Column) -> Column:
    p = [F.get(f["p"], i) for i in range(3)]
    kind, space = f["kind"], f["space"]
    alpha = F.when(f["alpha"].isNull(), F.lit(1.0)).otherwise(clamp(_ratio(f["alpha"])))
    byte = lambda x: F.when(F.endswith(x, F.lit("%")), _ratio(x)).otherwise(_num(x) / 255)
    hue = F.pmod(_degrees(p[0]), F.lit(360.0))
    hsl = let(
        F.array(hue, _ratio(p[1]), _ratio(p[2])),
        lambda h: rgba(*[linear(_hue_channel(h[0], h[1], h[2], n)) for n in (0, 8, 4)], alpha),
    )
    lab = _oklab(_ratio(p[0]), _ratio(p[1], 0.4), _ratio(p[2], 0.4), alpha)
    lch = let(
        F.array(_ratio(p[0]), _ratio(p[1], 0.4), F.radians(_degrees(p[2]))),
        lambda c: _oklab(c[0], c[1] * F.cos(c[2]), c[1] * F.sin(c[2]), alpha),
    )
    enc = lambda x: F.when(space == "srgb", linear(_ratio(x))).otherwise(clamp(_ratio(x)))
    out = F.when(
        f["n"] == 3,
        F.when(kind.isin("rgb", "rgba"), rgba(*[linear(byte(x)) for x in p], alpha))
        .when(kind.isin("hsl", "hsla"), hsl)
        .when(kind == "oklab", lab)
        .when(kind == "oklch", lch)
        .when(space != "", rgba(*[enc(x) for x in p], alpha)),
    )
    return let(
        out,
        lambda c: F.when(
            c["r"].isNotNull() & c["g"].isNotNull() & c["b"].isNotNull() & c["a"].isNotNull(), c
        ),
    )


def over(top: Column, under: Column) -> Column:
    """Source-over compositing."""

    def mix(v: Column) -> Column:
        ta, ua, a = v["ta"], v["ua"], v["ta"] + v["ua"] * (1 - v["ta"])
        ch = lambda k: clamp((v["t"][k] * ta + v["u"][k] * ua * (1 - ta)) / a)
        return F.when(a <= 0, rgba_lit((0, 0, 0, 0))).otherwise(rgba(ch("r"), ch("g"), ch("b"), a))

    return let(
        F.struct(
            top.alias("t"), under.alias("u"), clamp(top["a"]).alias("ta"), clamp(under["a"]).alias("ua")
        ),
        mix,
    )


def flatten_layers(layers: Column) -> Column:
    """Front-to-back array of RGBA, composited from the back."""
    return F.aggregate(
        F.reverse(layers), rgba_lit((0, 0, 0, 0)), lambda acc, layer: over(layer, acc)
    )


def luminance(c: Column) -> Column:
    return c["r"] * 0.2126 + c["g"] * 0.7152 + c["b"] * 0.0722


def contrast_ratio(a: Column, b: Column) -> Column:
    return let(
        F.array(let(a, luminance), let(b, luminance)),
        lambda v: (F.array_max(v) + 0.05) / (F.array_min(v) + 0.05),
    )


def is_large(size: Column, weight: Column) -> Column:
    return (size >= 24) | ((weight >= 700) & (size >= 14 * 96 / 72))
