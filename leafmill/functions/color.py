"""Colours: hex, CIE Lab and the CIEDE2000 distance, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_hex(parts: Column) -> Column:
    """Grey, RGB or CMYK parts from 0 to 1 as #rrggbb."""
    part = lambda v: F.lpad(F.lower(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int"))), 2, "0")
    get = lambda i: F.get(parts, F.lit(i))
    cmyk = [(1 - get(i)) * (1 - get(3)) for i in range(3)]
    joined = lambda *v: F.concat(F.lit("#"), *[part(x) for x in v])
    return F.when(F.size(parts) == 1, joined(get(0), get(0), get(0))).when(F.size(parts) == 3, joined(get(0), get(1), get(2))).when(F.size(parts) == 4, joined(*cmyk))


def to_lab(color: Column) -> Column:
    """Lab of a #rrggbb colour (sRGB, D65)."""
    channel = lambda at: F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
    linear = lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    r, g, b = (linear(channel(k)) for k in (2, 4, 6))
    bend = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    x = bend((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047)
    y = bend(0.2126729 * r + 0.7151522 * g + 0.0721750 * b)
    z = bend((0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883)
    return F.when(color.rlike("^#[0-9a-fA-F]{6}$"), F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b")))


def distance(p: Column, q: Column) -> Column:
    """CIEDE2000 between two Lab structs, after Sharma, Wu and Dalal (2005). p and q are best plain columns, as they stand in many places; with_distance() sees to that."""
    parts: dict[str, Column] = {"p": p, "q": q}
    for _, made in _steps():
        parts |= {n: f(parts) for n, f in made.items()}
    return parts["distance"]


def with_distance(df: DataFrame, a: str, b: str, name: str = "distance") -> DataFrame:
    """df with the CIEDE2000 distance of its #rrggbb columns a and b, computed step by step, so that no step is written out twice."""
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_kept")
    out = df.select(kept, to_lab(F.col(f"`{a}`")).alias("p"), to_lab(F.col(f"`{b}`")).alias("q"))
    for _, made in _steps():
        out = out.withColumns({n: f({c: F.col(c) for c in out.columns}) for n, f in made.items()})
    return out.select("_kept.*", F.col("distance").alias(name))


def _steps() -> list[tuple[str, dict]]:
    """The formula in its published steps; each names what the next ones read."""
    cos = lambda d: F.cos(F.radians(d))
    seven = lambda c: F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))
    angle = lambda y, x: F.when((y == 0) & (x == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))
    turn = lambda v: F.when(v["d1"] * v["d2"] == 0, 0.0).when(v["gap"] > 180, v["gap"] - 360).when(v["gap"] < -180, v["gap"] + 360).otherwise(v["gap"])
    mean = lambda v: F.when(v["d1"] * v["d2"] == 0, v["sum"]).when(F.abs(v["gap"]) <= 180, v["sum"] / 2).when(v["sum"] < 360, (v["sum"] + 360) / 2).otherwise((v["sum"] - 360) / 2)
    return [
        ("stretch of a", {"g": lambda v: 0.5 * (1 - seven((F.hypot(v["p"]["a"], v["p"]["b"]) + F.hypot(v["q"]["a"], v["q"]["b"])) / 2))}),
        ("stretched a", {"a1": lambda v: (1 + v["g"]) * v["p"]["a"], "a2": lambda v: (1 + v["g"]) * v["q"]["a"]}),
        ("chroma and hue", {"d1": lambda v: F.hypot(v["a1"], v["p"]["b"]), "d2": lambda v: F.hypot(v["a2"], v["q"]["b"]), "h1": lambda v: angle(v["p"]["b"], v["a1"]), "h2": lambda v: angle(v["q"]["b"], v["a2"])}),
        ("hues together", {"gap": lambda v: v["h2"] - v["h1"], "sum": lambda v: v["h1"] + v["h2"]}),
        ("differences and means", {"dl": lambda v: v["q"]["l"] - v["p"]["l"], "dc": lambda v: v["d2"] - v["d1"], "dh": lambda v: 2 * F.sqrt(v["d1"] * v["d2"]) * F.sin(F.radians(turn(v) / 2)), "lm": lambda v: F.pow((v["p"]["l"] + v["q"]["l"]) / 2 - 50, F.lit(2.0)), "cm": lambda v: (v["d1"] + v["d2"]) / 2, "hm": mean}),
        ("weights", {
            "t": lambda v: 1 - 0.17 * cos(v["hm"] - 30) + 0.24 * cos(2 * v["hm"]) + 0.32 * cos(3 * v["hm"] + 6) - 0.20 * cos(4 * v["hm"] - 63),
            "sl": lambda v: 1 + 0.015 * v["lm"] / F.sqrt(20 + v["lm"]),
            "sc": lambda v: 1 + 0.045 * v["cm"],
            "rt": lambda v: -2 * seven(v["cm"]) * F.sin(F.radians(60 * F.exp(-F.pow((v["hm"] - 275) / 25, F.lit(2.0))))),
        }),
        ("shares", {"el": lambda v: v["dl"] / v["sl"], "ec": lambda v: v["dc"] / v["sc"], "eh": lambda v: v["dh"] / (1 + 0.015 * v["cm"] * v["t"])}),
        ("distance", {"distance": lambda v: F.sqrt(F.greatest(F.lit(0.0), F.pow(v["el"], F.lit(2.0)) + F.pow(v["ec"], F.lit(2.0)) + F.pow(v["eh"], F.lit(2.0)) + v["rt"] * v["ec"] * v["eh"]))}),
    ]
