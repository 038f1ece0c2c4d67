"""Colour arithmetic and the roles of a site's colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel(hex_: Column, k: int) -> Column:
    """Red, green or blue (1 to 3) of ``#rrggbb``."""
    return F.conv(F.substring(hex_, 2 * k, 2), 16, 10).cast("int")


def luminance(hex_: Column) -> Column:
    def linear(k: int) -> Column:
        x = channel(hex_, k) / F.lit(255.0)
        return F.when(x <= 0.03928, x / F.lit(12.92)).otherwise(F.pow((x + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))

    return F.lit(0.2126) * linear(1) + F.lit(0.7152) * linear(2) + F.lit(0.0722) * linear(3)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + F.lit(0.05)) / (F.least(x, y) + F.lit(0.05))


def shades(hex_: Column) -> tuple[Column, Column, Column]:
    """Lightness, saturation and chroma, each 0 to 1."""
    top = F.greatest(*[channel(hex_, k) for k in (1, 2, 3)]) / F.lit(255.0)
    low = F.least(*[channel(hex_, k) for k in (1, 2, 3)]) / F.lit(255.0)
    light, chroma = (top + low) / 2, top - low
    room = 1 - F.abs(2 * light - 1)
    return light, F.when(chroma == 0, 0.0).otherwise(F.least(F.lit(1.0), chroma / F.when(room == 0, 1.0).otherwise(room))), chroma


def roles(colors: DataFrame) -> DataFrame:
    """``colors(site, hex, frequency, seq)`` with the role of each colour.

    The most used near-white or near-black is the background, the most used
    grey of the other end the text; of the rest with colour the two most used
    are primary and secondary, the most saturated is the accent; light greys are
    borders.  A site's palette is small: its rows meet in one window.
    """
    light, saturation, chroma = shades(F.col("hex"))
    site = Window.partitionBy("site")
    all_rows = colors.withColumn("light", light).withColumn("saturation", saturation).withColumn("chroma", chroma)
    placed = all_rows.withColumn("k", F.row_number().over(site.orderBy(F.desc("frequency"), "seq")))
    ground = (F.col("chroma") < 0.12) & ((F.col("light") > 0.9) | (F.col("light") < 0.12))
    placed = placed.withColumn("bg", F.min(F.when(ground, F.struct("k", "light"))).over(site))
    apart = F.when(F.col("bg.light") > 0.5, F.col("light") < 0.35).when(F.col("bg").isNotNull(), F.col("light") > 0.7).otherwise(F.col("light") < 0.35)
    not_ground = ~F.col("k").eqNullSafe(F.col("bg.k"))
    placed = placed.withColumn("tx", F.min(F.when(not_ground & (F.col("chroma") < 0.15) & apart, F.col("k"))).over(site))
    colored = not_ground & ~F.col("k").eqNullSafe(F.col("tx")) & (F.col("saturation") >= 0.25) & (F.col("light") > 0.12) & (F.col("light") < 0.9)
    placed = placed.withColumn("n", F.when(colored, F.sum(colored.cast("int")).over(site.orderBy("k"))))
    accent = F.max(F.when(F.col("n") > 2, F.struct("saturation", (-F.col("k")).alias("place")))).over(site)
    placed = placed.withColumn("ac", -accent["place"])
    role = (
        F.when(F.col("k") == F.col("bg.k"), "background").when(F.col("k") == F.col("tx"), "text").when(F.col("n") == 1, "primary").when(F.col("n") == 2, "secondary")
        .when(F.col("k") == F.col("ac"), "accent").when((F.col("chroma") < 0.15) & (F.col("light") > 0.5), "border").otherwise("unknown")
    )
    return placed.select("site", "hex", "frequency", role.alias("role"))
