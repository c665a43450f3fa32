"""Images as chunks of pixels in a pyramid of levels, and scans of levels, regions and tiles.

A chunk table has ``image_id, level, y0, x0, h, w, values``: a block of at most ``size`` by
``size`` pixels that begins at ``(y0, x0)`` of its level, with its values row by row, null where
the image has no pixel. Level k is 2^k times smaller than level 0. A scan reads only the chunks
that it needs: it filters, or joins, on their corners.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 64


def chunked(pixels: DataFrame, size: int = SIZE, level: int = 0) -> DataFrame:
    """Chunks of images that are given as pixel rows ``image_id, y, x, v``, one for each place.

    An image may lack pixels, as the last row of tiles of a slide may end anywhere: in a chunk's
    ``h`` by ``w`` values a missing one is null, and scans give no row for it.
    """
    corner = lambda c: (F.col(c) - F.pmod(F.col(c), F.lit(size))).alias(f"{c}0")
    rows = pixels.select("image_id", corner("y"), corner("x"), F.struct("y", "x", "v").alias("p"))
    held = rows.groupBy("image_id", "y0", "x0").agg(F.array_sort(F.collect_list("p")).alias("p"))
    far = lambda c: (F.array_max(F.transform("p", lambda q: q[c])) - F.col(f"{c}0") + 1)
    sized = held.select("image_id", F.lit(level).alias("level"), "y0", "x0", far("y").alias("h"), far("x").alias("w"), "p")
    place = lambda q: (q["y"] - F.col("y0")) * F.col("w") + q["x"] - F.col("x0")
    none = lambda n: F.array_repeat(F.lit(None).cast(dict(pixels.dtypes)["v"]), n.cast("int"))
    before = lambda i: F.when(i > 0, place(F.get("p", i - 1))).otherwise(-1)
    filled = F.flatten(F.transform("p", lambda q, i: F.concat(none(place(q) - before(i) - 1), F.array(q["v"]))))
    filled = F.concat(filled, none(F.col("h") * F.col("w") - 1 - place(F.element_at("p", -1))))
    whole = F.size("p") == F.col("h") * F.col("w")
    return sized.withColumn("values", F.when(whole, F.transform("p", lambda q: q["v"])).otherwise(filled)).drop("p")


def halved(pixels: DataFrame) -> DataFrame:
    """The next level: the whole part of the mean of each two by two pixels."""
    half = lambda c: F.expr(f"{c} div 2").alias(c)
    return pixels.groupBy("image_id", half("y"), half("x")).agg(F.floor(F.avg("v")).cast("long").alias("v"))


def pyramid(pixels: DataFrame, levels: int = 3, size: int = SIZE) -> DataFrame:
    """Chunks of ``levels`` levels, each made from the one before."""
    out, rows = chunked(pixels, size), pixels
    for level in range(1, levels):
        rows = halved(rows)
        out = out.unionByName(chunked(rows, size, level))
    return out


def level_table(chunks: DataFrame) -> DataFrame:
    """``image_id, level, height, width, downsample`` of every level."""
    far = lambda c, d: F.max(F.col(c) + F.col(d))
    sizes = chunks.groupBy("image_id", "level").agg(far("y0", "h").alias("height"), far("x0", "w").alias("width"))
    return sizes.withColumn("downsample", F.expr("shiftleft(1L, level)"))


def pixels_of(chunks: DataFrame, *keys: str) -> DataFrame:
    """``image_id, level, *keys, y, x, v``: the pixels of chunks."""
    rows = chunks.select("image_id", "level", *keys, "y0", "x0", "w", F.posexplode("values").alias("at", "v")).where("v is not null")
    return rows.select("image_id", "level", *keys, F.expr("y0 + at div w").alias("y"), F.expr("x0 + at % w").alias("x"), "v")


def level_image(chunks: DataFrame, level: int) -> DataFrame:
    """All pixels of one level: ``image_id, y, x, v``."""
    return pixels_of(chunks.where(F.col("level") == level)).drop("level")


def region(chunks: DataFrame, x: int, y: int, w: int, h: int, level: int = 0) -> DataFrame:
    """``image_id, y, x, v`` of ``w`` by ``h`` pixels of a level whose corner is at ``(x, y)`` of
    level 0; ``y`` and ``x`` count from that corner. What lies outside of an image has no rows."""
    if w <= 0 or h <= 0:
        raise ValueError("a region needs a positive width and height")
    left, top = x >> level, y >> level
    near = chunks.where((F.col("level") == level) & (F.col("y0") < top + h) & (F.col("x0") < left + w) & (F.col("y0") + F.col("h") > top) & (F.col("x0") + F.col("w") > left))
    rows = pixels_of(near).where(F.col("y").between(top, top + h - 1) & F.col("x").between(left, left + w - 1))
    return rows.select("image_id", (F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "v")


def _met(boxes: DataFrame, chunks: DataFrame, level: int, size: int) -> DataFrame:
    """Boxes at a level (``bx0, by0, bx1, by1``) beside each chunk of their image that they reach."""
    at = lambda c: F.shiftright(F.floor(c).cast("long"), level)
    sized = boxes.withColumns({"bx0": at("x0"), "by0": at("y0"), "bx1": F.greatest(at("x1"), at("x0") + 1), "by1": F.greatest(at("y1"), at("y0") + 1)}).drop("x0", "y0", "x1", "y1")
    corners = lambda lo, hi: F.explode(F.sequence(F.col(lo) - F.pmod(F.col(lo), F.lit(size)), F.col(hi) - 1, F.lit(size)))
    dealt = sized.withColumn("y0", corners("by0", "by1")).withColumn("x0", corners("bx0", "bx1"))
    own = chunks.where(F.col("level") == level).withColumnRenamed("image_id", "slide_id")
    return dealt.join(own, ["slide_id", "y0", "x0"])


def tile_images(chunks: DataFrame, tiles: DataFrame, out: int, level: int = 0, size: int = SIZE, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """``slide_id, tile_id, x, y, vec``: the picture of every tile, ``out`` by ``out``, row by row.

    Tiles (boxes at level 0) are read at ``level`` and resized to the nearest pixels; where they
    leave the image there is 0. ``transform`` changes the whole list of values.
    """
    met = _met(tiles.select("slide_id", "tile_id", F.col("x0").alias("x"), F.col("y0").alias("y"), "x0", "y0", "x1", "y1"), chunks, level, size)
    whole = lambda a, b: F.call_function("div", a, F.lit(b))
    source = lambda lo, hi: F.transform(F.sequence(F.lit(0), F.lit(out - 1)), lambda i: F.col(lo) + whole((i * 2 + 1) * (F.col(hi) - F.col(lo)), 2 * out))
    held = lambda c, lo, n: (c >= F.col(lo)) & (c < F.col(lo) + F.col(n))
    rows = met.withColumns({"sy": source("by0", "by1"), "sx": source("bx0", "bx1")})
    rows = rows.where(F.exists("sy", lambda y: held(y, "y0", "h")) & F.exists("sx", lambda x: held(x, "x0", "w")))

    def value(k: Column) -> Column:
        y, x = F.get("sy", whole(k, out).cast("int")), F.get("sx", k % out)
        return F.when(held(y, "y0", "h") & held(x, "x0", "w"), F.get("values", ((y - F.col("y0")) * F.col("w") + x - F.col("x0")).cast("int")).cast("double"))

    # A chunk's part of a picture has nulls elsewhere; a picture is the first value of its parts.
    part = F.transform(F.sequence(F.lit(0), F.lit(out * out - 1)), value).alias("part")
    parts = rows.select("slide_id", "tile_id", part).groupBy("slide_id", "tile_id").agg(F.collect_list("part").alias("parts"))
    one = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0)), lambda p, q: F.zip_with(p, q, lambda a, b: F.coalesce(a, b)))
    vec = F.transform(one, lambda v: F.coalesce(v, F.lit(0.0)))
    pictures = parts.select("slide_id", "tile_id", (transform(vec) if transform else vec).alias("vec"))
    places = tiles.select("slide_id", "tile_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return places.join(pictures, ["slide_id", "tile_id"]).select("slide_id", "tile_id", "x", "y", "vec")


def tissue_images(chunks: DataFrame, tissues: DataFrame, level: int = 0, size: int = SIZE) -> DataFrame:
    """``slide_id, tissue_id, downsample, y, x, v``: the pixels of every tissue's box at a level,
    counted from the box's corner."""
    met = _met(tissues.select("slide_id", "tissue_id", "x0", "y0", "x1", "y1"), chunks, level, size).withColumnRenamed("slide_id", "image_id")
    rows = pixels_of(met, "tissue_id", "bx0", "by0", "bx1", "by1").where("y >= by0 and y < by1 and x >= bx0 and x < bx1")
    place = [(F.col("y") - F.col("by0")).alias("y"), (F.col("x") - F.col("bx0")).alias("x")]
    return rows.select(F.col("image_id").alias("slide_id"), "tissue_id", F.lit(1 << level).cast("long").alias("downsample"), *place, "v")


def save_image(chunks: DataFrame, path: str, channels: dict[str, DataFrame] | None = None, scale: float = 1.0) -> None:
    """Writes chunks as Parquet by image and level, with named channels and their scale to level 0.

    ``channels`` gives a chunk table for each name; without it the one channel is ``c0``.
    """
    named = channels or {"c0": chunks}
    parts = [df.withColumns({"channel": F.lit(name), "scale": F.lit(float(scale))}) for name, df in named.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out.write.partitionBy("channel", "level").mode("errorifexists").parquet(path)
