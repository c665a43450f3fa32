"""Colours of classes and values: palettes, QuPath classifications, and where colour values come from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours of classes that are exported, by first appearance, in turn (fixed values).
EXPORT_COLORS = ("#1B9E77", "#D95F02", "#7570B3", "#E7298A", "#66A61E", "#E6AB02", "#A6761D", "#666666", "#1F78B4")
#: Colours of many categories, in turn (fixed values: a common palette of twenty).
MANY_COLORS = (
    "#1f77b4", "#aec7e8", "#ff7f0e", "#ffbb78", "#2ca02c", "#98df8a", "#d62728", "#ff9896", "#9467bd", "#c5b0d5",
    "#8c564b", "#c49c94", "#e377c2", "#f7b6d2", "#7f7f7f", "#c7c7c7", "#bcbd22", "#dbdb8d", "#17becf", "#9edae5",
)


def rgb(color: str) -> tuple[int, int, int]:
    """Red, green and blue of ``#rrggbb``."""
    if len(color) != 7 or color[0] != "#":
        raise ValueError(f"{color!r} is no colour of the form #rrggbb")
    return tuple(int(color[i : i + 2], 16) for i in (1, 3, 5))  # type: ignore[return-value]


def appearance(df: DataFrame, classes: str, order: str) -> DataFrame:
    """``class, first, place``: the distinct classes, numbered from 0 by first appearance.

    Only classes are numbered in one window; there are as many rows as classes.
    """
    seen = df.groupBy(F.col(classes).alias("class")).agg(F.min(order).alias("first"))
    return seen.withColumn("place", F.row_number().over(Window.orderBy("first", "class")) - 1)


def _listed(colors: Sequence[str]) -> Column:
    return F.array(*map(F.lit, colors))


def class_colors(df: DataFrame, classes: str, order: str, colors: None | str | Mapping[str, str] | Sequence[str] = None) -> DataFrame:
    """``class, color``: QuPath JSON ``{"name", "color"}`` of every class.

    ``colors``: None gives the default colours in turn; a column's name takes the colour of the
    class's first row; a mapping gives what it has; a list is used up by first appearance.
    Classes without a colour get a null one.
    """
    if classes not in df.columns:
        raise ValueError(f"there is no column {classes!r}; columns: {', '.join(df.columns)}")
    seen = appearance(df, classes, order)
    if colors is None:
        seen = seen.withColumn("hex", F.get(_listed(EXPORT_COLORS), F.pmod("place", F.lit(len(EXPORT_COLORS)))))
    elif isinstance(colors, str):
        if colors not in df.columns:
            raise ValueError(f"there is no colour column {colors!r}; columns: {', '.join(df.columns)}")
        own = df.groupBy(F.col(classes).alias("class")).agg(F.min_by(colors, order).alias("hex"))
        seen = seen.join(own, "class")
    elif isinstance(colors, Mapping):
        pairs = F.create_map(*[F.lit(x) for kv in colors.items() for x in kv]) if colors else F.lit(None)
        seen = seen.withColumn("hex", F.try_element_at(pairs, "class") if colors else F.lit(None).cast("string"))
    elif isinstance(colors, Sequence):
        seen = seen.withColumn("hex", F.get(_listed(colors), F.col("place")) if colors else F.lit(None).cast("string"))
    else:
        raise ValueError(f"colours must be a column, a mapping or a list, not {type(colors).__name__}")
    parts = [F.conv(F.substring("hex", i, 2), 16, 10).cast("int") for i in (2, 4, 6)]
    color = F.when(F.col("hex").isNotNull(), F.array(*parts))
    return seen.select("class", F.to_json(F.struct(F.col("class").alias("name"), color.alias("color")), {"ignoreNullFields": "false"}).alias("color"))


def palette(df: DataFrame, column: str, order: str, colors: None | str | Mapping[str, str] | Sequence[str] = None) -> DataFrame:
    """``category, color`` of every category of a column, by first appearance.

    Without ``colors``: nine categories at most get the export colours, more the twenty of a
    common palette, in turn. A mapping is taken as it is; one colour serves all; a list goes round.
    """
    seen = appearance(df, column, order).withColumnRenamed("class", "category")
    if isinstance(colors, Mapping):
        pairs = F.create_map(*[F.lit(x) for kv in colors.items() for x in kv])
        return seen.select("category", F.try_element_at(pairs, "category").alias("color"))
    if isinstance(colors, str):
        rgb(colors)
        return seen.select("category", F.lit(colors).alias("color"))
    if colors is not None:
        return seen.select("category", F.get(_listed(colors), F.pmod("place", F.lit(len(colors)))).alias("color"))
    few = F.get(_listed(EXPORT_COLORS), F.pmod("place", F.lit(len(EXPORT_COLORS))))
    many = F.get(_listed(MANY_COLORS), F.pmod("place", F.lit(len(MANY_COLORS))))
    number = seen.agg(F.count("*").alias("number"))
    return seen.join(F.broadcast(number)).select("category", F.when(F.col("number") <= len(EXPORT_COLORS), few).otherwise(many).alias("color"))


def color_values(tiles: DataFrame, color_by: str, features: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """``slide_id?, tile_id, value``: what tiles are coloured by.

    With ``features`` (``tile_id, vec`` and columns): one of its columns, else the dimension that
    ``names`` gives that name, or that number of it. Without, a column of the tiles.
    """
    source = tiles if features is None else features
    keys = [c for c in ("slide_id", "tile_id") if c in source.columns]
    if color_by in source.columns:
        return source.select(*keys, F.col(color_by).alias("value"))
    if features is None:
        raise ValueError(f"color_by={color_by!r} isn't in the tile table")
    if color_by in names:
        return features.select(*keys, F.get("vec", F.lit(list(names).index(color_by))).alias("value"))
    if color_by.isdigit():
        return features.select(*keys, F.get("vec", F.lit(int(color_by))).alias("value"))
    raise ValueError(f"color_by={color_by!r} isn't in the features")
