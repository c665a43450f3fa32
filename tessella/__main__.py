"""Commands over tables of slides: ``info``, ``preprocess``, ``feature``, ``agg``, ``qc``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.operators import aggregate, models, shapes, tiling
from tessella.sources.store import SlideStore, cohort, feature_key


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in {"info": "", "preprocess": "tile_px stride_px background_fraction", "feature": "model images tile_key", "agg": "features by encoder out", "qc": "element column"}.items():
        c = sub.add_parser(name)
        c.add_argument("store")
        for option in more.split():
            c.add_argument(f"--{option.replace('_', '-')}", dest=option)
        if name == "agg":
            c.add_argument("--slides", help="CSV with a column 'store'; without it, the store alone")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    store = SlideStore(spark, args.store)
    if args.command == "info":
        tissues = store.get("tissues")
        shapes.bounds_of(tissues, "slide_id").join(tissues.groupBy("slide_id").agg(F.count("*").alias("tissues")), "slide_id").orderBy("slide_id").show(50, False)
    elif args.command == "preprocess":
        tile = int(args.tile_px or 256)
        tiles = tiling.tile_tissues(store.get("tissues"), tile, int(args.stride_px or tile), background_fraction=float(args.background_fraction or 0.3))
        store.put("tiles", tiles, overwrite=True)
    elif args.command == "feature":
        model = args.model or "moments"
        store.put(feature_key(model, args.tile_key or "tiles"), models.feature_extraction(store.get(args.images or "images"), model), overwrite=True)
    elif args.command == "qc":
        store.put(f"{args.element or 'tiles'}_passed", store.get(args.element or "tiles").where(F.col(args.column or "qc")), overwrite=True)
    else:
        key = args.features or "moments_tiles"
        stores = [args.store] if not args.slides else [r[0] for r in cohort(spark, args.slides, "store", args.store).select("store").toLocalIterator()]
        out = None
        for path in stores:
            one = SlideStore(spark, path)
            rows = one.get(key).join(one.get("tiles"), "tile_id")
            done = aggregate.feature_aggregation(rows, tuple((args.by or "slide_id").split(",")), args.encoder or "mean")
            out = done if out is None else out.unionByName(done)
        out.write.mode("errorifexists").parquet(args.out or f"{args.store.rstrip('/')}/agg_{key}")


if __name__ == "__main__":
    main()
