"""Settings that operators read from the session, with validation."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.tessella."


@dataclass
class Settings:
    """``texts_at_once`` and ``batch_rows`` bound what is broadcast and batched; ``progress``
    turns Spark's progress bar on."""

    texts_at_once: int = 2_000
    batch_rows: int = 1_000
    progress: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(f.default, bool) and not isinstance(value, bool):
                raise TypeError(f"{f.name} must be true or false")
            if not isinstance(f.default, bool) and (not isinstance(value, int) or value < 1):
                raise ValueError(f"{f.name} must be a positive number")

    def apply(self, spark: SparkSession) -> None:
        for f in fields(self):
            spark.conf.set(PREFIX + f.name, str(getattr(self, f.name)).lower())

    @classmethod
    def read(cls, spark: SparkSession) -> "Settings":
        got = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(cls)}
        return cls(**{f.name: (v == "true") if isinstance(f.default, bool) else int(v) for f in fields(cls) if (v := got[f.name]) is not None})
