"""Catalogue of operators: a decorator registers them, and the catalogue is a DataFrame to filter."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelweave.functions import text
from reelweave.operators import frames, geometry, latent, lists, stats, tags

OPERATORS: dict[str, Callable] = {}


def operator(name: str):
    """Register a function under a name, for ``apply`` and the catalogue."""

    def add(f):
        OPERATORS[name] = f
        return f

    return add


for _module in (text, lists, tags, frames, stats, latent, geometry):
    for _name, _f in vars(_module).items():
        if inspect.isfunction(_f) and _f.__module__ == _module.__name__ and not _name.startswith("_"):
            OPERATORS[f"{_module.__name__.rpartition('.')[2]}.{_name}"] = _f


def apply(name: str, *args, **params):
    """Call a registered operator."""
    if name not in OPERATORS:
        raise KeyError(f"no operator {name}")
    return OPERATORS[name](*args, **params)


def catalogue(spark: SparkSession) -> DataFrame:
    """(name, family, n_params, n_required, doc) of every operator."""
    rows = []
    for name, f in sorted(OPERATORS.items()):
        params = inspect.signature(f).parameters.values()
        rows.append((name, name.partition(".")[0], len(params), sum(p.default is p.empty for p in params), (inspect.getdoc(f) or "").partition("\n")[0]))
    return spark.createDataFrame(rows, "name string, family string, n_params int, n_required int, doc string")


def options(cat: DataFrame, family: str | None = None, most_params: int = 12) -> DataFrame:
    """Entries of a family with few enough parameters, each with a display name of its own, by name without regard to case.

    cat is any table of (name, family, n_params); names are counted by an aggregation and joined back.
    """
    kept = cat.where(F.col("n_params") <= most_params)
    if family:
        kept = kept.where(F.lower("family") == family.lower())
    kept = kept.withColumn("_short", F.substring_index("name", ".", -1))
    same = kept.groupBy("_short").agg(F.count("*").alias("_same"))
    named = kept.join(same, "_short", "left")
    option = F.when(F.col("_same") > 1, F.concat("_short", F.lit(" ("), "family", F.lit(")"))).otherwise(F.col("_short"))
    return named.withColumn("option", option).drop("_short", "_same").orderBy(F.lower("option"))
