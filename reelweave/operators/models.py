"""Slots for models: the dataflow around a sampler, encoder or upscaler, with the model as a batch function.

No weights are shipped.  A model is any function from a pandas Series (or several) to a Series; it runs
in Arrow batches on the executors, and lists, seeds and chunks are laid out by the operators here.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave.operators import lists


def encode_texts(texts: DataFrame, model: Callable, text: str = "value", out: str = "emb") -> DataFrame:
    """Each text of a list with its embedding."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return model(batch)

    return texts.withColumn(out, run(text))


def sampler_plan(latents: DataFrame, prompts: DataFrame, seed: int, policy: str) -> DataFrame:
    """(list_id, pos, a, b, seed): latents and prompts aligned, the shorter side's last item repeated."""
    both = lists.zip_repeat_last(latents, prompts)
    return both.withColumn("seed", lists.step_seeds(F.col("pos"), F.lit(str(seed)).cast("decimal(20,0)"), policy))


def sample(plan: DataFrame, model: Callable, out: str = "array<double>") -> DataFrame:
    """Run a sampler ``model(a, b, seed)`` over a plan."""

    @F.pandas_udf(out)
    def run(a: pd.Series, b: pd.Series, seed: pd.Series) -> pd.Series:
        return model(a, b, seed)

    return plan.withColumn("samples", run("a", "b", F.col("seed").cast("double")))


def attach_masks(conditionings: DataFrame, masks: DataFrame, strength: float, bounds: str) -> DataFrame:
    """Conditionings (list_id, pos, emb, meta) with the mask of their position; lengths must be equal."""
    c = conditionings.select("list_id", "pos", F.struct("emb", "meta").alias("value"))
    both = lists.zip_strict(c, masks)
    extra = F.create_map(F.lit("set_area_to_bounds"), F.lit(str(bounds != "default").lower()), F.lit("mask_strength"), F.lit(str(strength)))
    return both.select("list_id", "pos", F.col("a.emb").alias("emb"), F.map_concat("a.meta", extra).alias("meta"), F.col("b").alias("mask"))


def decode_params(tile: int, overlap: int, temporal: int, temporal_overlap: int, spatial_factor: int = 8, temporal_factor: int = 4) -> dict:
    """Legal tile and overlap sizes in latents: an overlap is at most a quarter of its tile, a temporal one at most half."""
    if tile < overlap * 4:
        overlap = tile // 4
    if temporal < temporal_overlap * 2:
        temporal_overlap = temporal_overlap // 2
    return {
        "tile": tile // spatial_factor, "overlap": overlap // spatial_factor,
        "temporal": max(2, temporal // temporal_factor), "temporal_overlap": max(1, min(temporal // temporal_factor // 2, temporal_overlap // temporal_factor)),
    }


def padded_frames(n: Column, factor: int) -> Column:
    """Number of frames after the last one is repeated up to a multiple of the temporal factor."""
    return F.ceil(n / factor) * factor
