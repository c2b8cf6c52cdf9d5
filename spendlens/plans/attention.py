"""Attention: who stops, who stays and which ads only catch the eye."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact, mean, mean_to, rnd, sdiv, sum_to
from .common import CREATIVE_GRAIN, campaigns, highest_first, spend_total


def _attention_means() -> list[Column]:
    return [
        mean_to("hook_rate", 4).alias("avg_hook_rate"),
        mean_to("hold_rate_3s", 4).alias("avg_hold_rate"),
        mean_to("completion_rate", 4).alias("avg_completion_rate"),
    ]


def scroll_stoppers(facts: DataFrame, min_ads: int = 10, k: int = 20) -> DataFrame:
    """Q4. Creative combinations with the highest mean hook rate."""
    grain = ("hook_type", "creative_angle", "copy_tone", "has_ugc")
    return (
        facts.groupBy(*grain)
        .agg(campaigns("total_ads"), *_attention_means(), mean_to("roas", 2).alias("avg_roas"))
        .filter(F.col("total_ads") >= min_ads)
        .orderBy(highest_first("avg_hook_rate"), *grain)
        .limit(k)
    )


def attention_retention(facts: DataFrame) -> DataFrame:
    """Q5. How much attention survives from hook to hold to completion (ratios of unrounded means)."""
    hook, hold, done = mean("hook_rate"), mean("hold_rate_3s"), mean("completion_rate")
    return (
        facts.groupBy("platform", "ad_format")
        .agg(
            campaigns("total_ads"),
            *_attention_means(),
            rnd(sdiv(hold, hook), 4).alias("hook_to_hold_ratio"),
            rnd(sdiv(done, hold), 4).alias("hold_to_completion_ratio"),
        )
        .orderBy(highest_first("avg_completion_rate"), "platform", "ad_format")
    )


def attention_traps(facts: DataFrame, hook: float = 0.18, completion: float = 0.05) -> DataFrame:
    """Q6a. Creatives with a high mean hook rate but a low mean completion rate (unrounded)."""
    grain = (*CREATIVE_GRAIN, "ad_format")
    return (
        facts.groupBy(*grain)
        .agg(
            mean_to("hook_rate", 4).alias("avg_hook_rate"),
            mean_to("completion_rate", 4).alias("avg_completion_rate"),
            mean_to("cvr", 4).alias("avg_cvr"),
            mean_to("roas", 2).alias("avg_roas"),
            spend_total(),
            mean("hook_rate").alias("_hook"),
            mean("completion_rate").alias("_completion"),
        )
        .filter((F.col("_hook") > exact(hook)) & (F.col("_completion") < exact(completion)))
        .drop("_hook", "_completion")
    )


def attention_trap_retention(traps: DataFrame) -> DataFrame:
    """Q6b. Traps with completion per hook, from the rounded means; strongest hook first."""
    ratio = rnd(sdiv("avg_completion_rate", "avg_hook_rate"), 4).alias("retention_ratio")
    return traps.select("*", ratio).orderBy(highest_first("avg_hook_rate"), *CREATIVE_GRAIN, "ad_format")


def attention_trap_spend(traps: DataFrame) -> DataFrame:
    """Q6c. Number of traps and the spend on them; NULL spend if there are none."""
    return traps.agg(campaigns("trap_count"), sum_to("total_spend").alias("spend_on_traps"))
