"""Comparison of products within a cohort, and averages of pluggable analyzers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.offers import clamped

# The criteria's weights.
WEIGHTS = {"price": 0.30, "discount": 0.25, "rating": 0.25, "reviews": 0.10, "shipping": 0.10}


def normalised(items: DataFrame, cohort: str = "cohort_id") -> DataFrame:
    """Columns n_<criterion> from 0 to 1, null where the criterion can't be judged.

    Price and reviews are judged against the cohort, if two members at least have them.
    """
    w = Window.partitionBy(cohort)
    price = F.when(F.col("current_price") > 0, F.col("current_price").cast("double"))
    reviews = F.when(F.col("total_reviews") >= 0, F.col("total_reviews"))
    df = items.withColumns({"_price": price, "_reviews": reviews})
    df = df.withColumns({"_low": F.min("_price").over(w), "_high": F.max("_price").over(w), "_prices": F.count("_price").over(w), "_most": F.max("_reviews").over(w), "_counts": F.count("_reviews").over(w)})
    spread = F.when(F.col("_high") == F.col("_low"), 1.0).otherwise((F.col("_high") - F.col("_price")) / (F.col("_high") - F.col("_low")))
    popular = F.when(F.col("_most") == 0, 1.0).otherwise(F.log1p("_reviews") / F.log1p("_most"))
    return df.withColumns({
        "n_price": F.when(F.col("_price").isNotNull() & (F.col("_prices") >= 2), spread),
        "n_discount": F.when(F.col("discount_percent") >= 0, F.least(F.col("discount_percent"), F.lit(100)) / 100.0),
        "n_rating": F.when(F.col("average_rating") >= 0, F.least(F.col("average_rating").cast("double"), F.lit(5.0)) / 5.0),
        "n_reviews": F.when(F.col("_reviews").isNotNull() & (F.col("_counts") >= 2), popular),
        "n_shipping": F.col("free_shipping").cast("double"),
    }).drop("_price", "_reviews", "_low", "_high", "_prices", "_most", "_counts")


def scored(items: DataFrame, cohort: str = "cohort_id", weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``score`` from 0 to 10 over the criteria that every member of the cohort has."""
    w = Window.partitionBy(cohort)
    df = normalised(items, cohort)
    df = df.withColumns({f"_w_{c}": F.when(F.count(f"n_{c}").over(w) == F.count(F.lit(1)).over(w), x).otherwise(0.0) for c, x in weights.items()})
    total = sum((F.col(f"_w_{c}") for c in weights), F.lit(0.0))
    gained = sum((F.coalesce(F.col(f"n_{c}"), F.lit(0.0)) * F.col(f"_w_{c}") for c in weights), F.lit(0.0))
    return df.withColumn("score", F.when(total > 0, gained / total * 10).otherwise(0.0)).drop(*[f"_w_{c}" for c in weights])


def leaders(df: DataFrame, value: Column, name: str, tolerance: float, cohort: str = "cohort_id", highest: bool = True) -> DataFrame:
    """Flags name_leader (within the tolerance of the best) and name_tie (several are)."""
    w = Window.partitionBy(cohort)
    df = df.withColumn("_value", value)
    best = (F.max if highest else F.min)("_value").over(w)
    df = df.withColumn(f"{name}_leader", F.coalesce(F.abs(F.col("_value") - best) <= tolerance, F.lit(False)))
    return df.withColumn(f"{name}_tie", F.col(f"{name}_leader") & (F.count_if(F.col(f"{name}_leader")).over(w) > 1)).drop("_value")


Analyzer = Callable[[DataFrame], DataFrame]


class Analyzers:
    """Analyzers by name; each maps candidates to (id, score, confidence, reason)."""

    def __init__(self) -> None:
        self._by_name: dict[str, Analyzer] = {}

    def add(self, name: str, analyzer: Analyzer) -> None:
        if name in self._by_name:
            raise ValueError(f"{name} is registered twice")
        self._by_name[name] = analyzer

    def remove(self, name: str) -> None:
        self._by_name.pop(name, None)

    def names(self) -> list[str]:
        return [*self._by_name]

    def decide(self, candidates: DataFrame) -> DataFrame:
        """id, score, confidence (means of the clamped values, 0 without any), reasons in the analyzers' order."""
        found = None
        for at, analyzer in enumerate(self._by_name.values()):
            part = analyzer(candidates).select("id", clamped(F.col("score").cast("double")).alias("score"), clamped(F.col("confidence").cast("double")).alias("confidence"), "reason", F.lit(at).alias("at"))
            found = part if found is None else found.unionByName(part)
        ids = candidates.select("id")
        if found is None:
            return ids.select("id", F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("reasons"))
        told = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda x: x.reason), lambda r: r.isNotNull())
        means = found.groupBy("id").agg(F.avg("score").alias("score"), F.avg("confidence").alias("confidence"), told.alias("reasons"))
        return ids.join(means, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
