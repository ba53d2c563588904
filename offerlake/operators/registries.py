"""Registries whose entries become branches of one plan: page collectors by provider, comparison criteria by id."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sections import eligibility

Parser = Callable[[DataFrame], DataFrame]


def provider_slug(c: Column) -> Column:
    return F.lower(F.trim(c))


class Collectors:
    """Provider slugs (trimmed, lower case) to parsers of pages; the last one registered for a slug counts."""

    def __init__(self) -> None:
        self._parsers: dict[str, Parser] = {}

    def register(self, slugs: Iterable[str], parser: Parser) -> None:
        for slug in slugs:
            self._parsers[slug.strip().lower()] = parser

    def resolve(self, slug: str) -> Parser | None:
        return self._parsers.get(slug.strip().lower())

    def supported(self, provider: Column) -> Column:
        return F.coalesce(provider_slug(provider).isin(*self._parsers), F.lit(False)) if self._parsers else F.lit(False)

    def collectable(self, sources: DataFrame, now: Column) -> DataFrame:
        """Sources with ``code``: ok, or the first reason why they may not be collected."""
        return sources.withColumn("code", eligibility(now, self.supported(F.col("provider"))))

    def collected(self, pages: DataFrame, columns: list[str]) -> DataFrame:
        """The named columns of every parser's items, over the pages (with ``provider``) of its slugs: a union of one branch a parser."""
        by_parser: dict[Parser, list[str]] = {}
        for slug, parser in self._parsers.items():
            by_parser.setdefault(parser, []).append(slug)
        if not by_parser:
            raise ValueError("no collector is registered")
        own = lambda slugs: pages.where(provider_slug(F.col("provider")).isin(*slugs)).drop("provider")
        return reduce(DataFrame.unionByName, [parser(own(slugs)).select(*columns) for parser, slugs in by_parser.items()])


class Criteria:
    """Criteria by id: name, weight, and whether more is better. A second one with an id is an error."""

    def __init__(self) -> None:
        self._held: dict[str, tuple[str, float, bool]] = {}

    def register(self, id: str, name: str, weight: float, higher_is_better: bool = True) -> None:
        if id in self._held:
            raise ValueError(f"criterion {id} is registered already")
        self._held[id] = (name, weight, higher_is_better)

    def unregister(self, id: str) -> bool:
        return self._held.pop(id, None) is not None

    def get(self, id: str) -> tuple[str, float, bool] | None:
        return self._held.get(id)

    def __contains__(self, id: str) -> bool:
        return id in self._held

    def __iter__(self):
        return iter(self._held)

    def table(self, spark: SparkSession) -> DataFrame:
        """criterion_id, criterion, weight, higher_is_better, in the order of registration (``place``)."""
        rows = [(id, *told, i) for i, (id, told) in enumerate(self._held.items())]
        return spark.createDataFrame(rows, "criterion_id string, criterion string, weight double, higher_is_better boolean, place int")

    def weighted(self, scores: DataFrame) -> DataFrame:
        """Weighted means of long scores (subject, criterion_id, score) over the registered criteria; others and null scores don't count.
        Where less is better a score counts as 100 less itself."""
        joined = scores.where("score is not null").join(F.broadcast(self.table(scores.sparkSession)), "criterion_id")
        value = F.when(F.col("higher_is_better"), F.col("score")).otherwise(100 - F.col("score"))
        return joined.groupBy("subject").agg((F.sum(value * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("criteria"))
