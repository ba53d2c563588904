"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time (piecewise linear, times its base weight). The
schedule's integral gives the cumulative demand for the source's words, scaled to its target. Laying
the source's documents end to end, in hash order and epoch after epoch, and inverting the cumulative
demand at each one's words gives its training position; the mix is range-sorted by position.

A source that no task could hold is cut into blocks by the documents' hashes: block sums are added up
first, and running sums are taken within a block only.

Defined results: null texts have size 0 and are never taken; a null source is a source, after all
others; of repeated rows, each counts. A mix of nothing is empty. Texts of any length are counted whole; one
is cut only where its source's target ends. Columns travel in a struct; in ``plan`` and ``schedule`` those of a
name that the plan has too come out with doc_ before it. There are few sources, so windows over a row a source are small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stage, word_array

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
#: Weight multipliers at evenly spaced times, one tuple per base weight: early, steady and late sources.
CURRICULUM = ((1.4, 1.0, 0.6), (1.0, 1.0, 1.0), (0.4, 1.0, 1.6))
#: Hexadecimal digits of the hash that name a block: 4,096 blocks a source.
BLOCK_DIGITS = 3


def position(done: Column, cls: Column, curriculum=CURRICULUM) -> Column:
    """The time at which a share of a source's demand is met: the inverse of the integrated schedule."""
    out = None
    for c, knots in enumerate(curriculum):
        m = len(knots) - 1
        area = [(a + b) / (2 * m) for a, b in zip(knots, knots[1:], strict=False)]
        total = sum(area)
        inner = None
        for j in reversed(range(m)):
            before = sum(area[:j])
            rest = F.greatest(done * total - before, F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(knots[j] ** 2) + 2 * m * (knots[j + 1] - knots[j]) * rest, F.lit(0.0)))
            at = F.least(j / m + 2 * rest / (F.lit(float(knots[j])) + root), F.lit((j + 1) / m))
            inner = at if inner is None else F.when(done * total < before + area[j], at).otherwise(inner)
        out = inner if out is None else F.when(cls == c, inner).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds ``cls`` and ``target`` to a row per source (``source``, ``source_size``).

    A target is level times weight, at most cap times the size; the level is that of the first source,
    by size over weight, which stays under its cap when all before it are at theirs.
    """
    n = len(weights)
    ranked = sizes.withColumn("cls", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n).cast("int"))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("cls")).cast("double"))
    ranked = ranked.withColumn("most", (cap * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("pos", F.row_number().over(order))
    ranked = ranked.withColumn("free", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("pos"))).over(everything))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("pos") == F.col("free"), F.col("level"))).over(everything))
    return ranked.select("source", "source_size", "cls", F.when(F.col("pos") >= F.col("free"), F.col("level") * F.col("weight")).otherwise(F.col("most")).alias("target"))


class Mix:
    """``plan``: a row per document with what the mix takes; ``schedule``: the plan with its training positions, in
    training order; ``rows``: the mixed documents in training order."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, curriculum=CURRICULUM):
        carry = self._carry = docs.columns if carry is None else carry
        key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        name = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col)))  # no nulls in join keys
        # One write counts the words once and gives every row a number; what follows moves narrow rows only.
        own = [F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), name.alias("name"), key.alias("key"), F.substring(key, 1, BLOCK_DIGITS).alias("block"), size.alias("size")]
        self._rows = stage(docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), *own), "mix-rows")
        self._n = self._rows.count()
        sized = self._rows.drop("doc")
        blocks = sized.groupBy("name", "source", "block").agg(F.sum("size").alias("block_size"))
        sources = targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, share, cap)
        sources = sources.withColumn("name", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))).drop("source")
        running = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        starts = blocks.select("name", "block", F.coalesce(F.sum("block_size").over(running), F.lit(0)).alias("block_start")).join(sources, "name")
        within = Window.partitionBy("name", "block").orderBy("key", "id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
        laid = sized.join(starts, ["name", "block"]).withColumn("start", F.col("block_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        whole = F.floor(F.col("target")).cast("long")
        laid = laid.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"))
        rest = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("epochs") * F.col("source_size") - F.col("start")))
        self.laid = laid.withColumn("rest", rest.cast("long"))
        taken = (F.col("size") * F.col("epochs") + F.col("rest")).alias("taken")
        self.plan = self._with_docs(self.laid.select("rid", "size", "source_size", "target", taken)).select(*self._carried("size", "source_size", "target", "taken"), "size", "source_size", "target", "taken")
        self._text, self._most_epochs = text_col, math.ceil(cap) + 1
        self._curriculum = curriculum

    def _carried(self, *own: str) -> list[Column]:
        """The document's columns; those that would clash with the plan's own are named after the document."""
        return [F.col(f"doc.`{c}`").alias(f"doc_{c}" if c in own else c) for c in self._carry]

    def _with_docs(self, plan: DataFrame, rows: int = 1) -> DataFrame:
        """A plan's rows (so many a document at most) with their documents."""
        return self._rows.select("rid", "doc").join(small(plan, rows * self._n, 80), "rid")

    def _words(self, epoch: Column) -> Column:
        return F.when(epoch < F.col("epochs"), F.col("size")).otherwise(F.col("rest"))

    def _position(self, epoch: Column) -> Column:
        """Training time of the middle of the words that an epoch takes of a document."""
        done = (epoch * F.col("source_size") + F.col("start") + self._words(epoch) / 2) / F.col("target")
        return position(done, F.col("cls"), self._curriculum)

    @property
    def schedule(self) -> DataFrame:
        """``positions``: a training position per epoch that takes words of the document, none for what the mix leaves out (last)."""
        epochs = F.filter(F.sequence(F.lit(0).cast("long"), F.col("epochs")), lambda e: self._words(e) > 0)
        taken = (F.col("size") * F.col("epochs") + F.col("rest")).alias("taken")
        placed = self.laid.select("rid", "id", "size", "source_size", "target", taken, F.transform(epochs, self._position).alias("positions"))
        ordered = self._with_docs(placed).orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "id")
        own = ("size", "source_size", "target", "taken", "position", "positions")
        return ordered.withColumn("position", F.get("positions", F.lit(0))).select(*self._carried(*own), *own)

    @property
    def rows(self) -> DataFrame:
        """A document repeats once an epoch; the one on which a source's target ends is cut after its last word taken."""
        epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))).alias("epoch")
        many = self.laid.select("*", epochs).withColumn("words", self._words(F.col("epoch"))).where("words > 0")
        text = F.col(f"doc.{self._text}")
        cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(word_array(text), 1, F.col("words").cast("int")), " ")).otherwise(text)
        placed = self._with_docs(many.select("rid", self._position(F.col("epoch")).alias("position"), "id", "epoch", "words", "size"), self._most_epochs)
        placed = placed.select("position", "id", "epoch", F.col("doc").withField(self._text, cut).alias("doc"))
        return placed.orderBy("position", "id", "epoch").select("doc.*")
