"""Deletion over a declared graph of foreign keys: a deleted row takes those that refer to it with it, or is held back by them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """A child's column that holds a parent's key. ``cascade`` deletes the child's rows, else they hold the parent's back."""

    child: str
    column: str
    parent: str
    cascade: bool = True


# Which tables refer to which, and how.
RETAIL = (
    Reference("product_images", "product_id", "products"), Reference("product_colors", "product_id", "products"), Reference("user_favorites", "product_id", "products"),
    Reference("user_favorites", "user_id", "users"), Reference("offers", "product_id", "products", cascade=False),
)


def order_of(references: Sequence[Reference]) -> list[str]:
    """Tables, parents first; a cycle is an error."""
    graph: dict[str, set[str]] = {}
    for r in references:
        graph.setdefault(r.child, set()).add(r.parent)
    return list(TopologicalSorter(graph).static_order())


def held_back(tables: Mapping[str, DataFrame], keys: Mapping[str, str], references: Sequence[Reference], roots: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Of the roots, the keys to which rows that don't cascade refer."""
    out = {}
    for name, wanted in roots.items():
        for r in references:
            if r.parent == name and not r.cascade and r.child in tables:
                refer = tables[r.child].select(F.col(r.column).alias(keys[name])).distinct()
                found = wanted.join(refer, keys[name], "left_semi")
                out[name] = out[name].union(found).distinct() if name in out else found
    return out


def deletions(tables: Mapping[str, DataFrame], keys: Mapping[str, str], references: Sequence[Reference], roots: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that go, per table: the roots (a column of keys per table) and all that cascades from them, in dependency order.

    ``keys`` names the key of each table that others refer to. A row goes once, whichever parents take it. Null references stay.
    """
    gone: dict[str, DataFrame] = {}
    for name in order_of(references):
        if name not in tables:
            continue
        table, marks = tables[name], []
        if name in roots:
            marks.append((keys[name], roots[name].select(F.col(keys[name]).alias("_gone")).distinct()))
        for r in references:
            if r.child == name and r.cascade and r.parent in gone:
                marks.append((r.column, gone[r.parent].select(F.col(keys[r.parent]).alias("_gone")).distinct()))
        if not marks:
            continue
        hit, marked = F.lit(False), table
        for i, (column, parents) in enumerate(marks):
            marked = marked.join(parents.withColumn(f"_hit{i}", F.lit(True)).withColumnRenamed("_gone", f"_gone{i}"), F.col(column) == F.col(f"_gone{i}"), "left")
            hit |= F.coalesce(f"_hit{i}", F.lit(False))
        gone[name] = marked.where(hit).select(*table.columns)
    return gone


def remaining(table: DataFrame, gone: DataFrame | None, row_key: Sequence[str]) -> DataFrame:
    """A table without the rows that go; row_key names a row."""
    return table if gone is None else table.join(gone.select(*row_key).distinct(), list(row_key), "left_anti").select(*table.columns)
