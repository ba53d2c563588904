"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

A document's ids and a final separator are one piece, or, if too long, pieces of full length with the
shorter one first. Full pieces are sequences by themselves. The others are dealt, in the order in which the
documents come, to shards of bounded size, and each shard to islands. An island breeds packings: crossover injects whole well-filled
bins of one parent into another, drops the bins that hold the same pieces, and best-fits the displaced
pieces; mutation dissolves the emptiest bins. Between rounds an island's elite migrates to its neighbour
through a shuffle. Where best-fit alone reaches the bound (all tokens over the length), no packing has fewer
bins, so nothing is bred. Bins that stay emptier than a bound are dissolved and packed again across shards.
A sequence is named after its first piece, so sequences in the order of their ids follow the documents' order.

Defined results: a null or empty text is the separator alone. Repeated rows are separate pieces. An empty
table gives no pieces. Texts of any length are encoded whole. Only id and text are read, so other columns
can't clash. Equal lengths are told apart by item. Reruns agree: every random choice is seeded by shard, island and round.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, text_chunks
from .tokens import TextTokenizer, default_tokenizer

LENGTH = 2048
#: Bytes of text, about, that are encoded at once.
TEXT_BYTES = 2 << 20
SHARD_PIECES = 4096
ISLANDS, ROUNDS, POPULATION, GENERATIONS = 2, 2, 6, 24
#: Bins less full than this are packed again across shards, in so many levels.
POOR_FILL, LEVELS = 0.97, 3


def pieces_of(docs: DataFrame, tokenizer: Callable[[], TextTokenizer] = default_tokenizer, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = tokenizer()
        for batch in batches:
            for low, high, found in text_chunks(batch.column(1), TEXT_BYTES, tok.encode_all):
                out = []
                for doc, ids in zip(batch.column(0)[low:high].to_pylist(), found, strict=True):
                    ids = np.append(ids, np.uint32(0)).astype("<u4", copy=False)
                    cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
                    out += [(doc, i, a, b - a, zlib.crc32(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Bins:
    """A packing of items (by index) with best-fit insertion."""

    def __init__(self, size: list[int], length: int):
        self.size, self.length = size, length
        self.items: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.by_room: dict[int, set[int]] = {}
        self.rooms = 0  # bit r: some bin has r left
        self.next = 0

    def _link(self, b: int, room: int) -> None:
        self.room[b] = room
        self.by_room.setdefault(room, set()).add(b)
        self.rooms |= 1 << room

    def _unlink(self, b: int) -> None:
        room = self.room.pop(b)
        same = self.by_room[room]
        same.discard(b)
        if not same:
            self.rooms &= ~(1 << room)

    def add_bin(self, items: list[int]) -> None:
        self.items[self.next] = items
        self._link(self.next, self.length - sum(map(self.size.__getitem__, items)))
        self.next += 1

    def drop_bin(self, b: int) -> list[int]:
        self._unlink(b)
        return self.items.pop(b)

    def best_fit(self, items: list[int]) -> None:
        """Longest first, each to the fullest bin that takes it."""
        for i in sorted(items, key=lambda i: (-self.size[i], i)):
            n = self.size[i]
            fits = self.rooms >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = min(self.by_room[room])
                self._unlink(b)
                self.items[b].append(i)
                self._link(b, room - n)
            else:
                self.add_bin([i])

    def copy(self) -> Bins:
        out = Bins(self.size, self.length)
        for b in self.items:
            out.add_bin([*self.items[b]])
        return out

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller full ones."""
        return -len(self.items), sum((self.length - r) ** 2 for r in self.room.values())


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """a with some of b's well-filled bins whole."""
    ranked = sorted(b.items, key=lambda x: (b.room[x], x))
    good = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(good, max(1, len(good) // 3))
    taken = {i for x in chosen for i in b.items[x]}
    child = a.copy()
    displaced = []
    for x in [x for x, items in child.items.items() if not taken.isdisjoint(items)]:
        displaced += [i for i in child.drop_bin(x) if i not in taken]
    for x in chosen:
        child.add_bin([*b.items[x]])
    child.best_fit(displaced)
    return child


def mutate(a: Bins, rng: random.Random) -> Bins:
    """The emptiest bins and some others dissolve."""
    child = a.copy()
    worst = sorted(child.items, key=lambda x: (-child.room[x], x))[: max(2, len(child.items) // 50)]
    worst = {*worst, *rng.sample(sorted(child.items), min(len(child.items), 3))}
    loose = [i for x in sorted(worst) for i in child.drop_bin(x)]
    child.best_fit(loose)
    return child


def breed(size: list[int], length: int, elites: list[list[list[int]]], seed: int) -> Bins:
    """The best packing of an island after its generations; elites: packings that it starts with."""
    rng = random.Random(seed)
    people = []
    for bins in elites:
        p = Bins(size, length)
        for items in bins:
            p.add_bin(items)
        people.append(p)
    bound = -(-sum(size) // length)
    first = Bins(size, length)
    first.best_fit(list(range(len(size))))
    people.append(first)
    best = max(people, key=Bins.fitness)
    if len(best.items) <= bound:
        return best  # no packing has fewer
    while len(people) < POPULATION:
        shuffled = Bins(size, length)
        for i in rng.sample(range(len(size)), len(size)):
            shuffled.best_fit([i])
        people.append(shuffled)
    for _ in range(GENERATIONS):
        if len(best.items) <= bound:
            break
        a, b = rng.sample(people, 2)
        people += [mutate(crossover(a, b, rng), rng), mutate(best, rng)]
        people = sorted(people, key=Bins.fitness, reverse=True)[:POPULATION]
        best = people[0]
    return best


def _island(length: int, turn: int):
    """One round of an island: its pieces, with the bins of the elites that came to it."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["origin", "item"], kind="stable")
        own = pdf.drop_duplicates("item").sort_values("item")
        index = dict(zip(own["item"], range(len(own)), strict=True))
        elites = [[[index[i] for i in x["item"]] for _, x in e.groupby("bin")] for _, e in pdf.groupby("origin") if e.bin.notna().all()]
        best = breed(own["length"].tolist(), length, elites, hash((int(key[0]), int(key[1]), turn)))
        where = np.zeros(len(own), np.int64)
        for items in best.items.values():
            where[items] = own["item"].iloc[min(items)]  # named after its first piece
        return pd.DataFrame({"item": own["item"], "length": own["length"], "shard": key[0], "origin": key[1], "bin": where})

    return run


def _best_island(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score = {}
        for origin, p in pdf.groupby("origin"):
            fill = p.groupby("bin")["length"].sum()
            score[origin] = (len(fill), -float((fill.to_numpy(np.float64) ** 2).sum()), origin)
        best = pdf[pdf.origin == min(score, key=score.get)].sort_values(["bin", "item"])
        best["offset"] = best.groupby("bin")["length"].cumsum() - best["length"]
        best["fill"] = best.groupby("bin")["length"].transform("sum")
        return best[["item", "length", "bin", "offset", "fill"]]

    return run


def ranked(items: DataFrame) -> DataFrame:
    """Adds ``rank``: the rows before an item, in the order of its number; numbers come from ``monotonically_increasing_id``."""
    part = F.shiftright("item", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = items.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("item").alias("low"))
    starts = starts.select("part", "low", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("item"))
    return items.withColumn("part", part).join(starts.select("part", "before"), "part").withColumn("rank", F.col("before") + within - 1).drop("part", "before")


def pack_items(items: DataFrame, n: int, length: int, level: int) -> DataFrame:
    """item, length, bin (null, or the bin it comes from) to item, length, bin, offset, fill.

    First the shards are stretches of the input's order, so that a mix keeps its curriculum; poor bins are then dealt by hash.
    """
    shards = max(1, -(-n // SHARD_PIECES))
    if level == 0:
        dealt = ranked(items).withColumn("shard", F.floor(F.col("rank") / SHARD_PIECES)).drop("rank")
    else:  # a bin stays in one shard, as a packing to start with
        dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("bin", "item"), F.lit(level)), F.lit(shards)))
    rows = dealt.select("item", "length", "shard", F.lit(0).cast("long").alias("origin"), "bin")
    schema = "item long, length long, shard long, origin long, bin long"
    for turn in range(ROUNDS):
        if turn == 0:
            targets = F.sequence(F.lit(0).cast("long"), F.lit(ISLANDS - 1).cast("long"))
        else:  # an elite goes to its own island and the next
            targets = F.array(F.col("origin"), (F.col("origin") + 1) % ISLANDS)
        rows = rows.withColumn("island", F.explode(targets)).groupBy("shard", "island").applyInPandas(_island(length, turn), schema)
    return rows.groupBy("shard").applyInPandas(_best_island(length), "item long, length long, bin long, offset long, fill long")


def pack(docs: DataFrame, tokenizer: Callable[[], TextTokenizer] = default_tokenizer, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece with its sequence_id and offset."""
    pieces = stage(pieces_of(docs, tokenizer, length, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    full = F.col("length") == length
    loose = pieces.where(~full).select("item", "length", F.lit(None).cast("long").alias("bin"))
    n = loose.count()
    placed = []
    for level in range(LEVELS):
        done = stage(pack_items(loose, n, length, level), f"pack-level{level}")
        poor = F.col("fill") < POOR_FILL * length
        again = done.where(poor).select("item", "length", "bin")
        n_again = again.count()
        if level == LEVELS - 1 or n_again == 0 or n <= SHARD_PIECES:
            placed.append(done)
            break
        placed.append(done.where(~poor))
        loose, n = again, n_again
    found = placed[0]
    for p in placed[1:]:
        found = found.unionByName(p)
    where = pieces.join(found.select("item", F.col("bin").alias("sequence_id"), "offset"), "item", "left")
    return where.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "item").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
