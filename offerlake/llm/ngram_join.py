"""Similarity join on word n-gram sets, over R-trees of count vectors.

Tokens (hashed n-grams) are dealt to groups, and a set's group counts are a point. Two sets share at most
the sum of their coordinates' minima, so a node or a point whose sum falls short of the overlap that the
threshold needs is skipped. Survivors are verified on the sets themselves.

So that no task needs all points, they are first brought together by the groups' contents. Sets of like
sizes deal their tokens to K = D + 1 + S groups, where D is the largest symmetric difference of a linked
pair: at least S + 1 groups must then hold the same tokens. A group's content hash is a key. Groups with
few tokens are no keys, unless so many of a set's groups are small that they could be all that a pair
shares. No link is lost by either rule.

Exact copies collapse to one class first. Classes are joined to clusters by sharing enough keys with a key's
first class. A cluster's sets travel once, in pages of bounded size; each page has a tree, and every set of it
searches the tree for sets of other components, best bound first, so that most of a group of near copies
is joined by a comparison or two a set. Clusters of several pages are dealt anew once, their components
known. Then the sets outside a cluster's largest component meet all of the cluster, a page against a page, each page
with a tree. Points there have about two coordinates a token, so a near copy that is no link is told by its
bound, and what passes is verified where it is found; only joined components leave a task. At last pairs of different
clusters that share keys are searched by key: the members outside a key's largest component against all others.

Defined results: a null, empty or blank text has no n-grams and links with nothing; a text with fewer
words is one n-gram by itself. Repeated rows are exact copies; ties of ids are one document's name. A null
id never names a component unless all ids in it are null. An empty table gives an empty result. Texts of
any length are taken whole: a page then holds fewer sets. Columns of the input travel in a struct, so none
can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, drop, mix, small, stage, text_chunks
from .components import connected_components
from .filters import MAX_BITS, KeyFilter, key_filter

#: Coordinates of a point that travels; of points within a page, at most (two a token).
COORDINATES, FINE = 64, 4096
#: Points in a leaf of the tree; sets, and tokens on average, in a page of a cluster or key.
LEAF, PAGE, PAGE_TOKENS = 16, 512, 4 << 20
#: Rows and tokens, on average, that one call searches.
GROUP_ROWS, GROUP_TOKENS = 4096, 2 << 20
#: Deals of a cluster of several pages.
TURNS = 2
#: Ratio of the smallest to the largest size in a band.
BAND = 0.7
#: Sets that a task remembers, so as to send copies once.
SEEN = 50_000


class Scheme:
    """Bands of sizes, and the groups that a set's tokens are dealt to in each."""

    def __init__(self, percent: int):
        self.percent = percent
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(lows[-1] / BAND)))
        self.lows = np.array(lows)
        self.most = self.lows[1:] - 1
        self.differ = (100 - percent) * self.most // percent  # the largest symmetric difference with a smaller set in the band
        #: With a tighter threshold groups hold more tokens, so fewer of them are small.
        self.least = 2 if percent >= 85 else 1
        self.spare = 3 + self.differ * (5 if percent >= 85 else 10) // 100

    def bands(self, n: int) -> range:
        """The band of n, and those of the smaller sets that it may link with."""
        first = -(-self.percent * n // 100)
        return range(int(np.searchsorted(self.lows, first, "right")) - 1, int(np.searchsorted(self.lows, n, "right")))

    def keys(self, tokens: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Per band: how many of the keys a linked pair shares at least, the keys, and which of them suffice when fewer are shared.

        A set with many small groups may link with one that has few, and that one has no keys of small groups:
        all that they surely share is the key of one other group. A set whose own size allows a smaller
        difference than D leaves out as many of the last groups.
        """
        out, n, p = [], len(tokens), self.percent
        if not n:
            return out
        spread = mix(tokens)
        bands = self.bands(n)
        for band in bands:
            d, s = int(self.differ[band]), int(self.spare[band])
            if not d:
                continue  # equal sets only, which are one class
            k = d + 1 + s
            own = (100 - p) * n // p if band == bands[-1] else (100 - p) * (int(self.most[band]) + n) // (100 + p)
            last = k - max(0, d - own)
            group = ((tokens >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            content = np.zeros(k, np.uint64)
            np.add.at(content, group, spread)
            count = np.bincount(group, minlength=k)
            salt = mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 32))
            keys = mix(content + salt + count.astype(np.uint64))[:last]
            small = count[:last] < self.least
            n_small = int(small.sum())
            if n_small <= s:
                out.append((max(1, s + 1 - n_small), keys[~small], np.zeros(last - n_small, bool)))
            else:
                out.append((s + 1, keys, ~small))
        return out

    def shared(self, tokens: np.ndarray, keep: KeyFilter) -> tuple[int, list[np.ndarray]]:
        """The keys per band that may bring the set together with one that it links with, and the least number that a pair shares."""
        out, fewest = [], 0
        for least, keys, alone in self.keys(tokens):
            hit = keep.hits(keys)
            if np.count_nonzero(hit) < least:
                hit = hit & alone
            if hit.any():
                out.append(keys[hit])
                fewest = min(fewest or least, least)
        return fewest, out


def token_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = Words(texts, lower=True)
    grams, _ = words.grams(n)
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for at in range(a, b):
                whole = mix(whole + words.hash[at])
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def point(tokens: np.ndarray) -> np.ndarray:
    return np.bincount((tokens & np.uint64(COORDINATES - 1)).astype(np.int64), minlength=COORDINATES).astype(np.int32)


def fine_points(tokens: list[np.ndarray]) -> np.ndarray:
    """Points with about two coordinates for each token of the largest set, so that few tokens share one."""
    most = max(map(len, tokens))
    n = min(FINE, max(COORDINATES, 1 << (2 * most - 1).bit_length()))
    out = np.zeros((len(tokens), n), np.int16 if most < 1 << 15 else np.int32)
    for row, t in zip(out, tokens, strict=True):
        row += np.bincount((t & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(out.dtype)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are alike enough."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int(np.count_nonzero(b[at] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class RTree:
    """Leaves of neighbouring points under a level of parents; each node keeps its largest coordinates and its range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        parts, leaves = [np.arange(len(sizes))], []
        while parts:  # halved at the median of the widest coordinate
            rows = parts.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            at = points[rows]
            widest = int(np.argmax(at.max(axis=0) - at.min(axis=0)))
            halves = np.argpartition(at[:, widest], len(rows) // 2)
            parts += [rows[halves[len(rows) // 2 :]], rows[halves[: len(rows) // 2]]]
        self.order = np.concatenate(leaves)
        cut = np.cumsum([0, *map(len, leaves)])
        up = np.arange(0, len(leaves), LEAF)
        self.cut, self.up = cut, np.append(up, len(leaves))
        self.high = np.maximum.reduceat(points[self.order], cut[:-1])
        self.low_size = np.minimum.reduceat(sizes[self.order], cut[:-1])
        self.high_size = np.maximum.reduceat(sizes[self.order], cut[:-1])
        self.up_high = np.maximum.reduceat(self.high, up)
        self.up_low = np.minimum.reduceat(self.low_size, up)
        self.up_high_size = np.maximum.reduceat(self.high_size, up)

    def search(self, p: np.ndarray, size: int, percent: int, wanted: np.ndarray) -> np.ndarray:
        """The wanted points that may overlap p enough, largest bound first: 100 * overlap >= percent * (size + other - overlap)."""

        def may(high, low, top):
            most = np.minimum(high, p).sum(axis=1, dtype=np.int64)
            return most, ((100 + percent) * most >= percent * (size + low)) & (100 * top >= percent * size) & (percent * low <= 100 * size)

        any_wanted = np.logical_or.reduceat(wanted[self.order], self.cut[:-1])
        parents = np.flatnonzero(may(self.up_high, self.up_low, self.up_high_size)[1] & np.logical_or.reduceat(any_wanted, self.up[:-1]))
        if not len(parents):
            return parents
        leaves = np.concatenate([np.arange(self.up[x], self.up[x + 1]) for x in parents])
        leaves = leaves[any_wanted[leaves]]
        leaves = leaves[may(self.high[leaves], self.low_size[leaves], self.high_size[leaves])[1]]
        if not len(leaves):
            return leaves
        at = self.order[np.concatenate([np.arange(self.cut[x], self.cut[x + 1]) for x in leaves])]
        at = at[wanted[at]]
        most, passed = may(self.points[at], self.sizes[at], self.sizes[at])
        return at[passed][np.argsort(-most[passed], kind="stable")]


def link_page(v: np.ndarray, tokens: list[np.ndarray], component: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The components of a page's sets after all its links (the smallest number of those joined), and how many pairs were verified.

    Every set searches the tree for the sets before it that are in other components.
    """
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    points = fine_points(tokens)
    tree = RTree(points, sizes)
    component, verified = component.copy(), 0
    before = np.zeros(len(v), bool)
    for i in np.lexsort((v, sizes)):
        for j in tree.search(points[i], sizes[i], percent, before & (component != component[i])):
            if component[j] != component[i]:
                verified += 1
                if linked(tokens[i], tokens[j], percent):
                    low, high = sorted((component[i], component[j]))
                    component[component == high] = low
        before[i] = True
    return component, verified


def link_blocks(v: np.ndarray, tokens: list[np.ndarray], component: np.ndarray, left: np.ndarray, met, percent: int) -> tuple[np.ndarray, int]:
    """Like ``link_page`` for the lefts against the rights; met(x, rights) tells those that x was compared with before."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    points = fine_points(tokens)
    rights = np.flatnonzero(~left)
    tree = RTree(points[rights], sizes[rights])
    component, verified = component.copy(), 0
    for x in np.flatnonzero(left)[np.lexsort((v[left], sizes[left]))]:
        for j in tree.search(points[x], sizes[x], percent, (component[rights] != component[x]) & ~met(x, rights)):
            y = rights[j]
            if component[y] != component[x]:
                verified += 1
                if linked(tokens[x], tokens[y], percent):
                    low, high = sorted((component[x], component[y]))
                    component[component == high] = low
    return component, verified


def _split(order: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """An order of rows, cut where a column changes."""
    new = np.zeros(len(order) - 1, bool)
    for c in columns:
        new |= c[order][1:] != c[order][:-1]
    return np.split(order, np.flatnonzero(new) + 1)


def _blocks(percent: int):
    """Links the pairs of pages of a call: a row per component that joined a smaller one, and one with the pairs verified."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, i, j, left, v, component, q0, q1 = (pdf[c].to_numpy() for c in ("label", "i", "j", "left", "v", "component", "q0", "q1"))
        tokens = [np.asarray(t, np.int64).view(np.uint64) for t in pdf["tokens"]]
        joined, total = [np.zeros((0, 2), np.int64)], 0
        for rows in _split(np.lexsort((v, left, j, i, label)), label, i, j):
            own = left[rows]
            if own.all() or not own.any():
                continue
            met = lambda x, rights, rows=rows: (q0[rows[rights]] == q0[rows[x]]) | ((q1[rows[rights]] == q1[rows[x]]) & (q1[rows[x]] >= 0))
            after, verified = link_blocks(v[rows], [tokens[k] for k in rows], component[rows], own, met, percent)
            changed = after != component[rows]
            joined.append(np.stack([component[rows][changed], after[changed]], axis=1))
            total += verified
        pairs = np.append(np.unique(np.concatenate(joined), axis=0), [[-1, -1]], axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "verified": np.append(np.zeros(len(pairs) - 1, np.int64), total)})

    return run


def _pages(percent: int):
    """Links the pages of a call."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, page, v, component = (pdf[c].to_numpy() for c in ("label", "page", "v", "component"))
        after = component.copy()
        tokens = [np.asarray(t, np.int64).view(np.uint64) for t in pdf["tokens"]]
        for rows in _split(np.lexsort((v, page, label)), label, page):
            if len(rows) > 1:
                after[rows] = link_page(v[rows], [tokens[i] for i in rows], component[rows], percent)[0]
        return pd.DataFrame({"v": v, "page": page, "was": component, "component": after})

    return run


def _key_pairs(percent: int):
    """The pairs that the trees let pass, between the two sides of each key's blocks, and how many keys brought each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, i, j, right, other = (pdf[c].to_numpy() for c in ("key", "i", "j", "right", "other"))
        v, sizes, comp, least, label = (pdf[c].to_numpy() for c in ("v", "n", "component", "least", "label"))
        points = np.stack(pdf["point"].to_numpy())
        pairs = [np.zeros((0, 3), np.int64)]
        for rows in _split(np.lexsort((v, right, j, i, key)), key, i, j):
            rights, lefts = rows[right[rows]], rows[~right[rows]]
            if not len(rights) or not len(lefts):
                continue
            tree = RTree(points[rights], sizes[rights])
            for x in lefts:
                found = rights[tree.search(points[x], sizes[x], percent, (comp[rights] != comp[x]) & (label[rights] != label[x]) & (~other[rights] | (v[rights] > v[x])))]
                pairs.append(np.stack([np.minimum(v[x], v[found]), np.maximum(v[x], v[found]), np.minimum(least[x], least[found])], axis=1))
        both, keys = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "least": both[:, 2], "keys": keys})

    return run


class NgramJoin:
    """``docs``: doc_id, n_shingles, component_id per row; ``kept``: the first row of each component."""

    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, max_filter_bits: int = MAX_BITS, page: int = PAGE):
        self._percent, self._page = percent, page
        #: Pairs verified between pages and by key, for whoever watches them.
        self.verified = self.verified_by_key = 0
        scheme = Scheme(percent)
        counted = docs.select(text_col).mapInArrow(_all_keys(n, scheme), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
        repeated = stage(counted.where("copies > 1").select("key"), "join-keys")
        keep = key_filter(repeated, "key", repeated.count(), max_filter_bits)
        drop(repeated)
        found = _sets(docs, n, scheme, keep, id_col, text_col, docs.columns if carry is None else carry)
        rows = stage(found.withColumn("rid", F.monotonically_increasing_id()), "join-rows")
        # A class is named after its first row that carries keys.
        self._classes = stage(rows.where("keys is not null").groupBy("cid").agg(F.min("rid").alias("v"), F.first("n").alias("n")), "join-classes")
        self._sets = rows.where("keys is not null").select(F.col("rid").alias("v"), "n", "least", "keys", "point", "tokens")
        classes = self._classes.select("v")
        entries = self._sets.join(small(classes, classes.count(), 32), "v", "left_semi").select("v", "least", F.explode("keys").alias("key"))
        buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("v").alias("head")).where("members > 1")
        members = stage(entries.join(buckets, "key").select("key", "v", "least", "head"), "join-members")
        named = stage(self._named(members), "join-components")
        drop(members)
        ids = rows.where("n > 0").groupBy("cid").agg(F.min("id").alias("first_id"), F.min("rid").alias("first_rid"))
        ids = ids.join(named, "cid", "left")
        group = F.when(F.col("component").isNull(), F.col("cid")).otherwise(F.concat(F.lit("#"), F.col("component")))
        ids = ids.select("cid", "first_id", "first_rid", group.alias("group"))
        groups = ids.groupBy("group").agg(F.min("first_id").alias("component_id"))
        members = stage(ids.join(groups, "group").select("cid", "group", "component_id"), "join-groups")
        told = rows.select("rid", "id", "n", "cid").where("n > 0").join(members, "cid")
        alone = rows.where("n = 0").select("rid", "id", "n", F.col("id").alias("component_id"))
        self.docs = told.select("rid", "id", "n", "component_id").union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
        stays = told.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("stays"))
        dropped = told.select("rid").join(stays, "rid", "left_anti")
        self._rows, self._dropped = rows, dropped

    @property
    def kept(self) -> DataFrame:
        dropped = stage(self._dropped, "join-dropped")
        return self._rows.join(small(dropped, dropped.count(), 32), "rid", "left_anti").select("doc.*")

    def release(self) -> None:
        """Deletes the join's tables; its results can't be read any more."""
        drop(self._rows)
        drop(self._classes)

    def _named(self, members: DataFrame) -> DataFrame:
        """cid, component (null: it links with no other class)."""
        placed = self._clustered(members)
        links = self._rest(members, placed)
        component = F.coalesce("component", "v")
        ends = placed.select("v", "component")
        for side in ("a", "b"):
            links = links.join(ends.select(F.col("v").alias(side), F.col("component").alias(f"of_{side}")), side, "left").withColumn(side, F.coalesce(f"of_{side}", side)).drop(f"of_{side}")
        final = connected_components(links).select(F.col("vertex").alias("component"), F.col("component").alias("final"))
        told = self._classes.join(ends, "v", "left").withColumn("component", component).join(final, "component", "left")
        return told.select("cid", F.coalesce("final", "component").alias("component"))

    def _clusters(self, members: DataFrame) -> DataFrame:
        """v, label: a class and the first class of its cluster, for those that share enough keys with a key's first class."""
        met = members.where("v <> head").groupBy("v", "head").agg(F.count(F.lit(1)).alias("shared"), F.min("least").alias("least")).where("shared >= least")
        return connected_components(met.select(F.col("v").alias("a"), F.col("head").alias("b"))).select(F.col("vertex").alias("v"), F.col("component").alias("label"))

    def _clustered(self, members: DataFrame) -> DataFrame:
        """v, label, the page of each turn (q0, q1) and component, after the pages' links."""
        dealt = self._clusters(members).join(self._classes.select("v", "n"), "v")
        totals = dealt.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens")).where("size > 1")
        pages = F.greatest(F.ceil(F.col("size") / self._page), F.ceil(F.col("tokens") / PAGE_TOKENS)).alias("pages")
        placed = stage(dealt.join(totals, "label").select("v", "n", "label", pages, F.col("v").alias("component")), "join-clusters")
        for turn in range(TURNS):
            work = placed
            if turn:
                mixed = placed.where("pages > 1").groupBy("label").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("label")
                work = placed.join(mixed, "label", "left_semi")
            work = stage(work.withColumn("page", F.pmod(F.xxhash64("v", F.lit(turn)), F.col("pages"))).select("v", "n", "label", "page", "component"), "join-work")
            rows, tokens = work.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            if not rows:
                placed = placed.withColumn(f"q{turn}", F.lit(-1).cast("long"))
                continue
            group = F.pmod(F.xxhash64("label", "page"), F.lit(max(1, -(-tokens // GROUP_TOKENS), -(-rows // GROUP_ROWS)))).alias("group")
            sets = self._sets.select("v", "tokens").join(small(work, rows, 64), "v").select("v", "label", "page", "component", "tokens", group)
            found = stage(sets.groupBy("group").applyInPandas(_pages(self._percent), "v long, page long, was long, component long"), "join-pages")
            drop(work)
            told = found.select("v", F.col("page").alias(f"q{turn}"), F.col("component").alias("now"))
            if turn:
                joined = connected_components(found.where("was <> component").select(F.col("was").alias("a"), F.col("component").alias("b")))
                told = told.drop("now")
                placed = placed.join(joined.select(F.col("vertex").alias("component"), F.col("component").alias("now")), "component", "left")
            placed = stage(placed.join(told, "v", "left").withColumn("component", F.coalesce("now", "component")).withColumn(f"q{turn}", F.coalesce(f"q{turn}", F.lit(-1).cast("long"))).drop("now"), "join-clusters")
        return self._met(placed)

    def _met(self, placed: DataFrame) -> DataFrame:
        """After the pages: the sets outside a cluster's largest component meet the cluster's other pages."""
        sizes = placed.where("pages > 1").groupBy("label", "component").agg(F.count(F.lit(1)).alias("size"))
        main = sizes.groupBy("label").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"))
        main = main.where("main.size < all").select("label", F.col("main.component").alias("main"), F.ceil((F.col("all") - F.col("main.size")) / F.col("all") * 1_000_000).alias("share"))
        lefts = F.greatest(F.lit(1), F.ceil(F.col("pages") * F.col("share") / 1_000_000)).alias("lefts")
        work = placed.where("pages > 1").join(main, "label").select("v", "n", "label", "component", "q0", "q1", "pages", lefts, (F.col("component") != F.col("main")).alias("other"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        columns = ["v", "n", "label", "component", "q0", "q1"]
        right = work.select(*columns, F.lit(False).alias("left"), every("lefts").alias("i"), F.pmod(F.xxhash64("v", F.lit(7)), F.col("pages")).alias("j"))
        left = work.where("other").select(*columns, F.lit(True).alias("left"), F.pmod(F.xxhash64("v", F.lit(8)), F.col("lefts")).alias("i"), every("pages").alias("j"))
        blocks = stage(right.unionByName(left), "join-work")
        rows, tokens = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not rows:
            drop(blocks)
            return placed
        group = F.pmod(F.xxhash64("label", "i", "j"), F.lit(max(1, -(-tokens // GROUP_TOKENS), -(-rows // GROUP_ROWS)))).alias("group")
        sets = self._sets.select("v", "tokens").join(small(blocks, rows, 96), "v").select("label", "i", "j", "left", "v", "component", "q0", "q1", "tokens", group)
        found = stage(sets.groupBy("group").applyInPandas(_blocks(self._percent), "a long, b long, verified long"), "join-blocks")
        drop(blocks)
        self.verified = found.agg(F.sum("verified")).first()[0]
        joined = connected_components(found.where("a <> b").select("a", "b")).select(F.col("vertex").alias("component"), F.col("component").alias("now"))
        after = stage(placed.join(joined, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now"), "join-clusters")
        drop(found)
        drop(placed)
        return after

    def _rest(self, members: DataFrame, placed: DataFrame) -> DataFrame:
        """Verified links (a, b) between different components of classes that share a key but no cluster."""
        own = placed.select("v", "label", "component")
        at = members.join(own, "v", "left").select("key", "v", "least", F.coalesce("label", "v").alias("label"), F.coalesce("component", "v").alias("component"))
        parts = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("label").alias("p"), F.max("label").alias("q")).where("x <> y and p <> q").select("key")
        rest = stage(at.join(parts, "key", "left_semi"), "join-rest")
        n_rest = rest.count()
        if not n_rest:
            return rest.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0)
        # Members of a key's largest component need not meet each other.
        sizes = rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        main = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"))
        blocks = main.select("key", F.col("main.component").alias("main"), F.ceil((F.col("all") - F.col("main.size")) / self._page).alias("lefts"), F.ceil(F.col("all") / self._page).alias("rights"))
        points = rest.join(blocks, "key").withColumn("other", F.col("component") != F.col("main")).join(self._sets.select("v", "n", "point"), "v")
        columns = ["key", "v", "n", "least", "label", "component", "point", "other"]
        right = points.select(*columns, F.lit(True).alias("right"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("i"), F.pmod(F.xxhash64("v", F.lit(7)), F.col("rights")).alias("j"))
        left = points.where("other").select(*columns, F.lit(False).alias("right"), F.pmod(F.xxhash64("v", F.lit(8)), F.col("lefts")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)).alias("j"))
        # Most keys have few members: a call's group holds many of them, and each has its own tree.
        group = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-n_rest // GROUP_ROWS)))).alias("group")
        searched = right.union(left).withColumn("group", group).groupBy("group").applyInPandas(_key_pairs(self._percent), "a long, b long, least long, keys long")
        pairs = stage(searched.groupBy("a", "b").agg(F.min("least").alias("least"), F.sum("keys").alias("keys")).where("keys >= least").select("a", "b"), "join-pairs")
        drop(rest)
        self.verified_by_key = pairs.count()
        return stage(self._verified(pairs), "join-links")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are alike enough."""
        p = self._percent
        side = lambda x: self._sets.select(F.col("v").alias(x), F.col("tokens").alias(f"t_{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        return both.where((100 + p) * F.size(F.array_intersect("t_a", "t_b")) >= p * (F.size("t_a") + F.size("t_b"))).select("a", "b")


def _digest(tokens: np.ndarray) -> str:
    """Names a set: 128 bits of BLAKE2b over its sorted hashes."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest() if len(tokens) else ""


def _all_keys(n: int, scheme: Scheme):
    """Every key of every set; of copies within a task, once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[str] = set()
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0)):
                out = []
                for tokens in token_sets(texts, n):
                    name = _digest(tokens)
                    if name not in seen:
                        seen.add(name)
                        out += [k for _, k, _ in scheme.keys(tokens)]
                if len(seen) > SEEN:
                    seen.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["key"])

    return run


def _sets(docs: DataFrame, n: int, scheme: Scheme, keep: KeyFilter, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """A row per document; the first with a set in a task that shares keys carries its keys, point and tokens."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[str] = set()
        for batch in batches:
            doc = batch.column(0)
            kept = pa.StructArray.from_arrays([doc.field(c) for c in carry], names=carry)
            for a, b, texts in text_chunks(doc.field(text_col)):
                out = []
                for tokens in token_sets(texts, n):
                    name, keys = _digest(tokens), []
                    if name not in seen:
                        seen.add(name)
                        least, keys = scheme.shared(tokens, keep)
                    if keys:
                        out.append((len(tokens), name, least, np.concatenate(keys).view(np.int64), point(tokens), tokens.view(np.int64)))
                    else:
                        out.append((len(tokens), name, None, None, None, None))
                if len(seen) > SEEN:
                    seen.clear()
                columns = list(zip(*out, strict=True))
                longs = pa.list_(pa.int64())
                arrays = [pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), longs, pa.list_(pa.int32()), longs), strict=True)]
                yield pa.RecordBatch.from_arrays([kept.slice(a, b - a), doc.field(id_col).slice(a, b - a), *arrays], names=["doc", "id", "n", "cid", "least", "keys", "point", "tokens"])

    longs = T.ArrayType(T.LongType())
    carried = T.StructType([docs.schema[c] for c in carry])
    schema = T.StructType([T.StructField("doc", carried), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("cid", T.StringType()), T.StructField("least", T.LongType()), T.StructField("keys", longs), T.StructField("point", T.ArrayType(T.IntegerType())), T.StructField("tokens", longs)])
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, id_col, text_col])]).alias("doc")).mapInArrow(run, schema)
