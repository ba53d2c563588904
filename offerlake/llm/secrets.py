"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

The base patterns give spans by kind. The method adds tokens that no pattern names: each long token with
letters and digits is scored by two bigram models, one trained on random strings (the secrets that the
assign and access patterns find, but for plain hexadecimal ones and words), one on ordinary identifiers (long words of letters); it is a secret if the log-likelihood
ratio exceeds THRESHOLD. Both samples are taken from all documents and are bounded by SAMPLE_TOKENS, those
with the lowest hashes.

DataFrame functions only. Positions are code points, ends exclusive. Spans come from what stands between
the matches: a match starts where the gaps and matches before it end. Defined results: a null text is
empty; an empty text has no spans; without samples of both kinds the models add nothing. Repeated rows are
scanned alike, and an empty table gives no rows. Of spans that start together the kinds' order decides. Texts
of any length are scanned whole, in time that grows with the length. Only id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, stage

# Fixed by the contract of the base spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 8

#: Tokens that the models judge: at least 16 characters, with a digit and a letter; and the identifiers they learn from.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}+"
IDENTIFIER = r"(?<![A-Za-z0-9_])[A-Za-z_]{12,}(?![A-Za-z0-9_])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_TOKENS = 50_000
#: Matches whose lengths are summed up at once.
BLOCK = 64
THRESHOLD = 8.0

_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often inner functions name it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each of an array's numbers, all before it combined; block by block, so that no array grows by one item at a time over a whole text."""
    number = lambda x: F.lit(x).cast("bigint")
    empty = F.array().cast("array<bigint>")
    step = lambda acc, x: F.struct(combine(acc.at, x).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))
    scan = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), empty.alias("out")), step, lambda acc: acc.out)

    def by_block(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        return F.when(F.size(xs) == 0, F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK)))

    def scanned(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda xs: F.aggregate(xs, number(zero), combine))
        return F.flatten(F.zip_with(blocks, scan(totals, number(zero)), scan))

    return let(let(values, by_block), scanned)


def spans(text: Column, pattern: str, rank: int, keep: tuple[int, int] | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end); keep: a group and its least length."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size")))

    def placed(xs: Column) -> Column:
        before = running(F.transform(xs, lambda x: x.gap + F.coalesce(x["size"], F.lit(0))), lambda a, b: a + b, 0)
        return F.zip_with(xs, before, lambda x, n: F.struct((n + x.gap).alias("start"), F.lit(rank).alias("rank"), (n + x.gap + x["size"]).alias("end")))

    out = F.filter(let(lengths, placed), lambda s: s.end.isNotNull())
    if keep:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep[0]))
        out = let(values, lambda v: F.filter(out, lambda s, i: F.length(F.get(v, i)) >= keep[1]))
    return F.when(text.rlike(pattern), out).otherwise(F.array()).cast(_SPAN)


def apart(added: Column, base: Column) -> Column:
    """The added spans that overlap none of the base: of all in order, the farthest end so far and the next start to come tell."""
    far = 1 << 62
    own = lambda s: s["rank"] < len(KINDS) - 1

    def of(both: Column) -> Column:
        ends = running(F.transform(both, lambda s: F.when(own(s), s.end).otherwise(F.lit(0).cast("bigint"))), lambda a, b: F.greatest(a, b), 0)
        starts = F.reverse(running(F.transform(F.reverse(both), lambda s: F.when(own(s), s.start).otherwise(F.lit(far).cast("bigint"))), lambda a, b: F.least(a, b), far))
        near = F.zip_with(ends, starts, lambda e, n: F.struct(e.alias("before"), n.alias("after")))
        return let(near, lambda x: F.filter(both, lambda s, i: ~own(s) & (F.get(x, i).before <= s.start) & (F.get(x, i).after >= s.end)))

    return F.when(F.size(added) == 0, added).otherwise(let(F.array_sort(F.concat(base, added)), of)).cast(_SPAN)


def told(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s.start.cast("string"), s.end.cast("string"))), ",")


def _bigram_counts(tokens: DataFrame) -> dict[str, int]:
    pairs = let(F.split("token", ""), lambda cs: F.zip_with(cs, F.slice(cs, F.lit(2), F.size(cs)), lambda x, y: F.concat(x, y)))  # null after the last
    rows = tokens.select(F.explode(pairs).alias("pair")).where("length(pair) = 2").groupBy("pair").count().collect()  # at most len(ALPHABET) ** 2
    return {r["pair"]: r["count"] for r in rows}


def _sample(docs: DataFrame, tokens: Column) -> DataFrame:
    found = stage(docs.select(F.explode(tokens).alias("token")).distinct(), "secret-tokens")
    return sampled(found, SAMPLE_TOKENS, "token")


def log_ratios(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    """log P_random(next | this) - log P_ordinary(next | this), add-half smoothed, row by row."""
    n = len(ALPHABET)

    def logs(counts: dict[str, int]) -> list[list[float]]:
        out = []
        for a in ALPHABET:
            row = [counts.get(a + b, 0) + 0.5 for b in ALPHABET]
            total = sum(row)
            out.append([math.log(x / total) for x in row])
        return out

    p, q = logs(random), logs(ordinary)
    return [round(p[i][j] - q[i][j], 6) for i in range(n) for j in range(n)]


def train(docs: DataFrame, text: Column) -> list[float] | None:
    secrets = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0))])
    any_secret = text.rlike(ASSIGN) | text.rlike(ACCESS)
    positive = _sample(docs.where(any_secret), F.filter(secrets, lambda t: (F.length(t) >= MIN_VALUE) & t.rlike("^[A-Za-z0-9+/_=-]+$") & ~t.rlike("^[0-9a-f]+$|^[A-Z]+$|^[a-z]+$")))
    negative = _sample(docs, F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)))
    random, ordinary = _bigram_counts(stage(positive, "secret-positive")), _bigram_counts(stage(negative, "secret-negative"))
    return log_ratios(random, ordinary) if random and ordinary else None


def ratio(token: Column, weights: list[float]) -> Column:
    """The token's log-likelihood ratio: a sum over its bigrams, looked up by position."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    n = len(ALPHABET)
    places = F.transform(F.split(token, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    add = lambda acc, at: F.struct(at.alias("last"), (acc.sum + F.when(acc.last >= 0, F.coalesce(F.get(table, acc.last * n + at), F.lit(0.0))).otherwise(0.0)).alias("sum"))
    return F.aggregate(F.filter(places, lambda x: x >= 0), start, add, lambda acc: acc.sum)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added (arrays of spans) of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    weights = train(docs, text)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), spans(text, ASSIGN, 0, (2, MIN_VALUE)).alias("assign"), spans(text, ACCESS, 1).alias("access"), spans(text, HEX, 2).alias("hex"))
    base = base.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    if weights is None:
        return base.select("doc_id", "assign", "access", "hex", "base", F.array().cast(_SPAN).alias("added"))
    body = F.col("text")
    tokens = F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0))
    judged = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]") & (ratio(t, weights) > threshold)
    likely = let(tokens, lambda t: F.filter(spans(body, CANDIDATE, 3), lambda s, i: judged(F.get(t, i))))
    free = apart(F.col("likely"), F.col("base"))
    base = base.withColumn("likely", likely)
    return base.select("doc_id", "assign", "access", "hex", "base", free.alias("added"))


def report(found: DataFrame) -> DataFrame:
    count = lambda c: F.size(c).cast("long")
    everything = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(everything).alias("spans"))
