"""Numbers and labels of an offer: discounts, buckets, badges, freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the ranges.
DISCOUNTS = (("50% ou mais", 50, None), ("40% - 49%", 40, 50), ("30% - 39%", 30, 40), ("20% - 29%", 20, 30), ("Até 19%", 1, 20))
RATINGS = (("4 estrelas ou mais", 4), ("3 estrelas ou mais", 3), ("2 estrelas ou mais", 2), ("1 estrela ou mais", 1))


def rounded(x: Column) -> Column:
    """Half up, as whole number."""
    return F.floor(x + 0.5).cast("int")


def price_of(text: Column) -> Column:
    """The number that a text starts with; 0 if it starts with none or with one that is not finite."""
    number = F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number).otherwise(0.0)


def effective_discount(informed: Column, current: Column, original: Column) -> Column:
    """The informed discount if positive, else that of the prices, else 0; at most 100."""
    now, before = current.cast("double"), original.cast("double")
    priced = F.when((now > 0) & (before > now), rounded((before - now) / before * 100))
    return F.least(F.lit(100), F.when(informed > 0, rounded(informed)).otherwise(F.coalesce(priced, F.lit(0))))


def collected_discount(label: Column, current: Column, original: Column) -> Column:
    now, before = current.cast("double"), original.cast("double")
    return F.coalesce(F.nullif(label, F.lit(0)), F.when(before > now, rounded((1 - now / before) * 100)))


def discount_bucket(discount: Column) -> Column:
    """Null for no discount."""
    chain = F
    for label, low, high in DISCOUNTS:
        chain = chain.when((discount >= low) if high is None else (discount >= low) & (discount < high), label)
    return chain


def rating_buckets(rating: Column) -> Column:
    """All floors that a rating reaches."""
    return F.array_compact(F.array(*[F.when(rating >= low, label) for label, low in RATINGS]))


def badges(promotion: Column, rating: Column, reviews: Column) -> Column:
    """At most three, the most telling first."""
    given = F.array(F.when(promotion == "lightning", "lightning-offer"), F.when(rating >= 4.5, "highly-rated"), F.when(reviews >= 1000, "most-reviewed"))
    return F.slice(F.array_compact(given), 1, 3)


def freshness(seen: Column, now: Column) -> Column:
    """Now, minutes, hours, or the clock time of what is older than a day; empty for null."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(seen)) / 60_000_000)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} atrás"))
    label = F.when(minutes < 1, "agora").when(minutes < 60, ago(minutes, "min")).when(minutes < 1440, ago(F.floor(minutes / 60), "h"))
    return F.coalesce(label.otherwise(F.date_format(seen, "HH:mm")), F.lit(""))


def section_of(promotion: Column) -> Column:
    return F.when(promotion == "lightning", "relampago").when(promotion == "deal_of_day", "dia").when(promotion == "general", "geral")


def clamped(x: Column) -> Column:
    """0 to 100; what is no finite number is 0."""
    finite = x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))).otherwise(0.0)
