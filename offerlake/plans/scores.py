"""Queries of comparison scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import scoring as G
from ..operators.records import place_letters
from ..registry import query

_NORMAL = """
    w AS (SELECT *, CASE WHEN current_price > 0 THEN CAST(current_price AS DOUBLE) END AS p, CASE WHEN total_reviews >= 0 THEN total_reviews END AS r FROM v_cohorts),
    a AS (SELECT *, min(p) OVER c AS lo, max(p) OVER c AS hi, count(p) OVER c AS np, max(r) OVER c AS top, count(r) OVER c AS nr, count(*) OVER c AS members FROM w WINDOW c AS (PARTITION BY cohort_id)),
    n AS (SELECT *, CASE WHEN p IS NOT NULL AND np >= 2 THEN CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (hi - p) / (hi - lo) END END AS n_price,
        CASE WHEN discount_percent >= 0 THEN least(discount_percent, 100) / 100.0::DOUBLE END AS n_discount,
        CASE WHEN average_rating >= 0 THEN least(CAST(average_rating AS DOUBLE), 5.0) / 5.0::DOUBLE END AS n_rating,
        CASE WHEN r IS NOT NULL AND nr >= 2 THEN CASE WHEN top = 0 THEN 1.0::DOUBLE ELSE ln(1 + r) / ln(1 + top) END END AS n_reviews,
        CAST(CAST(free_shipping AS INT) AS DOUBLE) AS n_shipping FROM a)"""
_SCORED = f"""{_NORMAL},
    u AS (SELECT *, {', '.join(f"CASE WHEN count(n_{c}) OVER c = members THEN {x}::DOUBLE ELSE 0.0::DOUBLE END AS w_{c}" for c, x in G.WEIGHTS.items())} FROM n WINDOW c AS (PARTITION BY cohort_id)),
    s AS (SELECT *, CASE WHEN {' + '.join(f'w_{c}' for c in G.WEIGHTS)} > 0 THEN ({' + '.join(f'coalesce(n_{c}, 0) * w_{c}' for c in G.WEIGHTS)}) / ({' + '.join(f'w_{c}' for c in G.WEIGHTS)}) * 10 ELSE 0 END AS score FROM u)"""
_CRITERIA = [f"n_{c}" for c in G.WEIGHTS]


@query("cohort_normalized", f"WITH {_NORMAL} SELECT product_id, {', '.join(f'round({c}, 6) AS {c}' for c in _CRITERIA)} FROM n")
def cohort_normalized(v):
    return G.normalised(v.v_cohorts).select("product_id", *[F.round(c, 6).alias(c) for c in _CRITERIA])


@query("comparison_scores", f"WITH {_SCORED} SELECT cohort_id, product_id, round(score, 6) AS score FROM s")
def comparison_scores(v):
    return G.scored(v.v_cohorts).select("cohort_id", "product_id", F.round("score", 6).alias("score"))


@query("score_leaders", f"""
    WITH {_SCORED}, t AS (SELECT *, round(score, 6) AS q FROM s), l AS (SELECT *, abs(q - max(q) OVER (PARTITION BY cohort_id)) <= 0.1 AS leads FROM t)
    SELECT product_id, leads AS score_leader, leads AND count(*) FILTER (WHERE leads) OVER (PARTITION BY cohort_id) > 1 AS score_tie FROM l""")
def score_leaders(v):
    return G.leaders(G.scored(v.v_cohorts), F.round("score", 6), "score", 0.1).select("product_id", "score_leader", "score_tie")


def _leader_sql(value: str, name: str, best: str) -> str:
    return f"coalesce(abs({value} - {best}({value}) OVER (PARTITION BY cohort_id)) <= 0.000001, false) AS {name}_leader"


@query("criterion_leaders", f"""
    WITH b AS (SELECT product_id, cohort_id, {_leader_sql('current_price', 'price', 'min')}, {_leader_sql('discount_percent', 'discount', 'max')}, {_leader_sql('average_rating', 'rating', 'max')} FROM v_cohorts)
    SELECT product_id, {', '.join(f"{n}_leader, {n}_leader AND count(*) FILTER (WHERE {n}_leader) OVER (PARTITION BY cohort_id) > 1 AS {n}_tie" for n in ("price", "discount", "rating"))} FROM b""")
def criterion_leaders(v):
    df = G.leaders(v.v_cohorts, F.col("current_price"), "price", 1e-6, highest=False)
    df = G.leaders(G.leaders(df, F.col("discount_percent"), "discount", 1e-6), F.col("average_rating"), "rating", 1e-6)
    return df.select("product_id", *[f"{n}_{x}" for n in ("price", "discount", "rating") for x in ("leader", "tie")])


@query("product_labels", "SELECT product_id, 'Produto ' || chr(CAST(64 + row_number() OVER (PARTITION BY cohort_id ORDER BY product_id) AS INT)) AS label FROM v_cohorts")
def product_labels(v):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("cohort_id").orderBy("product_id"))
    return v.v_cohorts.select("product_id", F.concat(F.lit("Produto "), place_letters(place)).alias("label"))


def _decided(v):
    engine = G.Analyzers()
    engine.add("discount", lambda df: df.where("discount_percent is not null").select("id", F.col("discount_percent").alias("score"), F.lit(80).alias("confidence"), F.lit("discount").alias("reason")))
    engine.add("rating", lambda df: df.where("average_rating is not null").select("id", (F.col("average_rating") * 25).alias("score"), F.lit(140).alias("confidence"), F.when(F.col("average_rating") >= 4, "well rated").alias("reason")))
    engine.add("shipping", lambda df: df.where("free_shipping").select("id", F.lit(float("nan")).alias("score"), F.lit(-5).alias("confidence"), F.lit("free shipping").alias("reason")))
    return engine.decide(v.v_catalog)


_DECIDED = """
    x AS (SELECT id, least(100, greatest(0, discount_percent))::DOUBLE AS s, 80.0::DOUBLE AS c, 'discount' AS r, 0 AS pos FROM v_catalog WHERE discount_percent IS NOT NULL
        UNION ALL SELECT id, least(100, average_rating * 25)::DOUBLE, 100, CASE WHEN average_rating >= 4 THEN 'well rated' END, 1 FROM v_catalog WHERE average_rating IS NOT NULL
        UNION ALL SELECT id, 0, 0, 'free shipping', 2 FROM v_catalog WHERE free_shipping),
    d AS (SELECT k.id, coalesce(round(avg(s), 6), 0) AS score, coalesce(round(avg(c), 6), 0) AS confidence, coalesce(string_agg(r, ',' ORDER BY pos), '') AS reasons FROM v_catalog k LEFT JOIN x ON x.id = k.id GROUP BY k.id)"""


@query("decision_averages", f"WITH {_DECIDED} SELECT * FROM d")
def decision_averages(v):
    return _decided(v).select("id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.array_join("reasons", ",").alias("reasons"))


@query("decision_ranking_top", f"WITH {_DECIDED} SELECT id, score FROM d ORDER BY score DESC, id LIMIT 50")
def decision_ranking_top(v):
    return _decided(v).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("decision_ranking", f"WITH {_DECIDED} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM d")
def decision_ranking(v):
    ranked = _decided(v).select("id", F.round("score", 6).alias("score"))
    return C.placed(ranked, [F.desc("score"), F.col("id")])
