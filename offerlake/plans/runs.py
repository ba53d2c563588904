"""Queries of collection runs: memberships, raw and processed rows, publishing, decisions, dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import titles as T
from ..operators import runs as R
from ..registry import query
from .attributes import BRAND_SQL, normal_sql, terms_sql

_BATCH = "b2"
_MET = """
    ids AS (SELECT source_id, external_item_id, min(id) AS member FROM v_members WHERE external_item_id IS NOT NULL GROUP BY ALL),
    hashes AS (SELECT source_id, content_hash, min(id) AS member FROM v_members GROUP BY ALL),
    met AS (SELECT i.*, CASE WHEN i.external_id IS NULL THEN h.member ELSE e.member END AS member, coalesce('e:' || i.external_id, 'h:' || i.content_hash) AS item_key FROM v_items i
            LEFT JOIN ids e ON e.source_id = i.source_id AND e.external_item_id = i.external_id LEFT JOIN hashes h ON h.source_id = i.source_id AND h.content_hash = i.content_hash),
    seen AS (SELECT DISTINCT ON (member) * FROM met WHERE member IS NOT NULL ORDER BY member, position DESC, item_id DESC),
    fresh AS (SELECT DISTINCT ON (source_id, item_key) * FROM met WHERE member IS NULL ORDER BY source_id, item_key, position DESC, item_id DESC),
    upserted AS (SELECT m.id, m.source_id, m.external_item_id, coalesce(s.content_hash, m.content_hash) AS content_hash, coalesce(s.title, m.raw_title) AS raw_title, s.member IS NOT NULL OR m.is_active AS is_active,
                   CASE WHEN s.member IS NOT NULL THEN 'b2' ELSE m.last_batch END AS last_batch, CASE WHEN s.member IS NOT NULL THEN 0 ELSE m.missed END AS missed FROM v_members m LEFT JOIN seen s ON s.member = m.id
                 UNION ALL SELECT 'new-' || source_id || '-' || item_key, source_id, external_id, content_hash, title, true, 'b2', 0 FROM fresh)"""


def _upserted(v):
    return R.upserted_memberships(v.v_members, v.v_items.where("source_id % 3 <> 1"), _BATCH)


@query("membership_upsert", f"WITH {_MET.replace('FROM v_items i', 'FROM (SELECT * FROM v_items WHERE source_id % 3 <> 1) i')} SELECT * FROM upserted")
def membership_upsert(v):
    return _upserted(v)


@query("membership_miss", f"""WITH {_MET.replace('FROM v_items i', 'FROM (SELECT * FROM v_items WHERE source_id % 3 <> 1) i')},
    g AS (SELECT *, coalesce(source_id % 3 <> 1 AND is_active AND last_batch <> 'b2', false) AS gone FROM upserted)
    SELECT id, source_id, CASE WHEN gone THEN missed + 1 < 2 ELSE is_active END AS is_active, CASE WHEN gone THEN missed + 1 ELSE missed END AS missed FROM g""")
def membership_miss(v):
    return R.missed_memberships(_upserted(v), _BATCH, v.v_sources.select(F.col("id").alias("source_id")).where("source_id % 3 <> 1"))


_NEW = """n AS (SELECT DISTINCT ON (content_hash) * FROM v_items i WHERE NOT EXISTS (SELECT 1 FROM v_processed p WHERE p.content_hash = i.content_hash) ORDER BY content_hash, position, item_id)"""


@query("existing_raw_lookup", """WITH l AS (SELECT DISTINCT ON (content_hash) content_hash, id AS processed_id FROM v_processed ORDER BY content_hash, processed_at DESC, id DESC)
    SELECT i.item_id, l.processed_id, l.processed_id IS NOT NULL AS known FROM v_items i LEFT JOIN l USING (content_hash)""")
def existing_raw_lookup(v):
    return R.known_items(v.v_items, v.v_processed).select("item_id", "processed_id", "known")


@query("raw_item_rows", f"""WITH {_NEW} SELECT content_hash, 'b2' AS batch_id, external_id, title AS raw_title, price::VARCHAR AS raw_price, original_price::VARCHAR AS raw_original_price, image AS raw_image, url AS raw_url, discount AS raw_discount,
    '{{"brand":"' || coalesce(brand, 'N/A') || '","free_shipping":' || free_shipping::VARCHAR || ',"source":' || source_id || '}}' AS raw_data FROM n""")
def raw_item_rows(v):
    return R.raw_rows(R.new_items(v.v_items, v.v_processed), _BATCH)


_CATEGORY_SQL = terms_sql("main_name", *T.RULES["category"])


@query("processed_item_rows", f"""WITH {_NEW} SELECT content_hash, external_id, title AS normalized_title, {BRAND_SQL.replace('main_name', 'title')} AS detected_brand, {_CATEGORY_SQL.replace('main_name', 'title')} AS detected_category,
    price, original_price, discount, url || '?tool=1&word=' AS affiliate_url, promotion_type, free_shipping FROM n""")
def processed_item_rows(v):
    return R.processed_rows(R.new_items(v.v_items, v.v_processed), "tool=1&word=")


_DETAILS = "d AS (SELECT 'MLB' || product_id AS external_id, name, variation_name FROM v_colors WHERE product_id % 4 <> 0)"


def _details(v):
    """Official details of three items of four: attributes and variations, nested."""
    attribute = lambda key, value: F.struct(F.lit(key).alias("id"), value.alias("value_name"))
    attributes = F.array(attribute("BRAND", F.lit("x")), attribute("COLOR", F.col("name")))
    variations = F.array(F.struct(F.array(attribute("SIZE", F.lit("40")), attribute("COLOR", F.col("variation_name"))).alias("attribute_combinations")))
    return v.v_colors.where("product_id % 4 <> 0").select(F.concat(F.lit("MLB"), F.col("product_id").cast("string")).alias("external_id"), attributes.alias("attributes"), variations.alias("variations"))


@query("items_with_details", f"WITH {_DETAILS} SELECT i.item_id, d.external_id IS NOT NULL AS detailed, d.name AS color, d.variation_name AS variation_color FROM v_items i LEFT JOIN d USING (external_id)")
def items_with_details(v):
    own = lambda xs: F.filter(xs, lambda a: a.id == "COLOR")
    colors = _details(v).select("external_id", F.get(own("attributes"), F.lit(0)).value_name.alias("color"), F.get(F.flatten(F.transform("variations", lambda x: own(x.attribute_combinations))), F.lit(0)).value_name.alias("variation_color"), F.lit(True).alias("detailed"))
    return v.v_items.join(colors, "external_id", "left").select("item_id", F.coalesce("detailed", F.lit(False)).alias("detailed"), "color", "variation_color")


@query("details_missing", f"WITH {_DETAILS} SELECT DISTINCT external_id FROM v_items WHERE external_id IS NOT NULL AND external_id NOT IN (SELECT external_id FROM d)")
def details_missing(v):
    return v.v_items.where("external_id is not null").select("external_id").distinct().join(_details(v), "external_id", "left_anti")


# The dimensions' first rows.
BRAND_SEEDS = (
    ("nike", "Nike"), ("adidas", "Adidas"), ("puma", "Puma"), ("mizuno", "Mizuno"), ("asics", "Asics"), ("olympikus", "Olympikus"), ("fila", "Fila"), ("reebok", "Reebok"),
    ("new-balance", "New Balance"), ("under-armour", "Under Armour"), ("vans", "Vans"), ("converse", "Converse"), ("outra", "Outra"),
)
CATEGORY_SEEDS = (("corrida", "Corrida"), ("futebol", "Futebol"), ("academia", "Academia"), ("casual", "Casual"), ("basquete", "Basquete"), ("caminhada", "Caminhada"), ("acessorios", "Acessórios"))


def _seeds(v, rows):
    return v.spark.createDataFrame(list(rows), "slug string, name string")


def _values(rows):
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rows) + ") s(slug, name)"


@query("seed_dimensions", f"SELECT 'brand' AS kind, slug, name FROM v_brands UNION ALL SELECT 'brand', slug, name FROM {_values(BRAND_SEEDS)} UNION ALL SELECT 'category', slug, name FROM v_categories UNION ALL SELECT 'category', slug, name FROM {_values(CATEGORY_SEEDS)}")
def seed_dimensions(v):
    brands = R.seeded(v.v_brands, _seeds(v, BRAND_SEEDS)).select(F.lit("brand").alias("kind"), "slug", "name")
    return brands.unionByName(R.seeded(v.v_categories, _seeds(v, CATEGORY_SEEDS)).select(F.lit("category").alias("kind"), "slug", "name"))


_SOME = BRAND_SEEDS[:4]


@query("resolve_brand_ids", f"""WITH b AS (SELECT DISTINCT {BRAND_SQL} AS brand FROM v_products), w AS (SELECT brand, replace(brand, ' ', '-') AS slug FROM b)
    SELECT w.slug, coalesce(s.name, array_to_string([upper(x[1]) || substring(x, 2) FOR x IN string_split(w.brand, ' ')], ' ')) AS name, s.slug IS NULL AS created FROM w LEFT JOIN {_values(_SOME)} USING (slug)""")
def resolve_brand_ids(v):
    return R.resolved_brands(v.v_products.select(T.brand_of(F.col("main_name")).alias("name")).distinct(), _seeds(v, _SOME))


_FEW = CATEGORY_SEEDS[:3]


@query("resolve_category_ids", f"WITH c AS (SELECT id, {_CATEGORY_SQL} AS slug FROM v_products) SELECT c.id, s.slug AS category FROM c LEFT JOIN {_values(_FEW)} USING (slug)")
def resolve_category_ids(v):
    found = v.v_products.select("id", T.attribute(F.col("main_name"), "category").alias("slug"))
    return found.join(_seeds(v, _FEW).select("slug", F.col("slug").alias("category")), "slug", "left").select("id", "category")


@query("triage_suggestions", f"""WITH c AS (SELECT id, {BRAND_SQL} AS brand, {_CATEGORY_SQL} AS category FROM v_products)
    SELECT c.id, b.slug AS brand_id, k.slug AS category_id FROM c LEFT JOIN {_values(BRAND_SEEDS).replace(' s(', ' b(')} ON lower(b.name) = c.brand LEFT JOIN {_values(CATEGORY_SEEDS).replace(' s(', ' k(')} ON k.slug = c.category""")
def triage_suggestions(v):
    found = v.v_products.select("id", T.brand_of(F.col("main_name")).alias("brand"), T.attribute(F.col("main_name"), "category").alias("category"))
    brands = _seeds(v, BRAND_SEEDS).select(F.lower("name").alias("brand"), F.col("slug").alias("brand_id"))
    categories = _seeds(v, CATEGORY_SEEDS).select(F.col("slug").alias("category"), F.col("slug").alias("category_id"))
    return found.join(brands, "brand", "left").join(categories, "category", "left").select("id", "brand_id", "category_id")


@query("run_counters", """WITH k AS (SELECT i.source_id, count(*) AS found, count(*) FILTER (WHERE p.content_hash IS NULL) AS created FROM v_items i LEFT JOIN (SELECT DISTINCT content_hash FROM v_processed) p USING (content_hash) GROUP BY i.source_id)
    SELECT source_id, found, created, NULL::BIGINT AS updated, greatest(0, found - created) AS ignored FROM k""")
def run_counters(v):
    known = v.v_processed.select("content_hash", F.lit(True).alias("known")).distinct()
    counted = v.v_items.join(known, "content_hash", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("known").isNull()).alias("created"))
    return counted.select("source_id", "found", "created", F.lit(None).cast("long").alias("updated"), F.greatest(F.lit(0).cast("long"), F.col("found") - F.col("created")).alias("ignored"))


@query("refresh_known_items", """WITH l AS (SELECT DISTINCT ON (content_hash) * FROM v_items ORDER BY content_hash, position DESC, item_id DESC)
    SELECT p.id, coalesce(l.promotion_type, p.promotion_type) AS promotion_type, coalesce(l.free_shipping, p.free_shipping) AS free_shipping FROM v_processed p LEFT JOIN l USING (content_hash)""")
def refresh_known_items(v):
    return R.refreshed(v.v_processed, v.v_items)


@query("refresh_known_offers", """WITH l AS (SELECT DISTINCT ON (external_id) external_id, free_shipping AS fs FROM v_items WHERE external_id IS NOT NULL AND content_hash IN (SELECT content_hash FROM v_processed) ORDER BY external_id, position DESC, item_id DESC)
    SELECT o.id, coalesce(l.fs, o.free_shipping) AS free_shipping, coalesce(l.fs, o.free_shipping) IS DISTINCT FROM o.free_shipping AS changed FROM v_offers o LEFT JOIN l USING (external_id)""")
def refresh_known_offers(v):
    return R.refreshed_offers(v.v_offers, v.v_items, v.v_processed)


_TRUSTED = ", ".join(["CASE WHEN regexp_matches(title || ' ' || coalesce(brand, ''), '\\bair\\s+jordan\\b', 'i') THEN 'jordan' END"] + [f"CASE WHEN regexp_matches(title || ' ' || coalesce(brand, ''), '\\b{b.replace(' ', chr(92) + 's+')}\\b', 'i') THEN '{b}' END" for b in T.TRUSTED_BRANDS])
_ROUTED = f"""
    t AS (SELECT * FROM v_triage WHERE status = 'rejected'),
    f AS (SELECT DISTINCT ON (content_hash) * FROM v_items i WHERE content_hash NOT IN (SELECT content_hash FROM t) AND (external_id IS NULL OR external_id NOT IN (SELECT external_id FROM t WHERE external_id IS NOT NULL)) ORDER BY content_hash, position, item_id),
    b AS (SELECT *, list_distinct([x FOR x IN [{_TRUSTED}] IF x IS NOT NULL]) AS n_brands, [x FOR x IN [{_TRUSTED}] IF x IS NOT NULL][1] AS named, {normal_sql('title')} AS plain, coalesce({normal_sql('brand')}, '') AS plain_brand FROM f),
    c AS (SELECT *, CAST(CASE WHEN len(n_brands) = 0 THEN 0.0 WHEN len(n_brands) > 1 THEN 0.3 WHEN plain_brand IN ({", ".join(repr(b) for b in T.TRUSTED_BRANDS)}) THEN 0.95 WHEN contains(plain_brand, named) THEN 0.92 WHEN starts_with(plain, named) THEN 0.9 WHEN contains(plain, named) THEN 0.82 ELSE 0.7 END AS DOUBLE) AS confidence,
          array_to_string([x FOR x IN [CASE WHEN length(trim(title)) < 10 THEN 'title_too_short' END, CASE WHEN image IS NULL THEN 'missing_image' END, CASE WHEN price <= 0 THEN 'invalid_price' END, CASE WHEN discount NOT BETWEEN 0 AND 90 THEN 'discount_out_of_range' END] IF x IS NOT NULL], ',') AS issues FROM b),
    d AS (SELECT *, CASE WHEN len(n_brands) = 0 THEN 'brand_not_in_whitelist' WHEN confidence < 0.85 THEN 'confidence_below_threshold' WHEN issues <> '' THEN 'incomplete_card' ELSE 'auto_approved' END AS decision FROM c),
    routed AS (SELECT *, decision = 'auto_approved' AND coalesce(discount, 0) >= 30 AS passes FROM d)"""


@query("publish_items", f"""WITH {_ROUTED}
    SELECT content_hash, item_id, CASE WHEN passes THEN 'published' ELSE 'pending' END AS route, decision, issues, confidence, CASE WHEN discount >= 20 THEN 1 ELSE 0 END AS priority,
           CASE WHEN passes THEN substring(replace(plain, ' ', '-'), 1, 80) || '-' || content_hash END AS slug, CASE WHEN passes THEN replace({BRAND_SQL.replace('main_name', 'title')}, ' ', '-') END AS brand_slug,
           CASE WHEN passes THEN {_CATEGORY_SQL.replace('main_name', 'title')} END AS category_slug FROM routed""")
def publish_items(v):
    return R.routed(v.v_items, v.v_triage.where("status = 'rejected'"))


_DECISIONS = "r AS (SELECT 't' || id AS id, CASE WHEN quantity % 5 < 3 THEN 'approve' ELSE 'reject' END AS action, CASE WHEN quantity % 7 = 0 THEN 'Nome Novo ' || product_id END AS name, CASE WHEN quantity % 2 = 0 THEN 'foto ruim' END AS reason FROM v_processed)"
_DECIDED = f"""{_DECISIONS}, j AS (SELECT r.*, p.id AS pid, p.promotion_type, coalesce(nullif(r.name, ''), p.normalized_title) AS full_name FROM r LEFT JOIN v_triage t ON t.id = r.id LEFT JOIN v_processed p ON p.id = t.processed_id)"""


def _decisions(v):
    q = F.col("quantity")
    return v.v_processed.select(F.concat(F.lit("t"), "id").alias("id"), F.when(q % 5 < 3, "approve").otherwise("reject").alias("action"), F.when(q % 7 == 0, F.concat(F.lit("Nome Novo "), F.col("product_id").cast("string"))).alias("name"), F.when(q % 2 == 0, "foto ruim").alias("reason"))


@query("triage_decide", f"""WITH {_DECIDED}
    SELECT id, action, pid IS NOT NULL AS found, CASE WHEN pid IS NOT NULL THEN CASE action WHEN 'approve' THEN 'approved' ELSE 'rejected' END END AS status, CASE WHEN pid IS NOT NULL AND action = 'approve' THEN full_name END AS product_name,
           CASE WHEN pid IS NOT NULL AND action = 'approve' THEN substring(replace({normal_sql('full_name')}, ' ', '-'), 1, 100) || '-' || id END AS slug,
           CASE WHEN pid IS NOT NULL AND action = 'approve' THEN CASE promotion_type WHEN 'lightning' THEN 'relampago' WHEN 'deal_of_day' THEN 'dia' WHEN 'general' THEN 'geral' END END AS section,
           CASE WHEN pid IS NOT NULL AND action = 'reject' THEN coalesce(reason, 'Rejeitado em lote') END AS reason FROM j""")
def triage_decide(v):
    return R.decided(v.v_triage, v.v_processed, _decisions(v))


@query("triage_outcome", f"WITH {_DECIDED} SELECT action, count(*) FILTER (WHERE pid IS NOT NULL) AS succeeded, count(*) FILTER (WHERE pid IS NULL) AS failed FROM j GROUP BY action")
def triage_outcome(v):
    return R.decided(v.v_triage, v.v_processed, _decisions(v)).groupBy("action").agg(F.count_if("found").alias("succeeded"), F.count_if(~F.col("found")).alias("failed"))


@query("favorites_apply", """WITH a AS (SELECT user_id, product_id + 3 AS product_id FROM v_favorites WHERE user_id % 2 = 0), ok AS (SELECT DISTINCT a.* FROM a JOIN v_products p ON p.id = a.product_id)
    SELECT user_id, product_id FROM (SELECT user_id, product_id FROM v_favorites UNION SELECT user_id, product_id FROM ok) u WHERE NOT (product_id % 11 = 0 AND user_id % 3 = 0)""")
def favorites_apply(v):
    added = v.v_favorites.where("user_id % 2 = 0").select("user_id", (F.col("product_id") + 3).alias("product_id")).join(v.v_products.select(F.col("id").alias("product_id")), "product_id", "left_semi").select("user_id", "product_id")
    removed = v.v_favorites.unionByName(added.withColumn("created_at", F.lit(None).cast("timestamp"))).where("product_id % 11 = 0 and user_id % 3 = 0").select("user_id", "product_id")
    return v.v_favorites.select("user_id", "product_id").unionByName(added).distinct().join(removed, ["user_id", "product_id"], "left_anti")


@query("subscription_state", """WITH e AS (SELECT event_id AS id, lower(trim(' U' || user_id || '@X.test ')) AS email, ts AS stamp, event_type = 'signup' AS subscribes FROM events WHERE event_type IN ('signup', 'error')),
    s AS (SELECT *, lag(subscribes) OVER (PARTITION BY email ORDER BY stamp, id) AS b FROM e), t AS (SELECT * FROM s WHERE (b IS NULL AND subscribes) OR b <> subscribes),
    l AS (SELECT DISTINCT ON (email) * FROM t ORDER BY email, stamp DESC, id DESC) SELECT email, subscribes AS is_active, CASE WHEN subscribes THEN stamp END AS since, CASE WHEN NOT subscribes THEN stamp END AS left_at FROM l""")
def subscription_state(v):
    email = F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit("@X.test "))
    events = v.events.where("event_type in ('signup', 'error')").select(F.col("event_id").alias("id"), X.email_key(email).alias("email"), F.col("ts").alias("at"), (F.col("event_type") == "signup").alias("subscribes"))
    return R.subscriptions(events)


@query("email_key", "SELECT lower(trim(' U' || (c_custkey // 2) || '@X.test ')) AS email, count(*) AS accounts FROM customer GROUP BY 1 HAVING count(*) > 1")
def email_key(v):
    email = X.email_key(F.concat(F.lit(" U"), F.floor(F.col("c_custkey") / 2).cast("string"), F.lit("@X.test ")))
    return v.customer.groupBy(email.alias("email")).agg(F.count(F.lit(1)).alias("accounts")).where("accounts > 1")


@query("source_sync", """WITH old AS (SELECT id AS old_id, url, 'old ' || name AS old_name FROM v_sources WHERE id % 3 <> 0), new AS (SELECT url, min(id) AS new_id, max(name) AS new_name FROM v_sources WHERE id % 4 <> 0 GROUP BY url)
    SELECT coalesce(n.url, o.url) AS url, o.old_id, coalesce(n.new_name, o.old_name) AS name, CASE WHEN o.url IS NULL THEN 'create' WHEN n.url IS NULL THEN 'keep' ELSE 'update' END AS action FROM old o FULL JOIN new n ON n.url = o.url""")
def source_sync(v):
    old = v.v_sources.where("id % 3 <> 0").select("url", F.col("id").alias("old_id"), F.concat(F.lit("old "), "name").alias("old_name"))
    new = v.v_sources.where("id % 4 <> 0").groupBy("url").agg(F.max("name").alias("new_name"))
    action = F.when(F.col("old_id").isNull(), "create").when(F.col("new_name").isNull(), "keep").otherwise("update")
    return old.join(new, "url", "full").select("url", "old_id", F.coalesce("new_name", "old_name").alias("name"), action.alias("action"))


@query("latest_run", "SELECT source_id, max(batch_no) AS batch_no, max_by(status, day) AS status, max_by(total_collected, day) AS total_collected FROM v_batches GROUP BY source_id")
def latest_run(v):
    last = v.v_batches.groupBy("source_id").agg(F.max_by(F.struct("batch_no", "status", "total_collected"), "day").alias("run"))
    return last.select("source_id", "run.*")


@query("sources_with_marketplace", """WITH r AS (SELECT source_id, max_by(batch_no, (finished_at, batch_no)) AS batch_no FROM (SELECT CAST(user_id % 50 AS BIGINT) AS source_id, CAST(extract(day FROM ts) AS INT) AS batch_no, max(ts) AS finished_at FROM events GROUP BY ALL) b GROUP BY source_id)
    SELECT s.id, s.name, m.slug AS marketplace, r.batch_no AS latest_batch, s.source_type = 'listing' AS supported FROM v_sources s LEFT JOIN v_marketplaces m ON m.id = s.marketplace_id LEFT JOIN r ON r.source_id = s.id""")
def sources_with_marketplace(v):
    runs = v.events.groupBy((F.col("user_id") % 50).alias("source_id"), F.dayofmonth("ts").alias("batch_no")).agg(F.max("ts").alias("finished_at"))
    latest = runs.groupBy("source_id").agg(F.max_by("batch_no", F.struct("finished_at", "batch_no")).alias("latest_batch"))
    markets = v.v_marketplaces.select(F.col("id").alias("marketplace_id"), F.col("slug").alias("marketplace"))
    return v.v_sources.join(markets, "marketplace_id", "left").join(latest, F.col("id") == F.col("source_id"), "left").select("id", "name", "marketplace", "latest_batch", F.col("source_type").isin("listing").alias("supported"))


_UNION = """u AS (SELECT title, CASE WHEN position % 5 <> 0 THEN url END AS url, price, 0 AS part, item_id FROM v_items WHERE source_id % 2 = 0 UNION ALL SELECT title, CASE WHEN position % 5 <> 0 THEN url END, price, 1, item_id FROM v_items WHERE source_id % 2 = 1)"""


def _two_sources(v):
    url = F.when(F.col("position") % 5 != 0, F.col("url")).alias("url")
    part = lambda odd: v.v_items.where(F.col("source_id") % 2 == odd).select("title", url, "price", F.lit(odd).alias("part"), "item_id")
    return part(0).unionByName(part(1))


@query("union_sources", f"WITH {_UNION} SELECT DISTINCT ON (coalesce(url, title)) coalesce(url, title) AS item_key, item_id, price, part FROM u ORDER BY coalesce(url, title), part, item_id")
def union_sources(v):
    found = R.first_rows_by(_two_sources(v), [F.coalesce("url", "title")], ["part", "item_id"])
    return found.select(F.coalesce("url", "title").alias("item_key"), "item_id", "price", "part")


@query("first_by_url", f"WITH {_UNION} SELECT DISTINCT ON (coalesce(url, title)) coalesce(url, title) AS item_key, item_id FROM u WHERE part = 0 ORDER BY coalesce(url, title), item_id")
def first_by_url(v):
    found = R.first_rows_by(_two_sources(v).where("part = 0"), [F.coalesce("url", "title")], ["item_id"])
    return found.select(F.coalesce("url", "title").alias("item_key"), "item_id")


_RESULTS = """q AS (SELECT 'r' || p.id AS id, p.main_name AS title, b.current_price AS price, b.original_price, 1 AS n, p.id AS place FROM v_products p JOIN v_best b ON b.product_id = p.id WHERE contains(lower(p.main_name), 'nike')
    UNION ALL SELECT 'r' || p.id, p.main_name, b.current_price, b.original_price, 2, p.id FROM v_products p JOIN v_best b ON b.product_id = p.id WHERE contains(lower(p.main_name), 'tênis')),
    f AS (SELECT DISTINCT ON (id) * FROM q ORDER BY id, n, place)"""


def _results(v):
    rows = v.v_products.join(v.v_best, F.col("id") == F.col("product_id")).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.col("main_name").alias("title"), F.col("current_price").alias("price"), "original_price", F.col("id").alias("place"))
    of = lambda word, n: rows.where(F.contains(F.lower("title"), F.lit(word))).withColumn("n", F.lit(n))
    return R.first_rows_by(of("nike", 1).unionByName(of("tênis", 2)), ["id"], ["n", "place"])


@query("api_search_promotions", f"WITH {_RESULTS} SELECT id, price, original_price, CAST(floor((original_price::DOUBLE - price::DOUBLE) / original_price::DOUBLE * 100 + 0.5) AS INT) AS discount, {BRAND_SQL.replace('main_name', 'title')} AS brand FROM f WHERE original_price > price")
def api_search_promotions(v):
    was, now = F.col("original_price").cast("double"), F.col("price").cast("double")
    return _results(v).where("original_price > price").select("id", "price", "original_price", F.floor((was - now) / was * 100 + 0.5).cast("int").alias("discount"), T.brand_of(F.col("title")).alias("brand"))


@query("api_featured_products", f"WITH {_RESULTS} SELECT id, title FROM f ORDER BY n, place LIMIT 12")
def api_featured_products(v):
    return _results(v).orderBy("n", "place").limit(12).select("id", "title")


@query("constraint_report", r"""SELECT row_id, rule FROM (SELECT id::VARCHAR AS row_id, unnest([CASE WHEN length(trim(name)) NOT BETWEEN 1 AND 200 THEN 'name_length' END, CASE WHEN NOT regexp_full_match(url, 'https?://[^\s]+') THEN 'url_pattern' END,
        CASE WHEN priority < 0 THEN 'priority_negative' END, CASE WHEN ends_at < starts_at THEN 'ends_before_start' END, CASE WHEN status NOT IN ('active', 'inactive', 'ended') THEN 'status_value' END,
        CASE WHEN source_type NOT IN ('promotion', 'brand', 'category', 'outlet', 'campaign', 'other') THEN 'source_type_value' END, CASE WHEN marketplace_id % 10 = 3 THEN 'unknown_marketplace' END]) AS rule FROM v_sources) x WHERE rule IS NOT NULL""")
def constraint_report(v):
    """The rules over the sources as they are; a tenth of the marketplaces is missing."""
    markets = v.v_marketplaces.where("id % 10 <> 3").select(F.col("id").alias("marketplace_id"), F.lit(True).alias("_market"))
    rows = v.v_sources.join(markets, "marketplace_id", "left").withColumn("notes", F.lit(None).cast("string"))
    return R.violations(rows, R.source_rules())


@query("stale_cutoff", "SELECT source_id, external_item_id, batch_no, seen_at < timestamp '2024-01-30 12:00:00' - to_minutes(4320) AS stale FROM v_observations")
def stale_cutoff(v):
    cutoff = F.expr("timestamp '2024-01-30 12:00:00' - make_interval(0, 0, 0, 0, 0, 4320, 0)")
    return v.v_observations.select("source_id", "external_item_id", "batch_no", (F.col("seen_at") < cutoff).alias("stale"))


@query("previous_offers_base", """WITH g AS (SELECT p.* FROM v_processed p WHERE EXISTS (SELECT 1 FROM v_triage t WHERE t.processed_id = p.id AND t.status = 'approved') OR EXISTS (SELECT 1 FROM v_triage t WHERE t.external_id = p.external_id AND t.status = 'approved'))
    SELECT m.id AS membership_id, g.id AS processed_id FROM v_memberships m JOIN g ON g.content_hash = m.content_hash WHERE NOT m.is_active""")
def previous_offers_base(v):
    from ..operators.sections import approved

    gone = v.v_memberships.where("not is_active").select(F.col("id").alias("membership_id"), "content_hash")
    return gone.join(approved(v.v_processed, v.v_triage).select("content_hash", F.col("id").alias("processed_id")), "content_hash").select("membership_id", "processed_id")


_COLOR_ROWS = f"""o AS (SELECT DISTINCT product_id, nullif(replace({normal_sql('name')}, ' ', '-'), '') AS value, name AS label, 0.5::DOUBLE AS confidence FROM v_colors WHERE length(name) < 100),
    n AS (SELECT product_id, nullif(replace({normal_sql('variation_name')}, ' ', '-'), '') AS value, variation_name AS label, (product_id % 4) * 0.4::DOUBLE AS confidence FROM v_colors WHERE length(variation_name) < 100)"""


@query("color_upsert", f"""WITH {_COLOR_ROWS}, a AS (SELECT * FROM o WHERE value IS NOT NULL), b AS (SELECT * FROM n WHERE value IS NOT NULL AND confidence BETWEEN 0 AND 1)
    SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.value, b.value) AS value, coalesce(b.label, a.label) AS label, CASE WHEN a.confidence IS NULL THEN b.confidence WHEN b.confidence IS NULL THEN a.confidence ELSE greatest(a.confidence, b.confidence) END AS confidence
    FROM a FULL JOIN b ON a.product_id = b.product_id AND a.value = b.value""")
def color_upsert(v):
    old = v.v_colors.where("length(name) < 100").select("product_id", X.slug(F.col("name")).alias("value"), F.col("name").alias("label"), F.lit(0.5).alias("confidence")).where("value is not null")
    new = v.v_colors.where("length(variation_name) < 100").select("product_id", X.slug(F.col("variation_name")).alias("value"), F.col("variation_name").alias("label"), (F.col("product_id") % 4 * F.lit(0.4)).alias("confidence"), F.lit(0).alias("at"))
    return R.upserted_colors(old, new)


@query("color_coverage", f"""WITH v AS (SELECT product_id, product_id % 4 <> 0 AS detailed, list_distinct([x FOR x IN [{normal_sql('CASE WHEN length(name) <= 120 THEN name END')}, {normal_sql('CASE WHEN length(variation_name) <= 120 THEN variation_name END')}] IF x <> '']) AS c FROM v_colors),
    k AS (SELECT *, CASE WHEN detailed THEN len(c) ELSE 0 END AS n FROM v) SELECT count(*) AS analysed, count(*) FILTER (WHERE n > 0) AS with_color, count(*) FILTER (WHERE n > 1) AS with_several, count(*) FILTER (WHERE n = 0) AS without_color, count(*) FILTER (WHERE NOT detailed) AS without_detail FROM k""")
def color_coverage(v):
    values = F.array_distinct(F.array_compact(F.array(X.slug(T.clean_color(F.col("name"))), X.slug(T.clean_color(F.col("variation_name"))))))
    detailed = F.col("product_id") % 4 != 0
    per = v.v_colors.select(detailed.alias("detailed"), F.when(detailed, F.size(values)).otherwise(0).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("analysed"), F.count_if(F.col("n") > 0).alias("with_color"), F.count_if(F.col("n") > 1).alias("with_several"), F.count_if(F.col("n") == 0).alias("without_color"), F.count_if(~F.col("detailed")).alias("without_detail"))
