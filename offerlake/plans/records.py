"""Queries of whole records: log rows, nested products, merged payloads, masked rows, source states, facet orders, rule reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.offers import DISCOUNTS, RATINGS
from ..functions.text import search_text
from ..operators import catalog as C
from ..operators import facets as A
from ..operators import records as K
from ..operators import runs as R
from ..registry import query
from .facets import _BASE, _faceted
from .attributes import LABEL_SQL, RATINGS_SQL, normal_sql

_CLICKS = "c AS (SELECT k.id, b.offer_id, k.referrer, k.agent, k.clicked_at FROM v_clicks k JOIN v_best b ON b.product_id = k.offer_key)"


@query("click_log_rows", f"WITH {_CLICKS} SELECT c.id, c.offer_id, o.product_id, c.referrer AS source_page_url, c.agent AS user_agent, NULL::VARCHAR AS ip_hash, c.clicked_at FROM c JOIN v_offers o ON o.id = c.offer_id WHERE o.affiliate_url <> ''")
def click_log_rows(v):
    """Half the log is there; all clicks are appended, and none is there twice."""
    best = C.best_offers(v.v_offers).select(F.col("product_id").alias("offer_key"), "offer_id")
    rows = K.click_rows(v.v_clicks.join(best, "offer_key"), v.v_offers)
    return K.appended(rows.where("id % 2 = 0"), rows, "id")


_WORDS = ("nike", "tênis", "meia", "corrida")


@query("search_log_rows", f"""WITH s AS (SELECT id, session_id, searched_at, CASE k % 4 {' '.join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS))} END AS query, k FROM v_searches),
    n AS (SELECT w.query, (SELECT count(*) FROM v_catalog WHERE contains(lower(main_name), w.query)) AS n FROM (VALUES {', '.join(f"('{w}')" for w in _WORDS)}) w(query)),
    f AS (SELECT s.id, first(c.offer_key ORDER BY c.clicked_at, c.id) AS clicked FROM s JOIN v_clicks c ON c.offer_key = s.session_id AND c.clicked_at >= s.searched_at AND c.clicked_at < s.searched_at + INTERVAL 6 HOUR GROUP BY s.id)
    SELECT s.id, s.query, CASE WHEN s.k % 5 = 0 THEN '{{"frete":["Sim"]}}' END AS filters, n.n AS results_count, s.session_id, f.clicked AS clicked_product_id, s.searched_at FROM s JOIN n ON n.query = s.query LEFT JOIN f ON f.id = s.id""")
def search_log_rows(v):
    """What was searched, with how many results, and the product that the session clicked first within six hours."""
    query = F.get(F.array(*map(F.lit, _WORDS)), F.col("k") % 4)
    searches = v.v_searches.select("id", "session_id", "searched_at", query.alias("query"), F.when(F.col("k") % 5 == 0, '{"frete":["Sim"]}').alias("filters"))
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("main_name"), F.lit(w)), w) for w in _WORDS]))
    counts = v.v_catalog.select(F.explode(found).alias("query")).groupBy("query").agg(F.count(F.lit(1)).alias("results_count"))
    clicks = v.v_clicks.select(F.col("offer_key").alias("session_id"), "clicked_at", F.col("id").alias("click_id"))
    # A session's searches and clicks meet in six-hour bins: each click goes to its own bin and the one before.
    width = 6 * 3600
    bin_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width * 1_000_000))
    near = clicks.withColumn("bin", F.explode(F.array(bin_of("clicked_at"), bin_of("clicked_at") - 1)))
    met = searches.withColumn("bin", bin_of("searched_at")).join(near, ["session_id", "bin"]).where("clicked_at >= searched_at and clicked_at < searched_at + interval 6 hours")
    first = met.groupBy("id").agg(F.min_by("session_id", F.struct("clicked_at", "click_id")).alias("clicked_product_id"))
    joined = searches.join(F.broadcast(counts), "query", "left").join(first, "id", "left")
    return joined.select("id", "query", "filters", F.coalesce("results_count", F.lit(0).cast("long")).alias("results_count"), "session_id", "clicked_product_id", "searched_at")


_IMAGES = "i AS (SELECT product_id, 'https://img.example.test/' || CAST(marketplace_id AS VARCHAR) AS url, marketplace_id % 5 AS sort_order, marketplace_id % 7 = 3 AS is_primary FROM (SELECT DISTINCT product_id, marketplace_id FROM v_offers) d)"


@query("product_documents", f"""WITH {_IMAGES}, m AS (SELECT product_id, count(*) AS n_images, first(url ORDER BY NOT is_primary, sort_order, url) AS first_image, bool_or(is_primary) AS has_primary FROM i GROUP BY product_id),
    o AS (SELECT product_id, string_agg(id || '=' || current_price, '|' ORDER BY last_seen_at DESC, id) AS offers FROM v_offers WHERE status = 'active' GROUP BY product_id)
    SELECT p.id, p.brand_slug || '-' || p.id AS slug, p.main_name, coalesce(m.n_images, 0)::INT AS n_images, m.first_image, m.has_primary, o.offers FROM v_products p LEFT JOIN m ON m.product_id = p.id LEFT JOIN o ON o.product_id = p.id""")
def product_documents(v):
    images = v.v_offers.select("product_id", "marketplace_id").distinct().select("product_id", F.concat(F.lit("https://img.example.test/"), F.col("marketplace_id").cast("string")).alias("url"), (F.col("marketplace_id") % 5).alias("sort_order"), (F.col("marketplace_id") % 7 == 3).alias("is_primary"), F.lit(None).cast("string").alias("alt"))
    products = v.v_products.select("id", F.concat("brand_slug", F.lit("-"), F.col("id").cast("string")).alias("slug"), "main_name")
    docs = K.product_documents(products, v.v_offers, images)
    shown = F.array_join(F.transform("offers", lambda o: F.concat(o.id, F.lit("="), o.current_price.cast("string"))), "|")
    return docs.select("id", "slug", "main_name", F.coalesce(F.size("images"), F.lit(0)).alias("n_images"), F.get("images", F.lit(0)).url.alias("first_image"), F.exists("images", lambda x: x.is_primary).alias("has_primary"), shown.alias("offers"))


_PAYLOAD = """CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'broken ' || id WHEN 2 THEN '[1,2]' ELSE '{"id":' || id || ',"note":"' || id || '","nested":{"a":[1,2,{"b":null}]},"marketplace_colors":["old"],"flag":true}' END"""


@query("refresh_raw_colors", f"""WITH p AS (SELECT p.id, {_PAYLOAD} AS raw, c.name FROM v_products p JOIN v_colors c ON c.product_id = p.id WHERE c.name <> '' AND length(c.name) < 100),
    k AS (SELECT id, CASE WHEN id % 6 > 2 THEN raw END AS raw, name FROM p)
    SELECT id, '["' || name || '"]' AS colors, CASE WHEN id % 2 = 0 THEN '{{"source":"api"}}' ELSE 'null' END AS audit, json_extract_string(raw, '$.note') AS note, raw IS NOT NULL AS kept, CASE WHEN raw IS NOT NULL THEN '{{"a":[1,2,{{"b":null}}]}}' END AS nested,
           CASE WHEN raw IS NOT NULL THEN 6 ELSE 2 END AS n_keys FROM k""")
def refresh_raw_colors(v):
    """Raw payloads with the colours that a run brought; what else they hold stays as it was."""
    colors = v.v_colors.where("name <> '' and length(name) < 100").select("product_id", "name")
    rows = v.v_products.withColumn("raw", F.expr(_PAYLOAD)).join(colors, F.col("id") == F.col("product_id"))
    audit = F.when(F.col("id") % 2 == 0, '{"source":"api"}')
    merged = rows.select("id", K.with_keys(F.col("raw"), {K.COLOR_KEYS[0]: F.to_json(F.array("name")), K.COLOR_KEYS[1]: audit}).alias("raw"))
    held = F.from_json("raw", "map<string,variant>")
    text = lambda k: F.to_json(F.try_element_at("held", F.lit(k)))
    note = F.try_variant_get(F.try_element_at("held", F.lit("note")), "$", "string")
    return merged.withColumn("held", held).select("id", text(K.COLOR_KEYS[0]).alias("colors"), text(K.COLOR_KEYS[1]).alias("audit"), note.alias("note"), F.map_contains_key("held", "id").alias("kept"), text("nested").alias("nested"), F.size("held").alias("n_keys"))


@query("demo_cards", "SELECT id, product_id, current_price, NULL::VARCHAR AS affiliate_url, NULL::TIMESTAMP AS last_seen_at, NULL::VARCHAR AS seller_name, NULL::VARCHAR AS marketplace_name, 'Loja demonstrativa' AS store_label, true AS demonstrative FROM v_offers")
def demo_cards(v):
    names = v.v_marketplaces.select(F.col("id").alias("marketplace_id"), F.col("name").alias("marketplace_name"), F.concat(F.lit("vendedor "), "slug").alias("seller_name"))
    rows = v.v_offers.join(names, "marketplace_id", "left").select("id", "product_id", "current_price", "affiliate_url", "last_seen_at", "seller_name", "marketplace_name")
    return K.masked(rows)


_RUNS = "r AS (SELECT CAST(user_id % 50 AS BIGINT) AS source_id, CAST(extract(day FROM ts) AS INT) AS batch_id, max(ts) AS finished_at, CAST(count(*) AS INT) AS total_collected, CASE WHEN count(*) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY ALL)"


@query("source_states", f"""WITH {_RUNS}, l AS (SELECT DISTINCT ON (source_id) * FROM r ORDER BY source_id, finished_at DESC, batch_id DESC),
    m AS (SELECT source_id, count(*) AS total, count(*) FILTER (WHERE is_active) AS active FROM v_memberships GROUP BY source_id)
    SELECT s.id, s.name, s.is_active, l.batch_id, l.status, l.total_collected, l.finished_at, coalesce(m.total, 0) AS total, coalesce(m.active, 0) AS active, coalesce(m.total - m.active, 0) AS inactive FROM v_sources s LEFT JOIN l ON l.source_id = s.id LEFT JOIN m ON m.source_id = s.id""")
def source_states(v):
    runs = v.events.groupBy((F.col("user_id") % 50).alias("source_id"), F.dayofmonth("ts").alias("batch_id")).agg(F.max("ts").alias("finished_at"), F.count(F.lit(1)).cast("int").alias("total_collected"))
    runs = runs.withColumn("status", F.when(F.col("total_collected") % 7 == 0, "failed").otherwise("completed"))
    found = K.last_batches(v.v_sources.select("id", "name", "is_active"), runs, v.v_memberships.select("source_id", F.col("is_active")))
    return found.select("id", "name", "is_active", *[F.col(f"last_batch.{c}").alias(c) for c in ("batch_id", "status", "total_collected", "finished_at")], "total", "active", "inactive")


# Labels past Z, by the places of a brand's products.
@query("group_labels", """WITH n AS (SELECT id, brand_slug, row_number() OVER (PARTITION BY brand_slug ORDER BY id) - 1 AS n FROM v_products WHERE brand_slug IS NOT NULL)
    SELECT id, 'Produto ' || CASE WHEN n < 26 THEN chr(CAST(65 + n AS INT)) WHEN n < 702 THEN chr(CAST(65 + (n - 26) // 26 AS INT)) || chr(CAST(65 + (n - 26) % 26 AS INT))
        ELSE chr(CAST(65 + (n - 702) // 676 AS INT)) || chr(CAST(65 + (n - 702) // 26 % 26 AS INT)) || chr(CAST(65 + (n - 702) % 26 AS INT)) END AS label FROM n""")
def group_labels(v):
    place = F.row_number().over(Window.partitionBy("brand_slug").orderBy("id"))
    return v.v_products.where("brand_slug is not null").select("id", F.concat(F.lit("Produto "), K.place_letters(place)).alias("label"))


# Orders of labels that are no counts.
FIXED_ORDERS = {"genero": ("Masculino", "Feminino", "Unissex"), "idade": ("Adulto", "Infantil"), "tipo": ("Calçados", "Acessórios"), "desconto": tuple(x[0] for x in DISCOUNTS), "frete": ("Sim", "Não"), "avaliacao": tuple(x[0] for x in RATINGS)}
_FIXED_PLACE = "CASE " + " ".join(f"WHEN dimension = '{d}' AND value = '{x}' THEN {i}" for d, values in FIXED_ORDERS.items() for i, x in enumerate(values)) + " END"
_LABELS = f"lab AS (SELECT replace({normal_sql('label')}, ' ', '-') AS cor_value, min(label) AS cor_label FROM (SELECT CASE WHEN trim(name) <> '' THEN {LABEL_SQL} END AS label FROM v_colors) y WHERE label IS NOT NULL GROUP BY 1)"


@query("facet_places", f"""WITH {_BASE}, {_LABELS}, c AS (
      {' UNION ALL '.join(f"SELECT '{d}' AS dimension, value, count(*) AS n FROM (SELECT {'unnest(' + RATINGS_SQL + ')' if d == 'avaliacao' else d} AS value FROM f) q WHERE value IS NOT NULL GROUP BY value" for d in A.DIMENSIONS)}),
    z AS (SELECT dimension, value, sum(n)::BIGINT AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM (VALUES {', '.join(f"('{d}', '{x}', 0)" for d in A.FIXED for x in A.FIXED[d])}) w(dimension, value, n)) y GROUP BY ALL),
    p AS (SELECT z.*, coalesce(lab.cor_label, value) AS label, {_FIXED_PLACE} AS fixed FROM z LEFT JOIN lab ON z.dimension = 'cor' AND lab.cor_value = z.value)
    SELECT dimension, label, n, row_number() OVER (PARTITION BY dimension ORDER BY fixed, CASE WHEN dimension = 'tamanho' THEN CAST(value AS DOUBLE) END, CASE WHEN dimension <> 'tamanho' THEN -n END, lower(strip_accents(label)), value) AS place FROM p""")
def facet_places(v):
    labels = v.v_colors.select(F.col("name").alias("name"))
    return A.with_places(A.facet_counts(_faceted(v)), A.color_labels(labels), FIXED_ORDERS).select("dimension", "label", "n", "place")


_BRANDS = ("Nike", "NIKE ", "Olímpikus", "Olympikus", "Fila", "Ásics", "Puma", "adidas", "Adidas")
_BRAND_COUNTS = f"n AS (SELECT CASE id % 11 {' '.join(f'WHEN {i} THEN {b!r}' for i, b in enumerate(_BRANDS))} ELSE brand_slug END AS label, count(*) AS n FROM v_catalog GROUP BY 1), k AS (SELECT *, replace(trim(lower(strip_accents(label))), 'olimpikus', 'olympikus') AS key FROM n WHERE label IS NOT NULL)"


@query("brand_search", f"""WITH {_BRAND_COUNTS}, w AS (SELECT * FROM (VALUES ('Nike', 'nike', 0), ('Adidas', 'adidas', 1), ('Olympikus', 'olympikus', 2)) p(name, key, pin)),
    m AS (SELECT w.pin, coalesce(first(k.label ORDER BY k.n DESC, k.label), any_value(w.name)) AS label, coalesce(max(k.n), 0) AS n FROM w LEFT JOIN k ON k.key = w.key GROUP BY w.pin)
    SELECT label, n, pin FROM m WHERE contains(trim(lower(strip_accents(label))), 'i') UNION ALL SELECT label, n, NULL FROM k WHERE key NOT IN (SELECT key FROM w) AND contains(trim(lower(strip_accents(label))), 'i')""")
def brand_search(v):
    """Brands whose names hold a search, the pinned ones first; one is known under a misspelling too."""
    label = F.coalesce(F.get(F.array(*map(F.lit, _BRANDS)), (F.col("id") % 11).cast("int")), F.col("brand_slug"))
    counts = v.v_catalog.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return A.pinned(counts, ("Nike", "Adidas", "Olympikus"), {"olimpikus": "olympikus"}, "I").select("label", "n", "pin")


_RULES = r"""u AS (SELECT id, CASE WHEN id % 8 = 1 THEN '' WHEN id % 8 = 2 THEN repeat('n', 201) ELSE name END AS name, CASE WHEN id % 9 = 4 THEN 'https://a b.test' ELSE url END AS url, CASE WHEN id % 10 = 5 THEN -1 ELSE priority END AS priority,
        starts_at, CASE WHEN id % 7 = 3 THEN timestamp '2023-01-01 00:00:00' ELSE ends_at END AS ends_at, CASE WHEN id % 6 = 1 THEN repeat('x', 5001) END AS notes, CASE WHEN id % 5 = 2 THEN 'paused' ELSE status END AS status, CASE WHEN id % 12 = 7 THEN 'shop' ELSE 'promotion' END AS source_type,
        CASE WHEN id % 10 = 3 THEN -marketplace_id ELSE marketplace_id END AS marketplace_id FROM v_sources)"""


@query("source_rule_report", rf"""WITH {_RULES}
    SELECT id::VARCHAR AS row_id, rule FROM (SELECT id, unnest([CASE WHEN length(trim(name)) NOT BETWEEN 1 AND 200 THEN 'name_length' END, CASE WHEN NOT regexp_full_match(url, 'https?://[^\s]+') THEN 'url_pattern' END, CASE WHEN priority < 0 THEN 'priority_negative' END,
        CASE WHEN ends_at < starts_at THEN 'ends_before_start' END, CASE WHEN length(trim(notes)) > 5000 THEN 'notes_length' END, CASE WHEN status NOT IN ('active', 'inactive', 'ended') THEN 'status_value' END,
        CASE WHEN source_type NOT IN ('promotion', 'brand', 'category', 'outlet', 'campaign', 'other') THEN 'source_type_value' END, CASE WHEN NOT EXISTS (SELECT 1 FROM v_marketplaces m WHERE m.id = u.marketplace_id) THEN 'unknown_marketplace' END]) AS rule FROM u) x WHERE rule IS NOT NULL
    UNION ALL SELECT product_id::VARCHAR, 'confidence_range' FROM v_colors WHERE (product_id % 7) * 0.25 - 0.25 NOT BETWEEN 0 AND 1""")
def source_rule_report(v):
    """Rows made to break each rule, against the rules themselves."""
    i = F.col("id")
    rows = v.v_sources.select(
        "id", F.when(i % 8 == 1, "").when(i % 8 == 2, F.lit("n" * 201)).otherwise(F.col("name")).alias("name"), F.when(i % 9 == 4, "https://a b.test").otherwise(F.col("url")).alias("url"), F.when(i % 10 == 5, -1).otherwise(F.col("priority")).alias("priority"), "starts_at",
        F.when(i % 7 == 3, F.expr("timestamp_ntz '2023-01-01 00:00:00'")).otherwise(F.col("ends_at").cast("timestamp_ntz")).alias("ends_at"), F.when(i % 6 == 1, F.lit("x" * 5001)).alias("notes"), F.when(i % 5 == 2, "paused").otherwise(F.col("status")).alias("status"),
        F.when(i % 12 == 7, "shop").otherwise("promotion").alias("source_type"), F.when(i % 10 == 3, -F.col("marketplace_id")).otherwise(F.col("marketplace_id")).alias("marketplace_id"),
    )
    rows = rows.join(v.v_marketplaces.select(F.col("id").alias("marketplace_id"), F.lit(True).alias("_market")), "marketplace_id", "left")
    colors = v.v_colors.select("product_id", ((F.col("product_id") % 7) * F.lit(0.25) - F.lit(0.25)).alias("confidence"))
    return R.violations(rows, R.source_rules()).unionByName(R.violations(colors, {"confidence_range": F.col("confidence").between(0, 1)}, "product_id"))


@query("price_labels_localized", """SELECT id, CASE WHEN p IS NULL THEN '-' ELSE 'R$ ' || (CASE WHEN length(w) > 3 THEN substring(w, 1, length(w) - 3) || '.' || substring(w, length(w) - 2, 3) ELSE w END) || ',' || c END AS label
    FROM (SELECT id, p, CAST(CAST(floor(p) AS BIGINT) AS VARCHAR) AS w, lpad(CAST(CAST(floor(p * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS c FROM (SELECT id, CASE WHEN id % 9 <> 0 THEN current_price END AS p FROM v_catalog) q) r""")
def price_labels_localized(v):
    price = F.when(F.col("id") % 9 != 0, F.col("current_price"))
    return v.v_catalog.select("id", C.localized_brl(price).alias("label"))
