"""The engine's input tables as views over the star schema.

A view is one SELECT in the SQL that Spark and DuckDB share, so that a query and its oracle read the same
rows; what differs between the two is written as a placeholder and filled in per engine. ``{name}`` in a
text stands for a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

#: Titles that products cycle through; each shows one behaviour of the title rules.
TITLES = (
    "Tênis Nike Air Zoom Feminino Corrida",
    "Tênis Adidas Masculino Running Preto",
    "Chuteira Society Puma Unissex Azul Marinho",
    "Tênis Infantil Menino Skate Vermelho",
    "Tênis Nike x Adidas Edição Colab",
    "Ultraboost Light Cinza 40 Br",
    "Tênis Court Vision Low Branco 40 Br 35 Eu",
    "Tênis Olympikus Caminhada 39.0 Br",
    "Tênis Mizuno Wave R7524100020015 Amarelo",
    "Tênis Casual Preto e Branco",
    "Off Nike White Slip On Conforto",
    "Tênis  Vôlei   Asics  Gel",
    "Meia",
    "Tênis Basquete Fila Treino Academia Masculino Cano Alto Preto Numero Um",
    "Tênis Basquete Fila Treino Academia Masculino Cano Alto Preto Numero Dois",
    "Mochila Escolar Juvenil Rosa",
    "Tênis New Balance Feminina Nude 37",
    "Tênis Under Armour Crossfit Homem Chumbo 42",
    "Tênis Marca Própria Mulher Bordô",
    "Boné Kappa Aba Curva Verde",
    "Tênis Futsal Umbro Criança Laranja 28",
    "Palmilha Gel Conforto",
    "Tênis Bebê Menina Dourado 18",
    "Tênis Reebok Training Off-white 15 49 41",
)
COLORS = ("Preto", "preta", "Azul Marinho", "off-white", "Preto/branco", "Verde-limão", "", None, "x" * 121)


def _pick(values, by: str) -> str:
    """values[by % len] as a CASE, which both engines read alike."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


def _cents(x: str) -> str:
    return f"CAST(CAST(floor(({x}) * 100 + 0.5) AS bigint) / 100.0 AS decimal(10, 2))"


def _dotted(x: str) -> str:
    """A whole number with a dot before the last three digits."""
    n = f"CAST(floor({x}) AS bigint)"
    return f"CASE WHEN {x} >= 1000 THEN CAST(CAST(floor({n} / 1000) AS bigint) AS string) || '.' || lpad(CAST({n} % 1000 AS string), 3, '0') ELSE CAST({n} AS string) END"


def _money(x: str) -> str:
    cents = f"lpad(CAST(CAST(floor({x} * 100) AS bigint) % 100 AS string), 2, '0')"
    return f"""'<span class="andes-money-amount__fraction">' || {_dotted(x)} || '</span><span class="andes-money-amount__cents">' || {cents} || '</span></span>'"""


def _part(when: str, text: str) -> str:
    return f"CASE WHEN {when} THEN {text} ELSE '' END"


_CARD = " || ".join([
    """'<div class="ui poly-card"><a class="poly-component__link" href="' || url || '#top">'""",
    _part("image IS NOT NULL", """'<img class="poly-component__picture lazy" src="' || image || '">'"""),
    """'</a><h3 class="poly-component__title"> ' || title || ' </h3>'""",
    _part("brand IS NOT NULL", """'<span class="poly-component__brand">' || brand || '</span>'"""),
    _part("promotion = 'lightning'", """'<b class="poly-component__highlight">OFERTA</b><i class="poly-highlight-countdown__text">10:00</i>'"""),
    _part("promotion = 'deal_of_day'", """'<b class="poly-component__highlight">Oferta do dia</b>'"""),
    _part("average_rating IS NOT NULL", """'<span class="poly-reviews__rating">' || replace(CAST(average_rating AS string), '.', ',') || '</span>'"""),
    f"""'<span class="poly-reviews__total">(' || {_dotted('total_reviews')} || ')</span>'""",
    _part("original_price IS NOT NULL", f"""'<s class="andes-money-amount andes-money-amount--previous">' || {_money('original_price')} || '</s>'"""),
    _part("current_price IS NOT NULL", f"""'<div class="poly-price__current"><span>' || {_money('current_price')} || '</div>'"""),
    _part("discount_percent IS NOT NULL", """'<span class="poly-price__disc_label">' || CAST(discount_percent AS string) || '% OFF</span>'"""),
    _part("free_shipping", """'<span class="polylabel">Frete <b>grátis</b></span>'"""),
    "'</div>'",
])
_CARD_VALUES = """
            SELECT s.source_id, s.page_no, CAST(p.id % 20 AS int) AS slot, p.id AS product_id, p.main_name AS title,
                   CASE WHEN p.id % 10 <> 9 THEN 'https://shop.example.test/MLB-' || CAST(p.id AS string) || '-x?y=1' ELSE 'https://shop.example.test/x?y=' || CAST(p.id % 3 AS string) END AS url,
                   CASE WHEN p.id % 10 <> 9 THEN 'MLB' || CAST(p.id AS string) END AS external_id, p.main_image_url AS image, p.brand_slug AS brand, p.average_rating, p.total_reviews,
                   CASE p.id % 3 WHEN 0 THEN 'lightning' WHEN 1 THEN 'deal_of_day' ELSE 'general' END AS promotion, b.current_price, b.original_price, b.discount_percent, b.free_shipping
            FROM {v_page_slots} s JOIN {v_products} p ON CAST(floor(p.id / 200) AS bigint) = s.source_id AND CAST(floor((p.id % 200) / 20) AS int) + 1 = s.shown_page
            LEFT JOIN {v_best} b ON b.product_id = p.id WHERE s.kind = 'cards'"""

def _json(text: str) -> str:
    """A SQL text with < and > for braces, which both engines' views keep for names."""
    return "(" + text.replace("<", "' || chr(123) || '").replace(">", "' || chr(125) || '") + ")"


_STATE_ITEM = " || ".join([
    _json("""'<"id":'"""), """coalesce('"' || external_id || '"', 'null')""", """',"title":"' || title || '","url":"' || url || '",'""", _json("""'"prices":<"id":1,"prices":<"currentPrice":"'"""),
    "coalesce(CAST(current_price AS string), '0')", """'","originalPrice":' || coalesce('"' || CAST(original_price AS string) || '"', 'null')""", """',"discountPercent":' || coalesce(CAST(discount_percent AS string), 'null')""",
    _json("""'>>,"freeShipping":'"""), "CASE WHEN free_shipping THEN 'true' ELSE 'false' END", _json("'>'"),
])

VIEWS: dict[str, str] = {
    "v_products": f"""
        SELECT p_partkey AS id, {_pick(TITLES, 'p_partkey')} || ' ' || p_name AS main_name,
               CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS brand_slug, p_type AS category_slug,
               CASE WHEN p_size % 11 <> 0 THEN CAST((p_size % 11) / 2.0 AS decimal(3, 2)) END AS average_rating,
               CAST((p_partkey * 37) % 2000 AS int) AS total_reviews,
               CASE WHEN p_partkey % 13 = 0 THEN 'draft' ELSE 'published' END AS catalog_status,
               CASE WHEN p_partkey % 19 <> 0 THEN 'https://img.example.test/' || CAST(p_partkey AS string) || '-I.jpg' END AS main_image_url,
               timestamp '2024-01-01 00:00:00' + @minutes(p_partkey) AS created_at
        FROM {{part}}""",
    "v_offers": f"""
        SELECT CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) || '-' || CAST(l_partkey AS string) || '-' || CAST(l_suppkey AS string) AS id,
               l_partkey AS product_id, l_suppkey AS marketplace_id,
               {_cents('l_extendedprice / l_quantity')} AS original_price,
               {_cents('l_extendedprice / l_quantity * (1 - l_discount)')} AS current_price,
               CASE WHEN l_discount <> 0 THEN CAST(floor(l_discount * 1000 + 0.5) AS int) END AS discount_percent,
               CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'expired' END AS status,
               l_returnflag = 'N' AS free_shipping, l_shipdate AS last_seen_at, 'MLB' || CAST(l_partkey AS string) AS external_id,
               CASE WHEN l_linenumber <> 3 THEN 'https://shop.example.test/p/' || CAST(l_partkey AS string) END AS affiliate_url
        FROM {{lineitem}}""",
    "v_marketplaces": "SELECT s_suppkey AS id, s_name AS name, lower(s_name) AS slug FROM {supplier}",
    "v_brands": "SELECT DISTINCT p_brand AS slug, p_brand AS name FROM {part}",
    "v_categories": "SELECT DISTINCT p_type AS slug, p_type AS name FROM {part}",
    "v_sources": """
        SELECT s_suppkey AS id, s_name AS name, s_suppkey AS marketplace_id, s_suppkey % 4 <> 3 AS is_active,
               CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'ended' END AS status,
               CASE WHEN s_suppkey % 11 = 0 THEN 'ftp://example.test/x' WHEN s_suppkey % 7 = 0 THEN 'no url' ELSE 'https://example.test/list?s=' || CAST(s_suppkey AS string) END AS url,
               CASE WHEN s_suppkey % 2 = 0 THEN 'listing' ELSE 'brand' END AS source_type,
               CASE WHEN s_suppkey % 5 <> 0 THEN timestamp '2024-01-01 00:00:00' + @minutes(s_suppkey * 600) END AS starts_at,
               CASE WHEN s_suppkey % 6 <> 0 THEN timestamp '2024-02-01 00:00:00' + @minutes(s_suppkey * 600) END AS ends_at,
               CAST(s_suppkey % 4 AS int) AS priority
        FROM {supplier}""",
    "v_memberships": """
        SELECT CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) || '-' || CAST(l_partkey AS string) || '-' || CAST(l_suppkey AS string) AS id,
               l_suppkey AS source_id, CASE WHEN l_linenumber <> 7 THEN 'MLB' || CAST(l_partkey AS string) END AS external_item_id,
               CAST(l_partkey AS string) || '-' || CAST(CAST(l_quantity AS int) AS string) AS content_hash,
               l_returnflag <> 'R' AS is_active, l_shipdate AS last_seen_at, p.main_name AS raw_title,
               CASE WHEN l_linenumber % 2 = 0 THEN 'https://raw.example.test/' || CAST(l_partkey AS string) ELSE '' END AS raw_url
        FROM {lineitem} JOIN {v_products} p ON p.id = l_partkey""",
    "v_processed": f"""
        SELECT CAST(l_partkey AS string) || '-' || CAST(CAST(l_quantity AS int) AS string) AS id, CAST(l_partkey AS string) || '-' || CAST(CAST(l_quantity AS int) AS string) AS content_hash,
               'MLB' || CAST(l_partkey AS string) AS external_id, l_partkey AS product_id, CAST(l_quantity AS int) AS quantity,
               CASE WHEN CAST(l_quantity AS int) % 9 = 0 THEN '' ELSE max(p.main_name) END AS normalized_title,
               min({_cents('l_extendedprice / l_quantity * (1 - l_discount)')}) AS price,
               max({_cents('l_extendedprice / l_quantity')}) AS original_price,
               max(CASE WHEN l_discount <> 0 THEN CAST(floor(l_discount * 1000 + 0.5) AS int) END) AS discount_percent,
               CASE l_partkey % 3 WHEN 0 THEN 'lightning' WHEN 1 THEN 'deal_of_day' ELSE 'general' END AS promotion_type,
               bool_or(l_returnflag = 'N') AS free_shipping, max(p.brand_slug) AS detected_brand, max(p.category_slug) AS detected_category,
               max(l_shipdate) AS processed_at
        FROM {{lineitem}} JOIN {{v_products}} p ON p.id = l_partkey GROUP BY l_partkey, CAST(l_quantity AS int)""",
    "v_triage": """
        SELECT 't' || id AS id, id AS processed_id, content_hash, external_id,
               CASE quantity % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'rejected' END AS status,
               CASE WHEN coalesce(discount_percent, 0) >= 20 THEN 1 ELSE 0 END AS priority, processed_at AS created_at
        FROM {v_processed} WHERE quantity % 4 <> 0""",
    "v_batches": """
        SELECT event_type AS source_id, CAST(ts AS date) AS day, CAST(extract(day FROM ts) AS int) AS batch_no, max(ts) AS finished_at,
               CASE WHEN CAST(extract(day FROM ts) AS int) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
               CAST(count(DISTINCT user_id) AS int) AS total_collected
        FROM {events} GROUP BY event_type, CAST(ts AS date), CAST(extract(day FROM ts) AS int)""",
    "v_observations": """
        SELECT event_type AS source_id, CAST(extract(day FROM ts) AS int) AS batch_no, user_id AS external_item_id, max(ts) AS seen_at
        FROM {events} GROUP BY event_type, CAST(extract(day FROM ts) AS int), user_id""",
    "v_favorites": """
        SELECT o_custkey AS user_id, l_partkey AS product_id, min(o_orderdate) AS created_at
        FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "v_clicks": """
        SELECT event_id AS id, user_id AS offer_key, ts AS clicked_at, CASE WHEN event_id % 4 <> 0 THEN 'https://www.example.test/p/' || CAST(user_id AS string) END AS referrer,
               CASE event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' END AS agent FROM {events} WHERE event_type = 'click'""",
    "v_searches": """
        SELECT event_id AS id, user_id AS session_id, ts AS searched_at, 'q' || CAST(@json_int(props, k) AS string) AS query, CAST(@json_int(props, k) AS int) AS k
        FROM {events} WHERE event_type = 'view'""",
    "v_best": """
        SELECT product_id, id AS offer_id, marketplace_id, original_price, current_price, discount_percent, free_shipping, last_seen_at
        FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY discount_percent DESC NULLS LAST, current_price ASC NULLS LAST, id) AS rn
              FROM {v_offers} WHERE status = 'active') x WHERE rn = 1""",
    "v_catalog": """
        SELECT p.id, p.main_name, p.brand_slug, p.category_slug, p.average_rating, p.total_reviews, p.main_image_url, p.created_at,
               b.offer_id, b.marketplace_id, b.original_price, b.current_price, b.discount_percent, b.free_shipping
        FROM {v_products} p LEFT JOIN {v_best} b ON b.product_id = p.id WHERE p.catalog_status = 'published'""",
    "v_cohorts": """
        SELECT CAST(floor(p.id / 3) AS bigint) AS cohort_id, p.id AS product_id, p.main_name, p.average_rating, p.total_reviews,
               b.current_price, b.original_price, b.discount_percent, b.free_shipping
        FROM {v_products} p LEFT JOIN {v_best} b ON b.product_id = p.id""",
    # Listing pages: slots of twenty products; some pages repeat the one before, some have no cards, some no next link.
    "v_page_slots": """
        SELECT source_id, page_no, CASE WHEN (source_id + page_no) % 9 = 8 AND page_no > 1 THEN page_no - 1 ELSE page_no END AS shown_page,
               CASE WHEN (source_id * 3 + page_no) % 13 = 12 THEN 'empty' WHEN (source_id * 3 + page_no) % 13 = 11 THEN 'odd' ELSE 'cards' END AS kind,
               (source_id + page_no * 3) % 17 <> 0 AND page_no < 10 AS has_next
        FROM (SELECT DISTINCT CAST(floor(id / 200) AS bigint) AS source_id, CAST(floor((id % 200) / 20) AS int) + 1 AS page_no FROM {v_products}) q""",
    # A product in slot 5 stands on its page twice.
    "v_cards": f"""
        SELECT c.*, CAST(row_number() OVER (PARTITION BY source_id, page_no ORDER BY again, slot) - 1 AS int) AS position
        FROM (SELECT x.*, 0 AS again FROM ({_CARD_VALUES}) x UNION ALL SELECT y.*, 1 AS again FROM ({_CARD_VALUES}) y WHERE slot = 5) c""",
    "v_listing_pages": f"""
        SELECT s.source_id, s.page_no,
               '<html><main>' || CASE s.kind WHEN 'empty' THEN '<p>Não encontramos produtos aqui</p>' WHEN 'odd' THEN '<p>outra coisa</p>' ELSE coalesce(k.cards, '') END
               || CASE WHEN s.has_next THEN '<nav class="andes-pagination"><a class="andes-pagination__link" href="/list?page=' || CAST(s.page_no + 1 AS string) || '">Seguinte</a></nav>' ELSE '<nav class="andes-pagination"></nav>' END
               || CASE WHEN (s.source_id + s.page_no) % 11 <> 3 THEN '<!--' || repeat('x', 5000) || '-->' ELSE '' END || '</main></html>' AS html
        FROM {{v_page_slots}} s LEFT JOIN (SELECT source_id, page_no, @joined(card, position) AS cards FROM (SELECT source_id, page_no, position, {_CARD} AS card FROM {{v_cards}}) r GROUP BY source_id, page_no) k
          ON k.source_id = s.source_id AND k.page_no = s.page_no""",
    # One collection run: offers seen again, half of them at a price that is new.
    "v_items": f"""
        SELECT CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) || '-' || CAST(l_partkey AS string) || '-' || CAST(l_suppkey AS string) AS item_id, l_suppkey AS source_id,
               CASE WHEN l_linenumber <> 7 THEN 'MLB' || CAST(l_partkey AS string) END AS external_id, l_partkey AS product_id, p.main_name AS title, p.brand_slug AS brand, p.main_image_url AS image,
               CAST(l_partkey AS string) || '-' || CAST(CAST(l_quantity AS int) + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 50 END AS string) AS content_hash,
               {_cents('l_extendedprice / l_quantity * (1 - l_discount)')} AS price, {_cents('l_extendedprice / l_quantity')} AS original_price,
               CASE WHEN l_discount <> 0 THEN CAST(floor(l_discount * 1000 + 0.5) AS int) END AS discount, l_returnflag = 'N' AS free_shipping,
               CASE WHEN l_linenumber % 3 = 0 THEN 'lightning' ELSE 'general' END AS promotion_type, 'https://shop.example.test/p/' || CAST(l_partkey AS string) AS url, l_orderkey AS position
        FROM {{lineitem}} JOIN {{v_products}} p ON p.id = l_partkey WHERE l_linestatus = 'O'""",
    # The same items, half of them under a title that starts with a brand.
    "v_fresh_items": """
        SELECT item_id, source_id, external_id, product_id, CASE product_id % 4 WHEN 0 THEN 'Nike Revolution ' || CAST(product_id AS string) WHEN 1 THEN 'Olympikus Corre ' || CAST(product_id AS string) ELSE title END AS title,
               CASE product_id % 4 WHEN 0 THEN 'Nike' WHEN 1 THEN 'Olympikus' ELSE brand END AS brand, image, content_hash, price, original_price, discount, free_shipping, promotion_type, url, position
        FROM {v_items}""",
    # These over three runs; most come in one of them, so that others miss them.
    "v_run_items": """
        SELECT item_id, source_id, external_id, title, brand, image, content_hash, CASE WHEN position % 41 <> 0 THEN price END AS price, original_price, discount, free_shipping, promotion_type, url, position, CAST(position % 3 AS int) + 1 AS run_no
        FROM {v_fresh_items}""",
    "v_members": """
        SELECT id, source_id, external_item_id, content_hash, raw_title, is_active, CASE WHEN source_id % 6 <> 0 THEN 'b1' END AS last_batch, CAST(length(content_hash) % 2 AS int) AS missed FROM {v_memberships}""",
    # Brand stores: an embedded state, cards of one kind of markup, or a broken state and cards of another kind.
    "v_store_pages": f"""
        SELECT source_id, page_no, CASE page_no % 3
                 WHEN 0 THEN 'window.__PRELOADED_STATE__ = ' || {_json(''''<"searchState":<"itemsResponse":<"results":[''' + "'")} || @listed(record, position) || {_json("']>>>;'")}
                 WHEN 1 THEN @joined(grid, position) ELSE 'window.__PRELOADED_STATE__ = ' || {_json("'<oops>;'")} || @joined(item, position) END AS html
        FROM (SELECT source_id, page_no, position, replace({_CARD}, '<div class="ui poly-card">', '<div class="poly-card--grid-card">') AS grid,
                     replace(replace({_CARD}, '<div class="ui poly-card">', '<li class="ui-search-layout__item">'), 'poly-component__title"', 'ui-search-result__title"') AS item, {_STATE_ITEM} AS record
              FROM {{v_cards}}) r GROUP BY source_id, page_no""",
    "v_colors": f"SELECT p_partkey AS product_id, {_pick(COLORS, 'p_partkey')} AS name, {_pick(COLORS, '(p_partkey + 2)')} AS variation_name FROM {{part}}",
}

_MACROS = {
    "spark": {"listed": lambda x, order: f"array_join(transform(array_sort(collect_list(struct({order}, {x}))), z -> z.{x}), ',')", "joined": lambda x, order: f"array_join(transform(array_sort(collect_list(struct({order}, {x}))), z -> z.{x}), '')", "minutes": lambda x: f"make_interval(0, 0, 0, 0, 0, CAST({x} AS int), 0)", "json_int": lambda c, k: f"CAST(get_json_object({c}, '$.{k}') AS bigint)"},
    "duckdb": {"listed": lambda x, order: f"string_agg({x}, ',' ORDER BY {order})", "joined": lambda x, order: f"string_agg({x}, '' ORDER BY {order})", "minutes": lambda x: f"to_minutes(CAST({x} AS int))", "json_int": lambda c, k: f"CAST(json_extract_string({c}, '$.{k}') AS bigint)"},
}


def _expand(text: str, engine: str) -> str:
    def one(m: re.Match) -> str:
        return _MACROS[engine][m[1]](*[x.strip() for x in m[2].split(",")])

    return re.sub(r"@(\w+)\(([^()]*)\)", one, text)


def _needs(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


class Views:
    """Lazily built DataFrames: ``views.v_offers``, ``views.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not (name in VIEWS or name in BASE):
            raise AttributeError(name)
        if name not in self._built:
            if name in BASE:
                self._built[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                text = VIEWS[name]
                self._built[name] = self.spark.sql(_expand(text, "spark"), **{n: getattr(self, n) for n in dict.fromkeys(_needs(text))})
        return self._built[name]


def oracle(body: str) -> str:
    """A DuckDB statement: the views that the body names, as common table expressions, and the body."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name) if name not in order else None

    visit(body)
    body = body.strip()
    parts = [f"{n} AS ({_expand(re.sub(r'[{}]', '', VIEWS[n]), 'duckdb').strip()})" for n in order]
    if body[:5].upper() == "WITH ":
        body, parts = body[5:], [*parts]
        return _expand("WITH " + ",\n".join([*parts, body]), "duckdb")
    return _expand(("WITH " + ",\n".join(parts) + "\n" if parts else "") + body, "duckdb")
