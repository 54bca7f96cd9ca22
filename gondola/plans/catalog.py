"""Catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import freshness as fr
from ..functions import promo
from ..functions.text import slugify
from ..operators import catalog as op
from ..operators.catalog import ProductFilters
from ..sources.derive import NOW, N_MARKETS, Tables, ean_of
from .registry import query

SITE = "https://shop.example.com"


def entries(t: Tables) -> DataFrame:
    return op.price_entries(t.supermarket_products, t.supermarkets, NOW)


def promoted(t: Tables) -> DataFrame:
    active = op.active_promotions(t.promotions, NOW)
    best = op.best_promotion(entries(t), active, t.promotion_products)
    return op.with_price_movement(best, op.previous_prices(t.observations))


def categories(t: Tables) -> DataFrame:
    """Region, nation and supplier names as a three-level tree."""
    def level(df, key, name, base, parent):
        return df.select(
            (F.col(key) + base).cast("bigint").alias("id"), F.col(name).alias("name"),
            slugify(F.col(name)).alias("slug"), parent.cast("bigint").alias("parent_id"))
    return (
        level(t.raw("region"), "r_regionkey", "r_name", 0, F.lit(None))
        .unionByName(level(t.raw("nation"), "n_nationkey", "n_name", 100, F.col("n_regionkey")))
        .unionByName(level(t.raw("supplier"), "s_suppkey", "s_name", 1000, F.col("s_nationkey") + 100))
    )


def shelved_products(t: Tables) -> DataFrame:
    k = F.col("partkey")
    return t.products.withColumn("category", F.when(k % 17 == 0, None).when(
        k % 2 == 0, F.concat(F.lit("NATION_"), (k % 25).cast("string"))).otherwise(
        F.concat(F.lit("Supplier#"), F.lpad((k % 10).cast("string"), 9, "0"))))


_CATEGORIES_SQL = """
cats AS (
  SELECT r_regionkey::bigint AS id, r_name AS name, NULL::bigint AS parent_id FROM region
  UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation
  UNION ALL SELECT s_suppkey + 1000, s_name, s_nationkey + 100 FROM supplier),
categories AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM cats),
shelved AS (SELECT ean, CASE WHEN partkey % 17 = 0 THEN NULL WHEN partkey % 2 = 0 THEN 'NATION_' || (partkey % 25)
  ELSE 'Supplier#' || lpad((partkey % 10)::varchar, 9, '0') END AS category FROM products),
counts AS (SELECT trim(regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g'), '-') AS slug, min(category) AS name,
  count(*) AS product_count FROM shelved WHERE category IS NOT NULL GROUP BY 1)"""

SUMMARY_SQL = """
comparable AS (SELECT * FROM entries WHERE is_available),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product_ean ORDER BY CASE status WHEN 'fresh' THEN 0 ELSE 1 END,
    price, last_checked_at DESC, id) AS rn,
    CASE WHEN list_price > price AND list_price > 0
         THEN (list_price::double - price::double) / list_price::double * 100 END AS pct FROM comparable),
summary AS (SELECT product_ean AS ean, min(price)::double AS min_price, max(price)::double AS max_price,
    min(price) FILTER (status = 'fresh')::double AS fresh_min_price,
    max(CASE WHEN rn = 1 THEN price END)::double AS display_price,
    max(CASE WHEN rn = 1 THEN last_checked_at END) AS display_checked_at,
    max(CASE WHEN rn = 1 THEN status END) AS rank_status,
    max(pct) FILTER (status = 'fresh') AS discount_percent, bool_or(status = 'fresh') AS has_fresh,
    count(*) FILTER (status = 'stale') AS stale_count, count(*) AS price_count, max(last_checked_at) AS latest_checked_at
  FROM ranked GROUP BY 1)"""

PROMOTED_SQL = f"""
active AS (SELECT * FROM promotions WHERE is_active AND (start_date IS NULL OR start_date <= TIMESTAMP '{NOW}')
    AND (end_date IS NULL OR end_date >= TIMESTAMP '{NOW}')),
store_wide AS (SELECT * FROM active WHERE id NOT IN (SELECT promotion_id FROM promotion_products)),
pairs AS (
  SELECT e.id AS entry_id, e.price, p.* FROM entries e JOIN store_wide p ON p.supermarket_id = e.supermarket_id
  UNION ALL
  SELECT e.id, e.price, p.* FROM active p JOIN promotion_products b ON b.promotion_id = p.id
    JOIN entries e ON e.supermarket_id = p.supermarket_id AND e.product_ean = b.product_ean),
finals AS (SELECT *, CASE WHEN price <= 0 THEN NULL WHEN type = '2x1' THEN floor(price::double/2*100+0.5)/100
    WHEN type = '2nd_50' THEN floor(price::double*0.75::double*100+0.5)/100
    WHEN discount_value > 0 AND discount_value <= 100 THEN floor(price::double*(1-discount_value/100)*100+0.5)/100 END AS final_price
  FROM pairs),
best AS (SELECT * FROM finals WHERE final_price < price::double
  QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY final_price, discount_value DESC NULLS FIRST, title, id) = 1),
hist AS (SELECT supermarket_product_id AS sid, price, row_number() OVER (PARTITION BY supermarket_product_id
    ORDER BY scraped_at DESC, orderkey DESC, linenumber DESC, suppkey DESC) AS rn FROM observations),
promoted AS (SELECT e.*, b.final_price, b.id AS promotion_id, b.title AS promotion_title, b.end_date AS promotion_end,
    h.price AS previous_price,
    CASE WHEN h.price > 0 THEN floor((e.price::double - h.price::double)*100+0.5)/100 END AS delta_amount,
    CASE WHEN h.price > 0 AND e.price < h.price THEN floor((h.price::double - e.price::double)*100+0.5)/100 END AS drop_amount
  FROM entries e LEFT JOIN best b ON b.entry_id = e.id LEFT JOIN hist h ON h.sid = e.id AND h.rn = 2),
moved AS (SELECT *, floor(delta_amount / previous_price::double * 100 * 100 + 0.5)/100 AS delta_percent,
    floor(drop_amount / previous_price::double * 100 * 100 + 0.5)/100 AS drop_percent FROM promoted)"""
PROMOTED_TABLES = "entries promotions promotion_products observations"

_SCORE_SQL = """CASE WHEN ean = '{q}' THEN 100 WHEN lower(name) = '{q}' THEN 95 WHEN starts_with(lower(name), '{q}') THEN 80
  WHEN starts_with(lower(coalesce(brand,'')), '{q}') THEN 70 WHEN contains(lower(name), '{q}') THEN 50
  WHEN contains(lower(coalesce(brand,'')), '{q}') THEN 35 ELSE 0 END"""


@query("e04_product_price_summary", "A1 B2 B3 C2 D12 D15 E4 E5 E6 G3", "entries products",
       f"WITH {SUMMARY_SQL} SELECT s.*, p.name, p.brand, p.category FROM summary s JOIN products p USING (ean)")
def product_price_summary(t):
    found = op.product_list(entries(t), t.products, ProductFilters())
    return found.drop("image_url")


@query("b01_product_search", "B1", "entries products", """
SELECT ean, name, brand, category FROM products p WHERE (ean = 'red' OR contains(lower(name), 'red') OR contains(lower(brand), 'red'))
  AND lower(category) = 'economy'
  AND EXISTS (SELECT 1 FROM entries e WHERE e.product_ean = p.ean AND e.slug = 'market-2' AND e.is_available)""")
def product_search(t):
    f = ProductFilters(query="RED", category="Economy", supermarket="market-2")
    return op.search_products(t.products, f, entries(t)).select("ean", "name", "brand", "category")


@query("b04_public_price_filter", "B4", "entries",
       f"WITH {SUMMARY_SQL} SELECT ean, display_price, discount_percent FROM summary WHERE discount_percent > 0 "
       "AND coalesce(display_price, min_price) >= 900 AND coalesce(display_price, min_price) <= 1000")
def public_price_filter(t):
    f = ProductFilters(offers_only=True, min_price=900.0, max_price=1000.0)
    return op.filter_summaries(op.product_price_summary(entries(t)), f).select("ean", "display_price", "discount_percent")


@query("b05_active_promotions", "B5", "promotions", f"""
SELECT id, title, type, discount_value FROM promotions WHERE is_active AND type = 'wallet_discount'
  AND contains(lower(wallet_provider), 'wallet') AND (start_date IS NULL OR start_date <= TIMESTAMP '{NOW}')
  AND (end_date IS NULL OR end_date >= TIMESTAMP '{NOW}')""")
def active_promotions(t):
    rows = op.active_promotions(t.promotions, NOW, kind="wallet_discount", wallet="WALLET")
    return rows.orderBy(F.col("discount_value").desc_nulls_first(), "title", "id").select("id", "title", "type", "discount_value")


@query("b06_applicable_promotions", "B6 C5", "entries promotions promotion_products", f"""
WITH active AS (SELECT * FROM promotions WHERE is_active AND (start_date IS NULL OR start_date <= TIMESTAMP '{NOW}')
    AND (end_date IS NULL OR end_date >= TIMESTAMP '{NOW}')),
wide AS (SELECT supermarket_id, count(*) AS n FROM active WHERE id NOT IN (SELECT promotion_id FROM promotion_products) GROUP BY 1),
listed AS (SELECT supermarket_id, product_ean, count(*) AS n FROM active JOIN promotion_products ON promotion_id = id GROUP BY 1, 2)
SELECT e.id, coalesce(l.n, 0) AS listed, coalesce(w.n, 0) AS store_wide FROM entries e
LEFT JOIN listed l USING (supermarket_id, product_ean) LEFT JOIN wide w ON w.supermarket_id = e.supermarket_id""")
def applicable_promotions(t):
    return op.applicable_promotions(entries(t), op.active_promotions(t.promotions, NOW), t.promotion_products)


@query("f07_best_promotion", "D16 D18 F7", PROMOTED_TABLES,
       f"WITH {PROMOTED_SQL} SELECT id, product_ean, slug, price::double AS price, final_price, promotion_id, promotion_title FROM promoted")
def best_promotion(t):
    best = op.best_promotion(entries(t), op.active_promotions(t.promotions, NOW), t.promotion_products)
    return best.select("id", "product_ean", "slug", F.col("price").cast("double").alias("price"),
                       "final_price", "promotion_id", "promotion_title")


@query("f02_price_movement", "D17 F2", PROMOTED_TABLES, f"""WITH {PROMOTED_SQL}
SELECT id, previous_price::double AS previous_price, delta_amount, delta_percent, drop_amount, drop_percent FROM moved""")
def price_movement(t):
    moved = op.with_price_movement(entries(t), op.previous_prices(t.observations))
    return moved.select("id", F.col("previous_price").cast("double").alias("previous_price"),
                        "delta_amount", "delta_percent", "drop_amount", "drop_percent")


@query("f08_biggest_drop", "F8", PROMOTED_TABLES, f"""WITH {PROMOTED_SQL}
SELECT product_ean AS ean, drop_percent, slug FROM moved WHERE is_available AND status = 'fresh' AND drop_percent IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY product_ean ORDER BY drop_percent DESC, price, last_checked_at DESC, id) = 1""")
def biggest_drop(t):
    return op.biggest_drop(op.with_price_movement(entries(t), op.previous_prices(t.observations)))


@query("f01_latest_history", "F1", "observations", """
SELECT supermarket_product_id, price::double AS last_price, list_price::double AS last_list_price, scraped_at AS last_scraped_at
FROM observations QUALIFY row_number() OVER (PARTITION BY supermarket_product_id
  ORDER BY scraped_at DESC, orderkey DESC, linenumber DESC, suppkey DESC) = 1""")
def latest_history(t):
    h = op.latest_history(t.observations)
    return h.withColumns({c: F.col(c).cast("double") for c in ("last_price", "last_list_price")})


@query("e07_product_detail", "E7", PROMOTED_TABLES, f"""WITH {PROMOTED_SQL}
SELECT product_ean AS ean, min(price) FILTER (is_available)::double AS min_price, max(price) FILTER (is_available)::double AS max_price,
  min(price) FILTER (is_available AND status='fresh')::double AS fresh_min_price,
  coalesce(min(price) FILTER (is_available AND status='fresh'), min(price) FILTER (is_available))::double AS display_price,
  coalesce(bool_or(is_available AND status='fresh'), false) AS has_fresh, count(*) FILTER (status='stale') AS stale_count,
  max(CASE WHEN list_price > price THEN (list_price::double-price::double)/list_price::double*100 END)
    FILTER (is_available AND status='fresh') AS discount_percent,
  min(final_price) FILTER (is_available AND status='fresh') AS best_final_price,
  max(drop_percent) FILTER (is_available AND status='fresh') AS best_drop_percent, count(*) AS entries
FROM moved GROUP BY 1""")
def product_detail(t):
    return op.product_detail(promoted(t))


@query("i04_product_documents", "I4", PROMOTED_TABLES + " products", f"""WITH {PROMOTED_SQL},
agg AS (SELECT product_ean AS ean, count(*) AS entries,
  string_agg(slug || ':' || status || ':' || price::decimal(12,2) || ':' || coalesce(promotion_id::varchar, '-'), '|'
    ORDER BY CASE status WHEN 'fresh' THEN 0 ELSE 1 END, price, last_checked_at DESC, id) AS listing FROM moved GROUP BY 1)
SELECT p.ean, p.name, p.brand, a.entries, a.listing FROM products p JOIN agg a USING (ean)""")
def product_documents(t):
    docs = op.product_documents(promoted(t), t.products)
    listing = F.array_join(F.transform("price_entries", lambda e: F.concat_ws(
        ":", e["slug"], e["status"], e["price"].cast("decimal(12,2)").cast("string"),
        F.coalesce(e["promotion_id"].cast("string"), F.lit("-")))), "|")
    return docs.select("ean", "name", "brand", "entries", listing.alias("listing"))


@query("i03_offer_feed", "I3", PROMOTED_TABLES, f"""WITH {PROMOTED_SQL},
f AS (SELECT *, CASE WHEN list_price > price THEN (list_price::double-price::double)/list_price::double*100 END AS pct FROM moved WHERE status = 'fresh')
SELECT '{SITE}/producto/' || product_ean || '#offer-' || slug AS offer_id,
  CASE WHEN final_price IS NOT NULL OR promotion_id IS NOT NULL OR pct IS NOT NULL THEN 'SpecialOffer' ELSE 'Offer' END AS offer_type,
  product_url AS url, coalesce(final_price, price::double)::decimal(12,2)::varchar AS price, 'ARS' AS currency,
  'https://schema.org/' || CASE WHEN is_available THEN 'InStock' ELSE 'OutOfStock' END AS availability, store AS seller,
  strftime(promotion_end, '%Y-%m-%d') AS valid_until,
  coalesce(promotion_title, floor(pct+0.5)::bigint || '% OFF detectado sobre list price') AS description FROM f""")
def offer_feed(t):
    return op.offer_feed(promoted(t), SITE, "ARS")


@query("i05_promotion_summaries", "I5", "promotions promotion_products supermarkets", """
SELECT p.id, p.title, p.type, s.slug AS store_slug, count(b.product_ean) AS product_count FROM promotions p
JOIN supermarkets s ON s.id = p.supermarket_id LEFT JOIN promotion_products b ON b.promotion_id = p.id GROUP BY ALL""")
def promotion_summaries(t):
    rows = op.promotion_summaries(t.promotions, t.promotion_products, t.supermarkets)
    return rows.select("id", "title", "type", "store_slug", "product_count")


@query("i01_price_history_points", "I1", "observations supermarkets", f"""
WITH w AS (SELECT o.*, s.slug FROM observations o JOIN supermarkets s ON s.id = supermarket_id
  WHERE scraped_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY),
last AS (SELECT ean, slug, strftime(scraped_at, '%Y-%m-%d') AS day, price::double AS price FROM w
  QUALIFY row_number() OVER (PARTITION BY ean, slug, scraped_at::date ORDER BY scraped_at DESC, orderkey DESC, linenumber DESC, suppkey DESC) = 1),
first AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY ean, slug ORDER BY scraped_at, orderkey, linenumber, suppkey) = 1),
series AS (SELECT ean, slug, row_number() OVER (PARTITION BY ean ORDER BY scraped_at, orderkey, linenumber, suppkey) - 1 AS series FROM first)
SELECT ean, day, slug, price, series, ['#d24726','#2a6f58','#4259d6','#c77d00','#7b3fe4','#d13d7a'][series % 6 + 1] AS color
FROM last JOIN series USING (ean, slug)""")
def price_history_points(t):
    return op.price_history_points(t.observations, t.supermarkets, NOW, 90)


@query("i01_price_history_pivot", "I1", "observations", f"""
PIVOT (SELECT ean, strftime(scraped_at, '%Y-%m-%d') AS day, 'market-' || supermarket_id AS slug, price::double AS price FROM observations
  WHERE scraped_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY
  QUALIFY row_number() OVER (PARTITION BY ean, supermarket_id, scraped_at::date ORDER BY scraped_at DESC, orderkey DESC, linenumber DESC, suppkey DESC) = 1)
ON slug IN ('market-0','market-1','market-2','market-3','market-4','market-5') USING max(price) GROUP BY ean, day"""
       .replace("\nPIVOT", "\nSELECT * FROM (PIVOT") + ")")
def price_history_pivot(t):
    points = op.price_history_points(t.observations, t.supermarkets, NOW, 30)
    return op.pivot_history(points, [f"market-{i}" for i in range(N_MARKETS)])


@query("e08_category_counts", "E8 D11", "products", f"WITH {_CATEGORIES_SQL} SELECT * FROM counts")
def category_counts(t):
    return op.category_counts(shelved_products(t))


@query("i02_category_tree", "I2", "products", f"""WITH RECURSIVE {_CATEGORIES_SQL},
tree AS (SELECT id, name, slug, parent_id, 0 AS depth, slug AS path FROM categories WHERE parent_id IS NULL
  UNION ALL SELECT c.id, c.name, c.slug, c.parent_id, t.depth + 1, t.path || '/' || c.slug FROM categories c JOIN tree t ON c.parent_id = t.id)
SELECT t.*, coalesce(n.product_count, 0) AS product_count FROM tree t LEFT JOIN counts n USING (slug)""")
def category_tree(t):
    return op.category_tree(categories(t), op.category_counts(shelved_products(t)))


# a supplier in seven hangs below a category that is missing, one in eleven is its own ancestor
_DAMAGED = "CASE WHEN id >= 1000 AND id % 7 = 0 THEN 7 WHEN id >= 1000 AND id % 11 = 0 THEN CASE WHEN id % 2 = 0 THEN id ELSE id + 11 END ELSE parent_id END"


@query("i02_category_problems", "I2", "", f"""WITH RECURSIVE {_CATEGORIES_SQL.split("shelved AS")[0].rstrip().rstrip(",")},
damaged AS (SELECT id, name, slug, {_DAMAGED} AS parent_id FROM categories),
tree AS (SELECT id, parent_id IS NOT NULL AS orphan FROM damaged WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM damaged)
  UNION ALL SELECT d.id, t.orphan FROM damaged d JOIN tree t ON d.parent_id = t.id)
SELECT d.id, name, slug, parent_id, CASE WHEN t.orphan THEN 'orphan' ELSE 'cycle' END AS problem
FROM damaged d LEFT JOIN tree t ON t.id = d.id WHERE coalesce(t.orphan, true)""")
def category_problems(t):
    return op.category_problems(categories(t).withColumn("parent_id", F.expr(_DAMAGED)))


@query("i02_category_by_slug", "I2", "products", f"""WITH {_CATEGORIES_SQL}
SELECT c.id, c.name, coalesce(n.product_count, 0) AS product_count FROM categories c LEFT JOIN counts n USING (slug) WHERE slug = 'nation-7'""")
def category_by_slug(t):
    tree = op.category_tree(categories(t), op.category_counts(shelved_products(t)))
    return op.category_by_slug(tree, "nation-7").select("id", "name", "product_count")


@query("d30_haystack_search", "D30", "entries products", """
WITH s AS (SELECT product_ean AS ean, string_agg(DISTINCT store, ' ' ORDER BY store) AS stores FROM entries WHERE is_available GROUP BY 1)
SELECT ean, name, stores FROM products JOIN s USING (ean) WHERE contains(lower(strip_accents(
  ean || ' ' || name || ' ' || coalesce(brand,'') || ' ' || coalesce(category,'') || ' ' || stores)), 'bolt brand#1')""")
def haystack_search(t):
    return op.haystack_search(t.products, entries(t), "BÓLT Brand#1")


@query("d29_relevance_score", "D29", "products", f"SELECT ean, {_SCORE_SQL.format(q='red')} AS score FROM products")
def relevance(t):
    return t.products.select("ean", op.relevance_score("red").alias("score"))


def _page_sql(order: str, where: str = "true", limit: int = 24, offset: int = 24) -> str:
    return f"""WITH {SUMMARY_SQL}, rows AS (SELECT s.*, p.name, p.brand FROM summary s JOIN products p USING (ean) WHERE {where})
SELECT ean, name, display_price, rank_status, (SELECT count(*) FROM rows) AS total,
  greatest(1, ceil((SELECT count(*) FROM rows) / {limit}.0))::bigint AS total_pages FROM rows
ORDER BY CASE rank_status WHEN 'fresh' THEN 0 ELSE 1 END, {order}, name, ean LIMIT {limit} OFFSET {offset}"""


def _page(t, filters):
    rows = op.product_list(entries(t), t.products, filters)
    page = op.page_of(rows, op.public_order(filters), filters.page, filters.limit)
    return page.select("ean", "name", "display_price", "rank_status", "total", "total_pages")


_CHEAP = "coalesce(display_price, min_price)"


@query("g03_page_by_discount", "G3 G4", "entries products", _page_sql(f"coalesce(discount_percent, -1) DESC, {_CHEAP}"))
def page_by_discount(t):
    return _page(t, ProductFilters(page=2))


@query("g03_page_by_price_asc", "G3 G4", "entries products", _page_sql(_CHEAP))
def page_by_price_asc(t):
    return _page(t, ProductFilters(sort="price-asc", page=2))


@query("g03_page_by_price_desc", "G3 G4", "entries products", _page_sql(f"{_CHEAP} DESC"))
def page_by_price_desc(t):
    return _page(t, ProductFilters(sort="price-desc", page=2))


@query("g03_page_by_update", "G3 G4", "entries products", _page_sql("latest_checked_at DESC"))
def page_by_update(t):
    return _page(t, ProductFilters(sort="updated", page=2))


_RED = "(p.ean = 'red' OR contains(lower(p.name), 'red') OR contains(lower(p.brand), 'red'))"


@query("g03_page_by_relevance", "G3 G4 D29", "entries products",
       _page_sql(f"{_SCORE_SQL.format(q='red')} DESC, {_CHEAP}", _RED, offset=0))
def page_by_relevance(t):
    return _page(t, ProductFilters(query="red"))


@query("g05_search_suggestions", "G5", "entries products", f"""WITH {SUMMARY_SQL}
SELECT ean, name, brand, category, display_price AS min_price, display_price, latest_checked_at, display_checked_at, rank_status AS freshness_status
FROM summary JOIN products p USING (ean) WHERE {_RED.replace('red', 'gear')}
ORDER BY CASE rank_status WHEN 'fresh' THEN 0 ELSE 1 END, {_SCORE_SQL.format(q='gear')} DESC, {_CHEAP}, name, ean LIMIT 8""")
def search_suggestions(t):
    return op.search_suggestions(entries(t), t.products, "gear")


@query("g02_freshest_candidates", "G1 G2", "entries", """
SELECT ean FROM (SELECT product_ean AS ean, last_checked_at, id FROM entries WHERE is_available
  QUALIFY row_number() OVER (PARTITION BY product_ean ORDER BY last_checked_at DESC, id) = 1)
ORDER BY last_checked_at DESC, id LIMIT 200""")
def freshest_candidates(t):
    return op.freshest_candidates(entries(t), 200)


@query("f09_latest_checks", "F9", "sp",
       "SELECT product_ean AS ean, max(last_checked_at) AS latest_checked_at FROM sp GROUP BY 1")
def latest_checks(t):
    return op.latest_checks(t.supermarket_products)


@query("h06_site_feed", "H6", "products sp", f"""WITH {_CATEGORIES_SQL}
SELECT '{SITE}/categoria/' || slug AS url, TIMESTAMP '{NOW}' AS last_modified, 'weekly' AS change_frequency, 0.7::double AS priority FROM categories
UNION ALL SELECT '{SITE}/producto/' || ean, coalesce((SELECT max(last_checked_at) FROM sp WHERE product_ean = ean), TIMESTAMP '{NOW}'),
  'daily', 0.8::double FROM products""")
def site_feed(t):
    return op.site_feed(categories(t), t.products, op.latest_checks(t.supermarket_products), SITE, NOW)


@query("e37_page_flags", "E37", "entries products", f"""WITH {SUMMARY_SQL},
page AS (SELECT * FROM summary JOIN products USING (ean) WHERE rank_status <> 'fresh')
SELECT coalesce(bool_and(rank_status <> 'fresh'), false) AS all_stale, max(latest_checked_at) AS latest_checked_at FROM page""")
def page_flags(t):
    rows = op.product_list(entries(t), t.products, ProductFilters())
    return op.page_flags(rows.filter(F.col("rank_status") != fr.FRESH))


@query("d13_price_ages", "D12 D13 D36", "sp supermarkets", f"""
SELECT sp.id, CASE WHEN TIMESTAMP '{NOW}' - last_checked_at <= freshness_sla_hours * INTERVAL 1 HOUR THEN 'fresh' ELSE 'stale' END AS status,
  greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_checked_at)) // 86400000000 AS age_days,
  greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_checked_at)) / 3600000000.0::double AS age_hours,
  CASE WHEN TIMESTAMP '{NOW}' - last_checked_at <= freshness_sla_hours * INTERVAL 1 HOUR THEN 'within_sla'
       WHEN TIMESTAMP '{NOW}' - last_checked_at <= INTERVAL 7 DAY THEN 'up_to_7d'
       WHEN TIMESTAMP '{NOW}' - last_checked_at <= INTERVAL 30 DAY THEN 'up_to_30d' ELSE 'over_30d' END AS bucket
FROM sp JOIN supermarkets s ON s.id = supermarket_id""")
def price_ages(t):
    e = entries(t)
    at, sla = F.col("last_checked_at"), F.col("freshness_sla_hours")
    return e.select("id", "status", fr.age_days(at, NOW).alias("age_days"), fr.age_hours(at, NOW).alias("age_hours"),
                    fr.age_bucket(at, sla, NOW).alias("bucket"))
