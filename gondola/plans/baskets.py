"""Basket queries: every order is a basket."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baskets as op
from ..sources.derive import Tables, ean_of
from .catalog import entries
from .registry import query

_CLEAN = """
cleaned AS (SELECT basket_id, ean, least(99, greatest(1, sum(least(99, greatest(1, floor(qty+0.5)::bigint)))))::bigint AS qty
  FROM baskets WHERE regexp_full_match(trim(ean), '\\d{8,18}') AND qty > 0 GROUP BY 1, 2)"""
_TOTALS = f"""{_CLEAN},
known AS (SELECT * FROM cleaned WHERE ean IN (SELECT ean FROM products)),
stores AS (SELECT DISTINCT k.basket_id, e.slug FROM known k JOIN entries e ON e.product_ean = k.ean),
matrix AS (SELECT k.basket_id, s.slug, k.ean, k.qty, e.price,
    coalesce(e.is_available AND e.status = 'fresh', false) AS covered
  FROM known k JOIN stores s USING (basket_id) LEFT JOIN entries e ON e.product_ean = k.ean AND e.slug = s.slug),
totals AS (SELECT basket_id, slug, count(*) FILTER (covered) AS covered_items, count(*) FILTER (NOT covered) AS missing_items,
    (sum(price * qty::decimal(4,0)) FILTER (covered))::double AS total FROM matrix GROUP BY 1, 2 HAVING count(*) FILTER (covered) > 0)"""


@query("d33_sanitized_baskets", "D33", "baskets", f"WITH {_CLEAN} SELECT * FROM cleaned")
def sanitized_baskets(t: Tables):
    return op.sanitize_baskets(t.baskets)


@query("e09_basket_totals", "C12 E9", "baskets products entries", f"WITH {_TOTALS} SELECT * FROM totals")
def basket_totals(t):
    return op.basket_totals(op.sanitize_baskets(t.baskets), t.products, entries(t))


@query("g12_basket_ranking", "G12", "baskets products entries", f"""WITH {_TOTALS}
SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY missing_items, total, slug) AS position,
  row_number() OVER (PARTITION BY basket_id ORDER BY missing_items, total, slug) = 1 AND missing_items = 0 AS best_complete FROM totals""")
def basket_ranking(t):
    return op.rank_stores(basket_totals(t))


@query("c07_basket_lookup", "C7", "state_products", """
WITH req AS (SELECT l_orderkey AS request_id, lpad(l_partkey::varchar, 13, '0') AS ean, min(l_linenumber)::bigint AS ord FROM lineitem GROUP BY 1, 2)
SELECT request_id, ord, ean, p.name IS NOT NULL AS found, p.name FROM req LEFT JOIN state_products p USING (ean)""")
def basket_lookup(t):
    requests = t.raw("lineitem").select(
        F.col("l_orderkey").alias("request_id"), ean_of(F.col("l_partkey")).alias("ean"),
        F.col("l_linenumber").cast("bigint").alias("ord"))
    return op.lookup_products(requests, t.state_products)


@query("e10_basket_product_prices", "E10", "baskets products entries", """
WITH g AS (SELECT product_ean AS ean, min(price) FILTER (is_available)::double AS min_price,
  min(price) FILTER (is_available AND status = 'fresh')::double AS fresh_min_price,
  string_agg(slug || ':' || status, '|' ORDER BY slug, id) AS listing FROM entries GROUP BY 1)
SELECT p.ean, p.name, p.brand, min_price, fresh_min_price, fresh_min_price IS NOT NULL AS has_fresh, coalesce(listing, '') AS listing
FROM products p LEFT JOIN g USING (ean) WHERE p.ean IN (SELECT ean FROM baskets)""")
def basket_product_prices(t):
    rows = op.basket_product_prices(t.baskets, t.products, entries(t))
    listing = F.array_join(F.transform("price_entries", lambda e: F.concat_ws(":", e["slug"], e["status"])), "|")
    return rows.withColumn("listing", listing).drop("price_entries")
