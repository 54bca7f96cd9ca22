"""Registered queries and the SQL they are checked against.

``@query`` names a function (Tables) -> DataFrame, the inventory items it
covers and, where the semantics fit plain SQL, the statement that must give
the same rows. Statements list the derived tables they use; their definitions
are put in front as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.derive import N_MARKETS, NOW, STATE_AT, Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}

_EAN = "lpad(cast({} as varchar), 13, '0')"


def _current(where: str) -> str:
    return f"""
  SELECT k*{N_MARKETS}+m AS id, {_EAN.format('k')} AS product_ean, m AS supermarket_id,
         cast(floor(p_retailprice*(1.0::double-l_discount)*100+0.5)/100 AS decimal(10,2)) AS price,
         cast(p_retailprice AS decimal(10,2)) AS list_price, l_returnflag <> 'R' AS is_available,
         CASE WHEN k % 23 <> 0 THEN 'sku-' || cast(CASE WHEN k % 40 = 1 THEN k-1 ELSE k END AS varchar) END AS sku_id,
         '1' AS seller_id,
         CASE WHEN k % 29 = 0 THEN 'https://mirror.example.net' ELSE 'https://www.market-' || m || '.example.com' END
           || '/item-' || k || '/p' AS product_url,
         l_shipdate AS last_checked_at
  FROM (SELECT *, l_partkey AS k, l_suppkey % {N_MARKETS} AS m,
               row_number() OVER (PARTITION BY l_partkey, l_suppkey % {N_MARKETS}
                 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn
        FROM lineitem WHERE {where}) l JOIN part ON p_partkey = k WHERE rn = 1"""


_LINE_ID = "l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey || '-' || (epoch_us(l_shipdate) // 86400000000)"


def _candidates(source: str, price: str, created: str) -> str:
    return f"""
  SELECT {_LINE_ID} AS id, l_orderkey AS run_id, 'market-' || (l_suppkey % {N_MARKETS}) AS source_slug,
         p.ean, p.name, p.brand, p.description, p.image_url, p.images, p.category,
         CASE WHEN l_partkey % 23 <> 0 THEN 'sku-' || l_partkey END AS sku_id, '1' AS seller_id,
         'https://www.market-' || (l_suppkey % {N_MARKETS}) || '.example.com/item-' || l_partkey || '/p' AS product_url,
         cast({price} AS decimal(18,2)) AS price, cast(p_retailprice AS decimal(10,2)) AS list_price,
         l_returnflag <> 'R' AS is_available, {created} AS created_at, l_shipdate AS scraped_at
  FROM {source} JOIN products p ON p.partkey = l_partkey JOIN part ON p_partkey = l_partkey"""


# name -> (tables it needs, defining select)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "supermarkets": ((), f"""
  SELECT i AS id, 'Market ' || i AS name, 'market-' || i AS slug, 'https://www.market-' || i || '.example.com' AS base_url,
         i <> 5 AS is_active, 24*180*(1+i) AS freshness_sla_hours FROM range({N_MARKETS}) t(i)"""),
    "products": ((), f"""
  SELECT p_partkey AS partkey, {_EAN.format('p_partkey')} AS ean, p_name AS name,
         CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS brand,
         CASE WHEN p_partkey % 4 <> 0 THEN p_name || ' ' || p_type END AS description,
         CASE WHEN p_partkey % 13 <> 0 THEN 'https://img.example.com/' || {_EAN.format('p_partkey')} || '.jpg' END AS image_url,
         CASE WHEN p_partkey % 13 <> 0 THEN ['https://img.example.com/' || {_EAN.format('p_partkey')} || '.jpg']
              ELSE []::varchar[] END AS images,
         CASE WHEN p_partkey % 17 <> 0 THEN p_type END AS category FROM part"""),
    "observations": ((), f"""
  SELECT {_LINE_ID} AS id, l_partkey*{N_MARKETS} + l_suppkey%{N_MARKETS} AS supermarket_product_id,
         {_EAN.format('l_partkey')} AS ean, l_suppkey % {N_MARKETS} AS supermarket_id,
         cast(floor(p_retailprice*(1.0::double-l_discount)*100+0.5)/100 AS decimal(10,2)) AS price,
         cast(p_retailprice AS decimal(10,2)) AS list_price, l_shipdate AS scraped_at,
         l_orderkey AS orderkey, l_linenumber AS linenumber, l_suppkey AS suppkey, l_returnflag <> 'R' AS is_available
  FROM lineitem JOIN part ON p_partkey = l_partkey"""),
    "state_history": (("observations",), f"SELECT * FROM observations WHERE scraped_at < TIMESTAMP '{STATE_AT}'"),
    "sp": ((), _current("true")),
    "state_sp": ((), _current(f"l_shipdate < TIMESTAMP '{STATE_AT}'")),
    "state_products": (("products",), f"""
  SELECT * REPLACE (CASE WHEN partkey % 3 <> 0 THEN brand END AS brand) FROM products
  WHERE partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '{STATE_AT}')"""),
    "staging": (("products",), _candidates(
        "lineitem JOIN orders ON o_orderkey = l_orderkey", "floor(l_extendedprice/l_quantity*100+0.5)/100", "o_orderdate")),
    "batch": (("products",), _candidates(
        f"(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{STATE_AT}')",
        "floor(p_retailprice*(1.0::double-l_discount)*100+0.5)/100", "l_shipdate")),
    "runs": ((), f"""
  SELECT o_orderkey AS id, 'b-' || strftime(o_orderdate, '%Y%m%d') AS batch_id,
         'market-' || (o_custkey % {N_MARKETS}) AS source_slug, o_orderdate AS started_at,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + coalesce(n,0) * INTERVAL 1 MINUTE END AS finished_at,
         CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'P' THEN 'PARTIAL' ELSE 'RUNNING' END AS status,
         coalesce(n,0) AS queries_sent, coalesce(n,0) AS products_fetched, coalesce(n,0) AS products_staged,
         coalesce(promoted,0) AS products_promoted, coalesce(rejected,0) AS products_rejected,
         CASE WHEN o_orderstatus <> 'O' THEN coalesce(n,0)*60000 END AS duration_ms
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS promoted,
         count(*) FILTER (l_returnflag = 'R') AS rejected FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""),
    "health": ((), f"""
  SELECT event_id AS id, 'market-' || (user_id % {N_MARKETS}) AS source_slug, ts AS checked_at,
         event_type <> 'error' AS is_healthy, cast(floor(value*10) AS bigint) AS response_time_ms,
         CASE WHEN event_type = 'error' THEN ['blocked','hash_invalid','timeout','network','unknown'][event_id % 5 + 1] END AS error_type,
         NOT (event_type = 'error' AND event_id % 5 = 1) AS hash_valid, event_id % 50 AS products_returned FROM events"""),
    "promotions": ((), f"""
  SELECT c_custkey AS id, c_custkey % {N_MARKETS} AS supermarket_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '2x1' WHEN 'BUILDING' THEN '2nd_50' WHEN 'FURNITURE' THEN 'percentage'
              WHEN 'HOUSEHOLD' THEN 'wallet_discount' ELSE 'bank_discount' END AS type,
         'Promo ' || (c_custkey % 100) AS title,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Wallet ' || (c_custkey % 4) END AS wallet_provider,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Bank ' || (c_custkey % 3) END AS bank_name,
         CASE WHEN c_custkey % 9 <> 0 THEN cast(c_custkey % 60 + 1 AS double) END AS discount_value,
         CASE WHEN c_custkey % 5 = 0 THEN 'limit ' || (c_custkey % 8) END AS conditions,
         CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '{NOW}' + (c_custkey % 60 - 45) * INTERVAL 1 DAY END AS start_date,
         CASE WHEN c_custkey % 13 <> 0 THEN TIMESTAMP '{NOW}' + (c_custkey % 60 - 15) * INTERVAL 1 DAY END AS end_date,
         c_custkey % 7 <> 0 AS is_active FROM customer"""),
    "promotion_products": ((), f"""
  SELECT c_custkey AS promotion_id, lpad(cast((c_custkey*7) % (SELECT count(*) FROM part) AS varchar), 13, '0') AS product_ean
  FROM customer WHERE c_custkey % 50 <> 0"""),
    "baskets": ((), f"SELECT l_orderkey AS basket_id, {_EAN.format('l_partkey')} AS ean, l_quantity AS qty FROM lineitem"),
    # current prices with store and freshness, priced rows only
    "entries": (("sp", "supermarkets"), f"""
  SELECT sp.*, s.slug, s.name AS store, s.freshness_sla_hours,
         CASE WHEN TIMESTAMP '{NOW}' - last_checked_at <= s.freshness_sla_hours * INTERVAL 1 HOUR THEN 'fresh' ELSE 'stale' END AS status
  FROM sp JOIN supermarkets s ON s.id = sp.supermarket_id WHERE price IS NOT NULL"""),
}


def _needs(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        _needs(DERIVED[name][0], seen)
        if name not in seen:
            seen.append(name)
    return seen


def with_tables(tables: str, body: str) -> str:
    names = _needs(tuple(tables.split()), [])
    parts = [f"{n} AS ({DERIVED[n][1]})" for n in names]
    text = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(start):
            return start + ",\n".join([*parts, text[len(start):]])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + text


def query(name: str, covers: str, tables: str = "", sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(
            name, tuple(covers.split()), build, None if sql is None else with_tables(tables, sql))
        return build
    return add
