"""Product catalog reads: price entries, summaries, search, ordering, history, feeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import freshness as fr
from ..functions import promo
from ..functions.text import contains_ignore_case, slugify, strip_accents

# Names of the public orderings.
SORTS = ("relevance", "discount", "price-asc", "price-desc", "updated")

# Line colors of the price chart, reused in a cycle.
SERIES_COLORS = ("#d24726", "#2a6f58", "#4259d6", "#c77d00", "#7b3fe4", "#d13d7a")


# Fixed value: text after the rounded discount in an offer without promotion.
DISCOUNT_NOTE = "% OFF detectado sobre list price"


@dataclass(frozen=True)
class ProductFilters:
    query: str | None = None
    category: str | None = None
    supermarket: str | None = None
    sort: str | None = None
    offers_only: bool = False
    min_price: float | None = None
    max_price: float | None = None
    page: int = 1
    limit: int = 24

    def __post_init__(self):
        if self.sort is not None and self.sort not in SORTS:
            raise ValueError(f"unknown sort {self.sort}")
        if self.page < 1 or self.limit < 1:
            raise ValueError("page and limit start at 1")

    @property
    def order(self) -> str:
        has_query = bool(self.query and self.query.strip())
        return self.sort or ("relevance" if has_query else "discount")


# -- price entries -------------------------------------------------------------
def price_entries(current: DataFrame, supermarkets: DataFrame, now) -> DataFrame:
    """Priced current rows with their store and freshness status."""
    stores = supermarkets.select(
        F.col("id").alias("supermarket_id"), "slug", F.col("name").alias("store"), "freshness_sla_hours")
    return (
        current.filter(F.col("price").isNotNull())
        .join(stores, "supermarket_id")
        .withColumn("status", fr.freshness(F.col("last_checked_at"), F.col("freshness_sla_hours"), now))
    )


def comparable(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("price").isNotNull() & F.col("is_available"))


def fresh_comparable(entries: DataFrame) -> DataFrame:
    return comparable(entries).filter(F.col("status") == fr.FRESH)


def _display_key() -> Column:
    """Sort key of the entry shown first: freshness, price, newest check, id."""
    return F.struct(
        fr.freshness_rank(F.col("status")).alias("rank"), F.col("price").alias("price"),
        (-F.unix_micros("last_checked_at")).alias("age"), F.col("id").alias("id"))


def product_price_summary(entries: DataFrame) -> DataFrame:
    """One row per product over its comparable entries; others are dropped."""
    fresh = F.col("status") == fr.FRESH
    price = F.col("price").cast("double")
    grouped = comparable(entries).groupBy(F.col("product_ean").alias("ean")).agg(
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.min(F.when(fresh, price)).alias("fresh_min_price"),
        F.min(_display_key()).alias("display"),
        F.max(F.when(fresh, promo.discount_percent(F.col("price"), F.col("list_price")))).alias("discount_percent"),
        F.count_if(fresh).alias("fresh_count"),
        F.count_if(F.col("status") == fr.STALE).alias("stale_count"),
        F.count("*").alias("price_count"),
        F.max("last_checked_at").alias("latest_checked_at"),
    )
    return grouped.select(
        "ean", "min_price", "max_price", "fresh_min_price",
        F.col("display.price").cast("double").alias("display_price"),
        F.timestamp_micros(-F.col("display.age")).alias("display_checked_at"),
        fr.rank_to_freshness(F.col("display.rank")).alias("rank_status"),
        "discount_percent", (F.col("fresh_count") > 0).alias("has_fresh"),
        "stale_count", "price_count", "latest_checked_at",
    )


# -- search --------------------------------------------------------------------
def search_products(products: DataFrame, filters: ProductFilters, entries: DataFrame | None = None) -> DataFrame:
    """Text, category and store predicate on products."""
    found = products
    if filters.query:
        q = filters.query
        found = found.filter(
            (F.col("ean") == q)
            | F.coalesce(contains_ignore_case(F.col("name"), q), F.lit(False))
            | F.coalesce(contains_ignore_case(F.col("brand"), q), F.lit(False)))
    if filters.category:
        found = found.filter(F.lower("category") == filters.category.lower())
    if filters.supermarket and entries is not None:
        sold = comparable(entries).filter(F.col("slug") == filters.supermarket)
        found = found.join(sold.select(F.col("product_ean").alias("ean")), "ean", "left_semi")
    return found


def haystack_search(products: DataFrame, entries: DataFrame, query: str) -> DataFrame:
    """Products whose EAN, name, brand, category and store names contain the folded query."""
    def fold(c: Column) -> Column:
        return F.lower(strip_accents(F.coalesce(c, F.lit(""))))

    needle = F.lower(strip_accents(F.lit(query)))
    stores = comparable(entries).groupBy(F.col("product_ean").alias("ean")).agg(
        F.array_join(F.sort_array(F.collect_set("store")), " ").alias("stores"))
    hay = F.concat_ws(" ", *[fold(F.col(c)) for c in ("ean", "name", "brand", "category", "stores")])
    return products.join(stores, "ean").filter(F.contains(hay, needle)).select("ean", "name", "stores")


def relevance_score(query: str) -> Column:
    name, brand = F.lower("name"), F.coalesce(F.lower("brand"), F.lit(""))
    low = query.lower()
    return (
        F.when(F.col("ean") == query, 100).when(name == low, 95).when(F.startswith(name, F.lit(low)), 80)
        .when(F.startswith(brand, F.lit(low)), 70).when(F.contains(name, F.lit(low)), 50)
        .when(F.contains(brand, F.lit(low)), 35).otherwise(0)
    )


def public_price() -> Column:
    return F.coalesce("display_price", "min_price")


def filter_summaries(summaries: DataFrame, filters: ProductFilters) -> DataFrame:
    kept = summaries
    if filters.offers_only:
        kept = kept.filter(F.col("discount_percent") > 0)
    if filters.min_price is not None:
        kept = kept.filter(public_price() >= filters.min_price)
    if filters.max_price is not None:
        kept = kept.filter(public_price() <= filters.max_price)
    return kept


def public_order(filters: ProductFilters, collation: str | None = "es") -> list[Column]:
    """Freshness first, then the chosen mode, then price, name and EAN."""
    rank = fr.freshness_rank(F.col("rank_status")).asc()
    name = F.collate("name", collation) if collation else F.col("name")
    tail = [name.asc(), F.col("ean").asc()]
    cheap = public_price().asc_nulls_last()
    modes = {
        "price-asc": [cheap],
        "price-desc": [public_price().desc_nulls_last()],
        "updated": [F.col("latest_checked_at").desc_nulls_last()],
        "relevance": [(relevance_score(filters.query.strip()) if filters.query else F.lit(0)).desc(), cheap],
        "discount": [F.coalesce("discount_percent", F.lit(-1.0)).desc(), cheap],
    }
    return [rank, *modes[filters.order], *tail]


def freshest_candidates(entries: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` products with the newest available priced check (ties by row id)."""
    newest = comparable(entries).groupBy(F.col("product_ean").alias("ean")).agg(
        F.min(F.struct((-F.unix_micros("last_checked_at")).alias("age"), F.col("id").alias("id"))).alias("k"))
    return newest.orderBy("k").limit(limit).select("ean")


def product_list(entries: DataFrame, products: DataFrame, filters: ProductFilters) -> DataFrame:
    """All matching summaries with product attributes, before ordering and paging."""
    scoped = entries.filter(F.col("slug") == filters.supermarket) if filters.supermarket else entries
    found = search_products(products, filters)
    summary = filter_summaries(product_price_summary(scoped), filters)
    attributes = found.select("ean", "name", "brand", "image_url", "category")
    return summary.join(attributes, "ean")


def page_of(rows: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """Rows of one page plus totals: a top-k for the page and one count for the whole."""
    total = rows.agg(F.count("*").alias("total")).scalar()
    part = rows.orderBy(*order).offset((page - 1) * limit).limit(limit)
    return part.withColumn("total", total).withColumns({
        "page": F.lit(page), "limit": F.lit(limit),
        "total_pages": F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(float(limit)))).cast("bigint"),
    })


def search_suggestions(entries: DataFrame, products: DataFrame, query: str, limit: int = 8) -> DataFrame:
    filters = ProductFilters(query=query, sort="relevance", limit=limit)
    found = product_list(entries, products, filters)
    return found.orderBy(*public_order(filters)).limit(limit).select(
        "ean", "name", "brand", "category", F.col("display_price").alias("min_price"), "display_price",
        "latest_checked_at", "display_checked_at", F.col("rank_status").alias("freshness_status"))


# -- promotions applied to prices -------------------------------------------------
def _champions(promotions: DataFrame, keys: list[str], out: str) -> DataFrame:
    """At most three promotions per key that can win on any base price.

    Within a kind the final price depends only on the discount, and for the
    percent kinds a larger discount never gives a higher price and is also
    preferred on ties, so the first of each kind in tie order is enough.
    """
    order = F.struct(
        F.when(F.col("discount_value").isNull(), 0).otherwise(1).alias("has_discount"),
        F.coalesce(-F.col("discount_value"), F.lit(0.0)).alias("by_discount"),
        "title", "promotion_id", "type", "discount_value", "end_date")
    percent_ok = F.col("type").isin(*promo.PERCENT_KINDS) & (F.col("discount_value") > 0) & (F.col("discount_value") <= 100)
    return promotions.groupBy(*keys).agg(F.filter(F.array(
        F.min(F.when(F.col("type") == "2x1", order)),
        F.min(F.when(F.col("type") == "2nd_50", order)),
        F.min(F.when(percent_ok, order)),
    ), lambda p: p.isNotNull()).alias(out))


def active_promotions(promotions: DataFrame, now, supermarket_id: int | None = None,
                      kind: str | None = None, wallet: str | None = None) -> DataFrame:
    rows = promotions.filter(promo.running(F.col("is_active"), F.col("start_date"), F.col("end_date"), now))
    if supermarket_id is not None:
        rows = rows.filter(F.col("supermarket_id") == supermarket_id)
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    if wallet is not None:
        rows = rows.filter(contains_ignore_case(F.col("wallet_provider"), wallet))
    return rows


def split_applicable(promotions: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listed promotions with their EAN, store-wide promotions without any listed product)."""
    p = promotions.withColumnRenamed("id", "promotion_id")
    listed = p.join(bridge.distinct(), "promotion_id")
    store_wide = p.join(bridge.select("promotion_id"), "promotion_id", "left_anti")
    return listed, store_wide


def applicable_promotions(entries: DataFrame, promotions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Number of applicable promotions per price entry, split by how they apply."""
    listed, store_wide = split_applicable(promotions, bridge)
    by_product = listed.groupBy("supermarket_id", "product_ean").agg(F.count("*").alias("listed"))
    by_store = store_wide.groupBy("supermarket_id").agg(F.count("*").alias("store_wide"))
    return (
        entries.join(by_product, ["supermarket_id", "product_ean"], "left").join(by_store, "supermarket_id", "left")
        .select(F.col("id"), F.coalesce("listed", F.lit(0)).alias("listed"),
                F.coalesce("store_wide", F.lit(0)).alias("store_wide"))
    )


def best_promotion(entries: DataFrame, promotions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Entries plus the promotion with the lowest final price below the base price."""
    listed, store_wide = split_applicable(promotions, bridge)
    by_product = _champions(listed, ["supermarket_id", "product_ean"], "listed_best")
    by_store = _champions(store_wide, ["supermarket_id"], "store_best")
    none = F.expr("array()")
    pool = F.concat(F.coalesce("listed_best", none), F.coalesce("store_best", none))
    offers = F.filter(
        F.transform(pool, lambda p: F.struct(
            promo.promotional_price(F.col("price"), p["type"], p["discount_value"]).alias("final_price"),
            p["has_discount"].alias("has_discount"), p["by_discount"].alias("by_discount"),
            p["title"].alias("title"), p["promotion_id"].alias("promotion_id"), p["end_date"].alias("end_date"))),
        lambda o: o["final_price"] < F.col("price").cast("double"))
    joined = (
        entries.join(by_product, ["supermarket_id", "product_ean"], "left")
        .join(by_store, "supermarket_id", "left")
        .withColumn("best", F.array_min(offers))
    )
    return joined.withColumns({
        "final_price": F.col("best.final_price"), "promotion_id": F.col("best.promotion_id"),
        "promotion_title": F.col("best.title"), "promotion_end": F.col("best.end_date"),
    }).drop("best", "listed_best", "store_best")


def promotion_summaries(promotions: DataFrame, bridge: DataFrame, supermarkets: DataFrame) -> DataFrame:
    counts = bridge.groupBy(F.col("promotion_id").alias("id")).agg(F.count("*").alias("n"))
    stores = supermarkets.select(F.col("id").alias("supermarket_id"), F.col("slug").alias("store_slug"))
    return promotions.join(counts, "id", "left").join(stores, "supermarket_id").withColumn(
        "product_count", F.coalesce("n", F.lit(0))).drop("n")


# -- history -------------------------------------------------------------------
def previous_prices(history: DataFrame) -> DataFrame:
    """Second newest price per key, from the two newest rows (pre-limited before the shuffle)."""
    newest = Window.partitionBy("supermarket_product_id").orderBy(*[
        F.col(c).desc() for c in ("scraped_at", "orderkey", "linenumber", "suppkey")])
    return (
        history.withColumn("rn", F.row_number().over(newest)).filter("rn <= 2").filter("rn = 2")
        .select(F.col("supermarket_product_id").alias("id"), F.col("price").alias("previous_price"))
    )


def latest_history(history: DataFrame) -> DataFrame:
    """Newest (price, list price) per key."""
    return (
        history.groupBy("supermarket_product_id")
        .agg(F.max(F.struct("scraped_at", "orderkey", "linenumber", "suppkey", "price", "list_price")).alias("h"))
        .select("supermarket_product_id", F.col("h.price").alias("last_price"),
                F.col("h.list_price").alias("last_list_price"), F.col("h.scraped_at").alias("last_scraped_at"))
    )


def with_price_movement(entries: DataFrame, previous: DataFrame) -> DataFrame:
    cur, prev = F.col("price"), F.col("previous_price")
    return entries.join(previous, "id", "left").withColumns({
        "delta_amount": promo.delta_amount(cur, prev), "delta_percent": promo.delta_percent(cur, prev),
        "drop_amount": promo.drop_amount(cur, prev), "drop_percent": promo.drop_percent(cur, prev),
    })


def biggest_drop(moved: DataFrame) -> DataFrame:
    """Per product the fresh comparable entry with the largest drop; the first shown wins ties."""
    first = F.struct((-F.col("drop_percent")).alias("drop"), _display_key().alias("key"), F.col("slug").alias("slug"))
    return (
        fresh_comparable(moved).filter(F.col("drop_percent").isNotNull())
        .groupBy(F.col("product_ean").alias("ean")).agg(F.min(first).alias("b"))
        .select("ean", (-F.col("b.drop")).alias("drop_percent"), F.col("b.slug").alias("slug"))
    )


def price_history_points(history: DataFrame, supermarkets: DataFrame, now, days: int = 30) -> DataFrame:
    """Long form of the price chart: last price of each day and store, with the series color."""
    if not 7 <= days <= 90:
        raise ValueError("days must be between 7 and 90")
    cutoff = F.timestamp_micros(F.unix_micros(fr.at(now)) - F.lit(days * 86_400_000_000))
    stores = supermarkets.select(F.col("id").alias("supermarket_id"), "slug")
    daily = (
        history.filter(F.col("scraped_at") >= cutoff)
        .groupBy("ean", "supermarket_id", F.to_date("scraped_at").alias("day"))
        .agg(F.max(F.struct("scraped_at", "orderkey", "linenumber", "suppkey", "price")).alias("last"),
             F.min(F.struct("scraped_at", "orderkey", "linenumber", "suppkey")).alias("first"))
    )
    # both windows run over at most days * stores rows of one product
    per_store = Window.partitionBy("ean", "supermarket_id")
    order = Window.partitionBy("ean").orderBy("store_first", "supermarket_id")
    colors = F.array(*[F.lit(c) for c in SERIES_COLORS])
    return (
        daily.withColumn("store_first", F.min("first").over(per_store))
        .withColumn("series", F.dense_rank().over(order) - 1)
        .join(stores, "supermarket_id")
        .select("ean", F.date_format("day", "yyyy-MM-dd").alias("day"), "slug",
                F.col("last.price").cast("double").alias("price"), F.col("series").cast("bigint").alias("series"),
                F.get(colors, F.col("series") % len(SERIES_COLORS)).alias("color"))
    )


def pivot_history(points: DataFrame, slugs: list[str]) -> DataFrame:
    """Wide form on a closed list of stores; a price of any other store is an error, not a gap."""
    known = F.when(F.col("slug").isin(slugs), F.col("slug")).otherwise(F.raise_error(F.concat(F.lit("store not listed: "), "slug")))
    return points.withColumn("slug", known).groupBy("ean", "day").pivot("slug", slugs).agg(F.max("price"))


# -- product detail ------------------------------------------------------------
def product_detail(promoted: DataFrame) -> DataFrame:
    """Detail figures; the stale count covers every priced entry, the rest comparable ones."""
    avail = F.col("is_available")
    fresh = avail & (F.col("status") == fr.FRESH)
    price = F.col("price").cast("double")
    return promoted.groupBy(F.col("product_ean").alias("ean")).agg(
        F.min(F.when(avail, price)).alias("min_price"),
        F.max(F.when(avail, price)).alias("max_price"),
        F.min(F.when(fresh, price)).alias("fresh_min_price"),
        F.min(F.when(avail, _display_key()))["price"].cast("double").alias("display_price"),
        (F.count_if(fresh) > 0).alias("has_fresh"),
        F.count_if(F.col("status") == fr.STALE).alias("stale_count"),
        F.max(F.when(fresh, promo.discount_percent(F.col("price"), F.col("list_price")))).alias("discount_percent"),
        F.min(F.when(fresh, F.col("final_price"))).alias("best_final_price"),
        F.max(F.when(fresh, F.col("drop_percent"))).alias("best_drop_percent"),
        F.count("*").alias("entries"),
    )


def product_documents(promoted: DataFrame, products: DataFrame) -> DataFrame:
    """Detail document per product; the entry list is bounded by the number of stores."""
    entry = F.struct(
        fr.freshness_rank(F.col("status")).alias("rank"), F.col("price").cast("double").alias("price"),
        (-F.unix_micros("last_checked_at")).alias("age"), F.col("id").alias("id"), "slug", "is_available", "status",
        "final_price", "promotion_id", "previous_price", "drop_percent")
    lists = promoted.groupBy(F.col("product_ean").alias("ean")).agg(F.sort_array(F.collect_list(entry)).alias("price_entries"))
    return products.join(product_detail(promoted), "ean").join(lists, "ean")


def offer_feed(promoted: DataFrame, site: str, currency_code: str) -> DataFrame:
    """Structured-data offers of fresh entries."""
    resolved = F.coalesce("final_price", F.col("price").cast("double"))
    discount = promo.discount_percent(F.col("price"), F.col("list_price"))
    special = F.col("final_price").isNotNull() | F.col("promotion_id").isNotNull() | discount.isNotNull()
    page = F.concat(F.lit(site), F.lit("/producto/"), F.col("product_ean"))
    return promoted.filter((F.col("status") == fr.FRESH) & resolved.isNotNull()).select(
        F.concat(page, F.lit("#offer-"), F.col("slug")).alias("offer_id"),
        F.when(special, "SpecialOffer").otherwise("Offer").alias("offer_type"),
        F.coalesce("product_url", page).alias("url"),
        resolved.cast("decimal(12,2)").cast("string").alias("price"),
        F.lit(currency_code).alias("currency"),
        F.when(F.col("is_available"), "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock").alias("availability"),
        F.col("store").alias("seller"),
        F.date_format("promotion_end", "yyyy-MM-dd").alias("valid_until"),
        F.coalesce(
            "promotion_title",
            F.when(discount.isNotNull(), F.concat(
                F.floor(discount + 0.5).cast("string"), F.lit(DISCOUNT_NOTE)))).alias("description"),
    )


def latest_checks(current: DataFrame) -> DataFrame:
    return current.groupBy(F.col("product_ean").alias("ean")).agg(F.max("last_checked_at").alias("latest_checked_at"))


def site_feed(categories: DataFrame, products: DataFrame, checks: DataFrame, site: str, now) -> DataFrame:
    """Category and product addresses with their last change."""
    def page(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{site}/{kind}/"), F.col(key))

    return (
        categories.select(page("categoria", "slug").alias("url"), fr.at(now).alias("last_modified"),
                          F.lit("weekly").alias("change_frequency"), F.lit(0.7).alias("priority"))
        .unionByName(products.join(checks, "ean", "left").select(
            page("producto", "ean").alias("url"),
            F.coalesce("latest_checked_at", fr.at(now)).alias("last_modified"),
            F.lit("daily").alias("change_frequency"), F.lit(0.8).alias("priority")))
    )


def page_flags(items: DataFrame) -> DataFrame:
    """Whether no item of a non-empty result is fresh, and the newest check."""
    return items.agg(
        F.coalesce(F.bool_and(F.col("rank_status") != fr.FRESH), F.lit(False)).alias("all_stale"),
        F.max("latest_checked_at").alias("latest_checked_at"))


# -- categories ----------------------------------------------------------------
def category_counts(products: DataFrame) -> DataFrame:
    """Products per category slug; categories with one slug are summed."""
    counted = products.filter(F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("n"))
    return counted.groupBy(slugify(F.col("category")).alias("slug")).agg(
        F.min("category").alias("name"), F.sum("n").alias("product_count"))


# A level is one pass over the categories; ids already on the way down end a branch.
_DESCENT = """
WITH RECURSIVE tree AS (
  SELECT id, name, slug, parent_id, 0 AS depth, slug AS path, array(id) AS visited,
         parent_id IS NOT NULL AS orphan
  FROM {categories} WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM {categories} WHERE id IS NOT NULL)
  UNION ALL
  SELECT c.id, c.name, c.slug, c.parent_id, t.depth + 1, t.path || '/' || c.slug, array_append(t.visited, c.id), t.orphan
  FROM tree t JOIN {categories} c ON c.parent_id = t.id WHERE NOT array_contains(t.visited, c.id))
SELECT * FROM tree"""


def category_descent(categories: DataFrame) -> DataFrame:
    """Every category below a root or below an orphan (one whose parent does not exist), at any depth: id, name, slug,
    parent_id, depth, slug path, visited (the ids from the top) and orphan."""
    spark = categories.sparkSession
    # Spark ends a recursion after 100 levels or a million rows unless told otherwise
    for limit in ("cteRecursionLevelLimit", "cteRecursionRowLimit"):
        spark.conf.set(f"spark.sql.{limit}", "-1")
    return spark.sql(_DESCENT, categories=categories.select("id", "name", "slug", "parent_id"))


def category_tree(categories: DataFrame, counts: DataFrame) -> DataFrame:
    """Every category reachable from a root, with depth, slug path and own product count."""
    return category_descent(categories).filter("NOT orphan").join(counts.select("slug", "product_count"), "slug", "left").select(
        "id", "name", "slug", "parent_id", "depth", "path", F.coalesce("product_count", F.lit(0)).alias("product_count"))


def category_problems(categories: DataFrame) -> DataFrame:
    """Categories that no root reaches: (id, name, slug, parent_id, problem).

    problem is orphan for a category whose parent does not exist and all below it, cycle for those in or below a circle.
    """
    columns = ["id", "name", "slug", "parent_id"]
    reached = category_descent(categories).select("id", "orphan")
    return categories.select(*columns).join(reached, "id", "left").filter(F.coalesce("orphan", F.lit(True))).select(
        *columns, F.when(F.col("orphan"), "orphan").otherwise("cycle").alias("problem"))


def category_by_slug(tree: DataFrame, slug: str) -> DataFrame:
    """First category with the slug, in depth-first order of the tree."""
    return tree.filter(F.col("slug") == slug).orderBy("path", "id").limit(1)
