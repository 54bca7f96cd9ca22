"""Landed JSON: catalog payloads, category trees, artifacts, crawl logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import loose_number, number_of, number_text
from ..functions.text import category_from_lowered, category_leaf, clean, first_clean, slugify, strip_html
from ..functions.web import absolute_url
from ..schema import RAW_ALTERNATE, RAW_PRODUCT


def _children(node: Column) -> Column:
    """Everything directly inside an object or array; nothing for a scalar."""
    return F.coalesce(
        F.map_values(node.try_cast("map<string,variant>")), node.try_cast("array<variant>"), F.expr(_NO_NODES))


_NO_NODES = "cast(array() as array<variant>)"


def _is_product(node: Column) -> Column:
    return (F.try_variant_get(node, "$.productName", "variant").isNotNull()
            | F.try_variant_get(node, "$.items", "variant").isNotNull())


def _product_keys(node: Column) -> Column:
    return sum((F.try_variant_get(node, f"$.{k}", "variant").isNotNull().cast("int") for k in _PRODUCT_KEYS), F.lit(0))


def _keys_in_text() -> Column:
    """At least the number of ``productName`` and ``items`` keys in the payload: how often the quoted words stand in its text.

    A key can only be spelled otherwise with a code point escape; such payloads count as holding any number.
    """
    raw = F.col("raw")
    found = sum(((F.length(raw) - F.length(F.replace(raw, F.lit(f'"{k}"')))) / F.lit(len(k) + 2) for k in _PRODUCT_KEYS), F.lit(0.0))
    return F.when(F.contains(raw, F.lit("\\u")), F.lit(2**31 - 1)).otherwise(found.cast("int"))


_PRODUCT_KEYS = ("productName", "items")


def product_nodes(payloads: DataFrame) -> DataFrame:
    """Every object in a JSON payload that has ``productName`` or ``items``, nested hits too, as variants (pos, node).

    The payload is parsed once and walked level by level inside the row, as deep as its text has such keys left.
    """
    hits = _walk_all(_root(), _is_product, _children, 10, _product_keys, _keys_in_text())
    return payloads.select(*payloads.drop("raw").columns, F.posexplode(hits).alias("pos", "node"))


def find_product_records(payloads: DataFrame) -> DataFrame:
    """The same objects as JSON text (pos, record)."""
    return product_nodes(payloads).withColumn("record", F.to_json("node")).drop("node")


def _root(parsed: Column | None = None) -> Column:
    return F.filter(F.array(F.try_parse_json("raw") if parsed is None else parsed), lambda v: v.isNotNull())


def has_products(root: Column | None = None) -> Column:
    """Whether the payload in ``raw`` holds a product record at any depth; ``root``: the parsed payload."""
    return F.size(_walk_all(_root(root), _is_product, _children, 10, _product_keys, F.least(_keys_in_text(), F.lit(1)))) > 0


def deeper_than(max_depth: int, root: Column | None = None) -> Column:
    """Whether the payload in ``raw`` holds containers below ``max_depth`` levels; ``root``: the parsed payload.

    Only payloads whose brackets stand that deep are walked.
    """
    return F.coalesce(_brackets_reach(max_depth), F.lit(False)) & _walk(_root(root), _is_product, _children, max_depth)["deeper"]


def _brackets_reach(depth: int) -> Column:
    """Whether brackets are nested at least ``depth`` deep: some stay after the innermost pairs went ``depth - 1`` times."""
    left = F.regexp_replace("raw", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++', "")
    for _ in range(depth - 1):
        left = F.regexp_replace(left, r"\[\]|\{\}", "")
    return left != ""


def quarantined_payloads(payloads: DataFrame, max_depth: int = 10) -> DataFrame:
    """Payloads that hold containers below ``max_depth`` levels, for a look by hand; they don't stop the others."""
    return payloads.filter(deeper_than(max_depth))


def _walk(roots: Column, keep, children, max_depth: int) -> Column:
    """``hits``: kept nodes of all levels in breadth-first order; ``deeper``: whether levels were left.

    One fold, so no level is evaluated twice.
    """
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(max_depth)), _first_level(roots), lambda acc, _: _next_level(acc, keep, children),
        lambda acc: F.struct(acc["hits"].alias("hits"), (F.size(acc["level"]) > 0).alias("deeper")))


def _walk_all(roots: Column, keep, children, usual_depth: int, weigh=None, budget: Column | None = None) -> Column:
    """Kept nodes of all levels in breadth-first order, at any depth.

    The fold goes on where levels are left after the usual ones: JSON has no more levels than opening brackets. With
    ``budget``, at least the sum of ``weigh`` over all nodes, it ends at the level where that is used up.
    """
    def step(acc, _):
        return F.when(F.size(acc["level"]) == 0, acc).otherwise(_next_level(acc, keep, children, weigh))

    usual = F.aggregate(F.sequence(F.lit(1), F.lit(usual_depth)), _first_level(roots, budget), step)
    most = F.length("raw") - F.length(F.translate("raw", "[{", "")) + 1
    return F.get(F.transform(F.array(usual), lambda found: F.when(F.size(found["level"]) == 0, found["hits"]).otherwise(F.aggregate(
        F.sequence(F.lit(1), most), found, step, lambda acc: acc["hits"]))), F.lit(0))


def _first_level(roots: Column, budget: Column | None = None) -> Column:
    none = F.expr(_NO_NODES)
    start = F.coalesce(roots, none)
    if budget is None:
        return F.struct(none.alias("hits"), start.alias("level"))
    return F.struct(none.alias("hits"), F.when(budget > 0, start).otherwise(none).alias("level"), budget.alias("left"))


def _next_level(acc: Column, keep, children, weigh=None) -> Column:
    hits = F.concat(acc["hits"], F.filter(acc["level"], keep)).alias("hits")
    below = F.flatten(F.transform(acc["level"], children))
    if weigh is None:
        return F.struct(hits, below.alias("level"))
    left = F.aggregate(acc["level"], acc["left"], lambda n, node: n - weigh(node))
    return F.get(F.transform(F.array(left), lambda n: F.struct(
        hits, F.when(n > 0, below).otherwise(F.expr(_NO_NODES)).alias("level"), n.alias("left"))), F.lit(0))


def _truthy(text: Column) -> Column:
    return text.isNotNull() & ~F.lower(text).isin("", "0", "0.0", "false")


def _images(p: Column, base: Column) -> Column:
    none = F.expr("array()")
    pick = lambda i: first_clean(i["imageUrl"], i["imageLabel"], i["imageText"])
    of_items = F.flatten(F.transform(F.coalesce(p["items"], none), lambda i: F.coalesce(i["images"], none)))
    found = F.transform(F.concat(of_items, F.coalesce(p["images"], none)), pick)
    return F.array_distinct(F.transform(F.filter(found, lambda u: u.isNotNull()), lambda u: absolute_url(u, base)))


def normalize_payloads(records: DataFrame) -> DataFrame:
    """Candidate rows from (record, base_url); records without an EAN or a name are dropped.

    The record goes through JSON text: parsing that by schema is faster than a typed read of the variant (17 s against
    25 s on 119,000 payloads).
    """
    p, q, none = F.col("_p"), F.col("_q"), F.expr("array()")
    sku = F.get(p["items"], F.lit(0))
    sku_sellers, all_sellers = sku["sellers"], p["sellers"]
    sellers = F.when(F.size(F.coalesce(sku_sellers, none)) > 0, sku_sellers).otherwise(all_sellers)
    in_stock = F.filter(sellers, lambda s: _truthy(s["commertialOffer"]["AvailableQuantity"]))
    seller = F.coalesce(F.get(in_stock, F.lit(0)), F.get(sellers, F.lit(0)))
    offer = F.coalesce(F.col("_seller.commertialOffer"), F.col("_seller.commercialOffer"))
    other = F.get(q["items"], F.lit(0))
    ids = F.zip_with(
        F.concat(F.coalesce(p["referenceId"], none), F.coalesce(sku["referenceId"], none)),
        F.concat(F.coalesce(q["referenceId"], none), F.coalesce(other["referenceId"], none)),
        lambda a, b: F.coalesce(a["Value"], b["value"]))
    eans = F.transform(F.concat(F.array(p["ean"], q["EAN"], sku["ean"], other["EAN"]), ids), clean)
    price = number_text(F.coalesce(F.col("_offer.Price"), p["price"]))
    listed = number_text(F.coalesce(F.col("_offer.ListPrice"), p["listPrice"]))
    link = F.coalesce(F.when(clean(p["linkText"]).isNotNull(), F.concat(F.lit("/"), p["linkText"], F.lit("/p"))),
                      clean(p["link"]))
    available = F.coalesce(F.col("_offer.AvailableQuantity"), F.col("_offer.IsAvailable"), p["available"])
    keep = [c for c in records.columns if c not in ("record", "base_url")]
    c = F.col
    parsed = once(records.select(*keep, "base_url", "record"), "_d", p=F.from_json("record", RAW_PRODUCT), q=F.when(
        c("record").rlike('"(EAN|value)"'), F.from_json("record", RAW_ALTERNATE))).drop("record")
    parsed = parsed.withColumn("_p", c("_d.p")).withColumn("_q", c("_d.q"))
    found = once(parsed, "_a", seller=seller, eans=eans, name=first_clean(p["productName"], p["name"])).drop("_q", "_d")
    found = found.withColumn("_seller", c("_a.seller"))
    named = once(found, "_b", offer=offer, ean=F.get(F.filter("_a.eans", lambda e: e.rlike(r"^\d{8,14}$")), F.lit(0)), name=strip_html(c("_a.name")))
    named = named.drop("_a").withColumn("_offer", c("_b.offer")).filter(c("_b.ean").isNotNull() & (c("_b.name") != ""))
    worked = once(
        named, "_c", images=_images(p, c("base_url")), lowered=F.lower("_b.name"),
        listed=F.when(p["categories"].isNotNull(), clean(F.get(p["categories"], F.lit(0)))).otherwise(clean(p["category"])),
        brand=first_clean(p["brand"], p["brandName"]), description=first_clean(p["description"], p["metaTagDescription"]),
        price=price, list=listed, link=link, available=available)
    ready = once(worked, "_e", price=number_of(c("_c.price")), list=number_of(c("_c.list")), category=first_clean(
        category_from_lowered(c("_c.lowered")), F.get(p["categoryTree"], F.lit(0))["name"], category_leaf(c("_c.listed"))))
    return ready.select(
        *keep, c("_b.ean").alias("ean"), c("_b.name").alias("name"),
        strip_html(c("_c.brand")).alias("brand"),
        strip_html(c("_c.description")).alias("description"),
        F.get("_c.images", F.lit(0)).alias("image_url"),
        c("_c.images").alias("images"),
        strip_html(c("_e.category")).alias("category"),
        first_clean(sku["itemId"], sku["id"]).alias("sku_id"),
        first_clean(c("_seller.sellerId"), c("_seller.id")).alias("seller_id"),
        absolute_url(c("_c.link"), c("base_url")).alias("product_url"),
        c("_e.price").alias("price"),
        plausible_list_price(c("_e.price"), c("_e.list")).alias("list_price"),
        loose_number(F.coalesce(p["unitMultiplier"], c("_offer.PriceWithoutDiscount"))).alias("reference_price"),
        first_clean(p["measurementUnit"], sku["measurementUnit"]).alias("reference_unit"),
        F.when(c("_c.available").isNull(), True).otherwise(_truthy(c("_c.available"))).alias("is_available"),
    )


def once(rows: DataFrame, alias: str, /, **values: Column) -> DataFrame:
    """``rows`` with a struct of ``values``; the generator keeps them from being evaluated again at each use."""
    return rows.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias(alias))


def plausible_list_price(price: Column, list_price: Column) -> Column:
    """Null when the list price is below the price or above five times the price."""
    odd = (list_price < price) | (list_price > price * 5)
    return F.when(price.isNull() | ~odd, list_price)


def union_of_terms(results: list[DataFrame]) -> DataFrame:
    """The answers of several search terms (source_slug, ean, pos, ...) one after the other, with ``term_ord`` from 0."""
    tagged = [rows.withColumn("term_ord", F.lit(i)) for i, rows in enumerate(results)]
    return reduce(DataFrame.unionByName, tagged)


def last_fetch_wins(fetched: DataFrame) -> DataFrame:
    """Union of term results deduplicated by (source, EAN): values of the last row, position of the first."""
    order = F.struct("term_ord", "pos")
    payload = [c for c in fetched.columns if c not in ("source_slug", "ean", "term_ord", "pos")]
    return fetched.groupBy("source_slug", "ean").agg(
        F.max_by(F.struct(*payload), order).alias("last"), F.min(order).alias("first")
    ).select("source_slug", "ean", "last.*", F.col("first.term_ord").alias("term_ord"), F.col("first.pos").alias("pos"))


def fetch_outcome(error_code: Column, status: Column, body: Column) -> Column:
    """Null for a good answer, else timeout, hash_invalid, blocked, network or unknown."""
    low = F.lower(F.coalesce(body, F.lit("")))
    is_json = low.rlike(r"^\s*[\[{]")
    # Answer texts of an outdated stored query and of a blocked client.
    stale_query = is_json & low.rlike("persistedquerynotfound|persisted query|sha256hash|graphql query was not found")
    blocked = status.isin(403, 429) | (~is_json & low.rlike("captcha|access denied|<html"))
    failed = error_code.isNotNull() | (status >= 400)
    return (
        F.when(error_code == "ECONNABORTED", "timeout")
        .when(stale_query, "hash_invalid")
        .when(blocked, "blocked")
        .when(failed, F.when(status.isNull() & (error_code == "INTERNAL"), "unknown").otherwise("network"))
        .when(~is_json, "unknown")
    )


def _category_roots() -> Column:
    return F.try_parse_json("raw").try_cast("array<variant>")


def _category_children(node: Column) -> Column:
    kids = [F.try_variant_get(node, f"$.{n}", "array<variant>") for n in ("children", "Children")]
    return F.coalesce(*kids, F.expr(_NO_NODES))


def quarantined_category_trees(payloads: DataFrame, max_depth: int = 8) -> DataFrame:
    """Category payloads with nodes below ``max_depth`` levels."""
    return payloads.filter(_walk(_category_roots(), lambda _: F.lit(True), _category_children, max_depth)["deeper"])


def flatten_category_trees(payloads: DataFrame) -> DataFrame:
    """Nodes of nested category payloads: id, name, path and URL, at any depth.

    The path is the URL path without outer slashes, else the slug of the name.
    """
    def field(node: Column, *names: str) -> Column:
        return first_clean(*[F.try_variant_get(node, f"$.{n}", "string") for n in names])

    keys = payloads.drop("raw").columns
    nodes = payloads.select(*keys, F.explode(_walk_all(_category_roots(), lambda _: F.lit(True), _category_children, 8)).alias("n"))
    n = F.col("n")
    url_path = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return (
        nodes.select(*keys, field(n, "id", "Id").alias("id"), field(n, "name", "Name").alias("name"),
                     field(n, "url", "Url").alias("url"))
        .withColumns({
            "id": F.coalesce("id", "name"),
            "path": F.coalesce(clean(F.regexp_replace(url_path, "^/+|/+$", "")), clean(slugify(F.col("name"))))})
        .filter(F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("path").isNotNull())
    )


_ARTIFACT_ROW = T.StructType([T.StructField(n, T.StringType()) for n in (
    "source", "surface", "ean", "skuId", "productId", "url", "name", "categoryPath")])
_WRAPPER = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("surface", T.StringType()),
    T.StructField("candidates", T.ArrayType(_ARTIFACT_ROW))])


def read_artifacts(artifacts: DataFrame) -> DataFrame:
    """Candidates of JSON artifacts: a bare array or a ``candidates`` wrapper with defaults.

    ``conflict`` marks rows whose own source or surface differs from the wrapper's.
    """
    text = F.regexp_replace("body", "^﻿", "")
    is_array = F.startswith(F.ltrim(text), F.lit("["))
    wrapper = F.from_json(F.when(~is_array, text), _WRAPPER)
    rows = F.coalesce(F.from_json(F.when(is_array, text), T.ArrayType(_ARTIFACT_ROW)), F.col("_w.candidates"))

    def folded(c: str) -> Column:
        return F.lower(clean(F.col(c)))

    own_source, own_surface = folded("r.source"), folded("r.surface")
    top_source, top_surface = folded("_w.source"), folded("_w.surface")
    return (
        artifacts.withColumn("_w", wrapper).select("artifact_id", "_w", F.posexplode(rows).alias("pos", "r"))
        .select(
            "artifact_id", "pos",
            F.coalesce(own_source, top_source).alias("source"), F.coalesce(own_surface, top_surface).alias("surface"),
            F.coalesce((own_source != top_source) | (own_surface != top_surface), F.lit(False)).alias("conflict"),
            F.col("r.ean").alias("ean"), F.col("r.skuId").alias("sku_id"), F.col("r.productId").alias("product_id"),
            F.col("r.url").alias("url"), F.col("r.name").alias("name"), F.col("r.categoryPath").alias("category_path"))
    )
