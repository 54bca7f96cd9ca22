"""Price-intelligence tables projected from the generic star-schema tables.

Each property is a lazy DataFrame over the whole parquet tables; nothing is
cached or collected. ``NOW`` is the fixed clock of all registered queries and
``STATE_AT`` splits the observations into a stored state and a later batch.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import currency
from .sinks import written

NOW = "2001-11-05 00:00:00"
STATE_AT = "1995-07-01 00:00:00"
N_MARKETS = 6


def ean_of(partkey: Column) -> Column:
    return F.lpad(partkey.cast("string"), 13, "0")


def slug_of(market: Column) -> Column:
    return F.concat(F.lit("market-"), market.cast("string"))


def money(value: Column) -> Column:
    return value.cast("decimal(10,2)")


_SCHEMAS: dict[str, T.StructType] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._shared = spark, sf_dir, {}

    def shared(self, name: str, build) -> DataFrame:
        """``build(self)`` for a query that reads it several times: written once to the shared folder, then read from there."""
        if name not in self._shared:
            self._shared[name] = written(build(self), name)
        return self._shared[name]

    def stored(self, name: str) -> DataFrame:
        """The derived table of that name, for a query that reads it several times."""
        return self.shared(name, lambda t: getattr(t, name))

    def raw(self, name: str) -> DataFrame:
        """A source table; its schema is read from the files once per process."""
        path = f"{self.dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    # -- dimensions ---------------------------------------------------------
    @cached_property
    def supermarkets(self) -> DataFrame:
        i = F.col("id")
        return self.spark.range(0, N_MARKETS, 1, 1).select(
            i,
            F.concat(F.lit("Market "), i.cast("string")).alias("name"),
            slug_of(i).alias("slug"),
            F.concat(F.lit("https://www.market-"), i.cast("string"), F.lit(".example.com")).alias("base_url"),
            (i != 5).alias("is_active"),
            (F.lit(24 * 180) * (i + 1)).cast("int").alias("freshness_sla_hours"),
        )

    @cached_property
    def _parts(self) -> DataFrame:
        k, ean = F.col("p_partkey"), ean_of(F.col("p_partkey"))
        image = F.when(k % 13 != 0, F.concat(F.lit("https://img.example.com/"), ean, F.lit(".jpg")))
        return self.raw("part").select(
            k.alias("partkey"),
            ean.alias("ean"),
            F.col("p_name").alias("name"),
            F.when(k % 10 != 0, F.col("p_brand")).alias("brand"),
            F.when(k % 4 != 0, F.concat_ws(" ", "p_name", "p_type")).alias("description"),
            image.alias("image_url"),
            F.when(k % 13 != 0, F.array(image)).otherwise(F.array().cast("array<string>")).alias("images"),
            F.when(k % 17 != 0, F.col("p_type")).alias("category"),
            "p_retailprice",
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._parts.drop("p_retailprice")

    # -- facts --------------------------------------------------------------
    @cached_property
    def _lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("partkey"),
            (F.col("l_suppkey") % N_MARKETS).alias("market"),
            F.col("l_shipdate").cast("timestamp").alias("scraped_at"),
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_linenumber").cast("bigint").alias("linenumber"),
            F.col("l_suppkey").alias("suppkey"),
            F.col("l_discount").alias("discount"),
            F.col("l_returnflag").alias("returnflag"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("extendedprice"),
        )

    @cached_property
    def _prices(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("partkey"), "p_retailprice")

    def _priced(self, lines: DataFrame) -> DataFrame:
        return lines.join(self._prices, "partkey").withColumns({
            "price": money(currency(F.col("p_retailprice") * (F.lit(1.0) - F.col("discount")))),
            "list_price": money(F.col("p_retailprice")),
        })

    @staticmethod
    def _line_id() -> Column:
        return F.concat_ws(
            "-", "orderkey", "linenumber", "suppkey", "partkey", F.unix_date(F.to_date("scraped_at"))
        )

    @cached_property
    def observations(self) -> DataFrame:
        """Append-only price history, one row per sighting."""
        return self._priced(self._lines).select(
            self._line_id().alias("id"),
            (F.col("partkey") * N_MARKETS + F.col("market")).alias("supermarket_product_id"),
            ean_of(F.col("partkey")).alias("ean"),
            F.col("market").alias("supermarket_id"),
            "price", "list_price", "scraped_at", "orderkey", "linenumber", "suppkey",
            (F.col("returnflag") != "R").alias("is_available"),
        )

    @cached_property
    def state_history(self) -> DataFrame:
        return self.observations.filter(F.col("scraped_at") < F.lit(STATE_AT).cast("timestamp"))

    def _current(self, lines: DataFrame) -> DataFrame:
        """Newest line per (product, market), aggregated before the price join."""
        newest = lines.groupBy("partkey", "market").agg(
            F.max(F.struct(
                "scraped_at", "orderkey", "linenumber", "suppkey", "discount", "returnflag"
            )).alias("n")
        ).select("partkey", "market", "n.*")
        k, m = F.col("partkey"), F.col("market")
        sku = F.when(k % 23 != 0, F.concat(F.lit("sku-"), F.when(k % 40 == 1, k - 1).otherwise(k).cast("string")))
        url = F.concat(
            F.when(k % 29 == 0, F.lit("https://mirror.example.net")).otherwise(
                F.concat(F.lit("https://www.market-"), m.cast("string"), F.lit(".example.com"))),
            F.lit("/item-"), k.cast("string"), F.lit("/p"),
        )
        return self._priced(newest).select(
            (k * N_MARKETS + m).alias("id"),
            ean_of(k).alias("product_ean"),
            m.alias("supermarket_id"),
            "price", "list_price",
            F.lit(None).cast("decimal(10,2)").alias("reference_price"),
            F.lit(None).cast("string").alias("reference_unit"),
            (F.col("returnflag") != "R").alias("is_available"),
            sku.alias("sku_id"),
            F.lit("1").alias("seller_id"),
            url.alias("product_url"),
            F.col("scraped_at").alias("last_checked_at"),
        )

    @cached_property
    def supermarket_products(self) -> DataFrame:
        return self._current(self._lines)

    @cached_property
    def state_supermarket_products(self) -> DataFrame:
        return self._current(self._lines.filter(F.col("scraped_at") < F.lit(STATE_AT).cast("timestamp")))

    @cached_property
    def state_products(self) -> DataFrame:
        """Products seen before the split; their brand is blank where the key is a multiple of 3."""
        seen = self._lines.filter(F.col("scraped_at") < F.lit(STATE_AT).cast("timestamp")).select("partkey")
        return self.products.join(seen, "partkey", "left_semi").withColumn(
            "brand", F.when(F.col("partkey") % 3 != 0, F.col("brand"))
        )

    @cached_property
    def staging_product(self) -> DataFrame:
        """Candidates with deliberately wild prices."""
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
        return self._candidates(
            self._lines.join(orders, "orderkey"),
            currency(F.col("extendedprice") / F.col("quantity")).cast("decimal(18,2)"), F.col("created_at"))

    @cached_property
    def batch_candidates(self) -> DataFrame:
        """Candidates seen at or after the split, at their observed prices."""
        later = self._lines.filter(F.col("scraped_at") >= F.lit(STATE_AT).cast("timestamp"))
        return self._candidates(
            later, currency(F.col("p_retailprice") * (F.lit(1.0) - F.col("discount"))).cast("decimal(18,2)"),
            F.col("scraped_at"))

    def _candidates(self, lines: DataFrame, price: Column, created_at: Column) -> DataFrame:
        product = self._parts.drop("ean")
        k, m = F.col("partkey"), F.col("market")
        return lines.join(product, "partkey").select(
            self._line_id().alias("id"),
            F.col("orderkey").alias("run_id"),
            slug_of(m).alias("source_slug"),
            ean_of(k).alias("ean"),
            "name", "brand", "description", "image_url", "images", "category",
            F.when(k % 23 != 0, F.concat(F.lit("sku-"), k.cast("string"))).alias("sku_id"),
            F.lit("1").alias("seller_id"),
            F.concat(F.lit("https://www.market-"), m.cast("string"), F.lit(".example.com/item-"),
                     k.cast("string"), F.lit("/p")).alias("product_url"),
            price.alias("price"),
            money(F.col("p_retailprice")).alias("list_price"),
            F.lit(None).cast("decimal(10,2)").alias("reference_price"),
            F.lit(None).cast("string").alias("reference_unit"),
            (F.col("returnflag") != "R").alias("is_available"),
            F.lit(0.0).alias("quality_score"),
            F.array().cast("array<string>").alias("quality_flags"),
            F.lit("PENDING").alias("status"),
            created_at.alias("created_at"),
            "scraped_at",
        )

    @cached_property
    def ingestion_run(self) -> DataFrame:
        lines = self._lines.groupBy("orderkey").agg(
            F.count("*").alias("n"),
            F.count_if(F.col("returnflag") != "R").alias("promoted"),
            F.count_if(F.col("returnflag") == "R").alias("rejected"),
        )
        n = F.coalesce("n", F.lit(0))
        started = F.col("o_orderdate").cast("timestamp")
        status = (F.when(F.col("o_orderstatus") == "F", "SUCCESS")
                  .when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("RUNNING"))
        done = F.col("o_orderstatus") != "O"
        return (
            self.raw("orders").join(lines, F.col("o_orderkey") == F.col("orderkey"), "left")
            .select(
                F.col("o_orderkey").alias("id"),
                F.date_format(started, "'b-'yyyyMMdd").alias("batch_id"),
                slug_of(F.col("o_custkey") % N_MARKETS).alias("source_slug"),
                started.alias("started_at"),
                F.when(done, F.timestamp_micros(F.unix_micros(started) + n * F.lit(60_000_000))).alias("finished_at"),
                status.alias("status"),
                n.alias("queries_sent"),
                n.alias("products_fetched"),
                n.alias("products_staged"),
                F.coalesce("promoted", F.lit(0)).alias("products_promoted"),
                F.coalesce("rejected", F.lit(0)).alias("products_rejected"),
                F.lit(None).cast("string").alias("error_summary"),
                F.when(done, n * 60_000).alias("duration_ms"),
            )
        )

    @cached_property
    def source_health(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", F.element_at(
            F.array(*[F.lit(e) for e in ("blocked", "hash_invalid", "timeout", "network", "unknown")]),
            (F.col("event_id") % 5 + 1).cast("int")))
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            slug_of(F.col("user_id") % N_MARKETS).alias("source_slug"),
            F.col("ts").cast("timestamp").alias("checked_at"),
            (F.col("event_type") != "error").alias("is_healthy"),
            F.floor(F.col("value") * 10).alias("response_time_ms"),
            kind.alias("error_type"),
            F.coalesce(kind != "hash_invalid", F.lit(True)).alias("hash_valid"),
            (F.col("event_id") % 50).alias("products_returned"),
        )

    # -- promotions ---------------------------------------------------------
    @cached_property
    def promotions(self) -> DataFrame:
        c, seg = F.col("c_custkey"), F.col("c_mktsegment")
        now = F.unix_micros(F.lit(NOW).cast("timestamp"))
        day = F.lit(86_400_000_000)
        kind = (F.when(seg == "AUTOMOBILE", "2x1").when(seg == "BUILDING", "2nd_50")
                .when(seg == "FURNITURE", "percentage").when(seg == "HOUSEHOLD", "wallet_discount")
                .otherwise("bank_discount"))
        return self.raw("customer").select(
            c.alias("id"),
            (c % N_MARKETS).alias("supermarket_id"),
            kind.alias("type"),
            F.concat(F.lit("Promo "), (c % 100).cast("string")).alias("title"),
            F.when(seg == "HOUSEHOLD", F.concat(F.lit("Wallet "), (c % 4).cast("string"))).alias("wallet_provider"),
            F.when(seg == "MACHINERY", F.concat(F.lit("Bank "), (c % 3).cast("string"))).alias("bank_name"),
            F.when(c % 9 != 0, (c % 60 + 1).cast("double")).alias("discount_value"),
            F.when(c % 5 == 0, F.concat(F.lit("limit "), (c % 8).cast("string"))).alias("conditions"),
            F.when(c % 11 != 0, F.timestamp_micros(now + (c % 60 - 45) * day)).alias("start_date"),
            F.when(c % 13 != 0, F.timestamp_micros(now + (c % 60 - 15) * day)).alias("end_date"),
            (c % 7 != 0).alias("is_active"),
        )

    @cached_property
    def promotion_products(self) -> DataFrame:
        parts = self.raw("part").select(F.count("*")).scalar()
        c = F.col("c_custkey")
        return self.raw("customer").filter(c % 50 != 0).select(
            c.alias("promotion_id"), ean_of((c * 7) % parts).alias("product_ean"))

    # -- requests, payloads, texts -------------------------------------------
    @cached_property
    def baskets(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("basket_id"), ean_of(F.col("l_partkey")).alias("ean"),
            F.col("l_quantity").alias("qty"))

    @cached_property
    def raw_payloads(self) -> DataFrame:
        """One JSON payload per current price, in the nested shape of a shop's catalog answer."""
        p = self.products.select(
            "ean", "name", "brand", "description", "image_url", "category", "partkey")
        k = F.col("partkey")
        offer = F.struct(
            F.col("price").cast("double").alias("Price"), F.col("list_price").cast("double").alias("ListPrice"),
            F.when(F.col("is_available"), 5).otherwise(0).alias("AvailableQuantity"))
        seller = F.struct(F.col("seller_id").alias("sellerId"), offer.alias("commertialOffer"))
        item = F.struct(
            F.col("sku_id").alias("itemId"),
            F.array(F.struct(F.col("ean").alias("Value"))).alias("referenceId"),
            F.when(F.col("image_url").isNotNull(), F.array(F.struct(F.col("image_url").alias("imageUrl")))).alias("images"),
            F.array(seller).alias("sellers"))
        body = F.struct(
            F.concat(F.lit("<b>"), F.col("name"), F.lit("</b>  ")).alias("productName"),
            "brand", "description",
            F.concat(F.lit("item-"), k.cast("string")).alias("linkText"),
            F.when(F.col("category").isNotNull(), F.array(F.concat(F.lit("/Shop/"), F.col("category"), F.lit("/")))
                   ).alias("categories"),
            F.array(item).alias("items"))
        return (
            self.supermarket_products.join(p, F.col("product_ean") == F.col("ean"))
            .select(
                F.col("id").alias("payload_id"), slug_of(F.col("supermarket_id")).alias("source_slug"),
                F.concat(F.lit("https://www.market-"), F.col("supermarket_id").cast("string"),
                         F.lit(".example.com")).alias("base_url"),
                F.to_json(body).alias("raw"))
        )

    @cached_property
    def urls(self) -> DataFrame:
        return self.raw("pages").select("page_id", "url")

    @cached_property
    def texts(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text")
