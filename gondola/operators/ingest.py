"""From fetched candidates to quality verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import completeness, verdict
from ..functions.numeric import currency
from ..functions.text import default_search_terms, expand_terms


def keep_listed_eans(fetched: DataFrame, allowlist: DataFrame) -> DataFrame:
    return fetched.join(allowlist.select("ean"), "ean", "left_semi")


def staged(fetched: DataFrame, run_id: Column) -> DataFrame:
    """Rows as they are appended to staging: two-decimal price, score 0, PENDING."""
    return fetched.withColumns({
        "run_id": run_id, "price": currency(F.col("price").cast("double")).cast("decimal(10,2)"),
        "quality_score": F.lit(0.0), "quality_flags": F.array().cast("array<string>"), "status": F.lit("PENDING")})


def historical_averages(history: DataFrame) -> DataFrame:
    """Mean of the non-null prices of a product over all stores."""
    return history.filter(F.col("price").isNotNull()).groupBy("ean").agg(
        (F.sum("price").cast("double") / F.count("price")).alias("avg_price"))


def evaluate_candidates(candidates: DataFrame, averages: DataFrame) -> DataFrame:
    return candidates.join(averages, "ean", "left").withColumns(verdict(F.col("avg_price"))).drop("avg_price")


def validation_summary(evaluated: DataFrame, *keys: str) -> DataFrame:
    return evaluated.groupBy(*keys).agg(
        F.count("*").alias("validated"), F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        F.count_if(F.col("status") == "PENDING").alias("pending"))


def apply_verdicts(staging: DataFrame, averages: DataFrame, active: DataFrame) -> DataFrame:
    """Staging with fresh verdicts for the ``active`` sources; rows of other sources keep theirs. One pass, no self join."""
    columns = ("quality_score", "quality_flags", "status")
    kept = staging.withColumns({f"_old_{c}": F.col(c) for c in columns})
    marked = kept.join(active.select("source_slug", F.lit(True).alias("_active")), "source_slug", "left")
    judged = evaluate_candidates(marked, averages)
    return judged.withColumns({c: F.when(F.col("_active"), F.col(c)).otherwise(F.col(f"_old_{c}")) for c in columns}).select(*staging.columns)


def flag_histogram(evaluated: DataFrame) -> DataFrame:
    return evaluated.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("rows"))


def canonical_candidates(evaluated: DataFrame, collation: str | None = "es") -> DataFrame:
    """Best candidate per EAN: quality, completeness, source name, then id."""
    source = F.collate("source_slug", collation) if collation else F.col("source_slug")
    best = F.struct((-F.col("quality_score")).alias("q"), (-completeness()).alias("c"), source.alias("s"), F.col("id").alias("i"))
    cols = [c for c in evaluated.columns if c != "ean"]
    return evaluated.groupBy("ean").agg(F.min_by(F.struct(*cols), best).alias("c")).select("ean", "c.*")


def last_per_store(candidates: DataFrame) -> DataFrame:
    """Last candidate by id per (EAN, store)."""
    cols = [c for c in candidates.columns if c not in ("ean", "source_slug")]
    return candidates.groupBy("ean", "source_slug").agg(
        F.max_by(F.struct(*cols), F.col("id")).alias("c")).select("ean", "source_slug", "c.*")


def mined_terms(products: DataFrame, limit: int, collation: str | None = "es") -> DataFrame:
    """Most frequent expanded terms of names, brands and categories, then the default terms, ``limit`` in all.

    A product counts once per term; the whole catalog is mined.
    """
    parts = F.filter(F.array("name", "brand", "category"), lambda t: t.isNotNull())
    terms = F.array_distinct(F.flatten(F.transform(parts, expand_terms)))
    counted = products.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    by_term = F.collate("term", collation) if collation else F.col("term")
    top = counted.orderBy(F.desc("n"), by_term).limit(limit)
    defaults = default_search_terms()
    spark = products.sparkSession
    extra = spark.createDataFrame([(i, w) for i, w in enumerate(defaults)], "ord int, term string")
    # at most limit + number of default terms rows from here on
    joined = top.unionByName(extra.join(top.select("term"), "term", "left_anti"), allowMissingColumns=True)
    return joined.orderBy(F.col("n").desc_nulls_last(), "ord", by_term).limit(limit).select("term", "n")


def oldest_work_list(current: DataFrame, products: DataFrame, supermarkets: DataFrame, per_store: int = 500) -> DataFrame:
    """Distinct product names among the ``per_store`` least recently checked prices of each store."""
    order = Window.partitionBy("supermarket_id").orderBy("last_checked_at", "id")
    oldest = current.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_store)
    return (
        oldest.join(products.select(F.col("ean").alias("product_ean"), "name"), "product_ean")
        .join(supermarkets.select(F.col("id").alias("supermarket_id"), "slug"), "supermarket_id")
        .filter(F.col("name") != "").select("slug", "name").distinct()
    )


def batch_rollup(summaries: DataFrame) -> DataFrame:
    """Totals over the sources of one ingest batch."""
    def total(c: str) -> Column:
        return F.sum(c).alias(c)

    return summaries.groupBy("batch_id").agg(
        total("fetched"), total("staged"), total("promoted"), total("rejected"),
        F.count_if(F.col("status") == "FAILED").alias("failed_sources"))


def share_reconcile_time(summaries: DataFrame, reconcile_ms: int) -> DataFrame:
    """Reconcile time of the batch split over its sources by promoted rows."""
    totals = summaries.groupBy("batch_id").agg(F.greatest(F.lit(1), F.sum("promoted")).alias("_total"))
    share = F.floor(F.lit(float(reconcile_ms)) * (F.col("promoted") / F.col("_total")) + 0.5)
    return summaries.join(totals, "batch_id").withColumn(
        "reconcile_ms", F.when(F.col("promoted") > 0, share).otherwise(F.lit(0)).cast("bigint")).drop("_total")
