"""Candidate identities: coverage, overlaps, matching, sampling, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import candidate_identity, canonical_identity, folded, record_hash
from ..functions.rules import reasons
from ..functions.text import clean
from ..functions.web import normalized_product_url

KINDS = ("sku", "url", "ean")


# -- coverage ------------------------------------------------------------------------
def with_identity(candidates: DataFrame) -> DataFrame:
    """Case-folded source and surface, and the first usable of ean, skuId, productId, url, name."""
    return candidates.withColumns({
        "source": folded(F.col("source")), "surface": folded(F.col("surface")),
        "identity": candidate_identity(
            ean=F.col("ean"), skuId=F.col("sku_id"), productId=F.col("product_id"), url=F.col("url"), name=F.col("name"))})


def identity_rows(candidates: DataFrame) -> DataFrame:
    """Rows per (source, surface, identity); ambiguous rows keep a null identity."""
    return with_identity(candidates).filter(F.col("source").isNotNull() & F.col("surface").isNotNull()).groupBy(
        "source", "surface", "identity").agg(F.count("*").alias("rows"))


def coverage_by_surface(candidates: DataFrame) -> DataFrame:
    """Rows, distinct identities, duplicates and ambiguous rows per (source, surface)."""
    known = F.col("identity").isNotNull()
    return identity_rows(candidates).groupBy("source", "surface").agg(
        F.sum("rows").alias("candidate_rows"), F.count_if(known).alias("identities"),
        F.coalesce(F.sum(F.when(known, F.col("rows") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0)).alias("ambiguous_rows"))


def source_budgets(coverage: DataFrame, limit: int) -> DataFrame:
    return coverage.groupBy("source").agg(F.sum("candidate_rows").alias("used")).withColumn(
        "status", F.when(F.col("used") <= limit, "PASS").otherwise("FAIL"))


def surface_overlaps(candidates: DataFrame) -> DataFrame:
    """Identities seen on more than one surface of a source (surfaces per identity are few)."""
    return (
        identity_rows(candidates).filter(F.col("identity").isNotNull()).groupBy("source", "identity")
        .agg(F.sort_array(F.collect_set("surface")).alias("surfaces")).filter(F.size("surfaces") > 1)
        .select("source", F.concat_ws(":", "identity.kind", "identity.value").alias("identity"), "surfaces")
    )


def select_category_paths(categories: DataFrame, exclude: str | None, offset: int, budget: int) -> DataFrame:
    """Paths left after the exclusion pattern, skipping ``offset`` rows, then the first ``budget`` distinct ones.

    Each path covers at least one row, so offset + budget paths are always enough
    and the running sum stays on that many rows.
    """
    kept = categories if exclude is None else categories.filter(~F.col("path").rlike(exclude))
    paths = kept.groupBy("path").agg(F.count("*").alias("n")).orderBy("path").limit(offset + budget)
    running = Window.orderBy("path")
    return paths.withColumn("_end", F.sum("n").over(running)).filter(F.col("_end") > offset).orderBy("path").limit(budget).select("path")


def pagination_rollup(pages: DataFrame, page_size: int, page_budget: int) -> DataFrame:
    """Pages per category, why paging stopped, and identities found.

    ``pages`` has one row per product: category_path, page, plus the identity columns.
    """
    identity = candidate_identity(ean=F.col("ean"), skuId=F.col("sku_id"), productId=F.col("product_id"),
                                  url=F.col("url"), name=F.col("name"))
    per_identity = pages.withColumn("identity", identity).groupBy("category_path", "page", "identity").agg(F.count("*").alias("n"))
    per_page = per_identity.groupBy("category_path", "page").agg(F.sum("n").alias("products"))
    ends = per_page.groupBy("category_path").agg(
        F.count("*").alias("pages_fetched"), F.max_by("products", "page").alias("last_products"))
    found = per_identity.groupBy("category_path", "identity").agg(F.sum("n").alias("n")).groupBy("category_path").agg(
        F.count("identity").alias("identities"),
        F.coalesce(F.sum(F.when(F.col("identity").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("identity").isNull(), F.col("n"))), F.lit(0)).alias("ambiguous_rows"))
    stop = (F.when(F.col("last_products") < page_size, "short_page")
            .when(F.col("pages_fetched") >= page_budget, "page_budget").otherwise("unproven"))
    return ends.join(found, "category_path").withColumn("stop_reason", stop).drop("last_products")


# -- catalog matching ----------------------------------------------------------------
def identity_keys(sku: Column, url: Column, ean: Column) -> dict[str, Column]:
    return {"sku": folded(sku), "url": normalized_product_url(url), "ean": folded(ean)}


def first_key(keys: dict[str, Column]) -> Column:
    return F.coalesce(*[F.concat(F.lit(f"{k}:"), v) for k, v in keys.items()])


def duplicate_numbering(candidates: DataFrame, key: Column, order: Column) -> DataFrame:
    """Marks the second and later rows of an identity.

    The first row of each identity comes from an aggregate, so an identity shared
    by many rows is never gathered in one task. Rows without an identity join nothing
    and are spread by the hash of their order.
    """
    keyed = candidates.withColumn("_key", key).withColumn("_ord", order).withColumn(
        "_spread", F.when(F.col("_key").isNull(), F.xxhash64("_ord")).otherwise(F.xxhash64("_key")))
    first = keyed.filter(F.col("_key").isNotNull()).groupBy("_key", "_spread").agg(F.min("_ord").alias("_first"))
    return keyed.join(first, ["_key", "_spread"], "left").withColumn(
        "is_duplicate", F.coalesce(F.col("_ord") > F.col("_first"), F.lit(False))).drop("_key", "_ord", "_first", "_spread")


def catalog_comparison(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """known, conflict, likely_missing or insufficient per candidate.

    Both sides have id, source, sku_id, product_url, ean. Per kind of key the
    catalog is reduced to one row per (source, value) with its lowest and highest
    row id, so a value shared by many rows adds a single row to the join and
    several matched rows still show as a conflict. Values are compared for exact
    equality within a source.
    """
    keys = identity_keys(F.col("sku_id"), F.col("product_url"), F.col("ean"))
    joined = candidates.select("id", "source", *[v.alias(f"{k}_key") for k, v in keys.items()])
    for kind, value in keys.items():
        index = catalog.select("source", F.col("id").alias("row"), value.alias(f"{kind}_key")).filter(
            F.col(f"{kind}_key").isNotNull()).groupBy("source", f"{kind}_key").agg(
            F.min("row").alias(f"{kind}_low"), F.max("row").alias(f"{kind}_high"))
        joined = joined.join(index, ["source", f"{kind}_key"], "left")
    low = F.least(*[F.col(f"{k}_low") for k in KINDS])  # least and greatest skip nulls
    high = F.greatest(*[F.col(f"{k}_high") for k in KINDS])
    usable = reduce(Column.__or__, [F.col(f"{k}_key").isNotNull() for k in KINDS])
    status = (F.when(~usable, "insufficient").when(low.isNull(), "likely_missing").when(low != high, "conflict").otherwise("known"))
    hits = F.filter(F.array(*[F.when(F.col(f"{k}_low").isNotNull(), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    return joined.withColumn("status", status).select(
        "id", "source", "status", F.when(F.col("status") == "known", F.get(hits, F.lit(0))).alias("matched_by"),
        F.when(F.col("status") == "conflict", F.array_join(hits, ",")).alias("conflict_kinds"))


def comparison_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("source", "status", "matched_by").agg(F.count("*").alias("rows"))


def comparison_samples(compared: DataFrame, size: int = 25) -> DataFrame:
    """The first ``size`` rows by id of every source and status, for a look by hand."""
    first = Window.partitionBy("source", "status").orderBy("id")
    return compared.withColumn("position", F.row_number().over(first)).filter(F.col("position") <= size)


# -- sampling ------------------------------------------------------------------------
def stratified_sample(candidates: DataFrame, seed: str, size: int) -> DataFrame:
    """Deterministic sample over category paths, ordered by hash inside each path.

    Every path gets its floor share but at least one; the rest goes to the largest
    remainders until each path is used up, a surplus is taken from the smallest
    remainders down to one. With more paths than the sample, hash-chosen paths get one.
    The allocation runs on at most ``size`` paths.
    """
    if not seed.strip() or size <= 0:
        raise ValueError("sampling needs a seed and a positive size")
    # a row without any of these is told apart by everything it holds
    whole = F.concat(F.lit("candidate:"), record_hash(candidates.columns))
    identity = canonical_identity(*[F.col(c) for c in ("sku_id", "product_url", "ean", "identity_kind", "identity", "name")], whole)
    rows = candidates.withColumns({"category_path": folded(F.col("category_path")), "candidate_identity": identity}).filter(
        F.col("category_path").isNotNull())
    strata = rows.groupBy("category_path").agg(F.count("*").alias("n"))
    totals = strata.agg(F.struct(F.count("*").alias("strata"), F.coalesce(F.sum("n"), F.lit(0)).alias("eligible"))).scalar()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), "category_path"), 256)
    chosen = strata.withColumn("_order", order).orderBy("_order", "category_path").limit(size).withColumn("t", totals)
    target = F.least(F.lit(size), F.col("t.eligible"))
    exact = F.col("n") / F.col("t.eligible") * F.col("target")
    shares = (
        chosen.withColumn("target", target).withColumn("exact", exact)
        .withColumn("base", F.least(F.col("n"), F.greatest(F.lit(1).cast("bigint"), F.floor("exact"))))
        .withColumns({"remainder": F.col("exact") - F.floor("exact"), "capacity": F.col("n") - F.col("base")})
        .withColumn("open", F.col("target") - F.sum("base").over(Window.partitionBy()))
    )
    more = Window.orderBy(F.desc("remainder"), F.asc("category_path"))
    less = Window.orderBy(F.asc("remainder"), F.desc("category_path"))
    given = F.least(F.col("capacity"), F.greatest(F.lit(0).cast("bigint"), F.col("open") - (F.sum("capacity").over(more) - F.col("capacity"))))
    spare = F.col("base") - 1
    taken = F.least(spare, F.greatest(F.lit(0).cast("bigint"), -F.col("open") - (F.sum(spare).over(less) - spare)))
    share = F.when(F.col("t.strata") > size, F.lit(1).cast("bigint")).when(F.col("open") >= 0, F.col("base") + given).otherwise(F.col("base") - taken)
    allocation = shares.withColumn("share", share).select("category_path", "share")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), "category_path", F.lit(":"), "candidate_identity"), 256)
    within = Window.partitionBy("category_path").orderBy("_key", "candidate_identity", "id")
    ranked = rows.withColumn("_key", key).withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= size)
    picked = ranked.join(allocation, "category_path").filter(F.col("rank") <= F.col("share"))
    # at most ``size`` rows are left
    return picked.withColumn("sample_index", F.row_number().over(Window.orderBy("category_path", "rank")).cast("bigint")).drop("_key", "rank", "share")


def triage_class() -> Column:
    """Class of a reviewed item by precedence of its signals (class names are fixed values)."""
    return (F.when(F.col("artifact"), "source_or_candidate_artifact")
            .when(F.col("alternate_identity"), "already_present_alternate_identity")
            .when(F.col("variant"), "equivalent_variant_or_pack")
            .when(F.col("valid"), "valid_investigation_candidate").otherwise("insufficient_evidence"))


def triage_counts(sample: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed sample items per class; an item without a review is an error."""
    signal = ("artifact", "alternate_identity", "variant", "valid")
    joined = sample.join(reviews.select("candidate_identity", *signal, F.lit(True).alias("_seen")), "candidate_identity", "left")
    missing = F.raise_error(F.lit("sample item without review")).cast("string")
    return joined.groupBy(F.when(F.col("_seen"), triage_class()).otherwise(missing).alias("classification")).agg(
        F.count("*").alias("items"))


# -- denominators ------------------------------------------------------------------------
def denominator_snapshot(products: DataFrame) -> DataFrame:
    """kept, missing_ean or duplicate per fetched row; the first row of a source+EAN+SKU is kept."""
    ean, sku = clean(F.col("ean")), F.coalesce(clean(F.col("sku_id")), F.lit("no-sku"))
    key = F.when(ean.isNotNull(), F.concat_ws(":", "source", ean, sku))
    marked = duplicate_numbering(products, key, F.col("id"))
    return marked.withColumn("outcome", F.when(ean.isNull(), "missing_ean").when(F.col("is_duplicate"), "duplicate").otherwise("kept"))


def denominator_audit(candidates: DataFrame, numerator: DataFrame, requested: list[str]) -> DataFrame:
    """(source, reason, rows): set-level findings of a denominator.

    A denominator is the distinct source+EAN of rows that are not excluded; every
    numerator key must be in it.
    """
    checks = reasons([
        ("source_not_requested", ~F.col("source").isin(requested)),
        ("missing_ean", clean(F.col("ean")).isNull()), ("lineage_missing", F.col("lineage_source").isNull() & F.col("artifact_sha256").isNull()),
        ("lineage_source_mismatch", F.col("lineage_source") != F.col("source")), ("lineage_without_time", F.col("fetched_at").isNull()),
        ("lineage_without_hash", ~F.coalesce(F.col("artifact_sha256").rlike("^sha256:[a-f0-9]{64}$"), F.lit(False))),
        ("exclusion_without_reason", F.col("excluded") & clean(F.col("exclusion_reason")).isNull())])
    found = candidates.select("source", F.explode(checks).alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("rows"))
    denominator = candidates.filter(~F.col("excluded")).select("source", "ean").distinct()
    outside = numerator.select("source", "ean").distinct().join(denominator, ["source", "ean"], "left_anti").groupBy("source").agg(
        F.count("*").alias("rows")).select("source", F.lit("numerator_outside").alias("reason"), "rows")
    return found.unionByName(outside)


def denominator_counts(candidates: DataFrame) -> DataFrame:
    pairs = candidates.groupBy("source", "ean").agg(
        F.count("*").alias("n"), F.count_if("excluded").alias("x"))
    return pairs.groupBy("source").agg(
        F.sum("n").alias("candidate_rows"), F.sum("x").alias("excluded_rows"), F.count_if(F.col("n") > F.col("x")).alias("denominator"))


# -- fingerprints --------------------------------------------------------------------------
def snapshot_fingerprint(hashed: DataFrame, group: str, row_hash: str) -> DataFrame:
    """Order-free fingerprint of all row hashes of a group.

    Four 60-bit words of each SHA-256 are added up and the sums hashed with the row
    count, so a batch of any size needs only partial sums, never a sorted list.
    """
    words = [F.sum(F.conv(F.substring(F.col(row_hash), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(4)]
    sums = hashed.groupBy(group).agg(F.count("*").alias("rows"), *words)
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(4)])
    return sums.select(group, "rows", F.sha2(text, 256).alias("fingerprint"))
