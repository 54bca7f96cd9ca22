"""Identity, coverage, sampling and denominator queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import candidate_identity, canonical_identity, four_decimals, idempotency_key, record_hash
from ..functions.web import normalized_product_url, url_host
from ..operators import identity as op
from ..sources.derive import Tables, slug_of
from .registry import DERIVED, query

DERIVED["cands"] = (("observations", "products"), """
  SELECT o.id, 'Market-' || supermarket_id AS source, CASE WHEN linenumber % 2 = 0 THEN 'Search' ELSE 'category' END AS surface,
    CASE WHEN orderkey % 5 <> 0 THEN o.ean END AS ean, CASE WHEN orderkey % 7 <> 0 THEN 'SKU-' || p.partkey END AS sku_id, NULL::varchar AS product_id,
    CASE WHEN orderkey % 3 <> 0 THEN 'https://www.Market-' || supermarket_id || '.example.com/Item-' || p.partkey || '/p/?utm=' || linenumber END AS url,
    CASE WHEN orderkey % 105 <> 0 THEN ' ' || p.name END AS name, p.category || '/' || p.brand AS category_path, scraped_at, o.orderkey, o.linenumber
  FROM observations o JOIN products p USING (ean)""")
_IDENT = """CASE WHEN ean IS NOT NULL THEN 'ean:' || ean WHEN sku_id IS NOT NULL THEN 'skuId:' || lower(sku_id)
  WHEN url IS NOT NULL THEN 'url:' || lower(url) WHEN name IS NOT NULL THEN 'name:' || lower(trim(name)) END"""
_ID_SQL = f"""ids AS (SELECT *, lower(source) AS src, lower(surface) AS srf, {_IDENT} AS ident FROM cands),
per AS (SELECT src, srf, ident, count(*) AS n FROM ids GROUP BY 1, 2, 3)"""
_NORM_URL = "regexp_extract(lower({0}), '^[a-z]+://([^/:?#]+)', 1) || coalesce(nullif(regexp_replace(regexp_extract(lower({0}), '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/')"


def cands(t: Tables) -> DataFrame:
    o = F.col("orderkey")
    p = t.products.select("ean", "partkey", "name", "category", "brand")
    k, m = F.col("partkey").cast("string"), F.col("supermarket_id").cast("string")
    return t.observations.join(p, "ean").select(
        "id", F.concat(F.lit("Market-"), m).alias("source"), F.when(F.col("linenumber") % 2 == 0, "Search").otherwise("category").alias("surface"),
        F.when(o % 5 != 0, F.col("ean")).alias("ean"), F.when(o % 7 != 0, F.concat(F.lit("SKU-"), k)).alias("sku_id"),
        F.lit(None).cast("string").alias("product_id"),
        F.when(o % 3 != 0, F.concat(F.lit("https://www.Market-"), m, F.lit(".example.com/Item-"), k, F.lit("/p/?utm="), F.col("linenumber").cast("string"))).alias("url"),
        F.when(o % 105 != 0, F.concat(F.lit(" "), F.col("name"))).alias("name"),
        F.concat("category", F.lit("/"), "brand").alias("category_path"), "scraped_at", "orderkey", "linenumber")


@query("d23_url_hosts", "D23", "", r"""
SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^www\.', ''), '') AS host FROM pages""")
def url_hosts(t):
    return t.urls.select("page_id", url_host(F.col("url")).alias("host"))


@query("d24_normalized_urls", "D24", "", f"SELECT page_id, {_NORM_URL.format('url')} AS normalized FROM pages")
def normalized_urls(t):
    return t.urls.select("page_id", normalized_product_url(F.col("url")).alias("normalized"))


@query("d25_candidate_identity", "D25", "cands", f"SELECT id, {_IDENT} AS identity FROM cands")
def candidate_identities(t):
    ident = candidate_identity(ean=F.col("ean"), skuId=F.col("sku_id"), productId=F.col("product_id"), url=F.col("url"), name=F.col("name"))
    return cands(t).select("id", F.concat_ws(":", ident["kind"], ident["value"]).alias("identity")).withColumn(
        "identity", F.nullif("identity", F.lit("")))


_CANON = f"""CASE WHEN sku_id IS NOT NULL THEN 'sku:' || lower(sku_id) WHEN url IS NOT NULL THEN 'url:' || {_NORM_URL.format('url')}
  WHEN ean IS NOT NULL THEN 'ean:' || ean WHEN name IS NOT NULL THEN 'name:' || lower(trim(name)) ELSE 'none' END"""


@query("d26_canonical_identity", "D26", "cands", f"SELECT id, {_CANON} AS identity FROM cands")
def canonical_identities(t):
    none = F.lit(None).cast("string")
    ident = canonical_identity(F.col("sku_id"), F.col("url"), F.col("ean"), none, none, F.col("name"))
    return cands(t).select("id", F.when(F.startswith(ident, F.lit("hash:")), "none").otherwise(ident).alias("identity"))


@query("d27_idempotency_keys", "D27", "cands", """
SELECT id, CASE WHEN length(k) > 60 THEN 'discovery:' || sha256(k) ELSE k END AS key
FROM (SELECT id, 'discovery:' || source || ':' || coalesce(ean, repeat('9', 40)) || ':' || coalesce(sku_id, 'no-sku') AS k FROM cands)""")
def idempotency_keys(t):
    long_ean = F.coalesce(F.col("ean"), F.lit("9" * 40))
    return cands(t).select("id", idempotency_key(F.col("source"), long_ean, F.col("sku_id"), 60).alias("key"))


@query("e21_coverage_by_surface", "E21", "cands", f"""WITH {_ID_SQL}
SELECT src AS source, srf AS surface, sum(n)::bigint AS candidate_rows, count(ident) AS identities, coalesce(sum(n - 1) FILTER (ident IS NOT NULL), 0)::bigint AS duplicate_rows,
  coalesce(sum(n) FILTER (ident IS NULL), 0)::bigint AS ambiguous_rows FROM per GROUP BY 1, 2""")
def coverage_by_surface(t):
    return op.coverage_by_surface(cands(t))


@query("e21_source_budgets", "E21", "cands", """
SELECT lower(source) AS source, count(*) AS used, CASE WHEN count(*) <= 10000 THEN 'PASS' ELSE 'FAIL' END AS status FROM cands GROUP BY 1""")
def source_budgets(t):
    return op.source_budgets(op.coverage_by_surface(cands(t)), 10000)


@query("e22_surface_overlaps", "E22", "cands", f"""WITH {_ID_SQL}
SELECT src AS source, ident AS identity, string_agg(srf, ',' ORDER BY srf) AS surfaces FROM per WHERE ident IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def surface_overlaps(t):
    return op.surface_overlaps(cands(t)).withColumn("surfaces", F.array_join("surfaces", ","))


_PAGES_SQL = f"pages2 AS (SELECT *, orderkey % 9 AS page, {_IDENT} AS ident FROM cands WHERE category_path IS NOT NULL)"


@query("e23_pagination_rollup", "E23", "cands", f"""WITH {_PAGES_SQL},
pp AS (SELECT category_path, page, count(*) AS products FROM pages2 GROUP BY 1, 2),
ends AS (SELECT category_path, count(*) AS pages_fetched, arg_max(products, page) AS last_products FROM pp GROUP BY 1),
per AS (SELECT category_path, ident, count(*) AS n FROM pages2 GROUP BY 1, 2),
found AS (SELECT category_path, count(ident) AS identities, coalesce(sum(n - 1) FILTER (ident IS NOT NULL), 0)::bigint AS duplicate_rows, coalesce(sum(n) FILTER (ident IS NULL), 0)::bigint AS ambiguous_rows FROM per GROUP BY 1)
SELECT category_path, pages_fetched, identities, duplicate_rows, ambiguous_rows, CASE WHEN last_products < 40 THEN 'short_page' WHEN pages_fetched >= 9 THEN 'page_budget' ELSE 'unproven' END AS stop_reason
FROM ends JOIN found USING (category_path)""")
def pagination_rollup(t):
    pages = cands(t).filter(F.col("category_path").isNotNull()).withColumn("page", F.col("orderkey") % 9)
    return op.pagination_rollup(pages, 40, 9)


@query("b10_category_paths", "B10", "cands", """
WITH rows AS (SELECT category_path AS path, row_number() OVER (ORDER BY category_path) AS n FROM cands WHERE category_path IS NOT NULL AND NOT regexp_matches(category_path, '^(ECONOMY|LARGE)/'))
SELECT path FROM (SELECT DISTINCT path FROM rows WHERE n > 20) ORDER BY path LIMIT 12""")
def category_paths(t):
    categories = cands(t).filter(F.col("category_path").isNotNull()).select(F.col("category_path").alias("path"))
    return op.select_category_paths(categories, "^(ECONOMY|LARGE)/", 20, 12)


_DUP_KEY = f"CASE WHEN sku_id IS NOT NULL THEN 'sku:' || lower(sku_id) WHEN url IS NOT NULL THEN 'url:' || {_NORM_URL.format('url')} WHEN ean IS NOT NULL THEN 'ean:' || ean END"


@query("f11_duplicate_numbering", "F11", "cands", f"""
SELECT id, coalesce(key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY id) > 1, false) AS is_duplicate FROM (SELECT id, source || '|' || {_DUP_KEY} AS key FROM cands)""")
def duplicate_numbering(t):
    key = op.first_key(op.identity_keys(F.col("sku_id"), F.col("url"), F.col("ean")))
    return op.duplicate_numbering(cands(t), F.concat("source", F.lit("|"), key), F.col("id")).select("id", "is_duplicate")


_CMP_SQL = f"""
cat AS (SELECT id AS cid, 'Market-' || supermarket_id AS source, lower(sku_id) AS sku, {_NORM_URL.format('product_url')} AS url, product_ean AS ean FROM state_sp),
keys AS (SELECT source, 'sku' AS kind, sku AS v, cid FROM cat WHERE sku IS NOT NULL UNION ALL SELECT source, 'url', url, cid FROM cat UNION ALL SELECT source, 'ean', ean, cid FROM cat),
want AS (SELECT id, source, 0 AS rank, 'sku' AS kind, lower(sku_id) AS v FROM cands WHERE sku_id IS NOT NULL UNION ALL
  SELECT id, source, 1, 'url', {_NORM_URL.format('url')} FROM cands WHERE url IS NOT NULL UNION ALL SELECT id, source, 2, 'ean', ean FROM cands WHERE ean IS NOT NULL),
hit AS (SELECT w.id, count(DISTINCT cid) AS rows, arg_min(w.kind, w.rank) AS first FROM want w JOIN keys k USING (source, kind, v) GROUP BY 1),
compared AS (SELECT c.id, c.source, CASE WHEN sku_id IS NULL AND url IS NULL AND ean IS NULL THEN 'insufficient' WHEN rows IS NULL THEN 'likely_missing' WHEN rows > 1 THEN 'conflict' ELSE 'known' END AS status,
  CASE WHEN rows = 1 THEN first END AS matched_by, rows FROM cands c LEFT JOIN hit USING (id))"""


def compared(t: Tables) -> DataFrame:
    catalog = t.state_supermarket_products.select(
        "id", F.concat(F.lit("Market-"), F.col("supermarket_id").cast("string")).alias("source"), "sku_id", "product_url", F.col("product_ean").alias("ean"))
    return op.catalog_comparison(cands(t).withColumnRenamed("url", "product_url"), catalog)


@query("c11_catalog_comparison", "C11 K6", "cands state_sp", f"WITH {_CMP_SQL} SELECT id, source, status, matched_by FROM compared")
def catalog_comparison(t):
    return compared(t).drop("conflict_kinds")


@query("k06_comparison_counts", "K6", "cands state_sp", f"WITH {_CMP_SQL} SELECT source, status, matched_by, count(*) AS rows FROM compared GROUP BY 1, 2, 3")
def comparison_counts(t):
    return op.comparison_counts(compared(t))


@query("k06_comparison_samples", "K6", "cands state_sp", f"""WITH {_CMP_SQL}
SELECT source, status, row_number() OVER (PARTITION BY source, status ORDER BY id) AS position, id, matched_by FROM compared QUALIFY position <= 25""")
def comparison_samples(t):
    return op.comparison_samples(compared(t)).select("source", "status", F.col("position").cast("bigint").alias("position"), "id", "matched_by")


_ROW_FIELDS = {"id": "id", "source": "source", "surface": "surface", "ean": "ean", "sku_id": "sku_id", "product_id": "product_id", "product_url": "url",
               "name": "name", "category_path": "category_path", "scraped_at": "scraped_at", "orderkey": "orderkey", "linenumber": "linenumber",
               "identity_kind": "NULL", "identity": "NULL"}
_ROW_HASH = "sha256(concat_ws('|', " + ", ".join(f"'{n}=' || coalesce(({c})::varchar, '~')" for n, c in sorted(_ROW_FIELDS.items())) + "))"


def _sample_sql(size: int) -> str:
    return f"""
r AS (SELECT id, lower(category_path) AS path, {_CANON.replace("ELSE 'none'", f"ELSE 'candidate:' || {_ROW_HASH}")} AS ident FROM cands WHERE category_path IS NOT NULL),
strata AS (SELECT path, count(*) AS n FROM r GROUP BY 1),
tot AS (SELECT count(*) AS strata, sum(n)::bigint AS eligible FROM strata),
chosen AS (SELECT s.*, t.strata AS ns, t.eligible, least({size}, t.eligible) AS target FROM strata s, tot t ORDER BY sha256('seed-1:' || path), path LIMIT {size}),
sh AS (SELECT *, n::double / eligible * target AS exact, least(n, greatest(1, floor(n::double / eligible * target)))::bigint AS base FROM chosen),
sh2 AS (SELECT *, exact - floor(exact) AS rem, n - base AS cap, target - sum(base) OVER () AS open FROM sh),
sh3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY rem DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capb,
  coalesce(sum(base - 1) OVER (ORDER BY rem, path DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spb FROM sh2),
alloc AS (SELECT path, CASE WHEN ns > {size} THEN 1 WHEN open >= 0 THEN base + least(cap, greatest(0, open - capb)) ELSE base - least(base - 1, greatest(0, -open - spb)) END AS share FROM sh3),
rk AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sha256('seed-1:' || path || ':' || ident), ident, id) AS rank FROM r),
sample AS (SELECT id, path AS category_path, ident AS candidate_identity, row_number() OVER (ORDER BY path, rank) AS sample_index FROM rk JOIN alloc USING (path) WHERE rank <= share)"""


def sampled(t: Tables, size: int) -> DataFrame:
    rows = cands(t).withColumnRenamed("url", "product_url").withColumns({
        "identity_kind": F.lit(None).cast("string"), "identity": F.lit(None).cast("string")})
    return op.stratified_sample(rows, "seed-1", size)


@query("f13_stratified_sample", "F13", "cands", f"WITH {_sample_sql(400)} SELECT * FROM sample")
def stratified_sample(t):
    return sampled(t, 400).select("id", "category_path", "candidate_identity", "sample_index")


@query("f13_hash_chosen_strata", "F13", "cands", f"WITH {_sample_sql(50)} SELECT * FROM sample")
def hash_chosen_strata(t):
    return sampled(t, 50).select("id", "category_path", "candidate_identity", "sample_index")


@query("k07_triage_counts", "K7", "cands", f"""WITH {_sample_sql(400)}
SELECT CASE WHEN length(candidate_identity) % 5 = 0 THEN 'source_or_candidate_artifact' WHEN length(category_path) % 3 = 0 THEN 'already_present_alternate_identity'
  WHEN length(category_path) % 4 = 0 THEN 'equivalent_variant_or_pack' WHEN length(candidate_identity) % 2 = 0 THEN 'valid_investigation_candidate' ELSE 'insufficient_evidence' END AS classification,
  count(*) AS items FROM sample GROUP BY 1""")
def triage_counts(t):
    sample = sampled(t, 400)
    i, c = F.length("candidate_identity"), F.length("category_path")
    reviews = sample.groupBy("candidate_identity").agg(F.min("category_path").alias("category_path")).select(
        "candidate_identity", (i % 5 == 0).alias("artifact"), (c % 3 == 0).alias("alternate_identity"), (c % 4 == 0).alias("variant"), (i % 2 == 0).alias("valid"))
    return op.triage_counts(sample.select("candidate_identity"), reviews)


# -- denominators --------------------------------------------------------------------------------
@query("k09_denominator_snapshot", "K9", "cands", """
SELECT id, CASE WHEN ean IS NULL THEN 'missing_ean' WHEN row_number() OVER (PARTITION BY source, ean, coalesce(sku_id, 'no-sku') ORDER BY id) > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM cands""")
def denominator_snapshot(t):
    return op.denominator_snapshot(cands(t)).select("id", "outcome")


def denominator_rows(t: Tables) -> DataFrame:
    o = F.col("orderkey")
    return cands(t).select(
        "source", "ean", F.when(o % 23 != 0, F.when(o % 29 == 0, F.lit("other")).otherwise(F.col("source"))).alias("lineage_source"),
        F.when(o % 31 != 0, F.col("scraped_at")).alias("fetched_at"),
        F.when(o % 23 != 0, F.concat(F.lit("sha256:"), F.sha2("id", 256))).alias("artifact_sha256"),
        (o % 13 == 0).alias("excluded"), F.when(o % 26 == 0, "closed").alias("exclusion_reason"))


_DEN_SQL = """den AS (SELECT source, ean, CASE WHEN orderkey % 23 <> 0 THEN CASE WHEN orderkey % 29 = 0 THEN 'other' ELSE source END END AS lineage_source,
  CASE WHEN orderkey % 31 <> 0 THEN scraped_at END AS fetched_at, CASE WHEN orderkey % 23 <> 0 THEN 'sha256:' || sha256(id) END AS artifact, orderkey % 13 = 0 AS excluded,
  CASE WHEN orderkey % 26 = 0 THEN 'closed' END AS why FROM cands)"""


@query("e36_denominator_audit", "E36", "cands sp", f"""WITH {_DEN_SQL},
f AS (SELECT source, unnest(list_filter([CASE WHEN source = 'Market-5' THEN 'source_not_requested' END, CASE WHEN ean IS NULL THEN 'missing_ean' END,
  CASE WHEN lineage_source IS NULL AND artifact IS NULL THEN 'lineage_missing' END, CASE WHEN lineage_source <> source THEN 'lineage_source_mismatch' END, CASE WHEN fetched_at IS NULL THEN 'lineage_without_time' END,
  CASE WHEN artifact IS NULL THEN 'lineage_without_hash' END, CASE WHEN excluded AND why IS NULL THEN 'exclusion_without_reason' END], lambda x: x IS NOT NULL)) AS reason FROM den),
num AS (SELECT DISTINCT 'Market-' || supermarket_id AS source, product_ean AS ean FROM sp)
SELECT source, reason, count(*) AS rows FROM f GROUP BY 1, 2
UNION ALL SELECT source, 'numerator_outside', count(*) FROM num WHERE NOT EXISTS (SELECT 1 FROM den d WHERE NOT excluded AND d.source = num.source AND d.ean = num.ean) GROUP BY 1""")
def denominator_audit(t):
    numerator = t.supermarket_products.select(
        F.concat(F.lit("Market-"), F.col("supermarket_id").cast("string")).alias("source"), F.col("product_ean").alias("ean"))
    return op.denominator_audit(denominator_rows(t), numerator, [f"Market-{i}" for i in range(5)])


@query("e36_denominator_counts", "E36", "cands", f"""WITH {_DEN_SQL}
SELECT source, count(*) AS candidate_rows, count(*) FILTER (excluded) AS excluded_rows, count(DISTINCT coalesce(ean, '-')) FILTER (NOT excluded) AS denominator FROM den GROUP BY 1""")
def denominator_counts(t):
    return op.denominator_counts(denominator_rows(t))


# -- hashes ---------------------------------------------------------------------------------------
_HASH_COLUMNS = ["ean", "images", "is_available", "list_price", "name", "price", "sku_id"]
_HASH_SQL = """hashed AS (SELECT id, source_slug, sha256('ean=' || ean || '|images=' || array_to_string(list_sort(images), ',') || '|is_available=' || is_available
  || '|list_price=' || list_price::decimal(18,4) || '|name=' || name || '|price=' || coalesce(price::decimal(18,4)::varchar, '~') || '|sku_id=' || coalesce(sku_id, '~')) AS row_hash FROM batch)"""


def hashed(t: Tables) -> DataFrame:
    rows = t.batch_candidates.withColumns({"price": four_decimals(F.col("price")), "list_price": four_decimals(F.col("list_price"))})
    return rows.select("id", "source_slug", record_hash(_HASH_COLUMNS, ("images",)).alias("row_hash"))


@query("d35_record_hashes", "D35", "batch", f"WITH {_HASH_SQL} SELECT id, row_hash FROM hashed")
def record_hashes(t):
    return hashed(t).select("id", "row_hash")


@query("e24_snapshot_fingerprints", "E24", "batch", f"""WITH {_HASH_SQL},
s AS (SELECT source_slug, count(*) AS rows, {', '.join(f"sum(('0x' || substr(row_hash, {1 + 15 * i}, 15))::bigint)::hugeint AS w{i}" for i in range(4))} FROM hashed GROUP BY 1)
SELECT source_slug, rows, sha256(rows || ':' || w0 || ':' || w1 || ':' || w2 || ':' || w3) AS fingerprint FROM s""")
def snapshot_fingerprints(t):
    return op.snapshot_fingerprint(hashed(t), "source_slug", "row_hash")
