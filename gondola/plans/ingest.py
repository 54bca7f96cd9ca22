"""Ingestion queries: payloads to candidates, verdicts, and the batch merge."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import loose_number
from ..functions.quality import completeness
from ..functions.text import CATEGORY_KEYWORDS, STOP_WORDS, UNIT_PATTERN
from ..operators import catalog, ingest, merge
from ..sources import payloads
from ..sources.derive import NOW, STATE_AT, Tables, ean_of, slug_of
from ..sources import landed as files
from ..sources.stable import shared_folder
from .registry import query


def infer_sql(column: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + f" THEN '{name}'"
        for name, _, words in CATEGORY_KEYWORDS)
    return f"CASE {cases} END"


_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = (f"list_filter(string_split({_NORM}, ' '), lambda x: len(x) >= 3 AND x NOT IN ({_STOP}) "
           f"AND NOT regexp_matches(x, '{UNIT_PATTERN}'))")


def expand_sql(column: str) -> str:
    tokens, full = _TOKENS.format(column), _NORM.format(column)
    return f"""list_filter([CASE WHEN len({tokens}) >= 2 THEN array_to_string({tokens}[1:2], ' ') END,
      CASE WHEN len({tokens}) >= 3 THEN array_to_string({tokens}[1:3], ' ') END,
      {tokens}[1], CASE WHEN {full} <> '' THEN {full} END], lambda x: x IS NOT NULL)"""


# -- payloads ---------------------------------------------------------------------
def candidates_from_payloads(t: Tables) -> DataFrame:
    found = payloads.find_product_records(t.raw_payloads.select("payload_id", "source_slug", "base_url", "raw"))
    return payloads.normalize_payloads(found)


@query("a03_normalized_payloads", "A2 A3 D1 D2 D3 D4 D5 D6 D7 D8 D9 D10", "sp products supermarkets", f"""
SELECT sp.id AS payload_id, s.slug AS source_slug, 0 AS pos, p.ean, p.name, p.brand, p.description, p.image_url,
  array_to_string(p.images, '|') AS images, coalesce({infer_sql('p.name')}, p.category) AS category, sp.sku_id, sp.seller_id,
  'https://www.market-' || sp.supermarket_id || '.example.com/item-' || p.partkey || '/p' AS product_url,
  sp.price::double AS price, sp.list_price::double AS list_price, NULL::double AS reference_price, NULL::varchar AS reference_unit, sp.is_available
FROM sp JOIN products p ON p.ean = sp.product_ean JOIN supermarkets s ON s.id = sp.supermarket_id""")
def normalized_payloads(t):
    return candidates_from_payloads(t).withColumn("images", F.array_join("images", "|"))


@query("a02_nested_payload_records", "A2", "sp products", """
SELECT product_ean AS request, pos, CASE WHEN pos = 0 THEN name ELSE 'nested ' || name END AS product_name
FROM (SELECT DISTINCT product_ean, name FROM sp JOIN products ON ean = product_ean), (VALUES (0), (1)) v(pos)""")
def nested_payload_records(t):
    """Products hidden at different depths of one answer, one of them inside the other."""
    names = t.supermarket_products.select(F.col("product_ean").alias("request")).distinct().join(
        t.products.select(F.col("ean").alias("request"), "name"), "request")
    inner = F.struct(F.concat(F.lit("nested "), F.col("name")).alias("productName"))
    body = F.struct(F.struct(F.array(F.struct(
        F.col("name").alias("productName"), F.struct(F.array(inner).alias("list")).alias("related"))).alias("products")
    ).alias("data"), F.lit(3).alias("total"))
    found = payloads.find_product_records(names.select("request", F.to_json(body).alias("raw")))
    return found.select("request", "pos", F.get_json_object("record", "$.productName").alias("product_name"))


@query("d01_strip_html", "D1", "", r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x{A0}]+', ' ', 'g'))) AS digest,
  length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x{A0}]+', ' ', 'g'))) AS chars FROM pages WHERE html <> ''""")
def strip_html(t):
    plain = tx.strip_html(F.col("html"))
    return t.raw("pages").filter("html <> ''").select(
        "page_id", F.md5(plain).alias("digest"), F.length(plain).cast("bigint").alias("chars"))


@query("d02_loose_numbers", "D2", "", """
SELECT l_orderkey AS orderkey, sum(coalesce(l_extendedprice, 0))::decimal(18,2)::double AS total, count(*) AS n,
  0 AS unreadable FROM lineitem GROUP BY 1""")
def loose_numbers(t):
    text = F.regexp_replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), r"\.", ",")
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("orderkey"), loose_number(text).alias("x"))
    return rows.groupBy("orderkey").agg(
        F.sum(F.col("x").cast("decimal(18,2)")).cast("decimal(18,2)").cast("double").alias("total"), F.count("*").alias("n"),
        F.count_if(F.col("x").isNull()).alias("unreadable"))


@query("d09_category_from_text", "D9", "", f"SELECT doc_id, {infer_sql('text')} AS category FROM documents")
def category_from_text(t):
    return t.texts.select("doc_id", tx.category_from_text(F.col("text")).alias("category"))


@query("d31_query_tokens", "D31", "", f"SELECT doc_id, len({_TOKENS.format('text')}) AS tokens, "
       f"md5(array_to_string({_TOKENS.format('text')}, ' ')) AS digest FROM documents")
def query_tokens(t):
    tokens = tx.query_tokens(F.col("text"))
    return t.texts.select("doc_id", F.size(tokens).cast("bigint").alias("tokens"),
                          F.md5(F.array_join(tokens, " ")).alias("digest"))


@query("d32_expanded_terms", "D32", "products", f"""
SELECT ean, string_agg(term, '|' ORDER BY first) AS terms FROM (
  SELECT ean, term, min(i) AS first FROM (SELECT ean, unnest(x) AS term, generate_subscripts(x, 1) AS i
    FROM (SELECT ean, {expand_sql('description')} AS x FROM products WHERE description IS NOT NULL)) GROUP BY 1, 2) GROUP BY 1""")
def expanded_terms(t):
    rows = t.products.filter("description is not null")
    return rows.select("ean", F.array_join(tx.expand_terms(F.col("description")), "|").alias("terms"))


@query("g09_mined_terms", "G9", "products", f"""
WITH raw AS (SELECT DISTINCT ean, unnest(list_concat(
    coalesce({expand_sql('name')}, []), CASE WHEN brand IS NULL THEN [] ELSE {expand_sql('brand')} END,
    CASE WHEN category IS NULL THEN [] ELSE {expand_sql('category')} END)) AS term FROM products)
SELECT term, count(*) AS n FROM raw GROUP BY 1 ORDER BY n DESC, term LIMIT 40""")
def mined_terms(t):
    return ingest.mined_terms(t.products, 40)


@query("a04_last_fetch_wins", "A4 H1 H2", "observations", """
WITH f AS (SELECT 'market-' || supermarket_id AS source_slug, ean, orderkey AS term_ord, id, price FROM observations)
SELECT source_slug, ean, arg_max(price::double, (term_ord, id)) AS price, min(term_ord) AS term_ord,
  arg_min(id, (term_ord, id)) AS pos FROM f GROUP BY 1, 2""")
def last_fetch_wins(t):
    fetched = t.observations.select(
        F.concat(F.lit("market-"), F.col("supermarket_id").cast("string")).alias("source_slug"), "ean",
        F.col("orderkey").alias("term_ord"), F.col("id").alias("pos"), F.col("price").cast("double").alias("price"))
    return payloads.last_fetch_wins(fetched)


# words that stand in product names
SEARCH_TERMS = ("bolt", "red", "n")


@query("h01_union_of_terms", "H1 A4", "sp products", f"""
WITH found AS (SELECT 'market-' || supermarket_id AS source_slug, product_ean AS ean, t.i AS term_ord, sp.id AS pos, CASE WHEN t.i = 1 THEN list_price ELSE price END::double AS price
  FROM sp JOIN products ON ean = product_ean, (VALUES {", ".join(f"({i}, '{w}')" for i, w in enumerate(SEARCH_TERMS))}) t(i, word) WHERE contains(lower(name), word))
SELECT source_slug, ean, arg_max(price, (term_ord, pos)) AS price, min(term_ord) AS term_ord, arg_min(pos, (term_ord, pos)) AS pos, count(*) AS fetched FROM found GROUP BY 1, 2""")
def union_of_terms(t):
    """One answer per search term; the second term's answer shows list prices."""
    names = t.products.select(F.col("ean").alias("product_ean"), "name")
    rows = t.supermarket_products.join(names, "product_ean").select(
        slug_of(F.col("supermarket_id")).alias("source_slug"), F.col("product_ean").alias("ean"), F.col("id").alias("pos"), "name", "price", "list_price")
    answers = [rows.filter(F.contains(F.lower("name"), F.lit(word))).select(
        "source_slug", "ean", "pos", F.col("list_price" if i == 1 else "price").cast("double").alias("price")) for i, word in enumerate(SEARCH_TERMS)]
    fetched = payloads.union_of_terms(answers)
    counts = fetched.groupBy("source_slug", "ean").agg(F.count("*").alias("fetched"))
    return payloads.last_fetch_wins(fetched).join(counts, ["source_slug", "ean"])


@query("a05_allowlisted_rows", "A5 H4", "staging state_products", """
SELECT id, ean, floor(price::double*100+0.5)/100 AS price, 'PENDING' AS status FROM staging WHERE ean IN (SELECT ean FROM state_products)""")
def allowlisted_rows(t):
    kept = ingest.keep_listed_eans(t.staging_product, t.state_products)
    return ingest.staged(kept, F.col("run_id")).select("id", "ean", F.col("price").cast("double").alias("price"), "status")


@query("a08_fetch_outcomes", "A8", "", """
WITH log AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'ECONNABORTED' END AS code,
  CASE page_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 500 ELSE 200 END AS status,
  CASE WHEN page_id % 3 = 0 THEN '{"message":"PersistedQueryNotFound"}' WHEN page_id % 4 = 0 THEN '{"data":[]}' ELSE html END AS body FROM pages)
SELECT page_id, CASE WHEN code IS NOT NULL THEN 'timeout' WHEN body LIKE '{"message%' THEN 'hash_invalid'
  WHEN status IN (403, 429) OR (body NOT LIKE '{%' AND regexp_matches(lower(body), 'captcha|access denied|<html')) THEN 'blocked'
  WHEN status >= 400 THEN 'network' WHEN body NOT LIKE '{%' THEN 'unknown' END AS outcome FROM log""")
def fetch_outcomes(t):
    k = F.col("page_id")
    code = F.when(k % 10 == 0, "ECONNABORTED")
    status = F.when(k % 7 == 0, 403).when(k % 7 == 1, 429).when(k % 7 == 2, 500).otherwise(200)
    body = F.when(k % 3 == 0, '{"message":"PersistedQueryNotFound"}').when(k % 4 == 0, '{"data":[]}').otherwise(F.col("html"))
    log = t.raw("pages").select("page_id", code.alias("code"), status.alias("status"), body.alias("body"))
    return log.select("page_id", payloads.fetch_outcome(F.col("code"), F.col("status"), F.col("body")).alias("outcome"))


@query("a09_seeded_stores", "A9", "supermarkets", """
WITH seed AS (SELECT 'market-' || n_nationkey AS slug, n_name AS name, 'https://' || lower(n_name) || '.example.com' AS base_url FROM nation)
SELECT coalesce(s.id, (SELECT max(id) FROM supermarkets) + row_number() OVER (PARTITION BY s.id IS NULL ORDER BY d.slug)) AS id, coalesce(s.slug, d.slug) AS slug, coalesce(d.name, s.name) AS name, coalesce(d.base_url, s.base_url) AS base_url,
  coalesce(s.is_active, true) AS is_active, coalesce(s.freshness_sla_hours, 12) AS freshness_sla_hours
FROM supermarkets s FULL JOIN seed d ON d.slug = s.slug""")
def seeded_stores(t):
    seed = t.raw("nation").select(
        F.concat(F.lit("market-"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("name"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.com")).alias("base_url"))
    return merge.seed_dimension(t.supermarkets, seed)


@query("a10_category_payload_flatten", "A10", "", """
SELECT r_regionkey AS payload_id, r_regionkey::varchar AS id, r_name AS name, lower(r_name) AS path, '/' || lower(r_name) || '/' AS url FROM region
UNION ALL SELECT n_regionkey, n_name, n_name, 'all/' || n_nationkey, 'https://m.example.com/all/' || n_nationkey || '?o=1' FROM nation
UNION ALL SELECT n_regionkey, s_suppkey::varchar, s_name, replace(lower(s_name), '#', '-'), NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def category_payload_flatten(t):
    """A document of nations per region, and suppliers in documents of about twenty, below a node without a name."""
    nation = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("https://m.example.com/all/"), F.col("n_nationkey").cast("string"), F.lit("?o=1")).alias("url"))
    nations = t.raw("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(nation).alias("children"))
    tops = t.raw("region").join(nations, "r_regionkey", "left").select(
        F.col("r_regionkey").cast("bigint").alias("payload_id"), F.to_json(F.array(F.struct(
            F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"),
            F.concat(F.lit("/"), F.lower("r_name"), F.lit("/")).alias("url"), "children"))).alias("raw"))
    shop = F.struct(F.col("s_suppkey").cast("string").alias("Id"), F.col("s_name").alias("Name"))
    shops = t.raw("supplier").join(t.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy(
        F.col("n_regionkey").cast("bigint").alias("payload_id"), F.floor(F.col("s_suppkey") / 100)).agg(F.collect_list(shop).alias("children"))
    leaves = shops.select("payload_id", F.to_json(F.array(F.struct(F.array(F.struct("children")).alias("Children")))).alias("raw"))
    return payloads.flatten_category_trees(tops.unionByName(leaves))


@query("a11_artifact_candidates", "A11", "observations", """
SELECT id AS artifact_id, 0 AS pos, CASE WHEN linenumber % 2 = 0 THEN 'market-' || supermarket_id WHEN suppkey % 3 = 0 THEN 'other' ELSE 'shop' END AS source,
  CASE WHEN linenumber % 2 = 0 THEN 'search' ELSE 'category' END AS surface,
  linenumber % 2 = 1 AND suppkey % 3 = 0 AS conflict, ean,
  CASE WHEN orderkey % 2 = 0 THEN 'sku-' || orderkey END AS sku_id, NULL::varchar AS product_id, NULL::varchar AS url, NULL::varchar AS name,
  NULL::varchar AS category_path FROM observations""")
def artifact_candidates(t):
    own = F.when(F.col("linenumber") % 2 == 0, F.concat(F.lit("Market-"), F.col("supermarket_id").cast("string"))).when(
        F.col("suppkey") % 3 == 0, F.lit("Other"))
    row = F.struct(
        own.alias("source"), F.when(F.col("linenumber") % 2 == 0, F.lit("SEARCH")).alias("surface"), "ean",
        F.when(F.col("orderkey") % 2 == 0, F.concat(F.lit("sku-"), F.col("orderkey").cast("string"))).alias("skuId"))
    wrapped = F.to_json(F.struct(F.lit("Shop").alias("source"), F.lit("category").alias("surface"), F.array(row).alias("candidates")))
    body = F.concat(F.lit("﻿"), F.when(F.col("linenumber") % 2 == 0, F.to_json(F.array(row))).otherwise(wrapped))
    return payloads.read_artifacts(t.observations.select(F.col("id").alias("artifact_id"), body.alias("body")))


def landed(t: Tables, rows: DataFrame, name: str, whole: bool = False) -> DataFrame:
    """Documents written as lines of text files in the shared folder and read back."""
    path = f"{shared_folder(t.spark)}/landed-{name}-{uuid4().hex}"
    rows.select("body").write.text(path)
    return files.read_documents(t.spark, path, whole)


def landed_artifacts(t: Tables) -> DataFrame:
    """One artifact per order with its lines as candidates; one in 37 is cut off and one in 41 has no candidates."""
    k = F.col("orderkey")
    candidate = F.struct(
        F.when(F.col("linenumber") % 3 == 0, F.concat(F.lit("Market-"), F.col("supermarket_id").cast("string"))).alias("source"),
        F.when(F.col("linenumber") % 2 == 0, F.lit(" SEARCH ")).alias("surface"), "ean")
    orders = t.observations.groupBy("orderkey").agg(F.array_sort(F.collect_list(F.struct("linenumber", "id", candidate.alias("c")))).alias("lines"))
    body = F.to_json(F.struct(
        F.concat(F.lit("o-"), F.lpad(k.cast("string"), 10, "0")).alias("artifact"),
        F.when(k % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("Shop"))).alias("sources"),
        F.struct(F.lit("full").alias("mode"), F.lit("Category").alias("surface"), F.when(k % 3 == 0, F.array(F.lit("other"))).alias("surfaces")).alias("coverage"),
        F.when(k % 41 != 0, F.col("lines.c")).alias("candidates")))
    return landed(t, orders.select(F.when(k % 37 == 0, F.substring(body, 1, 60)).otherwise(body).alias("body")), "artifacts")


@query("a11_landed_artifacts", "A11", "observations", """
SELECT 'o-' || lpad(orderkey::varchar, 10, '0') AS artifact, (row_number() OVER (PARTITION BY orderkey ORDER BY linenumber, id) - 1)::int AS pos,
  CASE WHEN linenumber % 3 = 0 THEN 'market-' || supermarket_id WHEN orderkey % 5 <> 0 THEN 'shop' END AS source,
  CASE WHEN linenumber % 2 = 0 THEN 'search' WHEN orderkey % 3 <> 0 THEN 'category' END AS surface,
  concat_ws(',', CASE WHEN linenumber % 3 <> 0 AND orderkey % 5 = 0 THEN 'wrapper_source' END,
    CASE WHEN linenumber % 2 <> 0 AND orderkey % 3 = 0 THEN 'wrapper_coverage_conflict' END) AS errors, ean
FROM observations WHERE orderkey % 37 <> 0 AND orderkey % 41 <> 0""")
def artifacts_from_files(t):
    documents = landed_artifacts(t).withColumn("artifact", F.get_json_object("body", "$.artifact"))
    return files.artifact_candidates(documents).select("artifact", "pos", "source", "surface", F.array_join("errors", ",").alias("errors"), "ean")


@query("a11_quarantined_artifacts", "A11", "observations", """
SELECT DISTINCT '{"artifact":"o-' || lpad(orderkey::varchar, 10, '0') || '","sources":' AS excerpt,
  CASE WHEN orderkey % 37 = 0 THEN 'not_json' ELSE 'no_candidates' END AS reason FROM observations WHERE orderkey % 37 = 0 OR orderkey % 41 = 0""")
def quarantined_artifact_files(t):
    return files.quarantined_artifacts(landed_artifacts(t)).select(F.substring("excerpt", 1, 37).alias("excerpt"), "reason")


def landed_payloads(t: Tables) -> DataFrame:
    """The raw payloads as lines; one in 31 is cut off, one in 43 has no product, one in 47 lies a dozen levels down."""
    k, raw = F.col("payload_id"), F.col("raw")
    marked = F.concat(F.lit('{"id":"p-'), F.lpad(k.cast("string"), 12, "0"), F.lit('","data":'))
    body = (F.when(k % 31 == 0, F.concat(marked, F.substring(raw, 1, 20))).when(k % 43 == 0, F.concat(marked, F.lit("[]}")))
            .when(k % 47 == 0, F.concat(marked, F.lit("[" * 12), raw, F.lit("]" * 12 + "}"))).otherwise(F.concat(marked, raw, F.lit("}"))))
    return landed(t, t.raw_payloads.select(body.alias("body")), "payloads")


@query("a02_landed_payloads", "A2", "sp products", """
SELECT 'p-' || lpad(sp.id::varchar, 12, '0') AS payload, 0 AS pos, '<b>' || name || '</b>  ' AS product_name
FROM sp JOIN products ON ean = product_ean WHERE sp.id % 31 <> 0 AND sp.id % 43 <> 0""")
def payloads_from_files(t):
    documents = landed_payloads(t).withColumn("payload", F.get_json_object("body", "$.id"))
    return files.payload_records(documents).select("payload", "pos", F.get_json_object("record", "$.productName").alias("product_name"))


@query("a02_quarantined_payloads", "A2", "sp products", """
SELECT '{"id":"p-' || lpad(sp.id::varchar, 12, '0') || '"' AS excerpt, CASE WHEN sp.id % 31 = 0 THEN 'not_json' WHEN sp.id % 43 = 0 THEN 'no_products' ELSE 'deep' END AS reason
FROM sp JOIN products ON ean = product_ean WHERE sp.id % 31 = 0 OR sp.id % 43 = 0 OR sp.id % 47 = 0""")
def quarantined_payload_files(t):
    return files.quarantined_documents(landed_payloads(t)).select(F.substring("excerpt", 1, 22).alias("excerpt"), "reason")


# -- verdicts ---------------------------------------------------------------------
def evaluated(t: Tables) -> DataFrame:
    return ingest.evaluate_candidates(t.staging_product, ingest.historical_averages(t.observations))


def batch(t: Tables) -> DataFrame:
    return ingest.evaluate_candidates(t.batch_candidates, ingest.historical_averages(t.state_history))


def _evaluated_sql(source: str, history: str) -> str:
    return f"""
averages AS (SELECT ean, sum(price)::double / count(price) AS avg_price FROM {history} WHERE price IS NOT NULL GROUP BY 1),
gated AS (SELECT s.*, list_filter([
    CASE WHEN NOT regexp_full_match(s.ean, '\\d{{8,14}}') THEN 'valid_ean' END, CASE WHEN trim(name) = '' THEN 'has_name' END,
    CASE WHEN price <= 0 THEN 'price_positive' END, CASE WHEN price >= 1500000 THEN 'price_sane' END,
    CASE WHEN avg_price > 0 AND price::double > avg_price * 5 THEN 'price_no_spike' END,
    CASE WHEN coalesce(trim(brand), '') = '' THEN 'has_brand' END,
    CASE WHEN coalesce(image_url, '') = '' AND len(images) = 0 THEN 'has_image' END,
    CASE WHEN coalesce(trim(category), '') = '' THEN 'has_category' END], lambda x: x IS NOT NULL) AS flags
  FROM {source} s LEFT JOIN averages USING (ean)),
evaluated AS (SELECT *, (3 - len(list_filter(flags, lambda x: x IN ('has_brand','has_image','has_category')))) / 3.0::double AS quality_score,
    CASE WHEN len(list_filter(flags, lambda x: x NOT IN ('has_brand','has_image','has_category'))) > 0 THEN 'REJECTED' ELSE 'PENDING' END AS status
  FROM gated)"""


EVALUATED_SQL = _evaluated_sql("staging", "observations")
BATCH_SQL = _evaluated_sql("batch", "state_history") + """,
pending AS (SELECT *, (coalesce(brand,'')<>'')::int + (coalesce(description,'')<>'')::int + (coalesce(image_url,'')<>'')::int
    + (len(images)>0)::int + (coalesce(category,'')<>'')::int + (price IS NOT NULL)::int AS completeness FROM evaluated WHERE status = 'PENDING'),
canonical AS (SELECT * FROM pending QUALIFY row_number() OVER (PARTITION BY ean ORDER BY quality_score DESC, completeness DESC, source_slug, id) = 1),
winners AS (SELECT p.*, s.id AS supermarket_id FROM pending p JOIN supermarkets s ON s.slug = p.source_slug
  QUALIFY row_number() OVER (PARTITION BY p.ean, source_slug ORDER BY p.id DESC) = 1)"""
BATCH_TABLES = "batch state_history supermarkets state_products state_sp"


@query("e01_historical_averages", "C1 E1", "observations",
       "SELECT ean, sum(price)::double / count(price) AS avg_price FROM observations WHERE price IS NOT NULL GROUP BY 1")
def historical_averages(t):
    return ingest.historical_averages(t.observations)


@query("e02_quality_verdicts", "E2", "staging observations",
       f"WITH {EVALUATED_SQL} SELECT id, array_to_string(flags, ',') AS flags, quality_score, status FROM evaluated")
def quality_verdicts(t):
    return evaluated(t).select("id", F.array_join("quality_flags", ",").alias("flags"), "quality_score", "status")


@query("j06_applied_verdicts", "J6", "staging observations", f"""WITH {EVALUATED_SQL}
SELECT id, CASE WHEN source_slug <> 'market-5' THEN array_to_string(flags, ',') ELSE '' END AS flags,
  CASE WHEN source_slug <> 'market-5' THEN quality_score ELSE 0 END AS quality_score, CASE WHEN source_slug <> 'market-5' THEN status ELSE 'PENDING' END AS status FROM evaluated""")
def applied_verdicts(t):
    """Verdicts of the active stores; rows of the inactive store keep theirs."""
    staging = t.staging_product
    active = t.supermarkets.filter("is_active").select(F.col("slug").alias("source_slug"))
    rows = ingest.apply_verdicts(staging, ingest.historical_averages(t.observations), active)
    return rows.select("id", F.array_join("quality_flags", ",").alias("flags"), "quality_score", "status")


@query("e03_validation_summary", "E3", "staging observations", f"""WITH {EVALUATED_SQL}
SELECT run_id, count(*) AS validated, count(*) FILTER (status='REJECTED') AS rejected, count(*) FILTER (status='PENDING') AS pending FROM evaluated GROUP BY 1""")
def validation_summary(t):
    return ingest.validation_summary(evaluated(t), "run_id")


@query("e02_flag_histogram", "E2", "staging observations",
       f"WITH {EVALUATED_SQL} SELECT flag, count(*) AS rows FROM (SELECT unnest(flags) AS flag FROM evaluated) GROUP BY 1")
def flag_histogram(t):
    return ingest.flag_histogram(evaluated(t))


@query("d28_completeness", "D28", BATCH_TABLES, f"WITH {BATCH_SQL} SELECT completeness, count(*) AS rows FROM pending GROUP BY 1")
def completeness_counts(t):
    return pending(t).groupBy(completeness().alias("completeness")).agg(F.count("*").alias("rows"))


# -- merge ------------------------------------------------------------------------
def pending(t: Tables) -> DataFrame:
    return batch(t).filter(F.col("status") == "PENDING")


def canonical(t: Tables) -> DataFrame:
    columns = ["id", "ean", "source_slug", "quality_score", "name", "brand", "description", "image_url", "images", "category", "price"]
    return ingest.canonical_candidates(pending(t).select(*columns))


def winners(t: Tables) -> DataFrame:
    return ingest.last_per_store(pending(t).select("id", "ean", "source_slug", *merge.PRICE_COLUMNS))


@query("f05_canonical_candidates", "F5", BATCH_TABLES,
       f"WITH {BATCH_SQL} SELECT ean, id, source_slug, quality_score, price::double AS price FROM canonical")
def canonical_candidates(t):
    rows = canonical(t)
    return rows.select("ean", "id", "source_slug", "quality_score", F.col("price").cast("double").alias("price"))


@query("f06_last_per_store", "F6", BATCH_TABLES,
       f"WITH {BATCH_SQL} SELECT ean, source_slug, id, price::double AS price FROM winners")
def last_per_store(t):
    return winners(t).select("ean", "source_slug", "id", F.col("price").cast("double").alias("price"))


@query("c06_preflight_violations", "C6", BATCH_TABLES, f"""WITH {BATCH_SQL}
SELECT 'missing_product' AS reason, ean, NULL AS source_slug, 1 AS rows FROM (SELECT DISTINCT ean FROM pending) WHERE ean NOT IN (SELECT ean FROM state_products)
UNION ALL SELECT 'missing_store_row', p.ean, p.source_slug, count(*) FROM pending p JOIN supermarkets s ON s.slug = p.source_slug
WHERE NOT EXISTS (SELECT 1 FROM state_sp x WHERE x.product_ean = p.ean AND x.supermarket_id = s.id) GROUP BY 2, 3""")
def preflight_violations(t):
    return merge.preflight_violations(pending(t), t.state_products, t.state_supermarket_products, t.supermarkets)


@query("j01_new_products", "J1", BATCH_TABLES, f"""WITH {BATCH_SQL}
SELECT ean, name, brand, description, image_url, array_to_string(images, '|') AS images, category FROM canonical WHERE ean NOT IN (SELECT ean FROM state_products)""")
def new_products(t):
    rows = merge.new_products(canonical(t), t.state_products)
    return rows.withColumn("images", F.array_join("images", "|"))


@query("j02_protective_merge", "J2", BATCH_TABLES, f"""WITH {BATCH_SQL}
SELECT p.ean, p.name, coalesce(nullif(trim(p.brand),''), c.brand) AS brand, coalesce(nullif(p.description,''), c.description) AS description,
  coalesce(nullif(p.category,''), c.category) AS category, coalesce(nullif(p.image_url,''), c.image_url) AS image_url,
  coalesce((p.brand IS NULL AND c.brand IS NOT NULL) OR (p.description IS NULL AND c.description IS NOT NULL)
    OR (p.category IS NULL AND c.category IS NOT NULL) OR (p.image_url IS NULL AND c.image_url IS NOT NULL), false) AS changed
FROM state_products p LEFT JOIN canonical c USING (ean)""")
def protective_merge(t):
    rows = merge.protective_merge(t.state_products, canonical(t))
    return rows.select("ean", "name", "brand", "description", "category", "image_url", "changed")


def upserted(t: Tables) -> DataFrame:
    return merge.upsert_current(t.state_supermarket_products, winners(t), t.supermarkets, NOW)


def planned(t: Tables) -> DataFrame:
    return merge.planned_rows(
        winners(t).select("ean", "source_slug", "price", "list_price"), catalog.latest_history(t.state_history),
        t.supermarkets, t.state_supermarket_products)


def stored_winners(t: Tables) -> DataFrame:
    """The winners for a query that reads them several times."""
    return t.shared("winners", winners)


def upserted_stored(t: Tables) -> DataFrame:
    """The merge from stored winners and stored current prices."""
    return merge.upsert_current(t.stored("state_supermarket_products"), stored_winners(t), t.supermarkets, NOW)


# texts of one length follow all shorter ones: 10**8 + ... + 10**(len - 1) of these
_CREATED_ID = "-((w.ean::bigint + (CASE len(w.ean) " + " ".join(
    f"WHEN {n} THEN {sum(10 ** d for d in range(8, n))}" for n in range(8, 15)) + " END)) * 65536 + w.supermarket_id + 1)"
UPSERT_SQL = f"""{BATCH_SQL},
upserted AS (SELECT coalesce(x.id, {_CREATED_ID}) AS id, coalesce(x.product_ean, w.ean) AS product_ean, coalesce(x.supermarket_id, w.supermarket_id) AS supermarket_id,
    CASE WHEN w.ean IS NULL THEN x.price ELSE w.price END::double AS price, CASE WHEN w.ean IS NULL THEN x.is_available ELSE w.is_available END AS is_available,
    CASE WHEN w.ean IS NULL THEN x.sku_id ELSE w.sku_id END AS sku_id,
    CASE WHEN w.ean IS NULL THEN x.last_checked_at ELSE TIMESTAMP '{NOW}' END AS last_checked_at,
    CASE WHEN w.ean IS NULL THEN 'keep' WHEN x.id IS NULL THEN 'insert' ELSE 'update' END AS action
  FROM state_sp x FULL JOIN winners w ON w.ean = x.product_ean AND w.supermarket_id = x.supermarket_id),
last AS (SELECT supermarket_product_id AS sid, price, list_price FROM state_history QUALIFY row_number() OVER (
    PARTITION BY supermarket_product_id ORDER BY scraped_at DESC, orderkey DESC, linenumber DESC, suppkey DESC) = 1),
new_history AS (SELECT coalesce(x.id, {_CREATED_ID}) AS supermarket_product_id, TIMESTAMP '{NOW}' AS scraped_at, w.ean AS product_ean, w.supermarket_id, w.price::double AS price, w.list_price::double AS list_price, l.sid IS NULL AS first_row
  FROM winners w LEFT JOIN state_sp x ON x.product_ean = w.ean AND x.supermarket_id = w.supermarket_id LEFT JOIN last l ON l.sid = x.id
  WHERE l.sid IS NULL OR w.price IS DISTINCT FROM l.price OR w.list_price IS DISTINCT FROM l.list_price)"""


@query("j03_upserted_prices", "J3", BATCH_TABLES, f"WITH {UPSERT_SQL} SELECT * FROM upserted")
def upserted_prices(t):
    return upserted(t).select("id", "product_ean", "supermarket_id", F.col("price").cast("double").alias("price"),
                              "is_available", "sku_id", "last_checked_at", "action")


@query("j04_history_on_change", "J4", BATCH_TABLES, f"WITH {UPSERT_SQL} SELECT * FROM new_history")
def history_on_change(t):
    return merge.history_to_append(planned(t), NOW).withColumns({c: F.col(c).cast("double") for c in ("price", "list_price")})


@query("j05_promoted_staging", "J5", BATCH_TABLES, f"""WITH {BATCH_SQL}
SELECT id, CASE WHEN status = 'PENDING' THEN 'PROMOTED' ELSE status END AS status FROM evaluated""")
def promoted_staging(t):
    return merge.promote(batch(t)).select("id", "status")


@query("e17_reconcile_summary", "E17", BATCH_TABLES, f"""WITH {UPSERT_SQL}
SELECT (SELECT count(*) FROM pending) AS promoted, (SELECT count(DISTINCT ean) FROM pending) AS distinct_eans,
  (SELECT count(DISTINCT ean) FROM pending WHERE ean NOT IN (SELECT ean FROM state_products)) AS new_products,
  (SELECT count(DISTINCT ean) FROM pending WHERE ean IN (SELECT ean FROM state_products)) AS merged_products,
  (SELECT count(*) FROM upserted WHERE action = 'insert') AS created, (SELECT count(*) FROM upserted WHERE action = 'update') AS updated,
  (SELECT count(*) FROM new_history) AS history_inserted""")
def reconcile_summary(t):
    return merge.reconcile_summary(pending(t), t.state_products, planned(t))


@query("e17_promoted_counts", "E17", BATCH_TABLES, f"""WITH {BATCH_SQL}
SELECT 'run' AS scope, run_id::varchar AS key, count(*) AS promoted FROM pending GROUP BY 2
UNION ALL SELECT 'source', source_slug, count(*) FROM pending GROUP BY 2""")
def promoted_counts(t):
    return merge.promoted_counts(pending(t))


@query("j07_legacy_persist", "J7", "batch state_products", """
SELECT source_slug, CASE WHEN ean IN (SELECT ean FROM state_products) OR ean IN (SELECT ean FROM batch WHERE source_slug = 'market-0')
  THEN 'persisted' ELSE 'skipped' END AS outcome, count(*) AS rows FROM batch GROUP BY 1, 2""")
def legacy_persist(t):
    rows = merge.legacy_persist(t.batch_candidates, t.state_products, "market-0")
    return rows.groupBy("source_slug", "outcome").agg(F.count("*").alias("rows"))


@query("j04_second_batch_adds_nothing", "J3 J4", BATCH_TABLES, "SELECT 0::bigint AS added, 0::bigint AS inserted")
def second_batch(t):
    """The same batch again, against the tables the first one leaves."""
    current = upserted_stored(t).drop("action")
    rows = stored_winners(t).select("ean", "source_slug", "price", "list_price")
    newest = t.shared("latest-history", lambda t: catalog.latest_history(t.state_history))
    first = t.shared("planned", lambda t: merge.planned_rows(rows, newest, t.supermarkets, t.stored("state_supermarket_products")))
    last = merge.history_to_append(first, NOW).select(
        "supermarket_product_id", F.col("price").alias("last_price"), F.col("list_price").alias("last_list_price"))
    kept = newest.join(last, "supermarket_product_id", "left_anti").select(*last.columns)
    again = merge.planned_rows(rows, last.unionByName(kept), t.supermarkets, current)
    return again.agg(F.count_if("changed").alias("added"), F.count_if(F.col("id").isNull()).alias("inserted"))


_LEGACY_SQL = f"""
kept AS (SELECT * FROM batch WHERE ean IN (SELECT ean FROM state_products) OR ean IN (SELECT ean FROM batch WHERE source_slug = 'market-0'))"""


def legacy(t: Tables):
    return merge.legacy_writes(t.batch_candidates, t.state_products, "market-0", NOW)


@query("j07_legacy_products", "J7", "batch state_products", f"""WITH {_LEGACY_SQL}
SELECT ean, name, brand, description, category, image_url FROM kept WHERE source_slug = 'market-0'
QUALIFY row_number() OVER (PARTITION BY ean ORDER BY id DESC) = 1""")
def legacy_products(t):
    return legacy(t)[0].select("ean", "name", "brand", "description", "category", "image_url")


@query("j07_legacy_prices", "J7", "batch state_products", f"""WITH {_LEGACY_SQL}
SELECT ean, source_slug, price::double AS price, is_available, sku_id, TIMESTAMP '{NOW}' AS last_checked_at FROM kept
QUALIFY row_number() OVER (PARTITION BY ean, source_slug ORDER BY id DESC) = 1""")
def legacy_prices(t):
    return legacy(t)[1].select("ean", "source_slug", F.col("price").cast("double").alias("price"), "is_available", "sku_id", "last_checked_at")


@query("j07_legacy_history", "J7", "batch state_products", f"""WITH {_LEGACY_SQL}
SELECT ean, source_slug, price::double AS price, TIMESTAMP '{NOW}' AS scraped_at FROM kept""")
def legacy_history(t):
    return legacy(t)[2].select("ean", "source_slug", F.col("price").cast("double").alias("price"), "scraped_at")


@query("j08_history_retention", "J8", "observations", f"""
SELECT count(*) FILTER (scraped_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY) AS deletable, count(*) FILTER (scraped_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY) AS kept FROM observations""")
def history_retention(t):
    return merge.expired_counts(t.observations, "scraped_at", NOW, 90 * 24)


@query("j08_staging_kept", "J8", "staging", "SELECT id, created_at FROM staging WHERE created_at >= TIMESTAMP '2001-06-01' - INTERVAL 48 HOUR")
def staging_kept(t):
    return merge.expire(t.staging_product, "created_at", "2001-06-01 00:00:00", 48).select("id", "created_at")


@query("g10_oldest_work_list", "G10", "sp products supermarkets", """
SELECT DISTINCT s.slug, p.name FROM (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY supermarket_id ORDER BY last_checked_at NULLS FIRST, id) <= 500) o
JOIN products p ON p.ean = o.product_ean JOIN supermarkets s ON s.id = o.supermarket_id WHERE p.name <> ''""")
def oldest_work_list(t):
    return ingest.oldest_work_list(t.supermarket_products, t.products, t.supermarkets)


@query("e38_batch_rollup", "E38", "runs", """
WITH s AS (SELECT batch_id, source_slug, sum(products_fetched)::bigint AS fetched, sum(products_staged)::bigint AS staged, sum(products_promoted)::bigint AS promoted,
  sum(products_rejected)::bigint AS rejected, CASE WHEN sum(products_promoted) = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM runs GROUP BY 1, 2)
SELECT batch_id, sum(fetched)::bigint AS fetched, sum(staged)::bigint AS staged, sum(promoted)::bigint AS promoted, sum(rejected)::bigint AS rejected,
  count(*) FILTER (status = 'FAILED') AS failed_sources FROM s GROUP BY 1""")
def batch_rollup(t):
    return ingest.batch_rollup(source_summaries(t))


def source_summaries(t: Tables) -> DataFrame:
    return t.ingestion_run.groupBy("batch_id", "source_slug").agg(
        F.sum("products_fetched").alias("fetched"), F.sum("products_staged").alias("staged"),
        F.sum("products_promoted").alias("promoted"), F.sum("products_rejected").alias("rejected"),
    ).withColumn("status", F.when(F.col("promoted") == 0, "FAILED").otherwise("SUCCESS"))


@query("e38_reconcile_time_share", "E38", "runs", """
WITH s AS (SELECT batch_id, source_slug, sum(products_promoted)::bigint AS promoted FROM runs GROUP BY 1, 2)
SELECT batch_id, source_slug, CASE WHEN promoted > 0 THEN floor(250740.0::double * (promoted / greatest(1, sum(promoted) OVER (PARTITION BY batch_id))::double) + 0.5)::bigint ELSE 0 END AS reconcile_ms FROM s""")
def reconcile_time_share(t):
    return ingest.share_reconcile_time(source_summaries(t), 250740).select("batch_id", "source_slug", "reconcile_ms")
