"""Hand-written cases of the scalar rules."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gondola.functions import freshness, identity, numeric, promo, text, web
from gondola.functions.quality import verdict
from gondola.sources.payloads import category_leaf, fetch_outcome, plausible_list_price


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x, want", [(1.005, 1.0), (-2.5, -2.5), (2.675, 2.68), (0.125, 0.13)])
def test_currency(spark, x, want):
    assert value(spark, numeric.currency(F.lit(x))) == want


def test_half_up_goes_towards_plus_infinity(spark):
    assert value(spark, numeric.half_up(F.lit(-2.5), 0)) == -2.0


@pytest.mark.parametrize("t, want", [("1,5", 1.5), ("", 0.0), ("  ", 0.0), ("abc", None), ("1,2,3", None), ("-3e2", -300.0), ("12.", 12.0)])
def test_loose_number(spark, t, want):
    assert value(spark, numeric.loose_number(F.lit(t))) == want


def test_percentages(spark):
    one, zero, null = F.lit(1.0), F.lit(0.0), F.lit(None).cast("double")
    assert value(spark, numeric.percent(one, F.lit(3.0))) == 33.33
    assert value(spark, numeric.percent(one, zero)) == 0.0
    assert value(spark, numeric.drift_percent(F.lit(1000.0), F.lit(1200.0))) == 20.0
    assert value(spark, numeric.drift_percent(zero, one)) is None
    assert value(spark, numeric.absolute_delta_percent(F.lit(3.0), F.lit(2.0))) == 33.3333
    assert value(spark, numeric.absolute_delta_percent(null, one)) is None


@pytest.mark.parametrize("t, want", [
    ("<b>Leche</b>\n entera ", "Leche entera"), ("", None), (None, None), ("<br>", "")])
def test_strip_html(spark, t, want):
    assert value(spark, text.strip_html(F.lit(t).cast("string"))) == want


def test_text_rules(spark):
    assert value(spark, text.slugify(F.lit("  Panadería & Más! "))) == "panaderia-mas"
    assert value(spark, text.strip_accents(F.lit("Ñandú é"))) == "Nandu e"
    assert value(spark, text.category_from_text(F.lit("LECHE descremada"))) == "Lácteos"
    assert value(spark, text.category_from_text(F.lit("zzz"))) is None
    assert value(spark, category_leaf(F.lit("/a/ Bebidas /"))) == "Bebidas"
    assert value(spark, category_leaf(F.lit("//"))) is None
    assert value(spark, text.expand_terms(F.lit("Leche de Vaca 1 lt Serenísima"))) == [
        "leche vaca", "leche vaca serenisima", "leche", "leche de vaca 1 lt serenisima"]
    assert value(spark, text.split_ean_list(F.lit("123\n456, 123;789 "))) == ["123", "456", "789"]
    assert value(spark, text.has_broken_text(F.lit("CafÃ©"))) is True
    assert len(text.default_search_terms()) == len(set(text.default_search_terms())) == 59


def test_search_is_literal(spark):
    assert value(spark, text.contains_ignore_case(F.lit("100% Jugo"), "0% j")) is True
    assert value(spark, text.contains_ignore_case(F.lit("1000 Jugo"), "0% j")) is False


@pytest.mark.parametrize("hours, limit, want", [
    (23, 24, "fresh"), (24, 24, "fresh"), (25, 24, "stale"), (20, None, "fresh"), (25, 0, "stale"), (-5, 12, "fresh"), (None, 24, "unknown")])
def test_freshness(spark, hours, limit, want):
    now = datetime(2026, 5, 28)
    checked = F.lit(None).cast("timestamp") if hours is None else F.timestamp_micros(
        F.unix_micros(F.lit("2026-05-28 00:00:00").cast("timestamp")) - F.lit(hours * 3_600_000_000))
    assert value(spark, freshness.freshness(checked, F.lit(limit).cast("int"), now)) == want


@pytest.mark.parametrize("kind, discount, base, want", [
    ("2x1", None, 101.0, 50.5), ("2nd_50", None, 100.0, 75.0), ("percentage", 100.0, 80.0, 0.0), ("percentage", 101.0, 80.0, None),
    ("bank_discount", 0.0, 80.0, None), ("wallet_discount", 12.5, 80.0, 70.0), ("2x1", None, 0.0, None), ("other", 5.0, 9.0, None)])
def test_promotional_price(spark, kind, discount, base, want):
    assert value(spark, promo.promotional_price(F.lit(base), F.lit(kind), F.lit(discount).cast("double"))) == want


def test_price_movement_rounds_the_amount_first(spark):
    cur, prev = F.lit(66.666), F.lit(100.0)
    assert value(spark, promo.delta_amount(cur, prev)) == -33.33
    assert value(spark, promo.delta_percent(cur, prev)) == -33.33
    assert value(spark, promo.drop_percent(cur, prev)) == 33.33
    assert value(spark, promo.drop_amount(prev, cur)) is None


def test_promotion_windows_are_open_ended(spark):
    none, now = F.lit(None).cast("timestamp"), "2026-01-10 00:00:00"
    day = F.lit(now).cast("timestamp")
    assert value(spark, promo.running(F.lit(True), none, none, now)) is True
    assert value(spark, promo.running(F.lit(True), day, day, now)) is True
    assert value(spark, promo.lifecycle(F.lit(False), none, none, now)) == "inactive"


@pytest.mark.parametrize("price, listed, want", [(100.0, 90.0, None), (100.0, 500.0, 500.0), (100.0, 501.0, None), (None, 5.0, 5.0)])
def test_list_price(spark, price, listed, want):
    assert value(spark, plausible_list_price(F.lit(price).cast("double"), F.lit(listed))) == want


@pytest.mark.parametrize("url, want", [
    ("https://www.Shop.example.com:8443/Item/", "shop.example.com:8443"), ("not a url", None), (None, None)])
def test_url_host(spark, url, want):
    assert value(spark, web.url_host(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("url, want", [
    ("https://www.Shop.example.com:80/A/B//?x=1#y", "www.shop.example.com/a/b"), ("https://shop.example.com", "shop.example.com/"),
    ("/Item-1/P/?q=2", "/item-1/p"), ("  ", None)])
def test_normalized_url(spark, url, want):
    assert value(spark, web.normalized_product_url(F.lit(url))) == want


@pytest.mark.parametrize("code, status, body, want", [
    ("ECONNABORTED", None, "captcha", "timeout"), (None, 200, '{"e":"PersistedQueryNotFound"}', "hash_invalid"),
    (None, 429, "", "blocked"), (None, 200, "<HTML>", "blocked"), (None, 500, '{"a":1}', "network"), (None, 200, "[]", None), (None, 200, "hm", "unknown")])
def test_fetch_outcome(spark, code, status, body, want):
    got = fetch_outcome(F.lit(code).cast("string"), F.lit(status).cast("int"), F.lit(body))
    assert value(spark, got) == want


def test_quality_gates(spark):
    row = spark.createDataFrame(
        [("123", " ", 2_000_000.0, 10.0, None, None, [], " ")],
        "ean string, name string, price double, avg double, brand string, image_url string, images array<string>, category string")
    got = row.select(*[c.alias(n) for n, c in verdict(F.col("avg")).items()]).first()
    assert got["quality_flags"] == ["valid_ean", "has_name", "price_sane", "price_no_spike", "has_brand", "has_image", "has_category"]
    assert got["status"] == "REJECTED" and got["quality_score"] == 0.0
    free = spark.createDataFrame(
        [("12345678", "x", None, None, "b", None, ["i"], "c")],
        "ean string, name string, price double, avg double, brand string, image_url string, images array<string>, category string")
    got = free.select(*[c.alias(n) for n, c in verdict(F.col("avg")).items()]).first()
    assert got["quality_flags"] == [] and got["status"] == "PENDING" and got["quality_score"] == 1.0


def test_identities(spark):
    none = F.lit(None).cast("string")
    got = value(spark, identity.candidate_identity(ean=none, skuId=F.lit(" SKU-1 "), url=F.lit("x")))
    assert (got["kind"], got["value"]) == ("skuId", "sku-1")
    assert value(spark, identity.idempotency_key(F.lit("s"), F.lit("1"), none)) == "discovery:s:1:no-sku"
    assert value(spark, identity.canonical_identity(none, none, none, F.lit("EAN"), F.lit(" 9 "), none)) == "ean:9"
    assert 0 < value(spark, identity.source_lock_key(F.lit("market-1"))) < 2**31
