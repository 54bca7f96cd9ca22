"""Personal data by pattern, checksum and context, with DataFrame functions only.

A regular expression proposes spans, a validator (Luhn, mod 97, digit counts,
octet range) confirms them and words near a span raise its score. Positions come
from cutting the text at the same matches: the pieces between matches and the
matches themselves alternate, so their lengths add up to offsets. One pass over
each text, no shuffle. Patterns never backtrack over long runs.

Cases: null texts are empty; offsets count code points; each row gives one row,
repeated or not, and keeps its other columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
NEAR = 40
IN_BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _always(value: Column) -> Column:
    return F.lit(True)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3)
                    & (F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).try_cast("int") <= 255))


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


def _mod97(value: Column) -> Column:
    """Country code and check digits go last, letters count 10 to 35; the number must leave 1."""
    moved = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    letter = lambda c: c >= "A"
    step = lambda acc, c: (acc * F.when(letter(c), 100).otherwise(10) + F.when(letter(c), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)).cast("int")) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    hint: Callable[[Column], Column]  # cheap test that a text can hold the kind at all
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str  # words that raise the score


KINDS = (
    Kind("email", lambda t: t.contains("@"),
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always, 0.8, "mail|contact|write"),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.6, "ip|host|server|address"),
    Kind("card", lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), r"[0-9](?:[ -]?[0-9])++", _luhn, 0.7, "card|credit|visa|payment"),
    Kind("phone", lambda t: t.rlike(r"\+[0-9]"), r"\+[0-9][ ().0-9-]+[0-9]", _phone, 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
         r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", _mod97, 0.9, "iban|account|bank|konto"),
)
BASE = ("email", "ip", "card", "phone")


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans_of(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)  # one more than found: the last has no match behind it
    none = F.array().cast(SPAN)
    flat, nested = "array<struct<start:int,end:int,value:string>>", "array<array<struct<start:int,end:int,value:string>>>"

    def add(state: Column, pair: Column) -> Column:
        """(end of the last match, spans so far): only confirmed spans are copied along."""
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value")))
        right = F.coalesce(kind.valid(pair["value"]), F.lit(False))
        return F.when(pair["value"].isNull(), state).otherwise(F.struct(
            end.alias("at"), F.when(right, F.concat(state["out"], one)).otherwise(state["out"]).alias("out")))

    def add_block(state: Column, block: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), F.array().cast(flat).alias("out"))
        return _given(F.aggregate(block, begin, add), lambda done: F.struct(
            done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")))

    def by_block(pairs: Column) -> Column:
        """Appending to one array costs its length each time; blocks keep that bounded for any number of matches."""
        firsts = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / IN_BLOCK).cast("int"))
        blocks = F.transform(firsts, lambda i: F.slice(pairs, i * IN_BLOCK + 1, IN_BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(nested).alias("out"))
        return F.flatten(F.aggregate(blocks, start, add_block)["out"])

    pairs = F.zip_with(between, found, lambda gap, v: F.struct(gap.alias("gap"), v.alias("value")))
    placed = _given(pairs, by_block)

    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - NEAR, F.lit(0))
        near = F.lower(F.substring(text, first + 1, s["end"] + NEAR - first))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), 0.1).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        s["value"].alias("value"), score.alias("score"))

    return F.when(kind.hint(text), F.transform(placed, scored).cast(SPAN)).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``out``: all spans by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.concat(*[spans_of(text, k) for k in kinds]))


def report(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"), out="_spans").drop("text")
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, shown), ",")
    of = lambda *names: F.filter("_spans", lambda s: s["kind"].isin(*names))
    scores = F.array_join(F.transform("_spans", lambda s: F.format_number(s["score"], 1)), ",")
    return found.select("doc_id", *[F.size(of(n)).cast("long").alias(f"n_{n}") for n in BASE],
                        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"), scores.alias("scores"))
