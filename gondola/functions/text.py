"""String rules: cleaning, accents, slugs, query terms, encoding damage."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMBINING_MARKS = "[̀-ͯ]"

# Words and unit patterns that carry no search meaning.
STOP_WORDS = (
    "con", "de", "del", "el", "en", "la", "las", "los",
    "para", "por", "sin", "un", "una", "x", "y",
)
UNIT_PATTERN = (
    r"^(\d+[.,]?\d*|\d+(kg|g|gr|ml|l|lt|lts)|(kg|g|gr|ml|l|lt|lts|cc|un|u))$"
)

# Traces of UTF-8 read with a one-byte encoding.
BROKEN_TEXT_PATTERN = "Ã|Â|�"

# Category name, slug and the keywords that imply it, in match order.
CATEGORY_KEYWORDS = (
    ("Almacén", "almacen", ("arroz", "fideos", "harina", "azucar")),
    ("Bebidas", "bebidas", ("agua", "gaseosa", "jugo", "cerveza")),
    ("Lácteos", "lacteos", ("leche", "yogur", "queso", "manteca")),
    ("Carnes", "carnes", ("carne", "pollo", "cerdo", "hamburguesa")),
    ("Frutas y Verduras", "frutas-verduras", ("banana", "manzana", "papa", "tomate")),
    ("Limpieza", "limpieza", ("lavandina", "detergente", "jabon", "suavizante")),
    ("Higiene Personal", "higiene-personal", ("shampoo", "desodorante", "jabon", "papel higienico")),
    ("Bebés", "bebes", ("pañales", "toallitas", "mamadera", "talco")),
    ("Mascotas", "mascotas", ("alimento perro", "alimento gato", "piedras", "snack")),
    ("Congelados", "congelados", ("helado", "verdura congelada", "pizza", "medallon")),
    ("Desayuno y Merienda", "desayuno-merienda", ("yerba", "cafe", "te", "galletitas")),
    ("Panadería", "panaderia", ("pan", "facturas", "tostadas", "prepizza")),
    ("Perfumería", "perfumeria", ("crema", "maquillaje", "algodon", "quita esmalte")),
    ("Electro Hogar", "electro-hogar", ("lampara", "pilas", "cargador", "extension")),
    ("Sin TACC", "sin-tacc", ("sin tacc", "celiaco", "arroz integral", "galletas arroz")),
)


def default_search_terms() -> list[str]:
    """All category keywords once, in order of first appearance."""
    return list(dict.fromkeys(word for _, _, words in CATEGORY_KEYWORDS for word in words))


def _accent_table() -> tuple[str, str]:
    """Every precomposed letter whose decomposition is one base plus combining marks."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and re.fullmatch(f"{COMBINING_MARKS}+", parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, COMBINING_MARKS, ""), _ACCENTED, _PLAIN)


def strip_html(text: Column) -> Column:
    """Tags become spaces, whitespace collapses; empty or null input gives null."""
    spaced = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"(?U)\s+", " ")
    # most texts have nothing to replace, and the patterns are dear
    dressed = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in ("<", "  ", *"\t\n\v\f\r")]) | (F.octet_length(text) != F.length(text))
    return F.when(F.length(text) > 0, F.when(dressed, F.trim(spaced)).otherwise(F.trim(text)))


def trim_space(text: Column) -> Column:
    """Trim every kind of leading and trailing white space."""
    return F.btrim(text, F.lit(" \t\n\r\f\v\u00a0\u2028\u2029\ufeff"))


def clean(text: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(trim_space(text), F.lit(""))


def first_clean(*texts: Column) -> Column:
    return F.coalesce(*[clean(t) for t in texts])


def contains_ignore_case(text: Column, needle: str) -> Column:
    """Literal, case-insensitive containment (no pattern characters)."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def category_from_text(text: Column) -> Column:
    """Name of the first category owning a keyword that occurs in the text."""
    return category_from_lowered(F.lower(text))


def category_from_lowered(lowered: Column) -> Column:
    """The same from a text in lower case, which each keyword reads."""
    rule = None
    for name, _, words in CATEGORY_KEYWORDS:
        hit = reduce(Column.__or__, [F.contains(lowered, F.lit(w)) for w in words])
        rule = F.when(hit, F.lit(name)) if rule is None else rule.when(hit, F.lit(name))
    return rule


def category_leaf(path: Column) -> Column:
    """Last non-empty segment of a slash path; plain values pass through."""
    parts = F.filter(F.transform(F.split(path, "/"), trim_space), lambda p: p != "")
    leaf = F.try_element_at(parts, F.lit(-1))
    return F.when(path == "", F.lit(None)).when(F.contains(path, F.lit("/")), leaf).otherwise(path)


def normalize_term(text: Column) -> Column:
    folded = F.lower(strip_accents(text))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9\s]", " "), r"\s+", " "))


def query_tokens(text: Column) -> Column:
    """Meaningful tokens: 3+ characters, no stop word, no unit."""
    return F.filter(
        F.split(normalize_term(text), " "),
        lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS) & ~t.rlike(UNIT_PATTERN),
    )


def expand_terms(text: Column) -> Column:
    """First two, first three and first token, then the full term; distinct, in that order."""
    tokens = query_tokens(text)
    full = normalize_term(text)
    parts = F.array(
        F.when(F.size(tokens) >= 2, F.array_join(F.slice(tokens, 1, 2), " ")),
        F.when(F.size(tokens) >= 3, F.array_join(F.slice(tokens, 1, 3), " ")),
        F.when(F.size(tokens) >= 1, F.get(tokens, F.lit(0))),
        F.when(full != "", full),
    )
    return F.array_distinct(F.filter(parts, lambda t: t.isNotNull()))


def has_broken_text(text: Column, pattern: str = BROKEN_TEXT_PATTERN) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def split_ean_list(text: Column) -> Column:
    """EANs separated by newline, comma, semicolon or space; trimmed, distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,;\s]+"), trim_space), lambda e: e != ""))
