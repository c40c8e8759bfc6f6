"""Masks for personal data in questions, in a fixed order over progressively masked text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"(?U)(?<!\w)(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}(?!\w)"
IBAN = r"(?U)\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}\b"
CARD = r"(?U)(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"


def replace_where(text: Column, pattern: str, valid, put: str) -> Column:
    """Each match of ``pattern`` for which ``valid`` holds becomes ``put``: the gaps zipped with the judged matches."""
    gaps = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(valid(m), F.lit(put)).otherwise(m))
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def iban_valid(match: Column) -> Column:
    """15 to 34 signs, remainder 1 modulo 97."""
    plain = F.regexp_replace(match, "[ -]", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(r: Column, c: Column) -> Column:
        digit = F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
        return F.when(digit < 10, (r * 10 + digit) % 97).otherwise((r * 100 + digit) % 97)

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.length(plain).between(15, 34) & (rest == 1)


def card_valid(match: Column) -> Column:
    """13 to 19 digits with a valid check digit."""
    digits = F.reverse(F.filter(F.split(F.regexp_replace(match, r"\D", ""), ""), lambda c: c != ""))
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.size(digits).between(13, 19) & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)


def with_masked(df, text: str, masked: str = "masked", entities: str = "entities"):
    """``df`` with the masked text and the entity types found (email, ssn, phone, iban, credit_card), in rule order. Each step is a column, so
    none is computed twice."""
    steps, before = [], text
    for name, pattern, put in (("email", EMAIL, "[EMAIL]"), ("ssn", SSN, "[SSN]"), ("phone", PHONE, "[PHONE]")):
        df = df.withColumn(f"_{name}", F.regexp_replace(before, pattern, put))
        steps.append((name, before, f"_{name}"))
        before = f"_{name}"
    for name, pattern, valid, put in (("iban", IBAN, iban_valid, "[IBAN]"), ("credit_card", CARD, card_valid, "[CREDIT_CARD]")):
        df = df.withColumn(f"_{name}", F.when(F.col(before).rlike(pattern), replace_where(F.col(before), pattern, valid, put)).otherwise(F.col(before)))
        steps.append((name, before, f"_{name}"))
        before = f"_{name}"
    hit = F.array(*(F.when(F.col(a) != F.col(b), F.lit(n)) for n, a, b in steps))
    return df.withColumn(masked, F.col(before)).withColumn(entities, F.filter(hit, lambda x: x.isNotNull())).drop(*(b for _, _, b in steps))
