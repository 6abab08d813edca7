"""Checksum and format validators as Columns; a null value is not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of an address, and words beside a date that make it a reference to a law.
EMAIL_FORM = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
LAW = r"\b(?:article|art\.|loi|décret|code)\b"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def email(c: Column) -> Column:
    return sure(c.rlike(EMAIL_FORM))


def email_match(c: Column) -> Column:
    """The looser rule that matches are held to: a dot after the last @."""
    return sure(c.contains("@") & F.substring_index(c, "@", -1).contains("."))


def phone_fr(c: Column) -> Column:
    """Ten digits from 01 to 07, or so after the country's code."""
    return sure(F.regexp_replace(digits(c), "^(?:0033|33)", "0").rlike(r"^0[1-7]\d{8}$"))


def nir(c: Column) -> Column:
    """15 characters whose last two are 97 less the remainder of the rest by 97."""
    v = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    form = v.rlike(r"^[12]\d{2}(?:0[1-9]|1[0-2])(?:\d{2}|2A|2B)\d{8}$")
    number = F.replace(F.replace(F.substring(v, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    return sure(form & (97 - number.try_cast("bigint") % 97 == F.substring(v, 14, 2).try_cast("int")))


def iban_fr(c: Column) -> Column:
    """27 characters from FR; the number that its rotated characters spell leaves 1 by 97."""
    v = F.upper(F.regexp_replace(c, r"\s+", ""))
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, ch: F.when(ch.rlike("^[0-9]$"), (a * 10 + ch.try_cast("int")) % 97).when(ch.rlike("^[A-Z]$"), (a * 100 + F.ascii(ch) - 55) % 97).otherwise(F.when(ch == "", a)),
    )
    return sure(v.startswith("FR") & (F.length(v) == 27) & (rest == 1))


def siren(c: Column) -> Column:
    d = digits(c)
    return sure((F.length(d) == 9) & F.call_function("luhn_check", d))


def siret(c: Column) -> Column:
    """14 digits that pass the check, as do the first nine."""
    d = digits(c)
    return sure((F.length(d) == 14) & F.call_function("luhn_check", d) & F.call_function("luhn_check", F.substring(d, 1, 9)))


def date_fr(c: Column, context: Column | None = None) -> Column:
    """A day of 1900 to 2100 that exists, not within 20 characters of a law's words in its context."""
    day = F.coalesce(F.try_to_timestamp(c, F.lit("d/M/yyyy")), F.try_to_timestamp(c, F.lit("d-M-yyyy")))
    good = day.isNotNull() & F.year(day).between(1900, 2100)
    if context is None:
        return sure(good)
    plain = F.replace(F.lower(context), F.lit("**"), F.lit(""))
    at = F.instr(plain, F.lower(c))
    first = F.greatest(at - 21, F.lit(0))
    window = F.substring(plain, first + 1, at - 1 - first + F.length(c) + 20)
    return sure(good & ~F.coalesce((at > 0) & window.rlike("(?U)" + LAW), F.lit(False)))


CHECKS = {"EMAIL": email_match, "PHONE": phone_fr, "IBAN": iban_fr, "SIREN": siren, "SIRET": siret, "SSN": nir}


def match_ok(value: Column, kind: str) -> Column:
    """Whether a match of a type may stand."""
    v = F.trim(value)
    return sure(F.length(v) >= 2) & (CHECKS[kind](v) if kind in CHECKS else F.lit(True))


def match_ok_by(value: Column, kind: Column) -> Column:
    """The same where the type is a column."""
    out = F.when(kind.isNull(), F.lit(True))
    for k, check in CHECKS.items():
        out = out.when(kind == k, check(F.trim(value)))
    return sure(F.length(F.trim(value)) >= 2) & out.otherwise(True)
