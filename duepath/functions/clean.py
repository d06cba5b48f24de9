"""Cleaning expressions over columns: dates, numbers, text, names."""

from __future__ import annotations

import unicodedata
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from duepath.config import DEFAULT, Settings

# Keyword lists that decide the kind of a credit line.
BNPL_WORDS = ("klarna", "clearpay", "laybuy", "paypal4", "zilch", "bnpl")
CARD_WORDS = ("card", "visa", "mastercard", "amex")
LOAN_WORDS = ("loan", "finance", "lending", "credit", "repay", "instal")
# Words that mark employment income, salary credits, credit accounts, titles.
EMPLOYMENT_WORDS = ("salar", "employ", "wage", "work", "private_sector")
SALARY_PATTERN = r"\b(salary|salaries|payroll|wages?|hmrc|net\s*pay|paye)\b"
CREDIT_ACCOUNT_WORDS = ("credit", "card", "loan", "mortgage", "overdraft")
TITLES = ("MR", "MRS", "MISS", "MS", "DR", "PROF", "SIR", "MX", "REV")
# Letters that decompose to one plain letter and accents, over the Latin blocks and the full-width letters.
_LETTERS = (chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)))
_BASES = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in _LETTERS}
ACCENTED = "".join(c for c, base in _BASES.items() if len(base) == 1 and base.isascii() and base.isalpha())
PLAIN = "".join(_BASES[c] for c in ACCENTED)


def number(value: Column | str) -> Column:
    """Double, with text, NaN and null all read as null."""
    col = F.col(value) if isinstance(value, str) else value
    as_double = col.try_cast("double")
    return F.when(~F.isnan(as_double), as_double)


def month_start(year: Column, month: Column) -> Column:
    """First day of a bureau year and month; null outside 1900-2100 and 1-12."""
    y, m = number(year).cast("int"), number(month).cast("int")
    ok = m.between(1, 12) & y.between(1900, 2100)
    return F.when(ok, F.make_date(F.when(ok, y).otherwise(1900), F.when(ok, m).otherwise(1), F.lit(1)))


def non_negative(value: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(number(value), F.lit(0.0)))


def clipped_dpd(value: Column | str, cfg: Settings = DEFAULT) -> Column:
    return F.least(non_negative(value), F.lit(cfg.dpd_cap_days))


def first_present(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    have = set(columns)
    return next((c for c in candidates if c in have), None)


def row_max(columns: Sequence[str]) -> Column:
    cleaned = [number(c) for c in columns]
    return cleaned[0] if len(cleaned) == 1 else F.greatest(*cleaned)


def clean_text(value: Column | str) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.nullif(F.trim(col.cast("string")), F.lit(""))


def payee(*parts: Column) -> Column:
    """Normalised counterparty text: lower case, letters and single blanks only."""
    text = F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))
    text = F.regexp_replace(text, "[0-9]+", "")
    text = F.regexp_replace(text, "[^a-z ]", " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def _has_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(words))


def line_kind(counterparty: Column, hint: Column) -> Column:
    text = F.lower(F.concat(counterparty, F.lit(" "), F.coalesce(hint, F.lit(""))))
    return (
        F.when(_has_any(text, BNPL_WORDS), "bnpl")
        .when(_has_any(text, CARD_WORDS), "card")
        .when(_has_any(text, LOAN_WORDS), "loan")
        .otherwise("unknown")
    )


def account_kind(raw: Column) -> Column:
    return F.when(F.upper(raw).startswith("SAV"), "savings").otherwise("current")


def is_employment(text: Column) -> Column:
    return F.when(text.isNotNull(), _has_any(F.lower(text), EMPLOYMENT_WORDS).cast("double"))


def is_credit_account(text: Column) -> Column:
    return _has_any(F.lower(text), CREDIT_ACCOUNT_WORDS)


def is_salary(text: Column) -> Column:
    return text.rlike(SALARY_PATTERN)


def text_code(text: Column) -> Column:
    """The first six hex digits of the md5, as a number: a stable category code."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("double")


def plain_name(raw: Column) -> Column:
    """Upper-case name without accents, punctuation and titles."""
    ascii_text = F.regexp_replace(F.translate(F.coalesce(raw, F.lit("")), ACCENTED, PLAIN), "[̀-ͯ]", "")
    words = F.split(F.upper(F.regexp_replace(ascii_text, "[^A-Za-z ]", " ")), " +")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*TITLES))
    return F.array_join(kept, " ")


def name_spellings(raw: Column) -> Column:
    """Distinct spellings of a name: full, first and last, initial and last."""
    full = plain_name(raw)
    words = F.split(full, " ")
    n, first, last = F.size(words), F.get(words, F.lit(0)), F.element_at(words, -1)
    spellings = F.array(
        full,
        F.when(n > 2, F.concat_ws(" ", first, last)),
        F.when(n >= 2, F.concat_ws(" ", F.substring(first, 1, 1), last)),
    )
    return F.array_distinct(F.filter(spellings, lambda s: s.isNotNull()))


def to_monthly(amount: Column, period_days: Column, cfg: Settings = DEFAULT) -> Column:
    return F.when(period_days.between(26.0, 35.0), amount).otherwise(amount * (F.lit(cfg.days_per_month) / period_days))
