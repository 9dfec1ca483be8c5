"""Column functions that turn source fields, which come in several spellings and types, into typed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of status texts.
STATUS_INCLUDED = ("active", "completed", "executed", "finished", "signed", "действ", "исполн", "заверш", "подпис")
STATUS_EXCLUDED = ("draft", "чернов", "cancel", "отмен", "terminated", "расторг", "аннули", "deleted", "удален")
ACT_APPROVED = ("approve", "approved", "утверж", "одобрен")
ACT_DRAFT = ("draft", "чернов")
ACT_PENDING = ("pending", "ожида", "на соглас", "process")


def first_text(*aliases: Column) -> Column:
    """The first alias whose trimmed text is not empty, else ''."""
    return F.coalesce(*(F.nullif(F.trim(a.cast("string")), F.lit("")) for a in aliases), F.lit(""))


def first_present(*aliases: Column) -> Column:
    """The first alias that is not null."""
    return F.coalesce(*aliases)


def to_uint(value: Column, default: int = 0) -> Column:
    """Unsigned integer of a text: its digits; a leading minus gives 0, no digit or null the default, true and false 1
    and 0."""
    text = F.lower(F.trim(value.cast("string")))
    digits = F.regexp_replace(F.regexp_replace(text, r"\.0+$", ""), "[^0-9]", "")
    number = F.when(text.isin("true", "false"), (text == "true").cast("long")).when(text.startswith("-"), F.lit(0).cast("long")).otherwise(F.nullif(digits, F.lit("")).try_cast("long"))
    return F.coalesce(number, F.lit(default).cast("long"))


def clamp(value: Column, bits: int) -> Column:
    """Into the range of an unsigned integer of so many bits."""
    return F.least(F.greatest(value, F.lit(0)), F.lit((1 << bits) - 1))


def to_decimal(value: Column, scale: int = 2, default: Column | None = None) -> Column:
    """Decimal of a text without its blanks; a single comma and no point is a decimal point; half up to ``scale``."""
    text = F.regexp_replace(value.cast("string"), r"(?U)\s", "")
    commas = F.length(text) - F.length(F.regexp_replace(text, ",", ""))
    plain = F.when((commas == 1) & ~F.contains(text, F.lit(".")), F.regexp_replace(text, ",", ".")).otherwise(F.regexp_replace(text, ",", ""))
    number = F.round(plain.try_cast("decimal(30,10)"), scale).cast(f"decimal(18,{scale})")
    return F.coalesce(number, default if default is not None else F.lit(0).cast(f"decimal(18,{scale})"))


def to_flag(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    yes, no = text.isin("true", "yes", "y", "1", "active"), text.isin("false", "no", "n", "0", "inactive")
    return F.when(yes, 1).when(no, 0).otherwise(F.coalesce((text.try_cast("double") > 0).cast("int"), F.lit(0)))


def to_timestamp(value: Column, default: Column | None = None) -> Column:
    """UTC without a zone: ISO text (Z and offsets are applied), epoch seconds or, above 1e10, milliseconds, and
    'yyyy-MM-dd HH:mm:ss', 'dd.MM.yyyy HH:mm:ss', 'dd.MM.yyyy'; else ``default``."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))
    # years written alone are no epochs
    epoch = F.timestamp_seconds(F.when(number > 1e10, number / 1000).otherwise(number))
    utc = lambda c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    spelled = [F.try_to_timestamp(F.when(text.rlike(shape), text), F.lit(p)) for shape, p in ((r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}$", "dd.MM.yyyy HH:mm:ss"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"))]
    out = utc(F.coalesce(epoch, iso, *spelled))
    return out if default is None else F.coalesce(out, default)


def clamp_timestamp(value: Column) -> Column:
    """Into 1970-01-01 to 2100-01-01."""
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1970-01-01", "2100-01-01"))
    return F.least(F.greatest(value, low), high)


def code_prefix(code: Column, n: int) -> Column:
    """The first ``n`` digits."""
    return F.substring(F.regexp_replace(code, "[^0-9]", ""), 1, n)


def _has(text: Column, tokens: Sequence[str]) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).rlike("|".join(tokens))


def status_allowed(status_id: Column, text: Column) -> Column:
    """An excluded word drops the record, an included one keeps it; other texts pass with an id of 0 or more."""
    return F.when(_has(text, STATUS_EXCLUDED), False).when(_has(text, STATUS_INCLUDED), True).otherwise(F.coalesce(status_id, F.lit(0)) >= 0)


def act_status(status_id: Column, text: Column) -> Column:
    """approved, draft or pending by words, then by id; else other."""
    by_id = F.when(status_id.isin(2, 3, 4), "approved").when(status_id.isin(0, 1), "pending").otherwise("other")
    return F.when(_has(text, ACT_APPROVED), "approved").when(_has(text, ACT_DRAFT), "draft").when(_has(text, ACT_PENDING), "pending").otherwise(by_id)


def hash_id(*parts: Column) -> Column:
    """Signed 64-bit id of the parts joined by colons: first eight bytes of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 16), 16, -10).cast("long")


def units_or_self(units: Column, itself: Column) -> Column:
    """The nested units, or the record itself as the only one where there are none."""
    return F.when(F.size(units) > 0, units).otherwise(F.array(itself))


def unit_price(price: Column, amount: Column, quantity: Column) -> Column:
    """amount / quantity to two places where the price is missing and both are positive."""
    derived = F.round((amount / quantity).cast("decimal(28,8)"), 2).cast("decimal(18,2)")
    return F.when((F.coalesce(price, F.lit(0)) <= 0) & (amount > 0) & (quantity > 0), derived).otherwise(price)


def total_or_nested(total: Column, amounts: Column) -> Column:
    """The total, or the sum of nested amounts where it is not positive."""
    nested = F.aggregate(amounts, F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + F.coalesce(x, F.lit(0).cast("decimal(18,2)"))).cast("decimal(28,2)"))
    return F.when(F.coalesce(total, F.lit(0)) > 0, total).otherwise(nested.cast("decimal(18,2)"))


def codes_of(*lists: Column) -> Column:
    """All codes of the lists in order, without blanks and repeats."""
    flat = F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
    return F.array_distinct(F.filter(F.transform(flat, lambda c: F.trim(c)), lambda c: F.length(c) > 0))
