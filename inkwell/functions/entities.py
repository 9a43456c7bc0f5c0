"""IBANs and amounts in texts: extraction, check digits, match rates, the bank score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# The patterns that define what counts as an IBAN and an amount, and the weights of the bank score.
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?\b"
AMOUNT = r"(?:\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?\s?(?:EUR|USD|GBP|CHF|\$|€|£)\b)|(?:\b(?:EUR|USD|GBP|CHF|\$|€|£)\s?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?\b)"
DECIMAL = r"\b\d{1,9}[.,]\d{2}\b"
WEIGHTS = (0.35, 0.25, 0.20, 0.20)


def _all(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(0))


def _tight(value: Column) -> Column:
    return F.regexp_replace(value, r"\s+", "")


def ibans(value: Column) -> Column:
    """IBAN-shaped strings of 15 characters or more, without blanks, repeats included."""
    return F.filter(F.transform(_all(F.upper(F.coalesce(value, F.lit(""))), IBAN), _tight), lambda x: F.length(x) >= 15)


def mod97(value: Column) -> Column:
    """The remainder of digits and letters (A = 10, ..., Z = 35), a character at a time."""
    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, F.pmod(rest * 100 + code - 55, F.lit(97))).otherwise(F.pmod(rest * 10 + code - 48, F.lit(97)))

    return F.aggregate(F.split(value, ""), F.lit(0), step)


def iban_valid(value: Column) -> Column:
    """Shape, length and check digits."""
    clean = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    shape = clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}$")
    turned = F.concat(F.substring(clean, 5, 1 << 20), F.substring(clean, 1, 4))
    return F.coalesce(F.when(shape, mod97(turned) == 1), F.lit(False))


def make_iban(country: Column, account: Column) -> Column:
    """Country, check digits and account, in groups of four."""
    check = F.lit(98) - mod97(F.concat(account, country, F.lit("00")))
    return F.regexp_replace(F.concat(country, F.lpad(check.cast("string"), 2, "0"), account), "(.{4})(?=.)", "$1 ")


def amounts(value: Column) -> Column:
    """Amounts with a currency, then plain decimals; without blanks, lower case, first occurrences."""
    value = F.coalesce(value, F.lit(""))
    return F.array_distinct(F.transform(F.concat(_all(value, f"(?i){AMOUNT}"), _all(value, DECIMAL)), lambda x: F.lower(_tight(x))))


def matched(reference: Column, hypothesis: Column) -> Column:
    return F.size(F.filter(reference, lambda x: F.array_contains(hypothesis, x)))


def match_rate(reference: Column, hypothesis: Column) -> Column:
    """The share of the reference's items that the hypothesis has; null if there are none."""
    return F.when(F.size(reference) > 0, matched(reference, hypothesis) / F.size(reference))


def valid_rate(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.size(F.filter(found, iban_valid)) / F.size(found))


def _percent(part: Column, whole: Column) -> Column:
    return F.concat(part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(" ("), F.bround(part * 100 / whole, 0).cast("int").cast("string"), F.lit("%)"))


# The wording of the status texts below.


def iban_text(reference: Column, hypothesis: Column) -> Column:
    main = F.when(F.size(reference) > 0, F.concat(F.lit("IBANs matched: "), _percent(matched(reference, hypothesis), F.size(reference)))).otherwise("Not applicable: no IBAN in the reference.")
    more = F.concat(F.lit(" | Output validity: "), _percent(F.size(F.filter(hypothesis, iban_valid)), F.size(hypothesis)), F.lit(" valid"))
    return F.concat(main, F.when(F.size(hypothesis) > 0, more).otherwise(""))


def amount_text(reference: Column, hypothesis: Column) -> Column:
    return F.when(F.size(reference) > 0, F.concat(F.lit("Amounts matched: "), _percent(matched(reference, hypothesis), F.size(reference)))).otherwise("Not applicable: no amount in the reference.")


def weighted(values: list[Column], weights: tuple[float, ...] = WEIGHTS) -> Column:
    """The mean of the values that are not null, with their weights."""
    part = lambda v, x: F.when(v.isNotNull(), x).otherwise(F.lit(0.0))
    total, used = F.lit(0.0), F.lit(0.0)
    for v, w in zip(values, weights, strict=True):
        total, used = total + part(v, v * F.lit(w)), used + part(v, F.lit(w))
    return total / used


def with_bank_scores(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """The rows with all scores of the bank mode.

    Entities are found once, rates computed once: each step is a projection of its
    own, which later ones read more than once, so the optimiser keeps it.
    """
    r, h = F.col(reference), F.col(hypothesis)
    own, found, sums, seen = (F.col(c) for c in ("own_", "found_", "sums_", "seen_"))
    rows = rows.withColumns({"own_": ibans(r), "found_": ibans(h), "sums_": amounts(r), "seen_": amounts(h)})
    rows = rows.withColumns({
        "numeric_cer": text.numeric_cer(r, h), "iban_emr": match_rate(own, found), "iban_valid_rate": valid_rate(found), "iban_status": iban_text(own, found),
        "amount_emr": match_rate(sums, seen), "amount_status": amount_text(sums, seen), "general_accuracy": text.accuracy(text.cer(r, h)), "general_wer": text.wer(r, h),
    })
    score = weighted([F.col("iban_emr"), F.col("amount_emr"), text.accuracy(F.col("numeric_cer")), F.col("general_accuracy")])
    return rows.withColumn("bank_score", score).drop("own_", "found_", "sums_", "seen_")
