"""Phone numbers of accounts: normal form, what is wrong with one, masked display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, LONGEST, TAIL = 7, 15, 4


def cleaned(phone: Column) -> Column:
    """Without blanks, hyphens and brackets."""
    return F.regexp_replace(F.trim(phone), r"[\s\-()]", "")


def problem(phone: Column) -> Column:
    """The first thing wrong with a number, else null."""
    bare = cleaned(phone)
    digits = F.substr(bare, F.lit(2))
    return (
        F.when(F.coalesce(F.trim(phone), F.lit("")) == "", "empty_input").when(bare == "", "empty_after_strip").when(~bare.startswith("+"), "missing_plus_prefix")
        .when(digits == "", "no_digits").when(~digits.rlike("^[0-9]+$"), "contains_non_digits").when(F.length(digits) < SHORTEST, "too_short").when(F.length(digits) > LONGEST, "too_long")
    )


def normalized(phone: Column) -> Column:
    """``+`` and digits; null for a bad number."""
    return F.when(problem(phone).isNull(), cleaned(phone))


def masked(number: Column) -> Column:
    """A normal number with only its country code and last four digits; none of the rest if that is six digits or fewer."""
    digits = F.substr(number, F.lit(2))
    code = F.when((F.length(digits) == 11) & digits.startswith("1"), 1).otherwise(2)
    rest = F.length(digits) - code
    shown = F.concat(F.lit("+"), digits.substr(F.lit(1), code), F.lit(" ******"))
    return F.when(rest <= TAIL + 2, shown).otherwise(F.concat(shown, F.right(digits, F.lit(TAIL))))


def quality_report(accounts: DataFrame, phone: str = "phone") -> DataFrame:
    """Accounts by state of their number: ``status, n``."""
    return accounts.groupBy(F.coalesce(problem(F.col(phone)), F.lit("ok")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def protection_audit(accounts: DataFrame, phone: str = "phone") -> DataFrame:
    """What a migration to protected numbers would do with each account, counted (nothing is changed)."""
    text = F.trim(F.col(phone))
    status = F.when(F.coalesce(text, F.lit("")) == "", "no_number").when(text.contains("*"), "already_masked").when(problem(F.col(phone)).isNotNull(), "invalid").otherwise("to_protect")
    return accounts.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
