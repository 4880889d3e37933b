"""Column functions: canonical answers, ids, digests, safe numbers and arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions.draws import let

#: A whole number without sign for zero, without leading zeros; \z also rejects a trailing line feed.
CANONICAL = r"^(0|-?[1-9][0-9]*)\z"


def canonical_answer(terms: Column, size: int) -> Column:
    """The terms if there are `size` of them and all are canonical, else null."""
    fine = (F.size(terms) == size) & F.forall(terms, lambda x: F.coalesce(x.rlike(CANONICAL), F.lit(False)))
    return F.when(F.coalesce(fine, F.lit(False)), terms)


def sha256(*parts: Column, separator: str = "\n") -> Column:
    return F.sha2(F.concat_ws(separator, *parts).cast("binary"), 256)


def opaque_id(prefix: str, *parts: Column) -> Column:
    """The prefix and the first ten hex digits of a SHA-256 over the parts, upper-cased."""
    return F.concat(F.lit(prefix), F.upper(F.substring(sha256(*parts, separator=chr(31)), 1, 10)))


def safe_job_id(name: Column) -> Column:
    """Letters, digits, . _ and - only; what is longer than 100 is cut to 83, a dash and 16 hex digits of the whole."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-")
    return F.when(F.length(clean) > 100, F.concat(F.substring(clean, 1, 83), F.lit("-"), F.substring(sha256(clean), 1, 16))).otherwise(clean)


def genome_id(genes: Column) -> Column:
    """G- and twelve upper-case hex digits over the JSON of a struct whose fields stand in sorted order."""
    return F.concat(F.lit("G-"), F.upper(F.substring(F.sha2(F.to_json(genes).cast("binary"), 256), 1, 12)))


def subset_id(names: Column) -> Column:
    """Sixteen hex digits over the sorted names."""
    return F.substring(F.sha2(F.array_join(F.array_sort(names), "\n").cast("binary"), 256), 1, 16)


def compact(text: Column, others: Column, budget: int, caps: Sequence[int] = (120, 80, 40, 0)) -> Column:
    """The text under the first cap with which it and `others` characters stay within the budget."""
    out = F.substring(text, 1, caps[-1])
    for cap in reversed(caps[:-1]):
        out = F.when(F.least(F.length(text), F.lit(cap)) + others <= budget, F.substring(text, 1, cap)).otherwise(out)
    return out


def binomial_polynomial(coefficients: Column, x: Column) -> Column:
    """Sum of c_j times x over j, by a running product; decimal, so that nothing overflows."""
    big = "decimal(38,0)"
    step = lambda s, c: F.struct((s["sum"] + c.cast(big) * s["term"]).cast(big).alias("sum"), F.expr("0").cast("int").alias("z"), (s["term"] * (x - s["j"]) / (s["j"] + 1)).cast(big).alias("term"), (s["j"] + 1).alias("j"))
    start = F.struct(F.lit(0).cast(big).alias("sum"), F.lit(0).alias("z"), F.lit(1).cast(big).alias("term"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(coefficients, start, step, lambda s: s["sum"])


def differences(values: Column) -> Column:
    """First forward differences."""
    return F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a - b)


def fit_binomial(values: Column, degree: int) -> Column:
    """Coefficients of the binomial polynomial through the first degree + 1 values if it meets all values, else null.

    Each row of differences is made once, in a chain of lambdas; as plain expressions in each other it would be made four times for each row above it.
    """

    def fitted(first: Column, d: Column, heads: list[Column]) -> Column:
        if len(heads) > degree:
            return F.when((F.size(first) > degree) & F.forall(d, lambda x: x == 0), F.array(*heads))
        return let(differences(d), lambda own: fitted(first, own, [*heads, F.get(d, F.lit(0))]))

    return let(values, lambda own: fitted(own, own, []))


def floor_div(a: Column, b: Column) -> Column:
    """Division of whole numbers rounded down, in whole numbers throughout."""
    return F.call_function("div", a - floor_mod(a, b), b)


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return F.when(b > 0, F.pmod(a, b)).otherwise(-F.pmod(-a, -b))


def safe_number(x: Column) -> Column:
    """The number, 0 where it is null, not a number, infinite or negative."""
    return F.when(x.isNull() | F.isnan(x) | (x < 0) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clamped_confidence(x: Column) -> Column:
    return F.least(F.greatest(safe_number(x), F.lit(0.0)), F.lit(1.0))


def slot_name(text: Column, prefix: str = "S") -> Column:
    """The first number in a text as a two-digit slot; null without one."""
    n = F.regexp_extract(text, r"([0-9]+)", 1)
    return F.when(n != "", F.concat(F.lit(prefix), F.lpad(n, 2, "0")))


def links(html: Column) -> Column:
    """Targets of Markdown links."""
    return F.regexp_extract_all(html, F.lit(r"\]\(([^)\s]+)\)"), 1)


def scrub(text: Column) -> Column:
    """E-mail addresses, home folders and long hex tokens masked."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    out = F.regexp_replace(out, r"/(home|Users)/[A-Za-z0-9._-]+", "/$1/<user>")
    return F.regexp_replace(out, r"\b[0-9a-f]{32,}\b", "<token>")
