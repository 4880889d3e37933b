"""Random numbers from digests, in column expressions: a number depends on its label and index alone, so any engine and any task gets the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a word, and words that are tried for a number without bias: one is refused with a chance of n in 2 to the power 52.
BITS, TRIES = 52, 4


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(*label: Column | str) -> tuple[Column, Column]:
    """Two words of 52 bits, longs, from the MD5 of the label's parts with | between them."""
    digest = F.md5(F.concat_ws("|", *label).cast("binary"))
    return _word(digest, 0), _word(digest, 1)


def _word(digest: Column, which: int) -> Column:
    return F.conv(F.substring(digest, 1 + 13 * which, 13), 16, 10).cast("long")


def below(n: Column, *label: Column | str) -> Column:
    """A long from 0 to n - 1, each as likely: the first word that lies in the multiples of n below 2 to the power 52, modulo n.

    n is 1 to 2^40; should TRIES words all be refused, whose chance is below 2^-48, the last one is taken modulo n.
    """
    tried = [words(*label, F.lit(i))[0] for i in range(TRIES)]
    limit = F.lit(1 << BITS) - F.lit(1 << BITS) % n
    return F.coalesce(*[F.when(w < limit, w % n) for w in tried[:-1]], tried[-1] % n)


def below_of(pair: Column, n: Column) -> Column:
    """A long from 0 to n - 1 from two words, as below() makes it; should both be refused, whose chance is below (n / 2^52)^2, the second one is taken modulo n."""
    limit = F.lit(1 << BITS) - F.lit(1 << BITS) % n
    return F.when(pair["first"] < limit, pair["first"] % n).otherwise(pair["second"] % n)


def pairs(many: int, *label: Column | str) -> Column:
    """An array of `many` pairs of words, by the label and the pair's number."""

    def pair(i: Column) -> Column:
        return let(F.md5(F.concat_ws("|", *label, i).cast("binary")), lambda h: F.struct(_word(h, 0).alias("first"), _word(h, 1).alias("second")))

    return F.transform(F.sequence(F.lit(0), F.lit(many - 1)), pair)


def choice(options: Sequence, *label: Column | str) -> Column:
    """One of the options, each as likely."""
    return F.get(F.array(*[F.lit(o) for o in options]), below(F.lit(len(options)).cast("long"), *label).cast("int"))


def unit(word: Column) -> Column:
    """A double in the middle of the word's share of 0 to 1, exactly."""
    return (word + F.lit(0.5)) / F.lit(float(1 << BITS))


def between_sql(n: str, *label: str) -> str:
    """below() in DuckDB."""
    word = lambda i: f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(label)}, '{i}')), 1, 13) AS BIGINT)"
    limit = f"({1 << BITS} - {1 << BITS} % {n})"
    return "coalesce(" + ", ".join(f"CASE WHEN {word(i)} < {limit} THEN {word(i)} % {n} END" for i in range(TRIES - 1)) + f", {word(TRIES - 1)} % {n})"
