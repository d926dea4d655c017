"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times: a lambda body would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    """Vector divided by its norm; a zero vector stays zero."""
    def scaled(p: Column) -> Column:
        n = F.when(p["n"] == 0, F.lit(1.0)).otherwise(p["n"])
        return F.transform(p["v"], lambda x: x.cast("double") / n)

    return let(a, lambda v: let(F.struct(v.alias("v"), norm(v).alias("n")), scaled))


def cosine(a: Column, b: Column, zero: str = "zero") -> Column:
    """``zero``: 0 for a zero vector; ``epsilon``: add 1e-9 to the denominator; ``one``: a zero norm counts as 1."""
    na, nb = norm(a), norm(b)
    if zero == "zero":
        return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    if zero == "epsilon":
        return dot(a, b) / (na * nb + F.lit(1e-9))
    if zero == "one":
        return dot(a, b) / (F.when(na == 0, F.lit(1.0)).otherwise(na) * F.when(nb == 0, F.lit(1.0)).otherwise(nb))
    raise ValueError(zero)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Word-hash embedding that needs no model: signed counts of hashed words, unit length."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    # A word's number is made of the first 32 bits of its md5, so other engines can follow: twice the slot, odd for minus.
    number = F.transform(words, lambda w: let(F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast("bigint"), lambda h: (
        F.pmod(h, F.lit(size)) * 2 + F.shiftright(h, 24).bitwiseAND(F.lit(1))).cast("int")))

    def counts(ws: Column) -> Column:
        met = lambda n: F.size(ws) - F.size(F.array_remove(ws, n))
        return F.array(*[(met(2 * i) - met(2 * i + 1)).cast("double") for i in range(size)])

    return unit(let(number, counts))
