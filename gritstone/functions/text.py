"""Column expressions for text and vectors. All stay on the JVM, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Without white space, in the Unicode sense, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def words(c: Column) -> Column:
    """The parts between runs of white space; none for a blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def is_upper(w: Column) -> Column:
    """Has a cased character, and none of lower case."""
    return w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")


def is_title(s: Column) -> Column:
    """Each word, at any non-letter, begins in upper case and goes on in lower case."""
    return s.rlike(r"^[^\p{L}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$")


def starts_upper(w: Column) -> Column:
    return w.rlike(r"^\p{Lu}")


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def in_list(w: Column, entries) -> Column:
    return w.isin(*sorted(entries)) if entries else F.lit(False)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(a: Column, eps: float = 1e-12) -> Column:
    n = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def softmax(v: Column) -> Column:
    exps = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda s, y: s + y))


def argmax(v: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ordered_join(order: Column, value: Column, sep: str) -> Column:
    """An aggregate: values joined in the order of a key, whatever order rows arrive in."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), value.alias("v")))), lambda x: x["v"]), sep)
