"""Vector columns: arrays of floats, accumulated in double. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda, an outer expression is computed anew for
    each element."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null or the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column, eps: float | None = None) -> Column:
    """Unit vector in double. A zero vector stays as it is; with ``eps`` the norm is at least that."""

    def scaled(w: Column) -> Column:
        n = F.greatest(norm(w), F.lit(eps)) if eps is not None else F.when(norm(w) == 0, F.lit(1.0)).otherwise(norm(w))
        return let(n, lambda m: F.transform(w, lambda x: x.cast("double") / m))

    return F.when(v.isNotNull(), let(v, scaled))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of any two vectors; null where one is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def _stats(values: Column, name: str, size: Column) -> dict[str, Column]:
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / size
    spread = let(mean, lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return {f"{name}_mean": mean, f"{name}_std": F.sqrt(spread / size)}


def pair_features(a: Column, b: Column) -> dict[str, Column]:
    """Nine symmetric features of a pair; standard deviations are of the population."""
    size = F.size(a).cast("double")
    diff = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    squares = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)
    d, p = _stats(diff, "diff", size), _stats(prod, "prod", size)
    return {
        "cosine": dot(a, b), "distance": F.sqrt(squares),
        "diff_mean": d["diff_mean"], "diff_std": d["diff_std"], "diff_max": F.array_max(diff),
        "prod_mean": p["prod_mean"], "prod_std": p["prod_std"], "prod_min": F.array_min(prod), "prod_max": F.array_max(prod),
    }


def product_features(a: Column, b: Column, width: int | None = None) -> Column:
    """``[a * b, |a - b|, a . b]`` over the first ``width`` components: the pair network's input."""
    if width is not None:
        a, b = F.slice(a, 1, width), F.slice(b, 1, width)
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    diff = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.concat(prod, diff, F.array(dot(a, b)))


def fuse(deep: Column, colour: Column, weight: float) -> Column:
    """One vector whose dot product is the weighted sum of the two parts' (both of unit norm)."""
    left, right = (1 - weight) ** 0.5, weight**0.5
    return F.concat(
        F.transform(deep, lambda x: x.cast("double") * left), F.transform(colour, lambda x: x.cast("double") * right)
    )


def route(v: Column, label: Column, specialists: list[str], specialist_dim: int, general_dim: int) -> Column:
    """Place ``v`` in the specialist's or the general slice by label, zeros in the other."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    wide = F.transform(v, lambda x: x.cast("double"))
    return F.when(label.isin(specialists), F.concat(wide, zeros(general_dim))).otherwise(F.concat(zeros(specialist_dim), wide))


def checked(v: Column, dim: int) -> Column:
    """``v``, or an error where its width isn't ``dim``; null stays null."""
    message = F.concat(F.lit(f"expected {dim} components, got "), F.size(v).cast("string"))
    return F.when(v.isNull() | (F.size(v) == dim), v).otherwise(F.raise_error(message))
