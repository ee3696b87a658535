"""Column expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels used when a gene or an id has no match.
NO_GENE_FOUND = "No_Gene_Found"
NO_ENTREZ_FOUND = "No_Entrez_Found"


def hashed(seed: int, *keys: Column | str) -> Column:
    """A number below 2^52 from the first 13 hexadecimal digits of the MD5 of seed and keys, joined by ``|``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def hashed_unit(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from ``hashed``."""
    return hashed(seed, *keys) / float(1 << 52)


def prize(x: Column) -> Column:
    """P1. Score to prize."""
    return x * x


def clamp_high(s_high: Column, p: Column) -> Column:
    """P2. Upper size bound limited to ``p - 1``."""
    return F.least(s_high, p - 1)


def recovered(err: Column, tol: float, zero_is_failure: bool = False) -> Column:
    """P7. 1 when the error is within ``tol``.

    ``zero_is_failure`` counts an error of exactly zero as a failure.
    """
    ok = err <= tol
    if zero_is_failure:
        ok = ok & (err != 0.0)
    return F.when(ok, 1).otherwise(0)


def guard(condition: Column, message: str, value: Column) -> Column:
    """P8. ``value`` where ``condition`` holds; the query fails elsewhere."""
    return F.when(condition, value).otherwise(
        F.raise_error(F.lit(message)).cast("double")
    )


def non_negative(value: Column) -> Column:
    return guard(value >= 0, "prizes must not be negative", value)


def sign_label(y: Column) -> Column:
    """P9. Response to a class of +1 or -1 by sign."""
    return F.when(y > 0, 1).otherwise(-1)


def predicted_label(probability: Column) -> Column:
    """P9. Class of +1 or -1, cut at one half."""
    return F.when(probability < 0.5, -1).otherwise(1)


def sigmoid(x: Column) -> Column:
    """F1. Logistic function that never overflows."""
    small = F.exp(-F.abs(x))
    return F.when(x > 0, 1 / (1 + small)).otherwise(small / (1 + small))


def log_sigmoid(x: Column) -> Column:
    """F2. Logarithm of the logistic function."""
    tail = F.log1p(F.exp(-F.abs(x)))
    return F.when(x > 0, -tail).otherwise(x - tail)


def split_words(text: Column, sep: str = " ") -> Column:
    """F3. Parts of a multi-valued field without empty parts."""
    return F.filter(F.split(text, sep), lambda part: F.length(part) > 0)


def harmonic_mean(auc: Column, node_f: Column) -> Column:
    """F5. Harmonic mean of two rates, both checked to lie in [0, 1]."""
    inside = auc.between(0.0, 1.0) & node_f.between(0.0, 1.0)
    mean = F.when(auc + node_f > 0, 2 * auc * node_f / (auc + node_f)).otherwise(0.0)
    return guard(inside, "both rates must lie in [0, 1]", mean)


def cell_node(r: Column, c: Column, width: int) -> Column:
    """F6. Row-major node id of a cell."""
    return r * width + c


def node_cell(node: Column, width: int) -> tuple[Column, Column]:
    """F6. Row and column of a row-major node id."""
    return F.floor(node / width), F.pmod(node, F.lit(width))


def mean_sd_text(mean: Column, sd: Column, digits: int = 3) -> Column:
    """F7. ``mean ± sd`` as text."""
    return F.format_string(f"%.{digits}f ± %.{digits}f", mean, sd)


def fixed(value: Column, digits: int = 8) -> Column:
    """Decimal text of the exact binary value with ``digits`` decimals; exact halves go to the even digit, as in C.

    ``format_string`` rounds the shortest decimal text of a number instead, halves upwards.  The fraction of a number
    is exact, so it is formatted on its own and carried into the whole part.
    """
    size = F.abs(value)
    whole = F.floor(size)
    pattern = F.lit("0." + "0" * digits)
    part = F.call_function("format_number", size - whole, pattern)
    carried = F.concat((whole + F.substring(part, 1, 1).cast("long")).cast("string"), F.substring(part, 2, digits + 1))
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    return F.when(size < 9e18, F.concat(sign, carried)).otherwise(F.format_string(f"%.{digits}f", value))


def power_grid(first: float, step: float, last: float, scale: Column | float = 1.0) -> Column:
    """F8. Array of ``scale * 2 ** e`` for exponents from ``first`` to ``last``."""
    count = int(round((last - first) / step))
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    exponents = F.sequence(F.lit(0), F.lit(count))
    return F.transform(exponents, lambda k: scale * F.pow(F.lit(2.0), first + k * step))


def sparse_dot(x: Column, idx: Column, w: Column) -> Column:
    """Dot product of a dense array with a sparse vector (index and value arrays)."""
    terms = F.zip_with(idx, w, lambda i, v: F.get(x, i) * v)
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def dot(x: Column, w: Column) -> Column:
    """Dot product of two arrays of equal length."""
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, t: a + t)
