"""Column expressions shared by the operators: null rules, recoding, rounding, the normal tail.

Missing values are null throughout; NaN and infinities are never stored. All expressions stay inside
whole-stage code generation.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chromosome labels in report order; 10 is split in two for the analysis. Fixed values.
CHROMOSOMES = ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10a", "10b", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "21", "22", "X"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or either is null (SC10, PRJ7)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def log2_positive(x: Column | str) -> Column:
    """log2 of positive values, else null (PRJ9)."""
    return F.when(col(x) > 0, F.log2(col(x)))


def finite_or_null(x: Column | str) -> Column:
    """NaN and infinities become null (PRJ7)."""
    c = col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def weight_or_zero(w: Column | str) -> Column:
    """A missing or infinite weight counts as 0 (PRJ8)."""
    return F.coalesce(finite_or_null(w), F.lit(0.0))


def midpoint(a: Column | str, b: Column | str) -> Column:
    return (col(a) + col(b)) / 2


def half_hypotenuse(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(col(a) * col(a) + col(b) * col(b)) / 2


#: Step and number of terms of the trapezoidal sum below: its error is exp(-(pi / step)^2), the first term left out exp(-(13 step)^2).
_STEP, _TERMS = 0.5, 13


def _scaled_tail(z: Column) -> Column:
    """exp(z^2 / 2) times the two-sided tail at z, for z of 0.7 and more.

    The tail is an integral of exp(-t^2) / (t^2 + x^2) over all t, with x = z / sqrt(2). The trapezoidal rule
    gives such an integral to full precision with few steps; what the pole at i x adds is known in closed form.
    """
    y = z * z / 2
    total = 1 / (2 * y)
    for k in range(1, _TERMS):
        t = (k * _STEP) ** 2
        total = total + math.exp(-t) / (y + t)
    x = z * math.sqrt(0.5)
    # Beyond x = 6 the pole's part is below the precision, and its exponential would overflow.
    pole = F.when(x < 6, 2 * F.exp(y) / (1 - F.exp(x * (2 * math.pi / _STEP)))).otherwise(0.0)
    return x * total * (2 * _STEP / math.pi) + pole


def _one_less_erf(z: Column) -> Column:
    """The two-sided tail at z below 0.7, by the power series of the error function."""
    y = z * z / 2
    total: Column = F.lit(0.0)
    for n in range(13, -1, -1):
        total = total * y + (-1.0) ** n / (math.factorial(n) * (2 * n + 1))
    return 1 - z * math.sqrt(2 / math.pi) * total


def normal_two_sided(z: Column | str) -> Column:
    """Two-sided normal tail 2 * P(N > |z|), to some 1e-15 of its value (SC7).

    The square in the exponent is taken in two parts, the first of which is exact, so far tails keep their precision.
    """
    a = F.abs(col(z).cast("double"))
    head = F.floor(a * 16) / 16
    decay = F.exp(-head * head / 2) * F.exp(-(a - head) * (a + head) / 2)
    return F.when(a < 0.7, _one_less_erf(a)).when(a < 39, decay * _scaled_tail(a)).when(a.isNotNull(), F.lit(0.0))


def log_normal_two_sided(z: Column | str) -> Column:
    """Natural logarithm of normal_two_sided, also where that is too small for a double."""
    a = F.abs(col(z).cast("double"))
    return F.when(a < 0.7, F.ln(_one_less_erf(a))).when(a.isNotNull(), F.ln(_scaled_tail(a)) - a * a / 2)


def chr_number(label: Column | str) -> Column:
    """Numeric chromosome: optional ``chr`` taken off, X is 23, 10a is 10.1, 10b is 10.2; other text is null (PRJ18)."""
    bare = F.regexp_replace(col(label), "^chr", "")
    return F.when(bare == "X", F.lit(23.0)).when(bare == "10a", F.lit(10.1)).when(bare == "10b", F.lit(10.2)).otherwise(bare.try_cast("double"))


def chr_label(number: Column | str) -> Column:
    """Label with ``chr`` of a chromosome number, the other way round (PRJ18, JN12)."""
    n = col(number).cast("double")
    return F.when(n == 23, "chrX").when(n == 10.1, "chr10a").when(n == 10.2, "chr10b").otherwise(F.concat(F.lit("chr"), n.cast("int").cast("string")))


def recode(c: Column | str, values: Mapping[str, object]) -> Column:
    """values[c] where it is listed, else c (PRJ18)."""
    out, first = col(c), True
    case = None
    for k, v in values.items():
        case = F.when(col(c) == k, F.lit(v)) if first else case.when(col(c) == k, F.lit(v))
        first = False
    return out if case is None else case.otherwise(out)


def split_label(label: Column | str, position: Column | str, which: str, at: float, below: str, from_: str) -> Column:
    """Label ``which`` becomes ``below`` left of ``at`` and ``from_`` right of it (PRJ16)."""
    return F.when(col(label) != which, col(label)).when(col(label).isNotNull(), F.when(col(position) < at, below).otherwise(from_))


def merge_labels(label: Column | str, parts: Sequence[str], whole: str) -> Column:
    """Undo split_label (PRJ17)."""
    return F.when(col(label).isin(*parts), whole).otherwise(col(label))


def rescale(value: Column | str, region: Column | str, factors: Mapping[str, Column | float]) -> Column:
    """value times factors[region]; other regions are unchanged (PRJ21)."""
    factor: Column = F.lit(1.0)
    for r, f in factors.items():
        factor = F.when(col(region) == r, f if isinstance(f, Column) else F.lit(float(f))).otherwise(factor)
    return col(value) * factor


def blank_to_null(c: Column | str) -> Column:
    """PRJ6."""
    return F.nullif(col(c), F.lit(""))


def null_to_dot(c: Column | str) -> Column:
    """PRJ6, for text sinks."""
    return F.coalesce(col(c).cast("string"), F.lit("."))


def rounded_even(c: Column | str, digits: int = 0) -> Column:
    """Half to even (SC5)."""
    return F.bround(col(c), digits)


def order_rank(c: Column | str, order: Sequence[str]) -> Column:
    """Place of a category in a fixed order, null if it isn't listed (SO4)."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), col(c)).cast("int"), F.lit(0))


def matches_word(text: Column | str, word: Column | str) -> Column:
    """Case-insensitive: ``word`` between underscores in ``text`` (SC2)."""
    return F.lower(col(text)).contains(F.concat(F.lit("_"), F.lower(col(word)), F.lit("_")))


def tokens_other_than(pattern: Column | str, token: str = "1") -> Column:
    """Distinct blank-separated tokens other than ``token`` (SC4, ST5)."""
    return F.array_except(F.split(col(pattern), " "), F.array(F.lit(token)))
