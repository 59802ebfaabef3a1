"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` with ``value`` worked out once: inside a lambda, an expression would be worked out again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_values(values: Column) -> Column:
    """Array centred and scaled to length 1; NULL if it is constant."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
    centred = let(mean, lambda m: F.transform(values, lambda v: v - m))

    def scaled(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
        return let(norm, lambda n: F.when(n > 0, F.transform(c, lambda v: v / n)))

    return let(centred, scaled)


def log2_positive(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def neg_log10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p))


def stars(p: Column, threshold: float = 0.05, missing: str = "nd") -> Column:
    return F.when(p.isNull() | F.isnan(p), missing).when(p < 0.001, "***").when(p < 0.01, "**").when(p < threshold, "*").otherwise("ns")


def regulation(fc: Column, p: Column, fc_limit: float = 1.0, p_limit: float = 0.05, inclusive: bool = False) -> Column:
    """Up, Down or NS; ``inclusive`` takes changes equal to the limit."""
    up = fc >= fc_limit if inclusive else fc > fc_limit
    down = fc <= -fc_limit if inclusive else fc < -fc_limit
    telling = F.coalesce(p < p_limit, F.lit(False))
    return F.when(telling & up, "Up").when(telling & down, "Down").otherwise("NS")


def html_text(x: Column, limit: int = 256) -> Column:
    """Trimmed, cut to ``limit`` characters, then escaped."""
    out = F.substring(F.trim(x), 1, limit)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def csv_text(x: Column) -> Column:
    """An apostrophe before text that a spreadsheet would read as a formula."""
    return F.when(F.substring(x, 1, 1).isin("=", "+", "-", "@", "\t"), F.concat(F.lit("'"), x)).otherwise(x)


def round_signed(x: Column, digits: int) -> Column:
    """Rounded half away from zero; a small negative number becomes a negative zero, as in SQL engines that round in doubles."""
    return F.when(x < 0, -F.round(-x, digits)).when(x == 0, x).otherwise(F.round(x, digits))


def roll(values: Column, shift: Column) -> Column:
    """Array rotated to the right by ``shift`` (any sign)."""
    n = F.size(values)
    s = F.pmod(shift, n)
    return F.when(s == 0, values).otherwise(F.concat(F.slice(values, n - s + 1, s), F.slice(values, F.lit(1), n - s)))


def ppm_axis(offset: float, width: float, n: int) -> Column:
    """n coordinates from ``offset`` down to ``offset - width``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(offset) - F.lit(width) * i / (n - 1))


def multiplet_pattern(positions: Column, heights: Column) -> Column:
    """singlet to quartet by number, evenness of spacing and closeness of heights to binomial ratios; else multiplet."""
    n = F.size(positions)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    gaps = F.zip_with(F.slice(positions, F.lit(2), n - 1), F.slice(positions, F.lit(1), n - 1), lambda a, b: F.abs(a - b))
    spread = let(gaps, lambda g: let(mean(g), lambda m: F.when(m > 0, F.sqrt(mean(F.transform(g, lambda x: (x - m) * (x - m)))) / m).otherwise(F.lit(1.0))))
    ideal = F.when(n == 2, F.array(F.lit(1.0), F.lit(1.0))).when(n == 3, F.array(F.lit(0.5), F.lit(1.0), F.lit(0.5))).when(n == 4, F.array(F.lit(1 / 3), F.lit(1.0), F.lit(1.0), F.lit(1 / 3)))
    off = let(F.array_max(heights), lambda top: mean(F.zip_with(heights, ideal, lambda h, i: F.abs(h / top - i))))
    name = F.when(n == 2, "doublet").when(n == 3, "triplet").otherwise("quartet")
    return F.when(n == 1, "singlet").when(n.between(2, 4) & F.coalesce((spread < 0.25) & (off <= 0.35), F.lit(False)), name).otherwise("multiplet")
