"""Text expressions that follow Python's Unicode rules where Java's defaults don't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = "(?U)\\s+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it; keeps plans small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, _WS, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def snippet(c: Column, most: int = 140) -> Column:
    """Squeezed text of at most ``most`` characters; longer text ends in three dots. Null gives ''."""
    cut = lambda s: F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 3), F.lit("...")))
    return let(squeeze(F.coalesce(c, F.lit(""))), cut)


def samples(items: Column, most: int, count: int = 3) -> Column:
    """The first few items as quoted snippets, comma separated."""
    return F.array_join(F.transform(F.slice(items, 1, count), lambda x: F.concat(F.lit("'"), snippet(x, most), F.lit("'"))), ", ")


def and_more(items: Column, shown: int) -> Column:
    n = F.size(items)
    return F.when(n > shown, F.concat(F.lit(" (and "), (n - shown).cast("string"), F.lit(" more)"))).otherwise("")


def folded(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Regular expression replacements one after another."""
    for pattern, to in pairs:
        c = F.regexp_replace(c, pattern, to)
    return c


def any_contains(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def words_of(c: Column) -> Column:
    """Unicode word runs of more than one character."""
    return F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?U)(\\w+)"), F.lit(1)), lambda w: F.length(w) > 1)
