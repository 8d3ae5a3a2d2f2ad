"""Selection predicates over one dimension, as columns that reach the scan."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(dim: str, values: list, how: str = "exact") -> Column:
    """exact, icase (ignores case), prefix or regexp; a value `#re#` is a pattern whatever the kind."""

    def one(v) -> Column:
        c = F.col(dim)
        if isinstance(v, str) and len(v) > 2 and v[0] == v[-1] == "#":
            return c.rlike(v[1:-1])
        return {"exact": lambda: c == v, "icase": lambda: F.lower(c) == str(v).lower(), "prefix": lambda: c.startswith(v), "regexp": lambda: c.rlike(v)}[how]()

    return reduce(lambda a, b: a | b, map(one, values))


def within(dim: str, kind: str, *bounds) -> Column:
    """before, incbefore, after, incafter one bound; between or outside pairs of bounds."""
    c = F.col(dim)
    if kind in ("between", "outside"):
        inside = reduce(lambda a, b: a | b, (c.between(lo, hi) for lo, hi in zip(bounds[::2], bounds[1::2])))
        return inside if kind == "between" else ~inside
    return {"before": c < bounds[0], "incbefore": c <= bounds[0], "after": c > bounds[0], "incafter": c >= bounds[0]}[kind]


def found_at(text: Column, part: str) -> Column:
    """Where a part first stands, from 1; 0 if it doesn't."""
    return F.instr(text, part)


def part_match(text: Column, pattern: str, values: list[str]) -> Column:
    """Whether what the pattern's group picks is one of the values."""
    return F.regexp_extract(text, pattern, 1).isin(*values)


def nested_match(texts: Column, values: list[str]) -> Column:
    """Whether any of an array's texts is one of the values."""
    return F.exists(texts, lambda t: t.isin(*values))
