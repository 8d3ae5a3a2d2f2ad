"""Queries of nested records: predicates by dotted path, defaults, result tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def match(conditions: dict[str, object]) -> Column:
    """All of the conditions, by dotted path; `~path` negates.

    A value may be `*` (there), a list (any of), a callable from column to predicate, `#re#` (pattern from the start) or a plain value.
    """

    def one(path: str, wanted) -> Column:
        c = F.col(path.removeprefix("~"))
        if isinstance(wanted, str) and wanted == "*":
            found = c.isNotNull()
        elif callable(wanted):
            found = wanted(c)
        elif isinstance(wanted, (list, tuple)):
            found = c.isin(*wanted)
        elif isinstance(wanted, str) and len(wanted) > 2 and wanted[0] == wanted[-1] == "#":
            found = c.rlike(f"^(?:{wanted[1:-1]})")
        else:
            found = c == wanted
        found = F.coalesce(found, F.lit(False))
        return ~found if path.startswith("~") else found

    return reduce(lambda a, b: a & b, (one(*item) for item in conditions.items()), F.lit(True))


def fields(rows: DataFrame, paths: dict[str, object]) -> DataFrame:
    """One column a dotted path, its default where null."""
    return rows.select(*(F.coalesce(F.col(p), F.lit(default)).alias(p.split(".")[-1]) for p, default in paths.items()))


def result_table(rows: DataFrame, keys: list[str], column: str, values: list, score: str) -> DataFrame:
    """Best score of each key, one column a value; the values are named, so no extra pass finds them."""
    return rows.groupBy(*keys).pivot(column, values).agg(F.max(score))


def result_records(table: DataFrame, keys: list[str], column: str, score: str) -> DataFrame:
    """The reverse: one row for each score above 0."""
    return table.unpivot(keys, [c for c in table.columns if c not in keys], column, score).where(F.col(score) > 0)


def set_field(rows: DataFrame, path: str, value: Column) -> DataFrame:
    """A value at a dotted path, whose outer records are there."""
    first, _, rest = path.partition(".")
    return rows.withColumn(first, F.col(first).withField(rest, value) if rest else value)


def leaves(schema, prefix: str = "") -> list[str]:
    """Dotted paths of all fields that are no records themselves."""
    out: list[str] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, StructType) else [path]
    return out


def has_field(rows: DataFrame, path: str) -> bool:
    return any(p == path or p.startswith(f"{path}.") for p in leaves(rows.schema))


def flattened(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a leaf that is not null, beside the keys: field (its path), value as text."""
    paths = [p for p in leaves(rows.schema) if p not in keys]
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("field"), F.col(p).cast("string").alias("value")) for p in paths)))
    return rows.select(*keys, pairs.alias("_p")).select(*keys, "_p.field", "_p.value").where("value is not null")


def merged(rows: DataFrame, record: str, other: str) -> DataFrame:
    """The fields of two records in the first, the second's where it has a value."""
    mine, theirs = (rows.schema[c].dataType.fieldNames() for c in (record, other))
    both = [F.coalesce(F.col(f"{other}.{n}"), F.col(f"{record}.{n}")).alias(n) if n in theirs else F.col(f"{record}.{n}").alias(n) for n in mine]
    return rows.withColumn(record, F.struct(*both, *(F.col(f"{other}.{n}").alias(n) for n in theirs if n not in mine)))
