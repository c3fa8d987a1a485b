"""Filter, sort and page one table.

``query_table`` takes a nested dictionary of conditions, as an API would receive
it, and builds one Column; Catalyst does the rest.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Context, Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframes.functions.words import decimal_key, hex_text, key_bytes

DEFAULT_FIRST, MAX_FIRST = 100, 1000
#: Suffixes, longest first (fixed values); no suffix is ``eq``.
SUFFIXES = ("starts_with", "contains", "not_in", "gte", "lte", "in", "ne", "gt", "lt")
_EXACT = Context(prec=200)
_EVERY = {"eq", "ne", "in", "not_in"}
_TEXT = _EVERY | {"contains", "starts_with"}
_NUMBER = _EVERY | {"gt", "gte", "lt", "lte"}


class QueryError(ValueError):
    """A query that the table cannot answer."""


def is_numeric_text(field: T.StructField) -> bool:
    """Whether a text column is marked to hold exact whole numbers (256-bit values
    are stored as decimal text)."""
    return isinstance(field.dataType, T.StringType) and bool((field.metadata or {}).get("numeric"))


def mark_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Marks text columns of exact decimal numbers, so that they are compared,
    sorted and paged as numbers."""
    return df.withColumns({c: F.col(c).alias(c, metadata={"numeric": True}) for c in columns})


def is_key(field: T.StructField) -> bool:
    """Whether a column is the sortable key of a number beside it."""
    return "key_of" in (field.metadata or {})


def key_column(column: str, schema: T.StructType) -> str | None:
    """The key column of a column of numbers, where the table has one."""
    return next((f.name for f in schema if (f.metadata or {}).get("key_of") == column), None)


def operators_of(field: T.StructField) -> set[str]:
    """Which operators a column takes."""
    kind = field.dataType
    if isinstance(kind, T.NumericType) or is_numeric_text(field):
        return _NUMBER
    return _TEXT if isinstance(kind, T.StringType) else _EVERY


def split_key(key: str, columns: Sequence[str]) -> tuple[str, str]:
    """``value_gte`` -> (``value``, ``gte``).  The longest suffix whose base is a
    column comes first, then a full column name."""
    for suffix in SUFFIXES:
        base = key.removesuffix(f"_{suffix}")
        if base != key and base in columns:
            return base, suffix
    if key in columns:
        return key, "eq"
    raise QueryError(f"no column for filter {key!r}")


def number(value: Any) -> Decimal:
    """A filter value as an exact number; truth values are none."""
    try:
        found = Decimal(repr(value) if isinstance(value, float) else str(value).strip()) if not isinstance(value, bool) else None
    except InvalidOperation:
        found = None
    if found is None or not found.is_finite():
        raise QueryError(f"{value!r} is not a number")
    return found


def _units(value: Any, scale: int = 0) -> tuple[int, bool]:
    """A number in units of ``10 ** -scale``, rounded down, and whether it is
    exactly that.  Numbers far beyond any column are cut to 10 ** 100."""
    found = number(value)
    if found and found.adjusted() > 100:
        return (-1 if found < 0 else 1) * 10**100, True
    if found and found.adjusted() < -100:
        return (-1 if found < 0 else 0), False
    sign, digits, exponent = found.as_tuple()
    whole = int("".join(map(str, digits))) * (-1 if sign else 1)
    shift = exponent + scale
    if shift >= 0:
        return whole * 10**shift, True
    down, rest = divmod(whole, 10**-shift)
    return down, not rest


@dataclass(frozen=True)
class _Numbers:
    """How a column of numbers of one scale is compared: its least and greatest
    value in units, the column that is compared and how a value is written there."""

    column: Column
    write: Callable[[int], Column]
    least: int
    most: int
    scale: int = 0


def numbers_of(column: str, schema: T.StructType) -> _Numbers | None:
    """None for columns that hold no exact numbers."""
    field, c = schema[column], F.col(column)
    kind = field.dataType
    if is_numeric_text(field):
        key = key_column(column, schema)
        if key is None:
            return _Numbers(decimal_key(c), lambda n: decimal_key(F.lit(str(n))), 1 - 10**78, 10**78 - 1)
        signed = bool(schema[key].metadata.get("signed"))
        least = -(1 << 255) if signed else 0
        return _Numbers(F.col(key), lambda n: F.lit(key_bytes(n, signed)), least, least + (1 << 256) - 1)
    if isinstance(kind, T.DecimalType):
        most = 10**kind.precision - 1
        return _Numbers(c, lambda n: F.lit(Decimal(n).scaleb(-kind.scale, _EXACT)).cast(kind), -most, most, kind.scale)
    if isinstance(kind, T.IntegralType):
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind), 64)
        return _Numbers(c, lambda n: F.lit(n).cast(kind), -(1 << bits - 1), (1 << bits - 1) - 1)
    return None


def _compare(n: _Numbers, operator: str, value: Any) -> Column:
    """As for real numbers: fractions and values that the column cannot hold
    compare as what they are.  Nulls never match."""
    units, exact = _units(value, n.scale)
    if operator in ("eq", "ne") and (not exact or not n.least <= units <= n.most):
        return F.lit(False) if operator == "eq" else n.column.isNotNull()
    if not exact:  # x > 5.5 and x >= 5.5 are x > 5; x < 5.5 and x <= 5.5 are x <= 5
        operator = "gt" if operator in ("gt", "gte") else "lte"
    if units < n.least or units > n.most:
        return n.column.isNotNull() if (units < n.least) == (operator in ("gt", "gte")) else F.lit(False)
    c, v = n.column, n.write(units)
    return {"eq": c == v, "ne": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[operator]


def literal(value: Any, field: T.StructField) -> Column:
    """A filter value as the type of a column that holds no exact numbers."""
    kind = field.dataType
    if isinstance(kind, T.BinaryType):
        digits = str(value).lower().removeprefix("0x")
        try:
            return F.lit(bytes.fromhex(digits))
        except ValueError:
            raise QueryError(f"{value!r} is not hex") from None
    if isinstance(kind, T.BooleanType):
        if isinstance(value, bool) or str(value).lower() in ("true", "false"):
            return F.lit(value is True or str(value).lower() == "true")
        raise QueryError(f"{value!r} is not a bool")
    if isinstance(kind, T.FractionalType):
        return F.lit(float(number(value))).cast(kind)
    return F.lit(value).cast(kind)


def condition(column: str, operator: str, value: Any, schema: T.StructType) -> Column:
    c, numbers = F.col(column), numbers_of(column, schema)
    if operator in ("in", "not_in"):
        if numbers:
            found = [_units(v, numbers.scale) for v in value]
            items = [numbers.write(n) for n in sorted({n for n, exact in found if exact and numbers.least <= n <= numbers.most})]
            c = numbers.column
        else:
            items = [literal(v, schema[column]) for v in value]
        if not items:  # an empty list of the caller's filters all or nothing, values that cannot be there no null
            return F.lit(False) if operator == "in" else c.isNotNull() if value else F.lit(True)
        return c.isin(items) if operator == "in" else ~c.isin(items)
    if operator == "contains":
        return c.like(f"%{value}%")
    if operator == "starts_with":
        return c.like(f"{value}%")
    if numbers:
        return _compare(numbers, operator, value)
    v = literal(value, schema[column])
    return {"eq": c == v, "ne": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[operator]


def where_clause(where: Mapping[str, Any], schema: T.StructType) -> Column:
    """All keys must hold; ``AND`` and ``OR`` take lists of further groups.  Null
    values and empty groups filter nothing."""
    columns = [f.name for f in schema if not is_key(f)]
    parts: list[Column] = []
    for key, value in where.items():
        if value is None:
            continue
        if key in ("AND", "OR"):
            groups = [where_clause(g, schema) for g in value if g]
            if groups:
                parts.append(functools.reduce((lambda a, b: a & b) if key == "AND" else (lambda a, b: a | b), groups))
            continue
        column, operator = split_key(key, columns)
        field = schema[column]
        if column == "id" or operator not in operators_of(field):
            raise QueryError(f"{column!r} takes no {operator!r}")
        parts.append(condition(column, operator, value, schema))
    return functools.reduce(lambda a, b: a & b, parts, F.lit(True))


# -- order and pages -----------------------------------------------------------


def page_size(first: int | None) -> int:
    return max(1, min(DEFAULT_FIRST if first is None else first, MAX_FIRST))


def sort_column(column: str, schema: T.StructType) -> Column:
    """What rows are sorted by: numbers kept as text by their key."""
    numbers = numbers_of(column, schema) if is_numeric_text(schema[column]) else None
    return numbers.column if numbers else F.col(column)


def ordering(column: str, direction: str, schema: T.StructType | None = None) -> list[Column]:
    """Column, then id, in one direction; nulls are the largest values."""
    c = sort_column(column, schema) if schema is not None else F.col(column)
    down = direction.upper() == "DESC"
    if direction.upper() not in ("ASC", "DESC"):
        raise QueryError(f"no direction {direction!r}")
    order = [c.desc_nulls_first() if down else c.asc_nulls_last()]
    if column != "id":
        order.append(F.col("id").desc() if down else F.col("id").asc())
    return order


# A cursor is base64 of {"v": <sort value as text, or null>, "id": <id>}; bytes are
# written as 0x and hex.  One row's cursor is the same from either function.


def encode_cursor(value: Any, row_id: int) -> str:
    if isinstance(value, (bytes, bytearray)):
        value = "0x" + bytes(value).hex()
    elif isinstance(value, bool):
        value = "true" if value else "false"
    elif value is not None:
        value = format(value, "f") if isinstance(value, Decimal) else str(value)
    return base64.b64encode(json.dumps({"v": value, "id": row_id}, separators=(",", ":"), ensure_ascii=False).encode()).decode()


def decode_cursor(cursor: str) -> tuple[Any, int]:
    try:
        found = json.loads(base64.b64decode(cursor, validate=True))
        return found["v"], int(found["id"])
    except (binascii.Error, ValueError, KeyError, TypeError):
        raise QueryError("not a cursor") from None


def cursor_column(df: DataFrame, column: str) -> Column:
    """The cursor of every row, as a column."""
    c = F.col(column)
    value = hex_text(c) if isinstance(df.schema[column].dataType, T.BinaryType) else c.cast("string")
    body = F.to_json(F.struct(value.alias("v"), F.col("id")), {"ignoreNullFields": "false"})
    return F.translate(F.base64(body.cast("binary")), "\r\n", "")


def after_cursor(cursor: str, column: str, direction: str, schema: T.StructType) -> Column:
    """Rows behind the cursor in the given order; null sort values included."""
    value, row_id = decode_cursor(cursor)
    down = direction.upper() == "DESC"
    i = F.col("id") < row_id if down else F.col("id") > row_id
    if column == "id":
        return i
    c = F.col(column)
    if value is None:  # nulls first when descending, last when ascending
        return (c.isNull() & i) | (c.isNotNull() if down else F.lit(False))
    numbers = numbers_of(column, schema)
    if numbers:
        past, same = _compare(numbers, "lt" if down else "gt", value), _compare(numbers, "eq", value)
    else:
        v = literal(value, schema[column])
        past, same = (c < v if down else c > v), c == v
    return past | (same & i) if down else past | (same & i) | c.isNull()


def api_projection(df: DataFrame) -> DataFrame:
    """Rows as an API shows them: bytes as hex text, whole numbers beyond 32 bits
    and decimals as text; keys of numbers are not shown."""
    out = []
    for f in df.schema:
        if is_key(f):
            continue
        if isinstance(f.dataType, T.BinaryType):
            out.append(hex_text(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, (T.LongType, T.DecimalType)):
            out.append(F.col(f.name).cast("string").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def select_page(
    df: DataFrame,
    where: Mapping[str, Any] | None = None,
    order_by: str = "id",
    direction: str = "DESC",
    first: int | None = None,
    skip: int = 0,
    after: str | None = None,
    extra: int = 0,
) -> DataFrame:
    """The rows of one page.  With a cursor, ``skip`` is ignored.  Ends in one
    top-k, so no full sort takes place."""
    if order_by not in df.columns or is_key(df.schema[order_by]):
        raise QueryError(f"no column {order_by!r}")
    rows = df.where(where_clause(where or {}, df.schema))
    if after is not None:
        rows = rows.where(after_cursor(after, order_by, direction, df.schema))
    rows = rows.orderBy(*ordering(order_by, direction, df.schema))
    if after is None and skip > 0:
        rows = rows.offset(skip)
    return rows.limit(page_size(first) + extra)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    has_next: bool
    end_cursor: str | None


def query_table(df: DataFrame, where: Mapping[str, Any] | None = None, order_by: str = "id", direction: str = "DESC", first: int | None = None, skip: int = 0, after: str | None = None) -> Page:
    """One page with its page info.  One row more than asked for tells whether
    there is a next page; a page (at most 1001 rows) is all that is collected."""
    n = page_size(first)
    found = select_page(df, where, order_by, direction, first, skip, after, extra=1).collect()
    shown = found[:n]
    rows = df.sparkSession.createDataFrame(shown, df.schema) if shown else df.limit(0)
    end = encode_cursor(shown[-1][order_by], shown[-1]["id"]) if shown else None
    return Page(rows, len(found) > n, end)
