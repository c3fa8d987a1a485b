"""Logs and calldata to typed columns."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframes.functions import words as W
from chainframes.plans.specs import ARRAY, Param, column_metadata, key_metadata, key_name, spark_type, tuple_types


def array_of(solidity: str) -> tuple[str, int | None] | None:
    """Element type and fixed length of an array type."""
    m = ARRAY.fullmatch(solidity)
    return (m[1], int(m[2]) if m[2] else None) if m else None


def is_dynamic(solidity: str) -> bool:
    """Whether a value stands behind an offset."""
    if solidity in ("string", "bytes"):
        return True
    if found := array_of(solidity):
        return found[1] is None or is_dynamic(found[0])
    return solidity.startswith("(") and any(map(is_dynamic, tuple_types(solidity)))


def head_words(solidity: str) -> int:
    """Words that a value takes in the head of what holds it."""
    if is_dynamic(solidity):
        return 1
    if found := array_of(solidity):
        return found[1] * head_words(found[0])
    return sum(map(head_words, tuple_types(solidity))) if solidity.startswith("(") else 1


def word_value(solidity: str, word: Column) -> Column:
    """A one-word value as its stored type."""
    if solidity == "address":
        return W.address(word)
    if solidity == "bool":
        return W.boolean(word)
    if m := re.fullmatch(r"(u?)int(\d*)", solidity):
        bits = int(m[2] or 256)
        if bits <= 64:
            return W.int64(word)
        return W.uint_text(word) if m[1] else W.int_text(word)
    if m := re.fullmatch(r"bytes(\d+)", solidity):
        return W.fixed_bytes(word, int(m[1]))
    raise ValueError(f"{solidity} is not a one-word type")


# Values behind offsets are decoded by a program of bindings: the data as bytes, each
# offset, each length and each member are computed once, bound to a lambda variable
# and used from there, so that the expression is as long as the type and not
# exponential in its depth.  Places are byte numbers, so that reading a word does not
# depend on how far into the data it stands.  A value behind an offset is a struct
# (ok, v); v is null where it does not lie in the data.  Values without an offset
# inside are read as they stand: the head that holds them is checked as a whole.

BYTES = W.WORD // 2


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _int(place: Column) -> Column:
    """A place or length as an int; hostile ones beyond any data stay beyond it."""
    return F.least(place, F.lit(1 << 30)).cast("int")


def _cut(raw: Column, at: Column, size: Column | int) -> Column:
    return F.substring(raw, _int(at) + 1, F.lit(size) if isinstance(size, int) else _int(size))


def _offset(raw: Column, at: Column) -> Column:
    """The word at byte ``at`` as an offset or length; null beyond 2**32 or the data."""
    low = F.conv(F.hex(_cut(raw, at + 28, 4)), 16, 10).cast("bigint")
    return F.when(_cut(raw, at, 28) == F.lit(bytes(28)), low).otherwise(F.lit(None).cast("bigint"))


def _text(raw: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def _found(ok: Column, value: Column) -> Column:
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("v"))


def _missing(solidity: str) -> Column:
    return F.struct(F.lit(False).alias("ok"), F.lit(None).cast(spark_type(solidity)).alias("v"))


def _members(solidity: str) -> list[tuple[str, int]]:
    """Types of a tuple's members and the words before each of their heads."""
    out, at = [], 0
    for member in tuple_types(solidity):
        out.append((member, at))
        at += head_words(member)
    return out


#: Fixed arrays of more elements are written as a loop.
UNROLLED = 16


#: Reads hex digits of a value: its number of the word, bytes before, bytes.
Part = Callable[[Column | int, int, int], Column]


def read_word(solidity: str, part: Part, at: Column | int) -> Column:
    """A one-word value, of which only the bytes that count are read."""
    if solidity == "address":
        return F.concat(F.lit("0x"), F.lower(part(at, 12, 20)))
    if solidity == "bool":
        return F.right(part(at, 31, 1), F.lit(1)) == "1"
    if (m := re.fullmatch(r"u?int(\d*)", solidity)) and int(m[1] or 256) <= 64:
        return F.conv(part(at, 24, 8), 16, -10).cast("bigint")
    return word_value(solidity, F.lower(part(at, 0, BYTES)))


def static_value(solidity: str, part: Part, at: Column | int) -> Column:
    """A value without offsets inside, from its ``at``-th word on."""
    if found := array_of(solidity):
        element, n = found
        step = head_words(element)
        if n > UNROLLED:
            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: static_value(element, part, F.lit(at) + i * step if isinstance(at, int) else at + i * step))
        return F.array(*[static_value(element, part, at + i * step) for i in range(n)]).cast(spark_type(solidity))
    if solidity.startswith("("):
        return F.struct(*[static_value(t, part, at + d).alias(f"f{i}") for i, (t, d) in enumerate(_members(solidity))])
    return read_word(solidity, part, at)


def _read_static(solidity: str, raw: Column, at: Column) -> Column:
    return static_value(solidity, lambda n, skip, size: F.hex(_cut(raw, at + (n * BYTES + skip), size)), 0)


def _hex_part(data: Column) -> Part:
    return lambda n, skip, size: F.substring(data, n * W.WORD + (1 + 2 * skip) if isinstance(n, Column) else F.lit(n * W.WORD + 1 + 2 * skip), F.lit(2 * size))


def dynamic_value(solidity: str, raw: Column, block: Column, head: Column) -> Column:
    """``(ok, v)`` of the value at the offset that stands ``head`` bytes into
    ``block`` and is counted from there."""
    inside = lambda at: F.coalesce(at <= F.length(raw), F.lit(False))
    return bind(block + _offset(raw, block + head), lambda at: F.when(inside(at), value_at(solidity, raw, at)).otherwise(_missing(solidity)))


def _tuple_at(solidity: str, raw: Column, at: Column) -> Column:
    members = _members(solidity)
    heads = at + sum(map(head_words, tuple_types(solidity))) * BYTES <= F.length(raw)
    behind = {i: dynamic_value(t, raw, at, F.lit(d * BYTES)) for i, (t, d) in enumerate(members) if is_dynamic(t)}

    def joined(s: Column) -> Column:
        ok = functools.reduce(lambda a, i: a & s[f"m{i}"]["ok"], behind, heads)
        return _found(ok, F.struct(*[(s[f"m{i}"]["v"] if i in behind else _read_static(t, raw, at + d * BYTES)).alias(f"f{i}") for i, (t, d) in enumerate(members)]))

    return bind(F.struct(*[v.alias(f"m{i}") for i, v in behind.items()]), joined)


def _bytes_each(solidity: str) -> int:
    """Bytes per unit of the length that stands before a value; 0 if none does."""
    if solidity in ("string", "bytes"):
        return 1
    found = array_of(solidity)
    return head_words(found[0]) * BYTES if found and found[1] is None else 0


def _array_at(solidity: str, raw: Column, at: Column) -> Column:
    element, n = array_of(solidity)
    step, end = head_words(element) * BYTES, F.length(raw)
    empty = F.array().cast(T.ArrayType(spark_type(element)))

    def inside(count: Column, block: Column) -> Column:
        heads = (block + count * step <= end) if step else (count == 0)
        indexes = F.sequence(F.lit(0), count.cast("int") - 1)
        if not is_dynamic(element):
            items = _found(F.lit(True), F.transform(indexes, lambda i: _read_static(element, raw, block + i * step)))
            return F.when(heads & (count > 0), items).otherwise(_found(heads, empty))
        if each := _bytes_each(element):
            # many offsets may point at one long value: together the values must not be longer than the data
            sizes = F.transform(indexes, lambda i: _offset(raw, block + _offset(raw, block + i * step)))
            small = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, size: total + F.coalesce(size, end) * each) <= end
            heads = heads & F.when(heads & (count > 0), small).otherwise(F.lit(True))
        items = bind(
            F.transform(indexes, lambda i: dynamic_value(element, raw, block, (i * step).cast("bigint"))),
            lambda all_: _found(F.forall(all_, lambda x: x["ok"]), F.transform(all_, lambda x: x["v"])),
        )
        return bind(heads, lambda ok: F.when(ok & (count > 0), items).otherwise(_found(ok, empty)))

    if n is not None:
        return inside(F.lit(n).cast("bigint"), at)
    return bind(_offset(raw, at), lambda count: F.when(count.isNull(), _missing(solidity)).otherwise(inside(count, at + BYTES)))


def value_at(solidity: str, raw: Column, at: Column) -> Column:
    """``(ok, v)`` of the value encoded at byte ``at`` (a bound place)."""
    if solidity in ("string", "bytes"):

        def cut(size: Column) -> Column:
            value = _cut(raw, at + BYTES, size)
            return _found(F.coalesce(at + BYTES + size <= F.length(raw), F.lit(False)), _text(value) if solidity == "string" else value)

        return bind(_offset(raw, at), cut)
    if array_of(solidity):
        return _array_at(solidity, raw, at)
    if solidity.startswith("("):
        return _tuple_at(solidity, raw, at)
    return _found(at + BYTES <= F.length(raw), _read_static(solidity, raw, at))


def program(params: Sequence[tuple[str, int]], data: Column) -> Column:
    """A struct ``p0, p1, ..`` of ``(ok, v)`` of values behind offsets, given as
    their type and the words before their heads; the data become bytes once."""
    return bind(
        F.unhex(data), lambda raw: F.struct(*[dynamic_value(t, raw, F.lit(0).cast("bigint"), F.lit(head * BYTES)).alias(f"p{i}") for i, (t, head) in enumerate(params)])
    )


def _body(params: Sequence[Param]) -> list[tuple[Param, int]]:
    """Parameters in the data and the words before each of their heads."""
    out, at = [], 0
    for p in params:
        if not p.indexed:
            out.append((p, at))
            at += head_words(p.type)
    return out


def _plain(p: Param) -> bool:
    """Whether a parameter needs no program: no offset, or one text behind one."""
    return p.indexed or p.type in ("string", "bytes") or not is_dynamic(p.type)


def _hex_word(data: Column, at: Column) -> Column:
    return F.substring(data, _int(at) + 1, F.lit(W.WORD))


def _text_place(data: Column, head: int) -> Column:
    """Hex digits before the text whose offset stands at a head."""
    return W.offset_of(W.word_at(data, head)) * 2


def _plain_ok(params: Sequence[Param], data: Column) -> Column:
    """Whether topics are present, the head is complete and single texts lie
    inside the data."""
    body, end = _body(params), F.length(data)
    ok = F.lit(True)
    for i in range(sum(p.indexed for p in params)):
        ok = ok & F.col(f"topic{i + 1}").isNotNull()
    digits = sum(head_words(p.type) for p, _ in body) * W.WORD
    ok = ok & F.coalesce(end >= digits, F.lit(not body))
    for p, head in body:
        if _plain(p) and is_dynamic(p.type):
            at = _text_place(data, head)
            ok = ok & F.coalesce((at + W.WORD <= end) & (at + W.WORD + W.offset_of(_hex_word(data, at)) * 2 <= end), F.lit(False))
    return ok


def _programs(params: Sequence[Param]) -> list[tuple[Param, int]]:
    return [(p, head) for p, head in _body(params) if not _plain(p)]


def decode_ok(params: Sequence[Param], data: Column) -> Column:
    """Whether a row can be decoded: as ``_plain_ok``, and all that programs
    follow lies inside the data."""
    ok, behind = _plain_ok(params, data), _programs(params)
    if not behind:
        return ok
    done = program([(p.type, head) for p, head in behind], data)
    return ok & F.coalesce(bind(done, lambda s: functools.reduce(lambda a, i: a & s[f"p{i}"]["ok"], range(len(behind)), F.lit(True))), F.lit(False))


def _plain_value(p: Param, data: Column, head: int, topic: int) -> Column:
    if p.hashed:
        return F.unhex(F.col(f"topic{topic}"))
    if p.indexed:
        return read_word(p.type, _hex_part(F.col(f"topic{topic}")), 0)
    if p.type in ("string", "bytes"):
        at = _text_place(data, head)
        raw = F.unhex(F.substring(data, _int(at) + 1 + W.WORD, _int(W.offset_of(_hex_word(data, at)) * 2)))
        return _text(raw) if p.type == "string" else raw
    return static_value(p.type, _hex_part(data), head)


def _described(params: Sequence[Param], names: dict[str, str] | None) -> list[tuple[Param, str, int, int]]:
    """Each parameter with its column, its head and its topic."""
    out, topic = [], 1
    heads = {id(p): head for p, head in _body(params)}
    for p in params:
        out.append((p, (names or {}).get(p.name, p.out), heads.get(id(p), 0), topic))
        topic += p.indexed
    return out


def _keyed(p: Param) -> bool:
    return bool(column_metadata(p.type)) and not p.hashed


def _plain_columns(p: Param, name: str, data: Column, head: int, topic: int, keys: bool, ok: Column | None = None) -> list[Column]:
    """A plain parameter's column (null unless ``ok``), and its key where it has one."""
    guard = (lambda c: F.when(ok, c)) if ok is not None else lambda c: c
    value = guard(_plain_value(p, data, head, topic))
    if not _keyed(p):
        return [value.alias(name)]
    out = [value.alias(name, metadata=column_metadata(p.type))]
    if keys:
        word = F.col(f"topic{topic}") if p.indexed else W.word_at(data, head)
        out.append(guard(W.number_key(word, p.type.startswith("int"))).alias(key_name(name), metadata=key_metadata(name, p.type)))
    return out


def param_columns(params: Sequence[Param], data: Column, names: dict[str, str] | None = None, keys: bool = False) -> list[Column]:
    """One column per parameter in order, of rows that can be decoded.  An indexed
    value of more than one word is known by its hash only and comes as the 32
    bytes of its topic.  Numbers beyond 64 bits are decimal text, marked as
    numbers for filters and order; with ``keys`` each has its sortable key behind
    it."""
    out = []
    for p, name, head, topic in _described(params, names):
        if _plain(p):
            out += _plain_columns(p, name, data, head, topic, keys)
        else:
            out.append(program([(p.type, head)], data)["p0"]["v"].alias(name))
    return out


def with_decoded(rows: DataFrame, params: Sequence[Param], data: Column, keep: Sequence[str], names: dict[str, str] | None = None, keys: bool = False) -> DataFrame:
    """``keep``, ``decoded`` (whether the row can be decoded) and the parameters,
    null where it cannot.  A program runs once, in a generator, so that the value
    and the test of it share it."""
    described, behind = _described(params, names), _programs(params)
    ok = _plain_ok(params, data)
    if not behind:
        columns = [c for p, name, head, topic in described for c in _plain_columns(p, name, data, head, topic, keys, F.col("decoded"))]
        return rows.withColumn("decoded", ok).select(*keep, "decoded", *columns)
    inputs = [f"topic{i + 1}" for i in range(sum(p.indexed for p in params))]
    made = program([(p.type, head) for p, head in behind], data)
    staged = rows.select(*dict.fromkeys([*keep, *inputs]), data.alias("__data"), ok.alias("decoded"), F.inline(F.array(made)))
    order: list[Column] = []
    decoded = F.col("decoded")
    for p, name, head, topic in described:
        if _plain(p):
            order += _plain_columns(p, name, F.col("__data"), head, topic, keys, F.col("decoded"))
        else:
            found = F.col(f"p{[q for q, _ in behind].index(p)}")
            decoded = decoded & F.coalesce(found["ok"], F.lit(False))
            order.append(found["v"].alias(name))
    return staged.select(*keep, decoded.alias("decoded"), *order)


def decode_events(logs: DataFrame, params: Sequence[Param], keep: Sequence[str] = (), keys: bool = False) -> DataFrame:
    """Decodable logs as ``keep`` columns and one column per parameter."""
    return _decoded_only(logs, params, F.col("data"), keep, keys)


def _decoded_only(rows: DataFrame, params: Sequence[Param], data: Column, keep: Sequence[str], keys: bool) -> DataFrame:
    if all(map(_plain, params)):  # tests of words reach the scan
        return rows.where(decode_ok(params, data)).select(*keep, *param_columns(params, data, None, keys))
    return with_decoded(rows, params, data, keep, None, keys).where("decoded").drop("decoded")


def calldata_body() -> Column:
    return F.substring(F.col("input"), 9, 1 << 30)


def plain_params(params: Sequence[Param]) -> tuple[Param, ...]:
    """Parameters of calldata: none is indexed."""
    return tuple(Param(p.name, p.type, False, p.column) for p in params)


def decode_calls(txs: DataFrame, params: Sequence[Param], keep: Sequence[str] = (), keys: bool = False) -> DataFrame:
    """Calldata behind the 4-byte selector, decoded like a log's body."""
    return _decoded_only(txs, plain_params(params), calldata_body(), keep, keys)


def decode_failures(rows: DataFrame, params: Sequence[Param], by: Sequence[str], data: Column | None = None) -> DataFrame:
    """How many rows per entry cannot be decoded, and how many can."""
    found = with_decoded(rows, params, data if data is not None else F.col("data"), by)
    return found.groupBy(*by).agg(F.count_if(~F.col("decoded")).alias("failed"), F.count_if("decoded").alias("decoded"))
