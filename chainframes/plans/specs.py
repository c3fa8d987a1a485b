"""What to index: contracts, events, calls, transfers, factories.

Plain dataclasses on the driver.  Each entry resolves to fixed column names and
types; nothing is inferred from data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframes.functions import words as W
from chainframes.functions.keccak import bloom_positions

#: Columns of the output tables that a parameter may not be called (fixed values).
RESERVED_COLUMNS = (
    "id", "block_number", "tx_hash", "tx_index", "log_index", "contract_address", "block_timestamp", "block_hash",
    "tx_from", "tx_to", "tx_value", "tx_gas_price", "tx_gas_used", "tx_nonce", "cumulative_gas_used", "tx_status",
)
#: Context fields in output order and their Spark types (fixed values).
CONTEXT_FIELDS = {
    "block_timestamp": "bigint", "block_hash": "string", "tx_from": "string", "tx_to": "string", "tx_value": "string",
    "tx_gas_price": "bigint", "tx_gas_used": "bigint", "tx_nonce": "bigint", "cumulative_gas_used": "bigint", "tx_status": "boolean",
}
RECEIPT_FIELDS = ("tx_gas_used", "tx_nonce", "cumulative_gas_used", "tx_status")


class SpecError(ValueError):
    """A description that cannot be indexed."""


# -- names -------------------------------------------------------------------


def column_name(raw: str) -> str:
    """camelCase to snake_case, acronyms kept together, leading underscores gone;
    a clash with a reserved column gets the prefix ``param_``."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", raw)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"_+", "_", name).lstrip("_").lower()
    return f"param_{name}" if name in RESERVED_COLUMNS else name


def column_names(raw: list[str]) -> list[str]:
    names = [column_name(r) for r in raw]
    for name, original in zip(names, raw, strict=True):
        if names.count(name) > 1:
            raise SpecError(f"parameter {original!r} and another one both become column {name!r}")
    return names


def normalised(df: DataFrame) -> DataFrame:
    """Any table with its columns renamed by ``column_name``."""
    return df.toDF(*column_names(df.columns))


def identifier(name: str) -> str:
    if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
        raise SpecError(f"{name!r} is not an identifier")
    return name


# -- types -------------------------------------------------------------------


def sql_kind(solidity: str) -> str:
    """boolean, text, bigint, numeric or bytea: how a type is stored."""
    if solidity == "bool":
        return "boolean"
    if solidity in ("address", "string"):
        return "text"
    if m := re.fullmatch(r"u?int(\d*)", solidity):
        return "bigint" if int(m[1] or 256) <= 64 else "numeric"
    if solidity.startswith("bytes"):
        return "bytea"
    return "text"


_DDL = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}
SPARK_KINDS = {
    "boolean": T.BooleanType(), "text": T.StringType(), "bigint": T.LongType(),
    "numeric": T.StringType(), "bytea": T.BinaryType(),
}


def spark_type(solidity: str) -> T.DataType:
    """As ``sql_kind``, but arrays and tuples keep their structure (a tuple's
    fields are ``f0``, ``f1``, ..); numbers beyond 64 bits are exact decimal text."""
    if m := ARRAY.fullmatch(solidity):
        return T.ArrayType(spark_type(m[1]))
    if solidity.startswith("("):
        return T.StructType([T.StructField(f"f{i}", spark_type(t)) for i, t in enumerate(tuple_types(solidity))])
    return SPARK_KINDS[sql_kind(solidity)]


#: ``T[]`` and ``T[n]``: element type and length.
ARRAY = re.compile(r"(.+)\[(\d*)\]")


def tuple_types(solidity: str) -> list[str]:
    """The member types of ``(a,b,..)``, split at the outermost commas."""
    if not solidity.endswith(")"):
        raise SpecError(f"{solidity!r} is not a tuple")
    parts, depth = [""], 0
    for c in solidity[1:-1]:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p for p in parts if p]


#: Marks text columns that hold exact whole numbers.
NUMERIC = {"numeric": True}


def column_metadata(solidity: str) -> dict:
    return NUMERIC if sql_kind(solidity) == "numeric" else {}


def key_name(column: str) -> str:
    """The sortable key that stands beside a column of numbers beyond 64 bits."""
    return f"{column}_w"


def key_metadata(column: str, solidity: str = "uint256") -> dict:
    return {"key_of": column, "signed": solidity.startswith("int")}


# -- entries -----------------------------------------------------------------


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    indexed: bool = False
    column: str | None = None

    @property
    def out(self) -> str:
        return self.column or column_name(self.name)

    @property
    def hashed(self) -> bool:
        """An indexed value of more than one word is known by its hash only."""
        return self.indexed and (self.type in ("string", "bytes") or self.type.endswith("]") or self.type.startswith("("))


@dataclass(frozen=True)
class EventSpec:
    """An event of a contract (or of a factory's children) and its table.

    ``topic_filters`` maps topic positions 1..3 to accepted values: any value
    of one position, and every position given."""

    contract: str
    event: str
    selector: str
    params: tuple[Param, ...]
    table: str
    context: tuple[str, ...] = ()
    include_receipts: bool = False
    topic_filters: tuple[tuple[int, tuple[str, ...]], ...] = ()


@dataclass(frozen=True)
class CallSpec:
    contract: str
    function: str
    selector: str
    params: tuple[Param, ...]
    table: str
    context: tuple[str, ...] = ()
    include_receipts: bool = False


@dataclass(frozen=True)
class TransferSpec:
    """Native transfers; an empty address list accepts every address."""

    table: str
    from_addresses: tuple[str, ...] = ()
    to_addresses: tuple[str, ...] = ()
    context: tuple[str, ...] = ()


@dataclass(frozen=True)
class FactorySpec:
    """A contract whose event announces children of contract ``child``."""

    address: str
    selector: str
    child: str
    params: tuple[Param, ...]
    child_param: str

    def word(self) -> Column:
        """The announced address's word in topics or data."""
        topic, body = 1, 0
        for p in self.params:
            if p.name == self.child_param:
                if p.type != "address":
                    raise SpecError(f"{self.child_param!r} is a {p.type}, not an address")
                return F.col(f"topic{topic}") if p.indexed else W.word_at(F.col("data"), body)
            topic, body = topic + p.indexed, body + (not p.indexed)
        raise SpecError(f"no parameter {self.child_param!r}")

    def place(self) -> tuple[int, int]:
        """The topic that holds the announced address, or 0 and the word in the data."""
        topic, body = 1, 0
        for p in self.params:
            if p.name == self.child_param:
                return (topic, 0) if p.indexed else (0, body)
            topic, body = topic + p.indexed, body + (not p.indexed)
        raise SpecError(f"no parameter {self.child_param!r}")


@dataclass(frozen=True)
class ContractSpec:
    name: str
    address: str | None = None
    start_block: int = 0


@dataclass(frozen=True)
class IndexSpec:
    contracts: tuple[ContractSpec, ...] = ()
    events: tuple[EventSpec, ...] = ()
    calls: tuple[CallSpec, ...] = ()
    transfers: tuple[TransferSpec, ...] = ()
    factories: tuple[FactorySpec, ...] = ()

    def effective_start(self, override: int | None = None) -> int:
        """The lowest start block of all contracts, or the override."""
        return override if override is not None else min((c.start_block for c in self.contracts), default=0)

    def bloom_usable(self) -> bool:
        """Blocks may be skipped by their bloom only if nothing but events of
        contracts with known addresses is wanted."""
        return not (self.transfers or self.calls or self.factories) and bool(self.bloom_bits())

    def bloom_bits(self) -> list[tuple[int, int, int]]:
        """What the configured addresses set in a block's bloom; the zero address
        is no contract."""
        return [bloom_positions(c.address) for c in self.contracts if c.address and set(bare(c.address)) != {"0"}]

    def registry(self, spark: SparkSession) -> DataFrame:
        """address -> contract, of the configured contracts."""
        rows = [(bare(c.address), c.name) for c in self.contracts if c.address and set(bare(c.address)) != {"0"}]
        return spark.createDataFrame(rows, "address string, contract string")

    def routing(self, spark: SparkSession) -> DataFrame:
        """(contract, event) -> output table, one row per table."""
        rows = [(e.contract, e.event, e.selector, e.table) for e in self.events]
        return spark.createDataFrame(rows, "contract string, event string, topic0 string, table string")

    def summary(self, spark: SparkSession) -> DataFrame:
        """Entries per contract, with their columns, for inspection."""
        rows = [(e.contract, "event", e.event, e.table, [p.out for p in e.params], list(context_fields(e))) for e in self.events]
        rows += [(c.contract, "call", c.function, c.table, [p.out for p in c.params], list(context_fields(c))) for c in self.calls]
        rows += [("", "transfer", "transfer", t.table, ["from_address", "to_address", "value"], list(t.context)) for t in self.transfers]
        rows += [("", "factory", f.child, "", [f.child_param], []) for f in self.factories]
        entries = spark.createDataFrame(rows, "contract string, kind string, name string, table string, columns array<string>, context array<string>")
        entry = F.struct("kind", "name", "table", "columns", "context")
        return entries.groupBy("contract").agg(F.count("*").alias("entries"), F.sort_array(F.collect_list(entry)).alias("spec"))


def context_fields(entry: EventSpec | CallSpec | TransferSpec) -> tuple[str, ...]:
    """The chosen context fields, with the receipt fields behind them where they
    are asked for."""
    fields = list(entry.context)
    for name in fields:
        if name not in CONTEXT_FIELDS:
            raise SpecError(f"no context field {name!r}")
        if fields.count(name) > 1:
            raise SpecError(f"context field {name!r} is given twice")
    if getattr(entry, "include_receipts", False):
        fields += [f for f in RECEIPT_FIELDS if f not in fields]
    return tuple(fields)


def table_schema(entry: EventSpec | CallSpec | TransferSpec) -> T.StructType:
    """The columns of an entry's table.  Numbers beyond 64 bits are decimal text
    with a 32-byte key behind it, by which they are filtered and sorted."""
    fields = [("id", "bigint"), ("block_number", "bigint"), ("tx_hash", "string"), ("tx_index", "int")]
    if isinstance(entry, EventSpec):
        fields += [("log_index", "int"), ("contract_address", "string")]
    fields += [(name, CONTEXT_FIELDS[name]) for name in context_fields(entry)]
    if isinstance(entry, TransferSpec):
        fields += [("from_address", "string"), ("to_address", "string"), ("value", "string")]
    schema = T.StructType()

    def add(name: str, kind: T.DataType, solidity: str | None, nullable: bool = False) -> None:
        nonlocal schema
        schema = schema.add(name, kind, nullable, NUMERIC if solidity else None)
        if solidity:
            schema = schema.add(key_name(name), T.BinaryType(), nullable, key_metadata(name, solidity))

    for name, kind in fields:
        add(name, _DDL[kind], "uint256" if name in ("tx_value", "value") else None, name == "tx_to")
    if not isinstance(entry, TransferSpec):
        column_names([p.name for p in entry.params if not p.column])
        for p in entry.params:
            add(p.out, T.BinaryType() if p.hashed else spark_type(p.type), p.type if column_metadata(p.type) and not p.hashed else None)
    if len(set(schema.fieldNames())) < len(schema):
        raise SpecError(f"two columns of {entry.table!r} have one name: {schema.fieldNames()}")
    return schema


def table_key(entry: EventSpec | CallSpec | TransferSpec) -> tuple[str, ...]:
    """What is unique in an entry's table."""
    if isinstance(entry, EventSpec):
        return ("contract_address", "block_number", "tx_index", "log_index")
    return ("block_number", "tx_index")


# -- topic literals ------------------------------------------------------------


def bare(address: str) -> str:
    """Lower-case hex without prefix."""
    return address.lower().removeprefix("0x")


def topic_literal(solidity: str, value: str) -> str:
    """A filter value as the 32-byte word it has in a topic."""
    if solidity == "address":
        digits = bare(value)
        if not re.fullmatch(r"[0-9a-f]{40}", digits):
            raise SpecError(f"{value!r} is not an address")
        return digits.rjust(64, "0")
    if solidity == "bool":
        if value not in ("true", "false"):
            raise SpecError(f"{value!r} is not a bool")
        return ("1" if value == "true" else "0").rjust(64, "0")
    if re.fullmatch(r"u?int\d*", solidity):
        number = int(value, 16) if value.lower().startswith("0x") else int(value)
        if not -(1 << 255) <= number < 1 << 256 or (number < 0 and solidity.startswith("u")):
            raise SpecError(f"{value!r} does not fit {solidity}")
        return f"{number % (1 << 256):064x}"
    digits = bare(value)
    if not re.fullmatch(r"[0-9a-f]{64}", digits):
        raise SpecError(f"{value!r} is not a 32-byte word")
    return digits


def encode_topic(solidity: str, value: Column) -> Column:
    """The column form of ``topic_literal`` for addresses, bools and numbers of
    up to 64 bits."""
    if solidity == "address":
        return F.lpad(F.regexp_replace(F.lower(value), "^0x", ""), 64, "0")
    if solidity == "bool":
        return F.lpad(F.when(value, "1").otherwise("0"), 64, "0")
    fill = F.when(value < 0, F.lit("f")).otherwise(F.lit("0")) if solidity.startswith("int") else F.lit("0")
    return F.concat(F.repeat(fill, F.lit(48)), F.lpad(F.lower(F.hex(value)), 16, "0"))
