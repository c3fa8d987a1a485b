"""Following the chain head: batches of blocks into tables.

One micro-batch is one epoch and adds one unit to each table it has rows for.  The
unit's files are written first and its manifest last, so that a batch is seen whole
or not at all; a batch that is done is not written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from chainframes.functions import words as W
from chainframes.operators import match, messages, reorg
from chainframes.operators.context import context, with_context
from chainframes.operators.decode import calldata_body, plain_params, with_decoded
from chainframes.operators.flatten import drop_mismatched, first_per_key, with_gas_used, with_row_id
from chainframes.plans.specs import CallSpec, EventSpec, IndexSpec, TransferSpec, context_fields, key_name, table_key, table_schema
from chainframes.sources.scan import read_range
from chainframes.streaming import ranges
from chainframes.streaming.store import Manifest, Store, Unit

Rows = Callable[[DataFrame, int], None]
Entry = EventSpec | TransferSpec | CallSpec
Batch = tuple[DataFrame, DataFrame, DataFrame | None]

HASHES = T.StructType().add("block_number", T.LongType()).add("block_hash", T.StringType())
CHILDREN = T.StructType().add("contract", T.StringType()).add("address", T.StringType()).add("created_block", T.LongType())
#: Writes of one batch that run at a time.
WRITERS = 4
#: State tables and the column that holds their block.
STATE = {"_hashes": (HASHES, "block_number"), "_children": (CHILDREN, "created_block")}


@dataclass
class Sink:
    """Where messages go.  ``send`` gets the message rows of a batch, ``notify``
    one row per block with rows (``block_number, body``); one that does not want
    history is left out of backfills.  Failures are kept and never stop the job."""

    name: str
    send: Rows | None = None
    notify: Rows | None = None
    wants_backfill: bool = True
    errors: list[str] = field(default_factory=list)


def partition_sender(deliver: Callable[[Iterator[Row]], None]) -> Rows:
    """A sink that sends from the executors, one connection per partition."""
    return lambda rows, epoch: rows.foreachPartition(deliver)


@dataclass
class Handler:
    """The user's own work on the rows of some entries, before a batch is committed.

    ``matches(contract, event)`` chooses the entries (transfers have the contract
    ``""`` and the event ``transfer``).  ``handle`` gets each chosen entry's rows
    of a batch; ``rollback`` gets the last block that stays whenever a batch
    undoes blocks, before ``handle``.  Both may be called again for a batch that
    was not committed.  ``derive`` makes rows of the user's own table ``name``
    (with a ``block_number``) from an entry's; they are committed, rolled back and
    merged like the index's own."""

    name: str
    matches: Callable[[str, str], bool]
    handle: Rows | None = None
    rollback: Rows | None = None
    derive: Callable[[DataFrame], DataFrame] | None = None
    schema: T.StructType | None = None


@dataclass
class Counters:
    """What an index has done since it was opened, observed while batches ran."""

    blocks: int = 0
    pruned_blocks: int = 0
    events_matched: int = 0
    events_stored: int = 0
    transfers_stored: int = 0
    calls_stored: int = 0
    undecodable: dict[str, int] = field(default_factory=dict)
    stored: dict[str, int] = field(default_factory=dict)
    rollbacks: int = 0
    head: int = 0
    indexed_block: int = 0
    latest_timestamp: int | None = None

    @property
    def ready(self) -> bool:
        """Whether the index is at most two blocks behind the head."""
        return self.indexed_block > 0 and self.head - self.indexed_block <= 2


def _name_of(e: Entry) -> tuple[str, str]:
    if isinstance(e, TransferSpec):
        return "", "transfer"
    return e.contract, e.event if isinstance(e, EventSpec) else e.function


class Index:
    """The tables of an index in a folder that all executors share.

    ``canonical`` gives ``(block_number, block_hash)`` of the chain as it is now;
    it is asked only when a batch contradicts what is stored without reaching down
    to a common block.  ``refill`` gives the blocks, logs and transactions of a
    stretch of blocks; with it, gaps are filled as soon as they are seen."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        spec: IndexSpec,
        sinks: Sequence[Sink] = (),
        handlers: Sequence[Handler] = (),
        canonical: Callable[[], DataFrame] | None = None,
        refill: Callable[[int, int], Batch] | None = None,
    ):
        self.spark, self.spec, self.store = spark, spec, Store(spark, root)
        self.sinks, self.handlers, self.canonical, self.refill = list(sinks), list(handlers), canonical, refill
        self.counters = Counters()
        self._known: dict[str, DataFrame] = {}
        tables = [e.table for e in self.entries()]
        if len(set(tables)) < len(tables):
            raise ValueError(f"two entries write one table: {sorted(tables)}")

    # -- state ---------------------------------------------------------------

    def entries(self) -> list[Entry]:
        return [*self.spec.events, *self.spec.transfers, *self.spec.calls]

    def _schemas(self) -> dict[str, T.StructType]:
        own = {e.table: table_schema(e) for e in self.entries()}
        return own | {h.name: h.schema for h in self.handlers if h.derive} | {t: s for t, (s, _) in STATE.items()}

    def manifest(self) -> Manifest:
        return self.store.manifest()

    def table(self, name: str, low: int | None = None, high: int | None = None) -> DataFrame:
        """The rows of one entry's table, or of a handler's; of blocks ``low`` to
        ``high`` if given."""
        return self.store.read(name, self._schemas()[name], self.manifest(), low=low, high=high)

    def register(self, prefix: str = "") -> list[str]:
        """Makes every table, also one without rows yet, a view for SQL, as of now;
        returns the views' names."""
        names = [e.table for e in self.entries()] + [h.name for h in self.handlers if h.derive]
        for name in names:
            self.table(name).createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{n}" for n in names]

    def hashes(self) -> DataFrame:
        return self.store.read("_hashes", HASHES, self.manifest())

    def children(self) -> DataFrame:
        return self.store.read("_children", CHILDREN, self.manifest(), "created_block")

    def rollbacks(self) -> DataFrame:
        """The last rollbacks: the manifest they came with and the block they left."""
        return self.spark.createDataFrame([*self.manifest().rollbacks], "version bigint, ancestor bigint")

    def checkpoint(self) -> int:
        """Largest block done and not rolled back since; 0 if none."""
        return self.manifest().checkpoint

    def gaps(self) -> DataFrame:
        """Blocks missing below the checkpoint."""
        return reorg.block_gaps(self.hashes())

    def reset(self) -> None:
        """Drops all tables with all state; the next batch starts anew."""
        self._forget(())
        self.store.reset()
        self.counters = Counters()

    def _forget(self, names: Sequence[str]) -> None:
        """Keeps cached children of the named units only."""
        for gone in set(self._known) - set(names):
            self._known.pop(gone).unpersist()

    def _known_children(self, m: Manifest) -> DataFrame:
        """Stored children.  Units do not change, so each is read once and kept;
        a batch reads what was added since the last one."""
        found = self.spark.createDataFrame([], CHILDREN)
        units = self.store.units_of("_children", m)
        for unit, path in units:
            if unit.name not in self._known:
                self._known[unit.name] = self.spark.read.schema(CHILDREN).parquet(path).persist()
            rows = self._known[unit.name]
            found = found.unionByName(rows if unit.limit is None else rows.where(F.col("created_block") <= unit.limit))
        self._forget([u.name for u, _ in units])
        return found

    # -- batches ---------------------------------------------------------------

    def _latest(self, blocks: DataFrame) -> DataFrame:
        """A batch may hold old and new forks: the last arrival of a block counts,
        of those that came together the one of the greatest hash."""
        order = F.struct(*[F.col(c) for c in ("arrival", "block_hash") if c in blocks.columns])
        return blocks.groupBy("block_number").agg(F.max_by(F.struct(*blocks.columns), order).alias("b")).select("b.*")

    def prune(self, blocks: DataFrame) -> DataFrame:
        """Blocks that may hold a wanted log, by their bloom; all of them if the
        spec wants more than logs of known addresses, or blocks have no bloom."""
        if not self.spec.bloom_usable() or "logs_bloom" not in blocks.columns:
            return blocks
        return match.bloom_blocks(blocks, self.spec.bloom_bits())

    def process(self, blocks: DataFrame, logs: DataFrame, epoch: int | str, is_backfill: bool = False, txs: DataFrame | None = None) -> None:
        """One batch: reorganisation, children, rows, hashes, commit, messages.

        ``txs`` (``block_number, tx_index, tx_hash, tx_from, tx_to, value,
        success, input, cumulative_gas_used, nonce, tx_type, max_fee, tip``, and
        ``block_hash`` where forks can meet in a batch) is needed for transfers,
        calls and context fields; ``blocks`` then has ``block_timestamp`` and
        ``base_fee``.  A ``receipts`` column of ``blocks`` is their number of
        receipts: logs of blocks with another number of transactions are left out.
        With a ``logs_bloom`` column, logs are read of blocks only that may hold a
        wanted one.  A batch that is committed already only sends its messages
        again."""
        if txs is None and (self.spec.transfers or self.spec.calls or any(context_fields(e) for e in self.entries())):
            raise ValueError("transfers, calls and context fields need the batch's transactions")
        blocks = self._latest(blocks).persist()
        kept: list[DataFrame] = [blocks]
        try:
            stamp = F.max("block_timestamp") if "block_timestamp" in blocks.columns else F.lit(None)
            span = blocks.agg(F.min("block_number").alias("low"), F.max("block_number").alias("high"), F.count("*").alias("n"), stamp.alias("stamp")).first()
            if not span["n"]:
                return
            if txs is not None:
                own = ["block_number", "block_hash"]
                txs = (txs.join(blocks.select(*own), own, "left_semi").drop("block_hash") if "block_hash" in txs.columns else txs).persist()
                kept.append(txs)
            label, before = str(epoch), self.manifest()
            name = f"epoch-{label}"
            if not before.done(label):
                unit = self._unit(name, blocks, logs, txs, before, span, epoch, kept)
            else:
                unit = next((u for u in before.units if u.name == name), None)
            if unit is not None:
                self._notify(unit, blocks, txs, epoch, is_backfill)
        finally:
            for df in kept:
                df.unpersist()
        if self.refill and self.manifest().holes and not label.startswith("repair-"):
            self.repair()

    def _unit(self, name: str, blocks: DataFrame, logs: DataFrame, txs: DataFrame | None, before: Manifest, span: Row, epoch: int | str, kept: list[DataFrame]) -> Unit:
        """Writes a batch's unit and commits it."""
        low, high = span["low"], span["high"]
        after, ancestor = self._reorganised(blocks, low, before)
        if ancestor is not None:
            for handler in self.handlers:
                if handler.rollback:
                    handler.rollback(ancestor, epoch)
        self.store.clear(name)
        own = ["block_number", "block_hash"]
        wanted = self.prune(blocks)
        pruned = wanted is not blocks
        if "block_hash" in logs.columns:
            logs = logs.join(wanted.select(*own), own, "left_semi")
        elif pruned:
            logs = match.prune_logs(logs, wanted)
        if txs is not None and "receipts" in blocks.columns:
            receipts = blocks.select("block_number", F.explode(F.sequence(F.lit(1), F.col("receipts"))).alias("n")).where("n > 0")
            logs = drop_mismatched(logs, txs, receipts)
        tables: dict[str, str] = {}
        known = self._known_children(after)
        if self.spec.factories:
            fresh = match.factory_children(logs, self.spec.factories).join(known.select("address"), "address", "left_anti")
            tables |= self.store.write(name, "_children", fresh.select(*CHILDREN.fieldNames()))
            known = known.unionByName(self.spark.read.schema(CHILDREN).parquet(f"{self.store.folder(name)}/_children"))
        registry = match.registry_union(self.spec.registry(self.spark), known)
        attributes = self._attributes(blocks, txs, kept)
        into = _Into(name, after if after.overlapping(low, high) else None, low, high, _Seen())
        writes: list[Callable[[], dict[str, str]]] = [lambda: self._write_hashes(into, blocks)]
        if self.spec.events:
            found = match.entry_logs(logs, registry, self.spec.events).persist()
            kept.append(found)
            writes += self._shape_writes(into, self.spec.events, found, F.col("data"), attributes)
        if self.spec.calls:
            called = match.entry_calls(txs, registry, self.spec.calls).persist()
            kept.append(called)
            writes += self._shape_writes(into, self.spec.calls, called, calldata_body(), attributes)
        writes += [lambda e=e: self._write_transfers(into, e, txs, attributes) for e in self.spec.transfers]
        with ThreadPoolExecutor(WRITERS) as pool:  # small jobs that do not depend on each other
            for written in list(pool.map(inheritable_thread_target(self.spark)(lambda write: write()), writes)):
                tables |= written
        tables |= self._handled(name, tables, epoch)
        unit = Unit(name, low, high, span["n"], tables)
        holes = before.holes or span["n"] != high - low + 1 or (bool(after.units) and (low > after.checkpoint + 1 or high < min(u.low for u in after.units) - 1))
        done = self.store.commit(replace(after.with_epoch(str(epoch)), units=(*after.units, unit), holes=holes))
        n_pruned = span["n"] - wanted.count() if pruned else 0
        self._count(into.seen, span, n_pruned, ancestor is not None, done)
        schemas = self._schemas()
        self.store.merge(done, schemas, {t: b for t, (_, b) in STATE.items()})
        return unit

    def _attributes(self, blocks: DataFrame, txs: DataFrame | None, kept: list[DataFrame]) -> DataFrame | None:
        """A batch's context, made once for all entries that ask for it."""
        if txs is None or not any(context_fields(e) for e in self.entries()):
            return None
        found = context(blocks, with_gas_used(txs)).persist()
        kept.append(found)
        return found

    def _reorganised(self, blocks: DataFrame, low: int, before: Manifest) -> tuple[Manifest, int | None]:
        """The state without what the batch contradicts (the same block with
        another hash, or a parent that is not there), and the common ancestor."""
        last = before.checkpoint
        if not before.units or low > last + 1:
            return before, None
        # older blocks than these cannot be the ancestor, and units of other blocks are not opened
        stored = self.store.read("_hashes", HASHES, before, low=low - 1 - reorg.MAX_DEPTH, high=last)
        parents = blocks.select((F.col("block_number") - 1).alias("block_number"), F.col("parent_hash").alias("block_hash"))
        seen = blocks.select("block_number", "block_hash").unionByName(parents.join(blocks.select("block_number"), "block_number", "left_anti"))
        against = stored.join(seen.withColumnRenamed("block_hash", "now"), "block_number").agg(
            F.min(F.when(F.col("block_hash") != F.col("now"), F.col("block_number"))).alias("bad"),
            F.max(F.when(F.col("block_hash") == F.col("now"), F.col("block_number"))).alias("same"),
        ).first()
        if against["bad"] is None:
            return before, None
        ancestor = against["same"] if against["same"] is not None and against["same"] < against["bad"] else None
        if ancestor is None and self.canonical:
            ancestor = reorg.require_ancestor(stored, self.canonical(), last)
        if ancestor is None or ancestor < last - reorg.MAX_DEPTH:
            raise reorg.ReorgTooDeep(f"block {against['bad']} differs and no common block is known within {reorg.MAX_DEPTH} blocks of {last}")
        return before.rolled_back(ancestor), ancestor

    # -- rows --------------------------------------------------------------------

    def _write_hashes(self, into: _Into, blocks: DataFrame) -> dict[str, str]:
        stored = blocks.select(*HASHES.fieldNames())
        if into.after is not None:
            there = self.store.read("_hashes", HASHES, into.after, low=into.low, high=into.high)
            stored = stored.join(there.select("block_number"), "block_number", "left_anti")
        return self.store.write(into.unit, "_hashes", stored.coalesce(1))

    def _shape_writes(self, into: _Into, entries: Sequence[EventSpec | CallSpec], found: DataFrame, data: Column, attributes: DataFrame | None) -> list[Callable[[], dict[str, str]]]:
        """Entries of like parameters and context are decoded and written together:
        one write for each likeness."""
        shapes: dict[tuple, list[EventSpec | CallSpec]] = {}
        for e in entries:
            shapes.setdefault((tuple((p.type, p.indexed, p.out) for p in e.params), context_fields(e), type(e)), []).append(e)
        return [lambda a=alike: self._write_shape(into, a, found if len(shapes) == 1 else found.where(F.col("table").isin([x.table for x in a])), data, attributes) for alike in shapes.values()]

    def _write_shape(self, into: _Into, alike: Sequence[EventSpec | CallSpec], rows: DataFrame, data: Column, attributes: DataFrame | None) -> dict[str, str]:
        e = alike[0]
        is_event = isinstance(e, EventSpec)
        params = e.params if is_event else plain_params(e.params)
        rows = with_row_id(rows).withColumn("contract_address", F.col("address") if is_event else F.lit(None).cast("string"))
        fixed = ["table", "id", "block_number", "tx_hash", "tx_index", *(["log_index", "contract_address"] if is_event else [])]
        names = {p.name: f"__p{i}" for i, p in enumerate(params)}  # a parameter may be called like a column of the log
        decoded = into.seen.matched(with_decoded(rows, params, data, fixed, names, keys=True), [x.table for x in alike], is_event)
        decoded = decoded.where("decoded").drop("decoded")
        back = {f"__p{i}": p.out for i, p in enumerate(params)}
        back |= {key_name(k): key_name(v) for k, v in back.items() if key_name(k) in decoded.columns}
        if context_fields(e):
            decoded = with_context(decoded, attributes, context_fields(e))
        return self._write_rows(into, f"{'events' if is_event else 'calls'}-{e.table}", self._with_keys(decoded.withColumnsRenamed(back), e), alike)

    def _with_keys(self, rows: DataFrame, e: Entry) -> DataFrame:
        """Adds the sortable keys of numbers that do not come from a word."""
        schema = table_schema(e)
        missing = [f for f in schema if f.metadata.get("key_of") and f.name not in rows.columns]
        rows = rows.withColumns({f.name: W.number_key(W.number_word(F.col(f.metadata["key_of"]))) for f in missing}) if missing else rows
        return rows.select("table", *schema.fieldNames())

    def _write_transfers(self, into: _Into, e: TransferSpec, txs: DataFrame, attributes: DataFrame | None) -> dict[str, str]:
        moved = with_row_id(match.transfer_filter(match.native_transfers(txs), e)).select(
            F.lit(e.table).alias("table"), "id", "block_number", "tx_hash", "tx_index", F.col("tx_from").alias("from_address"), F.col("tx_to").alias("to_address"), F.col("value").cast("string").alias("value")
        )
        fields = context_fields(e)
        moved = self._with_keys(with_context(moved, attributes, fields) if fields else moved, e)
        return self._write_rows(into, f"transfers-{e.table}", moved, [e])

    def _write_rows(self, into: _Into, folder: str, rows: DataFrame, entries: Sequence[Entry]) -> dict[str, str]:
        """Writes the rows that are new: one of each key in the batch, and of keys
        that are not stored, for which stored rows of the batch's blocks alone are
        read, and only if there are any."""
        key = ["table", *table_key(entries[0])]
        new = first_per_key(rows, key, ["id"])
        there = None
        for e in entries if into.after is not None else ():
            if any(e.table in u.tables and u.low <= into.high and u.top >= into.low for u in into.after.units):
                part = self.store.read(e.table, table_schema(e), into.after, low=into.low, high=into.high).select(F.lit(e.table).alias("table"), *table_key(e))
                there = part if there is None else there.unionByName(part)
        if there is not None:
            new = new.join(there, key, "left_anti")
        new = into.seen.stored(new.sortWithinPartitions("table", "block_number", "id"), [e.table for e in entries], type(entries[0]))
        return self.store.write_many(into.unit, folder, new)

    def _written(self, unit: str, tables: dict[str, str], e: Entry) -> DataFrame | None:
        if e.table not in tables:
            return None
        return self.spark.read.schema(table_schema(e)).parquet(f"{self.store.folder(unit)}/{tables[e.table]}")

    def _handled(self, unit: str, tables: dict[str, str], epoch: int | str) -> dict[str, str]:
        """Lets handlers see the rows and writes what they derive."""
        out: dict[str, str] = {}
        for handler in self.handlers:
            derived = None
            for e in self.entries():
                rows = self._written(unit, tables, e) if handler.matches(*_name_of(e)) else None
                if rows is None:
                    continue
                if handler.handle:
                    handler.handle(rows, epoch)
                if handler.derive:
                    more = handler.derive(rows)
                    derived = more if derived is None else derived.unionByName(more)
            if derived is not None:
                out |= self.store.write(unit, handler.name, derived.select(*handler.schema.fieldNames()))
        return out

    def _count(self, seen: _Seen, span: Row, pruned: int, undone: bool, done: Manifest) -> None:
        c = self.counters
        c.blocks += span["n"]
        c.pruned_blocks += pruned
        c.rollbacks += undone
        seen.add_to(c)
        c.indexed_block, c.head = done.checkpoint, max(c.head, span["high"])
        if span["high"] == done.checkpoint:
            c.latest_timestamp = span["stamp"]

    # -- gaps --------------------------------------------------------------------

    def repair(self, max_blocks: int = ranges.MAX_BLOCKS) -> int:
        """Fills the gaps below the checkpoint from ``refill``, stretch by stretch,
        each under an epoch of its own; returns how many blocks were asked for."""
        asked = 0
        for gap in self.gaps().orderBy("first_missing").toLocalIterator():
            for first in range(gap["first_missing"], gap["last_missing"] + 1, max_blocks):
                last = min(first + max_blocks - 1, gap["last_missing"])
                blocks, logs, txs = self.refill(first, last)
                self.process(blocks, logs, f"repair-{first}-{last}-{self.manifest().version}", True, txs)
                asked += last - first + 1
        m = self.manifest()
        if m.holes and self.gaps().isEmpty():
            self.store.commit(replace(m, holes=False, epochs=tuple(e for e in m.epochs if not e.startswith("repair-"))))
        return asked

    # -- messages ----------------------------------------------------------------

    def _messages(self, e: Entry, written: DataFrame, attributes: DataFrame | None) -> DataFrame:
        """The messages of an entry's rows."""
        contract, event = _name_of(e)
        if isinstance(e, TransferSpec):
            address = F.lit(messages.ZERO_ADDRESS)
        else:
            address = F.col("contract_address") if isinstance(e, EventSpec) else F.lit(None).cast("string")
        out = written.withColumns({"table": F.lit(e.table), "event": F.lit(event), "contract": F.lit(contract), "contract_address": address})
        have = [c for c in ("block_timestamp", "tx_from", "tx_to", *messages.RECEIPT_PAYLOAD) if c not in context_fields(e)]
        if attributes is not None:
            out = with_context(out, attributes, have)
            if isinstance(e, CallSpec):
                out = out.withColumn("contract_address", F.col("tx_to"))
        else:
            out = out.withColumns({"block_timestamp": F.lit(None).cast("bigint"), "tx_from": F.lit(None).cast("string")})
        if isinstance(e, TransferSpec):
            data = F.struct(*[(F.concat(F.lit("0x"), c) if c != "value" else F.col(c)).alias(c) for c in ("from_address", "to_address", "value")])
        else:
            data = messages.data_struct(out, [(p.out, p.name) for p in e.params])
        flagged = (e.table,) if getattr(e, "include_receipts", False) else ()
        told = messages.payload(out, data, log_index=isinstance(e, EventSpec), receipts_for=flagged)
        return told.select("table", "event", "block_number", "tx_index", "body")

    def _notify(self, unit: Unit, blocks: DataFrame, txs: DataFrame | None, epoch: int | str, is_backfill: bool) -> None:
        """After the commit: every message, and what each block added, to every
        sink that wants it."""
        sinks = [s for s in self.sinks if s.wants_backfill or not is_backfill]
        written = [(e, self._written(unit.name, unit.tables, e)) for e in self.entries()] if sinks else []
        attributes = context(blocks, with_gas_used(txs)) if txs is not None else None
        told = [self._messages(e, rows, attributes) for e, rows in written if rows is not None]
        if not told:
            return
        rows = told[0]
        for more in told[1:]:
            rows = rows.unionByName(more)
        rows = rows.persist()
        try:
            for sink in sinks:
                try:
                    if sink.send:
                        sink.send(rows, epoch)
                    if sink.notify and "block_timestamp" in blocks.columns:
                        sink.notify(messages.block_notifications(messages.table_counts(rows), blocks.select("block_number", "block_timestamp")), epoch)
                except Exception as error:  # a sink's failure is its own
                    sink.errors.append(f"{epoch}: {error}")
        finally:
            rows.unpersist()


@dataclass(frozen=True)
class _Into:
    """Where a batch's rows go: its unit, and the state to test them against if
    there are blocks of the batch's in it."""

    unit: str
    after: Manifest | None
    low: int
    high: int
    seen: _Seen


class _Seen:
    """Counts that Spark observes while a batch's jobs run."""

    def __init__(self) -> None:
        self.parts: list[tuple[str, list[str], Observation]] = []

    def _observe(self, rows: DataFrame, kind: str, tables: list[str], test: Column) -> DataFrame:
        watch = Observation(f"{kind}-{uuid.uuid4().hex}")
        self.parts.append((kind, tables, watch))
        return rows.observe(watch, F.count("*").alias("rows"), *[F.count_if((F.col("table") == t) & test).alias(f"t{i}") for i, t in enumerate(tables)])

    def matched(self, rows: DataFrame, tables: list[str], is_event: bool) -> DataFrame:
        return self._observe(rows, "event" if is_event else "call", tables, ~F.col("decoded"))

    def stored(self, rows: DataFrame, tables: list[str], kind: type) -> DataFrame:
        return self._observe(rows, f"stored-{kind.__name__}", tables, F.lit(True))

    def add_to(self, c: Counters) -> None:
        for kind, tables, watch in self.parts:
            try:
                got = watch.get
            except Py4JJavaError:  # a job that was found to have no rows observes nothing
                continue
            if kind == "event":
                c.events_matched += got.get("rows", 0)
            counts = c.stored if kind.startswith("stored") else c.undecodable
            for i, t in enumerate(tables):
                if got.get(f"t{i}"):
                    counts[t] = counts.get(t, 0) + got[f"t{i}"]
            if kind == "stored-EventSpec":
                c.events_stored += got.get("rows", 0)
            elif kind == "stored-CallSpec":
                c.calls_stored += got.get("rows", 0)
            elif kind == "stored-TransferSpec":
                c.transfers_stored += got.get("rows", 0)


# -- streams -----------------------------------------------------------------------


def read_blocks(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1) -> DataFrame:
    """A stream of block files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _start(rows: DataFrame, batch: Rows, checkpoint: str, trigger: dict):
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(f"follow-{uuid.uuid4().hex[:8]}")
    return writer.trigger(**trigger).start()


def nested(index: Index, rows: DataFrame) -> Batch:
    """Blocks with their logs (and transactions) as arrays, taken apart.  Blocks
    that cannot hold a wanted log are left out before logs are."""
    wanted = index.prune(rows)
    logs = wanted.select("block_number", "block_hash", F.explode("logs").alias("l")).select("block_number", "block_hash", "l.*")
    txs = rows.select("block_number", "block_hash", F.explode("txs").alias("t")).select("block_number", "block_hash", "t.*") if "txs" in rows.columns else None
    return rows.drop("logs", "txs"), logs, txs


def follow(index: Index, blocks: DataFrame, checkpoint: str, *, seconds: float | None = None, is_backfill: bool = False):
    """Starts the follow loop over a stream of blocks with their ``logs`` (and, if
    the index needs them, ``txs``) as array columns.  ``seconds`` is the trigger
    interval; without it the stream runs until it has taken all that is there and
    stops."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        try:
            own, logs, txs = nested(index, rows)
            index.process(own, logs, epoch, is_backfill, txs)
        finally:
            rows.unpersist()

    return _start(blocks, batch, checkpoint, {"availableNow": True} if seconds is None else {"processingTime": f"{int(seconds * 1000)} milliseconds"})


def table_reader(spark: SparkSession, blocks: str, logs: str, txs: str | None = None) -> Callable[[int, int], Batch]:
    """Reads stretches of blocks from chain tables; directories and row groups of
    other blocks are skipped."""
    return lambda first, last: (read_range(spark, blocks, first, last), read_range(spark, logs, first, last), read_range(spark, txs, first, last) if txs else None)


def follow_ranges(
    index: Index, read: Callable[[int, int], Batch], checkpoint: str, *, start: int | None = None, end: int | None = None, head: str | None = None,
    max_blocks: int = ranges.MAX_BLOCKS, seconds: float = 1.0, is_backfill: bool | None = None,
):
    """Starts the follow loop over stretches of at most ``max_blocks`` blocks, from
    the spec's first block (or ``start``) to ``end``, or behind the block number
    in the file ``head``.  With an ``end`` and unless told otherwise the blocks
    count as backfill.  A restart goes on behind the last stretch that was done."""
    index.spark.dataSource.register(ranges.BlockRanges)
    source = index.spark.readStream.format("block_ranges").option("start", index.spec.effective_start(start)).option("max_blocks", max_blocks)
    source = source.option("end", end) if end is not None else source
    source = source.option("head", head) if head is not None else source
    old = is_backfill if is_backfill is not None else end is not None

    def batch(rows: DataFrame, epoch: int) -> None:
        for stretch in sorted(rows.collect()):  # one row
            if head is not None:
                index.counters.head = max(index.counters.head, ranges.read_head(head))
            blocks, logs, txs = read(stretch["first_block"], stretch["last_block"])
            index.process(blocks, logs, epoch, old, txs)

    return _start(source.load(), batch, checkpoint, {"processingTime": f"{int(seconds * 1000)} milliseconds"})


class StreamGauges(StreamingQueryListener):
    """Counters and gauges of a followed stream."""

    def __init__(self) -> None:
        self.batches, self.input_rows, self.last_batch, self.rows_per_second, self.failed = 0, 0, -1, 0.0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches += 1
        self.input_rows += p.numInputRows
        self.last_batch = p.batchId
        self.rows_per_second = p.processedRowsPerSecond or 0.0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failed += event.exception is not None
