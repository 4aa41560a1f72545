"""Streams that keep state by key: freezes per (token, user), and logs of pools that the stream itself announces."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlake.operators.upsert import latest_by_key

#: Spark's state store on local disk with checkpoints; the keyed state below needs it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_CHANGES = "token string, user string, revision long, change string, id string, kind string, frozen boolean, amount string, total string, block_number long, log_order long"
_ACCOUNT = ("frozen", "account_block", "account_order")
_LAST = ("delta", "kind", "last_block", "last_order")
_STATE = "frozen boolean, account_block long, account_order long, delta string, kind string, last_block long, last_order long, total string, closed_block long, newest_block long, revision long, timer long"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


class Freezes(StatefulProcessor):
    """State of one (token, user): the last account freeze, the last token freeze, and the running total.

    The value holds what closed logs amount to. The map holds the logs of the key's newest ``horizon``
    blocks by their place, so that a late one is put where it belongs and a repeated one is known; older
    logs are folded into the value. A key without logs for ``idle`` milliseconds is folded as a whole, and
    holds one value from then on.
    """

    def __init__(self, horizon: int, idle: int | None) -> None:
        self.horizon, self.idle = horizon, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", _STATE)
        self.open = handle.getMapState("open", "block long, log_order long, id string", "signed string, kind string")

    def _get(self) -> dict[str, Any]:
        if self.value.exists():
            return dict(zip(_NAMES, self.value.get(), strict=True))
        return dict.fromkeys(_NAMES) | {"total": "0", "closed_block": -1, "newest_block": -1, "revision": 0}

    def _put(self, state: dict[str, Any]) -> None:
        self.value.update(tuple(state[n] for n in _NAMES))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """One row of ``snapshot_state``: logs up to its closed block are in it."""
        row = {n: None if pd.isna(v) else v for n, v in initialState.iloc[0].items()}
        numbers = {"account_block", "account_order", "last_block", "last_order", "closed_block"}
        self._put(self._get() | {n: int(v) if n in numbers and v is not None else v for n, v in row.items() if n in _NAMES} | {"newest_block": int(row["closed_block"])})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, changes = self._get(), []
        before = {n: state[n] for n in (*_ACCOUNT, *_LAST)}
        earliest: tuple | None = None
        for part in rows:
            for r in part.to_dict("records"):
                place = (int(r["block_number"]), int(r["log_order"]), r["id"])
                if place[0] <= state["closed_block"]:
                    changes.append({"change": "closed", "id": r["id"], "kind": r["kind"], "block_number": place[0], "log_order": place[1]})
                    continue
                state["newest_block"] = max(state["newest_block"], place[0])
                if r["kind"] == "AddressFrozen":
                    now = (*place[:2], bool(r["isFrozen"]))
                    if state["account_block"] is None or now > (state["account_block"], state["account_order"], state["frozen"]):
                        state |= {"account_block": now[0], "account_order": now[1], "frozen": now[2]}
                    continue
                last = (*place[:2], r["amount"], r["kind"])
                if state["last_block"] is None or last > (state["last_block"], state["last_order"], state["delta"], state["kind"]):
                    state |= {"last_block": last[0], "last_order": last[1], "delta": last[2], "kind": last[3]}
                if not self.open.containsKey(place):
                    self.open.updateValue(place, (r["amount"] if r["kind"] == "TokensFrozen" else f"-{r['amount']}", r["kind"]))
                    earliest = place if earliest is None else min(earliest, place)
        if any(state[n] != before[n] for n in _ACCOUNT):
            changes.append({"change": "account", "frozen": state["frozen"], "block_number": state["account_block"], "log_order": state["account_order"]})
        if any(state[n] != before[n] for n in _LAST):
            changes.append({"change": "tokens", "kind": state["kind"], "amount": state["delta"], "block_number": state["last_block"], "log_order": state["last_order"]})
        if earliest is not None:
            changes += self._totals(state, earliest)
        self._fold(state, state["newest_block"] - self.horizon)
        if self.idle is not None:
            if state["timer"] is not None:
                self.handle.deleteTimer(state["timer"])
            state["timer"] = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(state["timer"])
        yield from self._told(key, state, changes)
        self._put(state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self._get()
        self._fold(state, state["newest_block"])
        state["timer"] = None
        yield from self._told(key, state, [{"change": "idle", "total": state["total"], "block_number": state["closed_block"], "log_order": 0}])
        self._put(state)

    def _sorted(self) -> list[tuple[tuple, tuple]]:
        return sorted((tuple(k), tuple(v)) for k, v in self.open.iterator())

    def _totals(self, state: dict[str, Any], earliest: tuple) -> list[dict[str, Any]]:
        """Running totals of the first new log and of all after it."""
        total, out = int(state["total"]), []
        for place, (signed, kind) in self._sorted():
            total += int(signed)
            if place >= earliest:
                out.append({"change": "total", "id": place[2], "kind": kind, "amount": signed.lstrip("-"), "total": str(total), "block_number": place[0], "log_order": place[1]})
        return out

    def _fold(self, state: dict[str, Any], block: int) -> None:
        """Logs up to ``block`` become a part of the value."""
        if block <= state["closed_block"]:
            return
        total = int(state["total"])
        for place, (signed, _) in self._sorted():
            if place[0] > block:
                break
            total += int(signed)
            self.open.removeKey(place)
        state |= {"total": str(total), "closed_block": block}

    def _told(self, key: Any, state: dict[str, Any], changes: list[dict[str, Any]]) -> Iterator[pd.DataFrame]:
        if changes:
            state["revision"] += 1
            columns = [c.split()[0] for c in _CHANGES.split(", ")]
            yield pd.DataFrame([{"token": key[0], "user": key[1], "revision": state["revision"]} | c for c in changes], columns=columns).astype(object).where(lambda x: x.notna(), None)


def snapshot_state(actions: DataFrame) -> DataFrame:
    """The state that ``actions`` (a batch, rows of distinct ids) leave, a row for each (token, user): what ``freeze_changes`` starts from.

    Its closed block is the batch's newest, so the stream's own logs must be later.
    """
    from ledgerlake.functions.hexwords import sum_digits

    place = F.struct("block_number", "log_order")
    is_token, is_account = F.col("kind").isin("TokensFrozen", "TokensUnfrozen"), F.col("kind") == "AddressFrozen"
    account = F.max(F.when(is_account, F.struct("block_number", "log_order", "isFrozen")))
    last = F.max(F.when(is_token, F.struct(place.alias("at"), "amount", "kind")))
    total = sum_digits("CASE kind WHEN 'TokensFrozen' THEN amount WHEN 'TokensUnfrozen' THEN concat('-', amount) END")
    keyed = actions.where(is_token | is_account).groupBy("token", "user").agg(account.alias("a"), last.alias("l"), total.alias("total"))
    newest = actions.agg(F.max("block_number").alias("closed_block"))
    fields = [F.col("a.isFrozen").alias("frozen"), F.col("a.block_number").alias("account_block"), F.col("a.log_order").alias("account_order"), F.col("l.amount").alias("delta"), F.col("l.kind").alias("kind"), F.col("l.at.block_number").alias("last_block"), F.col("l.at.log_order").alias("last_order")]
    return keyed.select("token", "user", *fields, "total").crossJoin(F.broadcast(newest))  # one row


def use_rocksdb(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB; streams that exist keep what they were started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def freeze_changes(actions: DataFrame, initial: DataFrame | None = None, horizon: int = 100_000, idle: int | None = None) -> DataFrame:
    """A stream of transfer-agent actions as a stream of changes of the freezes per (token, user).

    A row's ``change`` says what it holds: ``account`` (frozen), ``tokens`` (kind and amount of the last freeze or
    unfreeze), ``total`` (the running total after the log ``id``), ``idle`` (a key that has been folded), and ``closed``:
    a log at or before a block that the key has closed, which is taken for a repeated one and changes nothing. Logs may
    come in any order and split within ``horizon`` blocks of a key's newest; a late one sends the totals after it again.
    The change of greatest ``revision`` holds: see ``current_freezes``. Start from ``initial`` (``snapshot_state``), if
    given. Needs ``use_rocksdb``, and append mode; with ``idle``, a query that is to
    end by itself (availableNow) must switch off spark.sql.streaming.noDataMicroBatches.enabled. Rows without token or user are one key each, like any others.
    """
    rows = actions.where("kind IN ('AddressFrozen', 'TokensFrozen', 'TokensUnfrozen')").select("token", "user", "id", "kind", F.coalesce("isFrozen", F.lit(False)).alias("isFrozen"), F.coalesce("amount", F.lit("0")).alias("amount"), "block_number", "log_order")
    start = None if initial is None else initial.groupBy("token", "user")
    return rows.groupBy("token", "user").transformWithStateInPandas(Freezes(horizon, idle), _CHANGES, "Append", "None" if idle is None else "ProcessingTime", start)


def current_freezes(changes: DataFrame) -> dict[str, DataFrame]:
    """accounts, tokens and totals from all changes so far, in the columns of the batch's snapshots."""
    ident = F.concat_ws(":", "token", "user").alias("id")
    newest = latest_by_key(changes.where("change IN ('account', 'tokens')"), ("token", "user", "change"), ("revision",))
    totals = latest_by_key(changes.where("change = 'total'"), ("token", "user", "id"), ("revision",))
    return {
        "accounts": newest.where("change = 'account'").select(ident, "token", "user", "frozen", F.col("block_number").alias("updated"), "log_order"),
        "tokens": newest.where("change = 'tokens'").select(ident, "token", "user", F.col("amount").alias("delta"), "kind", F.col("block_number").alias("updated"), "log_order"),
        "totals": totals.select("id", "token", "user", "kind", "amount", "block_number", "log_order", "total"),
    }


def by_block(rows: DataFrame, late: int, block: str = "block_number", at: str = "at") -> DataFrame:
    """``at``: the block number as seconds (and one, for a watermark starts at 0 and block 0 is not late), with a watermark of ``late`` blocks. What windows and watermarks say in seconds then holds for blocks."""
    return rows.withColumn(at, F.timestamp_seconds(F.col(block) + 1)).withWatermark(at, f"{late} seconds")


def announced_stream(logs: DataFrame, pools: DataFrame, late: int, span: int, known: DataFrame | None = None) -> DataFrame:
    """A stream of logs, of those contracts alone that a stream of pools (id, created_block) announces at or before the log's block.

    Either stream may be ``late`` blocks out of order, and a log meets announcements of the ``span`` blocks before it;
    both sides drop their state once the watermark is past that. Pools announced earlier are in a table by then:
    give it as ``known`` (static rows of id, created_block), and their logs are found there and not kept in state.
    """
    first = by_block(pools.select(F.col("id").alias("p_id"), F.col("created_block").alias("p_block")), late, "p_block", "p_at")
    own, met = logs, None
    if known is not None:
        table = known.groupBy(F.col("id").alias("k_id")).agg(F.min("created_block").alias("k_block"))
        on = (F.col("address") == F.col("k_id")) & (F.col("block_number") >= F.col("k_block"))
        own, met = logs.join(table, on, "left_anti"), logs.join(table, on, "left_semi")
    span_of = F.expr(f"at >= p_at AND at <= p_at + INTERVAL {span} SECONDS")
    found = by_block(own, late).join(first, (F.col("address") == F.col("p_id")) & span_of, "left_semi").drop("at")
    return found if met is None else found.unionByName(met)
