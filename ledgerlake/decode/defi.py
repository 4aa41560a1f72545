"""Governance, gauges, locks, karma, staking, treasury and liquid-staking events: twelve tables and a few extras."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import topics as t
from ledgerlake.decode.base import address, by_kind, enough, only, take, topic, topic_uint, uint, word, word_address
from ledgerlake.functions import hexwords as hx
from ledgerlake.schemas import STORED_LOG


#: What a table is decoded by: signature -> (event, least topics), and its columns.
Layout = tuple[dict[str, tuple[str, int]], dict[str, Column]]


def _layout(names: dict[str, tuple[str, int]], **columns: Column) -> Layout:
    return names, columns


def _belongs(names: dict[str, tuple[str, int]]) -> Column:
    return enough({s: n for s, (_, n) in names.items()})


def _event(names: dict[str, tuple[str, int]]) -> Column:
    return by_kind({s: e for s, (e, _) in names.items()}).alias("event")


_PLACE = ("block_number", "tx_hash", "log_index", "log_order")


def _table(layout: Callable[[], Layout]) -> Callable[[DataFrame], DataFrame]:
    """The decoder of logs into one table, from what it is decoded by."""

    @wraps(layout)
    def decode(logs: DataFrame) -> DataFrame:
        names, columns = layout()
        return take(logs.where(_belongs(names)), F.col("address").alias("contract"), _event(names), *(c.alias(n) for n, c in columns.items()), *_PLACE)

    decode.layout = layout
    return decode


def _flag(i: int) -> Column:
    return hx.word_bool(word(i))


def _addr(i: int) -> Column:
    return word_address(i, on_short="", whole=False)


def _k(i: int, bits: int) -> Column:
    return hx.uint_k(word(i), bits)


@_table
def proposals() -> Layout:
    names = {t.PROPOSAL_CREATED: ("created", 1), t.PROPOSAL_EXECUTED: ("executed", 1), t.PROPOSAL_CANCELED: ("canceled", 1), t.PROPOSAL_QUEUED: ("queued", 1)}
    made = t.PROPOSAL_CREATED
    return _layout(names, proposal=uint(0), proposer=only(made, _addr(1)), startBlock=only(made, uint(5)), endBlock=only(made, uint(6)), eta=only(t.PROPOSAL_QUEUED, uint(1)))


@_table
def votes() -> Layout:
    """support: 0 against, 1 for, 2 abstain"""
    return _layout({t.VOTE_CAST: ("vote", 2)}, voter=address(1), proposal=uint(0), support=_k(1, 8), weight=uint(2))


@_table
def delegate_changes() -> Layout:
    return _layout({t.DELEGATE_CHANGED: ("delegate_changed", 4)}, delegator=address(1), fromDelegate=address(2), toDelegate=address(3))


@_table
def delegate_votes_changes() -> Layout:
    return _layout({t.DELEGATE_VOTES_CHANGED: ("delegate_votes_changed", 2)}, delegate=address(1), previousBalance=uint(0), newBalance=uint(1))


@_table
def gauges() -> Layout:
    names = {t.GAUGE_ADDED: ("added", 2), t.GAUGE_UPDATED: ("updated", 2), t.GAUGE_VOTE_CAST: ("vote", 3), t.WEIGHTS_UPDATED: ("weights_updated", 1)}
    gauge = F.coalesce(only((t.GAUGE_ADDED, t.GAUGE_UPDATED), topic_uint(1)), only(t.GAUGE_VOTE_CAST, topic_uint(2)))
    return _layout(names, gaugeId=gauge, recipient=only(t.GAUGE_ADDED, _addr(0)), active=only(t.GAUGE_UPDATED, _flag(0)), user=only(t.GAUGE_VOTE_CAST, address(1)), weight=only(t.GAUGE_VOTE_CAST, uint(0)))


@_table
def vote_locks() -> Layout:
    return _layout({t.LOCK_DEPOSIT: ("deposit", 3), t.LOCK_WITHDRAW: ("withdraw", 2)}, user=address(1), amount=uint(0), lockEnd=only(t.LOCK_DEPOSIT, topic_uint(2)))


@_table
def karma() -> Layout:
    names = {t.KARMA_MINTED: ("minted", 2), t.KARMA_SLASHED: ("slashed", 2), t.KARMA_DECAYED: ("decayed", 2), t.DID_LINKED: ("did_linked", 3), t.VERIFIED: ("verified", 2)}
    valued, reasoned = (t.KARMA_MINTED, t.KARMA_SLASHED, t.KARMA_DECAYED), (t.KARMA_MINTED, t.KARMA_SLASHED)
    return _layout(names, account=address(1), amount=only(valued, uint(0)), reason=only(reasoned, hx.word_hex(word(1))), wasActive=only(t.KARMA_DECAYED, _flag(1)), did=only(t.DID_LINKED, topic(2)))


@_table
def stakes() -> Layout:
    names = {t.STAKED: ("staked", 2), t.UNSTAKED: ("unstaked", 2), t.REBASED: ("rebased", 1), t.DEMURRAGE_APPLIED: ("demurrage", 2), t.STAKE_MINTED: ("minted", 3)}
    amount = F.when(F.col("topic0") == t.REBASED, uint(1)).otherwise(uint(0))
    user = only((t.STAKED, t.UNSTAKED, t.DEMURRAGE_APPLIED, t.STAKE_MINTED), address(1))
    return _layout(names, user=user, amount=amount, tier=only(t.STAKED, _k(1, 8)), lockEnd=only(t.STAKED, uint(2)), epoch=only(t.REBASED, uint(0)), rate=only(t.REBASED, uint(2)), reason=only(t.STAKE_MINTED, topic(2)))


@_table
def vaults() -> Layout:
    return _layout({t.VAULT_RECEIVE: ("receive", 2), t.VAULT_FLUSH: ("flush", 2)}, chain=topic(1), amount=uint(0), warpId=only(t.VAULT_RECEIVE, hx.word_hex(word(1))))


@_table
def fee_governance() -> Layout:
    names = {t.FEE_GOV_RATE: ("rate", 1), t.FEE_GOV_CHAIN: ("chain", 2), t.FEE_GOV_BROADCAST: ("broadcast", 1)}
    version = F.coalesce(only(t.FEE_GOV_RATE, _k(1, 32)), only(t.FEE_GOV_BROADCAST, _k(0, 32)))
    return _layout(names, rate=only(t.FEE_GOV_RATE, _k(0, 16)), version=version, chain=only(t.FEE_GOV_CHAIN, topic(1)), active=only(t.FEE_GOV_CHAIN, _flag(0)), count=only(t.FEE_GOV_BROADCAST, uint(1)))


@_table
def routers() -> Layout:
    names = {t.ROUTER_WEIGHT: ("weight", 2), t.ROUTER_DISTRIBUTE: ("distribute", 1), t.ROUTER_CLAIM: ("claim", 2)}
    return _layout(names, recipient=only((t.ROUTER_WEIGHT, t.ROUTER_CLAIM), address(1)), weight=only(t.ROUTER_WEIGHT, uint(0)), amount=only((t.ROUTER_DISTRIBUTE, t.ROUTER_CLAIM), uint(0)))


@_table
def liquid() -> Layout:
    names = {t.FEES_RECEIVED: ("fees_received", 3), t.VALIDATOR_REWARDS_RECEIVED: ("validator_rewards", 2), t.SLASHING_APPLIED: ("slashing", 1), t.EMERGENCY_WITHDRAWAL: ("emergency_withdrawal", 2)}
    fees, slash = t.FEES_RECEIVED, t.SLASHING_APPLIED
    sender = only((fees, t.VALIDATOR_REWARDS_RECEIVED, t.EMERGENCY_WITHDRAWAL), address(1))
    return _layout(names, **{"from": sender}, feeType=only(fees, topic(2)), amount=uint(0), perfFee=only(fees, uint(1)), toReserve=only(fees, uint(2)), fromReserve=only(slash, uint(1)), socialized=only(slash, uint(2)))


@_table
def guardian_updates() -> Layout:
    return _layout({t.GUARDIAN_UPDATED: ("guardian_updated", 1)}, oldGuardian=_addr(0), newGuardian=_addr(1))


@_table
def lock_supplies() -> Layout:
    return _layout({t.LOCK_SUPPLY: ("supply", 1)}, previousSupply=uint(0), newSupply=uint(1))


@_table
def tier_upgrades() -> Layout:
    return _layout({t.TIER_UPGRADED: ("tier_upgraded", 2)}, user=address(1), fromTier=_k(0, 8), toTier=_k(1, 8))


TABLES = {
    "GovernanceProposal": proposals,
    "GovernanceVote": votes,
    "DelegateChange": delegate_changes,
    "DelegateVotesChange": delegate_votes_changes,
    "GaugeEvent": gauges,
    "VoteLockEvent": vote_locks,
    "KarmaEvent": karma,
    "StakeEvent": stakes,
    "VaultEvent": vaults,
    "FeeGovEvent": fee_governance,
    "RouterEvent": routers,
    "LiquidEvent": liquid,
}
EXTRAS = {"GuardianUpdate": guardian_updates, "VoteLockSupply": lock_supplies, "TierUpgrade": tier_upgrades}


def parse_all(logs: DataFrame) -> dict[str, DataFrame]:
    """Every table from one set of logs; unknown signatures are ignored.

    The logs are read once per table: store them by signature (``sources.logs.write_logs``) or cache
    them, so that each reads its own part.
    """
    return {name: decode(logs) for name, decode in TABLES.items()}


def parse_once(logs: DataFrame) -> DataFrame:
    """Every log of a known event in one pass: ``table``, contract, place, and a struct for each table, null but for the log's own.

    One filter and one projection over one scan, whatever the number of tables; rows keep their order.
    """
    layouts = {name: decode.layout() for name, decode in TABLES.items()}
    known = None
    for name, (names, _) in layouts.items():
        known = (F if known is None else known).when(_belongs(names), F.lit(name))
    named = logs.withColumn("table", known).where("table IS NOT NULL")
    structs = [F.when(F.col("table") == name, F.struct(_event(names), *(c.alias(n) for n, c in columns.items()))).alias(name) for name, (names, columns) in layouts.items()]
    return take(named, "table", F.col("address").alias("contract"), *_PLACE, *structs)


def write_parsed(logs: DataFrame, path: str) -> None:
    """All tables by one job over one scan, a folder for each; the rows of a task stay in log order."""
    parse_once(logs).sortWithinPartitions("table", "block_number", "log_order").write.mode("append").partitionBy("table").parquet(path)


def read_parsed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the tables that ``write_parsed`` has stored, in the columns of its decoder; other tables' files are not read."""
    empty = TABLES[name](_no_logs(spark))
    fields = T.StructType([f for f in empty.schema.fields if f.name not in ("contract", *_PLACE)])
    schema = T.StructType([*[empty.schema[c] for c in ("contract", *_PLACE)], T.StructField(name, fields), T.StructField("table", T.StringType())])
    stored = spark.read.schema(schema).parquet(path).where(F.col("table") == name)
    return stored.select(*[F.col(f"{name}.{f.name}").alias(f.name) if f.name in fields.names else F.col(f.name) for f in empty.schema.fields])


def _no_logs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([f for f in STORED_LOG.fields if f.name != "block_bucket"]))
