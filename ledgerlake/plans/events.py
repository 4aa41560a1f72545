"""Queries over the event families that the swap queries do not touch, and over the get operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import topics as t
from ledgerlake.decode import amm, defi, securities
from ledgerlake.operators import entities, query, rollups, snapshots
from ledgerlake.operators.upsert import as_entities, upsert_entities
from ledgerlake.plans.queries import _SWAPS, _period, _pools, _swaps, _timed
from ledgerlake.plans.registry import ADDRESS, CENTS, TOPIC
from ledgerlake.plans.registry import SQL as _SQL
from ledgerlake.plans.registry import query as _query
from ledgerlake.sources import synth


def _events(signatures: int) -> str:
    """The fields of ``synth.order_logs``: s numbers the signature, a, t and n are topics, w are words."""
    topics = {1: "o_custkey % 100", 2: "o_custkey % 7", 3: "o_orderkey % 3"}
    told = ", ".join(f"{ADDRESS(x)} AS a{i}, {TOPIC(x)} AS t{i}, CAST({x} AS BIGINT) AS n{i}" for i, x in topics.items())
    return f"""e AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderkey % {signatures} AS s, {told}, CAST(o_custkey % 50 AS BIGINT) AS w0, {CENTS('o_totalprice')} AS w1, CAST(o_orderkey AS BIGINT) AS w2,
  CAST({CENTS('o_totalprice')}::HUGEINT * 18446744073709551616::HUGEINT + o_orderkey AS VARCHAR) AS w3, CAST(-(o_orderkey % 50) AS BIGINT) AS w4, CAST(o_custkey AS BIGINT) AS w5, CAST(o_custkey + 10 AS BIGINT) AS w6 FROM orders)"""


def _name(*names: str) -> str:
    return "CASE s " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _if(s: str, x: str) -> str:
    return f"CASE WHEN s IN ({s}) THEN {x} END"


_HEX = "('0x' || format('{{:x}}', {}))".format


# Governance


@_query(f"WITH {_events(4)} SELECT k AS block_number, {_name('created', 'executed', 'canceled', 'queued')} AS event, {_text('w0')} AS proposal, {_if('0', ADDRESS('w1'))} AS proposer, {_if('0', _text('w5'))} AS start_block, {_if('0', _text('w6'))} AS end_block, {_if('3', _text('w1'))} AS eta FROM e")
def decode_proposals(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.PROPOSAL_CREATED, t.PROPOSAL_EXECUTED, t.PROPOSAL_CANCELED, t.PROPOSAL_QUEUED)
    return defi.proposals(logs).select("block_number", "event", "proposal", "proposer", F.col("startBlock").alias("start_block"), F.col("endBlock").alias("end_block"), "eta")


@_query(f"""WITH {_events(4)}, p AS (SELECT w0, arg_max({_name('created', 'executed', 'canceled', 'queued')}, k) AS status FROM e GROUP BY 1), v AS (SELECT o_custkey % 50 AS w0, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(w0 AS VARCHAR) AS proposal, status, n AS votes FROM p FULL JOIN v USING (w0)""")
def proposal_status(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.PROPOSAL_CREATED, t.PROPOSAL_EXECUTED, t.PROPOSAL_CANCELED, t.PROPOSAL_QUEUED, contract=9)
    return rollups.proposal_tally(defi.votes(synth.vote_logs(spark, sf)), defi.proposals(logs)).select("proposal", "status", "votes")


@_query(f"WITH {_events(2)} SELECT k AS block_number, a1 AS delegator, a2 AS from_delegate, a3 AS to_delegate FROM e WHERE s = 0")
def decode_delegations(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.DELEGATE_CHANGED, t.DELEGATE_VOTES_CHANGED)
    return defi.delegate_changes(logs).select("block_number", "delegator", F.col("fromDelegate").alias("from_delegate"), F.col("toDelegate").alias("to_delegate"))


@_query(f"WITH {_events(2)} SELECT a1 AS delegator, arg_max(a3, k) AS to_delegate, max(k) AS block_number FROM e WHERE s = 0 GROUP BY 1")
def current_delegations(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.DELEGATE_CHANGED, t.DELEGATE_VOTES_CHANGED)
    return snapshots.delegations(defi.delegate_changes(logs)).select("delegator", F.col("toDelegate").alias("to_delegate"), "block_number")


@_query(f"WITH {_events(2)} SELECT a1 AS delegate, CAST(arg_max(w1, k) AS VARCHAR) AS balance, max(k) AS block_number FROM e WHERE s = 1 GROUP BY 1")
def voting_power(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.DELEGATE_CHANGED, t.DELEGATE_VOTES_CHANGED)
    return snapshots.voting_power(defi.delegate_votes_changes(logs)).select("delegate", "balance", "block_number")


@_query(f"WITH {_events(2)} SELECT k AS block_number, a1 AS delegate, {_text('w0')} AS previous_balance, {_text('w1')} AS new_balance FROM e WHERE s = 1")
def decode_delegate_votes(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.DELEGATE_CHANGED, t.DELEGATE_VOTES_CHANGED)
    return defi.delegate_votes_changes(logs).select("block_number", "delegate", F.col("previousBalance").alias("previous_balance"), F.col("newBalance").alias("new_balance"))


# Gauges, locks, karma, staking


@_query(f"WITH {_events(4)} SELECT k AS block_number, {_name('added', 'updated', 'vote', 'weights_updated')} AS event, CASE s WHEN 2 THEN {_text('n2')} WHEN 3 THEN NULL ELSE {_text('n1')} END AS gauge, {_if('0', ADDRESS('w0'))} AS recipient, {_if('1', 'w0 > 0')} AS active, {_if('2', 'a1')} AS \"user\", {_if('2', _text('w0'))} AS weight FROM e")
def decode_gauges(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.GAUGE_ADDED, t.GAUGE_UPDATED, t.GAUGE_VOTE_CAST, t.WEIGHTS_UPDATED)
    return defi.gauges(logs).select("block_number", "event", F.col("gaugeId").alias("gauge"), "recipient", "active", "user", "weight")


@_query(f"WITH {_events(2)} SELECT k AS block_number, {_name('deposit', 'withdraw')} AS event, a1 AS \"user\", {_text('w0')} AS amount, {_if('0', _text('n2'))} AS lock_end FROM e")
def decode_locks(spark: SparkSession, sf: str) -> DataFrame:
    return defi.vote_locks(synth.order_logs(spark, sf, t.LOCK_DEPOSIT, t.LOCK_WITHDRAW)).select("block_number", "event", "user", "amount", F.col("lockEnd").alias("lock_end"))


@_query(f"WITH {_events(5)} SELECT k AS block_number, {_name('minted', 'slashed', 'decayed', 'did_linked', 'verified')} AS event, a1 AS account, {_if('0, 1, 2', _text('w0'))} AS amount, {_if('0, 1', _HEX('w1'))} AS reason, {_if('2', 'w1 > 0')} AS was_active, {_if('3', 't2')} AS did FROM e")
def decode_karma(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.KARMA_MINTED, t.KARMA_SLASHED, t.KARMA_DECAYED, t.DID_LINKED, t.VERIFIED)
    return defi.karma(logs).select("block_number", "event", "account", "amount", "reason", F.col("wasActive").alias("was_active"), "did")


@_query(f"""WITH {_events(5)} SELECT k AS block_number, {_name('staked', 'unstaked', 'rebased', 'demurrage', 'minted')} AS event, {_if('0, 1, 3, 4', 'a1')} AS \"user\", CASE s WHEN 2 THEN {_text('w1')} ELSE {_text('w0')} END AS amount, {_if('0', 'w1 % 256')} AS tier, {_if('0', _text('w2'))} AS lock_end,
{_if('2', _text('w0'))} AS epoch, {_if('2', _text('w2'))} AS rate, {_if('4', 't2')} AS reason FROM e""")
def decode_stakes(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.STAKED, t.UNSTAKED, t.REBASED, t.DEMURRAGE_APPLIED, t.STAKE_MINTED)
    return defi.stakes(logs).select("block_number", "event", "user", "amount", "tier", F.col("lockEnd").alias("lock_end"), "epoch", "rate", "reason")


@_query(f"""WITH {_events(3)} SELECT k AS block_number, 'guardian' AS kind, {ADDRESS('w0')} AS before, {ADDRESS('w1')} AS after FROM e WHERE s = 0
UNION ALL SELECT k, 'supply', {_text('w0')}, {_text('w1')} FROM e WHERE s = 1 UNION ALL SELECT k, a1, {_text('w0 % 256')}, {_text('w1 % 256')} FROM e WHERE s = 2""")
def decode_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Guardians, lock supplies and tiers: what was and what is."""
    logs = synth.order_logs(spark, sf, t.GUARDIAN_UPDATED, t.LOCK_SUPPLY, t.TIER_UPGRADED)
    guardians = defi.guardian_updates(logs).select("block_number", F.lit("guardian").alias("kind"), F.col("oldGuardian").alias("before"), F.col("newGuardian").alias("after"))
    supplies = defi.lock_supplies(logs).select("block_number", F.lit("supply").alias("kind"), F.col("previousSupply").alias("before"), F.col("newSupply").alias("after"))
    tiers = defi.tier_upgrades(logs).select("block_number", F.col("user").alias("kind"), F.col("fromTier").cast("string").alias("before"), F.col("toTier").cast("string").alias("after"))
    return guardians.unionByName(supplies).unionByName(tiers)


# Treasury and liquid staking


@_query(f"WITH {_events(2)} SELECT k AS block_number, {_name('receive', 'flush')} AS event, t1 AS chain, {_text('w0')} AS amount, {_if('0', _HEX('w1'))} AS warp_id FROM e")
def decode_vaults(spark: SparkSession, sf: str) -> DataFrame:
    return defi.vaults(synth.order_logs(spark, sf, t.VAULT_RECEIVE, t.VAULT_FLUSH)).select("block_number", "event", "chain", "amount", F.col("warpId").alias("warp_id"))


@_query(f"WITH {_events(3)} SELECT k AS block_number, {_name('rate', 'chain', 'broadcast')} AS event, {_if('0', 'w0 % 65536')} AS rate, CASE s WHEN 0 THEN w1 % 4294967296 WHEN 2 THEN w0 % 4294967296 END AS version, {_if('1', 't1')} AS chain, {_if('1', 'w0 > 0')} AS active, {_if('2', _text('w1'))} AS receivers FROM e")
def decode_fee_governance(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.FEE_GOV_RATE, t.FEE_GOV_CHAIN, t.FEE_GOV_BROADCAST)
    return defi.fee_governance(logs).select("block_number", "event", "rate", "version", "chain", "active", F.col("count").alias("receivers"))


@_query(f"WITH {_events(3)} SELECT k AS block_number, {_name('weight', 'distribute', 'claim')} AS event, {_if('0, 2', 'a1')} AS recipient, {_if('0', _text('w0'))} AS weight, {_if('1, 2', _text('w0'))} AS amount FROM e")
def decode_routers(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.ROUTER_WEIGHT, t.ROUTER_DISTRIBUTE, t.ROUTER_CLAIM)
    return defi.routers(logs).select("block_number", "event", "recipient", "weight", "amount")


@_query(f"""WITH {_events(3)}, r AS (SELECT a1 AS recipient, arg_max(w0, k) FILTER (s = 0) AS weight, coalesce(sum(w0) FILTER (s = 2), 0) AS claimed FROM e WHERE s IN (0, 2) GROUP BY 1)
SELECT recipient, CAST(weight AS VARCHAR) AS weight, CAST(claimed AS VARCHAR) AS claimed, weight::DOUBLE / (SELECT sum(weight) FROM r)::DOUBLE AS share FROM r""")
def router_shares(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.ROUTER_WEIGHT, t.ROUTER_DISTRIBUTE, t.ROUTER_CLAIM)
    return rollups.router_shares(defi.routers(logs)).select("recipient", F.col("weight").cast("string").alias("weight"), F.col("claimed").cast("string").alias("claimed"), "share")


@_query(f"""WITH {_events(4)} SELECT k AS block_number, {_name('fees_received', 'validator_rewards', 'slashing', 'emergency_withdrawal')} AS event, {_if('0, 1, 3', 'a1')} AS sender, {_if('0', 't2')} AS fee_type, {_text('w0')} AS amount, {_if('0', _text('w1'))} AS perf_fee, {_if('0', _text('w2'))} AS to_reserve, {_if('2', _text('w1'))} AS from_reserve, {_if('2', _text('w2'))} AS socialized FROM e""")
def decode_liquid(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.FEES_RECEIVED, t.VALIDATOR_REWARDS_RECEIVED, t.SLASHING_APPLIED, t.EMERGENCY_WITHDRAWAL)
    return defi.liquid(logs).select("block_number", "event", F.col("from").alias("sender"), F.col("feeType").alias("fee_type"), "amount", F.col("perfFee").alias("perf_fee"), F.col("toReserve").alias("to_reserve"), F.col("fromReserve").alias("from_reserve"), "socialized")


_ONE_OF_EACH = {"GovernanceProposal": t.PROPOSAL_CREATED, "GovernanceVote": t.VOTE_CAST, "DelegateChange": t.DELEGATE_CHANGED, "DelegateVotesChange": t.DELEGATE_VOTES_CHANGED, "GaugeEvent": t.GAUGE_UPDATED, "VoteLockEvent": t.LOCK_DEPOSIT, "KarmaEvent": t.VERIFIED, "StakeEvent": t.REBASED, "VaultEvent": t.VAULT_FLUSH, "FeeGovEvent": t.FEE_GOV_CHAIN, "RouterEvent": t.ROUTER_WEIGHT, "LiquidEvent": t.SLASHING_APPLIED}


@_query(f"WITH {_events(len(_ONE_OF_EACH) + 1)} SELECT {_name(*_ONE_OF_EACH)} AS entity, count(*) AS events, min(k) AS first_block, max(k) AS last_block FROM e WHERE s < {len(_ONE_OF_EACH)} GROUP BY 1")
def parsed_tables(spark: SparkSession, sf: str) -> DataFrame:
    """All twelve tables from one set of logs, some of which nobody knows."""
    parsed = defi.parse_all(synth.order_logs(spark, sf, *_ONE_OF_EACH.values(), t.TRANSFER))
    return amm.union_all(*[rows.select(F.lit(name).alias("entity"), "block_number") for name, rows in parsed.items()]).groupBy("entity").agg(F.count("*").alias("events"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


@_query(_SQL["parsed_tables"])
def parsed_in_one_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The same from one scan of the logs."""
    logs = synth.order_logs(spark, sf, *_ONE_OF_EACH.values(), t.TRANSFER)
    return defi.parse_once(logs).groupBy(F.col("table").alias("entity")).agg(F.count("*").alias("events"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


# Security tokens

_ID = f"{ADDRESS(12)} || ':' || {TOPIC('k')} || ':0x0'"


@_query(f"WITH {_events(3)} SELECT {_ID} AS id, {_name('Paused', 'Unpaused', 'RecoverySuccess')} AS kind, {_if('0, 1', ADDRESS('w0'))} AS \"user\", {_if('2', 'a1')} AS lost, {_if('2', 'a2')} AS new, {_if('2', 'a3')} AS investor FROM e")
def decode_pauses(spark: SparkSession, sf: str) -> DataFrame:
    """Pauses and recoveries."""
    logs = synth.order_logs(spark, sf, t.PAUSED, t.UNPAUSED, t.RECOVERY_SUCCESS)
    return securities.transfer_agent_actions(logs).select("id", "kind", "user", F.col("lostWallet").alias("lost"), F.col("newWallet").alias("new"), F.col("investorOnchainID").alias("investor"))


@_query(f"WITH {_events(3)} SELECT {ADDRESS('w5 % 20')} AS token, max(k) AS block_number FROM e WHERE s < 2 GROUP BY 1 HAVING arg_max(s, k) = 0")
def paused_tokens(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.order_logs(spark, sf, t.PAUSED, t.UNPAUSED, t.RECOVERY_SUCCESS, contract=F.col("o_custkey") % 20)
    return snapshots.paused_tokens(securities.transfer_agent_actions(logs)).select("token", "block_number")


_IDENTITIES = list(securities.IDENTITIES.values())


@_query(f"WITH {_events(len(_IDENTITIES))} SELECT {_ID} AS id, {_name(*_IDENTITIES)} AS kind, {ADDRESS(12)} AS registry, t1 AS topic1, t2 AS topic2 FROM e")
def identity_registry_actions(spark: SparkSession, sf: str) -> DataFrame:
    return securities.identity_registry_actions(synth.order_logs(spark, sf, *securities.IDENTITIES)).select("id", "kind", "registry", "topic1", "topic2")


@_query(f"WITH {_events(3)} SELECT {_ID} AS id, {_name('ClaimAdded', 'ClaimRemoved', 'ClaimChanged')} AS kind, t1 AS claim, {_text('n2')} AS topic, a3 AS issuer FROM e")
def decode_claims(spark: SparkSession, sf: str) -> DataFrame:
    return securities.claims(synth.order_logs(spark, sf, *securities.CLAIMS)).select("id", "kind", F.col("claimId").alias("claim"), "topic", "issuer")


@_query(f"WITH {_events(3)} SELECT t1 AS claim, CASE arg_max(s, k) WHEN 0 THEN 'ClaimAdded' ELSE 'ClaimChanged' END AS kind, max(k) AS block_number FROM e GROUP BY 1 HAVING arg_max(s, k) <> 1")
def live_claims(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.live_claims(securities.claims(synth.order_logs(spark, sf, *securities.CLAIMS))).select(F.col("claimId").alias("claim"), "kind", "block_number")


@_query(f"WITH {_events(2)} SELECT {_ID} AS id, {_name('KeyAdded', 'KeyRemoved')} AS kind, t1 AS key, {_text('n2')} AS purpose, {_text('n3')} AS key_type FROM e")
def decode_keys(spark: SparkSession, sf: str) -> DataFrame:
    return securities.keys(synth.order_logs(spark, sf, *securities.KEYS)).select("id", "kind", "key", "purpose", F.col("keyType").alias("key_type"))


@_query(f"WITH {_events(2)} SELECT t1 AS key, max(k) AS block_number FROM e GROUP BY 1 HAVING arg_max(s, k) = 0")
def live_keys(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.live_keys(securities.keys(synth.order_logs(spark, sf, *securities.KEYS))).select("key", "block_number")


@_query(f"WITH {_events(3)} SELECT a1 AS issuer, CASE arg_max(s, k) WHEN 0 THEN 'TrustedIssuerAdded' ELSE 'ClaimTopicsUpdated' END AS kind, max(k) AS block_number FROM e GROUP BY 1 HAVING arg_max(s, k) <> 1")
def live_issuers(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.live_issuers(securities.trusted_issuer_actions(synth.order_logs(spark, sf, *securities.ISSUERS))).select("issuer", "kind", "block_number")


@_query(f"WITH {_events(2)} SELECT {_ID} AS id, {_name('ClaimTopicAdded', 'ClaimTopicRemoved')} AS kind, {_text('n1')} AS topic FROM e")
def claim_topic_actions(spark: SparkSession, sf: str) -> DataFrame:
    return securities.claim_topic_actions(synth.order_logs(spark, sf, *securities.CLAIM_TOPICS)).select("id", "kind", "topic")


_COMPLIANCE = list(securities.COMPLIANCE.values())


@_query(f"WITH {_events(len(_COMPLIANCE))} SELECT {_ID} AS id, {_name(*_COMPLIANCE)} AS kind, {ADDRESS(12)} AS compliance, a1 AS target FROM e")
def compliance_actions(spark: SparkSession, sf: str) -> DataFrame:
    return securities.compliance_actions(synth.order_logs(spark, sf, *securities.COMPLIANCE)).select("id", "kind", "compliance", "target")


@_query(f"WITH {_events(len(_COMPLIANCE))} SELECT a1 AS module, max(k) AS block_number FROM e WHERE s < 2 GROUP BY 1 HAVING arg_max(s, k) = 0")
def live_modules(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.live_modules(securities.compliance_actions(synth.order_logs(spark, sf, *securities.COMPLIANCE))).select(F.col("target").alias("module"), "block_number")


_OTHERS = list(securities.OTHERS.values())


@_query(f"WITH {_events(len(_OTHERS))} SELECT {_ID} AS id, {_name(*_OTHERS)} AS kind, t1 || t2 || t3 AS topics, CAST(2 + 7 * 64 AS BIGINT) AS data_length FROM e")
def security_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events that are kept raw."""
    rows = securities.other_events(synth.order_logs(spark, sf, *securities.OTHERS))
    return rows.select("id", "kind", F.array_join(F.slice("topics", 2, 3), "").alias("topics"), F.length("data").cast("bigint").alias("data_length"))


# Pools


@_query(f"WITH {_SWAPS} SELECT id, '115792089237316195423570985008687907853269984665640564039457584007913129' || CAST(639936 - q AS VARCHAR) AS amount0 FROM s")
def decode_swaps_v3_unsigned(spark: SparkSession, sf: str) -> DataFrame:
    """Negative amounts read as unsigned words: 2^256 less the quantity."""
    return amm.swaps_v3(synth.swap_v3_logs(spark, sf), signed=False).select("id", "amount0")


@_query(f"WITH {_SWAPS} SELECT pool, count(*) AS swaps FROM (SELECT pool FROM s UNION ALL SELECT pool FROM s UNION ALL SELECT {TOPIC('l_partkey')} FROM s) GROUP BY 1")
def swaps_of_all_generations(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.swap_v2_logs(spark, sf).unionByName(synth.swap_v3_logs(spark, sf)).unionByName(synth.swap_v4_logs(spark, sf))
    return amm.all_swaps(logs).groupBy("pool").agg(F.count("*").alias("swaps"))


@_query(f"WITH {_SWAPS} SELECT id, pool, CAST(q AS VARCHAR) AS reserve0, CAST(c AS VARCHAR) AS reserve1 FROM s")
def decode_syncs(spark: SparkSession, sf: str) -> DataFrame:
    return amm.syncs(synth.sync_logs(spark, sf)).select("id", "pool", "reserve0", "reserve1")


@_query(f"WITH {_events(2)} SELECT k AS block_number, a1 AS owner, n2 AS tick_lower, n3 AS tick_upper, {ADDRESS('w0')} AS recipient, {_text('w1')} AS amount0, {_text('w2')} AS amount1 FROM e WHERE s = 0")
def decode_collects(spark: SparkSession, sf: str) -> DataFrame:
    return amm.collects(synth.order_logs(spark, sf, t.COLLECT, t.FLASH)).select("block_number", "owner", F.col("tickLower").alias("tick_lower"), F.col("tickUpper").alias("tick_upper"), "recipient", "amount0", "amount1")


@_query(f"WITH {_events(2)} SELECT CAST(sum(w1) AS VARCHAR) AS fees0, CAST(sum(w2) AS VARCHAR) AS fees1, CAST(0 AS BIGINT) AS providers FROM e WHERE s = 0")
def collected_fees(spark: SparkSession, sf: str) -> DataFrame:
    """Fees of a pool that nobody provides liquidity to."""
    logs = synth.order_logs(spark, sf, t.COLLECT, t.FLASH)
    return rollups.pool_extras(amm.collects(logs), amm.mints(logs)).select(F.col("collectedFees0").alias("fees0"), F.col("collectedFees1").alias("fees1"), F.coalesce("liquidityProviderCount", F.lit(0)).cast("bigint").alias("providers"))


@_query(f"WITH {_events(2)} SELECT k AS block_number, a1 AS sender, a2 AS recipient, {_text('w0')} AS amount0, {_text('w1')} AS amount1, {_text('w2')} AS paid0, w3 AS paid1 FROM e WHERE s = 1")
def decode_flashes(spark: SparkSession, sf: str) -> DataFrame:
    return amm.flashes(synth.order_logs(spark, sf, t.COLLECT, t.FLASH)).select("block_number", "sender", "recipient", "amount0", "amount1", "paid0", "paid1")


@_query(f"""WITH {_events(2)} SELECT k AS block_number, CASE s WHEN 0 THEN {ADDRESS(12)} ELSE t1 END AS pool, {_if('1', 'a2')} AS currency0, {_if('1', _text('w0'))} AS fee, {_if('1', 'w1')} AS tick_spacing, {_if('1', ADDRESS('w2'))} AS hooks, CASE s WHEN 0 THEN {_text('w0')} ELSE w3 END AS sqrt_price, CASE s WHEN 0 THEN w1 ELSE w4 END AS tick FROM e""")
def decode_initializations(spark: SparkSession, sf: str) -> DataFrame:
    rows = amm.initializations(synth.order_logs(spark, sf, t.INITIALIZE, t.INITIALIZE_V4))
    return rows.select("block_number", "pool", "currency0", "fee", F.col("tickSpacing").alias("tick_spacing"), "hooks", F.col("sqrtPriceX96").alias("sqrt_price"), "tick")


@_query(f"WITH {_events(3)} SELECT k AS block_number, t1 AS pool, a2 AS sender, w0 AS tick_lower, w1 AS tick_upper, {_text('w2')} AS delta FROM e WHERE s = 0")
def decode_liquidity_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = amm.liquidity_changes(synth.order_logs(spark, sf, t.MODIFY_LIQUIDITY, t.SUBSCRIPTION, t.UNSUBSCRIPTION))
    return rows.select("block_number", "pool", "sender", F.col("tickLower").alias("tick_lower"), F.col("tickUpper").alias("tick_upper"), F.col("liquidityDelta").alias("delta"))


@_query(f"WITH {_events(3)} SELECT k AS block_number, {_name('', 'subscribed', 'unsubscribed')} AS kind, {_text('n1')} AS token_id, a2 AS address FROM e WHERE s > 0")
def decode_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    rows = amm.subscriptions(synth.order_logs(spark, sf, t.MODIFY_LIQUIDITY, t.SUBSCRIPTION, t.UNSUBSCRIPTION))
    return rows.select("block_number", "kind", F.col("tokenId").alias("token_id"), "address")


@_query(f"WITH {_events(1)} SELECT k AS block_number, a1 AS sender, a2 AS receiver, CAST(NULL AS VARCHAR) AS value, {_text('n3')} AS token_id FROM e")
def decode_unique_transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers of four topics: the last is a token's id."""
    return amm.transfers(synth.order_logs(spark, sf, t.TRANSFER)).select("block_number", F.col("from").alias("sender"), F.col("to").alias("receiver"), "value", F.col("tokenId").alias("token_id"))


@_query(f"""WITH {_SWAPS}, x AS (SELECT unnest([t0, t1]) AS t, unnest([q, c]) AS a, unnest([c, q]) AS b, c, ts // 3600 * 3600 AS d, l_orderkey * 100 + l_linenumber AS o FROM tm JOIN pl ON tm.pool = pl.pool), p AS (SELECT *, b::DOUBLE / a::DOUBLE AS price FROM x)
SELECT {ADDRESS('t')} AS token, d AS period, count(*) AS tx_count, CAST(sum(c) AS VARCHAR) AS volume_cents, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS "close" FROM p GROUP BY 1, 2""")
def token_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _period(rollups.token_period(_timed(spark, sf), _pools(spark, sf), rollups.HOUR, "periodStartUnix"), "token", "periodStartUnix")


# Get operators

_SWAP = f"0x{1:064x}#0x2"


@_query(f"""WITH {_SWAPS} SELECT 'token' AS part, {ADDRESS('s_suppkey')} AS id FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT 'pool', pool FROM pl WHERE p_partkey = 5
UNION ALL SELECT 'swap', id FROM u WHERE id = '{_SWAP}' UNION ALL SELECT 'block', CAST(max(o_orderkey) AS VARCHAR) FROM orders""")
def get_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """A token, a pool, a swap and the latest block; an unknown id gives no row."""
    tokens, swaps, blocks = synth.tokens(spark, sf), _swaps(spark, sf), synth.blocks(spark, sf)
    parts = {"token": query.get(tokens, f"0x{3:040x}"), "none": query.get(tokens, "0x"), "pool": query.get(_pools(spark, sf), f"0x{5:040x}"), "swap": query.get(swaps, _SWAP), "block": query.latest_block(blocks).withColumnRenamed("number", "id")}
    return amm.union_all(*[rows.select(F.lit(name).alias("part"), F.col("id").cast("string").alias("id")) for name, rows in parts.items()])


@_query(f"""SELECT 'Validator' AS entity_type, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey = 7
UNION ALL SELECT 'Delegator', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_name = (SELECT s_name FROM supplier WHERE s_suppkey = 2)""")
def get_entities(spark: SparkSession, sf: str) -> DataFrame:
    """By type and id, and by another field of the document."""
    rows = synth.entities(spark, sf)
    by_field = entities.get_by_field(rows, "Delegator", "nodeID", "Supplier#000000002")
    return entities.get_entity(rows, "Validator", "7").unionByName(by_field).select("entity_type", "id")


@_query(f"""SELECT 'factory' AS part, CAST(n_nationkey AS VARCHAR) AS id, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_nationkey = 1
UNION ALL SELECT 'bundle', CAST(r_regionkey AS VARCHAR), CAST(r_regionkey * 100 + 2400 AS VARCHAR) FROM region WHERE r_regionkey = 1
UNION ALL SELECT 'block by number', CAST(o_orderkey AS VARCHAR), CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) FROM orders WHERE o_orderkey = 3
UNION ALL SELECT 'block by hash', CAST(o_orderkey AS VARCHAR), CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) FROM orders WHERE o_orderkey = 4
UNION ALL SELECT 'transaction', {TOPIC('o_orderkey')}, CAST({CENTS('o_totalprice')} AS VARCHAR) FROM orders WHERE o_orderkey = 5""")
def get_chain_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The default factory and bundle, a block by number and by hash, a transaction by hash."""
    blocks, stamp = synth.blocks(spark, sf), F.col("timestamp").cast("string").alias("value")
    number = F.col("number").cast("string").alias("id")
    return amm.union_all(
        query.get_factory(synth.factories(spark, sf)).select(F.lit("factory").alias("part"), "id", F.col("poolCount").cast("string").alias("value")),
        query.get_bundle(synth.bundles(spark, sf)).select(F.lit("bundle").alias("part"), "id", F.col("ethPrice").alias("value")),
        query.get_block(blocks, number=3).select(F.lit("block by number").alias("part"), number, stamp),
        query.get_block(blocks, block_hash=f"0x{4:064x}").select(F.lit("block by hash").alias("part"), number, stamp),
        query.get_transaction(synth.transactions(spark, sf), f"0x{5:064x}").select(F.lit("transaction").alias("part"), F.col("hash").alias("id"), "value"),
    )


@_query(f"SELECT {TOPIC('o_orderkey')} AS hash, CAST(o_orderkey AS BIGINT) AS block_number, {ADDRESS('o_custkey')} AS sender, CAST({CENTS('o_totalprice')} AS VARCHAR) AS value FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def latest_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return query.list_transactions(synth.transactions(spark, sf)).select("hash", "block_number", F.col("from").alias("sender"), "value")


# Domain statistics

_STATS = {name: spec for name, spec in entities.STATISTICS.items() if name != "NetworkStats"}
_TYPES = sorted({kind for spec in _STATS.values() for kind, _, _ in spec.values()})


def _measure(kind: str, measure: str, field: str | None) -> str:
    own = f"FILTER (o_orderkey % {len(_TYPES)} = {_TYPES.index(kind)})"
    value = {"amount": CENTS("o_totalprice"), "uptime": "o_custkey % 101"}.get(field or "")
    return {"count": f"CAST(count(*) {own} AS VARCHAR)", "sum": f"CAST(coalesce(sum({value}) {own}, 0) AS VARCHAR)", "avg": f"CAST(CAST(round(avg({value}) {own} * 1000000) AS BIGINT) AS VARCHAR)"}[measure]


@_query(" UNION ALL ".join(f"SELECT '{stat}' AS stat, '{name}' AS field, {_measure(*m)} AS value FROM orders" for stat, spec in _STATS.items() for name, m in spec.items()))
def domain_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of nine domains, each recomputed over its own entity types; averages in millionths."""
    rows = synth.domain_entities(spark, sf, _TYPES)
    parts = []
    for stat, spec in _STATS.items():
        text = {name: F.round(F.col(name) * 1_000_000).cast("bigint").cast("string") if measure == "avg" else F.col(name).cast("string") for name, (_, measure, _) in spec.items()}
        fields = F.array(*[F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in text.items()])
        parts.append(entities.domain_statistics(rows, stat).select(F.lit(stat).alias("stat"), F.explode(fields).alias("f")).select("stat", "f.field", "f.value"))
    return amm.union_all(*parts)


@_query("SELECT 'BridgeStats' AS entity_type, CAST(2 * count(*) AS VARCHAR) AS total FROM customer")
def stored_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """A statistic that was computed, upserted as the domain's singleton, and read back by its id."""
    rows = synth.table(spark, sf, "customer").select(F.lit("BridgeTransfer").alias("entity_type"), F.col("c_custkey").cast("string").alias("id"), F.lit('{"amount": "2"}').alias("data"), F.lit(0).cast("bigint").alias("block_number"), F.lit(0).cast("bigint").alias("log_order"))
    kept = upsert_entities(rows, as_entities(entities.domain_statistics(rows, "BridgeStats"), "BridgeStats"))
    return entities.get_statistics(kept, "BridgeStats").select("entity_type", F.get_json_object("data", "$.totalVolume").alias("total"))


# Events that other queries read only on the way to something else


@_query(f"""SELECT {TOPIC('l_orderkey')} || '#0x' || format('{{:x}}', l_linenumber) AS id, CASE WHEN l_returnflag = 'R' THEN 'burn' ELSE 'mint' END AS kind, {ADDRESS('l_suppkey')} AS sender, CASE WHEN l_returnflag = 'R' THEN {ADDRESS('l_partkey')} END AS receiver,
CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS amount0, CAST({CENTS('l_extendedprice')} AS VARCHAR) AS amount1 FROM lineitem""")
def decode_liquidity_v2(spark: SparkSession, sf: str) -> DataFrame:
    logs = synth.liquidity_v2_logs(spark, sf)
    mints = amm.mints(logs).select("id", F.lit("mint").alias("kind"), "sender", F.lit(None).cast("string").alias("receiver"), "amount0", "amount1")
    return mints.unionByName(amm.burns(logs).select("id", F.lit("burn").alias("kind"), "sender", F.col("to").alias("receiver"), "amount0", "amount1"))


@_query(f"SELECT CAST(o_orderkey AS BIGINT) AS block_number, {ADDRESS('o_custkey')} AS voter, CAST(o_custkey % 50 AS VARCHAR) AS proposal, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS support, CAST({CENTS('o_totalprice')} AS VARCHAR) AS weight FROM orders")
def decode_votes(spark: SparkSession, sf: str) -> DataFrame:
    return defi.votes(synth.vote_logs(spark, sf)).select("block_number", "voter", "proposal", "support", "weight")


@_query(f"WITH {_events(3)} SELECT {_ID} AS id, {_name('TrustedIssuerAdded', 'TrustedIssuerRemoved', 'ClaimTopicsUpdated')} AS kind, {ADDRESS(12)} AS registry, a1 AS issuer FROM e")
def trusted_issuer_actions(spark: SparkSession, sf: str) -> DataFrame:
    return securities.trusted_issuer_actions(synth.order_logs(spark, sf, *securities.ISSUERS)).select("id", "kind", "registry", "issuer")
