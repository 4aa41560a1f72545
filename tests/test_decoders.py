"""Decoders on hand-built logs: fixtures with exact fields, and what the fixtures leave out."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake import topics as t
from ledgerlake.decode import amm, defi, securities
from ledgerlake.functions import hexwords as hx
from ledgerlake.operators import enrich, entities, query, rollups, snapshots
from ledgerlake.operators.upsert import as_entities, latest_by_key, read_entities, upsert, upsert_entities, upsert_stored_entities, write_entities
from ledgerlake.sources import logs as lg

A, B, C = ("0x" + c * 40 for c in "abc")


def w(x):
    return f"{x % 2**256:064x}"


def top(x):
    return "0x" + (w(x) if isinstance(x, int) else x.removeprefix("0x").rjust(64, "0"))


def make(spark, *logs):
    """logs: (address, topics, words, block, index)"""
    rows = [(a, list(ts), "0x" + "".join(ws), hex(b), f"0xt{k}", i, "0x0") for k, (a, ts, ws, b, i) in enumerate(logs)]
    return lg.normalise(spark.createDataFrame(rows, schemas.RAW_LOG))


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_hex_numbers(spark):
    texts = ["0x0", "0x1", "0xa", "0xff", "0x10932c", "", "xyz", None, "0x" + "f" * 16, "0x" + "1" * 17]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k").select(hx.hex_number(F.col("x"))).collect()]
    assert got == [0, 1, 10, 255, 1086252, 0, 0, 0, 0, 0]


def test_words_and_addresses(spark):
    df = spark.createDataFrame([("0x" + w(100) + w(200), "0x" + "0" * 24 + "ab" * 20, "short", "")], "d string, a string, s string, e string")
    df = df.withColumns({f"w{i}": hx.word(F.col("d"), i) for i in (0, 1, 5)})
    df = hx.with_digits(df, {f"u{i}": f"w{i}" for i in (0, 1, 5)})
    r = df.select("u0", "u1", "u5", hx.topic_address(F.col("a")), hx.topic_address(F.col("s")), hx.topic_address(F.col("e")), hx.address_word(F.col("d"), 7), hx.address_word(F.col("d"), 7, "", False)).first()
    assert tuple(r) == ("100", "200", "0", "0x" + "ab" * 20, "short", "", hx.ZERO_ADDRESS, "")


def test_256_bits_against_python(spark):
    rng = random.Random(4)
    values = [0, 1, 2**64 - 1, 2**64, 2**124 - 1, 2**124, 10**18, 10**36, 10**54 - 1, 2**255 - 1, 2**255, 2**256 - 1] + [rng.getrandbits(rng.randrange(1, 257)) for _ in range(200)]
    other = values[1:] + values[:1]
    df = spark.createDataFrame([(k, w(a), w(b)) for k, (a, b) in enumerate(zip(values, other, strict=True))], "k int, a string, b string")
    df = hx.with_digits(df, {"ua": "a", "ub": "b"}, {"sa": "a"})
    rows = df.orderBy("k").select("ua", "sa", hx.net_uint256("a", "b", "ua", "ub"), hx.int_small("a"), hx.uint_k("a", 8), hx.word_hex("a"), hx.word_bool("a")).collect()
    for r, a, b in zip(rows, values, other, strict=True):
        signed = a - 2**256 if a >= 2**255 else a
        small = signed if -(2**63) <= signed < 2**63 else None
        assert tuple(r) == (str(a), str(signed), str(a - b), small, a % 256 if a < 2**64 else 0, hex(a), a > 0)
    assert [r[0] for r in hx.with_digits(df.select("k", "a"), {"x": "a"}, small_path=False).orderBy("k").select("x").collect()] == [str(a) for a in values]
    assert df.agg(hx.sum_digits("ua")).first()[0] == str(sum(values))
    whole = [a - 2**256 if a >= 2**255 else a for a in values]
    assert df.agg(hx.sum_digits("sa")).first()[0] == str(sum(whole))
    assert df.where("k < 0").agg(hx.sum_digits("sa")).first()[0] == "0"
    for n in range(1, len(values), 7):
        assert df.where(f"k < {n}").agg(hx.sum_digits("IF(k % 2 = 0, ua, concat('-', ub))")).first()[0] == str(sum(a if k % 2 == 0 else -b for k, (a, b) in enumerate(zip(values[:n], other[:n], strict=True))))


def test_digits_are_computed_in_generated_code(spark):
    logs = make(spark, (A, [t.SWAP_V2, top(B)], [w(2**255), w(0), w(0), w(2**200)], 7, "0x1"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its generated spans when it has run
    try:
        plan = amm.swaps_v2(logs.repartition(2))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    projects = [line for line in plan.splitlines() if "Project [" in line]
    assert projects and all("*(" in line.split("Project [")[0] for line in projects)
    assert "lambdafunction" not in plan


def test_fractions(spark):
    texts = ["10.5", "-3", "x", None, "1e3", "0.0000000000000000019", ".5", "+2.", "9" * 60, "-" + "9" * 60 + ".25"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").withColumn("d", hx.fixed_point("x"))
    assert df.agg(hx.sum_digits("d").alias("s")).select(hx.with_point("s")).first()[0] == "1009.750000000000000001"
    assert df.where("x = '-3'").agg(hx.sum_digits("d").alias("s")).select(hx.with_point("s")).first()[0] == "-3"
    assert df.where("x = '.5'").agg(hx.sum_digits("d").alias("s")).select(hx.with_point("s")).first()[0] == "0.5"


def test_swaps_with_signs(spark):
    logs = make(spark, (A, [t.SWAP_V2, top(B)], [w(5), w(0), w(0), w(2**200)], 7, "0x1"), (A, [t.SWAP_V2], [w(0), w(9), w(3), w(0)], 8, "0x9"), (C, [t.SWAP_V3, top(B)], [w(-5), w(2**130)], 9, "0x10"))
    two = {r["timestamp"]: r for r in amm.swaps_v2(logs).collect()}
    assert (two[7]["amount0"], two[7]["amount1"], two[7]["sender"], two[7]["pool"], two[7]["id"]) == ("5", str(-(2**200)), B, A, "0xt0#0x1")
    assert (two[8]["amount0"], two[8]["amount1"], two[8]["sender"]) == ("-3", "9", "")
    three = one(amm.swaps_v3(logs))
    assert (three["amount0"], three["amount1"]) == ("-5", str(2**130))
    assert one(amm.swaps_v3(logs, signed=False))["amount0"] == str(2**256 - 5)
    assert amm.all_swaps(logs).count() == 3


def test_pools_tokens_transfers(spark):
    logs = make(spark, (A, [t.PAIR_CREATED, top(B), top(C)], [top(A)[2:], w(1)], 1, "0x0"), (A, [t.PAIR_CREATED, top(B), top(C)], [], 1, "0x1"), (A, [t.POOL_CREATED, top(B), top(C), top(500)], [w(60), top(B)[2:]], 2, "0x0"), (C, [t.TRANSFER, top(A), top(B)], [w(12)], 3, "0x0"), (C, [t.TRANSFER, top(A), top(B), top(77)], [], 3, "0x1"))
    assert sorted((r["id"], r["feeTier"]) for r in amm.pools(logs).collect()) == [(A, 3000), (B, 500)]
    short = make(spark, *[(A, [t.POOL_CREATED, top(B), top(C), top(500)], data, 2, "0x0") for data in ([], ["ab" * 20], [w(60)[:63]], [w(60)])])
    assert [r["id"] for r in amm.pools(short).collect()] == ["0x" + w(60)[-40:]]
    assert {r["id"] for r in amm.tokens(logs).collect()} == {B, C}
    assert sorted((r["value"] or "", r["tokenId"] or "") for r in amm.transfers(logs).collect()) == [("", "77"), ("12", "")]


def test_liquidity_events(spark):
    logs = make(spark, (A, [t.MINT_V2, top(B)], [w(1), w(2)], 1, "0x0"), (A, [t.BURN_V2, top(B), top(C)], [w(3), w(4)], 1, "0x1"), (A, [t.COLLECT, top(B), top(-60), top(60)], [top(C)[2:], w(5), w(6)], 1, "0x2"), (A, [t.FLASH, top(B), top(C)], [w(1), w(2), w(3), w(4)], 1, "0x3"), (A, [t.INITIALIZE], [w(2**96), w(-7)], 1, "0x4"), (A, [t.INITIALIZE_V4, top(5), top(B), top(C)], [w(3000), w(60), top(A)[2:], w(9), w(-1)], 1, "0x5"), (A, [t.MODIFY_LIQUIDITY, top(5), top(B)], [w(-60), w(60), w(-1000), w(1)], 1, "0x6"), (A, [t.SUBSCRIPTION, top(4), top(B)], [], 1, "0x7"), (A, [t.SYNC], [w(8), w(9)], 1, "0x8"))
    assert one(amm.mints(logs))["amount1"] == "2" and one(amm.burns(logs))["to"] == C
    assert (one(amm.collects(logs))["tickLower"], one(amm.collects(logs))["recipient"]) == (-60, C)
    assert one(amm.flashes(logs))["paid1"] == "4" and one(amm.syncs(logs))["reserve1"] == "9"
    assert sorted((r["tick"], r["hooks"]) for r in amm.initializations(logs).collect()) == [(-7, None), (-1, A)]
    assert one(amm.liquidity_changes(logs))["liquidityDelta"] == "-1000" and one(amm.subscriptions(logs))["tokenId"] == "4"


def test_securities(spark):
    logs = make(
        spark,
        (A, [t.ADDRESS_FROZEN, top(B), top(1), top(C)], [], 1, "0x9"),
        (A, [t.ADDRESS_FROZEN, top(B), top(0), top(C)], [], 1, "0x10"),
        (A, [t.TOKENS_FROZEN, top(B)], [w(5)], 2, "0x0"),
        (A, [t.TOKENS_UNFROZEN, top(B)], [w(2)], 3, "0x0"),
        (A, [t.PAUSED], [top(B)[2:]], 4, "0x0"),
        (A, [t.RECOVERY_SUCCESS, top(A), top(B), top(C)], [], 5, "0x0"),
        (A, [t.ADDRESS_FROZEN, top(B)], [], 6, "0x0"),
        (A, [t.CLAIM_ADDED, top(7), top(3), top(C)], [w(1)], 7, "0x0"),
        (A, [t.CLAIM_REMOVED, top(7), top(3), top(C)], [w(1)], 8, "0x0"),
        (A, [t.CLAIM_ADDED, top(8), top(3), top(C)], [w(1)], 8, "0x1"),
        (A, [t.KEY_ADDED, top(9), top(1), top(2)], [], 9, "0x0"),
        (A, [t.TRUSTED_ISSUER_ADDED, top(B)], [w(1)], 9, "0x1"),
        (A, [t.CLAIM_TOPICS_UPDATED], [w(1)], 9, "0x2"),
        (A, [t.CLAIM_TOPIC_ADDED, top(44)], [], 9, "0x3"),
        (A, [t.MODULE_ADDED, top(B)], [w(1)], 9, "0x4"),
        (A, [t.IDENTITY_STORED, top(B)], [], 9, "0x5"),
        (A, [t.ONCHAIN_ID_EXECUTED, top(1), top(B), top(0)], [w(1)], 9, "0x6"),
    )
    actions = securities.transfer_agent_actions(logs)
    assert actions.count() == 6
    by = {(r["kind"], r["isFrozen"]): r for r in actions.collect()}
    assert by["AddressFrozen", True]["owner"] == C and by["Paused", None]["user"] == B and by["RecoverySuccess", None]["newWallet"] == B
    assert one(snapshots.frozen_accounts(actions))["frozen"] is False  # index 0x10 comes after 0x9
    assert one(snapshots.frozen_tokens(actions)) == {"id": f"{A}:{B}", "token": A, "user": B, "delta": "2", "kind": "TokensUnfrozen", "updated": 3, "log_order": 0}
    assert [int(r["total"]) for r in snapshots.frozen_totals(actions).orderBy("block_number").collect()] == [5, 3]
    assert one(snapshots.paused_tokens(actions))["token"] == A
    assert one(snapshots.live_claims(securities.claims(logs)))["claimId"] == top(8)
    assert one(snapshots.live_keys(securities.keys(logs)))["purpose"] == "1"
    assert one(snapshots.live_issuers(securities.trusted_issuer_actions(logs)))["issuer"] == B
    assert one(snapshots.live_modules(securities.compliance_actions(logs)))["target"] == B
    assert one(securities.claim_topic_actions(logs))["topic"] == "44"
    assert one(securities.identity_registry_actions(logs))["topic1"] == top(B)
    assert one(securities.other_events(logs))["topics"][1] == top(1)


def test_governance(spark):
    logs = make(spark, (A, [t.PROPOSAL_CREATED], [w(7), top("0x" + "aa" * 20)[2:], w(0), w(0), w(0), w(100), w(200)], 50, "0x0"), (A, [t.PROPOSAL_QUEUED], [w(7), w(0x65B8D800)], 51, "0x0"), (A, [t.VOTE_CAST, top(B)], [w(7), w(1), w(10**21)], 52, "0x0"), (A, [t.VOTE_CAST], [w(7), w(1), w(1)], 52, "0x1"), (A, [t.DELEGATE_CHANGED, top(A), top(B), top(C)], [], 53, "0x0"), (A, [t.DELEGATE_VOTES_CHANGED, top(B)], [w(1000), w(2000)], 54, "0x0"), (A, [t.GUARDIAN_UPDATED], [top(B)[2:], top(C)[2:]], 55, "0x0"))
    created = one(defi.proposals(logs).where("event = 'created'"))
    assert (created["proposal"], created["proposer"], created["startBlock"], created["endBlock"]) == ("7", "0x" + "aa" * 20, "100", "200")
    vote = one(defi.votes(logs))
    assert (vote["proposal"], vote["support"], vote["weight"]) == ("7", 1, "1" + "0" * 21)
    tally = one(rollups.proposal_tally(defi.votes(logs), defi.proposals(logs)))
    assert (tally["status"], tally["forVotes"], tally["againstVotes"]) == ("queued", str(10**21), "0")
    assert one(snapshots.delegations(defi.delegate_changes(logs)))["toDelegate"] == C
    assert one(snapshots.voting_power(defi.delegate_votes_changes(logs)))["balance"] == "2000"
    assert one(defi.guardian_updates(logs))["newGuardian"] == C


def test_dao_treasury_liquid(spark):
    logs = make(
        spark,
        (A, [t.GAUGE_ADDED, top(1)], [top(B)[2:]], 1, "0x0"),
        (A, [t.GAUGE_VOTE_CAST, top(B), top(2)], [w(2000)], 1, "0x1"),
        (A, [t.LOCK_DEPOSIT, top(B), top(99)], [w(10**21)], 1, "0x2"),
        (A, [t.LOCK_WITHDRAW, top(B)], [w(10**20)], 1, "0x3"),
        (A, [t.KARMA_MINTED, top(B)], [w(10), w(0xAB)], 1, "0x4"),
        (A, [t.KARMA_DECAYED, top(B)], [w(4), w(1)], 1, "0x5"),
        (A, [t.STAKED, top(B)], [w(5), w(2), w(77)], 1, "0x6"),
        (A, [t.REBASED], [w(3), w(8), w(9)], 1, "0x7"),
        (A, [t.VAULT_RECEIVE, top(6)], [w(50), w(0xCD)], 1, "0x8"),
        (A, [t.VAULT_FLUSH, top(6)], [w(20)], 1, "0x9"),
        (A, [t.FEE_GOV_RATE], [w(30), w(5)], 1, "0xa"),
        (A, [t.FEE_GOV_CHAIN, top(6)], [w(1)], 1, "0xb"),
        (A, [t.FEE_GOV_BROADCAST], [w(3), w(5)], 1, "0xc"),
        (A, [t.ROUTER_WEIGHT, top(B)], [w(30)], 1, "0xd"),
        (A, [t.ROUTER_WEIGHT, top(C)], [w(10)], 1, "0xe"),
        (A, [t.ROUTER_CLAIM, top(B)], [w(4)], 1, "0xf"),
        (A, [t.FEES_RECEIVED, top(B), top(1)], [w(10**21), w(10**20), w(10**19)], 1, "0x10"),
        (A, [t.FEES_RECEIVED, top(B)], [w(1)], 1, "0x11"),
        (A, [t.SLASHING_APPLIED], [w(9), w(2), w(7)], 1, "0x12"),
    )
    gauges = {r["event"]: r for r in defi.gauges(logs).collect()}
    assert (gauges["added"]["gaugeId"], gauges["added"]["recipient"], gauges["vote"]["weight"]) == ("1", B, "2000")
    assert one(rollups.locked_balances(defi.vote_locks(logs)))["balance"] == str(9 * 10**20)
    assert one(rollups.karma_balances(defi.karma(logs)))["balance"] == "6"
    stakes = {r["event"]: r for r in defi.stakes(logs).collect()}
    assert (stakes["staked"]["tier"], stakes["staked"]["lockEnd"], stakes["rebased"]["amount"]) == (2, "77", "8")
    assert one(rollups.treasury_flows(defi.vaults(logs)))["net"] == "30"
    fees = {r["event"]: r for r in defi.fee_governance(logs).collect()}
    assert (fees["rate"]["rate"], fees["rate"]["version"], fees["chain"]["active"], fees["broadcast"]["count"]) == (30, 5, True, "5")
    shares = {r["recipient"]: (r["share"], int(r["claimed"])) for r in rollups.router_shares(defi.routers(logs)).collect()}
    assert shares == {B: (0.75, 4), C: (0.25, 0)}
    totals = {r["feeType"]: r for r in rollups.liquid_totals(defi.liquid(logs)).collect()}
    assert totals[top(1)]["perfFee"] == str(10**20) and totals[None]["socialized"] == "7"
    parsed = defi.parse_all(logs)
    assert len(parsed) == 12 and parsed["GovernanceVote"].count() == 0


def test_sums_over_the_whole_range(spark):
    """Amounts up to 2^256 - 1 are counted in full, in totals, differences and running totals."""
    big, mid = 2**256 - 1, 2**128 - 1
    stakes = make(spark, (A, [t.STAKED, top(B)], [w(5), w(0), w(0)], 1, "0x0"), (A, [t.STAKED, top(B)], [w(big), w(0), w(0)], 2, "0x0"), (A, [t.UNSTAKED, top(B)], [w(mid)], 3, "0x0"), (A, [t.UNSTAKED, top(C)], [w(big)], 3, "0x1"))
    assert {r["account"]: r["balance"] for r in rollups.stake_balances(defi.stakes(stakes)).collect()} == {B: str(5 + big - mid), C: str(-big)}
    vaults = make(spark, (A, [t.VAULT_RECEIVE, top(6)], [w(mid), w(0)], 1, "0x0"), (A, [t.VAULT_RECEIVE, top(6)], [w(big), w(0)], 1, "0x1"), (A, [t.VAULT_FLUSH, top(6)], [w(big)], 2, "0x0"), (A, [t.VAULT_FLUSH, top(6)], [w(big)], 2, "0x1"))
    flows = one(rollups.treasury_flows(defi.vaults(vaults)))
    assert (flows["received"], flows["flushed"], flows["net"]) == (str(mid + big), str(2 * big), str(mid - big))
    routers = make(spark, (A, [t.ROUTER_WEIGHT, top(B)], [w(big)], 1, "0x0"), (A, [t.ROUTER_WEIGHT, top(C)], [w(big)], 1, "0x1"), (A, [t.ROUTER_CLAIM, top(B)], [w(big)], 2, "0x0"))
    assert sorted((r["weight"], r["claimed"], r["share"]) for r in rollups.router_shares(defi.routers(routers)).collect()) == [(str(big), "0", 0.5), (str(big), str(big), 0.5)]
    fees = make(spark, *[(A, [t.FEES_RECEIVED, top(B), top(1)], [w(big), w(mid), w(0)], 1, f"0x{k}") for k in range(3)])
    assert (one(rollups.liquid_totals(defi.liquid(fees)))["fees"], one(rollups.liquid_totals(defi.liquid(fees)))["perfFee"]) == (str(3 * big), str(3 * mid))
    ticks = make(spark, (A, [t.MINT_V3, top(B), top(-60), top(60)], [w(0), w(big), w(1), w(1)], 1, "0x0"), (A, [t.MINT_V3, top(B), top(60), top(120)], [w(0), w(3), w(1), w(1)], 1, "0x1"), (A, [t.BURN_V3, top(B), top(-60), top(60)], [w(mid), w(1), w(1)], 2, "0x0"))
    got = {r["tick"]: (r["liquidityGross"], r["liquidityNet"]) for r in rollups.tick_liquidity(amm.mints(ticks), amm.burns(ticks)).collect()}
    assert got == {-60: (str(big + mid), str(big - mid)), 60: (str(big + mid + 3), str(mid - big + 3)), 120: ("3", "-3")}
    amounts = [(t.TOKENS_FROZEN, big, 1), (t.TOKENS_UNFROZEN, mid, 5), (t.TOKENS_UNFROZEN, big, 12), (t.TOKENS_FROZEN, 7, 13), (t.TOKENS_FROZEN, big, 40)]
    actions = securities.transfer_agent_actions(make(spark, *[(A, [s, top(B)], [w(x)], b, "0x0") for s, x, b in amounts]))
    for span in (1, 10, 10_000):
        assert [r["total"] for r in snapshots.frozen_totals(actions, span).orderBy("block_number").collect()] == [str(x) for x in (big, big - mid, -mid, 7 - mid, big + 7 - mid)]


def test_values_in_usd_keep_eighteen_places(spark):
    swaps = spark.createDataFrame([("a", "p", 1, 1, "2", "4", "0.0000004", 0), ("b", "p", 1, 2, "2", "4", "-0.000000000000000001", 0), ("c", "p", 1, 3, "2", "4", "n/a", 0)], "id string, pool string, block_number long, log_order long, amount0 string, amount1 string, amountUSD string, timestamp long")
    pools = spark.createDataFrame([("p", 3000)], "id string, feeTier long")
    assert f"{one(rollups.pool_totals(swaps, pools))['volumeUSD']:f}" == "0.000000400000000001"
    assert str(one(rollups.pool_totals(swaps.withColumn("amountUSD", F.lit("2.5")), pools))["feesUSD"]).rstrip("0") == "0.0225"
    assert one(rollups.pool_totals(swaps, pools.withColumn("feeTier", F.lit(2**62))))["feesUSD"] is None
    assert one(rollups.pool_totals(swaps.withColumn("amountUSD", F.lit("9" * 25)), pools))["volumeUSD"] is None


def test_logs_stored_by_signature_are_pruned(spark, tmp_path):
    logs = make(spark, (A, [t.STAKED, top(B)], [w(5), w(0), w(0)], 1, "0x0"), (A, [t.VOTE_CAST, top(B)], [w(7), w(1), w(3)], 9000, "0x0"), (A, [t.VOTE_CAST, top(C)], [w(7), w(0), w(4)], 1, "0x0"))
    lg.write_logs(logs, str(tmp_path / "logs"))
    stored = lg.read_stored(spark, str(tmp_path / "logs"))
    parsed = defi.parse_all(stored)
    assert {n: rows.count() for n, rows in parsed.items() if rows.count()} == {"GovernanceVote": 2, "StakeEvent": 1}
    late = parsed["GovernanceVote"].where("block_number > 0")
    assert "PartitionFilters: [topic0" in late._jdf.queryExecution().executedPlan().toString() or "isnotnull(topic0" in late._jdf.queryExecution().executedPlan().toString()
    assert len(lg.known_events(stored, [t.STAKED]).inputFiles()) <= len(stored.inputFiles())


def test_where_and_order(spark):
    rows = spark.createDataFrame([("a", "100", "50.5", "9.0", "A"), ("b", "200", "150.0", "100000.0", "A"), ("c", "300", "200.0", "50.0", "B"), ("d", None, "1d", "x", "B"), ("e", "1", " 7", "NaN", None)], "id string, date string, amount string, volumeUSD string, pool string")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(query.where(rows, {"pool": "A"})) == ["a", "b"]
    assert ids(query.where(rows, {"date_gte": "200"})) == ["b", "c"]
    assert ids(query.where(rows, {"date": "100.0"})) == ["a"]
    assert ids(query.where(rows, {"amount_lt": "100"}))[0] == "a"
    assert ids(query.where(rows, {"unknown": "x"})) == [] and len(ids(query.where(rows, {}))) == 5
    assert ids(query.where(rows, {"pool_not": "A"})) == []
    assert ids(query.order_by(rows.where("pool IS NOT NULL AND id <> 'd'"), "volumeUSD", "DESC")) == ["b", "c", "a"]
    assert ids(query.order_by(rows, "volumeUSD"))[:3] == ["a", "c", "b"]
    assert ids(query.order_by(rows, "missing")) == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize(("first", "n"), [(None, 100), (50, 50), (0, 1), (-5, 1), (5000, 1000), ("7", 7), ("x", 100), (2.9, 2), (float("inf"), 100), (float("nan"), 100), ("2.9", 2), ("1_000", 1), ("7abc", 7), (" +8", 8), ("-3x", 1), ("9" * 30, 100), (True, 100), ("", 100)])
def test_clamp(first, n):
    assert query.clamp(first) == n


def test_steps():
    assert lg.next_step(10, 10) is None
    assert lg.next_step(0, 10_000) == (1, 2001) and lg.next_step(0, 500) == (1, 500)


def test_upsert_is_idempotent_and_orders_hex(spark):
    rows = spark.createDataFrame([("k", "old", 5, 9), ("k", "new", 5, 16), ("j", "x", 1, 1)], "id string, v string, block_number long, log_order long")
    once = upsert(None, rows)
    again = upsert(upsert(once, rows), rows)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [("j", "x", 1, 1), ("k", "new", 5, 16)]
    assert latest_by_key(rows.orderBy(F.rand(1)), ("id",)).where("id = 'k'").first()["v"] == "new"


def test_enrichment_of_unknown_pools(spark):
    tokens = spark.createDataFrame([("t0", "S0", "N0", 18)], "id string, symbol string, name string, decimals long")
    pools = spark.createDataFrame([("p", "t0", "t9", 500)], "id string, token0 string, token1 string, feeTier long")
    swaps = spark.createDataFrame([("s1", "p"), ("s2", "nope")], "id string, pool string")
    got = {r["id"]: r for r in enrich.with_pools(swaps, pools, tokens).collect()}
    assert got["s1"]["pool"]["token0"]["symbol"] == "S0" and got["s1"]["pool"]["token1"] is None
    assert got["s2"]["pool"] is None and got["s2"]["pool_id"] == "nope"


def test_entities(spark, tmp_path):
    docs = spark.createDataFrame([("1", "10.5"), ("2", "x"), ("3", "9" * 50)], "id string, stake string")
    rows = as_entities(docs, "Validator").unionByName(as_entities(docs, "Delegator"))
    write_entities(upsert_entities(rows, rows), str(tmp_path / "e"))
    back = read_entities(spark, str(tmp_path / "e"))
    assert entities.list_entities(back, "Validator", 1).count() == 1
    assert entities.get_entity(back, "Validator", "2").count() == 1
    assert entities.get_statistics(back, "NetworkStats").count() == 0
    assert one(entities.domain_statistics(back, "NetworkStats")) == {"id": "1", "totalStake": "1" + "0" * 48 + "09.5", "validatorCount": 3, "delegatorCount": 3}
    assert entities.get_by_field(back, "Validator", "stake", "10.5").count() == 1
    assert entities.as_variant(back).count() == 6


def test_upsert_of_stored_entities_leaves_other_types(spark, tmp_path):
    path = str(tmp_path / "e")
    kind = "entity_type string, id string, data string, block_number long, log_order long"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    upsert_stored_entities(rows(("A", "1", "a1", 1, 0), ("A", "2", "a2", 1, 0), ("B", "1", "b1", 1, 0)), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "e").rglob("entity_type=B/*.parquet")}
    upsert_stored_entities(rows(("A", "2", "new", 5, 0), ("A", "1", "older", 0, 0), ("C d/e", "1", "c1", 1, 0)), path)
    want = [("A", "1", "a1"), ("A", "2", "new"), ("B", "1", "b1"), ("C d/e", "1", "c1")]
    got = lambda: sorted((r["entity_type"], r["id"], r["data"]) for r in read_entities(spark, path).collect())
    assert got() == want and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "e").rglob("entity_type=B/*.parquet")}
    upsert_stored_entities(rows(), path)
    # a merge that was complete when the driver went is put in place by the next one
    rows(("B", "1", "cut", 9, 0)).write.partitionBy("entity_type").parquet(f"{path}/_staged")
    upsert_stored_entities(rows(("A", "2", "new", 5, 0)), path)
    assert got() == [x if x[0] != "B" else ("B", "1", "cut") for x in want]


def test_values_of_tiny_prices_and_wide_amounts(spark):
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    cases = [("1" + "0" * 24, 18, "0.000000000000123", "2500"), ("-" + "9" * 41, 30, "0.25", "2500.5"), ("1", 0, "0.000000000000000001", "0.5"), ("1", 18, "1", "1"), ("5", 7, "1", "1"), ("9" * 78, 78, "99999999999999999999.999999999999999999", "2"), ("9" * 78, 0, "1", "1"), ("0", 6, "3", "4"), ("7", 0, "0", "4"), ("12345", 2, "1.5", "2500")]
    swaps = spark.createDataFrame([(f"s{k}", f"p{k}", c[0]) for k, c in enumerate(cases)] + [("none", "px", "5"), ("null", "p0", None)], "id string, pool string, amount0 string")
    pools = spark.createDataFrame([(f"p{k}", f"t{k}") for k in range(len(cases))], "id string, token0 string")
    tokens = spark.createDataFrame([(f"t{k}", c[1], c[2]) for k, c in enumerate(cases)], "id string, decimals long, derivedETH string")
    for usd in {c[3] for c in cases}:
        got = {r["id"]: r["amountUSD"] for r in enrich.value_in_usd(swaps, pools, tokens, spark.createDataFrame([("1", usd)], "id string, ethPriceUSD string")).collect()}
        with localcontext(prec=200):
            for k, (amount, decimals, eth, _) in enumerate(cases):
                value = (abs(Decimal(amount)) / Decimal(10) ** decimals * Decimal(eth) * Decimal(usd)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
                assert got[f"s{k}"] == (f"{value:f}" if value < 10**31 else None), (k, usd)
        assert got["none"] is None and got["null"] is None


def test_a_value_that_no_total_holds_stops_no_rollup(spark):
    swaps = [("a", "p", "1", "1", "5.5", 0), ("b", "p", "1", "1", "9" * 40, 0), ("c", "q", "1", "1", "2.25", 0), ("d", "q", "1", "1", "junk", 0), ("e", "r", "1", "1", "junk", 0), *[(f"f{k}", "s", "1", "1", "9" * 20, 0) for k in range(3)]]
    table = spark.createDataFrame([(*r, 0, 0) for r in swaps], "id string, pool string, amount0 string, amount1 string, amountUSD string, timestamp long, block_number long, log_order long")
    pools = spark.createDataFrame([(p, f"x{p}", f"y{p}", 3000) for p in "pqrs"], "id string, token0 string, token1 string, feeTier long")
    totals = rollups.pool_totals(table, pools)
    got = {r["id"]: (r["txCount"], r["volumeUSD"] is not None and float(r["volumeUSD"]), r["feesUSD"] is None) for r in totals.collect()}
    assert got == {"p": (2, False, True), "q": (2, 2.25, False), "r": (1, 0.0, False), "s": (3, False, True)}
    days = {r["pool"]: r["volumeUSD"] for r in rollups.pool_period(table, pools).collect()}
    assert days["p"] is None and float(days["q"]) == 2.25
    locked = pools.withColumn("totalValueLockedUSD", F.when(F.col("id") == "p", "8" * 30).otherwise("1"))
    whole = one(rollups.factory_totals(locked, totals))
    assert whole["totalVolumeUSD"] is None and whole["totalValueLockedUSD"] is None and whole["txCount"] == 8
    assert one(rollups.factory_period(rollups.pool_period(table.where("pool = 'q'"), pools)))["volumeUSD"] is not None


def test_blocks_transactions_and_lists(spark):
    blocks = spark.createDataFrame([(k, 10 * k, f"0x{k}") for k in range(40)], "number long, timestamp long, hash string")
    assert query.list_blocks(blocks).count() == 25 and query.list_blocks(blocks, 3).first()["number"] == 39
    assert one(query.get_block(blocks, number=0))["hash"] == "0x0" and one(query.get_block(blocks, block_hash="0x7"))["number"] == 7
    assert query.get_block(blocks, block_hash="0x99").count() == 0
    txs = spark.createDataFrame([(f"0x{k}", k // 2, "a", "1") for k in range(40)], "hash string, block_number long, from string, value string")
    assert [r["hash"] for r in query.list_transactions(txs, 2).collect()] == ["0x38", "0x39"] and query.list_transactions(txs).count() == 25
    assert one(query.get_transaction(txs, "0x5"))["block_number"] == 2
    many = spark.createDataFrame([(str(k),) for k in range(1500)], "id string")
    assert query.list_all(many).count() == 1500
