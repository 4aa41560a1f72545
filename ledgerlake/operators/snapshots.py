"""Current state from event history.

Snapshots keep ``log_order`` beside their block, so that a stream can merge them as it merges any table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.hexwords import limb_sums, render
from ledgerlake.operators.upsert import latest_by_key

_ORDER = ("block_number", "log_order")


def _snapshot_id():
    return F.concat_ws(":", "token", "user").alias("id")


def frozen_accounts(actions: DataFrame) -> DataFrame:
    """Per (token, user): the state that the last AddressFrozen left."""
    rows = actions.where("kind = 'AddressFrozen'").select(_snapshot_id(), "token", "user", F.col("isFrozen").alias("frozen"), F.col("block_number").alias("updated"), "log_order")
    return latest_by_key(rows, ("token", "user"), ("updated", "log_order"))


def frozen_tokens(actions: DataFrame) -> DataFrame:
    """Per (token, user): amount and kind of the last freeze or unfreeze; not a running total."""
    rows = actions.where("kind IN ('TokensFrozen', 'TokensUnfrozen')").select(_snapshot_id(), "token", "user", F.col("amount").alias("delta"), "kind", F.col("block_number").alias("updated"), "log_order")
    return latest_by_key(rows, ("token", "user"), ("updated", "log_order"))


def frozen_totals(actions: DataFrame, span: int = 10_000) -> DataFrame:
    """Running total of frozen amounts per (token, user), in log order, exact and as text.

    Totals of every ``span`` blocks come first; sums over those precede each span, and a window runs
    inside a span only. So no task holds a pair's whole history, however long it is.
    """
    names, limbs = ["token", "user", "span"], [f"limb{j}" for j in range(5)]
    rows = actions.where("kind IN ('TokensFrozen', 'TokensUnfrozen')").select("id", "token", "user", "kind", "amount", "block_number", "log_order", F.floor(F.col("block_number") / span).alias("span"), F.expr("IF(kind = 'TokensFrozen', amount, concat('-', amount))").alias("signed"))
    spans = rows.groupBy(*names).agg(*[x.alias(n) for x, n in zip(limb_sums("signed"), limbs, strict=True)])
    earlier = Window.partitionBy("token", "user").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.select(*[F.col(n).alias(f"at_{n}") for n in names], *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast("decimal(38,0)").alias(n) for n in limbs])
    inside = limb_sums("signed", "PARTITION BY token, user, span ORDER BY block_number, log_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    within = rows.withColumns({f"in_{n}": x for n, x in zip(limbs, inside, strict=True)})
    total = render("array(" + ", ".join(f"CAST({n} + in_{n} AS DECIMAL(38,0))" for n in limbs) + ")")
    here = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"at_{n}")) for n in names])
    return within.join(before, here).select("id", "token", "user", "kind", "amount", "block_number", "log_order", F.expr(total).alias("total"))


def live(events: DataFrame, keys: tuple[str, ...], gone: tuple[str, ...]) -> DataFrame:
    """The last event of every key, unless its kind says that the thing is gone."""
    rows = events.where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
    return latest_by_key(rows, keys, _ORDER).where(~F.col("kind").isin(*gone))


def paused_tokens(actions: DataFrame) -> DataFrame:
    return live(actions.where("kind IN ('Paused', 'Unpaused')").select("token", "kind", *_ORDER), ("token",), ("Unpaused",))


def live_claims(claims: DataFrame) -> DataFrame:
    return live(claims, ("identity", "claimId"), ("ClaimRemoved",))


def live_keys(keys: DataFrame) -> DataFrame:
    return live(keys, ("identity", "key"), ("KeyRemoved",))


def live_issuers(actions: DataFrame) -> DataFrame:
    return live(actions.where("issuer IS NOT NULL"), ("registry", "issuer"), ("TrustedIssuerRemoved",))


def live_modules(actions: DataFrame) -> DataFrame:
    return live(actions.where("kind IN ('ModuleAdded', 'ModuleRemoved') AND target IS NOT NULL"), ("compliance", "target"), ("ModuleRemoved",))


def voting_power(changes: DataFrame) -> DataFrame:
    """The latest balance of every delegate."""
    return latest_by_key(changes.select("contract", "delegate", F.col("newBalance").alias("balance"), *_ORDER), ("contract", "delegate"))


def delegations(changes: DataFrame) -> DataFrame:
    """Whom every delegator delegates to now."""
    return latest_by_key(changes.select("contract", "delegator", "toDelegate", *_ORDER), ("contract", "delegator"))


def top_per_group(rows: DataFrame, group: str, by: str, k: int, tie: str = "id") -> DataFrame:
    """The ``k`` rows of largest ``by`` in every group, with their rank; ties by ``tie``."""
    w = Window.partitionBy(group).orderBy(F.desc(by), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
