"""Security-token events: transfer agent, identities, claims, keys, issuers, compliance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import topics as t
from ledgerlake.decode.base import address, by_kind, enough, entity_id, only, take, topic, topic_uint, uint, where_event, word_address
from ledgerlake.functions import hexwords as hx

FREEZES = {t.TOKENS_FROZEN: "TokensFrozen", t.TOKENS_UNFROZEN: "TokensUnfrozen"}
PAUSES = {t.PAUSED: "Paused", t.UNPAUSED: "Unpaused"}
IDENTITIES = {t.IDENTITY_REGISTERED: "IdentityRegistered", t.IDENTITY_REMOVED: "IdentityRemoved", t.IDENTITY_UPDATED: "IdentityUpdated", t.IDENTITY_STORED: "IdentityStored", t.COUNTRY_UPDATED: "CountryUpdated"}
CLAIMS = {t.CLAIM_ADDED: "ClaimAdded", t.CLAIM_REMOVED: "ClaimRemoved", t.CLAIM_CHANGED: "ClaimChanged"}
KEYS = {t.KEY_ADDED: "KeyAdded", t.KEY_REMOVED: "KeyRemoved"}
ISSUERS = {t.TRUSTED_ISSUER_ADDED: "TrustedIssuerAdded", t.TRUSTED_ISSUER_REMOVED: "TrustedIssuerRemoved", t.CLAIM_TOPICS_UPDATED: "ClaimTopicsUpdated"}
CLAIM_TOPICS = {t.CLAIM_TOPIC_ADDED: "ClaimTopicAdded", t.CLAIM_TOPIC_REMOVED: "ClaimTopicRemoved"}
COMPLIANCE = {t.MODULE_ADDED: "ModuleAdded", t.MODULE_REMOVED: "ModuleRemoved", t.TOKEN_BOUND: "TokenBound", t.TOKEN_UNBOUND: "TokenUnbound", t.MODULE_INTERACTION: "ModuleInteraction"}
OTHERS = {t.UPDATED_TOKEN_INFORMATION: "UpdatedTokenInformation", t.IDENTITY_REGISTRY_ADDED: "IdentityRegistryAdded", t.COMPLIANCE_ADDED: "ComplianceAdded", t.ONCHAIN_ID_APPROVED: "OnchainIdApproved", t.ONCHAIN_ID_EXECUTED: "OnchainIdExecuted"}


def _rows(logs: DataFrame, contract: str, **columns) -> DataFrame:
    return take(logs, entity_id().alias("id"), columns.pop("kind").alias("kind"), F.col("address").alias(contract), *(c.alias(n) for n, c in columns.items()), "block_number", "tx_hash", "log_index", "log_order")


def transfer_agent_actions(logs: DataFrame) -> DataFrame:
    """Freezes, pauses and recoveries in one table; fields that an event lacks are null."""
    least = {t.ADDRESS_FROZEN: 4, t.TOKENS_FROZEN: 2, t.TOKENS_UNFROZEN: 2, t.PAUSED: 1, t.UNPAUSED: 1, t.RECOVERY_SUCCESS: 4}
    kinds = {t.ADDRESS_FROZEN: "AddressFrozen"} | FREEZES | PAUSES | {t.RECOVERY_SUCCESS: "RecoverySuccess"}
    user = F.coalesce(only((t.ADDRESS_FROZEN, *FREEZES), address(1)), only(tuple(PAUSES), word_address(0)))
    return _rows(
        logs.where(enough(least)),
        "token",
        kind=by_kind(kinds),
        user=user,
        isFrozen=only(t.ADDRESS_FROZEN, hx.topic_bool(topic(2))),
        owner=only(t.ADDRESS_FROZEN, address(3)),
        amount=only(tuple(FREEZES), uint(0)),
        lostWallet=only(t.RECOVERY_SUCCESS, address(1)),
        newWallet=only(t.RECOVERY_SUCCESS, address(2)),
        investorOnchainID=only(t.RECOVERY_SUCCESS, address(3)),
    )


def identity_registry_actions(logs: DataFrame) -> DataFrame:
    return _rows(where_event(logs, tuple(IDENTITIES)), "registry", kind=by_kind(IDENTITIES), topic1=topic(1), topic2=topic(2))


def claims(logs: DataFrame) -> DataFrame:
    return _rows(where_event(logs, tuple(CLAIMS), 4), "identity", kind=by_kind(CLAIMS), claimId=topic(1), topic=topic_uint(2), issuer=address(3), data=F.col("data"))


def keys(logs: DataFrame) -> DataFrame:
    return _rows(where_event(logs, tuple(KEYS), 4), "identity", kind=by_kind(KEYS), key=topic(1), purpose=topic_uint(2), keyType=topic_uint(3))


def trusted_issuer_actions(logs: DataFrame) -> DataFrame:
    return _rows(where_event(logs, tuple(ISSUERS)), "registry", kind=by_kind(ISSUERS), issuer=address(1), data=F.col("data"))


def claim_topic_actions(logs: DataFrame) -> DataFrame:
    return _rows(where_event(logs, tuple(CLAIM_TOPICS)), "registry", kind=by_kind(CLAIM_TOPICS), topic=F.when(topic(1).isNotNull(), topic_uint(1)))


def compliance_actions(logs: DataFrame) -> DataFrame:
    return _rows(where_event(logs, tuple(COMPLIANCE)), "compliance", kind=by_kind(COMPLIANCE), target=address(1), data=F.col("data"))


def other_events(logs: DataFrame) -> DataFrame:
    return _rows(where_event(logs, tuple(OTHERS)), "contract", kind=by_kind(OTHERS), topics=F.col("topics"), data=F.col("data"))


DECODERS = {
    "TransferAgentAction": transfer_agent_actions,
    "IdentityRegistryAction": identity_registry_actions,
    "OnchainIdClaim": claims,
    "OnchainIdKey": keys,
    "TrustedIssuerAction": trusted_issuer_actions,
    "ClaimTopicAction": claim_topic_actions,
    "ComplianceAction": compliance_actions,
    "SecuritiesEvent": other_events,
}
