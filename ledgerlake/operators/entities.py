"""The entity catalogue: types by domain, their queries, and domain statistics."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import hexwords as hx
from ledgerlake.operators.query import clamp, list_rows, suffix_of
from ledgerlake.operators.upsert import as_documents

# Entity types of each domain, and the singleton that holds its statistics.
CATALOGUE: dict[str, tuple[tuple[str, ...], str | None]] = {
    "ai": (("InferenceProof", "ModelHash", "ComputeAttestation", "AIJob", "TrainingRun"), "AIStats"),
    "bridge": (("BridgeTransfer", "MPCSignature", "WrappedAsset", "BridgeRequest"), "BridgeStats"),
    "dao": (("DAOProposal", "DAOMember", "DAOTreasury"), "DAOStats"),
    "derivatives": (("DerivativeContract", "DerivativeSettlement", "DerivativeExercise"), "DerivativeStats"),
    "dex": (("Order", "Fill", "Market", "PerpPosition", "FundingRate", "Liquidation", "Orderbook", "MarketDayData"), None),
    "did": (("DIDDocument", "DIDDelegate", "DIDAttribute"), "DIDStats"),
    "exchange": (("Asset", "UTXO", "XTransfer", "AssetCreation", "ImportTx", "ExportTx"), None),
    "fhe": (("DKGCeremony", "DecryptionRequest", "ComputeJob", "Ciphertext", "KeyShare", "FHEPolicy", "FHEPolicyBinding"), "FHEStats"),
    "governance": (("Proposal", "Vote", "Delegation", "GovernanceProposal", "GovernanceVote", "DelegateChange", "DelegateVotesChange", "GaugeEvent", "VoteLockEvent", "KarmaEvent", "StakeEvent"), "GovernanceStats"),
    "identity": (("DID", "VerifiableCredential", "Attestation", "IdentityRegistry", "CredentialSchema"), "IdentityStats"),
    "key": (("ManagedKey", "KeyRotation", "KeyShare", "KeyCeremony", "KeyAttestation"), "KeyStats"),
    "liquid": (("LiquidStake", "LiquidUnstake", "LiquidReward", "LiquidValidator", "LiquidEvent"), "LiquidStats"),
    "liquidity": (("CrossChainSwap", "LimitOrder", "Arbitrage", "OMAPool", "OMASwap", "PriceUpdate", "StrategyOrder", "MarketMaker", "BridgeTransfer"), "LiquidityStats"),
    "liquidprotocol": (("LiquidFee", "ValidatorReward", "SlashingEvent", "DepositMint", "YieldMint", "WithdrawBurn", "BackingUpdate", "VaultStrategy", "YieldHarvest"), "LiquidProtocolStats"),
    "mpc": (("SigningSession", "KeygenSession", "SignerSet", "Presignature", "SignRequest"), "MPCStats"),
    "oracle": (("PriceFeed", "DataRequest", "OracleReport", "OracleNode", "DataAttestation"), "OracleStats"),
    "platform": (("Validator", "Delegator", "Subnet", "Blockchain", "StakingReward"), "NetworkStats"),
    "precompile": (("PrecompileCall", "AIWorkProof", "FHEOperation", "FHEACLGrant", "FHEGatewayRequest", "CryptoOp", "ZKVerification", "PrivacyPoolOp", "RollupVerification", "WarpCall", "DEXPrecompileOrder", "RingSignature", "GraphSchemaUpdate", "PQCryptoOp", "ThresholdOp"), "PrecompileStats"),
    "prediction": (("PredictionMarket", "PredictionPosition", "PredictionResolution"), "PredictionStats"),
    "privacy": (("ShieldedTransfer", "ZKProof", "Nullifier", "Commitment", "PrivacyPool"), None),
    "quantum": (("RingtailSignature", "QuantumProof", "PQKeyPair", "QuantumFinality", "QuantumAttestation"), "QuantumStats"),
    "relay": (("WarpMessage", "RelayRequest", "RelayProof", "RelayRoute", "MessageReceipt"), "RelayStats"),
    "securities": (("SecurityIssuance", "SecurityTransfer", "SecurityDividend", "SecurityCompliance", "OnchainIdClaim", "TransferAgentAction", "FrozenAccount", "FrozenTokens", "IdentityRegistryAction", "OnchainIdKey", "TrustedIssuerAction", "ClaimTopicAction", "ComplianceAction", "SecuritiesEvent"), "SecurityStats"),
    "servicenode": (("ServiceNode", "ServiceRegistration", "SLARecord", "UptimeProof", "ServiceEndpoint"), "ServiceStats"),
    "treasury": (("TreasuryDeposit", "TreasuryWithdrawal", "TreasuryAllocation", "TreasuryBudget", "VaultEvent", "FeeGovEvent", "RouterEvent"), "TreasuryStats"),
    "utxo": (("UTXO", "Asset", "AssetCreateTx", "UTXOBalance"), "UTXOStats"),
    "zk": (("ZKProof", "Verifier", "CircuitHash", "ProofBatch", "ZKSession"), "ZKStats"),
}

# Statistics, field -> (entity type, measure, JSON field). Measures: count, sum, avg.
STATISTICS: dict[str, dict[str, tuple[str, str, str | None]]] = {
    "NetworkStats": {"totalStake": ("Validator", "sum", "stake"), "validatorCount": ("Validator", "count", None), "delegatorCount": ("Delegator", "count", None)},
    "QuantumStats": {"totalSignatures": ("RingtailSignature", "count", None), "totalProofs": ("QuantumProof", "count", None)},
    "BridgeStats": {"totalTransfers": ("BridgeTransfer", "count", None), "totalVolume": ("BridgeTransfer", "sum", "amount")},
    "FHEStats": {"totalCeremonies": ("DKGCeremony", "count", None), "totalComputeJobs": ("ComputeJob", "count", None)},
    "OracleStats": {"totalFeeds": ("PriceFeed", "count", None), "totalReports": ("OracleReport", "count", None)},
    "RelayStats": {"totalMessages": ("WarpMessage", "count", None), "totalRelayed": ("MessageReceipt", "count", None)},
    "ServiceStats": {"totalNodes": ("ServiceNode", "count", None), "averageUptime": ("SLARecord", "avg", "uptime")},
    "KeyStats": {"totalKeys": ("ManagedKey", "count", None), "totalRotations": ("KeyRotation", "count", None)},
    "AIStats": {"totalInferences": ("InferenceProof", "count", None), "totalModels": ("ModelHash", "count", None)},
    "IdentityStats": {"totalDIDs": ("DID", "count", None), "totalCredentials": ("VerifiableCredential", "count", None)},
}


def get_entity(entities: DataFrame, entity_type: str, ident: str) -> DataFrame:
    """One document or none; both keys are filters, the type prunes folders."""
    return entities.where((F.col("entity_type") == entity_type) & (F.col("id") == ident)).limit(1)


def list_entities(entities: DataFrame, entity_type: str, first: Any = None) -> DataFrame:
    return entities.where(F.col("entity_type") == entity_type).orderBy("id").limit(clamp(first))


def typed(entities: DataFrame, entity_type: str, schema: str) -> DataFrame:
    """Documents of a type as columns, by a declared schema; fields that a document lacks are null."""
    return entities.where(F.col("entity_type") == entity_type).select(F.from_json("data", schema).alias("d")).select("d.*")


def as_variant(entities: DataFrame) -> DataFrame:
    """Documents of any type as VARIANT, for types without a declared schema; malformed text is null."""
    return as_documents(entities)


def get_by_field(entities: DataFrame, entity_type: str, field: str, value: str) -> DataFrame:
    """Lookup by a field of the document, such as a balance by its address."""
    return entities.where((F.col("entity_type") == entity_type) & (F.get_json_object("data", f"$.{field}") == value)).limit(1)


def domain_statistics(entities: DataFrame, stat: str, spec: Mapping[str, tuple[str, str, str | None]] | None = None) -> DataFrame:
    """The singleton (id "1") of a domain, recomputed in one pass over its entity types.

    Counts are BIGINT, sums exact decimal text, averages DOUBLE; a field that is no number counts for neither.
    """
    spec = spec or STATISTICS[stat]
    rows = entities.where(F.col("entity_type").isin(*sorted({e for e, _, _ in spec.values()})))
    for name, (kind, measure, field) in spec.items():
        value = F.when(F.col("entity_type") == kind, F.get_json_object("data", f"$.{field}") if field else F.lit("1"))
        rows = rows.withColumn(f"_{name}", value)
        rows = rows.withColumn(f"_{name}", {"sum": hx.fixed_point(f"_{name}"), "avg": hx.number(F.col(f"_{name}"))}.get(measure, F.col(f"_{name}")))
    out = [{"count": F.count, "sum": hx.sum_digits, "avg": F.avg}[measure](f"_{name}").alias(name) for name, (_, measure, _) in spec.items()]
    return rows.agg(*out).select(F.lit("1").alias("id"), *[hx.with_point(n).alias(n) if m == "sum" else F.col(n) for n, (_, m, _) in spec.items()])


def get_statistics(entities: DataFrame, stat: str) -> DataFrame:
    """The stored singleton of a domain's statistics, or no row."""
    return get_entity(entities, stat, "1")


def at_path(path: str) -> Column:
    """A field of a VARIANT document by its dotted path, as text; null where the document lacks it."""
    return F.try_variant_get("data", F.lit("$." + path), "string")


def list_documents(documents: DataFrame, entity_type: str, first: Any = None, order: str | None = None, direction: str = "asc", conditions: Mapping[str, Any] | None = None) -> DataFrame:
    """VARIANT documents of a type, filtered and ordered by paths that nobody has declared; id and data.

    Conditions are those of ``query.where`` (suffixes _gte _lte _gt _lt, otherwise equality; numbers by value,
    text as text), ties go by id, and a document without a field that is asked for is dropped. Only the paths that
    are named are taken out of the documents, in the scan's own projection.
    """
    named = [key[: len(key) - len(s)] if (s := suffix_of(key)) else key for key in conditions or {}]
    paths = list(dict.fromkeys([*named, *([order] if order else [])]))
    columns = {p: f"path_{k}" for k, p in enumerate(paths)}
    rows = documents.where(F.col("entity_type") == entity_type).select("id", "data", *[at_path(p).alias(c) for p, c in columns.items()])
    asked = {columns[n] + suffix_of(key): value for n, (key, value) in zip(named, (conditions or {}).items(), strict=True)}
    return list_rows(rows, first, columns.get(order, "id"), direction, asked).select("id", "data")


def document_schemas(documents: DataFrame) -> DataFrame:
    """entity_type, documents, schema: what fields the documents of each type have, found in one pass."""
    return documents.groupBy("entity_type").agg(F.count("*").alias("documents"), F.schema_of_variant_agg("data").alias("schema"))
