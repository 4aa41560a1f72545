"""Schemas of the inputs and of the typed tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "b": T.BooleanType(), "a": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


#: A log as a node returns it: all text, numbers as 0x-hex.
RAW_LOG = _struct("address:s topics:a data:s blockNumber:s transactionHash:s logIndex:s transactionIndex:s")
#: A log as the decoders take it.
LOG = _struct("address:s topics:a data:s block_number:l tx_hash:s log_index:s tx_index:l topic0:s log_order:l")
#: The same, as stored by signature and block bucket.
STORED_LOG = _struct("address:s topics:a data:s block_number:l tx_hash:s log_index:s tx_index:l log_order:l topic0:s block_bucket:l")
ADDRESSED_LOG = _struct("address:s topics:a data:s block_number:l tx_hash:s log_index:s tx_index:l log_order:l topic0:s zone:l")

FACTORY = _struct("id:s poolCount:l txCount:l totalVolumeUSD:s totalValueLockedUSD:s")
BUNDLE = _struct("id:s ethPriceUSD:s")
TOKEN = _struct("id:s symbol:s name:s decimals:l volumeUSD:s totalValueLockedUSD:s derivedETH:s txCount:l")
POOL = _struct("id:s token0:s token1:s feeTier:l totalValueLockedUSD:s volumeUSD:s token0Price:s token1Price:s txCount:l")
SWAP = _struct("id:s timestamp:l pool:s amount0:s amount1:s amountUSD:s sender:s")
ENTITY = _struct("entity_type:s id:s data:s block_number:l log_order:l")
BLOCK = _struct("number:l timestamp:l hash:s")
TRANSACTION = _struct("hash:s block_number:l from:s value:s")
