"""The newest events of several kinds as one feed, decoded after they have been chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import topics as t
from ledgerlake.decode import amm
from ledgerlake.decode.base import enough, swap_id
from ledgerlake.operators.rollups import activity

#: Signatures of each kind, with the least number of topics.
SWAPS = {t.SWAP_V2: 1, t.SWAP_V3: 1, t.SWAP_V4: 3}
MINTS = {t.MINT_V2: 2, t.MINT_V3: 4}
BURNS = {t.BURN_V2: 3, t.BURN_V3: 4}


def newest_logs(logs: DataFrame, signatures: dict[str, int], first: int) -> DataFrame:
    """The ``first`` newest logs of the signatures, ties by id: a top-k over raw logs, without a full sort."""
    return logs.where(enough(signatures)).orderBy(F.desc("block_number"), F.desc("log_order"), swap_id()).limit(first)


def newest_activity(logs: DataFrame, first: int) -> DataFrame:
    """What ``rollups.activity`` gives over all decoded logs, with ``first`` logs of each kind decoded and no more."""
    swaps, mints, burns = (decode(newest_logs(logs, names, first)) for decode, names in ((amm.all_swaps, SWAPS), (amm.mints, MINTS), (amm.burns, BURNS)))
    return activity(swaps, mints, burns, first)
