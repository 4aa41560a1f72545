"""What every decoder shares: one filter on the signature, one projection, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import hexwords as hx


def topic(i: int) -> Column:
    """Topic i as it stands; null where the log has fewer."""
    return F.get("topics", i)


def address(i: int) -> Column:
    return hx.topic_address(topic(i))


def take(logs: DataFrame, *columns: Column | str) -> DataFrame:
    """A selection in which ``word``, ``uint``, ``sint`` and their like may stand.

    Words are cut and their decimal digits computed as columns below it, once each, for those that the
    selection names and no others: building and analysing all of them would take most of a second. Columns without
    words are made at the bottom, so that topics and data, which are long, are not copied from level to level.
    """
    chosen = [F.col(c) if isinstance(c, str) else c for c in columns]
    told = {k: str(c) for k, c in enumerate(chosen) if re.search(r"_[wt]\d", str(c))}
    every = " ".join(told.values())
    cut = sorted(set(re.findall(r"_[wt]\d", every)))
    if not cut:
        return logs.select(*chosen)
    plain = [k for k in range(len(chosen)) if k not in told]
    names = dict(zip(plain, logs.select(*[chosen[k] for k in plain]).columns, strict=True))
    read = [c for c in logs.columns if re.search(rf"\b{c}\b", every)]
    words = [(hx.word(F.col("data"), int(n[2])) if n[1] == "w" else hx.topic_word(topic(int(n[2])))).alias(n) for n in cut]
    rows = logs.select(*read, *[chosen[k].alias(f"_c{k}") for k in plain], *words)
    unsigned, signed = ({f"_{k}{n}": n for n in cut if f"_{k}{n}" in every} for k in "us")
    nets = sorted(set(re.findall(r"_over_w(\d)_w(\d)", every)))
    for i, j in nets:  # limbs for differences of wide words only
        rows = rows.withColumns({f"_wide{i}{j}_{k}": F.expr(f"CASE WHEN NOT {hx.both_small(word(i), word(j))} THEN {hx.limbs(word(k))} END") for k in (i, j)})
    rows = hx.with_digits(rows, unsigned, signed)
    for i, j in nets:
        sides = hx.apart(word(i), word(j), *[hx.joined(f"_wide{i}{j}_{k}") for k in (i, j)])
        rows = rows.withColumns({n: F.expr(f"CASE WHEN _wide{i}{j}_{i} IS NOT NULL THEN {x} END") for n, x in zip(_sides(i, j), sides, strict=True)})
    return rows.select(*[c if k in told else F.col(f"_c{k}").alias(names[k]) for k, c in enumerate(chosen)])


def _sides(i: int | str, j: int | str) -> tuple[str, str]:
    return f"_over_w{i}_w{j}", f"_under_w{i}_w{j}"


def word(i: int | str) -> str:
    """The name of data word i in a selection by ``take``."""
    return f"_w{i}"


def topic_uint(i: int) -> Column:
    return F.col(f"_u_t{i}")


def topic_int(i: int) -> Column:
    return hx.int_small(f"_t{i}")


def uint(i: int) -> Column:
    return F.col(f"_u{word(i)}")


def sint(i: int) -> Column:
    return F.col(f"_s{word(i)}")


def net(i: int, j: int) -> Column:
    """Word i less word j."""
    return hx.net_uint256(word(i), word(j), "", "", _sides(i, j))


def small_int(i: int) -> Column:
    return hx.int_small(word(i))


def word_address(i: int, on_short: str = hx.ZERO_ADDRESS, whole: bool = True) -> Column:
    return hx.address_word(F.col("data"), i, on_short, whole)


def where_event(logs: DataFrame, signatures: str | tuple[str, ...], topics: int = 1) -> DataFrame:
    """Logs of the signatures that have at least ``topics`` topics."""
    wanted = (signatures,) if isinstance(signatures, str) else signatures
    return logs.where(F.col("topic0").isin(*wanted) & hx.has_topics(topics))


def by_kind(kinds: Mapping[str, str]) -> Column:
    """signature -> name"""
    out = None
    for signature, name in kinds.items():
        out = (F if out is None else out).when(F.col("topic0") == signature, F.lit(name))
    return out


def only(signature: str | tuple[str, ...], value: Column) -> Column:
    """``value`` for these signatures, null for the others that share an output."""
    wanted = (signature,) if isinstance(signature, str) else signature
    return F.when(F.col("topic0").isin(*wanted), value)


def enough(minimum: Mapping[str, int]) -> Column:
    """Each signature with its own least number of topics."""
    out = F.lit(False)
    for signature, n in minimum.items():
        out = out | ((F.col("topic0") == signature) & hx.has_topics(n))
    return out


def swap_id() -> Column:
    return F.concat_ws("#", "tx_hash", "log_index")


def entity_id() -> Column:
    return F.concat_ws(":", "address", "tx_hash", "log_index")
