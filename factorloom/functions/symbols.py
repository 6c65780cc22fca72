"""Instrument code notations: ``SHSE.600000`` (exchange and dot) and ``SH600000`` (short prefix)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange codes of the two notations.
EXCHANGE_TO_PREFIX = {"SHSE": "SH", "SZSE": "SZ"}
PREFIX_TO_EXCHANGE = {"SH": "SHSE", "SZ": "SZSE"}
# Exchange codes of the suffix notation (``600000.XSHG``).
EXCHANGE_TO_SUFFIX = {"SHSE": "XSHG", "SZSE": "XSHE"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(mapping, key), key)


def to_prefixed(symbol: Column) -> Column:
    """``SHSE.600000`` -> ``SH600000``; an unknown exchange is kept as it is."""
    return F.concat(_lookup(EXCHANGE_TO_PREFIX, F.split_part(symbol, F.lit("."), F.lit(1))),
                    F.split_part(symbol, F.lit("."), F.lit(2)))


def to_dotted(symbol: Column) -> Column:
    """``SH600000`` -> ``SHSE.600000``; an unknown prefix is kept as it is."""
    return F.concat_ws(".", _lookup(PREFIX_TO_EXCHANGE, F.substring(symbol, 1, 2)), F.substr(symbol, F.lit(3)))


def to_suffixed(symbol: Column) -> Column:
    """``SHSE.600000`` -> ``600000.XSHG``."""
    return F.concat_ws(".", F.split_part(symbol, F.lit("."), F.lit(2)),
                       _lookup(EXCHANGE_TO_SUFFIX, F.split_part(symbol, F.lit("."), F.lit(1))))


def from_suffixed(symbol: Column) -> Column:
    """``600000.XSHG`` -> ``SHSE.600000``."""
    exchange_of = {suffix: exchange for exchange, suffix in EXCHANGE_TO_SUFFIX.items()}
    return F.concat_ws(".", _lookup(exchange_of, F.split_part(symbol, F.lit("."), F.lit(2))),
                       F.split_part(symbol, F.lit("."), F.lit(1)))
