"""Log level names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level token (lower case) and the level it stands for.
LEVEL_TOKENS = {
    "trace": "debug",
    "debug": "debug",
    "dbg": "debug",
    "0": "debug",
    "1": "debug",
    "info": "info",
    "information": "info",
    "notice": "info",
    "2": "info",
    "3": "info",
    "warn": "warn",
    "warning": "warn",
    "4": "warn",
    "error": "error",
    "err": "error",
    "critical": "error",
    "crit": "error",
    "fatal": "error",
    "emerg": "error",
    "alert": "error",
    "panic": "error",
    "5": "error",
    "6": "error",
    "7": "error",
}
DEFAULT_LEVEL = "info"


def trimmed(token: Column) -> Column:
    return F.btrim(token, F.lit(" \t\n\v\f\r\u0085\u00a0"))


def canonical_level(token: Column) -> Column:
    """Level a trimmed token stands for; NULL when the token is unknown."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(LEVEL_TOKENS.items())])
    return F.element_at(table, F.lower(token))
