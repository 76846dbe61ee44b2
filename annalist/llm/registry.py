"""What the driver's entry file adds from this subpackage."""

from .oracles import ORACLES
from .queries import queries


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["oracle_sql", "queries"]
