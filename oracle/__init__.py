"""SQL statements that compute the registered queries independently."""

from oracle import markets, modeling, people, point_in_time, sources

ALL_ORACLES = {**point_in_time.ORACLE, **sources.ORACLE, **markets.ORACLE, **people.ORACLE, **modeling.ORACLE}
