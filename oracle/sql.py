"""Builds an oracle statement: the body plus exactly the carrier views it names."""

from __future__ import annotations

import re

from oracle.carriers import CTE


def _needed(text: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bc_[a-z_]+\b", text):
        if name in CTE and name not in found:
            _needed(CTE[name], found)
            if name not in found:
                found.append(name)
    return found


#: Carriers that several steps read: computed once per statement.
ONCE = {"c_sides", "c_history", "c_fixtures", "c_matches"}


def q(body: str, **extra: str) -> str:
    """``WITH`` carriers, then the ``extra`` named steps in order, then ``body``."""
    names = _needed(" ".join([*extra.values(), body]), [])
    steps = [f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({CTE[n]})" for n in names] + [f"{n} AS ({s})" for n, s in extra.items()]
    return (f"WITH {', '.join(steps)} " if steps else "") + body


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
