"""All queries of the library and, beside each, its SQL."""

from __future__ import annotations

import re

from foretally.functions.numeric import NUDGE
from foretally.plans import comparison, forecasting, ledger, master, protocols, records, sources, texts

_PLANS = (forecasting, comparison, ledger, texts, records, master, protocols, sources)


def nudged(sql: str) -> str:
    """The SQL with the same nudge as numeric.rounded(); sums of whole cents and rendered texts are exact without."""
    return re.sub(r"\bround\((?!o_totalprice|value|v\d)", f"round({NUDGE!r} + ", sql)


QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
SQL = {k: nudged(s) for p in _PLANS for k, s in p.SQL.items()}
