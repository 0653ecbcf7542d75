"""Names of states and cities: canonical forms, as columns over small tables that are configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import text as tx

#: Canonical states and spellings of them, by their squashed key; a site's own table replaces it.
STATES = {
    "westbengal": "West Bengal", "wb": "West Bengal", "maharashtra": "Maharashtra", "maharastra": "Maharashtra", "rajasthan": "Rajasthan", "gujarat": "Gujarat",
    "karnataka": "Karnataka", "delhi": "Delhi", "uttarpradesh": "Uttar Pradesh",
}
CITIES = ("kolkata", "pune", "jaipur", "surat", "mysuru", "nagpur", "delhi", "noida", "ghazipur")


def is_in(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def canonical_state(c: Column, states: dict[str, str] | None = None) -> Column:
    """The state's canonical name, null for other texts."""
    table = F.create_map(*[F.lit(x) for kv in (states or STATES).items() for x in kv])
    return F.element_at(table, tx.squash_key(c))


def known_city(c: Column, cities: Sequence[str] = CITIES) -> Column:
    return is_in(tx.squash_key(c), cities)
