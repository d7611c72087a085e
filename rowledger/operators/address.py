"""Addresses of changed rows: whether a row can be found again, and the text that finds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import key_label, row_select
from ..sources.scope import TableScope
from .capture import DELETE, LEFT


def addresses(changes: DataFrame, scope: TableScope, location_known: bool = True, schema: str | None = None) -> DataFrame:
    """(table, kind, label, address_state, reason, select_text): usable, usable-absent (the row is gone) or unavailable with its reason."""
    image = F.coalesce(F.col("after"), F.col("before"))
    keys: list[Column] = [image[k] for k in scope.keys]
    masked = [k in scope.masked for k in scope.keys]
    why = "location-unknown" if not location_known else "no-stable-key" if not scope.keys else "masked-key" if any(masked) else None
    text = row_select(scope.name, list(scope.keys), keys, schema) if why is None else F.lit(None).cast("string")
    reason = F.lit(why) if why else F.when(text.isNull(), "unknown-value")
    d = changes.select("table", "kind", key_label(keys, masked).alias("label"), reason.cast("string").alias("reason"), text.alias("select_text"))
    state = F.when(F.col("reason").isNotNull(), "unavailable").when(F.col("kind").isin(DELETE, LEFT), "usable-absent").otherwise("usable")
    return d.select("table", "kind", "label", state.alias("address_state"), "reason", "select_text")
