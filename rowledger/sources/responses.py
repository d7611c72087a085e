"""Recorded responses: paths into them, variables captured from them, and the status they must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_path(body: Column, path: str) -> Column:
    """struct(state, value) of a path like ``meta.id``: 'value' with the leaf as text (objects as JSON), 'null' for a missing
    leaf or JSON null, 'unevaluable' if the body is no JSON or the parent is missing."""
    js = F.try_parse_json(body)
    parts = path.split(".")
    leaf = F.try_variant_get(js, "$." + path, "string")
    parent = js if len(parts) == 1 else F.try_variant_get(js, "$." + ".".join(parts[:-1]), "variant")
    holds = parent.isNotNull() & F.schema_of_variant(parent).startswith("OBJECT")
    state = F.when(~F.coalesce(holds, F.lit(False)), "unevaluable").when(leaf.isNull(), "null").otherwise("value")
    return F.struct(state.alias("state"), leaf.alias("value"))


def header(headers: Column, name: str) -> Column:
    """A header by name, case aside; ``headers`` is a map."""
    return F.element_at(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())), 1)


def capture_variables(responses: DataFrame, wanted: dict[str, str], by: list[str], body: str = "body") -> DataFrame:
    """(by…, name, value) for every variable and response whose path has a value; NULL and missing are not captured."""
    made = F.array(*(F.struct(F.lit(n).alias("name"), read_path(F.col(body), p)["value"].alias("value")) for n, p in wanted.items()))
    return responses.select(*by, F.explode(made).alias("v")).select(*by, "v.*").where("value is not null")


def status_check(responses: DataFrame, steps: DataFrame, by: list[str], expect: str = "expect_status") -> DataFrame:
    """The implicit assertion of each step: the status asked for, or one below 400; failed ones are the first of their step (ordinal -1)."""
    d = responses.join(steps, by)
    ok = F.when(F.col(expect).isNotNull(), F.col("status") == F.col(expect)).otherwise(F.col("status") < 400)
    expected = F.when(F.col(expect).isNotNull(), F.col(expect).cast("string")).otherwise("< 400")
    return d.select(*by, F.lit(-1).alias("ordinal"), F.lit("response.status").alias("source"), F.when(ok, "passed").otherwise("failed").alias("status"), F.col("status").cast("string").alias("actual"), expected.alias("expected"))
