"""Verdicts: assertion counts, step and run outcomes, bounds, suites, cases and exit codes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The statuses, outcomes (best first), warning severities and exit codes.
STATUSES = ("passed", "failed", "unevaluable", "passed-as-refused")
OUTCOMES = ("clean", "undecided", "failed", "errored")
EXIT_CODES = {"clean": 0, "failed": 1, "errored": 2, "undecided": 3}
SEVERITIES = {"scope-truncated": "error", "reduced-fidelity": "error", "concurrent-writes-detected": "warning", "degraded-row-identity": "warning", "unreadable-value": "warning", "rendering-not-pinned": "warning"}
STEP_OUTCOMES = ("passed", "failed", "undecided", "errored", "not-run")


@dataclass(frozen=True)
class Policy:
    """What undecided results cost: ``accept_unevaluable`` accepts unevaluable assertions, ``warnings`` is natural, strict or off,
    ``require_assertions`` leaves a run without any undecided."""

    accept_unevaluable: bool = False
    warnings: str = "natural"
    require_assertions: bool = True


def known(c: Column, values: tuple[str, ...], other: str) -> Column:
    """An unknown value counts as ``other``."""
    return F.when(c.isin(*values), c).otherwise(other)


def assertion_counts(results: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    s = known(F.col(status), STATUSES, "unevaluable")
    named = {"passed": "passed", "failed": "failed", "unevaluable": "unevaluable", "passed-as-refused": "passed_as_refused"}
    return results.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(s == k).alias(v) for k, v in named.items()))


def severity(code: Column, policy: Policy = Policy()) -> Column:  # noqa: B008
    natural = reduce(lambda c, x: c.when(code == x[0], x[1]), list(SEVERITIES.items())[1:], F.when(code == "scope-truncated", "error")).otherwise("error")
    return {"natural": natural, "strict": F.lit("error"), "off": F.lit("warning")}[policy.warnings]


def weigh_warnings(warnings: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Adds severity and escalated (the policy made it worse than it is by nature)."""
    natural = severity(F.col("code"))
    return warnings.withColumn("severity", severity(F.col("code"), policy)).withColumn("escalated", (F.col("severity") == "error") & (natural != "error"))


def step_outcome(status: Column, failed: Column, unevaluable: Column, blind: Column, policy: Policy = Policy()) -> Column:  # noqa: B008
    """errored, not-run, failed, undecided, passed: the first that holds."""
    undecided = (blind > 0) | ((unevaluable > 0) if not policy.accept_unevaluable else F.lit(False))
    return F.when(status == "errored", "errored").when(status.isin("skipped", "not-run"), "not-run").when(failed > 0, "failed").when(undecided, "undecided").otherwise("passed")


def step_outcomes(steps: DataFrame, results: DataFrame, warnings: DataFrame, by: list[str], policy: Policy = Policy(), status: str = "step_status") -> DataFrame:  # noqa: B008
    """Adds total, passed, failed, unevaluable, passed_as_refused, blind (severe warnings) and outcome to each step."""
    a = assertion_counts(results, by)
    w = weigh_warnings(warnings, policy).groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("blind"))
    d = steps.join(a, by, "left").join(w, by, "left").fillna(0, ["total", "passed", "failed", "unevaluable", "passed_as_refused", "blind"])
    return d.withColumn("outcome", step_outcome(F.col(status), F.col("failed"), F.col("unevaluable"), F.col("blind"), policy))


def unreached(declared: DataFrame, attempted: DataFrame, by: list[str]) -> DataFrame:
    """Declared steps that were never tried, as not-run rows."""
    return declared.join(attempted.select(*by), by, "left_anti").withColumn("outcome", F.lit("not-run"))


def run_verdicts(outcomes: DataFrame, by: list[str], policy: Policy = Policy(), warnings: DataFrame | None = None, facts: DataFrame | None = None, step: str = "step_no") -> DataFrame:  # noqa: B008
    """From step outcomes: counts of steps, unchecked and not-run ones, the run's outcome with its reason, and whether all was proven.

    The reason names the first cause that holds. ``warnings`` (by…, code, table) gives a bound for each code with its tables, and names the
    severe one that leaves a run undecided; ``facts`` (by…, partial, probed) tells of runs of a part of their steps and of baselines that
    nobody looked at. ``unchecked`` counts steps without an assertion; it bounds a run only if none of its steps has one. ``bounds`` are codes; ``fine_print`` has a sentence for each of them, in the same order."""
    o = F.col("outcome")
    first = F.min(F.when(o == "errored", F.col(step))) if step in outcomes.columns else F.lit(None)
    missed = F.array_sort(F.collect_list(F.when(o == "not-run", F.col(step)))) if step in outcomes.columns else F.array()
    d = outcomes.groupBy(*by).agg(
        F.count("*").alias("steps"), *(F.count_if(o == s).alias(s.replace("-", "_") + "_steps") for s in STEP_OUTCOMES), F.sum("failed").alias("failed"), first.alias("_first"), missed.alias("_missed"),
        F.count_if(~o.isin("errored", "not-run") & (F.col("total") == 0)).alias("unchecked"), F.count_if(~o.isin("errored", "not-run")).alias("_observed"), F.sum("total").alias("assertions"), F.sum("unevaluable").alias("unevaluable"), F.sum("blind").alias("blind"),
    )
    noted = F.array().cast("array<struct<code:string,tables:string,severity:string>>")
    if warnings is not None:
        w = bound_rows(warnings, by).withColumn("severity", severity(F.col("code"), policy))
        w = w.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("code", "tables", "severity"))).alias("_noted"))  # one of each code
        d, noted = d.join(w, by, "left"), F.coalesce("_noted", noted)
    if facts is not None:
        d = d.join(facts.select(*by, "partial", "probed"), by, "left")
    partial, unprobed = (F.coalesce("partial", F.lit(False)), ~F.coalesce("probed", F.lit(True))) if facts is not None else (F.lit(False), F.lit(False))
    none = (F.col("assertions") == 0) & F.lit(policy.require_assertions)
    open_ = F.lit(not policy.accept_unevaluable) & (F.col("unevaluable") > 0)
    by_policy = F.lit(policy.accept_unevaluable) & (F.col("unevaluable") > 0)
    undecided = (F.col("undecided_steps") > 0) | (F.col("blind") > 0) | open_ | none
    outcome = F.when(F.col("errored_steps") > 0, "errored").when((F.col("failed_steps") > 0) | (F.col("failed") > 0), "failed").when(undecided, "undecided").otherwise("clean")
    severe = F.get(F.filter(noted, lambda x: x["severity"] == "error"), F.lit(0))
    many = lambda n, one, more: F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, f" {one}").otherwise(f" {more}"))
    reason = (
        F.when(outcome == "errored", F.concat(many("errored_steps", "step", "steps"), F.lit(" of "), F.col("steps").cast("string"), F.lit(" errored"), F.coalesce(F.concat(F.lit(", first "), F.col("_first").cast("string")), F.lit(""))))
        .when((outcome == "failed") & (F.col("failed") > 0), many("failed", "assertion failed", "assertions failed"))
        .when(outcome == "failed", many("failed_steps", "step failed", "steps failed"))
        .when(open_, many("unevaluable", "assertion could not be evaluated", "assertions could not be evaluated"))
        .when((F.col("blind") > 0) & severe.isNotNull(), F.concat(severe["code"], F.when(severe["tables"] != "", F.concat(F.lit(" on "), severe["tables"])).otherwise("")))
        .when(F.col("blind") > 0, many("blind", "severe warning", "severe warnings"))
        .when(none, "nothing was asserted")
        .when(outcome == "undecided", many("undecided_steps", "step could not be decided", "steps could not be decided"))
        .when(F.col("assertions") == 0, "every step ran, nothing was asserted")
        .when(by_policy, F.concat((F.col("assertions") - F.col("unevaluable")).cast("string"), F.lit(" of "), many("assertions", "assertion", "assertions"), F.lit(" held, the others were not evaluated and accepted by policy")))
        .otherwise("all assertions held")
    )
    entry = lambda when, code, text: F.when(when, F.struct(F.lit(code).alias("bound"), text.alias("said")))
    codes = F.transform(noted, lambda x: F.struct(x["code"].alias("bound"), F.concat(x["code"], F.when(x["tables"] != "", F.concat(F.lit(" on "), x["tables"])).otherwise("")).alias("said")))
    before = F.array_compact(F.array(
        entry(partial, "partial", F.lit("only a part of the steps was asked for")),
        entry(F.col("not_run_steps") > 0, "unreached", F.concat(many("not_run_steps", "step never ran", "steps never ran"), F.when(F.size("_missed") > 0, F.concat(F.lit(": "), F.array_join(F.transform("_missed", lambda x: x.cast("string")), ", "))).otherwise(""))),
        entry(unprobed, "unprobed", F.lit("nobody looked at what changes when nothing is asked")),
        entry((F.col("blind") > 0) & F.lit(warnings is None), "warnings", many("blind", "severe warning", "severe warnings")),
    ))
    behind = F.array_compact(F.array(entry(by_policy, "by-policy", F.concat(many("unevaluable", "assertion", "assertions"), F.lit(" not evaluated and accepted by policy"))), entry(
        (F.col("assertions") == 0) & (F.col("steps") > 0), "unchecked", F.when(F.col("_observed") > 0, "what was observed was checked by nothing").otherwise("nothing was observed or checked"))))
    d = d.withColumn("outcome", outcome).withColumn("reason", reason).withColumn("_bounds", F.concat(before, codes, behind))
    d = d.withColumn("bounds", F.transform("_bounds", lambda x: x["bound"])).withColumn("fine_print", F.transform("_bounds", lambda x: x["said"]))
    return d.withColumn("proves", F.when(F.size("bounds") == 0, "full").otherwise("bounded")).drop("_first", "_missed", "_noted", "_observed", "_bounds", "partial", "probed")


def bound_rows(warnings: DataFrame, by: list[str]) -> DataFrame:
    """(by…, code, tables): each warning code once, with up to three table names in order and how many more."""
    d = warnings.groupBy(*by, "code").agg(F.array_sort(F.collect_set("table")).alias("t"))
    more = F.when(F.size("t") > 3, F.concat(F.lit(" and "), (F.size("t") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return d.select(*by, "code", F.concat(F.array_join(F.slice("t", 1, 3), ", "), more).alias("tables"))


def rank(outcome: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, OUTCOMES)), outcome)


def suite_verdict(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Merges runs (or stored suites with the same columns): the worst outcome, summed counts, coverage and what is proven."""
    g = runs.groupBy(*(by or []))
    worst = F.element_at(F.array(*map(F.lit, OUTCOMES)), F.max(rank(F.col("outcome"))).cast("int"))
    return g.agg(
        worst.alias("outcome"), F.count("*").alias("runs"), F.sum("steps").alias("steps"), F.sum("assertions").alias("assertions"), F.sum("not_run_steps").alias("not_run_steps"),
        F.when(F.bool_and(F.col("not_run_steps") == 0), "full").when(F.bool_and(F.col("not_run_steps") > 0), "partial").otherwise("mixed").alias("coverage"),
        F.when(F.bool_or(F.col("proves") == "bounded"), "bounded").otherwise("full").alias("proves"),
    )


def suite_bounds(runs: DataFrame) -> DataFrame:
    """(bound, sentence): in how many of the runs each bound holds. Bounds stay structured until here: a warning's code is one bound
    whatever its tables, and what was accepted by policy is counted over all runs."""
    n = runs.agg(F.count("*").alias("n"))
    d = runs.select(F.explode("bounds").alias("bound"), "unevaluable").groupBy("bound").agg(F.count("*").alias("k"), F.sum("unevaluable").alias("u")).crossJoin(F.broadcast(n))  # one row
    said = F.when(F.col("k") == F.col("n"), F.col("bound")).otherwise(F.format_string("%s in %d of %d datasets", "bound", "k", "n"))
    return d.select("bound", F.when(F.col("bound") == "by-policy", F.concat(said, F.lit(", "), F.col("u").cast("string"), F.lit(" assertions"))).otherwise(said).alias("sentence"))


def exit_code(outcome: Column, exit_zero: bool = False) -> Column:
    """0, 1, 2 or 3; with ``exit_zero``, failed and undecided give 0 and errored stays."""
    code = reduce(lambda c, x: c.when(outcome == x[0], x[1]), list(EXIT_CODES.items())[1:], F.when(outcome == "clean", 0)).otherwise(2)
    return F.when(outcome.isin("failed", "undecided"), 0).otherwise(code) if exit_zero else code


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Stored reports (verdict rows with target, started, ended, duration_ms, exit_zero) as one."""
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    extra = {"target": F.array_sort(F.collect_set("target")), "started": F.min("started"), "ended": F.max("ended"), "duration_ms": F.sum("duration_ms"), "exit_zero": F.bool_and("exit_zero")}
    have = [c.alias(n) for n, c in extra.items() if n in d.columns]
    base = suite_verdict(d)
    return base.crossJoin(d.agg(*have)) if have else base  # one row beside one row


def ci_cases(results: DataFrame, not_run: DataFrame, warnings: DataFrame, by: list[str], policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """(by…, case, result): a case for each assertion, each step that was not run, and each step's warning code."""
    s = known(F.col("status"), STATUSES, "unevaluable")
    lost = F.lit("skipped" if policy.accept_unevaluable else "error")
    a = results.select(*by, F.concat(F.lit("assertion "), F.coalesce(F.col("ordinal").cast("string"), F.lit("0"))).alias("case"), F.when(s == "failed", "failure").when(s == "unevaluable", lost).otherwise("passed").alias("result"))
    n = not_run.select(*by, F.lit("step").alias("case"), F.lit("skipped").alias("result"))
    w = bound_rows(warnings, by).withColumn("severity", severity(F.col("code"), policy))
    w = w.select(*by, F.concat(F.lit("warning "), "code").alias("case"), F.when(F.col("severity") == "error", "error").otherwise("passed").alias("result"))
    return a.unionByName(n).unionByName(w)


def ci_totals(cases: DataFrame, by: list[str]) -> DataFrame:
    r = F.col("result")
    return cases.groupBy(*by).agg(F.count("*").alias("tests"), F.count_if(r == "failure").alias("failures"), F.count_if(r == "error").alias("errors"), F.count_if(r == "skipped").alias("skipped"))


def reach(ran: Column, declared: Column) -> Column:
    return F.concat(ran.cast("string"), F.lit("/"), declared.cast("string"), F.lit(" steps ran"))


def badness(status: Column) -> Column:
    """failed, unevaluable, passed, planned, other."""
    return F.when(status == "failed", 0).when(status == "unevaluable", 1).when(status == "passed", 2).when(status == "planned", 3).otherwise(4)


def worst_first(results: DataFrame, *then: str) -> DataFrame:
    """The worst first; then by ordinal."""
    return results.orderBy(badness(F.col("status")), "ordinal", *then)
