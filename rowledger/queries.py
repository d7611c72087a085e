"""One query for each operator over fixtures derived from the tables, with its text for the oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import prelude, view
from .functions import jsondiff, values
from .operators import address, audit, capture, promote, select, series, summary, verdict
from .plans import check, tree
from .plans import runs as many_runs
from .sources import history, log, responses, scope
from .sources.scope import PRIMARY, Scope, TableScope
from .sources.scratch import shared_folder
from .streaming import changes as streaming

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = prelude(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


ORDERS = TableScope("orders", ("o_orderkey",), PRIMARY)
CONV = TableScope("conversations", ("conv_id", "turn"), PRIMARY)
LINES = TableScope("lineitem")
CUSTOMER = TableScope("customer", ("c_custkey",), PRIMARY, "c_mktsegment = 'BUILDING'", (), ("c_acctbal",))
XFER = TableScope("accounts", ("id",), PRIMARY)
V = "row_version"


def _orders(s: SparkSession, d: str, new: str = "orders_v1", t: TableScope = ORDERS) -> DataFrame:
    return capture.snapshot_diff(view(s, d, "orders_v0").drop(V), view(s, d, new).drop(V), t)


def _written(s: SparkSession, d: str, new: str = "orders_v1") -> DataFrame:
    return capture.written_since(view(s, d, "orders_v0"), view(s, d, new), ORDERS, V, 0)


def _conv(s: SparkSession, d: str) -> DataFrame:
    return capture.snapshot_diff(view(s, d, "conv_v0"), view(s, d, "conv_v1"), CONV)


def _lines(s: SparkSession, d: str) -> DataFrame:
    return capture.multiset_diff(view(s, d, "line_v0"), view(s, d, "line_v1"), LINES)


def _xfer(s: SparkSession, d: str) -> DataFrame:
    return capture.snapshot_diff(view(s, d, "xfer_v0"), view(s, d, "xfer_v1"), XFER)


def _money(c) -> object:
    return c.cast("decimal(38,2)")


#: The keyed diff of orders in SQL: d has every changed or written row.
_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_NAMED = ", ".join(f"case when b.{c} is distinct from a.{c} then '{c}' end" for c in _COLS)
_D = f"""with j as (select b.o_orderkey as bk, a.o_orderkey as ak, coalesce(a.o_orderkey, b.o_orderkey) as k, b.o_totalprice as bp, a.o_totalprice as ap, b.o_orderstatus as bs, a.o_orderstatus as st, coalesce(a.row_version, 0) as ver,
 case when b.o_orderkey is null then 'insert' when a.o_orderkey is null then 'delete' else 'update' end as kind,
 case when b.o_orderkey is null or a.o_orderkey is null then ['o_orderkey', {", ".join(f"'{c}'" for c in _COLS)}] else list_filter([{_NAMED}], lambda x: x is not null) end as cols
 from orders_v0 b full join orders_v1 a on a.o_orderkey = b.o_orderkey),
d as (select * from j where kind <> 'update' or len(cols) > 0),
w as (select * from j where kind = 'delete' or ver > 0) """
_CONV = """c as (select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) as turn, b.n as bn, a.n as an, case when b.conv_id is null then 'insert' when a.conv_id is null then 'delete' else 'update' end as kind
 from conv_v0 b full join conv_v1 a on a.conv_id = b.conv_id and a.turn = b.turn where b.conv_id is null or a.conv_id is null or b.n is distinct from a.n or b.role is distinct from a.role)"""


# -- capture ---------------------------------------------------------------------


@query(_D + "select kind, count(*) as n, cast(sum(coalesce(ap, 0) - coalesce(bp, 0)) as decimal(38,2)) as delta from d group by kind")
def diff_keyed_kinds(s: SparkSession, d: str) -> DataFrame:
    c = _orders(s, d)
    return c.groupBy("kind").agg(F.count("*").alias("n"), _money(F.sum(select.delta(c, "o_totalprice"))).alias("delta"))


@query(_D + "select kind, array_to_string(cols, ',') as columns, count(*) as n from d group by 1, 2")
def diff_keyed_columns(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).groupBy("kind", F.array_join("changed_columns", ",").alias("columns")).agg(F.count("*").alias("n"))


@query(_D + "select kind, array_to_string(cols, ',') as columns, count(*) as n from d group by 1, 2")
def diff_wide_rows(s: SparkSession, d: str) -> DataFrame:
    c = capture.wide_snapshot_diff(view(s, d, "orders_v0").drop(V), view(s, d, "orders_v1").drop(V), ORDERS)
    return c.groupBy("kind", F.array_join("changed_columns", ",").alias("columns")).agg(F.count("*").alias("n"))


@query("with " + _CONV + " select kind, count(*) as n, cast(sum(coalesce(an, 0) - coalesce(bn, 0)) as decimal(38,0)) as delta from c group by kind")
def diff_composite_key(s: SparkSession, d: str) -> DataFrame:
    c = _conv(s, d)
    return c.groupBy("kind").agg(F.count("*").alias("n"), F.sum(select.delta(c, "n")).cast("decimal(38,0)").alias("delta"))


@query("""with i as (select * from line_v1 except all select * from line_v0), g as (select * from line_v0 except all select * from line_v1)
 select 'insert' as kind, l_returnflag, l_linestatus, l_quantity, l_linenumber, count(*) as n from i group by all union all select 'delete', l_returnflag, l_linestatus, l_quantity, l_linenumber, count(*) from g group by all""")
def diff_keyless_multiset(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("kind", F.coalesce("after", "before").alias("r")).groupBy("kind", F.col("r.l_returnflag"), F.col("r.l_linestatus"), F.col("r.l_quantity"), F.col("r.l_linenumber")).agg(F.count("*").alias("n"))


@query(_D + "select kind, k as o_orderkey, array_to_string(cols, ',') as columns, true as has_write from w")
def written_since(s: SparkSession, d: str) -> DataFrame:
    c = _written(s, d)
    return c.select("kind", F.coalesce("after.o_orderkey", "before.o_orderkey").alias("o_orderkey"), F.array_join("changed_columns", ",").alias("columns"), "has_write")


@query(_D + "select k as o_orderkey from w where kind = 'update' and len(cols) = 0")
def noop_writes(s: SparkSession, d: str) -> DataFrame:
    return _written(s, d).where((F.col("kind") == "update") & (F.size("changed_columns") == 0)).select("after.o_orderkey")


@query("select 'insert' as kind, l_returnflag, count(*) as n, false as keyed from line_v1 where l_linenumber > 5 group by all")
def written_since_keyless(s: SparkSession, d: str) -> DataFrame:
    c = capture.written_since(view(s, d, "line_v0"), view(s, d, "line_v1"), LINES, "l_linenumber", 5)
    return c.groupBy("kind", F.col("after.l_returnflag").alias("l_returnflag"), F.col("key_token").isNotNull().alias("keyed")).agg(F.count("*").alias("n"))


@query("select o_orderkey from orders_v0 where o_orderkey not in (select o_orderkey from orders_v1)")
def departed_keys(s: SparkSession, d: str) -> DataFrame:
    return capture.departed_keys(view(s, d, "orders_v0"), view(s, d, "orders_v1"), ORDERS)


@query("select b.o_orderkey, b.o_totalprice from orders_v0 b join orders_v1 a on a.o_orderkey = b.o_orderkey and a.row_version > 0")
def before_images(s: SparkSession, d: str) -> DataFrame:
    keys = capture.written_rows(view(s, d, "orders_v1"), ORDERS, V, 0)
    return capture.before_images(view(s, d, "orders_v0"), keys, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""select b.c_custkey, case when a.c_custkey is null then 'deleted' else 'moved' end as cause from cust_v0 b left join cust_v1 a on a.c_custkey = b.c_custkey where b.c_mktsegment = 'BUILDING' and (a.c_custkey is null or a.c_mktsegment <> 'BUILDING')""")
def left_scope(s: SparkSession, d: str) -> DataFrame:
    after = view(s, d, "cust_v1")
    c = capture.snapshot_diff(view(s, d, "cust_v0").drop(V), after.drop(V), CUSTOMER)
    return capture.departure_cause(c, after, CUSTOMER).where("kind = 'left-scope'").select("before.c_custkey", "cause")


@query("""with e as (select a.c_custkey from cust_v1 a join cust_v0 b on a.c_custkey = b.c_custkey where a.c_mktsegment = 'BUILDING' and b.c_mktsegment <> 'BUILDING')
 select 'snapshot' as mode, 'insert' as kind, c_custkey from e union all select 'written', 'update', e.c_custkey from e join cust_v1 using (c_custkey) where row_version > 0""")
def entered_scope_modes(s: SparkSession, d: str) -> DataFrame:
    b, a = view(s, d, "cust_v0"), view(s, d, "cust_v1")
    x = capture.snapshot_diff(b.drop(V), a.drop(V), CUSTOMER).where("kind = 'insert'").select(F.lit("snapshot").alias("mode"), "kind", "after.c_custkey")
    w = capture.written_since(b, a, CUSTOMER, V, 0).where("kind = 'update' and before.c_mktsegment <> 'BUILDING'").select(F.lit("written").alias("mode"), "kind", "after.c_custkey")
    return x.unionByName(w)


@query("""select a.c_custkey, (b.c_acctbal is distinct from a.c_acctbal) as listed, cast(null as decimal(18,2)) as shown from cust_v0 b join cust_v1 a on a.c_custkey = b.c_custkey
 where a.c_mktsegment = 'BUILDING' and b.c_mktsegment = 'BUILDING' and b.c_acctbal is distinct from a.c_acctbal""")
def masked_diff(s: SparkSession, d: str) -> DataFrame:
    c = capture.snapshot_diff(view(s, d, "cust_v0").drop(V), view(s, d, "cust_v1").drop(V), CUSTOMER)
    return c.where("kind = 'update'").select("after.c_custkey", F.array_contains("changed_columns", "c_acctbal").alias("listed"), F.col("after.c_acctbal").alias("shown"))


@query(_D + "select k as o_orderkey, array_to_string(list_filter(cols, lambda x: x <> 'o_orderstatus'), ',') as visible from d where kind = 'update'")
def visible_columns(s: SparkSession, d: str) -> DataFrame:
    t = TableScope("orders", ("o_orderkey",), PRIMARY, None, ("o_orderstatus",))
    return _orders(s, d, t=t).where("kind = 'update'").select("after.o_orderkey", F.array_join("visible_columns", ",").alias("visible"))


_KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "conversations": ("conv_id", "turn")}


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n_rows, count(distinct ({', '.join(k)})) as distinct_keys, count(*) = count(distinct ({', '.join(k)})) as is_key from {t}" for t, k in _KEYS.items()))
def key_proof(s: SparkSession, d: str) -> DataFrame:
    each = [scope.prove_key(view(s, d, t), k).select(F.lit(t).alias("table_name"), F.col("rows").alias("n_rows"), "distinct_keys", "is_key") for t, k in _KEYS.items()]
    return reduce(DataFrame.unionByName, each)


@query("select 'baseline' as source, 'concurrent-writes-detected' as code, 'orders' as table_name, cast(count(*) as varchar) || ' rows changed while idle' as message from orders_idle where row_version > 0 having count(*) > 0")
def noise_probe(s: SparkSession, d: str) -> DataFrame:
    return capture.noise_warning({"orders": _written(s, d, "orders_idle")}).withColumnRenamed("table", "table_name")


@query(_D + ", " + _CONV + ", n as (select count(*) > 0 as noisy from orders_idle where row_version > 0) select kind, noisy as maybe_foreign, count(*) as n from d, n group by all union all select kind, false, count(*) from c group by kind")
def attribution(s: SparkSession, d: str) -> DataFrame:
    noise = capture.noise_tables({"orders": _written(s, d, "orders_idle")})
    both = capture.canonical(_orders(s, d)).unionByName(capture.canonical(_conv(s, d)))
    return capture.attribute(both, noise).groupBy("table", "kind", "maybe_foreign").agg(F.count("*").alias("n")).drop("table")


# -- logs ------------------------------------------------------------------------


@query(r"""select sequence, regexp_extract(line, '^table public\.(\w+): (\w+):', 1) as table_name, lower(regexp_extract(line, '^table public\.(\w+): (\w+):', 2)) as operation,
 regexp_extract(line, ' id\[bigint\]:(\S+)', 1) as id, nullif(regexp_extract(line, ' amount\[numeric\]:(\S+)', 1), '') as amount, replace(nullif(regexp_extract(line, ' note\[text\]:''(.*)''$', 1), ''), '''''', '''') as note from log_text""")
def log_decode(s: SparkSession, d: str) -> DataFrame:
    c = log.decode(view(s, d, "log_text"))
    return c.select("sequence", "table_name", "operation", F.col("columns")["id"].alias("id"), F.col("columns")["amount"].alias("amount"), F.col("columns")["note"].alias("note"))


@query("""with c as (select transaction_id, max(lsn) as c from log where is_commit group by 1) select sequence, log.transaction_id, lsn, operation from log left join c on c.transaction_id = log.transaction_id where c.c is null or c.c >= 1600""")
def commit_fence(s: SparkSession, d: str) -> DataFrame:
    return log.commit_fence(view(s, d, "log"), 1600).select("sequence", "transaction_id", "lsn", "operation")


def _mutations(s: SparkSession, d: str) -> tuple[DataFrame, Scope]:
    sc = Scope({"accounts": TableScope("accounts", ("id",), PRIMARY)}, False, "fixed")
    rec = view(s, d, "log").withColumn("columns", F.create_map(F.lit("id"), F.col("id").cast("string")))
    return log.mutation_list(rec, sc, {"accounts": ["id"]}), sc


@query("""select row_number() over (order by sequence) - 1 as sequence, transaction_id, table_name, operation, cast(id as varchar) as key, substr(sha256('fixed{"id":"' || cast(id as varchar) || '"}'), 1, 24) as key_token from log where table_name = 'accounts'""")
def mutation_list(s: SparkSession, d: str) -> DataFrame:
    return _mutations(s, d)[0].withColumnRenamed("table", "table_name")


@query("""with t as (select transaction_id, min(sequence) as f from log group by 1) select transaction_id, row_number() over (order by f) as label from t""")
def transaction_labels(s: SparkSession, d: str) -> DataFrame:
    return summary.transaction_labels(view(s, d, "log"))


_NET = """n as (select id, arg_min(operation, sequence) as first_op, arg_max(operation, sequence) as last_op, count(*) as writes, arg_max(amount, sequence) as amt from log where table_name = 'accounts' group by id),
 net as (select id, case when first_op <> 'insert' and last_op <> 'delete' then 'update' when last_op <> 'delete' then 'insert' else 'delete' end as kind, first_op, last_op, writes, case when last_op <> 'delete' then amt end as amount from n where first_op <> 'insert' or last_op <> 'delete')"""


@query("with " + _NET + " select * from net")
def log_net_view(s: SparkSession, d: str) -> DataFrame:
    return capture.log_net_view(view(s, d, "log").where("table_name = 'accounts'"), ["id"], ["amount"])


@query("select 'log' as source, 'reduced-fidelity' as code, 'other' as table_name, 'written in the log, absent from the net view' as message from log where table_name = 'other' having count(*) > 0")
def log_scan_crosscheck(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "log").withColumnRenamed("table_name", "table")
    net = log_net_view(s, d).select(F.lit("accounts").alias("table"))
    return log.cross_check(m, net).withColumnRenamed("table", "table_name")


@query("""select 'log' as source, 'reduced-fidelity' as code, cast(null as varchar) as table_name, cast(count(*) as varchar) || ' lines could not be read, first: ' || arg_min(x, sequence) as message from (select sequence, 'x' || line as x from log_text where sequence % 7 = 3)""")
def log_problems(s: SparkSession, d: str) -> DataFrame:
    bad = view(s, d, "log_text").withColumn("line", F.when(F.col("sequence") % 7 == 3, F.concat(F.lit("x"), "line")).otherwise(F.col("line")))
    return log.problem_warning(log.decode(bad)).withColumnRenamed("table", "table_name")


@query("select 'log' as source, 'scope-truncated' as code, cast(null as varchar) as table_name, 'the log ends before the window does' as message from log having max(lsn) < 100000000")
def late_log(s: SparkSession, d: str) -> DataFrame:
    return log.late_log_warning(view(s, d, "log"), 100000000).withColumnRenamed("table", "table_name")


# -- selections --------------------------------------------------------------------


def _selected(which: str, sql_kind: str) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        return select.of_kind(_orders(s, d), which).select(F.coalesce("after.o_orderkey", "before.o_orderkey").alias("o_orderkey"), "kind")

    f.__name__ = f"select_{which}"
    query(_D + f"select k as o_orderkey, kind from d where kind = '{sql_kind}'")(f)


for _which, _kind in (("inserted", "insert"), ("updated", "update"), ("deleted", "delete")):
    _selected(_which, _kind)


def _set(s: SparkSession, d: str, detection: str = capture.VALUE) -> capture.ChangeSet:
    tables = {"orders": ORDERS, "conversations": CONV, "accounts": XFER}
    frames = {"orders": _orders(s, d) if detection == capture.VALUE else _written(s, d), "conversations": _conv(s, d), "accounts": _xfer(s, d)}
    now = {"orders": view(s, d, "orders_v1").drop(V), "conversations": view(s, d, "conv_v1"), "accounts": view(s, d, "xfer_v1")}
    return capture.ChangeSet(frames, Scope(tables), detection, capture.NET, capture.warn(s), None, now)


@query(_D + ", " + _CONV + " select 'orders' as table_name, kind, count(*) as n from d group by kind union all select 'conversations', kind, count(*) from c group by kind")
def changes_except(s: SparkSession, d: str) -> DataFrame:
    return select.everything(_set(s, d), "changes", ("accounts",)).groupBy(F.col("table").alias("table_name"), "kind").agg(F.count("*").alias("n"))


@query(_D + ", r as (select k, kind, coalesce(st, bs) as st from d union all select o_orderkey, 'unchanged', o_orderstatus from orders_v1 where o_orderkey not in (select k from d)) select kind, count(*) as n from r where st = 'X' group by kind")
def rows_union_current(s: SparkSession, d: str) -> DataFrame:
    return select.rows(_set(s, d), "orders", {"o_orderstatus": "X"})[0].groupBy("kind").agg(F.count("*").alias("n"))


@query(_D + "select k as o_orderkey, kind from d where case when ak is not null then st else bs end = 'X' and case when ak is not null then ap else bp end is not null")
def where_after_or_before(s: SparkSession, d: str) -> DataFrame:
    return select.where(_orders(s, d), {"o_orderstatus": "X"}).select(F.coalesce("after.o_orderkey", "before.o_orderkey").alias("o_orderkey"), "kind")


@query(_D + "select 'before' as side, count(*) as n, cast(sum(bp) as decimal(38,2)) as total from d where bk is not null union all select 'after', count(*), cast(sum(ap) as decimal(38,2)) from d where ak is not null")
def images(s: SparkSession, d: str) -> DataFrame:
    c = _orders(s, d)
    part = lambda f, side: f(c, "o_totalprice").agg(F.count("*").alias("n"), _money(F.sum("value")).alias("total")).withColumn("side", F.lit(side))
    return part(select.before, "before").unionByName(part(select.after, "after"))


# -- typed values -------------------------------------------------------------------


@query("""select event_id, event_id % 3 = 2 as json_same, (case when event_id % 2 = 0 then 't' else 'false' end) in ('t') as bool_true, true as number_same, upper(before_j) = before_j as text_same from json_pairs""")
def predicate_typed(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "json_pairs")
    flag = F.when(F.col("event_id") % 2 == 0, " T").otherwise("false")
    number = F.concat(F.col("event_id").cast("string"), F.lit(".10"))
    return p.select(
        "event_id", values.eq_typed(F.col("before_j"), F.col("after_j"), "jsonb").alias("json_same"), values.eq_typed(flag, F.lit("true"), "bool").alias("bool_true"),
        values.eq_typed(number, F.concat(F.lit("+"), F.col("event_id").cast("string"), F.lit(".1")), "numeric").alias("number_same"), values.eq_typed(F.upper("before_j"), F.col("before_j"), "text").alias("text_same"),
    )


@query("select event_id, event_id % 3 = 2 as same from json_pairs")
def json_equal(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "json_pairs").select("event_id", values.eq_typed(F.col("before_j"), F.col("after_j"), "json").alias("same"))


@query("""select event_id, unnest(case when event_id % 3 = 0 then ['a.x', 'a.y[0]', 'a.y[1]'] when event_id % 3 = 1 then ['z'] else [] end) as path, unnest(case when event_id % 3 = 0 then ['1', '1', '2'] when event_id % 3 = 1 then ['0'] else [] end) as after_leaf, 'added' as mark, cast(null as varchar) as before_leaf from json_pairs""")
def json_leaf_diff(s: SparkSession, d: str) -> DataFrame:
    return jsondiff.leaf_diff(view(s, d, "json_pairs"), ["event_id"], "before_j", "after_j")


@query("""select event_id, 'n' as path, '0.12345678901234567890' || cast(event_id as varchar) as before_leaf, '0.12345678901234567890' || cast(event_id + 1 as varchar) as after_leaf, 'changed' as mark from events where event_id % 3 = 0""")
def json_leaf_digits(s: SparkSession, d: str) -> DataFrame:
    """Digits beyond those of a double tell values apart, spellings of one number do not, and depth is no limit."""
    e = view(s, d, "events").select("event_id")
    deep = F.when(F.col("event_id") % 997 == 0, 3000).otherwise(F.col("event_id") % 5).cast("int")
    text = lambda n, hundred: F.concat(F.lit('{"n": 0.12345678901234567890'), n.cast("string"), F.lit(f', "e": {hundred}, "d": '), F.repeat(F.lit("["), deep), F.lit("1"), F.repeat(F.lit("]"), deep), F.lit("}"))
    more = F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 1).otherwise(F.col("event_id"))
    pairs = e.select("event_id", text(F.col("event_id"), "1e2").alias("b"), text(more, "100.0").alias("a"))
    return jsondiff.leaf_diff(pairs, ["event_id"], "b", "a")


@query("""select event_id, '{' || cast(len(json_keys(after_j)) as varchar) || ' keys} ' || array_to_string(list_sort(json_keys(after_j))[1:3], ', ') || case when len(json_keys(after_j)) > 3 then '…' else '' end as summary from json_pairs""")
def json_summary(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "json_pairs").select("event_id", values.json_summary(F.col("after_j")).alias("summary"))


# -- assertions ---------------------------------------------------------------------


@query("select cast(sum(a.balance - b.balance) as decimal(38,2)) as total, count(*) as n from xfer_v0 b join xfer_v1 a on a.id = b.id where a.balance <> b.balance")
def sum_delta_balanced(s: SparkSession, d: str) -> DataFrame:
    c = _xfer(s, d)
    return c.agg(_money(F.try_sum(select.delta(c, "balance"))).alias("total"), F.count("*").alias("n"))


@query(_D + "select cast(min(ap - bp) as decimal(38,2)) as lo, cast(max(ap - bp) as decimal(38,2)) as hi from d where kind = 'update'")
def min_max_delta(s: SparkSession, d: str) -> DataFrame:
    c = select.of_kind(_orders(s, d), "updated")
    return c.agg(_money(F.min(select.delta(c, "o_totalprice"))).alias("lo"), _money(F.max(select.delta(c, "o_totalprice"))).alias("hi"))


@query(_D + "select count(*) as n from d where kind = 'update' and st = 'X'")
def count_where(s: SparkSession, d: str) -> DataFrame:
    return select.where(select.of_kind(_orders(s, d), "updated"), {"o_orderstatus": "X"}).agg(F.count("*").alias("n"))


def _batch() -> list[check.Expr]:
    k = check
    return [
        k.count(k.inserted("orders")).gt(0), k.sum_(k.delta(k.changes("accounts"), "balance")).eq("0.00"), k.count(k.updated("orders")).eq(1), k.is_empty(k.deleted("accounts")),
        k.any_(k.inserted("orders")) & ~k.is_empty(k.inserted("conversations")), k.count(k.inserted("ordres")).eq(0), k.max_(k.delta(k.rows("orders"), "o_totalprice")).le(k.var("limit")), k.atomic(k.changes("orders")), k.min_(k.delta(k.inserted("accounts"), "balance")).ge(0),
    ]


@query(_D + """select 0 as ordinal, case when (select count(*) from d where kind = 'insert') > 0 then 'passed' else 'failed' end as status, cast((select count(*) from d where kind = 'insert') as varchar) as actual, '0' as expected
 union all select 1, 'passed', '0.00', '0.00' union all select 2, 'unevaluable', null, null union all select 3, 'passed', 'true', 'true'
 union all select 4, 'failed', 'false', 'true' union all select 5, 'unevaluable', null, null
 union all select 6, 'unevaluable', null, null union all select 7, 'unevaluable', null, null union all select 8, 'unevaluable', null, null""")
def assertion_batch(s: SparkSession, d: str) -> DataFrame:
    return check.evaluate(s, _set(s, d), _batch(), {}).select("ordinal", "status", "actual", "expected")


@query(_D + """, u as (select count(*) as n from w where kind = 'update') select 0 as ordinal, 'failed' as status, cast(n as varchar) as actual, '1' as expected, cast(null as varchar) as reason from u
 union all select 1, 'passed', 'true', 'true', null union all select 2, 'passed', 'true', 'true', null""")
def assertion_batch_written(s: SparkSession, d: str) -> DataFrame:
    k = check
    e = [k.count(k.updated("orders")).eq(1), k.has_write(k.changes("orders")), k.is_empty(k.changes("*", ("orders", "conversations", "accounts")))]
    return check.evaluate(s, _set(s, d, capture.WRITE), e).select("ordinal", "status", "actual", "expected", "reason")


@query("with a as (select * from log where table_name = 'accounts') select id, count(*) as writes, count(distinct transaction_id) = 1 as atomic from a group by id")
def atomic_groups(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "log").where("table_name = 'accounts'").groupBy("id").agg(F.count("*").alias("writes"), (F.count_distinct("transaction_id") == 1).alias("atomic"))


@query("with " + _NET + " select 0 as ordinal, 'passed' as status, cast(count(*) as varchar) as actual from log where table_name = 'accounts' and id in (select id from net) union all select 1, case when count(distinct transaction_id) = 1 then 'passed' else 'failed' end, case when count(distinct transaction_id) = 1 then 'true' else 'false' end from log where table_name = 'accounts' and id in (select id from net)")
def write_counts(s: SparkSession, d: str) -> DataFrame:
    m, sc = _mutations(s, d)
    c = _accounts(log_net_view(s, d))
    cs = capture.ChangeSet({"accounts": c}, sc, capture.WRITE, capture.TRANSACTIONAL, capture.warn(s), m)
    k = check
    return check.evaluate(s, cs, [k.write_count(k.changes("accounts")).ge(0), k.atomic(k.changes("accounts"))]).select("ordinal", "status", "actual")


@query("select 0 as ordinal, 'unevaluable' as status, 'rows of lineitem have no identity: updates and departures cannot be told' as reason union all select 1, 'passed', null union all select 2, 'unevaluable', 'rows of lineitem have no identity: updates and departures cannot be told' union all select 3, 'failed', null")
def guard_blind_tables(s: SparkSession, d: str) -> DataFrame:
    blind = TableScope("lineitem", departures_observable=False)
    frames = {"lineitem": capture.written_since(view(s, d, "line_v0"), view(s, d, "line_v1"), blind, "l_linenumber", 5), "orders": _written(s, d)}
    cs = capture.ChangeSet(frames, Scope({"lineitem": blind, "orders": ORDERS}), capture.WRITE, capture.NET, capture.warn(s))
    k = check
    e = [k.count(k.deleted("lineitem")).eq(0), k.count(k.inserted("lineitem")).gt(0), k.is_empty(k.changes()), k.is_empty(k.changes("*", ("lineitem",)))]
    return check.evaluate(s, cs, e).select("ordinal", "status", "reason")


@query("select 0 as ordinal, 'unevaluable' as status, 'customer.c_acctbal is masked' as reason union all select 1, 'unevaluable', 'customer.c_acctbal is masked' union all select 2, 'unevaluable', 'needs write detection: a write that changes no value is not seen' union all select 3, 'unevaluable', 'not all rows were read'")
def guard_masked(s: SparkSession, d: str) -> DataFrame:
    b, a = view(s, d, "cust_v0").drop(V), view(s, d, "cust_v1").drop(V)
    cs = capture.ChangeSet({"customer": capture.snapshot_diff(b, a, CUSTOMER)}, Scope({"customer": CUSTOMER}), capture.VALUE, capture.NET, capture.warn(s), None, {"customer": a})
    k = check
    e = [k.sum_(k.delta(k.changes("customer"), "c_acctbal")).eq(0), k.count(k.inserted("customer").where(c_acctbal=1)).eq(0), k.count(k.updated("customer")).eq(0), k.count(k.rows("customer")).gt(0)]
    return check.evaluate(s, cs, e, rows_cap=5).select("ordinal", "status", "reason")


@query("""select step_no, json_extract_string(body, '$.id') as id, case when json_extract_string(body, '$.meta.k') is null then 'null' else 'value' end as k_state, json_extract_string(body, '$.meta.k') as k, 'unevaluable' as deep_state from responses""")
def response_paths(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "responses")
    k = responses.read_path(F.col("body"), "meta.k")
    return r.select("step_no", responses.read_path(F.col("body"), "id")["value"].alias("id"), k["state"].alias("k_state"), k["value"].alias("k"), responses.read_path(F.col("body"), "nothing.here")["state"].alias("deep_state"))


@query("select step_no, 'user' as name, json_extract_string(body, '$.id') as value from responses")
def variable_capture(s: SparkSession, d: str) -> DataFrame:
    return responses.capture_variables(view(s, d, "responses"), {"user": "id", "none": "nowhere"}, ["step_no"])


@query("select step_no, case when step_no % 5 = 0 then case when status = 201 then 'passed' else 'failed' end when status < 400 then 'passed' else 'failed' end as status, cast(status as varchar) as actual, case when step_no % 5 = 0 then '201' else '< 400' end as expected from responses")
def response_status(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "responses")
    steps = r.select("step_no", F.when(F.col("step_no") % 5 == 0, 201).alias("expect_status"))
    return responses.status_check(r, steps, ["step_no"]).select("step_no", "status", "actual", "expected")


# -- series --------------------------------------------------------------------------

_SERIES = """g as (select i.id, s.step_no from (select distinct id from series_obs) i cross join series_steps s), p as (select id, step_no, count(*) as n, max(v) as v from series_obs group by 1, 2),
 o as (select g.id, g.step_no, p.n, case when p.n = 1 then p.v end as own from g left join p on p.id = g.id and p.step_no = g.step_no),
 q as (select *, last_value(own ignore nulls) over w as lv, last_value(case when own is not null then step_no end ignore nulls) over w as ls from o window w as (partition by id order by step_no rows between unbounded preceding and 1 preceding)),
 sr as (select id, step_no, case when n > 1 then 'unevaluable' when own is not null then 'observed' when lv is not null then 'carried' else 'unobserved' end as state, own, lv, ls from q),
 srs as (select id, step_no, state, case state when 'observed' then own when 'carried' then lv end as value, case state when 'observed' then step_no when 'carried' then ls end as since from sr)"""


def _series(s: SparkSession, d: str) -> DataFrame:
    return series.observe(view(s, d, "series_steps"), view(s, d, "series_obs"), ["id"])


@query("with " + _SERIES + " select * from srs")
def series_carry(s: SparkSession, d: str) -> DataFrame:
    return _series(s, d)


@query("""with p as (select id, step_no, count(*) as n, max(v) as v from series_obs group by 1, 2), s as (select *, case when n = 1 then v end as own from p where n > 1 or v is not null),
 q as (select *, lead(step_no) over (partition by id order by step_no) as nx, last_value(own ignore nulls) over w as lv, last_value(case when own is not null then step_no end ignore nulls) over w as ls from s window w as (partition by id order by step_no rows between unbounded preceding and current row))
 select id, cast(null as bigint) as "after", step_no as at, cast(null as bigint) as before, case when n > 1 then 'unevaluable' else 'observed' end as state, own as value, case when own is not null then step_no end as since from q
 union all select id, step_no, null, nx, case when lv is not null then 'carried' else 'unobserved' end, lv, ls from q
 union all select id, null, null, min(case when n > 1 or v is not null then step_no end), 'unobserved', null, null from p group by id""")
def series_intervals(s: SparkSession, d: str) -> DataFrame:
    return series.intervals(view(s, d, "series_obs"), ["id"])


@query("with " + _SERIES + """, x as (select *, case when state in ('observed', 'carried') then state else 'gap' end as s from srs), y as (select *, lag(s) over (partition by id order by step_no) as b, lag(step_no) over (partition by id order by step_no) as bstep, lag(value) over (partition by id order by step_no) as bv from x),
 z as (select *, sum(case when b is null or b <> s then 1 else 0 end) over (partition by id order by step_no rows unbounded preceding) as seg from y),
 u as (select id, seg as segment, s as state, step_no, value from z where s <> 'gap' union all select id, seg, s, bstep, bv from z where s <> 'gap' and b <> s and b <> 'gap'),
 k as (select id, segment from u group by 1, 2 having count(*) > 1) select u.id, cast(u.segment as bigint) as segment, u.state, u.step_no, cast(u.value as decimal(38,10)) as value from u join k on k.id = u.id and k.segment = u.segment""")
def series_segments(s: SparkSession, d: str) -> DataFrame:
    return series.segments(_series(s, d), ["id"])


@query("with " + _SERIES + ", e as (select id, cast(min(value) as double) as lo, cast(max(value) as double) as hi from srs where state in ('observed', 'carried') group by id) select id, case when lo = hi then lo - case when lo = 0 then 1 else abs(lo) / 2 end else lo end as lo, case when lo = hi then hi + case when lo = 0 then 1 else abs(lo) / 2 end else hi end as hi from e")
def series_extent(s: SparkSession, d: str) -> DataFrame:
    return series.extent(series.intervals(view(s, d, "series_obs"), ["id"]), ["id"])


@query("with " + _SERIES + " select 'nobody' as series, 'matched no row' as problem where (select count(*) from srs) > 0 union all select 'bad', 'no column x'")
def series_panel(s: SparkSession, d: str) -> DataFrame:
    none = view(s, d, "series_obs").where("id = 0").select("id", "step_no").distinct().withColumn("v", F.lit(None).cast("decimal(12,2)"))
    lines = {"all": _series(s, d), "nobody": series.observe(view(s, d, "series_steps"), none, ["id"])}
    return series.panel(lines, {"bad": "no column x"})[1]


# -- summaries -----------------------------------------------------------------------


@query(_D + "select 'orders' as table_name, count(*) filter (where kind = 'insert') as inserted, count(*) filter (where kind = 'update') as updated, count(*) filter (where kind = 'delete') as deleted, count(*) filter (where kind = 'update' and len(cols) = 0) as written_no_visible_change from w")
def change_summary(s: SparkSession, d: str) -> DataFrame:
    return summary.change_summary(_written(s, d)).withColumnRenamed("table", "table_name")


@query("with " + _NET + " select sequence, id from log where table_name = 'accounts' and id not in (select id from net)")
def ghost_writes(s: SparkSession, d: str) -> DataFrame:
    return summary.ghost_writes(view(s, d, "log").where("table_name = 'accounts'"), log_net_view(s, d), ["id"]).select("sequence", "id")


@query("select id, count(*) as writes from log where table_name = 'accounts' group by id having count(*) > 1")
def repeated_writes(s: SparkSession, d: str) -> DataFrame:
    return summary.repeated_writes(view(s, d, "log").where("table_name = 'accounts'"), ["id"])


@query("with " + _NET + ", a as (select * from log where table_name = 'accounts') select (select count(*) from a) as total, (select count(distinct transaction_id) from a) as transactions, (select count(*) from a where id not in (select id from net)) as without_net_change, (select count(*) from n where writes > 1) as repeated, (select count(distinct transaction_id) from a)::varchar || ' transactions; ' || (select count(*) from n where writes > 1)::varchar || ' rows written more than once' || (select case when count(*) > 0 then '; ' || count(*)::varchar || ' writes without net change' else '' end from a where id not in (select id from net)) as story")
def write_order_summary(s: SparkSession, d: str) -> DataFrame:
    return summary.write_order_summary(view(s, d, "log").where("table_name = 'accounts'"), log_net_view(s, d), ["id"])


@query(_D + ", " + _CONV + """, x as (select 'orders' as t, cast(k as varchar) as key, k as o, kind from d union all select 'conversations', cast(conv_id as varchar) || '|' || cast(turn as varchar), conv_id * 1000 + turn, kind from c), r as (select *, row_number() over (partition by t order by o) as rn, count(*) over (partition by t) as n from x)
 select t as table_name, key, kind, rn as rank, greatest(n - 3, 0) as more_rows, 0 as more_tables from r where rn <= 3""")
def top_rows_per_table(s: SparkSession, d: str) -> DataFrame:
    o, c = _orders(s, d), _conv(s, d)
    key = lambda f, k: values.key_label([F.coalesce(f"after.{x}", f"before.{x}") for x in k])
    a = o.select("table", key(o, ["o_orderkey"]).alias("key"), F.coalesce("after.o_orderkey", "before.o_orderkey").alias("o"), "kind")
    b = c.select("table", key(c, ["conv_id", "turn"]).alias("key"), (F.coalesce("after.conv_id", "before.conv_id") * 1000 + F.coalesce("after.turn", "before.turn")).alias("o"), "kind")
    return summary.top_rows(a.unionByName(b), ["o"], 3, 6).select(F.col("table").alias("table_name"), "key", "kind", "rank", "more_rows", "more_tables")


@query(_D + "select k as o_orderkey, array_to_string(cols[1:2], ', ') || case when len(cols) > 2 then ' +' || cast(len(cols) - 2 as varchar) || ' more' else '' end as shown from d")
def first_columns(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).select(F.coalesce("after.o_orderkey", "before.o_orderkey").alias("o_orderkey"), summary.first_columns(F.col("changed_columns"), 2).alias("shown"))


@query(_D + """, a as (select 'orders:' || kind || ':' || cast(k as varchar) as r, array_to_string(list_sort(cols), ',') as columns_a from d), b as (select 'orders:' || kind || ':' || cast(k as varchar) as r, array_to_string(list_sort(cols), ',') as columns_b from w)
 select coalesce(a.r, b.r) as row_name, columns_a, columns_b from a full join b on a.r = b.r where columns_a is distinct from columns_b""")
def capture_divergence(s: SparkSession, d: str) -> DataFrame:
    return summary.reconcile(summary.shape(_orders(s, d)), summary.shape(_written(s, d))).withColumnRenamed("row", "row_name")


# -- verdicts ------------------------------------------------------------------------

_STEP = """sx as (select run_id, scenario_id, step_no, case when step_status = 'errored' then 'errored' when step_status = 'skipped' then 'not-run' when a_status = 'failed' then 'failed' when w_code = 'scope-truncated' or a_status = 'unevaluable' then 'undecided' else 'passed' end as outcome, a_status, w_code from runs)"""
_RUN = """rv as (select run_id, scenario_id, count(*) as steps, count(*) filter (where outcome = 'errored') as e, count(*) filter (where outcome = 'failed') as f, count(*) filter (where outcome = 'undecided') as u, count(*) filter (where outcome = 'not-run') as nr, count(*) filter (where w_code = 'scope-truncated') as blind, count(*) filter (where a_status = 'failed') as af, count(*) filter (where a_status = 'unevaluable') as au from sx group by 1, 2),
 ro as (select *, case when e > 0 then 'errored' when f > 0 or af > 0 then 'failed' when u > 0 or blind > 0 or au > 0 then 'undecided' else 'clean' end as outcome, case when nr > 0 or blind > 0 then 'bounded' else 'full' end as proves from rv)"""


def _steps(s: SparkSession, d: str, policy: verdict.Policy = verdict.Policy()) -> DataFrame:  # noqa: B008
    r = view(s, d, "runs")
    by = ["run_id", "scenario_id", "step_no"]
    a = r.select(*by, F.col("a_status").alias("status"), F.lit(0).alias("ordinal"))
    w = r.where("w_code is not null").select(*by, F.col("w_code").alias("code"), F.lit("orders").alias("table"))
    return verdict.step_outcomes(r.select(*by, "step_status"), a, w, by, policy)


def _runs(s: SparkSession, d: str) -> DataFrame:
    return verdict.run_verdicts(_steps(s, d), ["run_id", "scenario_id"])


@query("with " + _STEP + " select run_id, step_no, outcome from sx")
def step_outcomes(s: SparkSession, d: str) -> DataFrame:
    return _steps(s, d).select("run_id", "step_no", "outcome")


@query("select run_id, count(*) as total, count(*) filter (where a_status = 'passed') as passed, count(*) filter (where a_status = 'failed') as failed, count(*) filter (where a_status = 'unevaluable') as unevaluable, count(*) filter (where a_status = 'passed-as-refused') as passed_as_refused from runs group by run_id")
def assertion_counts(s: SparkSession, d: str) -> DataFrame:
    return verdict.assertion_counts(view(s, d, "runs"), ["run_id"], "a_status")


@query("select w_code as code, case when w_code = 'scope-truncated' then 'error' else 'warning' end as natural, 'error' as strict, w_code = 'degraded-row-identity' as escalated, count(*) as n from runs where w_code is not null group by 1")
def warning_severity(s: SparkSession, d: str) -> DataFrame:
    w = view(s, d, "runs").where("w_code is not null").select(F.col("w_code").alias("code"))
    e = verdict.weigh_warnings(w, verdict.Policy(warnings="strict"))
    return e.withColumn("natural", verdict.severity(F.col("code"))).groupBy("code", "natural", F.col("severity").alias("strict"), "escalated").agg(F.count("*").alias("n"))


@query("with " + _STEP + ", " + _RUN + " select run_id, steps, outcome, proves, case outcome when 'clean' then 0 when 'failed' then 1 when 'errored' then 2 else 3 end as exit_code from ro")
def run_verdicts(s: SparkSession, d: str) -> DataFrame:
    return _runs(s, d).select("run_id", "steps", "outcome", "proves", verdict.exit_code(F.col("outcome")).alias("exit_code"))


_SUITE = "case max(case outcome when 'clean' then 1 when 'undecided' then 2 when 'failed' then 3 else 4 end) when 1 then 'clean' when 2 then 'undecided' when 3 then 'failed' else 'errored' end as outcome, count(*) as runs, cast(sum(steps) as bigint) as steps, cast(sum(steps) as bigint) as assertions, cast(sum(nr) as bigint) as not_run_steps, case when bool_and(nr = 0) then 'full' when bool_and(nr > 0) then 'partial' else 'mixed' end as coverage, case when bool_or(proves = 'bounded') then 'bounded' else 'full' end as proves"


@query("with " + _STEP + ", " + _RUN + f" select scenario_id, {_SUITE} from ro group by scenario_id")
def suite_verdict(s: SparkSession, d: str) -> DataFrame:
    return verdict.suite_verdict(_runs(s, d), ["scenario_id"])


@query("with " + _STEP + ", " + _RUN + f" select {_SUITE}, cast(sum(run_id) as bigint) as duration_ms from ro")
def merge_shards(s: SparkSession, d: str) -> DataFrame:
    r = _runs(s, d).withColumn("duration_ms", F.col("run_id"))
    return verdict.merge_shards([r.where("scenario_id < 2"), r.where("scenario_id >= 2")])


@query("with " + _STEP + ", " + _RUN + ", b as (select 'unreached' as bound, count(*) filter (where nr > 0) as k, count(*) as n from ro union all select 'warnings', count(*) filter (where blind > 0), count(*) from ro) select bound, case when k = n then bound else bound || ' in ' || cast(k as varchar) || ' of ' || cast(n as varchar) || ' datasets' end as sentence from b where k > 0")
def suite_bounds(s: SparkSession, d: str) -> DataFrame:
    return verdict.suite_bounds(_runs(s, d))


@query("""with c as (select run_id, case a_status when 'failed' then 'failure' when 'unevaluable' then 'error' else 'passed' end as r from runs where step_status <> 'skipped' union all select run_id, 'skipped' from runs where step_status = 'skipped' union all select distinct run_id, case when w_code = 'scope-truncated' then 'error' else 'passed' end from (select distinct run_id, step_no, w_code from runs where w_code is not null) where false),
 w as (select run_id, case when w_code = 'scope-truncated' then 'error' else 'passed' end as r from runs where w_code is not null), a as (select * from c union all select * from w)
 select run_id, count(*) as tests, count(*) filter (where r = 'failure') as failures, count(*) filter (where r = 'error') as errors, count(*) filter (where r = 'skipped') as skipped from a group by run_id""")
def ci_cases(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "runs")
    by = ["run_id", "step_no"]
    a = r.where("step_status <> 'skipped'").select(*by, F.col("a_status").alias("status"), F.lit(0).alias("ordinal"))
    w = r.where("w_code is not null").select(*by, F.col("w_code").alias("code"), F.lit("orders").alias("table"))
    return verdict.ci_totals(verdict.ci_cases(a, r.where("step_status = 'skipped'").select(*by), w, by), ["run_id"])


@query("select r.run_id, r.step_no + 1 as step_no, 'not-run' as outcome from runs r left join runs q on q.run_id = r.run_id and q.step_no = r.step_no + 1 where q.run_id is null")
def unreached_steps(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "runs")
    return verdict.unreached(r.select("run_id", (F.col("step_no") + 1).alias("step_no")), r, ["run_id", "step_no"])


@query("select scenario_id, max(run_id) as run_id from runs group by scenario_id")
def latest_run(s: SparkSession, d: str) -> DataFrame:
    return history.latest(view(s, d, "runs"), ["scenario_id"]).select("scenario_id", "run_id").distinct()


@query("with a as (select distinct scenario_id, run_id from runs), b as (select *, row_number() over (partition by scenario_id order by run_id desc) as age from a) select scenario_id, run_id from b where age > 2")
def prune_runs(s: SparkSession, d: str) -> DataFrame:
    return history.prune_plan(view(s, d, "runs"), 2, ["scenario_id"])


@query("select run_id, case when run_id % 3 = 2 then 'written by a newer version' else 'written by an older version' end as reason from (select distinct run_id from runs) where run_id % 3 <> 1")
def history_gate(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "runs").select("run_id").distinct().withColumn("schema_major", (F.col("run_id") % 3).cast("int"))
    return history.gate(r)[1].select("run_id", "reason")


# -- promotion, audit, addresses -------------------------------------------------------


@query(_D + "select 'count(' || case kind when 'insert' then 'inserted' else 'deleted' end || '(orders)) == ' || cast(count(*) as varchar) as expression from d where kind <> 'update' group by kind union all select 'count(inserted(orders, o_orderstatus = \"' || st || '\")) == ' || cast(count(*) as varchar) from d where kind = 'insert' group by st")
def promote_counts(s: SparkSession, d: str) -> DataFrame:
    c = _orders(s, d)
    return promote.candidates([promote.table_counts(c), promote.discriminator_counts(c, (), ("o_orderstatus",))]).select("expression")


@query(_D + ", p as (select cast(k as varchar) as k, ap - bp as dp, st, list_contains(cols, 'o_totalprice') as has_p, list_contains(cols, 'o_orderstatus') as has_s from d where kind = 'update') select 'delta(single(rows(orders, o_orderkey = \"' || k || '\")).o_totalprice) == \"' || regexp_replace(regexp_replace(cast(dp as varchar), '0+$', ''), '\\.$', '') || '\"' as expression from p where has_p union all select 'single(updated(orders, o_orderkey = \"' || k || '\")).after.o_orderstatus == \"' || st || '\"' from p where has_s")
def promote_deltas(s: SparkSession, d: str) -> DataFrame:
    return promote.update_candidates(_orders(s, d), ["o_orderkey"]).select("expression")


@query(_D + "select 'hasWrite(changes(orders, o_orderkey = \"' || cast(k as varchar) || '\")) == true' as expression, 'no value changed' as caveat from w where kind = 'update' and len(cols) = 0")
def promote_write_only(s: SparkSession, d: str) -> DataFrame:
    return promote.update_candidates(_written(s, d), ["o_orderkey"]).where("rule = 'write'").select("expression", "caveat")


@query(_D + "select 'sum(delta(orders.o_totalprice)) == \"' || regexp_replace(regexp_replace(cast(sum(ap - bp) as varchar), '0+$', ''), '\\.$', '') || '\"' as expression from d where kind = 'update' having count(*) >= 2 and count(*) filter (where bp <> ap) > 0 union all select 'sum(delta(accounts.balance)) == \"0\"' from xfer_v0 having count(*) > 1")
def promote_invariants(s: SparkSession, d: str) -> DataFrame:
    return promote.candidates([promote.invariants(_orders(s, d), keys=["o_orderkey"]), promote.invariants(_xfer(s, d), keys=["id"])]).select("expression")


def _catalog(s: SparkSession, d: str) -> DataFrame:
    return scope.catalog_columns(s, {t: s.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem", "customer")})


_AUDIT = """cols as (select unnest(['orders', 'orders', 'lineitem', 'customer']) as t, unnest(['o_totalprice', 'o_orderkey', 'l_quantity', 'c_acctbal']) as c),
 ut as (select distinct assertion_id, case when use_kind = 'except' then 'except-names-nothing' else 'unknown-table' end as problem, table_name as name, case table_name when 'ordres' then 'orders' when 'custmoer' then 'customer' end as suggestion from features where table_name in ('ordres', 'custmoer')),
 uc as (select distinct assertion_id, 'unknown-column-' || use_kind as problem, table_name || '.' || column_name as name, case when table_name = 'orders' and column_name = 'o_totalprise' then 'orders.o_totalprice' end as suggestion from features left join cols on t = table_name and c = column_name where table_name in ('orders', 'lineitem', 'customer') and column_name <> '*' and c is null)"""


@query("with " + _AUDIT + " select * from ut union all select * from uc")
def audit_names(s: SparkSession, d: str) -> DataFrame:
    return audit.audit(view(s, d, "features"), _catalog(s, d))


@query("with " + _AUDIT + " select problem, name, suggestion, count(*) as n from (select * from ut union all select * from uc) group by all")
def audit_panels(s: SparkSession, d: str) -> DataFrame:
    return audit.panel_audit(view(s, d, "features"), _catalog(s, d)).groupBy("problem", "name", "suggestion").agg(F.count("*").alias("n"))


@query("select distinct assertion_id, 'not-watched' as problem, 'lineitem' as name from features where table_name = 'lineitem' union all select distinct assertion_id, 'masked-column', 'orders.o_totalprice' from features where table_name = 'orders' and column_name = 'o_totalprice'")
def audit_watch_and_masks(s: SparkSession, d: str) -> DataFrame:
    f, c = view(s, d, "features"), _catalog(s, d)
    watched, masks = s.createDataFrame([("orders",), ("customer",)], "table string"), s.createDataFrame([("o_totalprice",)], "column string")
    return audit.not_watched(f, c, watched).unionByName(audit.masked_reads(f, masks, c))


_CANNOT = "select assertion_id, case when question = 'hasWrite' or (question = 'count' and selector_kind = 'changes') then {write} when question = 'atomic' then 'needs-transactions' when question in ('count', 'hasWrite') and selector_kind in ('changes', 'deleted') and table_name = 'lineitem' then 'rows-have-no-identity' end as problem, table_name as name from features"


def _cannot(s: SparkSession, d: str, detection: str) -> DataFrame:
    sc = Scope({"orders": ORDERS, "lineitem": TableScope("lineitem", departures_observable=False)}).frame(s)
    return audit.cannot_answer(view(s, d, "features"), sc, detection, capture.NET)


@query("select * from (" + _CANNOT.format(write="'needs-write-detection'") + ") where problem is not null")
def audit_capabilities(s: SparkSession, d: str) -> DataFrame:
    return _cannot(s, d, capture.VALUE)


@query("select * from (" + _CANNOT.replace("when question = 'hasWrite' or (question = 'count' and selector_kind = 'changes') then {write} ", "") + ") where problem is not null")
def audit_capabilities_written(s: SparkSession, d: str) -> DataFrame:
    return _cannot(s, d, capture.WRITE)


@query("select 'nothing-asserted' as problem from runs where a_status = 'nobody' having count(*) = 0 union all select 'nothing-asserted' from runs having count(*) = 0")
def audit_nothing_asserted(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "runs")
    return audit.nothing_asserted(r.where("a_status = 'nobody'")).unionByName(audit.nothing_asserted(r))


@query("""with n as (select distinct scenario_id, role as name, step_no from runs where step_no > 0), c as (select distinct scenario_id, role as name, step_no as at from runs where a_status <> 'passed'),
 j as (select n.scenario_id, n.name, n.step_no, max(case when c.at < n.step_no then c.at end) as b, min(case when c.at >= n.step_no then c.at end) as a from n left join c on c.scenario_id = n.scenario_id and c.name = n.name group by 1, 2, 3)
 select scenario_id, name, step_no, case when b is not null then 'captured' when a is not null then 'later' else 'nowhere' end as state, coalesce(b, a) as producer from j""")
def variable_producers(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "runs").withColumnRenamed("role", "name")
    return audit.variable_producers(r.where("step_no > 0").select("scenario_id", "name", "step_no").distinct(), r.where("a_status <> 'passed'"), ["scenario_id"])


@query(_D + """select 'orders' as table_name, kind, cast(k as varchar) as label, case kind when 'delete' then 'usable-absent' else 'usable' end as address_state, cast(null as varchar) as reason, 'SELECT * FROM "orders" WHERE "o_orderkey" = ''' || cast(k as varchar) || '''' as select_text from d
 union all (with i as (select * from line_v1 except all select * from line_v0), g as (select * from line_v0 except all select * from line_v1) select 'lineitem', 'insert', '(unkeyed)', 'unavailable', 'no-stable-key', null from i union all select 'lineitem', 'delete', '(unkeyed)', 'unavailable', 'no-stable-key', null from g)""")
def row_addresses(s: SparkSession, d: str) -> DataFrame:
    a = address.addresses(_orders(s, d), ORDERS).unionByName(address.addresses(_lines(s, d), LINES))
    return a.withColumnRenamed("table", "table_name")


@query("with recursive b as (select text, '[item ' || cast(item_id as varchar) || ']' as mark, row_number() over (order by length(text) desc, text) as i from benchmark where length(text) >= 6), r(doc_id, text, i) as (select doc_id, text, cast(0 as bigint) from documents union all select r.doc_id, replace(r.text, b.text, b.mark), b.i from r join b on b.i = r.i + 1) select doc_id, text as scrubbed from r where i = (select count(*) from b)")
def scrub_documents(s: SparkSession, d: str) -> DataFrame:
    marks = view(s, d, "benchmark").select(F.col("text").alias("value"), F.concat(F.lit("[item "), F.col("item_id").cast("string"), F.lit("]")).alias("mark"))
    return values.scrub_texts(view(s, d, "documents").select("doc_id", "text"), marks, "text").select("doc_id", "scrubbed")


@query("""select event_id, replace(props, '"k": ', '"signup secret": "•••", "k\\"": ') as scrubbed from events""")
def scrub_json_values(s: SparkSession, d: str) -> DataFrame:
    e = view(s, d, "events").select("event_id", F.replace("props", F.lit('"k": '), F.lit('"signup secret": "signup secret", "k\\"": ')).alias("j"))
    return e.select("event_id", values.scrub_json(F.col("j"), {"signup secret": "•••"}).alias("scrubbed"))


@query(r"""select event_id, '{"say": "' || event_type || ' ••• · <' || cast(event_id % 50 as varchar) || '>", "secret \"é\"": 1, "key' || cast(event_id % 50 as varchar) || ' of user": "k"}' as scrubbed from events""")
def scrub_json_escaped(s: SparkSession, d: str) -> DataFrame:
    """Values are found however a JSON text spells them, by one automaton for the whole list; keys are spared."""
    e = view(s, d, "events")
    user = (F.col("event_id") % 50).cast("string")
    j = F.concat(F.lit('{"say": "'), "event_type", F.lit(r' sec\u0072et \"\u00e9\" · k\u0065y'), user, F.lit(r' of\u0020user", "secret \"é\"": 1, "key'), user, F.lit(' of user": "k"}'))
    listed = e.select(F.concat(F.lit("key"), user, F.lit(" of user")).alias("value"), F.concat(F.lit("<"), user, F.lit(">")).alias("mark")).distinct()
    own = e.limit(1).select(F.lit('secret "é"').alias("value"), F.lit("•••").alias("mark"))
    return values.scrub_texts(e.select("event_id", j.alias("j")), listed.unionByName(own), "j", json=True).select("event_id", "scrubbed")


@query("select 'capture' as source, 'scope-truncated' as code, 'orders' as table_name, 'the table was rewritten' as message from orders_v0 having cast(count(*) as varchar) is distinct from (select cast(count(*) as varchar) from orders_v1) union all select 'capture', 'scope-truncated', 'lineitem', 'the table is gone'")
def rewritten_tables(s: SparkSession, d: str) -> DataFrame:
    ids = lambda v, t: view(s, d, v).agg(F.count("*").cast("string").alias("identity")).select(F.lit(t).alias("table"), "identity")
    before = ids("orders_v0", "orders").unionByName(ids("line_v0", "lineitem")).unionByName(ids("conv_v0", "conversations"))
    after = ids("orders_v1", "orders").unionByName(ids("conv_v0", "conversations"))
    return capture.rewritten(before, after).withColumnRenamed("table", "table_name")


@query("select 'no values differ' as statement from orders_v0 having count(*) > 0")
def nothing_happened(s: SparkSession, d: str) -> DataFrame:
    same = capture.snapshot_diff(view(s, d, "orders_v0"), view(s, d, "orders_v0"), ORDERS)
    return summary.nothing_happened(same, capture.warn(s), capture.VALUE)


@query(_D + "select k as o_orderkey, 'o_orderstatus,o_orderkey,o_totalprice' as shown from d where kind = 'insert'")
def column_ranking(s: SparkSession, d: str) -> DataFrame:
    texts = F.array(F.lit("o_totalprice"))
    shown = summary.ranked_columns(F.col("changed_columns"), ["o_orderstatus"], ["o_orderkey"], texts, ["o_orderdate"], 3)
    return select.of_kind(_orders(s, d), "inserted").select("after.o_orderkey", F.array_join(shown, ",").alias("shown"))


@query(_D + "select 'single(updated(orders, o_orderkey = \"' || cast(k as varchar) || '\")).after.o_orderstatus == {{new}}' as expression from d where kind = 'update' and list_contains(cols, 'o_orderstatus')")
def promote_values(s: SparkSession, d: str) -> DataFrame:
    return promote.update_candidates(_orders(s, d), ["o_orderkey"], ("o_totalprice",), {"new": "X", "run": "Y"}).where("rule = 'value'").select("expression")


@query("select distinct 'customer' as table_name, '•••' as label from cust_v0")
def promote_withheld(s: SparkSession, d: str) -> DataFrame:
    t = TableScope("customer", ("c_custkey",), PRIMARY, None, (), ("c_custkey",))
    c = capture.snapshot_diff(view(s, d, "cust_v0").drop(V), view(s, d, "cust_v1").drop(V), t)
    return promote.withheld(c, ["c_custkey"], ("c_custkey",)).withColumnRenamed("table", "table_name")


@query("select distinct 'response.status == ' || cast(status as varchar) as expression from responses")
def promote_response(s: SparkSession, d: str) -> DataFrame:
    return promote.candidates([promote.response_status(view(s, d, "responses"))]).select("expression")


@query("select 'hasWrite(changes(*)) == false' as expression, 'a write that changes no value would not be seen' as caveat from orders_v0 having count(*) > 0")
def promote_nothing(s: SparkSession, d: str) -> DataFrame:
    same = capture.snapshot_diff(view(s, d, "orders_v0"), view(s, d, "orders_v0"), ORDERS)
    return promote.nothing_changed(s, same, capture.VALUE).select("expression", "caveat")


@query("select run_id, step_no, 'checks-nothing' as problem from runs where a_status = 'passed'")
def audit_unchecked_steps(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "runs")
    return audit.steps_without_assertions(r, r.where("a_status <> 'passed'"), ["run_id", "step_no"])


# -- streams ---------------------------------------------------------------------------


@query("""with m as (select max(epoch_us(ts)) as m from log), n as (select id, epoch_us(ts) - epoch_us(ts) % 604800000000 as ws, arg_min(operation, sequence) as f, arg_max(operation, sequence) as l, count(*) as writes, arg_max(amount, sequence) as amt from log where table_name = 'accounts' group by 1, 2)
 select id, cast(ws as bigint) as window_us, case when f <> 'insert' and l <> 'delete' then 'update' when l <> 'delete' then 'insert' else 'delete' end as kind, writes, case when l <> 'delete' then amt end as amount from n, m where (f <> 'insert' or l <> 'delete') and ws + 604800000000 <= m - 60000000""")
def stream_net_view(s: SparkSession, d: str) -> DataFrame:
    rec = view(s, d, "log").where("table_name = 'accounts'").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    # files in the order of time, as a log is written
    rec.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/log")
    src = streaming.intake(streaming.read_parquet_stream(s, f"{base}/log", 1000), "ts", "1 minute")
    net = streaming.window_net_view(src, ["id"], ["amount"], "7 days")
    q = streaming.store_each_batch(net, f"{base}/out", f"{base}/state")
    q.awaitTermination()
    out = s.read.schema("window_start timestamp, id bigint, kind string, first_op string, last_op string, writes bigint, amount decimal(12,2), batch int").parquet(f"{base}/out")
    return out.select("id", F.unix_micros("window_start").alias("window_us"), "kind", "writes", "amount")


@query("""with c as (select transaction_id from log where is_commit) select sequence, transaction_id, complete from log join (select distinct transaction_id, true as complete from c) using (transaction_id)""")
def stream_fence(s: SparkSession, d: str) -> DataFrame:
    rec = view(s, d, "log").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    # batches end within transactions
    third = rec.agg(F.max("sequence")).first()[0] // 12 * 4 + 2
    for part in range(3):
        rec.where(F.least(F.floor(F.col("sequence") / third), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(f"{base}/log")
    src = streaming.read_parquet_stream(s, f"{base}/log", 1).withWatermark("ts", "40 days")
    held = streaming.transaction_fence(src)
    streaming.store_each_batch(held, f"{base}/out", f"{base}/state").awaitTermination()
    return s.read.schema("sequence bigint, transaction_id bigint, complete boolean, batch int").parquet(f"{base}/out").where("complete").drop("batch")


@query("""with m as (select max(epoch_us(ts)) as m from log where table_name = 'accounts' and sequence % 7 <> 0) select 'stream' as source, 'scope-truncated' as code, id, cast(count(*) as varchar) || ' writes came too late' as message
 from log, m where table_name = 'accounts' and sequence % 7 = 0 and epoch_us(ts) - epoch_us(ts) % 604800000000 + 604800000000 <= m - 60000000 group by id""")
def stream_late_writes(s: SparkSession, d: str) -> DataFrame:
    """A seventh of the log comes behind all else; the stream itself gives out what is too late, and the log is read once."""
    rec = view(s, d, "log").where("table_name = 'accounts'").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    rec.where("sequence % 7 <> 0").coalesce(1).write.parquet(f"{base}/log")
    rec.where("sequence % 7 = 0").coalesce(1).write.mode("append").parquet(f"{base}/log")
    src = streaming.read_parquet_stream(s, f"{base}/log", 1).withWatermark("ts", "1 minute")
    out = streaming.window_net_view_with_late(src, ["id"], ["amount"], "7 days")
    streaming.store_each_batch(out, f"{base}/out", f"{base}/state").awaitTermination()
    found = s.read.schema("id bigint, late boolean, writes bigint, batch int").parquet(f"{base}/out")
    return streaming.late_writes(found, ["id"])


@query("with " + _NET + " select 0 as ordinal, 'passed' as status, cast(count(*) as varchar) as actual from net where kind = 'update' union all select 1, case when count(*) = 0 then 'passed' else 'failed' end, case when count(*) = 0 then 'true' else 'false' end from net where kind = 'delete'")
def stream_assertions(s: SparkSession, d: str) -> DataFrame:
    net = _accounts(log_net_view(s, d))
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    net.write.parquet(f"{base}/changes")
    _, sc = _mutations(s, d)
    k = check

    def answer(batch: DataFrame, _: int) -> DataFrame:
        cs = capture.ChangeSet({"accounts": batch}, sc, capture.WRITE, capture.NET, capture.warn(s))
        return check.evaluate(batch.sparkSession, cs, [k.count(k.updated("accounts")).ge(0), k.is_empty(k.deleted("accounts"))])

    streaming.evaluate_each_batch(streaming.read_parquet_stream(s, f"{base}/changes", 1000), answer, f"{base}/out", f"{base}/state").awaitTermination()
    return s.read.schema(check.RESULT).parquet(f"{base}/out").select("ordinal", "status", "actual")


@query("""with e as (select event_id % 128 as step_no, user_id as id, case when event_type <> 'error' then cast(value as decimal(12,2)) end as v from events), p as (select id, step_no, count(*) as n, max(v) as v from e group by 1, 2), o as (select *, case when n = 1 then v end as own from p),
 q as (select *, last_value(own ignore nulls) over w as lv, last_value(case when own is not null then step_no end ignore nulls) over w as ls from o window w as (partition by id order by step_no rows between unbounded preceding and current row))
 select id, step_no, case when n > 1 then 'unevaluable' when own is not null then 'observed' when lv is not null then 'carried' else 'unobserved' end as state, cast(case when n = 1 then lv end as varchar) as value, case when n = 1 then ls end as since from q""")
def stream_carried(s: SparkSession, d: str) -> DataFrame:
    """Rows of all steps in no order over three batches; errors report nothing, and late rows correct what was carried."""
    obs = view(s, d, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 128).alias("step_no"), F.when(F.col("event_type") != "error", F.col("value").cast("decimal(12,2)")).cast("string").alias("value"), F.xxhash64("event_id").alias("h"))
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    obs.repartition(3, F.pmod("h", F.lit(3))).select("id", "step_no", "value").write.parquet(f"{base}/obs")
    out = streaming.carried(streaming.read_parquet_stream(s, f"{base}/obs", 1), ["id"])
    streaming.store_each_batch(out, f"{base}/out", f"{base}/state").awaitTermination()
    r = s.read.schema("id bigint, step_no bigint, state string, value string, since bigint, revision bigint, batch int").parquet(f"{base}/out")
    return streaming.settled(r, ["id"])


# -- exactness ---------------------------------------------------------------------------


@query("with c as (select transaction_id, max(place) as c from log_pairs where is_commit group by 1) select sequence, log_pairs.transaction_id, lsn from log_pairs left join c on c.transaction_id = log_pairs.transaction_id where place <= 300 and (c.c is null or c.c >= 16 or c.c > 300)")
def commit_fence_text(s: SparkSession, d: str) -> DataFrame:
    return log.commit_fence(view(s, d, "log_pairs"), "0/10", "0/12C").select("sequence", "transaction_id", "lsn")


@query("select coalesce(a.id, b.id) as id, cast(cast(coalesce(a.x, 0) - coalesce(b.x, 0) as decimal(30,10)) as varchar) as delta from fine_v0 b full join fine_v1 a on a.id = b.id")
def delta_scale(s: SparkSession, d: str) -> DataFrame:
    t = TableScope("fine", ("id",), PRIMARY)
    c = capture.snapshot_diff(view(s, d, "fine_v0"), view(s, d, "fine_v1"), t)
    return c.select(F.coalesce("after.id", "before.id").alias("id"), select.delta(c, "x").cast("decimal(30,10)").cast("string").alias("delta"))


@query("select event_id, event_id % 2 = 0 as same, event_id % 10 < (event_id + 1) % 10 as below, event_id % 10 >= (event_id + 1) % 10 as not_below from events")
def numeric_exact(s: SparkSession, d: str) -> DataFrame:
    e = view(s, d, "events").select("event_id", *(F.concat(F.lit("-0000123456789012345678901234567890123456789.0000000000000" if k < 2 else "0.00000000000000000000"), ((F.col("event_id") + k % 2) % 10).cast("string")).alias(f"x{k}") for k in range(4)))
    same = values.eq_typed(F.concat(F.lit("0."), F.lit("0" * 20), (F.col("event_id") % 2).cast("string")), F.lit("-0.000"), "numeric")
    # of negative numbers, the larger digits are below
    low, high = values.compare_numbers(F.col("x1"), F.col("x0"), ">"), values.compare_numbers(F.col("x2"), F.col("x3"), "<")
    return e.select("event_id", same.alias("same"), high.alias("below"), F.when(low == ~high, ~high).when(F.col("x0") == F.col("x1"), ~high).alias("not_below"))


@query("select event_id, true as cased, event_type = upper(event_type) as text_same from events")
def citext_equal(s: SparkSession, d: str) -> DataFrame:
    e = view(s, d, "events")
    return e.select("event_id", values.eq_typed(F.upper("event_type"), F.col("event_type"), "citext").alias("cased"), values.eq_typed(F.upper("event_type"), F.col("event_type"), "text").alias("text_same"))


@query("""select sequence, 'pub"lic' as schema_name, 'we"ird' as table_name, case sequence % 2 when 0 then 't' else 'f' end as ok, '10' as bits, cast(null as varchar) as nothing, 'it''s ' || event_type as say, 'left' as unreadable from log_kinds join events on event_id = sequence""")
def log_values(s: SparkSession, d: str) -> DataFrame:
    c, v = log.decode(view(s, d, "log_kinds")), lambda n: F.col("columns")[n]
    return c.select("sequence", "schema_name", "table_name", v("ok").alias("ok"), v("bits").alias("bits"), v("none").alias("nothing"), v("say").alias("say"), F.array_join("unreadable", ",").alias("unreadable"))


@query("select cast(sequence as bigint) as sequence, cast(transaction_id as varchar) as transaction_id, lsn, 'accounts' as table_name, 'update' as operation, cast(sequence % 9 as varchar) as id from log_pairs where is_commit or place >= 16 union all select sequence, cast(transaction_id as varchar), lsn, 'accounts', 'update', cast(sequence % 9 as varchar) from log_pairs where not is_commit and place < 16")
def log_records(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(s)}/records-{uuid.uuid4().hex}"
    rec = view(s, d, "log_pairs").select("sequence", F.col("transaction_id").cast("string").alias("transaction_id"), "lsn", F.lit("accounts").alias("table_name"), F.lit("update").alias("operation"), F.create_map(F.lit("id"), (F.col("sequence") % 9).cast("string")).alias("key"))
    rec.write.json(path)
    return log.read_records(s, path).select("sequence", "transaction_id", "lsn", "table_name", "operation", F.col("key")["id"].alias("id"))


# -- scopes, stores ------------------------------------------------------------------------


def _world(s: SparkSession, d: str) -> tuple[scope.Catalog, dict[str, DataFrame], dict[str, DataFrame]]:
    names = {"orders": ("orders_v0", "orders_v1"), "customer": ("cust_v0", "cust_v1"), "lineitem": ("line_v0", "line_v1"), "conversations": ("conv_v0", "conv_v1"), "_hidden": ("xfer_v0", "xfer_v1")}
    b, a = ({n: view(s, d, v[i]) for n, v in names.items()} for i in (0, 1))
    return scope.Catalog(a, {"orders": ("o_orderkey",), "customer": ("c_custkey",), "conversations": ("conv_id",)}), b, a


def _captured(s: SparkSession, d: str, sc: Scope, b: dict[str, DataFrame], a: dict[str, DataFrame]) -> DataFrame:
    cs = capture.capture_snapshots(s, b, a, sc)
    parts = [x.groupBy(F.lit(t).alias("table_name"), "kind").agg(F.count("*").alias("n"), F.count_if(F.size("visible_columns") == 0).alias("unseen")) for t, x in cs.changes.items()]
    notes = cs.warnings.select(F.col("table").alias("table_name"), F.col("code").alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("unseen"))
    return reduce(DataFrame.unionByName, [*parts, notes])


_LINE_DIFF = "li as (select * from line_v1 except all select * from line_v0), lg as (select * from line_v0 except all select * from line_v1), ci as (select * from conv_v1 except all select * from conv_v0), cg as (select * from conv_v0 except all select * from conv_v1)"


@query(f"""with {_LINE_DIFF}, o as (select case when b.o_orderkey is null then 'insert' when a.o_orderkey is null then 'delete' else 'update' end as kind, (b.o_orderstatus, b.o_totalprice) is not distinct from (a.o_orderstatus, a.o_totalprice) as unseen from orders_v0 b full join orders_v1 a on a.o_orderkey = b.o_orderkey where a.o_orderkey is null or b.o_orderkey is null or (b.o_orderstatus, b.o_totalprice, b.row_version) is distinct from (a.o_orderstatus, a.o_totalprice, a.row_version)),
 c as (select case when a.c_custkey is null then 'delete' else 'update' end as kind, (b.c_mktsegment, b.c_acctbal) is not distinct from (a.c_mktsegment, a.c_acctbal) as unseen from cust_v0 b left join cust_v1 a on a.c_custkey = b.c_custkey where a.c_custkey is null or (b.c_mktsegment, b.c_acctbal, b.row_version) is distinct from (a.c_mktsegment, a.c_acctbal, a.row_version))
 select 'orders' as table_name, kind, count(*) as n, count(*) filter (where unseen and kind = 'update') as unseen from o group by kind union all select 'customer', kind, count(*), count(*) filter (where unseen and kind = 'update') from c group by kind
 union all select 'lineitem', 'insert', count(*), 0 from li having count(*) > 0 union all select 'lineitem', 'delete', count(*), 0 from lg having count(*) > 0 union all select 'lineitem', 'degraded-row-identity', 0, 0
 union all select 'conversations', 'insert', count(*), 0 from ci having count(*) > 0 union all select 'conversations', 'delete', count(*), 0 from cg having count(*) > 0 union all select 'conversations', 'degraded-row-identity', 0, 0""")
def scope_full(s: SparkSession, d: str) -> DataFrame:
    catalog, b, a = _world(s, d)
    return _captured(s, d, scope.full_scope(catalog, ignore=(V,)), b, a)


@query("""with c as (select case when b.c_custkey is null then 'insert' when a.c_custkey is null then 'left-scope' else 'update' end as kind, b.c_acctbal is not distinct from a.c_acctbal and b.c_mktsegment is not distinct from a.c_mktsegment as same from (select * from cust_v0 where c_mktsegment = 'BUILDING') b full join (select * from cust_v1 where c_mktsegment = 'BUILDING') a on a.c_custkey = b.c_custkey
 where a.c_custkey is null or b.c_custkey is null or (b.c_acctbal, b.row_version) is distinct from (a.c_acctbal, a.row_version))
 select 'customer' as table_name, kind, count(*) as n, count(*) filter (where kind = 'update') as unseen from c group by kind union all select 'orders', 'scope-truncated', 0, 0""")
def scope_watched(s: SparkSession, d: str) -> DataFrame:
    catalog, b, a = _world(s, d)
    sc = scope.narrowed_scope(scope.full_scope(catalog, ignore=(V,)), {"customer": {"where": "c_mktsegment = 'BUILDING'", "ignore": ("c_acctbal",)}, "orders": {}})
    tables = sc.tables | {"orders": replace(sc.tables["orders"], max_rows=10)}
    return _captured(s, d, replace(sc, tables=tables), b, a)


@query("select 'orders' as table_name, 'o_orderkey' as key, 'primary-key' as strategy from orders_v0 having count(*) > 0 union all select 'conversations', 'conv_id,turn', 'unique-index' union all select 'lineitem', '', 'full-row-multiset' union all select 'customer', 'c_custkey', 'unique-index'")
def key_inference(s: SparkSession, d: str) -> DataFrame:
    found = {
        "orders": scope.infer_key(view(s, d, "orders_v0"), ("o_orderkey",)), "conversations": scope.infer_key(view(s, d, "conv_v0"), ("conv_id",), [("conv_id",), ("turn",), ("conv_id", "turn")]),
        "lineitem": scope.infer_key(view(s, d, "line_v0")), "customer": scope.infer_key(view(s, d, "cust_v0"), None, [("c_nationkey",), ("c_custkey",)]),
    }
    return s.createDataFrame([(t, ",".join(k), how) for t, (k, how) in found.items()], "table_name string, key string, strategy string")


@query("select x.*, (select count(*) from orders) as n_rows from (values ('orders', 0, 'o_orderkey', true, false, false), ('orders', 1, 'o_custkey', false, false, false), ('orders', 2, 'o_orderstatus', false, true, false), ('orders', 3, 'o_totalprice', false, false, true), ('orders', 4, 'o_orderdate', false, false, false), ('orders', 5, 'o_orderpriority', false, false, false), ('orders', 6, 'row_version', false, false, false)) as x(table_name, ordinal, column_name, is_key, ignored, masked)")
def table_description(s: SparkSession, d: str) -> DataFrame:
    t = view(s, d, "orders_v0")
    sc = Scope({"orders": TableScope("orders", ("o_orderkey",), PRIMARY, None, ("o_orderstatus",), ("o_totalprice",))})
    c = scope.describe(scope.catalog_columns(s, {"orders": t}), sc.frame(s)).crossJoin(scope.prove_key(t, ("o_orderkey",)).select(F.col("rows").alias("n_rows")))  # one row
    return c.select(F.col("table").alias("table_name"), "ordinal", F.col("column").alias("column_name"), "is_key", "ignored", "masked", "n_rows")


@query("with c as (select * from (values ('watched', 'conversations'), ('watched', 'customer'), ('watched', 'lineitem'), ('watched', 'orders'), ('keyless', 'lineitem'), ('underscore', '_hidden'), ('foreign', 'far')) as t(kind, table_name)) select kind, table_name, case table_name when 'orders' then (select count(*) from orders_v1) when 'lineitem' then (select count(*) from line_v1) end as n_rows from c")
def scope_report(s: SparkSession, d: str) -> DataFrame:
    catalog, _, a = _world(s, d)
    catalog.foreign = ("far",)
    r = scope.scope_report(s, catalog, scope.full_scope(catalog)).withColumnRenamed("table", "table_name")
    n = reduce(DataFrame.unionByName, (a[t].agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(t)) for t in ("orders", "lineitem")))
    return r.join(n, "table_name", "left")


@query("select distinct role as name from conversations")
def unresolved_masks(s: SparkSession, d: str) -> DataFrame:
    names = view(s, d, "conversations").select(F.col("role").alias("name")).unionByName(view(s, d, "conversations").select(F.lit("c_acctbal").alias("name")))
    return scope.unresolved_names(s, names, _catalog(s, d))


@query(_D + "select 'r' || cast(i as varchar) as run_id, kind, count(*) as n from d, (values (1), (2)) as t(i) where i = 1 or kind = 'insert' group by all")
def history_changes(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(s)}/changes-{uuid.uuid4().hex}"
    c = capture.canonical(_orders(s, d)).drop("key")
    for run, part in (("r1", c), ("r2", c), ("r2", select.of_kind(c, "inserted"))):  # the last one replaces its run alone
        history.write_changes(part.withColumn("run_id", F.lit(run)), path)
    return s.read.parquet(path).groupBy("run_id", "kind").agg(F.count("*").alias("n"))


@query("with r as (select distinct run_id from runs), n as (select run_id from r order by run_id desc limit 6), k as (select run_id from n where run_id % 2 = 0 or true) select run_id, count(*) as n from runs where run_id in (select run_id from k order by run_id desc limit 4) group by run_id")
def history_runs(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(s)}/runs-{uuid.uuid4().hex}"
    r = view(s, d, "runs")
    history.write_run(r.repartition(4, "run_id"), path, 6)
    stored = s.read.parquet(path).withColumn("run_id", F.col("run_id").cast("bigint"))
    few = history.newest(stored.select("run_id", "schema_major").distinct(), 4).select("run_id")
    return stored.join(few, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n"))


@query(_D + "select k as o_orderkey, kind from d where k % 3 = 1")
def at_step(s: SparkSession, d: str) -> DataFrame:
    c = _orders(s, d).withColumn("step_id", F.coalesce("after.o_orderkey", "before.o_orderkey") % 3)
    return select.at_step(c, 1).select(F.coalesce("after.o_orderkey", "before.o_orderkey").alias("o_orderkey"), "kind")


# -- more assertions and verdicts --------------------------------------------------------------


def _accounts(net: DataFrame) -> DataFrame:
    image = F.struct("id", "amount")
    return net.select(F.lit("accounts").alias("table"), values.key_token("fixed", [F.col("id").cast("string")], ["id"]).alias("key_token"), "kind", F.when(F.col("kind") != "insert", image).alias("before"), F.when(F.col("kind") != "delete", image).alias("after"), F.array(F.lit("amount")).alias("changed_columns"), F.array(F.lit("amount")).alias("visible_columns"), F.lit(True).alias("has_write"))


@query(_D + """, u as (select * from d where kind = 'update'), one as (select * from d where kind = 'insert' and k = (select min(k) from d where kind = 'insert'))
 select 0 as ordinal, 'passed' as status, cast(ap as varchar) as actual, cast(null as varchar) as reason from one union all select 1, 'unevaluable', null, cast(count(*) as varchar) || ' values where one is needed' from d where kind = 'insert'
 union all select 2, 'passed', cast(cast(min(ap - bp) as decimal(38,2)) as varchar), null from u union all select 3, 'passed', cast(cast(max(ap) as decimal(38,2)) as varchar), null from d where kind = 'insert'
 union all select 4, 'unevaluable', null, cast(count(*) as varchar) || ' rows have no number in o_orderstatus' from u union all select 5, 'unevaluable', null, 'current rows cannot be read here' union all select 6, 'unevaluable', null, 'orders has no column o_totalprise; did you mean o_totalprice?'
 union all select 7, 'passed', 'true', null""")
def single_and_folds(s: SparkSession, d: str) -> DataFrame:
    c = _orders(s, d)
    first = select.of_kind(c, "inserted").agg(F.min("after.o_orderkey").alias("k")).first()["k"]
    cs = capture.ChangeSet({"orders": c}, Scope({"orders": ORDERS}), capture.VALUE, capture.NET, capture.warn(s))
    k = check
    new = k.inserted("orders")
    e = [
        k.single(new.where(o_orderkey=first)).after("o_totalprice").gt(0), k.single(new).after("o_totalprice").gt(0), k.min_(k.delta(k.updated("orders"), "o_totalprice")).ge(0), k.max_(new.after("o_totalprice")).gt(0),
        k.sum_(k.updated("orders").after("o_orderstatus")).eq(0), k.count(k.rows("orders")).gt(0), k.sum_(k.delta(k.changes("orders"), "o_totalprise")).eq(0), k.any_(new),
    ]
    return check.evaluate(s, cs, e).select("ordinal", "status", "actual", "reason")


@query("select run_id, step_no, row_number() over (partition by run_id order by case a_status when 'failed' then 0 when 'unevaluable' then 1 when 'passed' then 2 else 4 end, step_no) as place from runs")
def worst_first(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "runs").select("run_id", "step_no", F.col("a_status").alias("status"), F.col("step_no").alias("ordinal"))
    # the order within each run is read off the sorted rows
    w = verdict.worst_first(r, "run_id").withColumn("_at", F.monotonically_increasing_id())
    return w.select("run_id", "step_no", F.row_number().over(Window.partitionBy("run_id").orderBy("_at")).alias("place"))


@query("with t as (select 'conversations' as table_name union all select 'lineitem' union all select 'orders') select table_name, row_number() over (order by table_name) as place from t, (select count(*) as n from orders_v1) where n > 0")
def summary_order(s: SparkSession, d: str) -> DataFrame:
    all_ = reduce(DataFrame.unionByName, (x.select("table", "kind", "visible_columns") for x in (_orders(s, d), _conv(s, d), _lines(s, d))))
    w = summary.change_summary(all_).withColumn("_at", F.monotonically_increasing_id())
    return w.select(F.col("table").alias("table_name"), F.row_number().over(Window.orderBy("_at")).alias("place"))


_REASON = """pl as (select run_id, count(*) as steps, count(*) filter (where outcome = 'errored') as e, min(case when outcome = 'errored' then step_no end) as fe, count(*) filter (where a_status = 'failed') as f, count(*) filter (where a_status = 'unevaluable') as u, count(*) filter (where w_code = 'scope-truncated') as blind, count(*) filter (where outcome = 'not-run') as nr,
 list_sort(list(step_no) filter (where outcome = 'not-run')) as missed, count(*) filter (where w_code = 'degraded-row-identity') as soft, run_id % 5 = 0 as part, run_id % 3 = 0 as unprobed, list_sort(list(distinct 't' || cast(step_no as varchar)) filter (where w_code = 'scope-truncated')) as ts, list_sort(list(distinct 't' || cast(step_no as varchar)) filter (where w_code = 'degraded-row-identity')) as ds from sx group by run_id),
 tx as (select *, array_to_string(ts[1:3], ', ') || case when len(ts) > 3 then ' and ' || cast(len(ts) - 3 as varchar) || ' more' else '' end as tt, array_to_string(ds[1:3], ', ') || case when len(ds) > 3 then ' and ' || cast(len(ds) - 3 as varchar) || ' more' else '' end as dt from pl)"""


@query("with " + _STEP + ", " + _REASON + """ select run_id, case when e > 0 then cast(e as varchar) || case when e = 1 then ' step' else ' steps' end || ' of ' || cast(steps as varchar) || ' errored, first ' || cast(fe as varchar) when f > 0 then cast(f as varchar) || case when f = 1 then ' assertion failed' else ' assertions failed' end
 when u > 0 then cast(u as varchar) || case when u = 1 then ' assertion' else ' assertions' end || ' could not be evaluated' when blind > 0 then 'scope-truncated on ' || tt else 'all assertions held' end as reason,
 array_to_string(list_filter([case when part then 'only a part of the steps was asked for' end, case when nr > 0 then cast(nr as varchar) || case when nr = 1 then ' step' else ' steps' end || ' never ran: ' || array_to_string(missed, ', ') end, case when unprobed then 'nobody looked at what changes when nothing is asked' end,
 case when soft > 0 then 'degraded-row-identity on ' || dt end, case when blind > 0 then 'scope-truncated on ' || tt end], lambda x: x is not null), '; ') as fine_print from tx""")
def run_reasons(s: SparkSession, d: str) -> DataFrame:
    return _reasoned(s, d).select("run_id", "reason", F.array_join("fine_print", "; ").alias("fine_print"))


def _reasoned(s: SparkSession, d: str, policy: verdict.Policy = verdict.Policy()) -> DataFrame:  # noqa: B008
    r = view(s, d, "runs")
    w = r.where("w_code is not null").select("run_id", F.col("w_code").alias("code"), F.concat(F.lit("t"), F.col("step_no").cast("string")).alias("table"))
    facts = r.select("run_id").distinct().select("run_id", (F.col("run_id") % 5 == 0).alias("partial"), (F.col("run_id") % 3 != 0).alias("probed"))
    return verdict.run_verdicts(_steps(s, d, policy), ["run_id"], policy, w, facts)


@query("""with g as (select *, run_id % 4 = 3 or step_no % 2 = 1 as bare from runs where w_code is distinct from 'scope-truncated'),
 sx as (select run_id, step_no, case when step_status = 'errored' then 'errored' when step_status = 'skipped' then 'not-run' when not bare and a_status = 'failed' then 'failed' else 'passed' end as outcome, case when not bare then a_status end as a, w_code from g),
 pl as (select run_id, count(*) as steps, count(*) filter (where outcome = 'errored') as e, min(case when outcome = 'errored' then step_no end) as fe, count(*) filter (where a = 'failed') as f, count(*) filter (where a = 'unevaluable') as u, count(a) as n, count(*) filter (where outcome = 'not-run') as nr, count(*) filter (where outcome not in ('not-run', 'errored')) as seen, count(w_code) as soft from sx group by run_id)
 select run_id, case when e > 0 then 'errored' when f > 0 then 'failed' else 'clean' end as outcome, case when e > 0 then cast(e as varchar) || case when e = 1 then ' step' else ' steps' end || ' of ' || cast(steps as varchar) || ' errored, first ' || cast(fe as varchar) when f > 0 then cast(f as varchar) || case when f = 1 then ' assertion failed' else ' assertions failed' end
 when n = 0 then 'every step ran, nothing was asserted' when u > 0 then cast(n - u as varchar) || ' of ' || cast(n as varchar) || case when n = 1 then ' assertion' else ' assertions' end || ' held, the others were not evaluated and accepted by policy' else 'all assertions held' end as reason,
 array_to_string(list_filter([case when nr > 0 then 'unreached' end, case when soft > 0 then 'degraded-row-identity' end, case when u > 0 then 'by-policy' end, case when n = 0 then 'unchecked' end], lambda x: x is not null), ',') as bounds, case when nr + soft + u = 0 and n > 0 then 'full' else 'bounded' end as proves from pl""")
def run_reasons_by_policy(s: SparkSession, d: str) -> DataFrame:
    """Runs of which some have no assertion at all and others a step without one, under a policy that lets both pass."""
    policy = verdict.Policy(accept_unevaluable=True, require_assertions=False)
    r = view(s, d, "runs").where("not w_code <=> 'scope-truncated'")
    by = ["run_id", "step_no"]
    a = r.where("run_id % 4 <> 3 and step_no % 2 = 0").select(*by, F.col("a_status").alias("status"), F.lit(0).alias("ordinal"))
    w = r.where("w_code is not null").select(*by, F.col("w_code").alias("code"), F.lit("orders").alias("table"))
    o = verdict.step_outcomes(r.select(*by, "step_status"), a, w, by, policy)
    return verdict.run_verdicts(o, ["run_id"], policy, w.drop("step_no")).select("run_id", "outcome", "reason", F.array_join("bounds", ",").alias("bounds"), "proves")


@query("with " + _STEP + """, pl as (select run_id, count(*) filter (where outcome = 'not-run') as nr, count(*) filter (where w_code = 'scope-truncated') as blind, count(*) filter (where w_code = 'degraded-row-identity') as soft, count(*) filter (where a_status = 'unevaluable') as u, run_id % 5 = 0 as part, run_id % 3 = 0 as unprobed from sx group by run_id),
 b as (select unnest(list_filter([case when part then 'partial' end, case when nr > 0 then 'unreached' end, case when unprobed then 'unprobed' end, case when soft > 0 then 'degraded-row-identity' end, case when blind > 0 then 'scope-truncated' end, case when u > 0 then 'by-policy' end], lambda x: x is not null)) as bound, u from pl),
 k as (select bound, count(*) as k, sum(u) as u, (select count(*) from pl) as n from b group by bound) select bound, case when k = n then bound else bound || ' in ' || cast(k as varchar) || ' of ' || cast(n as varchar) || ' datasets' end || case when bound = 'by-policy' then ', ' || cast(u as varchar) || ' assertions' else '' end as sentence from k""")
def suite_fine_print(s: SparkSession, d: str) -> DataFrame:
    return verdict.suite_bounds(_reasoned(s, d, verdict.Policy(accept_unevaluable=True)))


@query("select run_id, count(*) as total, count(*) filter (where role = 'passed') as passed, count(*) filter (where role = 'failed') as failed, count(*) filter (where role not in ('passed', 'failed', 'passed-as-refused')) as unevaluable, count(*) filter (where role = 'passed-as-refused') as passed_as_refused from runs group by run_id")
def unknown_statuses(s: SparkSession, d: str) -> DataFrame:
    return verdict.assertion_counts(view(s, d, "runs"), ["run_id"], "role")


@query("with " + _STEP + ", " + _RUN + f" select {_SUITE} from ro where run_id % 2 = 0 union all select {_SUITE} from ro")
def stored_suite(s: SparkSession, d: str) -> DataFrame:
    """Stored verdicts, read back, are a report like another."""
    path = f"{shared_folder(s)}/verdicts-{uuid.uuid4().hex}"
    history.write_run(_runs(s, d), path, 0)
    stored = history.gate(s.read.parquet(path))[0]
    return verdict.suite_verdict(stored.where("run_id % 2 = 0")).unionByName(verdict.suite_verdict(stored))


@query("with c as (select distinct scenario_id as assertion, role as expected, step_no % 2 as d from runs), f as (select distinct assertion, expected from c where d = 0), t as (select assertion from f group by 1 having count(*) > 1) select assertion, expected from f where assertion not in (select assertion from t) union all select assertion, 'claimed twice' from t")
def expected_answers(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "runs").select(F.col("scenario_id").alias("assertion"), F.col("role").alias("expected"), F.when(F.col("step_no") % 2 == 0, "value").otherwise("write").alias("detection"), F.lit(None).cast("string").alias("fidelity"), F.lit(None).cast("boolean").alias("row_identity"))
    one, twice = summary.expected_answers(r, capture.VALUE, capture.NET, True)
    return one.unionByName(twice.withColumn("expected", F.lit("claimed twice")))


@query(_D + "select 'hasWrite(changes(orders, o_orderkey = \"' || cast(k as varchar) || '\")) == true' as expression, 'volatile' as caveat from d where kind = 'update'")
def promote_volatile(s: SparkSession, d: str) -> DataFrame:
    names = {"o_orderstatus": "last_seen", "o_totalprice": "touched", "o_orderdate": "created_at", "o_orderpriority": "etag"}
    part = lambda v: view(s, d, v).drop(V).withColumnsRenamed(names)
    c = capture.snapshot_diff(part("orders_v0"), part("orders_v1"), ORDERS)
    return promote.update_candidates(c, ["o_orderkey"]).select("expression", "caveat")


# -- many runs at once -----------------------------------------------------------------


RUN_ORDERS = TableScope("orders", ("run_id", "o_orderkey"), PRIMARY)


def run_set(s: SparkSession, d: str) -> capture.ChangeSet:
    """Orders and accounts of all runs: changes, current rows and the list of writes, each with its run."""
    b, a = view(s, d, "run_orders_v0"), view(s, d, "run_orders_v1")
    n = view(s, d, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    at_run = lambda f: f.crossJoin(F.broadcast(n)).withColumn("run_id", F.col("id") % F.col("n")).drop("n")  # noqa: E731 - one row
    changed = many_runs.with_run(capture.snapshot_diff(b, a, RUN_ORDERS, "fixed"), "run_id")
    m, sc = _mutations(s, d)
    writes = at_run(m.withColumn("id", F.col("key").cast("long"))).drop("id")
    accounts = at_run(_accounts(log_net_view(s, d)).withColumn("id", F.coalesce("after.id", "before.id"))).drop("id")
    both = Scope({"orders": RUN_ORDERS, **sc.tables}, True, sc.salt)
    return capture.ChangeSet({"orders": changed, "accounts": accounts}, both, capture.VALUE, capture.NET, capture.warn(s), writes, {"orders": a})


def run_assertions() -> list[check.Expr]:
    k = check
    return [
        k.count(k.inserted("orders")).le(k.var("limit")), k.sum_(k.delta(k.changes("orders"), "o_totalprice")).ge(0), k.is_empty(k.deleted("orders")), k.any_(k.inserted("orders")) & ~k.is_empty(k.deleted("orders")), k.count(k.updated("orders")).ge(1),
        k.single(k.deleted("orders")).before("o_orderstatus").eq("O"), k.max_(k.delta(k.updated("orders"), "o_totalprice")).gt(k.var("limit")), k.write_count(k.changes("accounts")).ge(2), k.atomic(k.changes("accounts")), k.count(k.rows("orders", o_orderstatus="X")).gt(3),
    ]


def run_variables(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "run_list").where("run_id % 5 <> 0").select("run_id", F.lit("limit").alias("name"), (F.col("run_id") % 7).cast("string").alias("value"))


@query(_D + ", " + _NET + """, nr as (select max(conv_id) + 1 as n from conversations), x as (select d.*, k % nr.n as run_id from d, nr),
 g as (select run_id, count(*) filter (where kind = 'insert') as ins, count(*) filter (where kind = 'update') as upd, count(*) filter (where kind = 'delete') as del, cast(sum(coalesce(ap, 0) - coalesce(bp, 0)) as decimal(38,2)) as delta, cast(max(case when kind = 'update' then ap - bp end) as decimal(38,2)) as mx, min(case when kind = 'delete' then bs end) as bs from x group by run_id),
 wr as (select id % nr.n as run_id, count(*) as wc, count(distinct transaction_id) as wt from log, nr where table_name = 'accounts' and id in (select id from net) group by 1),
 rx as (select run_id, count(*) as rc from (select run_id from x where coalesce(st, bs) = 'X' union all select run_id from run_orders_v1 where o_orderstatus = 'X' and o_orderkey not in (select k from d)) group by run_id),
 b as (select run_list.*, coalesce(ins, 0) as ins, coalesce(upd, 0) as upd, coalesce(del, 0) as del, delta, mx, bs, coalesce(wc, 0) as wc, wt, coalesce(rc, 0) as rc, case when run_id % 5 <> 0 then cast(run_id % 7 as varchar) end as lim, case when run_id % 5 = 0 then 'no value was captured for limit' end as nolim from run_list left join g using (run_id) left join wr using (run_id) left join rx using (run_id)),
 e as (select run_id, 0 as ordinal, nolim as reason, ins <= cast(lim as bigint) as ok, cast(ins as varchar) as actual, lim as expected from b
 union all select run_id, 1, null, coalesce(delta, 0) >= 0, coalesce(cast(delta as varchar), '0'), '0' from b
 union all select run_id, 2, null, del = 0, case when del = 0 then 'true' else 'false' end, 'true' from b
 union all select run_id, 3, null, ins > 0 and del > 0, case when ins > 0 and del > 0 then 'true' else 'false' end, 'true' from b
 union all select run_id, 4, case when detection = 'value' then 'needs write detection: a write that changes no value is not seen' end, upd >= 1, cast(upd as varchar), '1' from b
 union all select run_id, 5, case when del <> 1 then cast(del as varchar) || ' values where one is needed' end, bs = 'O', bs, 'O' from b
 union all select run_id, 6, case when upd = 0 then 'no rows' else nolim end, mx > cast(lim as bigint), cast(mx as varchar), lim from b
 union all select run_id, 7, case when fidelity = 'net' then 'needs a list of writes with their transactions' end, wc >= 2, cast(wc as varchar), '2' from b
 union all select run_id, 8, case when fidelity = 'net' then 'needs a list of writes with their transactions' when wc = 0 then 'no writes were recorded on these rows' end, wt = 1, case when wt = 1 then 'true' else 'false' end, 'true' from b
 union all select run_id, 9, null, rc > 3, cast(rc as varchar), '3' from b)
 select run_id, ordinal, case when reason is not null then 'unevaluable' when ok then 'passed' else 'failed' end as status, case when reason is null then actual end as actual, case when reason is null then expected end as expected, reason from e""")
def runs_evaluated(s: SparkSession, d: str) -> DataFrame:
    """Ten assertions over all runs: a plan of one aggregate for each table, with detection, fidelity and variables of each run."""
    found = many_runs.evaluate_runs(run_set(s, d), view(s, d, "run_list"), run_assertions(), run_variables(s, d))
    return found.select("run_id", "ordinal", "status", "actual", "expected", "reason")


# -- candidates as data ------------------------------------------------------------------


def promoted(s: SparkSession, d: str) -> tuple[DataFrame, capture.ChangeSet]:
    """All candidates of the written orders and of the accounts, and the changes they come from."""
    cs, path = _set(s, d, capture.WRITE), f"{shared_folder(s)}/changes-{uuid.uuid4().hex}"
    # promotion and its decision ask the changes several times, so they are stored once, as a run's would be
    for t in ("orders", "accounts"):
        cs.changes[t].write.parquet(f"{path}/{t}")
        cs.changes[t] = s.read.parquet(f"{path}/{t}")
    o, x = cs.changes["orders"], cs.changes["accounts"]
    offers = [promote.table_counts(o), promote.discriminator_counts(o, (), ("o_orderstatus",)), promote.update_candidates(o, ["o_orderkey"]), promote.invariants(o, keys=["o_orderkey"]), promote.invariants(x, keys=["id"])]
    return promote.candidates(offers), cs


@query(_D + """, u as (select *, list_contains(cols, 'o_totalprice') as p, list_contains(cols, 'o_orderstatus') as st_seen from w where kind = 'update'),
 i as (select count(*) as n, count(*) filter (where p) as seen, sum(ap - bp) as up from u), whole as (select sum(coalesce(ap, 0) - coalesce(bp, 0)) as total from w),
 x as (select 'count' as rule, 'passed' as status, count(distinct kind) as n from w where kind <> 'update' union all select 'discriminator', 'passed', count(distinct st) from w where kind = 'insert'
 union all select 'delta', 'passed', count(*) from u where p union all select 'value', 'passed', count(*) from u where st_seen union all select 'write', 'passed', count(*) from u where len(cols) = 0
 union all select 'invariant', case when up = total then 'passed' else 'failed' end, 1 from i, whole where n >= 2 and seen > 0 union all select 'invariant', 'passed', 1 from xfer_v0 having count(*) > 1)
 select rule, status, cast(sum(n) as bigint) as n, count(*) filter (where false) as pruned from x where n > 0 group by rule, status""")
def promote_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Promotion's trees decided over the changes that they come from: all hold, but for totals of updates where rows also came or went, as
    their caveat says. None of them is implied by another."""
    offers, cs = promoted(s, d)
    path = f"{shared_folder(s)}/candidates-{uuid.uuid4().hex}"
    offers.write.parquet(path)
    stored = s.read.parquet(path)
    lost = stored.join(tree.prune(stored).select("expression"), "expression", "left_anti").groupBy("rule").agg(F.count("*").alias("pruned"))
    found = tree.decide(cs, stored).groupBy("rule", "status").agg(F.count("*").alias("n"))
    return found.join(lost, "rule", "left").select("rule", "status", "n", F.coalesce("pruned", F.lit(0)).cast("long").alias("pruned"))


# -- keys and names ------------------------------------------------------------------------


_PARTED = "select event_id % 20 as a, event_id // 20 % 25 as b, event_id // 500 as c, event_id % 4 as d, event_type as e, case when event_id % 9 <> 0 then event_id end as f from events"


@query(f"""with t as ({_PARTED}), n as (select count(*) as n from t), k as (
 select 'a' as key, count(distinct a) = n as k from t, n group by n union all select 'b', count(distinct b) = n from t, n group by n union all select 'c', count(distinct c) = n from t, n group by n
 union all select 'a,b', count(distinct (a, b)) = n from t, n group by n union all select 'a,c', count(distinct (a, c)) = n from t, n group by n union all select 'b,c', count(distinct (b, c)) = n from t, n group by n union all select 'b,c,d', count(distinct (b, c, d)) = n from t, n group by n union all select 'a,b,c', count(distinct (a, b, c)) = n from t, n group by n)
 select key from k where k and not exists (select 1 from k x where x.k and x.key <> k.key and list_has_all(str_split(k.key, ','), str_split(x.key, ',')))""")
def key_search(s: SparkSession, d: str) -> DataFrame:
    """The minimal keys of a table that needs three columns for one; two of its other columns depend on these, one has NULLs."""
    t = view(s, d, "events").selectExpr("event_id % 20 as a", "cast(event_id div 20 % 25 as bigint) as b", "cast(event_id div 500 as bigint) as c", "event_id % 4 as d", "event_type as e", "case when event_id % 9 <> 0 then event_id end as f")
    return s.createDataFrame([(",".join(k),) for k in scope.minimal_keys(t, 3) if not {"e"} & set(k)], "key string")


@query("""with w as (select distinct role || ' ' || cast(conv_id % 40 as varchar) || case when turn % 2 = 0 then ' column' else ' name' end as k from conversations),
 u as (select k, case length(k) % 3 when 0 then substr(k, 1, 3) || 'x' || substr(k, 5) when 1 then substr(k, 2, 1) || substr(k, 1, 1) || substr(k, 3) else substr(k, 1, 4) || substr(k, 6) end as name from w),
 p as (select u.name, w.k as known, damerau_levenshtein(lower(u.name), lower(w.k)) as d from (select distinct name from u) u, w)
 select name, arg_min(known, (d, known)) as suggestion from p where d <= greatest(1, length(name) // 3) group by name""")
def loose_suggestions(s: SparkSession, d: str) -> DataFrame:
    """What files that people write may mean: the nearest name within a third of the written one's length."""
    c = view(s, d, "conversations")
    known = c.select(F.concat("role", F.lit(" "), (F.col("conv_id") % 40).cast("string"), F.when(F.col("turn") % 2 == 0, " column").otherwise(" name")).alias("name")).distinct()
    k, n = F.col("name"), F.length("name")
    slip = F.when(n % 3 == 0, F.concat(F.substring(k, 1, 3), F.lit("x"), F.substr(k, F.lit(5)))).when(n % 3 == 1, F.concat(F.substring(k, 2, 1), F.substring(k, 1, 1), F.substr(k, F.lit(3)))).otherwise(F.concat(F.substring(k, 1, 4), F.substr(k, F.lit(6))))
    return scope.suggest(known.select(slip.alias("name")).distinct(), known, loose=True)


# -- versions by range ----------------------------------------------------------------------


@query(_D + """, r as (select k, kind, ap, bp, k // 1000 as rg from d), c as (select * from r where kind = 'insert' or rg % 20 = 3),
 a as (select distinct o_orderkey // 1000 as rg from orders_v0 union select distinct rg from c), m as (select count(distinct rg) as ranges_read from c)
 select kind, count(*) as n, cast(sum(coalesce(ap, 0) - coalesce(bp, 0)) as decimal(38,2)) as delta, any_value(ranges_read) as ranges_read, (select count(*) from a) as ranges from c, m group by kind""")
def diff_by_ranges(s: SparkSession, d: str) -> DataFrame:
    """Versions stored by ranges of the key, of which a twentieth changed and some are new: the digests tell which files to read."""
    old, base = view(s, d, "orders_v0").drop(V), f"{shared_folder(s)}/version-{uuid.uuid4().hex}"
    rg = F.floor(F.col("o_orderkey") / 1000)
    touched = (rg % 20 == 3) | (F.col("o_orderkey") >= 10000000)
    new = view(s, d, "orders_v1").drop(V).where(touched).unionByName(old.where(~touched))
    for name, v in (("old", old), ("new", new)):
        capture.write_version(v, f"{base}/{name}", ORDERS, width=1000)
    c = capture.diff_versions(s, f"{base}/old", f"{base}/new", ORDERS)
    moved = capture.changed_ranges(s, f"{base}/old", f"{base}/new").agg(F.count("*").alias("ranges_read"))
    both = reduce(DataFrame.unionByName, (s.read.parquet(f"{base}/{n}/digests").select("_range") for n in ("old", "new"))).agg(F.count_distinct("_range").alias("ranges"))
    found = c.groupBy("kind").agg(F.count("*").alias("n"), _money(F.sum(select.delta(c, "o_totalprice"))).alias("delta"))
    return found.crossJoin(F.broadcast(moved)).crossJoin(F.broadcast(both))  # one row each
