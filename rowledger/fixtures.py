"""Versions, logs and runs derived from the tables: one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Views build on one another in this order.
VIEWS = {
    "orders_v0": "select o_orderkey,o_custkey,o_orderstatus,cast(o_totalprice as decimal(18,2)) as o_totalprice,o_orderdate,o_orderpriority,0 as row_version from orders",
    "orders_v1": """select o_orderkey,o_custkey,
 case when o_orderkey % 11 = 3 then 'X' else o_orderstatus end as o_orderstatus,
 cast(case when o_orderkey % 13 = 5 then o_totalprice + 100 else o_totalprice end as decimal(18,2)) as o_totalprice,
 o_orderdate,o_orderpriority,
 case when o_orderkey % 11 = 3 or o_orderkey % 13 = 5 or o_orderkey % 23 = 7 then 1 + o_orderkey % 5 else 0 end as row_version
 from orders_v0 where o_orderkey % 17 <> 0
 union all select o_orderkey + 10000000,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority,1 + o_orderkey % 5 from orders_v0 where o_orderkey % 19 = 1""",
    "orders_idle": "select o_orderkey,o_custkey,case when o_orderkey % 997 = 1 then 'N' else o_orderstatus end as o_orderstatus,o_totalprice,o_orderdate,o_orderpriority,case when o_orderkey % 997 = 1 then 1 else 0 end as row_version from orders_v0",
    "line_v0": "select l_returnflag,l_linestatus,cast(l_quantity as decimal(12,2)) as l_quantity,l_linenumber from lineitem",
    "line_v1": "select l_returnflag,l_linestatus,cast(l_quantity as decimal(12,2)) as l_quantity,l_linenumber from lineitem where l_orderkey % 29 <> 0 union all select l_returnflag,l_linestatus,cast(l_quantity as decimal(12,2)),l_linenumber from lineitem where l_orderkey % 31 = 2",
    "conv_v0": "select conv_id,turn,role,length(text) as n from conversations",
    "conv_v1": "select conv_id,turn,role,length(text) + case when turn % 3 = 1 then 1 else 0 end as n from conversations where not (conv_id % 7 = 0 and turn = 0)",
    "log": """select event_id as sequence, event_id - event_id % 4 as transaction_id, (event_id + 1) * 16 as lsn,
 case when event_id % 50 = 49 then 'other' else 'accounts' end as table_name,
 case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end as operation,
 user_id as id, cast(value as decimal(12,2)) as amount, ts,
 case when event_id % 4 = 3 and event_id % 40 <> 39 then true else false end as is_commit from events""",
    "log_text": """select sequence, transaction_id, 'table public.' || table_name || ': ' || upper(operation) || ': id[bigint]:' || cast(id as string) ||
 case when operation = 'delete' then '' else ' amount[numeric]:' || cast(amount as string) || ' note[text]:''it''''s ' || cast(sequence % 3 as string) || '''' end as line from log""",
    "cust_v0": "select c_custkey,c_nationkey,c_mktsegment,cast(c_acctbal as decimal(18,2)) as c_acctbal,0 as row_version from customer",
    "cust_v1": """select c_custkey,c_nationkey,case when c_custkey % 7 = 1 then 'BUILDING' when c_custkey % 7 = 2 then 'MACHINERY' else c_mktsegment end as c_mktsegment,
 cast(case when c_custkey % 5 = 0 then c_acctbal - 10 else c_acctbal end as decimal(18,2)) as c_acctbal,
 case when c_custkey % 7 in (1,2) or c_custkey % 5 = 0 then 1 else 0 end as row_version from cust_v0 where c_custkey % 41 <> 0""",
    "json_pairs": """select event_id, props as before_j, case when event_id % 3 = 0 then replace(props,'}', ', "a": {"x": 1, "y": [1,2]}}') when event_id % 3 = 1 then '{"z": 0, ' || substr(props,2) else replace(props,' ','') end as after_j from events""",
    "xfer_v0": "select c_custkey as id, cast(c_acctbal as decimal(18,2)) as balance from customer",
    "xfer_v1": "select id, cast(case when id % 10 = 0 then balance - 40 when id % 10 = 1 then balance + 40 else balance end as decimal(18,2)) as balance from xfer_v0",
    "responses": """select event_id as step_no, case event_type when 'error' then 500 when 'signup' then 201 else 200 end as status, '{"id": ' || cast(user_id as string) || ', "meta": ' || props || '}' as body from events""",
    "series_steps": "select distinct event_id % 128 as step_no from events",
    "series_obs": "select event_id % 128 as step_no, user_id as id, cast(value as decimal(12,2)) as v from events where event_type <> 'error'",
    "runs": """select conv_id as run_id, conv_id % 5 as scenario_id, turn as step_no, role,
 case when (conv_id * 7 + turn * 3) % 29 = 0 then 'errored' when (conv_id * 7 + turn * 3) % 31 = 1 then 'skipped' else 'passed' end as step_status,
 case when (conv_id * 5 + turn) % 17 = 0 then 'failed' when (conv_id * 5 + turn) % 19 = 1 then 'unevaluable' when (conv_id * 5 + turn) % 23 = 2 then 'passed-as-refused' else 'passed' end as a_status,
 case when (conv_id + turn) % 37 = 0 then 'scope-truncated' when (conv_id + turn) % 11 = 0 then 'degraded-row-identity' end as w_code from conversations""",
    "features": """select cast(conv_id * 100 + turn as string) as assertion_id, 0 as ordinal, case (conv_id + turn) % 7 when 1 then 'ordres' when 2 then 'lineitem' when 3 then 'custmoer' when 4 then 'customer' when 6 then '*' else 'orders' end as table_name,
 case when turn % 4 > 1 then '*' when (conv_id + turn) % 5 = 0 then 'o_totalprise' when (conv_id + turn) % 5 = 1 then 'c_acctbal' when (conv_id + turn) % 5 = 2 then 'l_quantity' else 'o_totalprice' end as column_name,
 case turn % 4 when 0 then 'read' when 1 then 'match' when 2 then 'select' else 'except' end as use_kind,
 case conv_id % 4 when 0 then 'count' when 1 then 'hasWrite' when 2 then 'atomic' else 'sum' end as question, case conv_id % 3 when 0 then 'deleted' when 1 then 'changes' else 'inserted' end as selector_kind from conversations""",
    "run_orders_v0": "select o_orderkey % (select max(conv_id) + 1 from conversations) as run_id, o_orderkey, o_orderstatus, o_totalprice from orders_v0",
    "run_orders_v1": "select o_orderkey % (select max(conv_id) + 1 from conversations) as run_id, o_orderkey, o_orderstatus, o_totalprice from orders_v1",
    "run_list": "select run_id, case when run_id % 2 = 0 then 'write' else 'value' end as detection, case when run_id % 4 = 0 then 'net' else 'transactional' end as fidelity from runs group by run_id",
    "log_pairs": """select event_id as sequence, event_id - event_id % 4 as transaction_id, '0/' || hex(event_id) as lsn, event_id as place, case when event_id % 4 = 3 and event_id % 40 <> 39 then true else false end as is_commit from events""",
    "log_kinds": """select event_id as sequence, 'table "pub""lic"."we""ird": INSERT: id[bigint]:' || cast(event_id as string) || ' ok[boolean]:' || case event_id % 2 when 0 then 'true' else 'false' end || ' bits[bit]:B''10''' ||
 ' left[text]:unchanged-toast-datum none[text]:null say[text]:''it''''s ' || event_type || '''' as line from events""",
    "fine_v0": "select event_id as id, cast(value as decimal(30,10)) as x from events",
    "fine_v1": "select event_id as id, cast(cast(value as decimal(30,10)) + 0.0000000001 as decimal(30,10)) as x from events where event_id % 3 <> 0",
}


def needed(sql: str) -> list[str]:
    """Views that a text names, and those they build on, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for v, body in VIEWS.items():
            if v not in found and re.search(rf"\b(from|join)\s+{v}\b", text):
                found.add(v)
                todo.append(body)
    return [v for v in VIEWS if v in found]


def prelude(sql: str) -> str:
    """The text with its views as common table expressions."""
    views = [f"{v} as ({VIEWS[v]})" for v in needed(sql)]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join([*views, body[5:]])
    return ("with " + ", ".join(views) + " " if views else "") + body


def view(spark: SparkSession, sf_dir: str, name: str):
    """One view (or table) over a folder of tables. Views are resolved at once, so folders do not mix."""
    wanted = [*needed(f"from {name}")]
    text = " ".join([f"from {name}", *(VIEWS[v] for v in wanted)])
    for t in TABLES:
        if re.search(rf"\b(from|join)\s+{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for v in wanted:
        spark.sql(VIEWS[v]).createOrReplaceTempView(v)
    return spark.table(name)
