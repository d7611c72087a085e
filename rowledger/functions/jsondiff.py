"""Leaf differences of JSON documents.

Documents are walked in the JVM, a level at a time: values of a row become an array of (path, value), in which each
object or array is replaced by what it holds, as often as the document is deep. Numbers go through as their own text,
so all their digits count, and are compared by value. What Spark's JSON reader refuses though it is JSON (very deep nesting,
names given twice, of which the last counts) goes to a walk without recursion in Python, in rows of its own; where there are none, no
Python worker is started.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of JSON. The patterns never go back, so long texts need no stack.
STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
NUMBER = r"-?+\d++(?:\.\d++)?+(?:[eE][+-]?+\d++)?+"
_PLAIN_NAME = r"^[^.\[\]\"]+$"
_MAP, _ARRAY = "map<string,variant>", "array<variant>"


def depth(text: Column) -> Column:
    """How deep objects and arrays are nested in a JSON text."""
    brackets = F.regexp_replace(F.regexp_replace(text, STRING, ""), r"[^\[\]{}]", "")
    step = lambda s, c: F.when(c.isin("[", "{"), F.struct((s["at"] + 1).alias("at"), F.greatest(s["most"], s["at"] + 1).alias("most"))).otherwise(F.struct((s["at"] - 1).alias("at"), s["most"].alias("most")))
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), lambda s, c: F.when(c == "", s).otherwise(step(s, c)), lambda s: s["most"])


def tagged(text: Column) -> Column:
    """The text with strings and numbers told apart as strings: s before the one, n before the other."""
    parts = F.regexp_extract_all(text, F.lit(rf'{STRING}\s*+:|{STRING}|{NUMBER}|[^"\d-]++|[\s\S]'), F.lit(0))
    one = lambda p: F.when(p.rlike(r'^"[\s\S]*:$'), p).when(p.startswith('"'), F.concat(F.lit('"s'), F.substr(p, F.lit(2)))).when(p.rlike(r"^-?\d"), F.concat(F.lit('"n'), p, F.lit('"'))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def number_value(token: Column) -> Column:
    """A text that is equal for equal numbers: sign, digits without zeros at their ends, place of the point."""
    whole, fraction = F.regexp_extract(token, r"^-?(\d+)", 1), F.regexp_extract(token, r"\.(\d+)", 1)
    power = F.regexp_extract(token, r"[eE]([+-]?\d+)$", 1)
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+", "")
    place = F.length(digits) - F.length(fraction) + F.when(power == "", F.lit(0).cast("long")).otherwise(power.try_cast("long"))
    core = F.regexp_replace(digits, "0+$", "")
    return F.when(core == "", "0").when(place.isNull(), token).otherwise(F.concat(F.when(token.startswith("-"), "-").otherwise(""), core, F.lit("e"), place.cast("string")))


def _name(path: Column, key: Column) -> Column:
    name = F.when(key.rlike(_PLAIN_NAME), key).otherwise(F.concat(F.lit("["), _quoted(key), F.lit("]")))
    return F.when(path == "", name).when(name.startswith("["), F.concat(path, name)).otherwise(F.concat(path, F.lit("."), name))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    js = F.to_json(F.array(text))
    return F.substring(js, F.lit(2), F.length(js) - 2)


def _children(x: Column) -> Column:
    held, listed = F.try_variant_get(x["value"], "$", _MAP), F.try_variant_get(x["value"], "$", _ARRAY)
    entry = lambda path, value: F.struct(path.alias("path"), value.alias("value"))
    return (
        F.when(F.size(held) > 0, F.transform(F.map_entries(held), lambda e: entry(_name(x["path"], e["key"]), e["value"])))
        .when(F.size(listed) > 0, F.transform(listed, lambda v, i: entry(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), v)))
        .otherwise(F.array(entry(x["path"], x["value"])))
    )


#: Where a number may lose digits, or be spelled in another way, when it is read as one.
_RISKY = r"\d{16}|\d[eE]|\d{8}\.\d{8}"


def _levels(text: Column) -> Column:
    """The depth; where there are few brackets, their number will do."""
    opened = F.length(text) - F.length(F.translate(text, "[{", ""))
    return F.when(opened <= 3, opened).otherwise(depth(text))


def leaves(text: Column, risky: Column) -> Column:
    """(path, leaf, same) of each leaf: its JSON text (numbers as they are written or shorter), and a text that is equal for equal values. Empty objects and arrays
    are leaves; NULL for what cannot be read. Texts to be compared are read in one way: with ``risky``, numbers go through as texts."""
    start = lambda v: F.when(v.isNotNull(), F.array(F.struct(F.lit("").alias("path"), v.alias("value"))))
    walked = lambda v: F.aggregate(F.array_repeat(F.lit(0), _levels(text)), start(v), lambda seen, _: F.flatten(F.transform(seen, _children)))

    def plain(x: Column) -> Column:
        shown = F.to_json(x["value"])
        return F.struct(x["path"].alias("path"), shown.alias("leaf"), shown.alias("same"))

    def leaf(x: Column) -> Column:
        s = F.try_variant_get(x["value"], "$", "string")
        kind, rest = F.substring(s, 1, 1), F.substr(s, F.lit(2))
        raw = F.to_json(x["value"])
        string = raw.startswith('"')
        shown = F.when(string & (kind == "n"), rest).when(string, _quoted(rest)).otherwise(raw)
        return F.struct(x["path"].alias("path"), shown.alias("leaf"), F.when(string & (kind == "n"), number_value(rest)).otherwise(shown).alias("same"))

    return F.when(risky, F.transform(walked(F.try_parse_json(tagged(text))), leaf)).otherwise(F.transform(walked(F.try_parse_json(text)), plain))


def leaf_diff(pairs: DataFrame, id_cols: list[str], before: str, after: str) -> DataFrame:
    """(ids, path, before_leaf, after_leaf, mark) for each leaf that was added, removed or changed; arrays go by index.

    Both sides' leaves are in the row, so no join and no shuffle is needed. One job before tells whether Spark can read them all."""
    b, a = F.col(before), F.col(after)
    odd = b.isNotNull() & a.isNotNull() & (F.try_parse_json(b).isNull() | F.try_parse_json(a).isNull())
    ids, some = [F.col(c) for c in id_cols], bool(pairs.where(odd).limit(1).count())
    usual = pairs.where(~odd) if some else pairs
    risky = F.coalesce(b.rlike(_RISKY) | a.rlike(_RISKY), F.lit(False))
    d = usual.select(*ids, leaves(b, risky).alias("_b"), leaves(a, risky).alias("_a"))
    if some:
        d = d.unionByName(_walked(pairs.where(odd).select(*ids, b.alias("_b"), a.alias("_a")), id_cols))
    by_path = lambda side: F.map_from_arrays(F.transform(side, lambda x: x["path"]), side)
    d = d.where(F.col("_b").isNotNull() & F.col("_a").isNotNull()).select(*ids, by_path(F.col("_b")).alias("_b"), by_path(F.col("_a")).alias("_a"))
    d = d.select(*ids, "_a", "_b", F.explode(F.array_union(F.map_keys("_b"), F.map_keys("_a"))).alias("path"))
    x, y = F.try_element_at("_b", F.col("path")), F.try_element_at("_a", F.col("path"))
    mark = F.when(x.isNull(), "added").when(y.isNull(), "removed").otherwise("changed")
    return d.where(~x["same"].eqNullSafe(y["same"])).select(*ids, "path", x["leaf"].alias("before_leaf"), y["leaf"].alias("after_leaf"), mark.alias("mark"))


_TOKEN = re.compile(rf'\s*+(?:(?P<s>{STRING})|(?P<n>-?(?:0|[1-9]\d*+)(?:\.\d++)?+(?:[eE][+-]?+\d++)?+)|(?P<w>true|false|null)|(?P<p>[\[\]{{}},:]))')


def walk(text: str) -> list[tuple[str, str, str]] | None:
    """``leaves`` of one text, of any depth, without recursion; None if it is no JSON."""
    out: dict[str, tuple[str, str]] = {}
    # each open container: its path, whether it is an object, the next index or name, how many values it has
    stack: list[list] = []
    at, state, path = 0, "value", ""

    names: list[set] = []
    while True:
        t = _TOKEN.match(text, at)
        if not t:
            if state != "end" or text[at:].strip():
                return None
            return [(p, *v) for p, v in out.items()]
        at, p = t.end(), t["p"]
        if state == "value" or (state == "first" and p != "]"):
            if p in ("[", "{"):
                stack.append([path, p == "{", 0])
                names.append(set())
                state = "first" if p == "[" else "name or end"
                if p == "[":
                    path = f"{path}[0]"
                continue
            if p:
                return None
            token = t["s"] or t["n"] or t["w"]
            if t["s"]:
                try:
                    shown = json.dumps(json.loads(token), ensure_ascii=False)
                except ValueError:
                    return None
                out[path] = (shown, shown)
            else:
                out[path] = (token, _number(token) if t["n"] else token)
        elif p in ("]", "}") and state in ("first", "name or end", "next"):
            if not stack or stack[-1][1] != (p == "}"):
                return None
            path, _, _ = stack.pop()
            names.pop()
            if state != "next":
                out[path] = ("[]", "[]") if p == "]" else ("{}", "{}")
        elif state in ("name", "name or end") and t["s"]:
            try:
                key = json.loads(t["s"])
            except ValueError:
                return None
            base = stack[-1][0]
            name = key if re.match(_PLAIN_NAME, key) else f"[{json.dumps(key, ensure_ascii=False)}]"
            path = name if not base else base + name if name[0] == "[" else f"{base}.{name}"
            if key in names[-1]:  # the last one counts
                for k in [k for k in out if k == path or k.startswith((path + ".", path + "["))]:
                    del out[k]
            names[-1].add(key)
            state = "colon"
            continue
        elif state == "colon" and p == ":":
            state = "value"
            continue
        elif state == "next" and p == "," and stack:
            if stack[-1][1]:
                state = "name"
            else:
                stack[-1][2] += 1
                path, state = f"{stack[-1][0]}[{stack[-1][2]}]", "value"
            continue
        else:
            return None
        state = "next" if stack else "end"


def _number(token: str) -> str:
    sign, whole, fraction, power = re.fullmatch(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?", token).groups()
    digits = (whole + (fraction or "")).lstrip("0")
    core = digits.rstrip("0")
    return f"{sign}{core}e{len(digits) - len(fraction or '') + int(power or 0)}" if core else "0"


def _walked(d: DataFrame, id_cols: list[str]) -> DataFrame:
    shape = "array<struct<path:string,leaf:string,same:string>>"
    kind = pa.list_(pa.struct([("path", pa.string()), ("leaf", pa.string()), ("same", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for c in b.columns[-2:]:
                found = [None if t is None else walk(t) for t in c.to_pylist()]
                sides.append(pa.array([None if f is None else [dict(zip(("path", "leaf", "same"), x, strict=True)) for x in f] for f in found], kind))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *sides], b.schema.names)

    ids = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in id_cols)
    return d.mapInArrow(run, f"{ids}, _b {shape}, _a {shape}")


def path_exists(text: Column, path: str) -> Column:
    """Whether a JSON text has the place that ``path`` ($.a.b) names, a JSON null included."""
    return F.try_variant_get(F.try_parse_json(text), path, "variant").isNotNull()
