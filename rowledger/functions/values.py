"""Values: typed equality, exact decimals, key tokens and labels, row text, names.

Two equalities are kept apart. Whether a column changed is null-safe equality of the
native values. Whether an assertion holds is ``eq_typed``, by the declared type.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Working type of exact arithmetic: as many digits as Spark has, the scale of the column.
DIGITS = 38
#: Fixed value: what counts as a decimal written as text.
DECIMAL_TEXT = r"^[+-]?\d+(\.\d+)?$"
#: Type names with a comparison of their own.
NUMBERS = ("smallint", "int", "bigint", "tinyint", "int2", "int4", "int8", "numeric", "decimal", "float", "float4", "float8", "double")
BOOLEANS = ("bool", "boolean")
JSON = ("json", "jsonb")


def decimal_of(text: Column, scale: int = 10) -> Column:
    """The decimal that a text or a number is, else NULL; exponents and bare points are not decimals."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(DECIMAL_TEXT), t.try_cast(f"decimal({DIGITS},{scale})"))


def exact(c: Column, dtype: T.DataType, scale: int = 10) -> Column:
    """A numeric column as a decimal of its own scale (18 digits before the point are kept at least)."""
    if isinstance(dtype, T.DecimalType):
        return c.cast(T.DecimalType(DIGITS, dtype.scale))
    if isinstance(dtype, T.IntegralType):
        return c.cast(T.DecimalType(DIGITS, 0))
    return decimal_of(c, scale)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def plus(a: Column, b: Column, scale: int) -> Column:
    """Exact sum with the scale kept; NULL on overflow. Spark keeps all digits of terms of 37; longer ones are added as whole and fraction."""
    t = T.DecimalType(DIGITS, scale)
    if scale == 0:
        return F.try_add(a.cast(t), b.cast(t)).cast(t)
    short = T.DecimalType(DIGITS - 1, scale).simpleString()
    x, y = a.cast(t), b.cast(t)
    # of the fractions, which are not negative, one may be carried
    part = lambda v: F.pmod(v, F.lit(1).cast("decimal(1,0)")).cast(T.DecimalType(scale + 1, scale))
    fraction = part(x) + part(y)
    carry = F.when(fraction >= 1, 1).otherwise(0)
    whole, left = F.try_add(F.try_add(F.floor(x), F.floor(y)), carry), (fraction - carry).cast(T.DecimalType(scale + 1, scale))
    back = (whole < 0) & (left > 0)
    number = lambda w, f: F.concat(w.cast("string"), F.substring(f.cast("string"), -scale - 1, scale + 1)).try_cast(t)
    one = F.lit(1).cast(T.DecimalType(scale + 1, scale))
    long = F.when(back, F.when(whole == -1, F.concat(F.lit("-"), (one - left).cast(T.DecimalType(scale + 1, scale)).cast("string")).try_cast(t)).otherwise(number(whole + 1, (one - left).cast(T.DecimalType(scale + 1, scale))))).otherwise(number(whole, left))
    return F.coalesce(F.try_add(x.try_cast(short), y.try_cast(short)).cast(t), long)


def minus(a: Column, b: Column, scale: int) -> Column:
    """Exact difference with the scale kept; NULL on overflow."""
    return plus(a, -b, scale)


def negate(a: Column) -> Column:
    return -a


def digits_of(text: Column) -> Column:
    """A decimal of any length as (negative, whole digits, whole, fraction), equal for equal numbers and ordered by size; NULL if it is none."""
    t = F.trim(text.cast("string"))
    whole = F.regexp_replace(F.regexp_extract(t, r"^[+-]?0*(\d*)", 1), "^0+", "")
    fraction = F.regexp_replace(F.regexp_extract(t, r"\.(\d*)$", 1), "0+$", "")
    nothing = (whole == "") & (fraction == "")
    return F.when(t.rlike(DECIMAL_TEXT), F.struct((t.startswith("-") & ~nothing).alias("negative"), F.length(whole).alias("n"), whole.alias("whole"), fraction.alias("fraction")))


def boolean_of(text: Column) -> Column:
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("t", "true"), True).when(t.isin("f", "false"), False)


def canonical_json(text: Column) -> Column:
    """Text that is equal for JSON values equal in structure: keys in order, numbers in one spelling; NULL if unreadable."""
    return F.to_json(F.try_parse_json(text))


def eq_typed(a: Column, b: Column, kind: str) -> Column:
    """Equality under a type's meaning, never NULL: NULL equals NULL alone. ``a`` and ``b`` are texts or native values."""
    kind = kind.lower().split("(")[0]
    sa, sb = a.cast("string"), b.cast("string")
    text = sa == sb
    if kind in BOOLEANS:
        x, y = boolean_of(a), boolean_of(b)
        same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(text)
    elif kind in JSON:
        x, y = canonical_json(sa), canonical_json(sb)
        same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(text)
    elif kind in NUMBERS:
        x, y = digits_of(a), digits_of(b)
        same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(text)
    elif kind == "citext":
        same = F.lower(sa) == F.lower(sb)
    else:
        same = text
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def compare_numbers(a: Column, b: Column, op: str) -> Column:
    """< <= > >= by decimal value, digit by digit, so any length is exact; NULL (not decidable) if either is no decimal."""
    x, y = digits_of(a), digits_of(b)
    size = lambda v: F.struct(v["n"], v["whole"], v["fraction"])
    below = lambda p, q: F.when(p["negative"] != q["negative"], p["negative"]).when(p["negative"], size(q) < size(p)).otherwise(size(p) < size(q))
    answer = {"<": below(x, y), "<=": ~below(y, x), ">": below(y, x), ">=": ~below(x, y)}[op]
    return F.when(x.isNotNull() & y.isNotNull(), answer)


def comparable(c: Column, dtype: T.DataType) -> Column:
    """Maps have no equality: they are compared as the JSON of their entries in order of key."""
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    return c


def key_token(salt: str, keys: list[Column], names: list[str]) -> Column:
    """A salted name for a row: 24 hex digits; a NULL part is a part."""
    js = F.to_json(F.struct(*(k.alias(n) for k, n in zip(keys, names, strict=True))), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(F.concat(F.lit(salt), js), 256), 1, 24)


def key_label(keys: list[Column], masked: list[bool] | None = None) -> Column:
    """The key as one text: parts joined by a bar, NULL and masked parts spelled out; '(unkeyed)' without a key."""
    if not keys:
        return F.lit("(unkeyed)")
    masked = masked or [False] * len(keys)
    return F.concat_ws("|", *(F.lit("•••") if m else F.coalesce(k.cast("string"), F.lit("NULL")) for k, m in zip(keys, masked, strict=True)))


def quote_name(name: str) -> str:
    if "\x00" in name:
        raise ValueError("a name cannot hold a NUL byte")
    return '"' + name.replace('"', '""') + '"'


def quote_value(c: Column) -> Column:
    """A value as an SQL literal; backslashes need the E form."""
    s = c.cast("string")
    doubled = F.replace(s, F.lit("'"), F.lit("''"))
    slashed = F.replace(doubled, F.lit("\\"), F.lit("\\\\"))
    return F.when(s.contains("\\"), F.concat(F.lit("E'"), slashed, F.lit("'"))).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))


def row_select(table: str, names: list[str], keys: list[Column], schema: str | None = None) -> Column:
    """SELECT text that finds the row again; NULL if a value holds a NUL byte."""
    where = [F.concat(F.lit(quote_name(n)), F.when(k.isNull(), F.lit(" IS NOT DISTINCT FROM NULL")).otherwise(F.concat(F.lit(" = "), quote_value(k)))) for n, k in zip(names, keys, strict=True)]
    source = quote_name(table) if schema is None else f"{quote_name(schema)}.{quote_name(table)}"
    bad = reduce(lambda a, b: a | b, (F.coalesce(F.instr(k.cast("string"), "\x00") > 0, F.lit(False)) for k in keys))
    return F.when(~bad, F.concat(F.lit(f"SELECT * FROM {source} WHERE "), F.concat_ws(" AND ", *where)))


def close_name(a: Column, b: Column) -> Column:
    """Whether two names are one slip apart: a letter changed, missing or more, or two neighbours swapped; case aside."""
    x, y = F.lower(a), F.lower(b)
    d = F.levenshtein(x, y)
    i = F.length(F.regexp_extract(F.concat(x, F.lit("\n"), y), r"^(.*)(.*)\n\1", 1))  # common beginning, greedy
    swapped = (F.length(x) == F.length(y)) & (d == 2) & (F.substr(x, i + 1, F.lit(1)) == F.substr(y, i + 2, F.lit(1))) & (F.substr(x, i + 2, F.lit(1)) == F.substr(y, i + 1, F.lit(1))) & (F.substr(x, i + 3) == F.substr(y, i + 3))
    return (d <= 1) | swapped


def _typing_distances(a: list[str], b: list[str]) -> np.ndarray:
    """``typing_distance`` of many pairs at once: a cell of all their tables is one step."""
    n, m = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    spread = lambda ts, width: np.array([[ord(c) for c in t.ljust(width, "\0")] for t in ts], np.int32).reshape(len(ts), -1)
    x, y = spread(a, n.max(initial=0)), spread(b, m.max(initial=0))
    rows = [np.tile(np.arange(y.shape[1] + 1), (len(a), 1))]
    out = np.where(n == 0, m, 0)
    for i in range(1, x.shape[1] + 1):
        row = np.full_like(rows[-1], i)
        for j in range(1, y.shape[1] + 1):
            best = np.minimum(np.minimum(rows[-1][:, j], row[:, j - 1]) + 1, rows[-1][:, j - 1] + (x[:, i - 1] != y[:, j - 1]))
            if i > 1 and j > 1:
                swapped = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                best = np.where(swapped, np.minimum(best, rows[-2][:, j - 2] + 1), best)
            row[:, j] = best
        rows = [rows[-1], row]
        at = n == i
        out[at] = row[at, m[at]]
    return out


def close(a: str, b: str) -> bool:
    """``close_name`` of two names at hand."""
    return int(_typing_distances([a.lower()], [b.lower()])[0]) <= 1


@F.pandas_udf(T.IntegerType())
def _typing_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_typing_distances([t.lower() for t in a], [t.lower() for t in b]), dtype="int32") if len(a) else pd.Series([], dtype="int32")


def typing_distance(a: Column, b: Column) -> Column:
    """Edits between two texts, case aside: a letter changed, missing or more, or two neighbours swapped, no letter touched twice. NULL if
    either is NULL. For pairs that an index has found; the tables of a batch of pairs are filled together."""
    none = a.isNull() | b.isNull()
    return F.when(~none, _typing_distance(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))


def loose_limit(name: Column) -> Column:
    """The edits that the looser rule of files that people write allows: a third of the name's length, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(name) / 3)).cast("int")


def loosely_close_name(a: Column, b: Column) -> Column:
    """Whether ``b`` is close to the name ``a`` that somebody wrote, by the looser rule."""
    return typing_distance(a, b) <= loose_limit(a)


def json_summary(text: Column, most: int = 3) -> Column:
    """'[n]' for an array, '{n keys} a, b, c…' for an object, else the text."""
    n, keys = F.json_array_length(text), F.array_sort(F.json_object_keys(text))
    names = F.concat(F.array_join(F.slice(keys, 1, most), ", "), F.when(F.size(keys) > most, F.lit("…")).otherwise(F.lit("")))
    return F.when(n.isNotNull(), F.concat(F.lit("["), n, F.lit("]"))).when(keys.isNotNull(), F.concat(F.lit("{"), F.size(keys), F.lit(" keys} "), names)).otherwise(text)


#: Fixed value: a string of a JSON text with the colon that makes it a key, a string, or what is between strings.
JSON_PARTS = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"(?:\s*+:)?+|[^"]++|"'
#: Bytes of known values that are sent to every task.
MOST_SECRETS = 64 << 20


def scrub(c: Column, secrets: dict[str, str], least: int = 6) -> Column:
    """A few known values replaced by their marks, longest first; shorter ones than ``least`` are left, as they occur by chance.
    For long lists, see ``scrub_texts``."""
    for value, mark in _by_length(secrets, least):
        c = F.replace(c, F.lit(value), F.lit(mark))
    return c


def scrub_json(c: Column, secrets: dict[str, str], least: int = 6) -> Column:
    """The same inside a JSON text, whose keys are spared. Strings are compared as what they say, however their signs are
    escaped; a string that holds a value is written anew. For long lists, see ``scrub_texts`` with ``json``."""
    parts = F.regexp_extract_all(c, F.lit(JSON_PARTS), F.lit(0))

    def one(x: Column) -> Column:
        said = F.try_variant_get(F.try_parse_json(x), "$", "string")
        clean = scrub(said, secrets, least)
        written = F.to_json(F.array(clean))
        return F.when(~x.startswith('"') | x.endswith(":"), x).when(said.isNull(), scrub(x, secrets, least)).when(clean == said, x).otherwise(F.substring(written, F.lit(2), F.length(written) - 2))

    return F.array_join(F.transform(parts, one), "")


def _by_length(secrets: dict[str, str], least: int) -> list[tuple[str, str]]:
    return sorted(((v, m) for v, m in secrets.items() if len(v) >= least), key=lambda x: (-len(x[0]), x[0]))


def scrub_texts(texts: DataFrame, secrets: DataFrame, column: str, value: str = "value", mark: str = "mark", least: int = 6, out: str = "scrubbed", json: bool = False) -> DataFrame:
    """Adds ``out``: the text with all known values (rows of value and mark) replaced as ``scrub`` does; with ``json``, as ``scrub_json`` does.

    Each task finds the values that occur with one automaton, in one pass; each value that does occur costs another one over
    that text, or over that string of a JSON text. The values are sent to all tasks, behind a check of their bytes;
    a list beyond ``MOST_SECRETS`` is dealt into blocks by length, one pass for each."""
    known = secrets.where(F.length(value) >= least).groupBy(value).agg(F.min(mark).alias(mark))
    known = known.withColumn("_bytes", F.octet_length(value) + F.octet_length(mark))
    lengths = known.groupBy(F.length(value).alias("n")).agg(F.sum("_bytes").alias("bytes")).orderBy(F.desc("n")).collect()  # one row for each length
    blocks: list[tuple[int, int, int]] = []
    for r in lengths:
        if blocks and blocks[-1][2] + r["bytes"] <= MOST_SECRETS:
            blocks[-1] = (r["n"], blocks[-1][1], blocks[-1][2] + r["bytes"])
        else:
            blocks.append((r["n"], r["n"], r["bytes"]))
    d = texts.withColumn(out, F.col(column))
    for low, high, _ in blocks:
        part = {r[0]: r[1] for r in known.where(F.length(value).between(low, high)).select(value, mark).collect()}
        d = _scrub_pass(d, out, _by_length(part, 0), json)
    return d


def _scrub_pass(d: DataFrame, column: str, secrets: list[tuple[str, str]], json_texts: bool) -> DataFrame:
    names, sent = [f.name for f in d.schema.fields], d.sparkSession.sparkContext.broadcast(secrets)
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import re

        import ahocorasick

        found = ahocorasick.Automaton()
        for i, (v, _) in enumerate(sent.value):
            found.add_word(v, i)
        found.make_automaton()

        def one(text: str | None) -> str | None:
            done = -1
            # a replacement may bring a later value together, never an earlier one back into turn
            while text and (todo := sorted({i for _, i in found.iter(text) if i > done})):
                done = todo[0]
                text = text.replace(*sent.value[done])
            return text

        def part(m: re.Match) -> str:
            token = m[0]
            if token[0] != '"' or token[-1] == ":":
                return token
            try:
                said = json.loads(token, strict=False)
            except ValueError:  # no string after all
                return one(token)
            clean = one(said)
            return token if clean == said else json.dumps(clean, ensure_ascii=False)

        parts = re.compile(JSON_PARTS)
        clean = (lambda t: None if t is None else parts.sub(part, t)) if json_texts else one
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return d.mapInArrow(run, d.schema)
