"""Registry of queries and helpers for their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchframe.functions.hashing import stream_key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::double"


def select(final: str, *parts: str | list[str]) -> str:
    """WITH the given common table expressions, then ``final``."""
    flat = [p for part in parts for p in ([part] if isinstance(part, str) else part)]
    return "with " + ",\n".join(flat) + "\n" + final


# --- xxhash64 in SQL --------------------------------------------------------
# The 64-bit primes of the public xxHash definition and Spark's seed.
P1 = 0x9E3779B185EBCA87
P2 = 0xC2B2AE3D27D4EB4F
P3 = 0x165667B19E3779F9
P4 = 0x85EBCA77C2B2AE63
P5 = 0x27D4EB2F165667C5
SPARK_SEED = 42
MASK = 2**64 - 1


def big(value: int) -> str:
    return f"{value}::uhugeint"


def key_sql(seed: int, stream: str, party: str = "", repeat: int = 1) -> str:
    return big(stream_key(seed, stream, party, repeat) & MASK)


def _mul(x: str, factor: int) -> str:
    return f"(({x}) * {big(factor)}) & {big(MASK)}"


def _rotated(x: str, bits: int) -> str:
    return f"((({x}) << {bits}) & {big(MASK)}) | (({x}) >> {64 - bits})"


def _round(source: str, out: str, value: str, seed: str, tag: str) -> str:
    """One 8-byte round; later columns use the earlier ones of the same select."""
    steps = [
        (f"{tag}0", _mul(value, P2)),
        (f"{tag}1", _mul(_rotated(f"{tag}0", 31), P1)),
        (f"{tag}2", f"xor(({seed} + {big(P5 + 8)}) & {big(MASK)}, {tag}1)"),
        (f"{tag}3", _mul(_rotated(f"{tag}2", 27), P1)),
        (f"{tag}4", f"({tag}3 + {big(P4)}) & {big(MASK)}"),
        (f"{tag}5", _mul(f"xor({tag}4, {tag}4 >> 33)", P2)),
        (f"{tag}6", _mul(f"xor({tag}5, {tag}5 >> 29)", P3)),
        (f"{tag}h", f"xor({tag}6, {tag}6 >> 32)"),
    ]
    columns = ", ".join(f"{expression} as {name}" for name, expression in steps)
    return f"{out} as (select *, {columns} from {source})"


def hashed(out: str, source: str, two: bool = True) -> list[str]:
    """CTEs that add ``h`` (signed 64 bits) and ``u`` to a query.

    The query has a column ``k`` (key), ``a`` and, with ``two``, ``b``; both ids
    must not be negative.
    """
    first = _round(f"{out}_in", f"{out}_r1", "xor(k, a::uhugeint)", big(SPARK_SEED), "x")
    ctes = [f"{out}_in as ({source})", first]
    last, bits = f"{out}_r1", "xh"
    if two:
        ctes.append(_round(last, f"{out}_r2", "b::uhugeint", "xh", "y"))
        last, bits = f"{out}_r2", "yh"
    signed = f"case when {bits} >= {big(2**63)} then ({bits}::hugeint - 18446744073709551616::hugeint)::bigint else {bits}::bigint end"
    u = f"((({bits} >> 12)::bigint)::double + 0.5::double) / 4503599627370496::double"
    ctes.append(f"{out} as (select *, {bits} as bits, {signed} as h, {u} as u from {last})")
    return ctes


def streams(out: str, ids: str, columns: list[str], keys: dict[str, str]) -> list[str]:
    """CTE ``out`` with the id columns of query ``ids`` and one uniform per named key."""
    table = ", ".join(f"('{name}', {key})" for name, key in keys.items())
    second = f", i.{columns[1]} as b" if len(columns) > 1 else ""
    source = f"select i.*, s.name, s.k, i.{columns[0]} as a{second} from ({ids}) i, (values {table}) s(name, k)"
    pivot = ", ".join(f"max(case when name = '{name}' then u end) as {name}" for name in keys)
    group = ", ".join(columns)
    return [
        *hashed(f"{out}_h", source, len(columns) > 1),
        f"{out} as (select {group}, {pivot} from {out}_h group by {group})",
    ]


# --- feature views in SQL ---------------------------------------------------

K = 16

CUST_PART = (
    "x as (select o_custkey as row_id, l_partkey as f, sum(l_quantity) as v"
    " from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"
)
CUST_ROWS = "rws as (select c_custkey as row_id from customer)"
PART_COUNT = "dim as (select max(p_partkey) + 1 as n from part)"
EMB = (
    "x as (select vec_id as row_id, (pos - 1)::bigint as f, embedding[pos]::double as v"
    " from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as pos from embeddings)"
    " where embedding[pos] <> 0)"
)
EMB_ROWS = "rws as (select vec_id as row_id from embeddings)"
EMB_DIM = "dim as (select max(len(embedding))::bigint as n from embeddings)"
EVENT_TYPES_SQL = "(select event_type as name, row_number() over (order by event_type) - 1 as f from (select distinct event_type from events where event_type is not null)) t"
EVENT_MIX = (
    "x as (select user_id as row_id, f::bigint as f, sum(value) as v"
    f" from events join {EVENT_TYPES_SQL} on event_type = name group by 1, 2)"
)
EVENT_ROWS = "rws as (select distinct user_id as row_id from events)"
DRAWS = f"draws as (select range as j from range({K}))"

