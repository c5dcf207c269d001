"""Queries for samples, kernel sketches, their expansion and whole plans."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from sketchframe.operators import expand, sketch
from sketchframe.operators.reshape import split_width
from sketchframe.plans.sketching import SketchConfig, Split, sketch_central, sketch_vertical, squeeze_grid, squeeze_samples, store_party_samples
from sketchframe.queries.registry import (
    CUST_PART,
    CUST_ROWS,
    EMB,
    EMB_DIM,
    EMB_ROWS,
    K,
    PART_COUNT,
    key_sql,
    query,
    r6,
    rounded,
    select,
    streams,
)
from sketchframe.queries.reshaping import both
from sketchframe.session import fresh_path
from sketchframe.sources import views

SEED = 1
PORTION = 0.3
K1 = math.floor(K * PORTION)


# --- checking SQL ------------------------------------------------------------


def sampled_sql(out: str, method: str, cells: str = "x", k: int = K, party: str = "", rows: str = "rws", seed: int = SEED) -> list[str]:
    """CTE ``out``(row_id, j, s): samples counted from 0, -1 for an empty row."""
    ids = f"select f, j from (select distinct f from {cells} where v > 0), (select range as j from range({k}))"
    if method == "SM":
        names = ["u"]
        score = "-ln(u) / v"
    else:
        names = ["beta", "v1", "v2", "u1", "u2"]
        g = "(-ln(u1 * u2))"
        y = f"exp({g} * (floor(ln(v) / {g} + beta) - beta))"
        score = f"-ln(v1 * v2) * (u1 * u2) / {y}"
    keys = {name: key_sql(seed, name, party) for name in names}
    return [
        *streams(f"{out}_r", ids, ["f", "j"], keys),
        f"{out}_b as (select row_id, j, f from (select row_id, j, f, row_number() over"
        f" (partition by row_id, j order by {score}, f) as rn from {cells} join {out}_r using (f) where v > 0) where rn = 1)",
        f"{out} as (select row_id, j, coalesce(f, -1) as s from {rows} cross join (select range as j from range({k}))"
        f" left join {out}_b using (row_id, j))",
    ]


def based_sql(out: str, source: str) -> str:
    return f"{out} as (select row_id, j, s + 1 as s from {source})"


def coefficient_sql(out: str, c: int, k: int = K, offset: int = 0) -> list[str]:
    """CTE ``out``(j, a, b); ``offset`` moves which draws' coefficients are used."""
    ids = f"select range + {offset} as j from range({k})"
    return [
        *streams(f"{out}_c", ids, ["j"], {"ua": key_sql(1, "a"), "ub": key_sql(1, "b")}),
        f"{out} as (select j - {offset} as j, floor(ua * {c - 1})::bigint + 1 as a, floor(ub * {c})::bigint as b from {out}_c)",
    ]


def column_sql(width: str, place: str) -> str:
    return f"({width} * j + {width} - ({place}))::bigint"


COUNT_PLACE = "(a * s + b) % {c} + 1"

CUST = [CUST_PART, CUST_ROWS, PART_COUNT]
SM = [*sampled_sql("m", "SM"), based_sql("s", "m")]
PARTIES = [
    f"cut as (select n, floor(n * {PORTION}::double)::bigint as n1, n - floor(n * {PORTION}::double)::bigint as n2 from dim)",
    "xa as (select x.* from x, cut where f < n1)",
    "xb as (select row_id, f - n1 as f, v from x, cut where f >= n1)",
]


def party_sampled_sql(method: str) -> list[str]:
    return [
        *PARTIES,
        *sampled_sql("ma", method, "xa", K1, "A"),
        *sampled_sql("mb", method, "xb", K - K1, "B"),
        based_sql("sa", "ma"),
        based_sql("sb", "mb"),
    ]


def blocks_sql(b: int = 0, c: int = 0) -> list[str]:
    """CTE ``z``(row_id, col, v) of the two parties' blocks."""
    if c:
        place = COUNT_PLACE.format(c=c)

        def col(n: str) -> str:
            return f"case when {n} <= {c} then {column_sql(n, 's')} else {column_sql(str(c), place)} end"

        width = f"case when n1 <= {c} then n1 else {c} end"
        coefficients = [*coefficient_sql("ha", c, K1), *coefficient_sql("hb", c, K - K1, K1)]
        join_a, join_b = " join ha using (j)", " join hb using (j)"
    elif b:

        def col(n: str) -> str:
            return column_sql(str(2**b), f"s % {2**b} + 1")

        width, coefficients, join_a, join_b = str(2**b), [], "", ""
    else:

        def col(n: str) -> str:
            return column_sql(n, "s")

        width, coefficients, join_a, join_b = "n1", [], "", ""
    return [
        *coefficients,
        f"z as (select row_id, {col('n1')} as col, 1 as v from sa{join_a}, cut where s > 0 union all"
        f" select row_id, {col('n2')} + ({width}) * {K1} as col, 1 as v from sb{join_b}, cut where s > 0)",
    ]


def global_sql(b: int = 0, c: int = 0) -> list[str]:
    """CTE ``z`` with both parties in one id space."""
    joint = f"g as (select * from sa union all select row_id, j + {K1}, case when s > 0 then s + n1 else s end from sb, cut)"
    if c:
        place = COUNT_PLACE.format(c=c)
        return [
            joint,
            *coefficient_sql("hg", c),
            f"z as (select row_id, {column_sql(str(c), place)} as col, 1 as v from g join hg using (j) where s > 0)",
        ]
    col = column_sql(str(2**b), f"s % {2**b} + 1") if b else column_sql("n", "s")
    return [joint, f"z as (select row_id, {col} as col, 1 as v from g, cut where s > 0)"]


def fourier_sql(out: str, cells: str, k: int, gamma: str, party: str = "") -> list[str]:
    """CTE ``out``(row_id, j, v) of random Fourier features."""
    ids = f"select f, j from (select distinct f from {cells}), (select range as j from range({k}))"
    return [
        *streams(f"{out}_n", ids, ["f", "j"], {name: key_sql(SEED, name, party) for name in ("n1", "n2")}),
        *streams(f"{out}_p", f"select range as j from range({k})", ["j"], {"phase": key_sql(SEED, "b", party)}),
        f"{out}_d as (select row_id, j, sum(v * sqrt(2 * {gamma}) * sqrt(-2 * ln(n1)) * cos(2 * pi() * n2)) as z"
        f" from {cells} join {out}_n using (f) group by 1, 2)",
        f"{out} as (select row_id, j, sqrt(2.0::double / {k}) * cos(coalesce(z, 0) + 2 * pi() * phase) as v"
        f" from rws cross join {out}_p left join {out}_d using (row_id, j))",
    ]


def tensor_sql(out: str, cells: str, k: int, gamma: str, n: str, party: str = "") -> list[str]:
    """CTE ``out``(row_id, j, v) of the degree-2 sketch, by plain convolution."""
    names = ("h1", "s1", "h2", "s2")
    full = f"select row_id, f, v * sqrt({gamma}) as v from {cells} union all select row_id, {n} as f, 1.0::double from rws"
    side = (
        "{out}_{i} as (select row_id, floor(h{i} * {k})::bigint as p, sum(case when s{i} < 0.5 then -v else v end) as w"
        " from {out}_f join {out}_u using (f) group by 1, 2)"
    )
    return [
        f"{out}_f as ({full})",
        *streams(f"{out}_u", f"select distinct f from {out}_f", ["f"], {name: key_sql(SEED, name, party) for name in names}),
        *[side.format(out=out, i=i, k=k) for i in (1, 2)],
        f"{out}_c as (select l.row_id, (l.p + r.p) % {k} as j, sum(l.w * r.w) as v from {out}_1 l join {out}_2 r"
        " on l.row_id = r.row_id group by 1, 2)",
        f"{out} as (select row_id, j, coalesce(v, 0) as v from rws cross join (select range as j from range({k}))"
        f" left join {out}_c using (row_id, j))",
    ]


# --- samples -----------------------------------------------------------------


def customers(spark, root):
    return views.cust_part(spark, root), views.cust_rows(spark, root)


def based_samples(spark, root, k: int = K):
    x, rows = customers(spark, root)
    return sketch.one_based(sketch.p_minhash(x, rows, k, SEED))


@query(
    "shared_uniforms",
    select(
        f"select f, j, {r6('u', 12)} as u from r",
        streams("r", "select f, j from (select distinct l_partkey as f from lineitem), (select range as j from range(4))", ["f", "j"], {"u": key_sql(SEED, "u")}),
    ),
)
def shared_uniforms(spark, root):
    lines = views.table(spark, root, "lineitem").select(F.col("l_partkey").alias("f"))
    return sketch.shared_uniforms(lines, 4, SEED).withColumn("u", rounded("u", 12))


@query("p_minhash", select("select row_id, j, s from m", CUST, SM))
def p_minhash(spark, root):
    x, rows = customers(spark, root)
    return sketch.p_minhash(x, rows, K, SEED)


@query("cws_0bit", select("select row_id, j, s from m", CUST, sampled_sql("m", "MM")))
def cws_0bit(spark, root):
    x, rows = customers(spark, root)
    return sketch.cws_0bit(x, rows, K, SEED)


TERM_ID = "('0x' || substr(md5(term), 1, 15))::bigint"
DOC_TERMS = (
    f"x as (select doc_id as row_id, {TERM_ID} as f, count(*)::double as v from (select doc_id,"
    " unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as term from documents) where term <> '' group by 1, 2)"
)


@query(
    "p_minhash_terms",
    select("select row_id, j, s from m", DOC_TERMS, "rws as (select distinct doc_id as row_id from documents)", sampled_sql("m", "SM", k=8)),
)
def p_minhash_terms(spark, root):
    return sketch.p_minhash(views.doc_terms(spark, root), views.doc_rows(spark, root), 8, SEED)


@query("samples_one_based", select("select row_id, j, s from s", CUST, SM))
def samples_one_based(spark, root):
    return based_samples(spark, root)


# --- expansion ---------------------------------------------------------------


@query("sketch_plain", select(f"select row_id, {column_sql('n', 's')} as col, 1 as v from s, dim where s > 0", CUST, SM))
def sketch_plain(spark, root):
    return expand.sketch_plain(based_samples(spark, root), views.part_count(spark, root))


COUNT_SQL = select(
    f"select row_id, {column_sql('16', COUNT_PLACE.format(c=16))} as col, 1 as v from s join h using (j) where s > 0",
    CUST,
    SM,
    coefficient_sql("h", 16),
)


@query("sketch_count", COUNT_SQL)
def sketch_count(spark, root):
    return expand.sketch_count(based_samples(spark, root), 16)


@query("sketch_bbit", select(f"select row_id, {column_sql('16', 's % 16 + 1')} as col, 1 as v from s where s > 0", CUST, SM))
def sketch_bbit(spark, root):
    return expand.sketch_bbit(based_samples(spark, root), 4)


@query(
    "hash_coefficients",
    select(
        "select j, a, b, (a * (p_partkey + 1) + b) % 16 as bucket, count(*) as features"
        " from part cross join h group by all",
        coefficient_sql("h", 16),
    ),
)
def hash_coefficients(spark, root):
    """How the coefficients of each draw spread the parts over the buckets."""
    parts = views.table(spark, root, "part").select((F.col("p_partkey") + 1).alias("s"))
    drawn = expand.hash_coefficients(spark.range(K).withColumnRenamed("id", "j"), 16)
    spread = parts.selectExpr("s", f"explode(sequence(0L, {K - 1}L)) as j").join(F.broadcast(drawn), "j")  # K rows
    return spread.selectExpr("j", "a", "b", "pmod(a * s + b, 16L) as bucket").groupBy("j", "a", "b", "bucket").agg(F.count("*").alias("features"))


def party_tables(spark, root, method="SM"):
    """(samples with ``second``, width of the first party, width of the second)."""
    x, rows = customers(spark, root)
    n = views.part_count(spark, root)
    n1 = split_width(n, PORTION)
    draw = sketch.p_minhash_of_parties if method == "SM" else sketch.cws_0bit_of_parties
    return sketch.one_based(draw(x, rows, n1, K1, K - K1, SEED)), n1, n - n1


def two_parties(spark, root, method="SM"):
    both, n1, n2 = party_tables(spark, root, method)
    return both.where("not second").drop("second"), both.where("second").drop("second"), n1, n2


MODES = {"plain": {}, "count": {"c": 16}, "bbit": {"b": 4}}


def _register_two_party(kind: str, mode: str, sizes: dict[str, int]) -> None:
    ctes = global_sql(**sizes) if kind == "global" else blocks_sql(**sizes)

    @query(f"sketch2_{kind}_{mode}", select("select row_id, col, v from z", CUST, party_sampled_sql("SM"), ctes))
    def run(spark, root):
        samples, n1, n2 = party_tables(spark, root)
        return expand.expand_parties(samples, n1, n2, K1, blocks=kind == "blocks", **sizes)


for _kind in ("global", "blocks"):
    for _mode, _sizes in MODES.items():
        _register_two_party(_kind, _mode, _sizes)


@query(
    "sketch_resplit",
    "select case when col < cut then 'a' else 'b' end as party, row_id, case when col < cut then col else col - cut end as col, v"
    f" from ({COUNT_SQL}) z, (select floor({16 * K} * {PORTION}::double)::bigint as cut)",
)
def sketch_resplit(spark, root):
    left, right = expand.resplit_sketch(expand.sketch_count(based_samples(spark, root), 16), 16 * K, PORTION)
    return both(left, right, "party", "a", "b")


# --- kernel sketches ---------------------------------------------------------


def vectors(spark, root):
    rows = views.table(spark, root, "embeddings").select(F.col("vec_id").alias("row_id"))
    return views.emb(spark, root), rows


EMBS = [EMB, EMB_ROWS, EMB_DIM]


@query("rff", select(f"select row_id, j, {r6('v')} as v from d", EMBS, fourier_sql("d", "x", K, "0.5::double")))
def rff(spark, root):
    x, rows = vectors(spark, root)
    return sketch.rff(x, rows, K, 0.5, SEED).withColumn("v", rounded("v"))


@query("tensor_sketch", select(f"select row_id, j, {r6('v')} as v from d", EMBS, tensor_sql("d", "x", K, "0.5::double", "(select n from dim)")))
def tensor_sketch(spark, root):
    x, rows = vectors(spark, root)
    return sketch.tensor_sketch(x, rows, K, 0.5, views.emb_width(spark, root), seed=SEED).withColumn("v", rounded("v"))


# --- whole plans -------------------------------------------------------------


def cust_splits(spark, root):
    """Customers of nations below 20, and the others."""
    x, _ = customers(spark, root)
    base = views.table(spark, root, "customer").select(F.col("c_custkey").alias("row_id"), "c_nationkey")
    train, test = base.where("c_nationkey < 20").select("row_id"), base.where("c_nationkey >= 20").select("row_id")
    return Split(x.join(train, "row_id", "left_semi"), train), Split(x.join(test, "row_id", "left_semi"), test)


def vector_splits(spark, root):
    """Vectors of the first eight labels, and the rest."""
    x = views.emb(spark, root)
    y = views.emb_labels(spark, root)
    train, test = y.where("label < 8").select("row_id"), y.where("label >= 8").select("row_id")
    return Split(x.join(train, "row_id", "left_semi"), train), Split(x.join(test, "row_id", "left_semi"), test)


CUST_TAG = "tag as (select c_custkey as row_id, case when c_nationkey < 20 then 'train' else 'test' end as split from customer)"
EMB_TAG = "tag as (select vec_id as row_id, case when label < 8 then 'train' else 'test' end as split from embeddings)"
TAGGED = "select split, row_id, col, v from z join tag using (row_id)"
TAGGED_REAL = f"select split, row_id, col, {r6('v')} as v from z join tag using (row_id) where v <> 0"
# 1 / width / variance over all cells of the train split.
GAMMA = (
    "gam as (select (1.0::double / n) / (sum(v * v) / (m * n) - (sum(v) / (m * n)) * (sum(v) / (m * n))) as gamma"
    " from x join tag using (row_id), dim, (select count(*)::double as m from tag where split = 'train') c"
    " where split = 'train' group by n, m)"
)
GAMMA_VALUE = "(select gamma from gam)"


def _tagged(pair, digits=None):
    out = both(*pair, "split", "train", "test")
    return out if digits is None else out.withColumn("v", rounded("v", digits))


def _central(method: str, mode: dict, ctes: list[str]) -> None:
    @query(f"sketch_central_{method.lower()}", select(TAGGED, CUST, CUST_TAG, sampled_sql("m", method), based_sql("s", "m"), ctes))
    def run(spark, root):
        train, test = cust_splits(spark, root)
        return _tagged(sketch_central(train, test, SketchConfig(method, views.part_count(spark, root), K, seed=SEED, **mode)))


_central(
    "SM",
    {"c": 16},
    [*coefficient_sql("h", 16), f"z as (select row_id, {column_sql('16', COUNT_PLACE.format(c=16))} as col, 1 as v from s join h using (j) where s > 0)"],
)
_central("MM", {"b": 4}, [f"z as (select row_id, {column_sql('16', 's % 16 + 1')} as col, 1 as v from s where s > 0)"])


def _vertical(method: str, mode: dict) -> None:
    @query(f"sketch_vertical_{method.lower()}", select(TAGGED, CUST, CUST_TAG, party_sampled_sql(method), blocks_sql(**mode)))
    def run(spark, root):
        train, test = cust_splits(spark, root)
        cfg = SketchConfig(method, views.part_count(spark, root), K, seed=SEED, portion=PORTION, **mode)
        return _tagged(sketch_vertical(train, test, cfg))


_vertical("SM", {"c": 16})
_vertical("MM", {"c": 1000})


def _kernel_ctes(method: str, cells: str, out: str, k: int, n: str, party: str = "") -> list[str]:
    if method == "RBF":
        return fourier_sql(out, cells, k, GAMMA_VALUE, party)
    return tensor_sql(out, cells, k, GAMMA_VALUE, n, party)


def _central_kernel(method: str) -> None:
    ctes = [*_kernel_ctes(method, "x", "d", K, "(select n from dim)"), "z as (select row_id, j as col, v from d)"]

    @query(f"sketch_central_{method.lower()}", select(TAGGED_REAL, EMBS, EMB_TAG, GAMMA, ctes))
    def run(spark, root):
        train, test = vector_splits(spark, root)
        return _tagged(sketch_central(train, test, SketchConfig(method, views.emb_width(spark, root), K, seed=SEED)), 6)


def _vertical_kernel(method: str) -> None:
    ctes = [
        *PARTIES,
        *_kernel_ctes(method, "xa", "da", K1, "(select n1 from cut)", "A"),
        *_kernel_ctes(method, "xb", "db", K - K1, "(select n2 from cut)", "B"),
        f"z as (select row_id, j as col, v from da union all select row_id, j + {K1}, v from db)",
    ]

    @query(f"sketch_vertical_{method.lower()}", select(TAGGED_REAL, EMBS, EMB_TAG, GAMMA, ctes))
    def run(spark, root):
        train, test = vector_splits(spark, root)
        cfg = SketchConfig(method, views.emb_width(spark, root), K, seed=SEED, portion=PORTION)
        return _tagged(sketch_vertical(train, test, cfg), 6)


for _method in ("RBF", "Poly"):
    _central_kernel(_method)
    _vertical_kernel(_method)


SQUEEZE_C = 8


@query(
    "squeeze_samples",
    select(
        "select case when col < w then 'a' else 'b' end as party, row_id, case when col < w then col else col - w end as col, v from z,"
        f" (select floor((case when n1 <= {SQUEEZE_C} then n1 else {SQUEEZE_C} end * {K1}"
        f" + case when n2 <= {SQUEEZE_C} then n2 else {SQUEEZE_C} end * {K - K1}) * {PORTION}::double)::bigint as w from cut)",
        CUST,
        party_sampled_sql("SM"),
        blocks_sql(c=SQUEEZE_C),
    ),
)
def squeeze(spark, root):
    """Samples of two parties written as files, read back and compressed."""
    x, rows = customers(spark, root)
    cfg = SketchConfig("SM", views.part_count(spark, root), K, c=SQUEEZE_C, seed=SEED, portion=PORTION)
    path_a, path_b = fresh_path(spark, "samples_a"), fresh_path(spark, "samples_b")
    store_party_samples(Split(x, rows), cfg, path_a, path_b)
    left, right = squeeze_samples(spark, path_a, path_b, cfg, out=fresh_path(spark, "squeezed"))
    return both(left, right, "party", "a", "b")


GRID_K = 7
GRID_SIZES = [("plain", 0, 0), ("bits2", 2, 0), ("count8", 0, 8)]


def grid_sql(name: str, k: int, b: int, c: int) -> str:
    """One layout of the grid as a query of its own."""
    k1 = math.floor(k * PORTION)
    first, second = (f"case when {n} <= {c} then {n} else {c} end" if c else str(2**b) if b else n for n in ("n1", "n2"))
    w = f"(select floor(({first} * {k1} + {second} * {k - k1}) * {PORTION}::double)::bigint as w from cut)"

    def place(n: str) -> str:
        if c:
            return f"case when {n} <= {c} then {column_sql(n, 's')} else {column_sql(str(c), COUNT_PLACE.format(c=c))} end"
        return column_sql(str(2**b), f"s % {2**b} + 1") if b else column_sql(n, "s")

    joins = [f" join {h} using (j)" if c else "" for h in (f"{name}_ha", f"{name}_hb")]
    return (
        f"select '{name}' as layout, case when col < w then 'a' else 'b' end as party, row_id,"
        f" case when col < w then col else col - w end as col, 1 as v from {w}, ("
        f"select row_id, {place('n1')} as col from sa{joins[0]}, cut where s > 0 and j < {k1}"
        f" union all select row_id, {place('n2')} + ({first}) * {k1} from sb{joins[1]}, cut where s > 0 and j < {k - k1})"
    )


GRID = [(f"{size}_{k}", k, b, c) for size, b, c in GRID_SIZES for k in (GRID_K, K)]


@query(
    "squeeze_grid",
    select(
        " union all ".join(grid_sql(*g) for g in GRID),
        CUST,
        party_sampled_sql("SM"),
        *[
            part
            for name, k, _, c in GRID
            if c
            for k1 in [math.floor(k * PORTION)]
            for part in (coefficient_sql(f"{name}_ha", c, k1), coefficient_sql(f"{name}_hb", c, k - k1, k1))
        ],
    ),
)
def squeeze_all(spark, root):
    """Stored samples in six layouts, sizes by numbers of draws, from one read."""
    x, rows = customers(spark, root)
    whole = SketchConfig("SM", views.part_count(spark, root), K, seed=SEED, portion=PORTION)
    path_a, path_b = fresh_path(spark, "samples_a"), fresh_path(spark, "samples_b")
    store_party_samples(Split(x, rows), whole, path_a, path_b)
    layouts = {name: replace(whole, k=k, b=b, c=c) for name, k, b, c in GRID}
    return squeeze_grid(spark, path_a, path_b, layouts, out=fresh_path(spark, "grid"))
