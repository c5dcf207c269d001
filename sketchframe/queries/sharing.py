"""Queries for share tables and encrypted sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from sketchframe.operators import encrypted, paillier, reshape, shares, wide
from sketchframe.queries.registry import CUST_PART, EMB, EMB_DIM, EMB_ROWS, hashed, key_sql, query, r6, rounded, select
from sketchframe.queries.reshaping import DENSE_EMB
from sketchframe.queries.sketches import vectors
from sketchframe.sources import views

RING = str(shares.RING)
SIZE_LOG = "floor(log2(abs(l_discount)))"
EXACT_LOG = (
    f"(case when pow(2.0, {SIZE_LOG}) > abs(l_discount) then {SIZE_LOG} - 1"
    f" when pow(2.0, {SIZE_LOG} + 1) <= abs(l_discount) then {SIZE_LOG} + 1 else {SIZE_LOG} end)"
)
OWN = f"(case when l_discount = 0 then 13 else floor((53 - ({EXACT_LOG} + 1)) / 4.0) end)::int"


def ring_sql(x: str, exponent: str) -> str:
    return f"(((round_even({x} * pow(16.0::double, {exponent}), 0))::bigint + {RING}) % {RING})::bigint"


@query(
    "fixed_point",
    f"select l_orderkey, l_linenumber, {ring_sql('(l_discount - l_tax)', '4')} as encoding,"
    f" (round_even((l_discount - l_tax) * 65536, 0) / 65536)::double + 0.0::double as decoded,"
    f" {OWN} as own_exponent, {ring_sql('l_discount', OWN)} as own_encoding,"
    f" {ring_sql('l_discount', OWN)}::double / pow(16.0::double, {OWN}) as own_decoded from lineitem",
)
def fixed_point(spark, root):
    lines = views.table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    fixed = shares.fixed_encode(F.col("l_discount") - F.col("l_tax"), 4)
    own = shares.fixed_encode(F.col("l_discount"))
    coded = lines.select("l_orderkey", "l_linenumber", fixed.alias("a"), own.alias("b"))
    return coded.select(
        "l_orderkey",
        "l_linenumber",
        F.col("a.encoding").alias("encoding"),
        (shares.fixed_decode(F.col("a.encoding"), 4) + 0.0).alias("decoded"),
        F.col("b.exponent").alias("own_exponent"),
        F.col("b.encoding").alias("own_encoding"),
        shares.fixed_decode(F.col("b.encoding"), F.col("b.exponent")).alias("own_decoded"),
    )


WIDE = "1329227995784915872903807060280344576::hugeint"


@query(
    "fixed_precision",
    f"select l_orderkey, l_linenumber, {ring_sql('l_tax', '3')} as by_precision, greatest({OWN}, 13)::int as exponent,"
    f" {ring_sql('l_discount', f'greatest({OWN}, 13)')} as raised, 0::bigint as tiny from lineitem",
)
def fixed_precision(spark, root):
    """The exponent from a precision, one that is raised to a least one, and values too small to keep."""
    lines = views.table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    raised = shares.fixed_encode(F.col("l_discount"), max_exponent=13)
    coded = lines.select(
        "l_orderkey",
        "l_linenumber",
        shares.fixed_encode(F.col("l_tax"), precision=5000.0)["encoding"].alias("by_precision"),
        raised.alias("r"),
        shares.fixed_encode((F.col("l_tax") + 1.0) * 1e-250)["encoding"].alias("tiny"),
    )
    return coded.select("l_orderkey", "l_linenumber", "by_precision", F.col("r.exponent").alias("exponent"), F.col("r.encoding").alias("raised"), "tiny")


@query(
    "wide_sum",
    f"select l_returnflag, ((e % {WIDE} + {WIDE}) % {WIDE} >> 60)::bigint as hi, ((e % {WIDE} + {WIDE}) % {WIDE} & 1152921504606846975::hugeint)::bigint as lo,"
    " e::double / pow(16.0::double, 14) as total from (select l_returnflag,"
    " sum(round_even(-l_extendedprice * pow(16.0::double, 10), 0)::hugeint * 65536 + round_even(l_tax * pow(16.0::double, 14), 0)::hugeint)::hugeint as e from lineitem group by 1)",
)
def wide_sum(spark, root):
    """Two columns under different exponents, aligned, added and summed in the ring of 2^120."""
    lines = views.table(spark, root, "lineitem")
    coded = lines.select("l_returnflag", wide.wide_encode(-F.col("l_extendedprice"), 10).alias("a"), wide.wide_encode(F.col("l_tax"), 14).alias("b"))
    added = coded.select("l_returnflag", wide.wide_add(wide.wide_align(F.col("a"), F.lit(10), 14), F.col("b")).alias("e"))
    summed = wide.wide_sum(added, "e", ["l_returnflag"])
    return summed.select("l_returnflag", F.col("e.hi").alias("hi"), F.col("e.lo").alias("lo"), wide.wide_decode(F.col("e"), 14).alias("total"))


EMBS = [EMB, EMB_ROWS, EMB_DIM, DENSE_EMB]


def masked_sql(out: str, cells: str, party: str = "") -> list[str]:
    """CTE ``out``(row_id, f, a, b) of ring shares."""
    return [
        *hashed(f"{out}_h", f"select row_id, f, v, {key_sql(1, 'mask', party)} as k, row_id as a, f as b from {cells}"),
        f"{out}_m as (select row_id, f, (bits >> 4)::bigint as mask, {ring_sql('v', '4')} as encoding from {out}_h)",
        f"{out} as (select row_id, f, mask as a, ((encoding - mask + {RING}) % {RING})::bigint as b from {out}_m)",
    ]


def dense_vectors(spark, root):
    x, rows = vectors(spark, root)
    return reshape.to_dense(x, rows, views.emb_width(spark, root))


@query(
    "share_split",
    select("select row_id, f, a as share, 'a' as party from s union all select row_id, f, b, 'b' from s", EMBS, masked_sql("s", "d")),
)
def share_split(spark, root):
    a, b = shares.share_split(dense_vectors(spark, root))
    return a.withColumn("party", F.lit("a")).unionByName(b.withColumn("party", F.lit("b")))


@query(
    "share_reconstruct",
    select("select row_id, f, round_even(v * 65536, 0) / 65536 + 0.0::double as v from d", EMBS),
)
def share_reconstruct(spark, root):
    a, b = shares.share_split(dense_vectors(spark, root))
    return shares.reconstruct(a, b).withColumn("v", F.col("v") + 0.0)


@query(
    "share_reconstruct_wide",
    select("select row_id, f, round_even(v * pow(16.0::double, 20), 0) / pow(16.0::double, 20) + 0.0::double as v from d", EMBS),
)
def share_reconstruct_wide(spark, root):
    """Twenty digits behind the point, which the small ring has no room for."""
    a, b = wide.wide_split(dense_vectors(spark, root), 20)
    return wide.wide_reconstruct(a, b, 20).withColumn("v", F.col("v") + 0.0)


@query(
    "share_dataset",
    select(
        "select 'a' as party, row_id, f, a as share from sa union all select 'b', row_id, f, b from sa"
        " union all select 'a', row_id, f + cut, a from sb, c union all select 'b', row_id, f + cut, b from sb, c"
        " union all select 'a', row_id, -1, a from sy union all select 'b', row_id, -1, b from sy",
        EMBS,
        "c as (select n // 4 as cut from dim)",
        "da as (select d.* from d, c where f < cut)",
        "db as (select row_id, f - cut as f, v from d, c where f >= cut)",
        "dy as (select vec_id as row_id, 0 as f, label::double as v from embeddings)",
        masked_sql("sa", "da", "A"),
        masked_sql("sb", "db", "B"),
        masked_sql("sy", "dy", "Y"),
    ),
)
def share_dataset(spark, root):
    """What each of two parties holds; column -1 is the label."""
    n1 = views.emb_width(spark, root) // 4
    xa, xb = reshape.vertical_split_at(dense_vectors(spark, root), n1)
    held = shares.share_dataset(xa, xb, views.emb_labels(spark, root), n1)
    tables = []
    for name, party in zip("ab", held):
        labels = party.y.select("row_id", F.lit(-1).cast("bigint").alias("f"), "share")
        tables.append(party.x.select("row_id", "f", "share").unionByName(labels).withColumn("party", F.lit(name)))
    return tables[0].unionByName(tables[1])


@query(
    "beaver_triples",
    select(
        f"select row_id, {r6('sum(hu.m * hv.m)')} as z from hu join hv using (f) group by row_id",
        EMBS,
        hashed("ur", f"select row_id, f, {key_sql(1, 'U')} as k, row_id as a, f as b from d"),
        hashed("vr", f"select f, {key_sql(1, 'V')} as k, f as a, 0 as b from (select unnest(range(n)) as f from dim)"),
        "hu as (select row_id, f, floor((u * 2 - 1) * 524288.0::double) / 65536.0::double as m from ur)",
        "hv as (select f, floor((u * 2 - 1) * 524288.0::double) / 65536.0::double as m from vr)",
    ),
)
def beaver_triples(spark, root):
    """The product of a random table with a random vector, recombined from its shares."""
    cells = dense_vectors(spark, root)
    triples = shares.beaver_triples(cells, cells.select("f").distinct())
    return triples.z.select("row_id", rounded(F.col("a") + F.col("b")).alias("z"))


VECTOR = "w as (select f, (f % 7 - 3) / 8.0::double as w from (select unnest(range(n)) as f from dim))"


def shared_table(spark, root):
    cells = dense_vectors(spark, root)
    features = cells.select("f").distinct()
    return shares.real_split(cells, "v", ["row_id", "f"], 1, "X0"), features, shares.beaver_triples(cells, features)


@query("beaver_matvec", select(f"select row_id, {r6('sum(v * w)')} as z from d join w using (f) group by 1", EMBS, VECTOR))
def beaver_matvec(spark, root):
    """X w from shares of both, against the plain product."""
    x, features, triples = shared_table(spark, root)
    w = features.withColumn("w", (F.pmod("f", F.lit(7)) - 3) / F.lit(8.0))
    product = shares.beaver_matvec(x, shares.real_split(w, "w", ["f"], 1, "W0"), triples, views.emb_width(spark, root))
    return product.select("row_id", rounded(F.col("a") + F.col("b")).alias("z"))


@query(
    "beaver_matvec_t",
    select(f"select f, {r6('sum(v * (label - 4.5::double))')} as g from d join embeddings on vec_id = row_id group by 1", EMBS),
)
def beaver_matvec_t(spark, root):
    """X' d from shares of both, against the plain product."""
    x, _, triples = shared_table(spark, root)
    y = views.emb_labels(spark, root)
    rows = y.select("row_id")
    d = shares.real_split(y.withColumn("d", F.col("label") - 4.5), "d", ["row_id"], 1, "D0")
    product = shares.beaver_matvec_t(x, d, shares.transposed_triples(triples, rows))
    return product.select("f", rounded(F.col("a") + F.col("b")).alias("g"))


# A key pair for tests, the two largest primes below 2^128; never use it for data.
TEST_KEY = paillier.PrivateKey(
    p=340282366920938463463374607431768211297,
    q=340282366920938463463374607431768211283,
)


def encrypted_lines(spark, root):
    lines = views.table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_tax"
    )
    spread = lines.repartition(spark.sparkContext.defaultParallelism * 2, "l_orderkey")
    return paillier.encrypt_column(spread, "l_quantity", ["l_orderkey", "l_linenumber"], TEST_KEY.public, b"test secret")


@query("paillier_sum", f"select l_returnflag, l_linestatus, {r6('sum(l_quantity)')} as v from lineitem group by 1, 2")
def paillier_sum(spark, root):
    summed = paillier.paillier_sum(encrypted_lines(spark, root), ["l_returnflag", "l_linestatus"], TEST_KEY.public)
    return paillier.decrypt_column(summed, TEST_KEY).withColumn("v", rounded("v"))


@query(
    "paillier_weighted_sum",
    f"select l_returnflag, {r6('sum(l_quantity * (round_even(l_tax * 65536, 0) / 65536))')} as v from lineitem group by 1",
)
def paillier_weighted_sum(spark, root):
    lines = encrypted_lines(spark, root)
    summed = paillier.paillier_weighted_sum(lines, "l_tax", ["l_returnflag"], TEST_KEY.public, exponent=4)
    return paillier.decrypt_column(summed, TEST_KEY).withColumn("v", rounded("v"))


def encrypted_vector(spark, ids, name, secret):
    """One of seven encrypted numbers per id, from -3/8 to 3/8."""
    values = ids.select(name, ((F.pmod(name, F.lit(7)) - 3) / F.lit(8.0)).alias("w"))
    return paillier.encrypt_column(values.repartition(spark.sparkContext.defaultParallelism, name), "w", [name], TEST_KEY.public, secret)


@query(
    "paillier_matvec",
    select(f"select row_id, {r6('sum(v * ((f % 7 - 3) / 8.0::double))')} as z from x group by 1", CUST_PART),
)
def paillier_matvec(spark, root):
    """What customers bought times encrypted weights of the parts."""
    x = views.cust_part(spark, root)
    w = encrypted_vector(spark, views.table(spark, root, "part").select(F.col("p_partkey").cast("bigint").alias("f")), "f", b"test weights")
    product = encrypted.encrypted_matvec(x, w, TEST_KEY.public, bound=1.0)
    return paillier.decrypt_column(product, TEST_KEY, "z").withColumn("z", rounded("z"))


@query(
    "paillier_matvec_t",
    select(f"select f, {r6('sum(v * ((row_id % 7 - 3) / 8.0::double))')} as g from x group by 1", CUST_PART),
)
def paillier_matvec_t(spark, root):
    """The transposed table times encrypted residuals of the customers."""
    x = views.cust_part(spark, root)
    d = encrypted_vector(spark, views.table(spark, root, "customer").select(F.col("c_custkey").cast("bigint").alias("row_id")), "row_id", b"test rest")
    product = encrypted.encrypted_matvec_t(x, d, TEST_KEY.public, bound=1.0)
    return paillier.decrypt_column(product, TEST_KEY, "g").withColumn("g", rounded("g"))


@query("paillier_add", f"select o_orderkey, {r6('o_totalprice + o_custkey')} as v from orders")
def paillier_add(spark, root):
    """Two columns encrypted under different exponents, added row by row."""
    orders = views.table(spark, root, "orders").repartition(spark.sparkContext.defaultParallelism * 2, "o_orderkey")
    a = paillier.encrypt_column(orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], TEST_KEY.public, b"test a", exponent=8)
    b = paillier.encrypt_column(orders.select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"], TEST_KEY.public, b"test b", exponent=0)
    return paillier.decrypt_column(encrypted.encrypted_add(a, b, ["o_orderkey"], TEST_KEY.public), TEST_KEY).withColumn("v", rounded("v"))
