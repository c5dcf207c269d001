"""One registered query per corpus operator, with production parameters, and checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sketchframe.llm import bpe, codes, decontaminate, exact, license_scan, line_dedup, near, quality, secret_scan, simhash, toxicity, warc, whitening
from sketchframe.llm.common import Query, learnable, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_toxicity")
def op3(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    held, learn = learnable(5, 0)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, root, "labels"), learn), held)


@query(
    "op4_exact_dedup",
    """
    with g as (
        select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size
        from documents group by 1
    )
    select doc_id, keep_id, group_size,
        coalesce(doc_id = keep_id, false) and row_number() over (partition by t, doc_id order by doc_id) = 1 as kept,
        sha256(t) as text_sha256
    from documents join g on coalesce(text, '') = t
    """,
)
def op4(spark: SparkSession, root: str) -> DataFrame:
    found = exact.classes(table(spark, root, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_byte_bpe")
def op6(spark: SparkSession, root: str) -> DataFrame:
    return bpe.digests(table(spark, root, "documents"), *bpe.public_vocabulary())


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, root: str) -> DataFrame:
    return near.near_classes(table(spark, root, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.leaks(table(spark, root, "documents"), table(spark, root, "benchmark")).drop("key")


@query("op7_quality_classifier")
def op7(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    held, learn = learnable(4, 2)
    return quality.score(docs, quality.fit(docs, table(spark, root, "labels"), learn), held)


@query("op2_secret_scan")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return secret_scan.scan(table(spark, root, "documents")).drop("findings")


@query("op9_license_scan")
def op9(spark: SparkSession, root: str) -> DataFrame:
    return license_scan.scan(table(spark, root, "documents")).drop("hits")


@query("op10_line_dedup")
def op10(spark: SparkSession, root: str) -> DataFrame:
    return line_dedup.scan(table(spark, root, "documents"))


@query(
    "op1_warc",
    """
    with p as (
        select page_id, url, encode(coalesce(html, '')) as payload from pages
    ), g as (
        select payload, min(page_id) as first, count(*) as n from p where octet_length(payload) >= 100 group by 1
    )
    select page_id, octet_length(p.payload) as payload_bytes, sha256(p.payload) as payload_digest,
        case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
        case when page_id is distinct from first then first end as refers_to, coalesce(url, 'about:blank') as url
    from p left join g on p.payload = g.payload
    """,
)
def op1(spark: SparkSession, root: str) -> DataFrame:
    return warc.round_trip(table(spark, root, "pages"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten(table(spark, root, "embeddings"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8) -> str:
    """All rounds as one statement, for vectors of ``parts * width`` entries."""
    apart = " + ".join(f"(v[{i}] - c[{i}]) * (v[{i}] - c[{i}])" for i in range(1, width + 1))
    steps = [
        f"""kept as (
            select vec_id, label, row_number() over (order by vec_id) as place, list_transform(embedding, lambda c: floor(4096 * c::double)::bigint) as x
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
        ), cut as (
            select place, p, x[p * {width} + 1 : p * {width} + {width}] as v from kept, (select unnest(range({parts})) as p)
        ), book0 as (select p, place - 1 as e, v as c from cut where place <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"near{r} as (select place, p, any_value(v) as v, min(({apart}) * {entries} + e) as best from cut join book{r} using (p) group by place, p)")
        if r < rounds:
            steps.append(
                f"""spread{r} as (select p, best % {entries} as e, generate_subscripts(v, 1) as i, unnest(v) as one from near{r}),
                sums{r} as (select p, e, i, sum(one)::bigint as s, count(*) as n from spread{r} group by p, e, i),
                mean{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as c from sums{r} group by p, e),
                book{r + 1} as (select p, e, coalesce(m.c, b.c) as c from book{r} b left join mean{r} m using (p, e))"""
            )
    text = f"string_agg(array_to_string(c, ','), ',' order by p, e) from book{rounds}"
    return f"""
    with {", ".join(steps)}, coded as (
        select place, string_agg(printf('%02x', best % {entries}), '' order by p) as code, sum(best // {entries})::bigint as error
        from near{rounds} group by place
    )
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256({text.replace(" from ", ") from ", 1)}) as codebooks_sha256
    from kept join coded using (place)
    """


@query("op12_vector_codes", _codes_sql())
def op12(spark: SparkSession, root: str) -> DataFrame:
    return codes.compress(table(spark, root, "embeddings")).drop("label")


@query("op13_simhash_near_dedup")
def op13(spark: SparkSession, root: str) -> DataFrame:
    return simhash.classes(table(spark, root, "documents")).drop("component_size")
