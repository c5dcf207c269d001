"""Files of samples and sketches, and the partitioned run layout."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchframe.sources.svmlight import numbered_lines


def write_samples(samples: DataFrame, path: str, value: str = "s") -> None:
    """CSV without a header: row id, then the k values in order of j.

    A group is one row's k values, so its size is fixed by k.
    """
    ordered = F.array_sort(F.collect_list(F.struct("j", value)))
    packed = samples.groupBy("row_id").agg(ordered.alias("p"))
    numbers = F.transform("p", lambda e: e[value].cast("string"))
    text = packed.select(F.concat_ws(",", F.col("row_id").cast("string"), numbers).alias("value"))
    text.write.mode("errorifexists").text(path)


def read_samples(spark: SparkSession, path: str, has_row_id: bool = True, value_type: str = "bigint", value: str = "s") -> DataFrame:
    """Inverse of ``write_samples``; files without row ids are numbered by line."""
    if has_row_id:
        parts = spark.read.text(path).select(F.split("value", ",").alias("p"))
        parts = parts.select(F.col("p")[0].cast("bigint").alias("row_id"), F.slice("p", F.lit(2), F.size("p")).alias("p"))
    else:
        parts = numbered_lines(spark, path).select("row_id", F.split("value", ",").alias("p"))
    long = parts.select("row_id", F.posexplode("p").alias("j", value))
    return long.select("row_id", F.col("j").cast("bigint").alias("j"), F.trim(value).cast(value_type).alias(value))


def write_sketch(sketch: DataFrame, path: str) -> None:
    sketch.select("row_id", "col").write.mode("errorifexists").parquet(path)


def read_sketch(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema("row_id bigint, col bigint").parquet(path)
    return stored.select("row_id", "col", F.lit(1).alias("v"))


def export_dense_csv(sketch: DataFrame, rows: DataFrame, width: int, path: str) -> None:
    """One line of 0/1 per row in the order of the ids, for tools that read dense text: the ones in order, with runs of zeros between.

    The files are ranges of ids, so that a line's number is the rank of its row; ``read_dense_csv`` reads them.
    """
    columns = sketch.groupBy("row_id").agg(F.sort_array(F.collect_set(F.col("col").cast("int"))).alias("ones"))
    none = F.array().cast("array<int>")
    ordered = rows.join(columns, "row_id", "left").orderBy("row_id").select(F.coalesce("ones", none).alias("ones"))
    stops = F.concat("ones", F.array(F.lit(width)))
    befores = F.concat(F.array(F.lit(-1)), "ones")
    runs = F.zip_with(befores, stops, lambda a, b: F.repeat(F.lit("0,"), b - a - 1))
    line = F.array_join(runs, "1,")
    ordered.select(F.rtrim(line, F.lit(",")).alias("value")).write.mode("errorifexists").text(path)


LAYOUT = ["dataset", "ratio", "method", "k", "seed", "gamma"]


def run_path(root: str, dataset: str, portion: float, method: str, k: int, seed: int, gamma: float | None = None) -> str:
    """The folder one run lands in; portion and gamma keep all their digits, so no two runs share one."""
    tail = "none" if gamma is None else repr(float(gamma))
    return f"{root}/dataset={dataset}/ratio={float(portion)!r}/method={method}/k={k}/seed={seed}/gamma={tail}"


def _tag(column: str, value: object) -> str:
    """A layout value as the folder names and the list of commits spell it."""
    if column == "gamma" and value is None:
        return "none"
    return repr(float(value)) if column in ("ratio", "gamma") and value != "none" else str(value)


def _commits(spark: SparkSession, root: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in [*LAYOUT, "version"]) + ", number bigint"
    try:
        return spark.read.schema(schema).parquet(f"{root}/_commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed_runs(spark: SparkSession, root: str, **want: object) -> DataFrame:
    """(layout columns as text, version, number): the last commit of every run that fits the conditions."""
    unknown = set(want) - set(LAYOUT)
    if unknown:
        raise ValueError(f"not part of the layout: {sorted(unknown)}")
    log = _commits(spark, root)
    for column, value in want.items():
        log = log.where(F.col(column) == _tag(column, value))
    last = log.groupBy(*LAYOUT).agg(F.max(F.struct("number", "version")).alias("last"))
    return last.select(*LAYOUT, "last.version", "last.number")


def write_run(
    df: DataFrame, root: str, dataset: str, portion: float, method: str, k: int, seed: int, gamma: float | None = None
) -> None:
    """Add one run to the partitioned layout, or put a new version in its place.

    The rows go to a folder of their own that no reader lists.  Then one row, the commit, is added to ``_commits`` in a file that
    appears by a rename; from there on readers take the new version, and those that already read the old one go on with it.  A
    writer that is lost before that leaves the run as it was.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    values = (dataset, portion, method, k, seed, gamma)
    tags = {c: _tag(c, v) for c, v in zip(LAYOUT, values, strict=True)}
    df.write.mode("errorifexists").parquet(f"{run_path(root, *values)}/version={version}")
    before = committed_runs(spark, root, **dict(zip(LAYOUT, values, strict=True))).first()
    row = [F.lit(t).alias(c) for c, t in tags.items()]
    number = F.lit(before["number"] + 1 if before else 1).cast("bigint").alias("number")
    spark.range(1).coalesce(1).select(*row, F.lit(version).alias("version"), number).write.mode("append").parquet(f"{root}/_commits")


def read_run(spark: SparkSession, root: str, **want: object) -> DataFrame:
    """The committed runs of the layout; conditions on its columns choose the folders that are listed at all.

    The driver holds a path per chosen run.  Where no run fits the result is empty, with the columns of some other run.
    """
    chosen = committed_runs(spark, root, **want).collect() or committed_runs(spark, root).limit(1).collect()
    if not chosen:
        raise ValueError(f"no committed run in {root}")
    folders = ["/".join([root, *(f"{c}={r[c]}" for c in LAYOUT), f"version={r['version']}"]) for r in chosen]
    runs = spark.read.option("basePath", root).parquet(*folders).drop("version")
    for column, value in want.items():
        runs = runs.where(F.col(column) == F.lit("none" if value is None else value))
    types = {"dataset": "string", "ratio": "double", "method": "string", "k": "int", "seed": "int", "gamma": "string"}
    return runs.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in runs.columns])
