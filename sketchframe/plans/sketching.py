"""Whole sketching plans: one table, or two parties that own different columns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchframe.operators import expand as ex
from sketchframe.operators import sketch as sk
from sketchframe.operators.joins import hstack
from sketchframe.operators.reshape import split_width, vertical_split_at
from sketchframe.operators.stats import resolve_gamma
from sketchframe.session import write_out
from sketchframe.sources.samples import read_samples, write_samples, write_sketch


@dataclass(frozen=True)
class SketchConfig:
    """Method SM (p-minhash), MM (0-bit CWS), RBF or Poly, and its parameters.

    ``n`` is the width of the table that is sketched: already doubled if signs
    were separated, with ``normalization`` set so that gamma knows.
    """

    method: str
    n: int
    k: int = 64
    b: int = 0
    c: int = 0
    seed: int = 1
    gamma: float = 0.0
    gamma_mode: str = "scale"
    coef0: float = 1.0
    degree: int = 2
    normalization: bool = False
    portion: float = 0.0
    settle_ties: bool = True

    @property
    def sampled(self) -> bool:
        if self.method not in ("SM", "MM", "RBF", "Poly"):
            raise ValueError(f"unknown method {self.method!r}")
        return self.method in ("SM", "MM")

    @property
    def n1(self) -> int:
        return split_width(self.n, self.portion)

    @property
    def k1(self) -> int:
        return split_width(self.k, self.portion)


class Split(NamedTuple):
    """One split: cells X(row_id, f, v) and its rows."""

    x: DataFrame
    rows: DataFrame


def with_gamma(cfg: SketchConfig, train: Split) -> SketchConfig:
    """Fix gamma before the kernel sketch is planned; one aggregate over train."""
    if cfg.sampled or cfg.gamma != 0:
        return cfg
    width = cfg.n // 2 if cfg.normalization else cfg.n
    m = train.rows.count()
    value = resolve_gamma(train.x, m, width, 0.0, cfg.gamma_mode, cfg.normalization).first()["gamma"]
    if value is None:
        raise ValueError("gamma 'scale' needs a table of non-zero variance")
    return replace(cfg, gamma=value)


def samples(split: Split, cfg: SketchConfig, k: int, n: int, party: str = "") -> DataFrame:
    """S(row_id, j, s) from 1, or D(row_id, j, v), of one party's columns."""
    x, rows = split
    if cfg.method == "SM":
        return sk.one_based(sk.p_minhash(x, rows, k, cfg.seed, party, settle_ties=cfg.settle_ties))
    if cfg.method == "MM":
        return sk.one_based(sk.cws_0bit(x, rows, k, cfg.seed, party, settle_ties=cfg.settle_ties))
    if cfg.method == "RBF":
        return sk.rff(x, rows, k, cfg.gamma, cfg.seed, party)
    if cfg.method == "Poly":
        return sk.tensor_sketch(x, rows, k, cfg.gamma, n, cfg.coef0, cfg.degree, cfg.seed, party)
    raise ValueError(f"unknown method {cfg.method!r}")


def as_features(sampled: DataFrame) -> DataFrame:
    """A dense kernel sketch as a sparse feature table."""
    return sampled.select("row_id", F.col("j").alias("col"), "v").where(F.col("v") != 0)


def sketch_central(train: Split, test: Split, cfg: SketchConfig) -> tuple[DataFrame, DataFrame]:
    """Feature tables Z(row_id, col, v) of both splits, one plan each."""
    cfg = with_gamma(cfg, train)

    def one(split: Split) -> DataFrame:
        sampled = samples(split, cfg, cfg.k, cfg.n)
        return ex.expand(sampled, cfg.n, cfg.b, cfg.c) if cfg.sampled else as_features(sampled)

    return one(train), one(test)


def sampled_parties(split: Split, cfg: SketchConfig) -> DataFrame:
    """S(row_id, second, j, s) from 1 of both parties, over one scan and one exchange of the split's cells."""
    run = {"SM": sk.p_minhash_of_parties, "MM": sk.cws_0bit_of_parties}[cfg.method]
    return sk.one_based(run(split.x, split.rows, cfg.n1, cfg.k1, cfg.k - cfg.k1, cfg.seed, cfg.settle_ties))


def party_samples(split: Split, cfg: SketchConfig) -> tuple[DataFrame, DataFrame]:
    """The two parties' samples; each party sees its own columns only."""
    if cfg.sampled:
        both = sampled_parties(split, cfg)
        return both.where("not second").drop("second"), both.where("second").drop("second")
    a, b = vertical_split_at(split.x, cfg.n1)
    first = samples(Split(a, split.rows), cfg, cfg.k1, cfg.n1, "A")
    second = samples(Split(b, split.rows), cfg, cfg.k - cfg.k1, cfg.n - cfg.n1, "B")
    return first, second


def sketch_vertical(train: Split, test: Split, cfg: SketchConfig) -> tuple[DataFrame, DataFrame]:
    """As ``sketch_central`` with columns and samples divided by ``portion``.

    Sampled sketches take both parties in one pass over a split; the kernel methods take a pass each.
    """
    cfg = with_gamma(cfg, train)
    if not 0 < cfg.k1 < cfg.k:
        raise ValueError("portion leaves one party without samples")

    def one(split: Split) -> DataFrame:
        if cfg.sampled:
            return ex.expand_parties(sampled_parties(split, cfg), cfg.n1, cfg.n - cfg.n1, cfg.k1, cfg.b, cfg.c)
        a, b = party_samples(split, cfg)
        return hstack(as_features(a), as_features(b), cfg.k1, "col")

    return one(train), one(test)


def sketch_width(cfg: SketchConfig) -> int:
    """Number of columns of the sketch."""
    if not cfg.sampled:
        return cfg.k
    if not cfg.portion:
        return cfg.k * ex.sample_width(cfg.n, cfg.b, cfg.c)
    first = ex.party_width(cfg.n1, cfg.b, cfg.c) * cfg.k1
    return first + ex.party_width(cfg.n - cfg.n1, cfg.b, cfg.c) * (cfg.k - cfg.k1)


def squeeze_samples(
    spark: SparkSession,
    path_a: str,
    path_b: str,
    cfg: SketchConfig,
    out: str | None = None,
    align: str = "portion",
) -> tuple[DataFrame, DataFrame]:
    """Stored samples of two parties to two compressed sketches, optionally stored."""
    a, b = read_samples(spark, path_a), read_samples(spark, path_b)
    whole = ex.expand_two_party_blocks(a, b, cfg.n1, cfg.n - cfg.n1, cfg.k1, cfg.b, cfg.c)
    boundary = ex.party_width(cfg.n1, cfg.b, cfg.c) * cfg.k1
    left, right = ex.resplit_sketch(whole, sketch_width(cfg), cfg.portion, align, boundary)
    if out is not None:
        write_sketch(left, f"{out}/party_a")
        write_sketch(right, f"{out}/party_b")
    return left, right


def squeeze_grid(
    spark: SparkSession, path_a: str, path_b: str, cfgs: dict[str, SketchConfig], out: str | None = None, align: str = "portion"
) -> DataFrame:
    """(layout, party, row_id, col, v): stored samples of two parties compressed in many ways at once.

    Every layout has a name and a configuration, which may differ in k, b and c.  With a smaller k each party's first draws are
    taken, which are the samples that k draws would have given.  The samples are read once, and a sample meets all layouts in one
    projection.  With ``out`` the result is stored by layout and party and read back from there.
    """
    if not cfgs:
        raise ValueError("a grid needs a layout")
    if align not in ("portion", "party"):
        raise ValueError("align must be 'portion' or 'party'")
    cells = []
    for name, cfg in cfgs.items():
        n2, k2 = cfg.n - cfg.n1, cfg.k - cfg.k1
        if not cfg.sampled or k2 < 1 or cfg.k1 < 1:
            raise ValueError(f"layout {name} has no samples of two parties")
        boundary = ex.party_width(cfg.n1, cfg.b, cfg.c) * cfg.k1
        cut = boundary if align == "party" else split_width(sketch_width(cfg), cfg.portion)
        col = f"if(j < if(second, {k2}L, {cfg.k1}L), {ex.party_column(cfg.n1, n2, cfg.k1, cfg.b, cfg.c)}, null)"
        cells.append(F.struct(F.lit(name).alias("layout"), F.lit(cut).cast("bigint").alias("cut"), F.expr(col).cast("bigint").alias("col")))
    both = read_samples(spark, path_a).withColumn("second", F.lit(False)).unionByName(read_samples(spark, path_b).withColumn("second", F.lit(True)))
    unfolded = both.where("s > 0").select("row_id", F.explode(F.array(*cells)).alias("e")).where("e.col is not null")
    party, col = F.expr("if(e.col < e.cut, 'a', 'b')"), F.expr("if(e.col < e.cut, e.col, e.col - e.cut)")
    grid = unfolded.select("e.layout", party.alias("party"), "row_id", col.alias("col"))
    if out is not None:
        grid.write.mode("errorifexists").partitionBy("layout", "party").parquet(out)
        grid = spark.read.schema("row_id bigint, col bigint, layout string, party string").parquet(out)
    return grid.select("layout", "party", "row_id", "col", F.lit(1).alias("v"))


def store_party_samples(split: Split, cfg: SketchConfig, path_a: str, path_b: str) -> None:
    a, b = party_samples(split, cfg)
    if cfg.sampled:  # sampled once, then told apart
        both = write_out(sampled_parties(split, cfg), "samples", ["second"])
        a, b = both.where("not second").drop("second"), both.where("second").drop("second")
    write_samples(a, path_a)
    write_samples(b, path_b)
