"""Plain tables times encrypted vectors, and sums of encrypted columns.

A product needs a power of every ciphertext.  The powers of one group are taken together: an exponent is read in
digits of base 16, a ciphertext is multiplied into the bucket of each of its digits, and only when the group ends are the
buckets raised, digit place by digit place.  The squarings are thus shared by all cells of the group, and a cell
costs one multiplication a non-zero digit.  What a task holds is the buckets of one group, however many cells it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchframe.operators.paillier import BASE, PowerProduct, PublicKey, paillier_sum
from sketchframe.session import write_out

# A vector is broadcast if its ciphertexts take no more than this.
BROADCAST_BYTES = 64 << 20
# Cells that a task sorts together with their ciphertexts.
CELLS_PER_TASK = 250_000


def encrypted_product(
    cells: DataFrame, vector: DataFrame, on: str, by: str, key: PublicKey, *, bound: float | None, exponent: int = 4
) -> DataFrame:
    """(by, c, exponent): per ``by`` the encrypted sum of v * vector[on] over ``cells(row_id, f, v)``.

    ``vector`` has (on, c, exponent).  ``on='f', by='row_id'`` is X w, ``on='row_id', by='f'`` is X' d.  ``v`` counts with
    ``exponent`` digits of base 16 behind the point.  ``bound`` is the largest size of an entry of the vector: a sum that might not
    fit the key raises an error; None leaves that to the caller.  Cells without an entry, and null or zero ones, add nothing.

    The vector is stored, so that nothing is encrypted twice, and broadcast if its ciphertexts are few: the cells are brought
    together by group before they meet them, in parts whose number grows with the cells, and a heavy group is cut in pieces.  Else both
    sides are exchanged and the cells brought together afterwards, where adaptive execution may cut a heavy group.  The pieces' products
    meet in ``paillier_sum``.
    """
    sizes = cells.groupBy(by).agg(F.sum(F.abs("v")).alias("size"), F.count("*").alias("n"))
    # rounding adds up to half a unit a cell
    largest, total, most = sizes.agg(F.max(F.col("size") * float(BASE**exponent) + F.col("n")), F.sum("n"), F.max("n")).first()
    if bound is not None:
        digits = vector.agg(F.max("exponent")).first()[0]
        if largest and digits is not None and int(largest * bound) * BASE**digits > key.n // 2:
            raise ValueError("the product might not fit the key")
    stored = write_out(vector.select(on, F.col("c").alias("_c"), F.col("exponent").alias("_e")), "vector")
    few = stored.count() * key.size <= BROADCAST_BYTES
    thin = cells.where("v <> 0").select(by, on, "v")
    if few:
        parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // CELLS_PER_TASK))
        piece = F.pmod(F.xxhash64(on), F.lit(-(-(most or 1) // CELLS_PER_TASK)))
        met = thin.repartition(parts, by, piece).join(F.broadcast(stored), on).select(by, "v", "_c", "_e")
    else:
        met = thin.join(stored, on).select(by, "v", "_c", "_e").hint("rebalance", by)
    fields = met.select(by, F.col("_c").alias("c"), F.col("_e").alias("exponent")).schema
    square, scale = key.square, BASE**exponent

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, product, done = None, None, []

        def packed() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=[by, "c", "exponent"], dtype=object)
            done.clear()
            return out

        def end() -> None:
            c, e = product.close()
            done.append((group, key.pack(c), e + exponent))

        for frame in frames:
            for now, v, c, e in zip(*(frame[name].tolist() for name in [by, "v", "_c", "_e"])):
                if product is None or now != group:
                    if product is not None:
                        end()
                    group, product = now, PowerProduct(square)
                product.add(int.from_bytes(c, "big"), round(v * scale), e)
            if done:
                yield packed()
        if product is not None:
            end()
            yield packed()

    return paillier_sum(met.sortWithinPartitions(by).mapInPandas(run, fields), [by], key)


def encrypted_matvec(x: DataFrame, w: DataFrame, key: PublicKey, *, bound: float | None, exponent: int = 4) -> DataFrame:
    """(row_id, c, exponent): X w of a plain X(row_id, f, v) and encrypted W(f, c, exponent)."""
    return encrypted_product(x, w, "f", "row_id", key, bound=bound, exponent=exponent)


def encrypted_matvec_t(x: DataFrame, d: DataFrame, key: PublicKey, *, bound: float | None, exponent: int = 4) -> DataFrame:
    """(f, c, exponent): X' d of a plain X(row_id, f, v) and encrypted D(row_id, c, exponent)."""
    return encrypted_product(x, d, "row_id", "f", key, bound=bound, exponent=exponent)


def encrypted_add(left: DataFrame, right: DataFrame, by: list[str], key: PublicKey) -> DataFrame:
    """(by..., c, exponent): the sum of two encrypted columns, row by row; a row that one side lacks counts as zero there.

    Rows of both sides are exchanged once, as most keys have one of each.
    """
    columns = [*by, "c", "exponent"]
    return paillier_sum(left.select(columns).unionByName(right.select(columns)), by, key, few=True)
