"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sketchframe.queries import QUERIES
from sketchframe.session import build_session

HEADLINE = [
    "src_weighted_set",
    "src_svmlight",
    "row_sample",
    "sign_separate",
    "batch_rows",
    "matrix_variance",
    "scale_standard",
    "scale_robust",
    "scale_maxabs",
    "p_minhash",
    "cws_0bit",
    "sketch_count",
    "sketch2_blocks_count",
    "rff",
    "tensor_sketch",
    "sketch_central_sm",
    "sketch_vertical_sm",
    "squeeze_samples",
    "score_epochs",
    "ovr_predict",
    "minibatch_lr",
    "lr_predict",
    "share_split",
    "beaver_matvec",
    "paillier_sum",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, shuffle_partitions=max(8, int(cores) if cores.isdigit() else 8), memory="16g")
    spark.read.parquet(f"{root}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
