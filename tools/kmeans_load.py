"""Load test: generate uniform vectors, fit k-means, print the elapsed times.

    python tools/kmeans_load.py [rows] [dims] [k] [iterations]
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from hinloom.operators import clustering  # noqa: E402
from hinloom.runtime import materialize  # noqa: E402
from hinloom.session import local_session  # noqa: E402
from hinloom.sources import generators  # noqa: E402


def main() -> None:
    sizes = [int(a) for a in sys.argv[1:]]
    rows, dims, k, iterations = sizes + [100_000, 10_000, 100, 1][len(sizes) :]
    spark = local_session("*", "kmeans-load")
    started = time.perf_counter()
    data = materialize(generators.load_test_vectors(spark, rows, dims, partitions=32), "load")
    prepared = time.perf_counter()
    model = clustering.k_means(data, "features", k, iterations)
    fitted = time.perf_counter()
    cost = clustering.within_cost(data, "features", clustering.centres_of(model)).first()["cost"]
    print(
        json.dumps(
            {
                "rows": rows, "dims": dims, "k": k, "iterations": iterations, "cost": cost,
                "prepare_sec": round(prepared - started, 2), "fit_sec": round(fitted - prepared, 2),
                "cost_sec": round(time.perf_counter() - fitted, 2),
            }
        )
    )


if __name__ == "__main__":
    main()
