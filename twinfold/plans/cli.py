"""Command line: python -m twinfold.plans.cli --data offers.json --out results"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from ..sources import offers as S
from . import experiment


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--data", required=True, help="JSON file of clusters of offers")
    p.add_argument("--out", default="results")
    p.add_argument("--bootstraps", type=int, default=21)
    p.add_argument("--seed", type=int, default=123)
    p.add_argument("--min-pc", type=float, default=0.8)
    p.add_argument("--max-clusters", type=int)
    p.add_argument("--trials", type=int, default=30)
    p.add_argument("--no-propagate", action="store_true", help="don't spread brands over the true clusters")
    a = p.parse_args()
    start = time.time()
    spark = SparkSession.builder.appName("twinfold").getOrCreate()
    offers = S.from_json(spark, a.data)
    if a.max_clusters is not None:
        offers = S.first_clusters(offers, a.max_clusters)
    got = experiment.run(offers, a.bootstraps, a.seed, min_pc=a.min_pc, trials=a.trials, propagate=not a.no_propagate)
    for i, r in enumerate(got["results"]):
        print(f"bootstrap {a.seed + i}: bands {r['bands']['b']} x {r['bands']['r']}, {r['params']}, test {r['test']}")
    got["mean"].show(truncate=False)
    S.write_curve(got["curve"], f"{a.out}/curve")
    S.plot_curves([r.asDict() for r in got["curve"].collect()], a.out, ("f1_avg", "f1_star_avg", "pq_avg", "pc_avg", "f1", "pq", "pc", "f1_star"))
    print(f"{time.time() - start:.1f} seconds")


if __name__ == "__main__":
    main()
