"""Times the headline queries; prints one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: cores."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ["resolve_fields", "spatial_neighbours", "indel_ratio_pairs", "choose_winner", "candidate_scores", "segment_lines", "address_resolve", "page_lines", "identifier_rules", "rule_based_split"]


def main() -> None:
    from spanforge.plans.all_queries import QUERIES
    from spanforge.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()  # warm: code and files
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
