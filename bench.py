"""Times the headline queries: one run of each over $BENCH_SF_DIR on local[$BENCH_CPUS], after a first graph that warms up; prints one JSON line."""

import json
import os
import sys
import tempfile
import time
import warnings

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
warnings.simplefilter("ignore")

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import geoweft as gw
    from geoweft.plans import catalog

    points = lambda n: gw.sample_points(n, bbox=(-5000, -5000, 5000, 5000), random_state=42, crs="EPSG:3857", spark=spark, fast=True)
    er = lambda f: gw.geo_erdos_renyi_network(f, random_state=1).edges
    ws = lambda f: gw.geo_watts_strogatz_network(f, 10, 0.1, random_state=1).edges
    ba = lambda f: gw.geo_barabasi_albert_network(f, 10, random_state=1).edges
    runs = {f"{name}_{n}": (lambda make=make, n=n: make(points(n))) for n in (100, 1000, 2000, 5000, 8000, 10000) for name, make in (("er", er), ("ws", ws), ("ba", ba))}
    runs["er_exact_customer"] = lambda: catalog._edges(catalog.er_customers(spark, SF_DIR, fast=True))
    runs["er_customer"] = lambda: er(catalog.customers(spark, SF_DIR))
    runs["er_thinned_customer"] = lambda: catalog.QUERIES["er_edges_thinned"](spark, SF_DIR)
    for name in ("knn_topk", "order_kde_compact", "sample_polygon_hole", "polygon_centroid_area"):
        runs[name] = lambda name=name: catalog.QUERIES[name](spark, SF_DIR)
    try:
        from geoweft.llm import queries as llm

        for name in llm.QUERIES:
            runs[name] = lambda name=name: llm.QUERIES[name](spark, SF_DIR)
        import corpus_pipeline

        runs["pipeline"] = lambda: corpus_pipeline.run(spark, SF_DIR)
    except ImportError:
        pass
    er(points(100)).count()
    took = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
