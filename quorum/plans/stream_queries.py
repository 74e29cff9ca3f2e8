"""Query: weighted counts maintained by a streaming job over wave files."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quorum.plans.distribution_queries import _MEMB
from quorum.plans.oracle_views import with_views
from quorum.plans.registry import query
from quorum.sources import io as IO
from quorum.sources import views as V
from quorum.streaming.waves import run_to_end


@query("stream_counts", with_views("responses", "group_codes", ctes=_MEMB.rstrip().rstrip(",")) + """
SELECT qkey, attribute, grp, code, round(sum(weight), 2) AS w, count(*) AS n FROM memb
WHERE code IS NOT NULL AND NOT isnan(code) AND weight IS NOT NULL AND NOT isnan(weight) AND weight > 0
  AND weight < CAST('inf' AS DOUBLE)
GROUP BY qkey, attribute, grp, code""")
def q_stream_counts(spark, sf_dir):
    root = IO.scratch(spark, "stream")
    src = os.path.join(root, "incoming")
    resp = V.responses(spark, sf_dir)
    # files arrive per wave; a wave is several files, so that a large one is not one task's
    part = F.pmod(F.xxhash64("human_id"), F.lit(4))
    resp.repartition("wave", part).write.mode("overwrite").partitionBy("wave").parquet(src)
    schema = spark.read.parquet(src).schema
    counts = run_to_end(spark, src, schema, V.ATTRIBUTE_COLUMNS, V.group_codes(spark), root, files_per_trigger=8)
    return counts.select("qkey", "attribute", "grp", "code", F.round("w", 2).alias("w"), "n")
