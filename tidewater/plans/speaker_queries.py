"""Queries over embeddings: similarity trials, centroids, clustering, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.times import seconds
from tidewater.operators import clusters as C
from tidewater.plans.base import Tables, query


@query(
    """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS target, list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)) AS d, a.embedding AS x, b.embedding AS y
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 37)
    SELECT a, b, target, round(list_sum(d) / sqrt(list_sum(list_transform(x, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))) * list_sum(list_transform(y, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))), 6) AS cosine FROM p"""
)
def mth_cosine_trials(t: Tables) -> DataFrame:
    """Cosine similarity of the pairs that a trial list names."""
    e = t.embeddings
    a = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 37).alias("b"), F.col("label").alias("la"), F.col("embedding").alias("x"))
    b = e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), F.col("embedding").alias("y"))
    return a.join(b, "b").select("a", "b", (F.col("la") == F.col("lb")).alias("target"), F.round(C.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(
    """WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS c FROM x GROUP BY label, d)
    SELECT x.label, count(DISTINCT vec_id) AS n, round(sqrt(avg((CAST(x AS DOUBLE) - c) * (CAST(x AS DOUBLE) - c))), 6) AS spread FROM x JOIN c USING (label, d) GROUP BY x.label"""
)
def agg_cluster_spread(t: Tables) -> DataFrame:
    """Root mean square distance to the centroid, by label."""
    x = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    c = x.groupBy("label", "d").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x")).alias("q"))
    # the mean of squares about the mean needs the sums only, so no join back
    part = F.greatest(F.col("q") - F.col("n") * F.col("c") * F.col("c"), F.lit(0.0))
    return c.groupBy("label").agg(F.max("n").alias("n"), F.round(F.sqrt(F.sum(part) / F.sum("n")), 6).alias("spread"))


@query()
def seg_spectral_clusters(t: Tables) -> DataFrame:
    """Speakers of each session of 125 chunks."""
    e = t.embeddings.select(F.floor(F.col("vec_id") / 125).alias("session"), "vec_id", "embedding")
    return C.cluster_sessions(e, "session", "vec_id", "embedding")


@query()
def seg_smooth_speakers(t: Tables) -> DataFrame:
    """Speaker turns smoothed within a session."""
    begin = seconds("ts") - F.min(seconds("ts")).over(W.partitionBy("user_id"))
    turns = t.events.select("user_id", (begin / 3600).alias("begin"), (begin / 3600 + F.col("value") / 20).alias("end"), (F.col("value").cast("int") % 3).cast("double").alias("speaker"))
    return C.smooth_speakers(turns, "user_id", shortest=2.0)


@query("SELECT label, count(*) AS n, CASE WHEN count(*) < 50 THEN 'few' ELSE 'many' END AS size_class FROM embeddings GROUP BY label")
def flt_instance_screening(t: Tables) -> DataFrame:
    n = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("size_class", F.when(F.col("n") < 50, "few").otherwise("many"))
