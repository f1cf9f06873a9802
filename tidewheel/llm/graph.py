"""Connected components of an edge table, in rounds of minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """v, label (the component's smallest vertex) for the vertices of edges (a, b).

    Every round is a few joins on vertex keys, written to the shared folder; a vertex takes the smallest label
    among its neighbours and itself, then the label of its label, so long chains shrink by halves.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = saved(step.join(up, "label", "left").select("v", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        moved = new.where("label != old").head(1)
        discard(labels)
        labels = new.select("v", "label")
        labels._scratch_path = new._scratch_path  # noqa: SLF001
        if not moved:
            discard(both)
            return labels
