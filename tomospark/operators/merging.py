"""Clusters of overlapping findings, their merging, and matching of predicted to true findings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import diameter_of_sigma, sigma_of_diameter, sphere_overlap, squared_distance
from ..functions.grouped import numbered, pairs_within, whole_groups


def overlaps(nodules: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Ordered pairs of findings of a scan: seriesuid, id_1, id_2, overlap over threshold, distance."""
    cols = ["seriesuid", "NoduleID", "coordX", "coordY", "coordZ", "diameter_mm"]
    a, b = nodules.select(*cols).alias("a"), nodules.select(*cols).alias("b")
    dist = F.sqrt(squared_distance("a", "b"))
    overlap = sphere_overlap(F.col("a.diameter_mm"), F.col("b.diameter_mm"), dist)
    pairs = a.join(b, (F.col("a.seriesuid") == F.col("b.seriesuid")) & (F.col("a.NoduleID") != F.col("b.NoduleID")))
    found = pairs.select(F.col("a.seriesuid").alias("seriesuid"), F.col("a.NoduleID").alias("id_1"), F.col("b.NoduleID").alias("id_2"), overlap.alias("overlap"), dist.alias("distance"))
    return found.where(F.col("overlap") > threshold)


def _linked(of, at, diameter, threshold: float, begin):
    """Pairs (i, j) of rows of one scan of which one overlaps the other by more than threshold."""
    import numpy as np

    found = []
    for i, j in pairs_within(of, begin):
        dist, r, q = np.sqrt(((at[i] - at[j]) ** 2).sum(axis=1)), diameter[i] / 2, diameter[j] / 2
        large, small = np.maximum(r, q), np.minimum(r, q)
        lens = math.pi * (large + small - dist) ** 2 * (dist * dist + 2 * dist * (large + small) - 3 * (large - small) ** 2) / (12 * dist + 1e-6)
        share = 2 * lens / (4 / 3 * math.pi * (large**3 + small**3) + 1e-6)
        # one ball within the other: the smaller one is wholly covered, however small
        met = np.where(dist >= large + small, 0.0, np.where(large >= dist + small, 1.0, share)) > threshold
        found.append((i[met], j[met]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2


def with_groups(nodules: DataFrame, threshold: float = 0.1) -> DataFrame:
    """nodules with GroupNoduleID, the least NoduleID that a chain of overlaps of either direction reaches in the scan.

    Findings are dealt by scan once; pairs are made and joined where they meet, in the square of a scan's findings. Rows
    of one NoduleID in a scan are one finding; rows without coordinates or diameter overlap nothing.
    """
    names = [*nodules.columns, "GroupNoduleID"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for table in whole_groups(batches, "seriesuid"):
            of, begin = numbered(table.column("seriesuid"))
            ids = table.column("NoduleID").combine_chunks().dictionary_encode()
            order = pc.sort_indices(ids.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            who = rank[ids.indices.to_numpy()]
            column = lambda c: table.column(c).fill_null(float("nan")).to_numpy()
            i, j = _linked(of, np.stack([column(f"coord{a}") for a in "XYZ"], axis=1), column("diameter_mm"), threshold, begin)
            # nodes are a scan's ids in order, so that the least number is the least id
            key, node = np.unique(of * len(order) + who, return_inverse=True)
            root = np.arange(len(key))
            a, b = node[i], node[j]
            while True:
                x, y = root[a], root[b]
                if (x == y).all():
                    break
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root != root[root]).any():
                    root = root[root]
            least = ids.dictionary.take(pa.array(order[key[root[node]] % len(order)]))
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns), least], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodules.schema.fields), f"GroupNoduleID {nodules.schema['NoduleID'].dataType.simpleString()}"])
    return nodules.repartition("seriesuid").sortWithinPartitions("seriesuid").mapInArrow(run, schema)


def groups(nodules: DataFrame, threshold: float = 0.1) -> DataFrame:
    """NoduleID and GroupNoduleID of each finding."""
    wide = [f"coord{a}" for a in "XYZ"] + ["diameter_mm"]
    return with_groups(nodules.select("seriesuid", "NoduleID", *[F.col(c).cast("double").alias(c) for c in wide]), threshold).select("NoduleID", "GroupNoduleID").distinct()


def merge_groups(nodules: DataFrame, proba: float = 0.8) -> DataFrame:
    """One finding per GroupNoduleID: the single Gaussian nearest to the weighted mixture of its members'.

    seriesuid, GroupNoduleID, coordX, coordY, coordZ, diameter_mm (of the z axis) and the largest NoduleConfidence.
    """
    w = F.col("NoduleConfidence")
    group = Window.partitionBy("GroupNoduleID")
    mean = {a: F.sum(w * F.col(f"coord{a}")).over(group) / F.sum(w).over(group) for a in "XYZ"}
    # the mean first, then deviations from it: no cancellation
    rows = nodules.withColumns({f"_m{a}": m for a, m in mean.items()}).withColumn("_s", sigma_of_diameter(F.col("diameter_mm"), proba))
    spread = F.sum(w * (F.col("_s") * F.col("_s") + (F.col("coordZ") - F.col("_mZ")) * (F.col("coordZ") - F.col("_mZ")))) / F.sum(w)
    return rows.groupBy("GroupNoduleID").agg(
        F.min("seriesuid").alias("seriesuid"), *[F.max(f"_m{a}").alias(f"coord{a}") for a in "XYZ"],
        diameter_of_sigma(F.sqrt(spread), proba).alias("diameter_mm"), F.max("NoduleConfidence").alias("NoduleConfidence"),
    )


def nodule_groups(nodules: DataFrame, proba: float = 0.8, threshold: float = 0.1) -> DataFrame:
    return merge_groups(with_groups(nodules, threshold), proba)


def match(true: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each true finding its best predicted one of the source, and the other way round.

    Both take (source_id, nodule_id, z, y, x, diam) and return nodule_id, source_id, match_id and overlap; match_id is
    null without any overlap. Ties go to the smaller id.
    """
    a, b = true.alias("a"), pred.alias("b")
    dist = F.sqrt(squared_distance("a", "b", ("z", "y", "x")))
    pairs = a.join(b, F.col("a.source_id") == F.col("b.source_id")).select(
        F.col("a.source_id").alias("source_id"), F.col("a.nodule_id").alias("t"), F.col("b.nodule_id").alias("p"),
        sphere_overlap(F.col("a.diam"), F.col("b.diam"), dist).alias("overlap"),
    ).where("overlap > 0")

    def best(side: DataFrame, own: str, other: str) -> DataFrame:
        top = pairs.groupBy(own).agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col(other).alias("id"))).alias("m"))
        return side.select("source_id", "nodule_id").join(top, F.col("nodule_id") == F.col(own), "left").select("source_id", "nodule_id", F.col("m.id").alias("match_id"), (-F.col("m.o")).alias("overlap"))

    return best(true, "t", "p"), best(pred, "p", "t")
