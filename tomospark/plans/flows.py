"""Canned flows from raw scans to crops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import masks, sampling, volumes
from ..sources import scans as files


@dataclass(frozen=True)
class Settings:
    """What the flows share; LUNA and NPCMR are the two data sets' numbers."""

    spacing: tuple = (1.7, 1.0, 1.0)
    shape: tuple = (400, 512, 512)
    method: str = "lanczos"
    padding: str = "reflect"
    crop: tuple = (32, 64, 64)
    variance: tuple = (36, 144, 144)
    hu: tuple = (-1000, 400)
    rounds: int = 100
    random_per_run: int = 1030
    run_size: int = 8


LUNA = Settings()
NPCMR = Settings(rounds=15, random_per_run=480)


def set_dataset_mode(name: str) -> Settings:
    modes = {"luna": LUNA, "npcmr": NPCMR}
    if name not in modes:
        raise ValueError(f"unknown data set {name}; one of {sorted(modes)}")
    return modes[name]


def prepared(scans: DataFrame, annotation: DataFrame, settings: Settings = LUNA) -> tuple[DataFrame, DataFrame]:
    """Scans at common spacing and shape with masks, and their findings."""
    nodules = masks.fetch_nodules(annotation, scans)
    even = volumes.unify_spacing(scans, settings.spacing, settings.shape, settings.method, padding=settings.padding)
    return masks.create_mask(even, nodules), nodules


def get_crops(scans: DataFrame, annotation: DataFrame, batch_size: int = 20, share: float = 0.5, histo=None, settings: Settings = LUNA, seed: int = 42) -> DataFrame:
    """Crops with masks for training: around findings and elsewhere, batch_size for each run of settings.run_size scans."""
    even, nodules = prepared(scans, annotation, settings)
    even = volumes.normalize_hu(even, *settings.hu)
    return sampling.sample_per_run(even, nodules, settings.crop, batch_size, share, settings.run_size, settings.variance, histo, seed, ("images", "masks"))


def split_dump(scans: DataFrame, annotation: DataFrame, cancer_path: str, non_cancer_path: str, histo=None, settings: Settings = LUNA, seed: int = 42) -> None:
    """Write crops around findings (settings.rounds shifted ones each) and random crops, as two tables."""
    even, nodules = prepared(scans, annotation, settings)
    even = even.persist()
    try:
        cancer = sampling.sample_rounds(even, nodules, settings.rounds, seed, size=settings.crop, batch_size=None, share=1.0, variance=settings.variance, columns=("images", "masks"))
        files.dump(cancer.withColumn("scan_id", F.col("crop_id")), cancer_path)
        runs = -(-scans.count() // settings.run_size)
        other = sampling.sample_nodules(even, nodules, settings.crop, settings.random_per_run * runs, 0.0, None, histo, seed, ("images", "masks"))
        files.dump(other.withColumn("scan_id", F.col("crop_id")), non_cancer_path)
    finally:
        even.unpersist()


def update_histo(scans: DataFrame, annotation: DataFrame, histo: DataFrame | None, edges, settings: Settings = LUNA) -> DataFrame:
    """histo (bz, by, bx, n) with these scans' findings added. Only geometry is computed: no pixels are read."""
    nodules = masks.fetch_nodules(annotation, scans)
    flat = scans.select("scan_id", "shape", "spacing", "origin", F.lit(None).cast("array<double>").alias("images"))
    even = volumes.unify_spacing(flat, settings.spacing, settings.shape, settings.method, padding=settings.padding).select("scan_id", "shape", "spacing", "origin")
    added = masks.histogram(nodules, even, edges)
    return added if histo is None else masks.add_histograms(histo, added)


def combine_crops(cancer: DataFrame, non_cancer: DataFrame, batch_sizes=(10, 10), hu=(-1000, 400), shuffle: int | None = 42) -> DataFrame:
    """Batches of crops of both kinds, normalised; ids are numbered, and pixels join them."""
    def order(df):
        ids = df.select("scan_id")
        return ids.withColumn("_o", F.xxhash64(F.lit(shuffle), "scan_id") if shuffle is not None else F.lit(0))

    numbers = sampling.merge_by_batch(order(cancer), order(non_cancer), batch_sizes, ["_o", "scan_id"]).drop("_o")
    both = cancer.withColumn("part", F.lit(0)).unionByName(non_cancer.withColumn("part", F.lit(1)))
    return volumes.normalize_hu(both, *hu).join(numbers, ["scan_id", "part"])
