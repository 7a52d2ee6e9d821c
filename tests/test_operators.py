"""Operators on small hand-made tables: errors, invariants and sampling."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tomospark.functions.geometry import epanechnikov, sphere_overlap, zyx
from tomospark.functions.voxels import from_voxels, to_voxels
from tomospark.operators import annotations, confidence, masks, merging, sampling, volumes
from tomospark.plans import flow, flows
from tomospark.sources import scans as files


@pytest.fixture(scope="module")
def scans(spark):
    rng = np.random.default_rng(0)
    made = files.load(spark, fmt=None, src={f"s{k}": rng.normal(0, 500, (4, 6, 6)) for k in range(6)})
    return made.withColumn("masks", F.transform("images", lambda v: F.when(v > 600, 1.0).otherwise(0.0))).cache()


@pytest.fixture(scope="module")
def nodules(spark):
    rows = [(f"s{k % 6}", f"n{k}", (1.0 + k % 3, 2.0, 3.0), (2.0, 2.0, 2.0)) for k in range(10)]
    triple = "struct<z:double,y:double,x:double>"
    return spark.createDataFrame(rows, f"scan_id string, nodule_id string, center {triple}, size {triple}")


def arrays(df, column="images"):
    return {r.scan_id: np.array(r[column]).reshape(tuple(r["shape"])) for r in df.select("scan_id", "shape", column).collect()}


def test_voxel_view_round_trip(scans):
    back = from_voxels(to_voxels(scans))
    assert {k: v.tolist() for k, v in arrays(back).items()} == {k: v.tolist() for k, v in arrays(scans).items()}


def test_flip_twice(scans):
    assert all((arrays(volumes.flip(volumes.flip(scans)))[k] == v).all() for k, v in arrays(scans).items())


@pytest.mark.parametrize("padding", ["edge", "reflect", "constant"])
def test_to_shape(scans, padding):
    got = arrays(volumes.to_shape(scans, (7, 5, 9), padding))
    for k, v in arrays(scans).items():
        want = np.pad(v[:, 0:5, :], [(1, 2), (0, 0), (1, 2)], mode=padding)
        assert (got[k] == want).all()


def test_crop_too_large(scans):
    with pytest.raises(PySparkException, match="larger"):
        volumes.central_crop(scans, (5, 2, 2)).collect()


def test_unknown_options(scans, nodules):
    for call in (lambda: volumes.resize(scans, (2, 2, 2), "cubic"), lambda: volumes.xip(scans, 2, "sum"), lambda: masks.create_mask(scans, nodules, "disc"), lambda: volumes.mix_images(scans, scans, mode="min"),
                 lambda: flow.training_data(scans, "x"), lambda: flow.predict_on_scan(scans, 3), lambda: flow.predict_on_scan(scans, len, targets_mode="x"), lambda: sampling.sample_nodules(scans, nodules, (2, 2, 2), None, 0.0),
                 lambda: flows.set_dataset_mode("x"), lambda: volumes.apply_noise(scans, F.col("images"), "/")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError, match="missing"):
        masks.fetch_nodules(nodules, scans)


def test_codes(scans):
    for encode, decode in ((volumes.encode_linear, volumes.decode_linear), (volumes.encode_quantized, volumes.decode_quantized)):
        coded = encode(scans)
        assert dict(coded.dtypes)["codes"] == "array<tinyint>"
        back = arrays(decode(coded))
        for k, v in arrays(scans).items():
            assert np.abs(back[k] - v).max() <= 2 * np.ptp(v) / 255
    flat = scans.withColumn("images", F.transform("images", lambda v: F.lit(7.0)))
    assert all((v == 7).all() for v in arrays(volumes.decode_linear(volumes.encode_linear(flat))).values())


def test_items(scans):
    assert volumes.get(scans, 2, "spacing").first().scan_id == "s2" and volumes.get(scans, "s3").count() == 1
    for place in (6, -1):
        with pytest.raises(IndexError):
            volumes.get(scans, place)
    row = volumes.unpack(scans).where("scan_id = 's0'").first()
    assert np.array(row.images).tolist() == arrays(scans)["s0"].tolist()
    assert volumes.unpack(scans, "nothing").first().nothing is None


def test_patches_round_trip(scans):
    cut = volumes.get_patches(scans, (3, 4, 4), (2, 3, 2), "reflect")
    back = arrays(volumes.load_from_patches(cut, (3, 4, 4), (2, 3, 2)))
    assert all(np.allclose(back[k], v) for k, v in arrays(scans).items())


def test_predict_regression_and_segmentation(scans):
    box = flow.predict_on_scan(scans, lambda b: np.tile([0.5, 0.5, 0.5, 1, 1, 1, 0.9], (len(b), 1)), (2, 2, 2), (2, 2, 2), targets_mode="regression", dst="found")
    assert all((v == 1).all() for v in arrays(box, "found").values())
    same = flow.predict_on_scan(scans, lambda b: b * 2, (2, 2, 2), (2, 2, 2), dst="found")
    assert all(np.allclose(v, 2 * arrays(scans)[k]) for k, v in arrays(same, "found").items())


def test_sampling_counts(scans, nodules):
    """Shares: 6 of 8 around findings at 0.8, 4 at 0.5; all of them without a batch size."""
    for share, size, want in ((0.8, 8, 6), (0.5, 8, 4), (0.6, 10, 6)):
        starts = sampling.sample_starts(scans, nodules, (2, 2, 2), size, share)
        assert starts.count() == size and starts.where("nodule_id IS NOT NULL").count() == want
        assert starts.select("crop_id").distinct().count() == size
    crops = sampling.sample_nodules(scans, nodules, (2, 2, 2), None, 1.0, (2, 2, 2))
    assert crops.count() == nodules.count()
    shape = arrays(scans)["s0"].shape
    for r in sampling.sample_starts(scans, nodules, (2, 3, 3), 40, 0.1, (9, 9, 9)).collect():
        assert all(0 <= s <= n - k for s, n, k in zip(r.start, shape, (2, 3, 3), strict=True))
    again = [sorted(map(str, sampling.sample_starts(scans.repartition(n), nodules, (2, 2, 2), 8, 0.5).collect())) for n in (1, 5)]
    assert again[0] == again[1]
    assert sampling.sample_rounds(scans, nodules, 2, size=(2, 2, 2), batch_size=4, share=0.5).count() == 8
    assert sampling.sample_nodules(scans, nodules, (2, 2, 2), 0, 0.5).count() == 0


def test_crop_contents(scans, nodules):
    starts = sampling.sample_starts(scans, nodules, (2, 2, 2), None, 1.0)
    whole = arrays(scans)
    made = {r.crop_id: np.array(r.images).reshape(2, 2, 2) for r in volumes.crops(scans, starts, (2, 2, 2)).collect()}
    for r in starts.collect():
        z, y, x = r.start
        assert (made[r.crop_id] == whole[r.scan_id][z : z + 2, y : y + 2, x : x + 2]).all()


def test_histogram_sampling(scans):
    counts, edges = [[[0, 0], [0, 0]], [[0, 0], [0, 5]]], ((0, 2, 4), (0, 3, 6), (0, 3, 6))
    rows = sampling.random_starts(scans, 200, (2, 2, 2), histo=(counts, edges)).collect()
    assert len(rows) == 200 and all(r.start.z >= 1 and r.start.y >= 2 and r.start.x >= 2 for r in rows)


def test_ellipsoid(spark):
    for r in sampling.ellipsoid_region(spark.range(300), (1, 2, 3), (2, 3, 4), (0.5, 1.5)).collect():
        assert 0.5 - 1e-9 <= np.sqrt(((r.z - 1) / 2) ** 2 + ((r.y - 2) / 3) ** 2 + ((r.x - 3) / 4) ** 2) <= 1.5 + 1e-9


def test_sampler(spark):
    s = sampling.Sampler
    mixed = (s.normal(0, 1) * 2 + 5).truncate(4, 6) | s.uniform(10, 11).weighed(3)
    values = np.array([r.v for r in spark.range(4000).select(mixed.sample(1, F.col("id")).alias("v")).collect()])
    low = values < 7
    assert 0.2 < low.mean() < 0.3 and values[low].min() >= 4 and values[low].max() <= 6 and values[~low].min() >= 10
    z = np.array([r.v for r in spark.range(4000).select(sampling.normal(3, F.col("id")).alias("v")).collect()])
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1


def test_split(scans, spark):
    ids = spark.range(2000).select(F.col("id").alias("scan_id"))
    train, test = sampling.split(ids, 0.7)
    assert train.count() + test.count() == 2000 and abs(train.count() - 1400) < 100
    first, rest = sampling.split_batch(scans, 2, "scan_id")
    assert (first.count(), rest.count()) == (2, 4)
    assert sampling.split_batch(scans, 0, "scan_id")[0] is None and sampling.split_batch(scans, 6, "scan_id")[1] is None
    assert sampling.concat(None, None) is None
    whole, none = sampling.merge(scans.select("scan_id"), scans.select("scan_id"))
    assert whole.count() == 12 and none is None
    a, b = sampling.merge(scans.select("scan_id"), scans.select("scan_id"), batch_size=5)
    assert (a.count(), b.count()) == (5, 7)


def test_sample_xip(scans):
    rows = sampling.sample_xip(scans, 2, 1, 10, 0.5, channels=1).collect()
    assert len(rows) == 10 and sum(r.cancer for r in rows) >= 5


def test_masks_follow_resize(scans, nodules):
    """The mask made after a resize agrees with the finding's voxels."""
    big = volumes.resize(scans, (8, 12, 12))
    mask = arrays(masks.create_mask(big, nodules), "masks")
    assert all(v.sum() > 0 for v in mask.values()) and mask["s0"].shape == (8, 12, 12)
    none = masks.create_mask(scans, nodules.where("false"))
    assert all((v == 0).all() for v in arrays(none, "masks").values())


def test_finds_planted_component(spark):
    volume = np.zeros((6, 6, 6))
    volume[1:4, 2:5, 2:5] = 1
    one = files.load(spark, fmt=None, src={"a": volume}).withColumn("masks", F.col("images")).withColumn("spacing", zyx(2.0, 1.0, 1.0))
    row = masks.nodules_from_mask(one).first()
    assert tuple(row.center) == (4.0, 3.0, 3.0) and abs(row.size.y - (6 * 27 / np.pi) ** (1 / 3)) < 1e-9 and abs(row.size.z - 2 * row.size.y) < 1e-9


def test_sphere_overlap(spark):
    cases = [(2.0, 2.0, 5.0, 0.0), (10.0, 4.0, 1.0, 1.0), (4.0, 10.0, 1.0, 1.0), (22.0, 4.0, 1.0, 0.0), (2.0, 2.0, 0.0, 1.0)]
    df = spark.createDataFrame(cases, "a double, b double, d double, want double")
    assert all(abs(r.got - r.want) < 1e-4 for r in df.select("want", sphere_overlap(F.col("a"), F.col("b"), F.col("d")).alias("got")).collect())
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (-2.0,)], "u double").select(epanechnikov(F.col("u"))).collect()] == [0.75, 0.0, 0.0]


def findings(spark):
    rows = [("s", "a", 0, 10.0, 10.0, 10.0, 6.0, 0.9), ("s", "b", 1, 11.0, 10.0, 10.0, 6.0, 0.8), ("s", "c", 2, 12.0, 10.0, 10.0, 6.0, 0.7), ("s", "d", 2, 90.0, 10.0, 10.0, 6.0, 0.7), ("t", "e", 0, 10.0, 10.0, 10.0, 6.0, 0.9)]
    return spark.createDataFrame(rows, "seriesuid string, NoduleID string, DoctorID int, coordX double, coordY double, coordZ double, diameter_mm double, DoctorConfidence double")


def test_groups_shrink(spark):
    rows = findings(spark)
    grouped = {r.NoduleID: r.GroupNoduleID for r in merging.groups(rows).collect()}
    assert grouped == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    scored = confidence.with_confidence(rows)
    assert merging.nodule_groups(scored).count() == 3


def test_good_doctors_win(spark):
    from tomospark.sources import annotations as made

    rows = made.generate_annotation(spark, 60, 5, bad_doctors=[0], seed=3).withColumn("DoctorID", F.col("DoctorID").cast("int"))
    last = confidence.doctor_confidences(rows, n_iters=4, factor=0.1).where("iteration = 4").collect()
    by = {r.DoctorID: r.confidence for r in last}
    assert by[0] == min(by.values()) and len(by) == 5
    few = confidence.doctor_confidences(rows, n_iters=2, factor=0.1, n_consiliums=3)
    assert few.count() == 15
    assert [r.rating for r in confidence.rating(spark.createDataFrame([(1, 0.2), (2, 0.9)], "DoctorID int, confidence double")).orderBy("DoctorID").collect()] == [2, 1]


def test_verifications(spark):
    rows = findings(spark).join(merging.groups(findings(spark)), "NoduleID")
    got = {(r.DoctorID, r.verifications): r.n for r in annotations.verification_counts(rows).collect()}
    assert got == {(0, 3): 1, (1, 3): 1, (2, 3): 1, (2, 1): 1, (0, 1): 1}


def annotation_of(spark, scans):
    rows = [(f"s{k}", 3.0, 2.0, 1.0 + k % 3, 2.0) for k in range(5)] + [("other", 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "seriesuid string, coordX double, coordY double, coordZ double, diameter_mm double")


SMALL = flows.Settings(spacing=(1.0, 1.0, 1.0), shape=(4, 6, 6), method="linear", crop=(2, 2, 2), variance=(1, 1, 1), rounds=2, random_per_run=3, run_size=3)


def test_canned_flows(spark, scans, tmp_path):
    table = annotation_of(spark, scans)
    crops = flows.get_crops(scans, table, 10, 0.5, settings=SMALL)
    rows = crops.collect()
    assert len(rows) == 20 and all(len(r.images) == 8 and len(r.masks) == 8 and 0 <= min(r.images) and max(r.images) <= 255 for r in rows)
    flows.split_dump(scans, table, str(tmp_path / "c"), str(tmp_path / "n"), settings=SMALL)
    cancer, other = (files.load(spark, str(tmp_path / x), components=["images", "masks", "spacing", "origin"]) for x in "cn")
    assert (cancer.count(), other.count()) == (10, 6)
    both = flows.combine_crops(cancer, other, (3, 2))
    sizes = {(r.batch_no, r.part): r["count"] for r in both.groupBy("batch_no", "part").count().collect()}
    assert sizes and all(n == (3, 2)[part] for (_, part), n in sizes.items())
    edges = ((0, 2, 4),) * 3
    once = flows.update_histo(scans, table, None, edges, SMALL)
    twice = flows.update_histo(scans, table, once, edges, SMALL)
    assert twice.agg(F.sum("n")).first()[0] == 10
    assert flows.set_dataset_mode("npcmr").random_per_run == 480


def test_flow(scans):
    chain = flow.Flow().init_variable("seen", 0).flip() + flow.Flow().normalize_hu()
    got = arrays((chain << scans).run())
    assert all(np.allclose(got[k], 255 * np.clip((v[::-1] + 1000) / 1400, 0, 1)) for k, v in arrays(scans).items())
    chain.update_variable("losses", 1, "a").update_variable("losses", 2, "a").update_variable("seen", 5)
    assert chain.get_variable("losses") == [1, 2] and chain.get_variable("seen") == 5
    lazy = flow.Flow().init_variable("size", (2, 2, 2)).central_crop(flow.V("size"))
    assert all(v.shape == (2, 2, 2) for v in arrays(lazy.bind(scans)).values())
    sizes = [b.count() for b in (scans >> chain).batches(4)]
    assert sizes == [4, 2] and [b.count() for b in (scans >> chain).batches(4, drop_last=True, shuffle=1)] == [4]
    assert (chain << scans).next_batch(3).count() == 3
    assert flow.Flow().init_model("m", len).get_model("m") is len
    with pytest.raises(ValueError, match="source"):
        flow.Flow().bind()
    with pytest.raises(AttributeError):
        flow.Flow().nothing()
    assert (scans >> flow.Flow()).merge(scans >> flow.Flow(), (2, 2)).count() == 12


def test_flow_values_and_batches(scans):
    """B, C and Fn are found when a step gets its batch; run goes by batches, some of them ahead; models see each batch."""
    class Model:
        seen = 0

        def train(self, df):
            self.seen += df.count()

    model, parts = Model(), []
    chain = flow.Flow().set_config(noise={"sigma": 2.0}).init_model("m", model).apply_noise(flow.B("images"), "-")
    chain = chain.then(lambda df, s, n, other: df.withColumn("sigma", F.lit(s)).withColumn("n", F.lit(n)).withColumn("other", F.lit(other)), flow.C("noise.sigma"), flow.Fn(lambda df: len(df.columns)), flow.C("absent", 7)).train_model("m")
    for prefetch in (0, 2):
        parts.clear()
        assert (chain << scans).run(sink=lambda part: parts.append(part.select("scan_id", "sigma", "n", "other", F.array_max("images").alias("m")).collect()), batch_size=4, prefetch=prefetch) is None
        assert [len(p) for p in parts] == [4, 2] and {(r.sigma, r.n, r.other, r.m) for p in parts for r in p} == {(2.0, 6, 7, 0.0)}
    assert model.seen == 12


def test_axes_pairs(scans):
    """All pairs agree, as resampling is separable; a pair needs two axes."""
    plain, pairs = (volumes.resize(scans, (3, 5, 4), "lanczos", axes_pairs=p).orderBy("scan_id").collect() for p in (None, ((0, 1), (1, 2), (2, 0))))
    assert all(np.allclose(a.images, b.images) for a, b in zip(plain, pairs, strict=True))
    with pytest.raises(ValueError, match="pair"):
        volumes.resize(scans, (3, 5, 4), axes_pairs=((1, 1),))


def test_masked_slice(scans):
    row = volumes.axial_slice(scans, 0.5, mask="masks").first()
    assert len(row.pixels) == len(row.mask) == 36 and volumes.axial_slice(scans.drop("masks"), 0.5, mask="masks").first().mask is None


def test_large_grid_of_patches(spark):
    """Overlapping boxes of many times the scan's size pass in rows, and a part of them can be assembled."""
    scan = files.load(spark, fmt=None, src={"a": np.arange(20 * 40 * 40).reshape(20, 40, 40) % 97, "b": np.ones((20, 40, 40))})
    boxes = volumes.get_patches(scan, (8, 16, 16), (2, 4, 4), "reflect")
    assert boxes.count() == 2 * 7 * 7 * 7
    whole = {r.scan_id: r.images for r in volumes.load_from_patches(boxes, (8, 16, 16), (2, 4, 4)).collect()}
    assert np.allclose(whole["a"], (np.arange(20 * 40 * 40) % 97).tolist()) and set(whole["b"]) == {1.0}
    some = volumes.load_from_patches(boxes.where("patch_no = 0 AND scan_id = 'b'"), (8, 16, 16), (2, 4, 4)).first()
    assert sum(some.images) == 8 * 16 * 16


def plain_components(image):
    """Flood fill over 26 neighbours of equal value, numbered by first voxel."""
    out, n = np.zeros(image.shape, int), 0
    for p in np.ndindex(image.shape):
        if image[p] and not out[p]:
            n, todo = n + 1, [p]
            out[p] = n
            while todo:
                q = todo.pop()
                for d in np.ndindex(3, 3, 3):
                    r = tuple(a + b - 1 for a, b in zip(q, d, strict=True))
                    if all(0 <= a < b for a, b in zip(r, image.shape, strict=True)) and image[r] == image[p] and not out[r]:
                        out[r] = n
                        todo.append(r)
    return out


def test_lungs_against_flood_fill(scans):
    """segment on small random scans, by plain loops."""
    got = {r.scan_id: np.array(r.images).reshape(4, 6, 6) for r in volumes.segment(scans, 1).collect()}
    for r in scans.collect():
        image = np.array(r.images).reshape(4, 6, 6)
        tissue = (image > -320).astype(int) + 1
        parts = plain_components(tissue)
        tissue[np.isin(parts, [parts[z, y, x] for z in range(4) for y in (0, -1) for x in (0, -1)])] = 2
        for z in range(4):
            inside = plain_components(np.stack([tissue[z] - 1]))[0]
            sizes = np.bincount(inside.ravel())[1:]
            tissue[z][(inside != sizes.argmax() + 1) if len(sizes) else True] = 1
        lungs = plain_components(2 - tissue)
        sizes = np.bincount(lungs.ravel())[1:]
        mask = (lungs == sizes.argmax() + 1) if len(sizes) else np.zeros(image.shape, bool)
        kept = mask.copy()
        for z, y, x in np.ndindex(mask.shape):
            kept[z, y, x] = all(mask[z, y + i, x + j] for i, j in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) if 0 <= y + i < 6 and 0 <= x + j < 6)
        assert (got[r.scan_id] == np.where(kept, image, -2000)).all()


def test_quantized_against_plain_means(scans):
    """Decoded values are the centres of a plain one-dimensional k-means, nearest to each value."""
    coded = volumes.encode_quantized(scans.select("scan_id", "shape", "images"), clusters=5)
    got = {r.scan_id: r.images for r in volumes.decode_quantized(coded).collect()}
    for r in scans.collect():
        centers = [min(r.images) + k * (max(r.images) - min(r.images)) / 4 for k in range(5)]
        for _ in range(5):
            near = [min(range(5), key=lambda k: (abs(v - centers[k]), k)) for v in r.images]
            centers = sorted(np.mean([v for v, n in zip(r.images, near, strict=True) if n == k]) if k in near else c for k, c in enumerate(centers))
        want = [min(centers, key=lambda c: abs(v - c)) for v in r.images]
        assert np.allclose(got[r.scan_id], want)


def test_crops_per_run(scans, nodules):
    """Each run of scans gives a batch of its own."""
    made = sampling.sample_per_run(scans, nodules, (2, 2, 2), 5, 0.6, 2, seed=1).collect()
    own = {f"s{k}": k // 2 for k in range(6)}
    assert len(made) == 15 and all(own[r.scan_id] == r.run for r in made)
    starts = {r.crop_id for r in made}
    assert len(starts) == 15


def test_training_data(scans, nodules):
    plain = flow.training_data(scans, "segmentation", is_training=False)
    assert plain.columns == ["scan_id", "features"]
    assert flow.training_data(scans, "segmentation").columns == ["scan_id", "features", "label"]
    assert {tuple(r.label) for r in flow.training_data(scans, "classification").collect()} <= {(0.0,), (1.0,)}
    assert all(len(r.label) == 7 for r in flow.training_data(scans, "regression", nodules).collect())


def test_permutation_and_noise(scans):
    pairs = volumes.permutation(scans).collect()
    assert {p.scan_id for p in pairs} == {p.partner_id for p in pairs} and all(p.scan_id != p.partner_id for p in pairs)
    noisy = arrays(volumes.apply_noise(scans, volumes.gaussian_noise(1, 2.0)))
    spread = np.concatenate([(noisy[k] - v).ravel() for k, v in arrays(scans).items()])
    assert 1.5 < spread.std() < 2.5


def test_streaming_histogram(spark, scans, nodules, tmp_path):
    from tomospark.streaming import histogram

    nodules.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(nodules.schema).parquet(str(tmp_path / "in"))
    edges = ((0, 2, 4), (0, 3, 6), (0, 3, 6))
    query = histogram.start(stream, scans, edges, str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, masks.histogram(nodules, scans, edges).collect()))


def test_plans_stay_native(spark):
    """The pairwise queries keep an equality key and no Python; element-wise rules need no shuffle."""
    from tomospark.plans import surrogates

    folder = "/root/testdata/sf0.001"
    pytest.importorskip("duckdb")
    import os

    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(confidence.finding_confidence(surrogates.nodules(spark, folder)))
    assert "NestedLoop" not in text and "Python" not in text and "Arrow" not in text
    text = plan(volumes.normalize_hu(volumes.flip(surrogates.scans(spark, folder))))
    assert "Exchange" not in text and "Python" not in text


@pytest.mark.parametrize("mode", ["rectangle", "ellipse", "fetch"])
def test_equal_boxes_meet_before_they_are_collected(spark, scans, monkeypatch, mode):
    """A kernel gets each box of a scan once, however many findings share it."""
    triple = "struct<z:double,y:double,x:double>"
    rows = [("s0", f"n{k}", (1.0 + k % 2, 2.0, 3.0), (2.0, 2.0, 2.0)) for k in range(1000)] + [("s0", "far", (90.0, 2.0, 3.0), (2.0, 2.0, 2.0))]
    many = spark.createDataFrame(rows, f"scan_id string, nodule_id string, center {triple}, size {triple}")
    make = lambda found: masks.fetch_mask(scans, found, (8, 8, 8)) if mode == "fetch" else masks.create_mask(scans, found, mode)
    want = {k: v.tolist() for k, v in arrays(make(many.where("nodule_id IN ('n0', 'n1')")), "masks").items()}
    assert {k: v.tolist() for k, v in arrays(make(many), "masks").items()} == want
    monkeypatch.setattr(masks.kernels, "per_row", lambda kernel: lambda image, shape, held: F.length(F.to_json(held)))
    assert make(many).where("scan_id = 's0'").first().masks < 100


def plan(df) -> str:
    return df.select("*")._jdf.queryExecution().executedPlan().toString()  # not the one that has run


def test_masks_of_doctors_in_one_pass(spark):
    """Sizes equal the count of different voxels, unknown doctors, scans and places included; no voxel or scan is shuffled twice."""
    rng = np.random.default_rng(5)
    rows = [(int(s) if s else None, int(d) if d < 6 else None, *map(float, rng.integers(0, 60, 3)), float(g) if g else None)
            for s, d, g in zip(rng.integers(0, 40, 400), rng.integers(0, 7, 400), rng.integers(0, 30, 400), strict=True)]
    found = spark.createDataFrame(rows, "seriesuid long, DoctorID int, coordX double, coordY double, coordZ double, diameter_mm double")
    want = confidence.ball_voxels(found, 0.1).groupBy("seriesuid", "DoctorID").count()
    made = confidence.mask_sizes(found, 0.1)
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert plan(made).count("Exchange hashpartitioning") == 1 and "Generate" not in plan(made)
    last = confidence.doctor_confidences(found, 3, factor=0.1)
    assert plan(last).count("MapInArrow") == 1 and "collect_set" not in plan(last)
    assert {r.DoctorID: r.confidence for r in last.where("iteration = 3").collect()}[None] == 0.5
    assert "flatten" not in plan(confidence.consilium_scores(found, 0.1))


def test_pivot_in_bits(spark):
    """A column for each of many doctors; unknown and unlisted ones give none."""
    rows = [("a", 0), ("a", 62), ("a", 63), ("a", 0), ("b", 99), ("b", None), ("c", None), (None, 64)]
    pairs = spark.createDataFrame(rows, "seriesuid string, DoctorID long")
    wide = annotations.annotators_pivot(pairs, range(70))
    assert {r.seriesuid: [k for k in range(70) if r[f"doctor_{k:03d}"]] for r in wide.collect()} == {"a": [0, 62, 63], "b": [], "c": [], None: [64]}
    assert plan(wide).count("Exchange hashpartitioning") == 1 and "pivotfirst" not in plan(wide)


def test_first_rows_without_an_order_of_all(spark, scans, nodules, monkeypatch):
    """Findings are picked before places are made, without a window over all; many are picked by shares of the draw, the same ones."""
    starts = sampling.sample_starts(scans, nodules, (2, 2, 2), 5, 0.6, (1, 1, 1))
    assert starts.where("nodule_id IS NOT NULL").count() == 3
    assert "row_number" not in plan(sampling.sample_starts(scans, nodules, (2, 2, 2), 3, 1.0, (1, 1, 1)))
    rows = spark.range(3000).withColumn("n", F.col("id").cast("string"))
    u = sampling.uniform(1, F.col("id") % 1000)
    want = sorted(r.id for r in rows.orderBy(u, "n").limit(1700).collect())
    for top in (10_000, 50, 0):
        monkeypatch.setattr(sampling, "TOP", top)
        assert sorted(r.id for r in sampling._first(rows, 1700, u, "n").collect()) == want
    none = sampling.sample_starts(scans, nodules, (2, 2, 2), 4, 0.0)
    assert none.count() == 4 and none.where("nodule_id IS NULL").count() == 4 and none.columns == starts.columns


@pytest.mark.parametrize("size", [(2, 3, 2), (9, 9, 3)])
def test_crops_cut_whole_lines(spark, size):
    made = files.load(spark, fmt=None, src={"s": np.arange(1000.0).reshape(10, 10, 10)})
    starts = spark.createDataFrame([("s", "c", (1, 0, 4))], "scan_id string, crop_id string, start struct<z:int,y:int,x:int>")
    crops = volumes.crops(made, starts, size)
    want = np.arange(1000.0).reshape(10, 10, 10)[1 : 1 + size[0], : size[1], 4 : 4 + size[2]]
    assert crops.first().images == want.ravel().tolist() and "slice(" in plan(crops)
