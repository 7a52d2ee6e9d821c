"""Lazy chains of DataFrame transforms, with variables and models."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import masks, sampling, volumes

ACTIONS: dict[str, Callable] = {}


def action(fn: Callable) -> Callable:
    """Make a function (DataFrame, ...) -> DataFrame callable as a method of Flow."""
    ACTIONS[fn.__name__] = fn
    return fn


for _module, _names in (
    (volumes, "normalize_hu flip central_crop to_shape crops truncate_mask binarize_mask encode_linear decode_linear resize unify_spacing rotate xip make_xip unxip get_patches segment lung_mask cutout apply_noise mix_images"),
    (masks, "create_mask"),
    (sampling, "sample_nodules sample_xip"),
):
    for _name in _names.split():
        action(getattr(_module, _name))


@dataclass(frozen=True)
class Flow:
    """steps run in order on a DataFrame; nothing is computed before run, next_batch or an action on bind's result."""

    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    source: DataFrame | None = None
    variables: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)

    def then(self, step: Callable, *args, **options) -> Flow:
        """Add step(df, *args, **options); arguments that are Lazy are resolved when the plan is built."""
        def run(df):
            solved = [a.resolve(self, df) if isinstance(a, Lazy) else a for a in args]
            named = {k: v.resolve(self, df) if isinstance(v, Lazy) else v for k, v in options.items()}
            return step(df, *solved, **named)

        return replace(self, steps=(*self.steps, run))

    call = then

    def __getattr__(self, name: str):
        if name in ACTIONS:
            return lambda *args, **options: self.then(ACTIONS[name], *args, **options)
        raise AttributeError(name)

    def __add__(self, other: Flow) -> Flow:
        return Flow((*self.steps, *other.steps), self.source if self.source is not None else other.source, {**self.variables, **other.variables}, {**self.models, **other.models}, {**self.config, **other.config})

    def __lshift__(self, df: DataFrame) -> Flow:
        return replace(self, source=df)

    def __rrshift__(self, df: DataFrame) -> Flow:
        return replace(self, source=df)

    def bind(self, df: DataFrame | None = None) -> DataFrame:
        """The lazy DataFrame."""
        df = df if df is not None else self.source
        if df is None:
            raise ValueError("the flow has no source")
        for step in self.steps:
            df = step(df)
        return df

    def run(self, df: DataFrame | None = None, sink: Callable[[DataFrame], None] | None = None, batch_size: int | None = None, prefetch: int = 0, **options) -> DataFrame | None:
        """Bind, and hand the result to a sink, if one is given.

        With batch_size, each batch of batches(batch_size, **options) is handed to the sink (without one it is computed
        and let go), in order; prefetch of them are computed ahead, as jobs of their own. Nothing is returned then.
        """
        if batch_size is None:
            out = self.bind(df)
            if sink is not None:
                sink(out)
            return out
        flow = self if df is None else replace(self, source=df)
        sink = sink or (lambda part: part.write.format("noop").mode("overwrite").save())
        waiting: deque = deque()

        def done(part, ahead):
            ahead.result()
            sink(part)
            part.unpersist()

        def compute(part):
            part.persist().count()

        if prefetch <= 0:
            for part in flow.batches(batch_size, **options):
                sink(part)
            return None
        with ThreadPoolExecutor(prefetch) as pool:
            for part in flow.batches(batch_size, **options):
                waiting.append((part, pool.submit(compute, part)))
                if len(waiting) > prefetch:
                    done(*waiting.popleft())
            while waiting:
                done(*waiting.popleft())
        return None

    def batches(self, batch_size: int, order="scan_id", shuffle: int | None = None, n_epochs: int = 1, drop_last: bool = False) -> Iterator[DataFrame]:
        """DataFrames of batch_size rows; ids alone are numbered, and only a batch's scans pass the steps."""
        ids = self.source.select("scan_id")
        for epoch in range(n_epochs):
            by = F.xxhash64(F.lit(shuffle + epoch), "scan_id") if shuffle is not None else F.col(order)
            numbered = sampling.batch_numbers(ids, batch_size, [by, F.col("scan_id")], drop_last)
            last = numbered.agg(F.max("batch_no")).first()[0]
            for k in range(-1 if last is None else last + 1):
                chosen = numbered.where(F.col("batch_no") == k).select("scan_id")
                yield self.bind(self.source.join(chosen, "scan_id", "left_semi"))

    def next_batch(self, batch_size: int, **options) -> DataFrame:
        return next(self.batches(batch_size, **options))

    def merge(self, other: Flow, sizes, order="scan_id") -> DataFrame:
        return sampling.merge_by_batch(self.bind(), other.bind(), sizes, order)

    def init_variable(self, name: str, value=None) -> Flow:
        self.variables.setdefault(name, value)
        return self

    def update_variable(self, name: str, value, mode: str = "w") -> Flow:
        """Set (w) or append to (a) a variable."""
        if mode == "a":
            self.variables[name] = [*(self.variables.get(name) or []), value]
        else:
            self.variables[name] = value
        return self

    def get_variable(self, name: str):
        return self.variables[name]

    def init_model(self, name: str, model) -> Flow:
        self.models[name] = model
        return self

    def get_model(self, name: str):
        return self.models[name]

    def set_config(self, **values) -> Flow:
        """A flow with more configuration values, for C."""
        return replace(self, config={**self.config, **values})

    def train_model(self, name: str, *args, **options) -> Flow:
        """A step that calls the model's train(df, *args, **options) with each batch that passes and hands the batch on."""
        def train(df, *args, **options):
            self.models[name].train(df, *args, **options)
            return df

        return self.then(train, *args, **options)


@dataclass(frozen=True)
class Lazy:
    """A value that is found when the plan is built, from the flow and the DataFrame that the step gets."""

    find: Callable

    def resolve(self, flow: Flow, df: DataFrame | None = None):
        return self.find(flow, df)


def V(name: str) -> Lazy:  # noqa: N802
    """A variable of the flow."""
    return Lazy(lambda flow, df: flow.variables[name])


def L(fn: Callable) -> Lazy:  # noqa: N802
    """A call without arguments."""
    return Lazy(lambda flow, df: fn())


def B(name: str) -> Lazy:  # noqa: N802
    """A column of the batch."""
    return Lazy(lambda flow, df: df[name])


def C(name: str, default=None) -> Lazy:  # noqa: N802
    """A configuration value; dots lead into nested ones."""
    def find(flow, df):
        held = flow.config
        for part in name.split("."):
            if not isinstance(held, dict) or part not in held:
                return default
            held = held[part]
        return held

    return Lazy(find)


def Fn(fn: Callable) -> Lazy:  # noqa: N802
    """A call with the batch, a DataFrame."""
    return Lazy(lambda flow, df: fn(df))


TARGETS = ("segmentation", "classification", "regression")


def predict(patches: DataFrame, model: Callable, batch_size: int = 4) -> DataFrame:
    """patches with prediction (array): model takes an array (n, values) and returns one of n rows.

    It is shipped once to a worker and called on batches of batch_size.
    """

    def run(parts):
        import numpy as np

        for pixels in parts:
            out = []
            for k in range(0, len(pixels), batch_size):
                got = np.asarray(model(np.stack([np.asarray(p, float) for p in pixels[k : k + batch_size]])), float)
                out += got.reshape(len(got), -1).tolist()
            yield pd.Series(out, dtype=object)

    from collections.abc import Iterator as It

    run.__annotations__ = {"parts": It[pd.Series], "return": It[pd.Series]}
    # as if not deterministic, so that no inferred filter runs the model again
    return patches.withColumn("prediction", F.pandas_udf(run, "array<double>").asNondeterministic()("pixels"))


def predict_on_scan(scans: DataFrame, model: Callable, strides=(16, 32, 32), crop_shape=(32, 64, 64), batch_size: int = 4, targets_mode: str = "segmentation", dst: str = "masks", padding: str = "reflect") -> DataFrame:
    """Cut scans into overlapping boxes, predict each, and average the predictions into dst.

    segmentation: the model gives a box; classification: one number, spread over the box; regression: centre, size and
    probability (seven numbers), painted as a box.
    """
    if targets_mode not in TARGETS:
        raise ValueError(f"unknown mode {targets_mode}; one of {TARGETS}")
    if not callable(model):
        raise ValueError("the model isn't callable")
    parts = predict(volumes.get_patches(scans, crop_shape, strides, padding), model, batch_size)
    n = crop_shape[0] * crop_shape[1] * crop_shape[2]
    if targets_mode == "classification":
        parts = parts.withColumn("pixels", F.array_repeat(F.col("prediction")[0], n))
    elif targets_mode == "segmentation":
        parts = parts.withColumn("pixels", F.col("prediction"))
    else:
        from ..functions.geometry import zyx

        p = F.col("prediction")
        boxes = parts.withColumns({"center": zyx(p[0], p[1], p[2]), "size": zyx(p[3], p[4], p[5]), "probability": p[6]})
        parts = masks.box_of_prediction(boxes, crop_shape, 0.01, "pixels")
    whole = volumes.load_from_patches(parts.select("scan_id", "scan_shape", "patch_no", "pixels"), crop_shape, strides, "_predicted")
    return scans.join(whole.select("scan_id", "_predicted"), "scan_id", "left").drop(dst).withColumnRenamed("_predicted", dst)


def training_data(scans: DataFrame, mode: str, nodules: DataFrame | None = None, is_training: bool = True, threshold: float = 10) -> DataFrame:
    """scan_id and features, with label if training: the mask, a 0/1 class, or seven regression targets."""
    if mode not in TARGETS:
        raise ValueError(f"unknown mode {mode}; one of {TARGETS}")
    rows = scans.select("scan_id", F.col("images").alias("features"), *(["masks"] if is_training else []))
    if not is_training:
        return rows
    if mode == "segmentation":
        return rows.withColumnRenamed("masks", "label")
    if mode == "classification":
        return rows.select("scan_id", "features", F.array(masks.classification_target(F.col("masks"), threshold).cast("double")).alias("label"))
    targets = masks.regression_targets(scans, nodules, threshold)
    label: Column = F.array(*[F.col(c).cast("double") for c in targets.columns if c != "scan_id"])
    return rows.select("scan_id", "features").join(targets.select("scan_id", label.alias("label")), "scan_id")
