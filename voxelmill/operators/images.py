"""Image quality by image and by series; connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.functions import pixels as X
from voxelmill.operators.barrier import settled

#: Modalities whose images may be masks. Fixed values.
MASKED = ("DX", "DR", "CR", "MG", "RF", "CT", "MR", "DEFAULT")


def component_count(mask: np.ndarray) -> int:
    """4-connected regions: runs of each row are joined with the runs that they touch in the row before."""
    rows, cols = mask.shape
    framed = np.zeros((rows, cols + 2), dtype=np.int8)
    framed[:, 1:-1] = mask
    steps = np.diff(framed.reshape(-1))  # a frame column ends every run in its row
    begin, end = np.flatnonzero(steps == 1) + 1, np.flatnonzero(steps == -1) + 1
    # a run touches those of the row before that end after it begins and begin before it ends
    first = np.searchsorted(end, begin - (cols + 2), side="right")
    last = np.searchsorted(begin, end - (cols + 2), side="left")
    root = list(range(len(begin)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    count = len(root)
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        for j in range(a, b):
            x, y = find(j), find(k)
            if x != y:
                root[max(x, y)] = min(x, y)
                count -= 1
    return count


def with_components(images: DataFrame, into: str = "components", share: float = 0.01) -> DataFrame:
    """Add the number of regions of pixels in the top ``share`` of the range; needs ``data, n_rows, n_cols``.

    Null where there are no pixels, or not as many as rows and columns say.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, rows, cols in batches:
            made = []
            for values, r, c in zip(data, rows, cols, strict=True):
                if values is None or not len(values) or r is None or c is None or len(values) != r * c:
                    made.append(None)
                    continue
                x = np.asarray(values, dtype=float).reshape(int(r), int(c))
                low, high = np.nanmin(x, initial=np.inf), np.nanmax(x, initial=-np.inf)
                made.append(component_count(x > high - share * (high - low)))
            yield pd.Series(made, dtype="Int32")

    return images.withColumn(into, count("data", "n_rows", "n_cols"))


def segmentation_mask(images: DataFrame, into: str = "masked", bright: float = 0.05, most: int = 10) -> DataFrame:
    """Whether much of an image is near its maximum, in few regions; not asked of other modalities than ``MASKED`` names."""
    low, high = F.array_min("data"), F.array_max("data")
    bright_share = X.share_of(F.col("data"), lambda x: x > high - 0.05 * (high - low))
    return with_components(images, "_n").withColumn(into, F.coalesce(F.col("modality").isin(*MASKED) & (high > low) & (bright_share > bright) & (F.col("_n") <= most), F.lit(False))).drop("_n")


def low_quality_png(images: DataFrame, into: str = "low", bright: float = 0.05, most: int = 10) -> DataFrame:
    """Whether more than ``bright`` of an 8-bit image is above 250 and its pixels of 255 form few regions; false without pixels."""

    @F.pandas_udf("int")
    def regions(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, rows, cols in batches:
            yield pd.Series([None if v is None or len(v) != r * c else component_count(np.asarray(v).reshape(int(r), int(c)) == 255) for v, r, c in zip(data, rows, cols, strict=True)], dtype="Int32")

    much = X.share_of(F.col("data"), lambda x: x > 250) > bright
    return images.withColumn(into, F.coalesce(much & (regions("data", "n_rows", "n_cols") <= most), F.lit(False)))


def image_quality(images: DataFrame, overrides: dict[tuple[str, str], float] | None = None, masks: bool = True) -> DataFrame:
    """Add ``reasons`` and ``low`` to images with ``image_id, modality, data, n_rows, n_cols``."""
    if masks:
        images = segmentation_mask(images)
    made = settled(images, {"_s": X.pixel_statistics(F.col("data"), F.col("modality")), "_e": X.border_excess(F.col("data"), F.col("n_rows"), F.col("n_cols"))})
    reasons = X.quality_reasons(F.col("_s"), F.col("_e"), F.col("modality"), F.col("masked") if masks else None, overrides)
    judged = F.when(F.col("data").isNull(), F.array(F.lit("no_pixel_data"))).otherwise(reasons)
    return settled(made, {"reasons": judged}).withColumn("low", F.size("reasons") > 0).drop("_s", "_e")


def series_quality(judged: DataFrame, key: str, limit: float = 0.3) -> DataFrame:
    """Share of low images of each series, and whether it is over the limit."""
    share = F.avg(F.col("low").cast("double"))
    return judged.groupBy(key).agg(F.count(F.lit(1)).alias("images"), share.alias("ratio")).withColumn("low", F.col("ratio") > limit)


def reason_summary(judged: DataFrame, key: str, order: str = "image_id", top: int = 3) -> DataFrame:
    """``40% files with issues - Low contrast:4, ...``: the most frequent reasons of each series; of equals the one that appears first, images taken by ``order``."""
    # one pass: every reason of an image is a row, the first one (or none) counts the image
    each = judged.select(key, "low", F.col(order).alias("_order"), F.posexplode_outer("reasons").alias("at", "reason"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    counts = each.groupBy(key, "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("images"), F.count_if(first & F.col("low")).alias("lows"), F.min(F.struct("_order", "at")).alias("seen"))
    table = F.create_map(*[F.lit(x) for pair in X.REASONS.items() for x in pair])
    text = lambda e: F.concat(F.coalesce(F.try_element_at(table, e["reason"]), e["reason"]), F.lit(":"), (-e["m"]).cast("string"))
    shown = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct((-F.col("n")).alias("m"), "seen", "reason"))))
    made = counts.groupBy(key).agg(shown.alias("_shown"), (F.sum("lows") / F.sum("images")).alias("_share"))
    told = F.concat(F.format_string("%.0f", F.bround(F.col("_share") * 100, 0)), F.lit("% files with issues - "), F.array_join(F.transform(F.slice("_shown", 1, top), text), ", "))
    return made.select(key, F.when(F.size("_shown") > 0, told).otherwise("Normal").alias("summary"))
