"""Images made from the tables' rows: files, hashes, and assets found in pages."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions import scores
from ..functions.images import image_hashes, resized
from ..functions.matching import feature_place, template_place
from ..operators.joins import sized
from ..sources.pictures import decoded, list_images, optimised_png, png, write_files
from ..streaming.base import shared_folder
from .base import Registry, Tables

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
c = F.col

#: Assets of the page queries, width and height of assets and pages, and the sizes at which an asset stands in a page.
ASSETS, ASSET_W, ASSET_H, PAGE_W, PAGE_H = 20, 80, 64, 200, 150
SIZES = ((40, 32), (60, 48), (81, 65))
BIG_W, BIG_H, WIDE, TALL = 160, 120, 320, 240
#: Images drawn together.
STACK = 64


def texture(seed: int, h: int, w: int, cell: int) -> np.ndarray:
    """Cells of random grey with soft edges."""
    return textures([seed], h, w, cell)[0]


def textures(seeds: list[int], h: int, w: int, cell: int) -> np.ndarray:
    """A stack of textures."""
    x = np.stack([np.random.Generator(np.random.PCG64(s)).integers(0, 256, (h // cell + 2, w // cell + 2)) for s in seeds]).astype(np.uint16)
    x = x.repeat(cell, 1)[:, : h + 2].repeat(cell, 2)[:, :, : w + 2]
    x = x[:, :h] + x[:, 1 : h + 1] + x[:, 2:]
    return ((x[..., :w] + x[..., 1 : w + 1] + x[..., 2:]) // 9).astype(np.uint8)


def drawn(h: int, w: int, cell: int, salt: int):
    """A column of images by a number each row has."""

    @F.pandas_udf("binary")
    def run(seed: pd.Series) -> pd.Series:
        seeds = [int(s) * 1000 + salt for s in seed]
        return pd.Series([x.tobytes() for i in range(0, len(seeds), STACK) for x in textures(seeds[i : i + STACK], h, w, cell)], dtype=object)

    return run


@functools.lru_cache(maxsize=128)
def _asset(number: int, h: int, w: int, cell: int, to_h: int, to_w: int) -> np.ndarray:
    return resized(texture(number * 1000 + 2, h, w, cell), to_h, to_w).astype(np.uint8)


def page_batches(batches: Iterator[pa.RecordBatch], h: int, w: int, cell: int, asset_h: int, asset_w: int, asset_cell: int) -> Iterator[pa.RecordBatch]:
    """Rows with an image of the page each, a few at a time: Spark's batches of rows would be ten thousand pages."""
    for b in (whole.slice(i, STACK) for whole in batches for i in range(0, whole.num_rows, STACK)):
        pages = []
        for s, a, left, top, aw, ah in zip(*(b.column(k).to_pylist() for k in ("page_id", "asset", "x", "y", "width", "height"))):
            page = texture(s * 1000 + 1, h, w, cell)
            if aw:
                page[top : top + ah, left : left + aw] = _asset(a, asset_h, asset_w, asset_cell, ah, aw)
            pages.append(page.tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pages, pa.binary())], names=[*b.schema.names, "page_px"])


def with_pages(rows: DataFrame, *sizes: int) -> DataFrame:
    """Rows (page_id, asset, x, y, width, height) with an image of the page, page_px; the asset is at its place and size where its width isn't 0."""
    return rows.mapInArrow(lambda batches: page_batches(batches, *sizes), StructType([*rows.schema.fields, StructField("page_px", BinaryType())]))


def dealt(t: Tables, rows: DataFrame, key: str, a_core: int = 0) -> DataFrame:
    """Rows before images are made of them, dealt out by key, to so many tasks a core at least: what is a file of few bytes would be one task of long work."""
    return rows.repartition(max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), a_core * t.spark.sparkContext.defaultParallelism), key)


def _pairs(t: Tables, pages: DataFrame, h: int, w: int, cell: int) -> DataFrame:
    """Each page with the asset that may stand in it and with another one, the assets' images joined by number; a page's pairs stay together."""
    assets = t.part.select(c("p_partkey").alias("asset")).filter(f"asset <= {ASSETS}").withColumn("asset_px", drawn(h, w, cell, 2)(c("asset")))
    both = pages.withColumn("asset", F.explode(F.array("asset", (c("asset") + 6) % ASSETS + 1)))
    return both.join(sized(assets, ASSETS), "asset")


_PLACED = f"""p AS (SELECT page_id, page_id % {ASSETS} + 1 AS own, page_id % 4 <> 0 AS planted, page_id * 7 % 110 AS x, page_id * 11 % 80 AS y,
    {[a for a, _ in SIZES]}[page_id % 3 + 1] AS w, {[b for _, b in SIZES]}[page_id % 3 + 1] AS h FROM pages), q AS (SELECT *, unnest([own, (own + 6) % {ASSETS} + 1]) AS asset FROM p)"""


@R.add(
    "h25_template_match",
    f"""WITH {_PLACED}, r AS (SELECT *, planted AND asset = own AS found FROM q)
    SELECT page_id, asset, found, CASE WHEN found THEN x ELSE -1 END AS x, CASE WHEN found THEN y ELSE -1 END AS y, CASE WHEN found THEN w ELSE 0 END AS width, CASE WHEN found THEN h ELSE 0 END AS height FROM r""",
)
def template_pairs(t: Tables) -> DataFrame:
    """Pages against assets over 50 scales; the SQL knows where an asset was put."""
    at = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in SIZES]), (c("page_id") % 3 + 1).cast("int"))
    put = c("page_id") % 4 != 0
    x, y = c("page_id") * 7 % 110, c("page_id") * 11 % 80
    p = t.pages.select("page_id", (c("page_id") % ASSETS + 1).alias("asset"), x.alias("x"), y.alias("y"), F.when(put, at(0)).otherwise(0).alias("width"), at(1).alias("height"))
    p = with_pages(dealt(t, p, "page_id"), PAGE_H, PAGE_W, 6, ASSET_H, ASSET_W, 8)
    m = _pairs(t, p, ASSET_H, ASSET_W, 8).select("page_id", "asset", template_place("page_px", F.lit(PAGE_W), "asset_px", F.lit(ASSET_W)).alias("m"))
    or_ = lambda k, v: F.coalesce(c(f"m.{k}"), F.lit(v)).alias(k)
    return m.select("page_id", "asset", c("m.x").isNotNull().alias("found"), or_("x", -1), or_("y", -1), or_("width", 0), or_("height", 0))


@R.add(
    "h26_feature_match",
    f"""WITH {_PLACED} SELECT page_id, asset, planted AND asset = own AS found, planted AND asset = own AS near FROM q""",
)
def feature_pairs(t: Tables) -> DataFrame:
    """Pages against assets by features and a homography; the SQL knows where an asset was put, and near is a box within 5 pixels of that."""
    put = c("page_id") % 4 != 0
    x, y = (c("page_id") * 7 % 110).cast("int"), (c("page_id") * 11 % 80).cast("int")
    p = t.pages.select("page_id", (c("page_id") % ASSETS + 1).alias("asset"), x.alias("x"), y.alias("y"), F.when(put, BIG_W).otherwise(0).alias("width"), F.lit(BIG_H).alias("height"))
    p = with_pages(dealt(t, p, "page_id", 4), TALL, WIDE, 7, BIG_H, BIG_W, 9)
    m = _pairs(t, p, BIG_H, BIG_W, 9).select("page_id", "asset", "x", "y", feature_place("page_px", F.lit(WIDE), "asset_px", F.lit(BIG_W)).alias("m"))
    off = F.greatest(F.abs(c("m.x") - c("x")), F.abs(c("m.y") - c("y")), F.abs(c("m.width") - BIG_W), F.abs(c("m.height") - BIG_H))
    return m.select("page_id", "asset", c("m.x").isNotNull().alias("found"), F.coalesce(off <= 5, F.lit(False)).alias("near"))


@R.add("h21_image_hashes", "SELECT s_suppkey, 'exact' AS duller, true AS other_differs FROM supplier")
def hashed(t: Tables) -> DataFrame:
    """Hashes of an image, of a duller copy of it and of another image; classes by the mean distance."""

    @F.pandas_udf("binary")
    def duller(px: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(p, np.uint8) * 0.9 + 10).astype(np.uint8).tobytes() for p in px], dtype=object)

    draw = drawn(ASSET_H, ASSET_W, 8, 3)
    px = dealt(t, t.supplier.select("s_suppkey"), "s_suppkey").select("s_suppkey", draw("s_suppkey").alias("own"), draw(c("s_suppkey") + 100_000_000).alias("other"))
    h = px.select("s_suppkey", *[image_hashes(x, F.lit(ASSET_W)).alias(k) for k, x in (("a", c("own")), ("b", duller("own")), ("o", c("other")))])
    names = ("phash", "dhash", "whash", "average_hash")
    far = lambda k: sum((F.bit_count(c(f"a.{n}").bitwiseXOR(c(f"{k}.{n}"))) for n in names), F.lit(0)) / 4
    return h.select("s_suppkey", scores.hash_class(far("b")).alias("duller"), (scores.hash_class(far("o")) != "exact").alias("other_differs"))


#: Files of so many bytes at most are listed.
FILE_BYTES = 6000


@R.add(
    "a18_image_files",
    f"""WITH f AS (SELECT s_suppkey, s_suppkey || '.' || ['png','PNG','txt','jpg','png','webp','png'][s_suppkey % 7 + 1] AS name, s_suppkey % 7 AS k FROM supplier)
    SELECT name, CASE WHEN k = 2 THEN 'extension' WHEN k = 4 THEN 'size' WHEN k IN (3, 5) THEN 'not a PNG' WHEN k = 6 THEN 'damaged chunk' ELSE 'image' END AS state, CASE WHEN k IN (0, 1) THEN {ASSET_W} ELSE 0 END AS width, CASE WHEN k IN (0, 1) THEN {ASSET_H} ELSE 0 END AS height, k IN (0, 1) AS optimised FROM f""",
)
def image_files(t: Tables) -> DataFrame:
    """Image files are written, listed by extension and size, decoded and optimised; what is too large, broken or no image is reported."""

    @F.pandas_udf("binary")
    def content(seed: pd.Series) -> pd.Series:
        out = []
        for s in seed:
            image, k = png(texture(int(s), ASSET_H, ASSET_W, 8)), s % 7
            out.append(b"GIF or other" if k in (3, 5) else image + bytes(FILE_BYTES) if k == 4 else image[:60] + b"\0" + image[61:-30] + b"xx" + image[-28:] if k == 6 else image)
        return pd.Series(out, dtype=object)

    kinds = F.array(*[F.lit(x) for x in ("png", "PNG", "txt", "jpg", "png", "webp", "png")])
    name = F.concat_ws(".", c("s_suppkey").cast("string"), F.element_at(kinds, (c("s_suppkey") % 7 + 1).cast("int")))
    folder = f"{shared_folder(t.spark)}/images-{uuid.uuid4().hex}"
    write_files(dealt(t, t.supplier.select("s_suppkey"), "s_suppkey").select(name.alias("name"), content("s_suppkey").alias("content")), folder)
    kept, left = list_images(t.spark, folder, FILE_BYTES)
    file = F.element_at(F.split("path", "/"), -1).alias("name")
    zero = lambda k: F.coalesce(c(f"d.{k}"), F.lit(0)).alias(k)
    images = kept.select(file, decoded("content").alias("d"), optimised_png("content").alias("o"))
    images = images.select("name", F.coalesce("d.error", F.lit("image")).alias("state"), zero("width"), zero("height"), c("o").isNotNull().alias("optimised"))
    return images.unionByName(left.select(file, c("reason").alias("state"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(False).alias("optimised")))
