"""Queries over the driver's tables, by name, and their SQL.

Rows of `embeddings` stand in for frames: 64 values are an 8 x 8 frame, the label its group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringlake.functions import geometry, naming
from ringlake.operators import background as bg
from ringlake.operators import blocks as bl
from ringlake.operators import centroid, grouping, lookups, moments, morphology, outliers, radial, summary
from ringlake.operators.frames import normalise, of_frame, shift, subtract, to_frames, to_pixels
from ringlake.operators.fitting import NAMES, centred_frames, gaussian_centres
from ringlake.operators.masking import apply_masks
from ringlake.plans.pipeline import Settings, process_blocks, process_frames, process_pixels, screening_image, split_failures
from ringlake.plans.run import merged_frames, run_configured, run_groups
from ringlake.sources.files import write_files
from ringlake.sources.formats import frame_source
from ringlake.sources.masks import mask_pixels, read_masks, write_images
from ringlake.sources.results import RunConfig, load_configs, load_results, parse_configs, save_configs, save_failures, save_report, save_results, save_results_csv
from ringlake.sources.scratch import new_folder
from ringlake.sources.tiff import encode, encode_pages, read_frames, write_frames
from ringlake.streaming.statistics import latest_state, merge_batches

SIDE = 8
RING = (1, 3)
GUESS = (3.3, 4.6)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Common parts of the SQL: frames, their pixels, distances from the mask centre (4, 4).
FRAMES_SQL = """frames AS (
  SELECT vec_id AS frame_id, label, embedding,
    ('120.' || lpad((label * 250)::VARCHAR, 5, '0')) AS xps_text,
    'Cam-' || lpad(vec_id::VARCHAR, 6, '0') || '_xps120.' || lpad((label * 250)::VARCHAR, 5, '0') || '_scan' || (vec_id % 3)::VARCHAR || '_labtime12-00-00p0' AS filename
  FROM embeddings)"""
PX_SQL = f"""WITH {FRAMES_SQL},
px AS (
  SELECT frame_id, xps_text::DOUBLE AS xps_value, (p // 8)::INT AS r, (p % 8)::INT AS c, v
  FROM (SELECT frame_id, xps_text, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM frames)),
grid AS (
  SELECT DISTINCT r, c, sqrt((c - 4.0)::DOUBLE * (c - 4.0) + (r - 4.0)::DOUBLE * (r - 4.0)) AS d FROM (SELECT unnest(range(8))::INT AS r), (SELECT unnest(range(8))::INT AS c))"""


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if it has one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    """Rounded for comparison with another engine; no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, filename, xps_value, height, width, pixels; the scan position is read from the file name."""
    token = F.concat(F.lit("120."), F.lpad((F.col("label") * 250).cast("string"), 5, "0"))
    name = F.concat(F.lit("Cam-"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit("_xps"), token, F.lit("_scan"), (F.col("vec_id") % 3).cast("string"), F.lit("_labtime12-00-00p0"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), name.alias("filename"), F.col("embedding").cast("array<double>").alias("pixels"))
    return rows.select("frame_id", "filename", naming.scan_value(F.col("filename")).alias("xps_value"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), "pixels")


def raised(f: DataFrame) -> DataFrame:
    """Frames with 1 added to each pixel: positive weights."""
    return f.withColumn("pixels", F.transform("pixels", lambda v: v + 1))


def pixels(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    return to_pixels(frames(spark, sf_dir), deal)


def met(spark: SparkSession, sf_dir: str, lookup: DataFrame) -> DataFrame:
    """The pixels that a lookup (r, c, ...), one frame in size, has, with its columns."""
    return pixels(spark, sf_dir, deal=False).join(F.broadcast(lookup), ["r", "c"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select(F.concat(F.lit("/data/run/"), "filename", F.lit(".tiff")).alias("path"))


# names and scalar columns


@query("p1_extract_scan_value", f"WITH {FRAMES_SQL} SELECT frame_id, xps_text::DOUBLE AS xps_value, CASE WHEN frame_id % 5 = 0 THEN NULL ELSE xps_text::DOUBLE END AS damaged FROM frames")
def p1(spark, sf_dir):
    broken = F.when(F.col("frame_id") % 5 == 0, F.regexp_replace("filename", r"_scan", "-scan")).otherwise(F.col("filename"))
    return frames(spark, sf_dir).select("frame_id", "xps_value", naming.scan_value(broken).alias("damaged"))


@query("p2_suffix_pattern", f"WITH {FRAMES_SQL} SELECT regexp_extract(filename, '_xps[0-9.]+_(.*)', 1) AS suffix, count(*) AS n FROM frames GROUP BY 1")
def p2(spark, sf_dir):
    return grouping.listed(frames(spark, sf_dir).select(F.col("filename").alias("path"))).groupBy("suffix").agg(F.count("*").alias("n"))


@query("p3_path_parts", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent FROM pages")
def p3(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", naming.base_name(F.col("url")).alias("name"), naming.parent(F.col("url")).alias("parent"))


@query("p4_subtract_background", f"{PX_SQL}, m AS (SELECT r, c, avg(v) AS bg FROM px GROUP BY r, c) SELECT frame_id, r, c, round(v - bg, 6) + 0.0 AS v FROM px JOIN m USING (r, c)")
def p4(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return subtract(p, bg.mean_background(p)).select("frame_id", "r", "c", r6("v").alias("v"))


@query("p8_distance_grid", f"{PX_SQL} SELECT frame_id, round(sum(v * d), 6) + 0.0 AS weighted, round(max(d), 6) AS farthest FROM px JOIN grid USING (r, c) GROUP BY frame_id")
def p8(spark, sf_dir):
    x, y = geometry.mask_centre(SIDE, SIDE)
    grid = lookups.grid(spark, SIDE, SIDE).select("r", "c", geometry.distance(F.col("r"), F.col("c"), x, y).alias("d"))
    return met(spark, sf_dir, grid).groupBy("frame_id").agg(r6(F.sum(F.col("v") * F.col("d"))).alias("weighted"), r6(F.max("d")).alias("farthest"))


@query("p9_minmax_normalize", f"{PX_SQL} SELECT frame_id, r, c, round(coalesce((v - lo) / nullif(hi - lo, 0), 0), 6) AS v FROM (SELECT *, min(v) OVER (PARTITION BY frame_id) AS lo, max(v) OVER (PARTITION BY frame_id) AS hi FROM px)")
def p9(spark, sf_dir):
    return normalise(pixels(spark, sf_dir)).select("frame_id", "r", "c", r6("v").alias("v"))


@query("p9_clamped_normalize", f"{PX_SQL} SELECT frame_id, r, c, round((least(greatest(v, -0.1), 0.2) + 0.1) / 0.3::DOUBLE, 6) + 0.0 AS v FROM px")
def p9_clamped(spark, sf_dir):
    return normalise(pixels(spark, sf_dir), -0.1, 0.2).select("frame_id", "r", "c", r6("v").alias("v"))


@query("p10_fill_missing", f"{PX_SQL}, m AS (SELECT r, c, CASE WHEN r = c THEN NULL ELSE avg(v) END AS bg FROM px GROUP BY r, c) SELECT r, c, round(coalesce(bg, (SELECT avg(bg) FROM m)), 6) + 0.0 AS bg FROM m")
def p10(spark, sf_dir):
    m = bg.mean_background(pixels(spark, sf_dir)).withColumn("bg", F.when(F.col("r") != F.col("c"), F.col("bg")))
    return bg.fill_missing(m).select("r", "c", r6("bg").alias("bg"))


@query("p11_gaussian_model", f"{PX_SQL}, model AS (SELECT r, c, 5.0::DOUBLE * exp(-((c - 3.5) * (c - 3.5) + (r - 4.25) * (r - 4.25))::DOUBLE / (2 * 2.5::DOUBLE * 2.5::DOUBLE)) + 0.75 AS m FROM grid) SELECT frame_id, round(sum(v * m), 6) + 0.0 AS product, round(sum((v - m) * (v - m)), 6) AS residual FROM px JOIN model USING (r, c) GROUP BY frame_id")
def p11(spark, sf_dir):
    d = geometry.distance(F.col("r"), F.col("c"), 3.5, 4.25)
    model = lookups.grid(spark, SIDE, SIDE).select("r", "c", geometry.circular_gaussian(d * d, 5.0, 2.5, 0.75).alias("m"))
    rest = F.col("v") - F.col("m")
    return met(spark, sf_dir, model).groupBy("frame_id").agg(r6(F.sum(F.col("v") * F.col("m"))).alias("product"), r6(F.sum(rest * rest)).alias("residual"))


@query("p12_integer_shift", f"{PX_SQL} SELECT frame_id, (r + 1)::INT AS r, (c - 2)::INT AS c, round(v, 6) + 0.0 AS v FROM px WHERE r + 1 BETWEEN 0 AND 7 AND c - 2 BETWEEN 0 AND 7")
def p12(spark, sf_dir):
    return shift(pixels(spark, sf_dir), 2, -1, SIDE, SIDE).select("frame_id", "r", "c", r6("v").alias("v"))


@query("p14_format_names", f"WITH {FRAMES_SQL} SELECT DISTINCT xps_text::DOUBLE AS xps_value, printf('xps_%.5f', xps_text::DOUBLE) AS folder, printf('radial_bin_%03d', label) AS bin_name FROM frames")
def p14(spark, sf_dir):
    f = frames(spark, sf_dir).select("xps_value", naming.group_name(F.col("xps_value")).alias("folder"), F.format_string("radial_bin_%03d", F.rint((F.col("xps_value") - 120) * 1000 / 2.5).cast("int")).alias("bin_name"))
    return f.distinct()


@query("p15_pixel_coordinates", f"{PX_SQL} SELECT frame_id, r, c, round(v, 6) + 0.0 AS v FROM px")
def p15(spark, sf_dir):
    return pixels(spark, sf_dir).select("frame_id", "r", "c", r6("v").alias("v"))


@query("p16_half_even_round", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2.0, 0)::INT AS n FROM lineitem")
def p16(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.half_even(F.col("l_quantity") / 2.0).alias("n"))


@query("s5_parse_config", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def s5(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("s5_typed_config", "SELECT vec_id, label::DOUBLE AS sigma FROM embeddings")
def s5_typed(spark, sf_dir):
    text = F.concat(F.lit('{"result_directory": "/out", "xray_removal_param": ['), F.col("label").cast("string"), F.lit(", 0.7]}"))
    return parse_configs(table(spark, sf_dir, "embeddings").select("vec_id", text.alias("j")), "j").select("vec_id", F.col("config.xray_removal_param")[0].alias("sigma"))


# lookups and masks


@query("s3a_corner_mask", f"{PX_SQL}, k AS (SELECT *, (r < 2 OR r >= 6) AND (c < 2 OR c >= 6) AS corner FROM px) SELECT frame_id, count(*) FILTER (corner) AS n_corner, round(sum(v) FILTER (corner), 6) + 0.0 AS corner_sum, round(sum(v), 6) + 0.0 AS kept_sum FROM k GROUP BY frame_id")
def s3a(spark, sf_dir):
    corner, kept = (F.when(F.col(x) == n, F.col("v")) for x, n in (("bkg", 0), ("keep", 1)))
    known = met(spark, sf_dir, lookups.corner_masks(spark, SIDE, SIDE, 2))
    return known.groupBy("frame_id").agg(F.count(corner).alias("n_corner"), r6(F.sum(corner)).alias("corner_sum"), r6(F.sum(kept)).alias("kept_sum"))


@query("s6_threshold_mask", f"{PX_SQL} SELECT frame_id, r, c, CASE WHEN v * 255 + 128 >= 128 THEN 1 ELSE 0 END AS mask FROM px")
def s6(spark, sf_dir):
    return lookups.threshold_mask(pixels(spark, sf_dir).withColumn("v", F.col("v") * 255 + 128))


@query("f6_ring_lookup", f"{PX_SQL} SELECT frame_id, count(*) AS n, round(sum(v), 6) + 0.0 AS total, round(sum(v * d), 6) + 0.0 AS weighted FROM px JOIN grid USING (r, c) WHERE d BETWEEN 1 AND 3 GROUP BY frame_id")
def f6(spark, sf_dir):
    ring = met(spark, sf_dir, lookups.ring(spark, SIDE, SIDE, *RING))
    return ring.groupBy("frame_id").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"), r6(F.sum(F.col("v") * F.col("d"))).alias("weighted"))


@query("f7_radial_lookup", f"{PX_SQL} SELECT frame_id, floor(d / 0.5)::INT AS bin, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM px JOIN grid USING (r, c) WHERE d < 4 GROUP BY ALL")
def f7(spark, sf_dir):
    return met(spark, sf_dir, lookups.radial(spark, SIDE, SIDE, 4, 8)).groupBy("frame_id", "bin").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


@query("f8_bin_counts", f"{PX_SQL}, n AS (SELECT floor(d / 0.5)::INT AS bin, count(*) AS n_pixels, sum(r * 8 + c)::BIGINT AS index_sum FROM grid WHERE d < 4 GROUP BY 1), t AS (SELECT frame_id, floor(d / 0.5)::INT AS bin, sum(v) AS total FROM px JOIN grid USING (r, c) WHERE d < 4 GROUP BY ALL) SELECT frame_id, bin, n_pixels, index_sum, round(total / n_pixels, 6) + 0.0 AS mean FROM t JOIN n USING (bin)")
def f8(spark, sf_dir):
    """Each frame's bins as means over the pixels that the lookup counts for them."""
    index = F.aggregate("pixel_index", F.lit(0).cast("long"), lambda a, x: a + x)
    counts = lookups.bin_counts(spark, SIDE, SIDE, 4, 8).select("bin", "n_pixels", index.alias("index_sum"))
    sums = met(spark, sf_dir, lookups.radial(spark, SIDE, SIDE, 4, 8)).groupBy("frame_id", "bin").agg(F.sum("v").alias("total"))
    return sums.join(F.broadcast(counts), "bin").select("frame_id", "bin", "n_pixels", "index_sum", r6(F.col("total") / F.col("n_pixels")).alias("mean"))


@query("u2_mask_union", f"{PX_SQL}, a AS (SELECT r, c, (d < 2)::INT AS a, (r < 4)::INT AS b FROM grid) SELECT frame_id, round(sum(v * greatest(a, b)), 6) + 0.0 AS either, round(sum(v * least(a, b)), 6) + 0.0 AS both FROM px JOIN a USING (r, c) GROUP BY frame_id")
def u2(spark, sf_dir):
    g = lookups.grid(spark, SIDE, SIDE)
    x, y = geometry.mask_centre(SIDE, SIDE)
    near = g.withColumn("keep", (geometry.distance(F.col("r"), F.col("c"), x, y) < 2).cast("int"))
    masks = lookups.combine(near, g.withColumn("keep", (F.col("r") < 4).cast("int")))
    return met(spark, sf_dir, masks).groupBy("frame_id").agg(*[r6(F.sum(F.col("v") * F.col(c))).alias(c) for c in ("either", "both")])


@query("f5_drift_mask", f"{PX_SQL}, k AS (SELECT *, (r < 2 OR r >= 6) AND (c < 2 OR c >= 6) AS corner FROM px) SELECT frame_id, r, c, CASE WHEN (r + c) % 3 <> 0 THEN round(v - avg(CASE WHEN corner THEN v END) OVER (PARTITION BY frame_id), 6) + 0.0 END AS v FROM k")
def f5(spark, sf_dir):
    masks = lookups.corner_masks(spark, SIDE, SIDE, 2).withColumn("keep", ((F.col("r") + F.col("c")) % 3 != 0).cast("int"))
    return apply_masks(pixels(spark, sf_dir), masks).select("frame_id", "r", "c", r6("v").alias("v"))


# outliers

CHUNKED_SQL = """,
ch AS (SELECT *, r // 4 AS a, c // 4 AS b FROM px),
m1 AS (SELECT *, median(v) OVER w AS med FROM ch WINDOW w AS (PARTITION BY frame_id, a, b)),
m2 AS (SELECT *, median(abs(v - med)) OVER w AS mad FROM m1 WINDOW w AS (PARTITION BY frame_id, a, b)),
m3 AS (SELECT *, max((v > med + 3 * mad)::INT) OVER (PARTITION BY frame_id, a, b) = 1 AND med <= 0.05 AS hit FROM m2),
cleaned AS (SELECT frame_id, r, c, CASE WHEN hit AND v > med + 0.75 * 3 * mad THEN NULL ELSE v END AS v FROM m3)"""


@query("f1_mad_chunk_filter", f"{PX_SQL}{CHUNKED_SQL} SELECT frame_id, r, c, round(v, 6) + 0.0 AS v FROM cleaned")
def f1(spark, sf_dir):
    return outliers.mad_chunk_filter(pixels(spark, sf_dir), 4, 3, 0.05).select("frame_id", "r", "c", r6("v").alias("v"))


@query("a2_filtered_background", f"{PX_SQL}{CHUNKED_SQL}, m AS (SELECT r, c, avg(v) AS bg FROM cleaned GROUP BY r, c) SELECT r, c, round(coalesce(bg, (SELECT avg(bg) FROM m)), 6) + 0.0 AS bg FROM m")
def a2(spark, sf_dir):
    return bg.filtered_background(pixels(spark, sf_dir), 4, 3, 0.05).select("r", "c", r6("bg").alias("bg"))


CLIPPED_SQL = """,
clipped AS (SELECT frame_id, r, c, v, avg(v) OVER w <= 0.08 AND v > avg(v) OVER w + 2 * stddev_pop(v) OVER w AS removed
  FROM px WINDOW w AS (PARTITION BY frame_id, r // 4, c // 4))"""


def clipped(spark, sf_dir):
    return outliers.sigma_chunk_filter(pixels(spark, sf_dir), 4, 2, 0.08)


@query("f3_sigma_clip", f"{PX_SQL}{CLIPPED_SQL} SELECT frame_id, r, c, removed FROM clipped")
def f3(spark, sf_dir):
    return clipped(spark, sf_dir).select("frame_id", "r", "c", "removed")


@query("m3_removal_summary", f"{PX_SQL}{CLIPPED_SQL} SELECT frame_id, count(*) AS n_pixels, count(*) FILTER (removed) AS n_removed, round(100.0 * count(*) FILTER (removed) / count(*), 6) AS rate, min(r) FILTER (removed) AS first_r, max(r) FILTER (removed) AS last_r, min(c) FILTER (removed) AS first_c, max(c) FILTER (removed) AS last_c FROM clipped GROUP BY frame_id")
def m3(spark, sf_dir):
    return morphology.removal_summary(clipped(spark, sf_dir)).withColumn("rate", r6("rate"))


@query("l5_first_removed", f"{PX_SQL}{CLIPPED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY r, c)::INT AS k FROM clipped WHERE removed) SELECT frame_id, k, r, c, round(v, 6) + 0.0 AS v FROM n WHERE k <= 2")
def l5_removed(spark, sf_dir):
    return morphology.first_removed(clipped(spark, sf_dir), 2).withColumn("v", r6("v"))


DILATED_SQL = """,
hits AS (SELECT frame_id, r, c FROM px WHERE v > 0.3),
near AS (SELECT DISTINCT frame_id, (r + dr)::INT AS r, (c + dc)::INT AS c FROM hits, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dr, dc))"""


@query("m1_dilation", f"{PX_SQL}{DILATED_SQL} SELECT px.frame_id, px.r, px.c, n.frame_id IS NOT NULL AS near FROM px LEFT JOIN near n USING (frame_id, r, c)")
def m1(spark, sf_dir):
    flagged = pixels(spark, sf_dir).withColumn("hit", F.col("v") > 0.3)
    return flagged.select("frame_id", "r", "c", morphology.dilated("hit").alias("near"))


#: Blocks of three pixels a side: every frame is nine of them, and most neighbours are in another one.
BLOCKS = bl.Layout(SIDE, SIDE, 3)


def _block_pixels(blocks, value: str) -> DataFrame:
    """(frame_id, r, c, v) of the array ``value`` of blocks."""
    whole = bl.from_blocks(blocks.select("frame_id", "xps_value", "br", "bc", F.col(value).alias("v")), BLOCKS)
    return to_pixels(whole, deal=False).select("frame_id", "r", "c", "v")


def hit_blocks(spark, sf_dir, level: float) -> DataFrame:
    return bl.to_blocks(frames(spark, sf_dir), BLOCKS).withColumn("hit", F.transform("v", lambda v: (v > level).cast("double")))


@query("m1_dilation_blocks", ORACLE["m1_dilation"])
def m1_blocks(spark, sf_dir):
    near = bl.dilated_blocks(hit_blocks(spark, sf_dir, 0.3), BLOCKS)
    return _block_pixels(near, "near").select("frame_id", "r", "c", (F.col("v") == 1).alias("near"))


STATS_SQL = """,
med AS (SELECT xps_value, r, c, median(v) AS med FROM px GROUP BY ALL),
st AS (SELECT xps_value, r, c, med, median(abs(v - med)) AS mad FROM px JOIN med USING (xps_value, r, c) GROUP BY ALL)"""


@query("a3_median_mad", f"{PX_SQL}{STATS_SQL} SELECT xps_value, r, c, round(med, 6) + 0.0 AS med, round(mad, 6) AS mad FROM st")
def a3(spark, sf_dir):
    return bg.pixel_statistics(pixels(spark, sf_dir, deal=False)).select("xps_value", "r", "c", r6("med").alias("med"), r6("mad").alias("mad"))


@query("f9_center_box", f"{PX_SQL}{STATS_SQL} SELECT xps_value, r, c, CASE WHEN NOT (r >= 3 AND r < 7 AND c >= 1 AND c < 5) THEN round(med, 6) + 0.0 END AS med FROM st")
def f9(spark, sf_dir):
    boxed = bg.centre_box(bg.pixel_statistics(pixels(spark, sf_dir)), 3.3, 4.6, 4)
    return boxed.select("xps_value", "r", "c", r6("med").alias("med"))


HYSTERESIS_SQL = f"""{STATS_SQL},
fl AS (SELECT px.*, med, mad, v > med + 4 * mad AS hit FROM px JOIN st USING (xps_value, r, c)),
near2 AS (SELECT DISTINCT frame_id, (r + dr)::INT AS r, (c + dc)::INT AS c FROM fl, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dr, dc) WHERE hit),
hy AS (SELECT fl.frame_id, fl.xps_value, fl.r, fl.c, CASE WHEN n.frame_id IS NOT NULL AND v > med + 4 * 0.5 * mad THEN NULL ELSE v END AS v FROM fl LEFT JOIN near2 n USING (frame_id, r, c))"""


def cleaned(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return outliers.hysteresis_filter(p, bg.pixel_statistics(p), 4, 0.5)


@query("f2_hysteresis", f"{PX_SQL}{HYSTERESIS_SQL} SELECT frame_id, r, c, round(v, 6) + 0.0 AS v FROM hy")
def f2(spark, sf_dir):
    return cleaned(spark, sf_dir).select("frame_id", "r", "c", r6("v").alias("v"))


@query("f4_remove_background", f"""{PX_SQL}, m AS (SELECT r, c, avg(v) AS bg FROM px GROUP BY r, c), sub AS (SELECT frame_id, xps_value, r, c, v - bg AS v FROM px JOIN m USING (r, c)),
med AS (SELECT xps_value, r, c, median(v) AS med FROM sub GROUP BY ALL),
st AS (SELECT xps_value, r, c, med, median(abs(v - med)) AS mad FROM sub JOIN med USING (xps_value, r, c) GROUP BY ALL),
fl AS (SELECT sub.*, med, mad, v > med + 4 * mad AS hit FROM sub JOIN st USING (xps_value, r, c)),
near2 AS (SELECT DISTINCT frame_id, (r + dr)::INT AS r, (c + dc)::INT AS c FROM fl, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dr, dc) WHERE hit)
SELECT fl.frame_id, fl.r, fl.c, round(CASE WHEN n.frame_id IS NOT NULL AND v > med + 4 * 0.5 * mad THEN NULL ELSE v END, 6) + 0.0 AS v FROM fl LEFT JOIN near2 n USING (frame_id, r, c)""")
def f4(spark, sf_dir):
    p = pixels(spark, sf_dir)
    mean = bg.mean_background(p)
    stats = bg.pixel_statistics(subtract(p, mean))
    return outliers.remove_background(p, mean, stats, 4, 0.5).select("frame_id", "r", "c", r6("v").alias("v"))


@query("a4_mean_image", f"{PX_SQL}{HYSTERESIS_SQL} SELECT xps_value, r, c, CASE WHEN count(v) = count(*) THEN round(avg(v), 6) + 0.0 END AS v FROM hy GROUP BY ALL")
def a4(spark, sf_dir):
    return bg.mean_image(cleaned(spark, sf_dir)).withColumn("v", r6("v"))


@query("m2_cluster_sizes", f"""WITH RECURSIVE {PX_SQL[5:]},
h AS (SELECT frame_id, r, c, r * 8 + c AS p FROM px WHERE v > 0.15),
reach(frame_id, p, q) AS (
  SELECT frame_id, p, p FROM h
  UNION
  SELECT a.frame_id, a.p, b.p FROM reach a JOIN h x ON x.frame_id = a.frame_id AND x.p = a.q JOIN h b ON b.frame_id = a.frame_id AND abs(b.r - x.r) + abs(b.c - x.c) = 1),
roots AS (SELECT frame_id, p, min(q) AS root FROM reach GROUP BY frame_id, p),
sizes AS (SELECT frame_id, root, count(*) AS size FROM roots GROUP BY frame_id, root)
SELECT CASE WHEN size = 1 THEN '1' WHEN size <= 3 THEN '2-3' WHEN size <= 6 THEN '4-6' WHEN size <= 10 THEN '7-10' WHEN size <= 20 THEN '11-20' ELSE '>20' END AS size_class,
  count(*) AS n_clusters, min(size) AS smallest, max(size) AS largest FROM sizes GROUP BY 1""")
def m2(spark, sf_dir):
    hits = pixels(spark, sf_dir).where("v > 0.15")
    return morphology.size_histogram(morphology.cluster_sizes(morphology.clusters(hits)))


@query("m2_cluster_blocks", ORACLE["m2_cluster_sizes"])
def m2_blocks(spark, sf_dir):
    return morphology.size_histogram(morphology.cluster_sizes(bl.cluster_blocks(hit_blocks(spark, sf_dir, 0.15), BLOCKS)))


def _box_sql(weights: list[str], half: int) -> str:
    taps = ", ".join(f"({k - half}, {w}::DOUBLE)" for k, w in enumerate(weights))
    mirror = lambda x: f"CASE WHEN {x} < 0 THEN -{x} - 1 WHEN {x} > 7 THEN 15 - {x} ELSE {x} END"
    return f"""{PX_SQL}, taps(k, w) AS (VALUES {taps}),
rows_ AS (SELECT a.frame_id, a.r, a.c, sum(b.v * w) AS v FROM px a, taps JOIN px b ON b.frame_id = a.frame_id AND b.r = a.r AND b.c = {mirror('(a.c + k)')} GROUP BY ALL),
cols AS (SELECT a.frame_id, a.r, a.c, sum(b.v * w) AS v FROM rows_ a, taps JOIN rows_ b ON b.frame_id = a.frame_id AND b.c = a.c AND b.r = {mirror('(a.r + k)')} GROUP BY ALL)
SELECT frame_id, r, c, round(v, 6) + 0.0 AS v FROM cols"""


@query("m5_box_mean", _box_sql(["1 / 3.0::DOUBLE"] * 3, 1).replace("(1 / 3.0::DOUBLE)::DOUBLE", "1 / 3.0::DOUBLE"))
def m5(spark, sf_dir):
    return to_pixels(morphology.box_mean(frames(spark, sf_dir), 3)).select("frame_id", "r", "c", r6("v").alias("v"))


@query("m5_box_blocks", ORACLE["m5_box_mean"])
def m5_blocks(spark, sf_dir):
    return _block_pixels(bl.box_blocks(bl.to_blocks(frames(spark, sf_dir), BLOCKS), BLOCKS, 3), "v").withColumn("v", r6("v"))


def _gauss(sigma: float) -> list[str]:
    from math import exp

    half = int(4 * sigma + 0.5)
    k = [exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    return [f"{x / sum(k):.17e}" for x in k]


@query("m4_gaussian_blur", _box_sql(_gauss(0.75), 3))
def m4(spark, sf_dir):
    return to_pixels(morphology.gaussian_blur(frames(spark, sf_dir), 0.75)).select("frame_id", "r", "c", r6("v").alias("v"))


@query("m4_gaussian_blocks", ORACLE["m4_gaussian_blur"])
def m4_blocks(spark, sf_dir):
    return _block_pixels(bl.gaussian_blocks(bl.to_blocks(frames(spark, sf_dir), BLOCKS), BLOCKS, 0.75), "v").withColumn("v", r6("v"))


# backgrounds, centres, profiles


@query("a1_mean_background", f"{PX_SQL} SELECT r, c, round(avg(v), 6) + 0.0 AS bg FROM px GROUP BY r, c")
def a1(spark, sf_dir):
    return bg.mean_background(pixels(spark, sf_dir, deal=False)).withColumn("bg", r6("bg"))


@query("a1_median_background", f"{PX_SQL} SELECT r, c, round(median(v), 6) + 0.0 AS bg FROM px GROUP BY r, c")
def a1_median(spark, sf_dir):
    return bg.mean_background(pixels(spark, sf_dir, deal=False), "median").withColumn("bg", r6("bg"))


def _centroid_sql(source: str, prior: str, keep: str = "") -> str:
    """One ring centroid (ring 1..3 under the mask centre) around (gx, gy) of ``prior``; missing pixels skipped."""
    return f"""SELECT s.frame_id, s.gx, s.gy{keep}, count(v) AS n, coalesce(sum(v), 0) AS t, sum(v * c) AS tx, sum(v * r) AS ty
  FROM {prior} s LEFT JOIN {source} p ON p.frame_id = s.frame_id
    AND c - round_even(gx - 4, 0) BETWEEN 0 AND 7 AND r - round_even(gy - 4, 0) BETWEEN 0 AND 7
    AND sqrt(pow(c - round_even(gx - 4, 0) - 4, 2) + pow(r - round_even(gy - 4, 0) - 4, 2)) BETWEEN 1 AND 3
  GROUP BY ALL"""


def _moved(x: str, t: str) -> str:
    return f"CASE WHEN n = 0 THEN {x} WHEN t <= 0 THEN 4 + round_even({x} - 4, 0) ELSE {t} / t END"


@query("a5_ring_centroid", f"{PX_SQL}, g AS (SELECT vec_id AS frame_id, 3.3::DOUBLE AS gx, 4.6::DOUBLE AS gy FROM embeddings), s AS ({_centroid_sql('px', 'g')}) SELECT frame_id, round({_moved('gx', 'tx')}, 4) + 0.0 AS center_x, round({_moved('gy', 'ty')}, 4) + 0.0 AS center_y, round(t, 6) + 0.0 AS total_count FROM s")
def a5(spark, sf_dir):
    out = centroid.ring_centroid(pixels(spark, sf_dir), GUESS, SIDE, SIDE, *RING)
    return out.select("frame_id", (F.round("center_x", 4) + 0.0).alias("center_x"), (F.round("center_y", 4) + 0.0).alias("center_y"), r6("total_count").alias("total_count"))


@query("a6_exact_centroid", f"""{PX_SQL}, near AS (SELECT frame_id, v + 1 AS v, r, c FROM px WHERE sqrt((c - 3.3::DOUBLE) * (c - 3.3::DOUBLE) + (r - 4.6::DOUBLE) * (r - 4.6::DOUBLE)) BETWEEN 1 AND 3)
SELECT frame_id, round(CASE WHEN sum(v) > 0 THEN sum(v * c) / sum(v) ELSE 3.3 END, 6) AS center_x, round(CASE WHEN sum(v) > 0 THEN sum(v * r) / sum(v) ELSE 4.6 END, 6) AS center_y, round(sum(v), 6) AS total_count FROM near GROUP BY frame_id""")
def a6(spark, sf_dir):
    out = centroid.ring_centroid_exact(to_pixels(raised(frames(spark, sf_dir))), GUESS, *RING)
    return out.select("frame_id", *[r6(c).alias(c) for c in ("center_x", "center_y", "total_count")])


def _steps_sql(source: str, tolerance: float) -> list[str]:
    """s0 to s10, the centres after each step, and e, one more centroid around the last."""
    parts = ["s0 AS (SELECT vec_id AS frame_id, 3.3::DOUBLE AS gx, 4.6::DOUBLE AS gy, false AS done, 0 AS k FROM embeddings)"]
    for i in range(1, 11):
        parts.append(f"q{i} AS MATERIALIZED ({_centroid_sql(source, f's{i - 1}', ', s.done, s.k')})")
        parts.append(f"n{i} AS (SELECT *, {_moved('gx', 'tx')} AS nx, {_moved('gy', 'ty')} AS ny FROM q{i})")
        parts.append(f"s{i} AS MATERIALIZED (SELECT frame_id, CASE WHEN done THEN gx ELSE nx END AS gx, CASE WHEN done THEN gy ELSE ny END AS gy, done OR sqrt(pow(nx - gx, 2) + pow(ny - gy, 2)) < {tolerance} AS done, k + (NOT done)::INT AS k FROM n{i})")
    return [*parts, f"e AS ({_centroid_sql(source, 's10', ', s.k')})"]


ITERATED_SQL = ", ".join([f"{PX_SQL}, up AS MATERIALIZED (SELECT frame_id, r, c, v + 1 AS v FROM px)", *_steps_sql("up", 0.1)])


@query("i1_iterative_centroid", f"{ITERATED_SQL} SELECT frame_id, round({_moved('gx', 'tx')}, 6) AS center_x, round({_moved('gy', 'ty')}, 6) AS center_y, round(t, 6) AS total_count, (k + 1)::INT AS n_steps FROM e")
def i1(spark, sf_dir):
    out = centroid.iterative_centroid(raised(frames(spark, sf_dir)), GUESS, inner=RING[0], outer=RING[1], tolerance=0.1)
    return out.select("frame_id", *[r6(c).alias(c) for c in ("center_x", "center_y", "total_count")], "n_steps")


TRACE_SQL = " UNION ALL ".join([
    "SELECT frame_id, 0 AS step, gx AS x, gy AS y, 0.0::DOUBLE AS total FROM s0",
    *[f"SELECT frame_id, {i}, nx, ny, t FROM n{i} WHERE NOT done" for i in range(1, 11)],
    f"SELECT frame_id, (k + 1)::INT, {_moved('gx', 'tx')}, {_moved('gy', 'ty')}, t FROM e",
])


@query("i2_centroid_trace", f"{ITERATED_SQL}, steps AS ({TRACE_SQL}) SELECT frame_id, step::INT AS step, round(x, 6) AS x, round(y, 6) AS y, round(total, 6) AS total FROM steps")
def i2(spark, sf_dir):
    t = centroid.centroid_trace(raised(frames(spark, sf_dir)), GUESS, RING[0], RING[1], tolerance=0.1)
    return t.select("frame_id", F.posexplode("trace").alias("step", "at")).select("frame_id", "step", r6("at.x").alias("x"), r6("at.y").alias("y"), r6("at.total").alias("total"))


def planted(spark, sf_dir):
    """Frames that hold a planted circular Gaussian around (3.6, 4.3) plus a hundredth of their own noise."""

    def value(v, p):
        d = geometry.distance(F.floor(p / SIDE), p % SIDE, 3.6, 4.3)
        return geometry.circular_gaussian(d * d, 100.0, 2.0, 5.0) + v / 100

    return frames(spark, sf_dir).withColumn("pixels", F.transform("pixels", value))


START = (80.0, 4.0, 4.0, 1.5, 0.0)
PLANTED_SQL = f"{PX_SQL}, pl AS MATERIALIZED (SELECT frame_id, r, c, 100.0::DOUBLE * exp(-((c - 3.6::DOUBLE) * (c - 3.6::DOUBLE) + (r - 4.3::DOUBLE) * (r - 4.3::DOUBLE)) / 8) + 5 + v / 100 AS v FROM px)"


def _gauss_newton_sql(steps: int) -> str:
    """Gauss-Newton steps from the planted parameters p0 to p4: normal equations as sums over pixels, solved by elimination."""
    ctes = ["fit0 AS (SELECT vec_id AS frame_id, 100.0::DOUBLE AS p0, 3.6::DOUBLE AS p1, 4.3::DOUBLE AS p2, 2.0::DOUBLE AS p3, 5.0::DOUBLE AS p4 FROM embeddings)"]
    for i in range(steps):
        ctes.append(f"e{i} AS (SELECT frame_id, p0, p1, p2, p3, p4, v, c - p1 AS dx, r - p2 AS dy, exp(-((c - p1) * (c - p1) + (r - p2) * (r - p2)) / (2 * p3 * p3)) AS e FROM fit{i} JOIN pl USING (frame_id))")
        ctes.append(f"j{i} AS (SELECT frame_id, p0, p1, p2, p3, p4, v - p0 * e - p4 AS y, e AS d0, p0 * e * dx / (p3 * p3) AS d1, p0 * e * dy / (p3 * p3) AS d2, p0 * e * (dx * dx + dy * dy) / (p3 * p3 * p3) AS d3, 1.0::DOUBLE AS d4 FROM e{i})")
        sums = ", ".join([f"sum(d{a} * d{b}) AS m{a}{b}" for a in range(5) for b in range(5)] + [f"sum(d{a} * y) AS m{a}5" for a in range(5)])
        ctes.append(f"n{i}_0 AS (SELECT frame_id, p0, p1, p2, p3, p4, {sums} FROM j{i} GROUP BY ALL)")
        for k in range(5):
            cells = ", ".join(f"m{k}{b} / m{k}{k} AS m{k}{b}" if a == k else f"m{a}{b} - m{a}{k} * m{k}{b} / m{k}{k} AS m{a}{b}" for a in range(5) for b in range(k + 1, 6))
            ctes.append(f"n{i}_{k + 1} AS (SELECT frame_id, p0, p1, p2, p3, p4, {cells} FROM n{i}_{k})")
        ctes.append(f"fit{i + 1} AS MATERIALIZED (SELECT frame_id, {', '.join(f'p{k} + m{k}5 AS p{k}' for k in range(5))} FROM n{i}_5)")
    return ", ".join(ctes)


@query("i3_gaussian_fit", f"{PLANTED_SQL}, {_gauss_newton_sql(4)}, t AS (SELECT frame_id, count(*) AS n_pixels, sum(v) AS total FROM pl GROUP BY frame_id) SELECT frame_id, true AS success, n_pixels, {', '.join(f'round(p{k}, 6) AS {n}' for k, n in enumerate(('amplitude', 'x0', 'y0', 'sigma', '\"offset\"')))}, round(total, 6) AS total_intensity FROM fit4 JOIN t USING (frame_id)")
def i3(spark, sf_dir):
    """The parameters of every frame's fit, which begins far from the planted ones; the SQL solves the same least squares from near by."""
    found = gaussian_centres(planted(spark, sf_dir), START, SIDE, SIDE, 0, 6)
    return found.select("frame_id", "success", "n_pixels", *[r6(n).alias(n) for n in (*NAMES, "total_intensity")])


@query("i4_fitted_profile", f"""{PLANTED_SQL},
b AS (SELECT frame_id, floor(d)::INT AS bin, avg(v) AS mean FROM pl JOIN grid USING (r, c) WHERE d < 4 GROUP BY ALL),
t AS (SELECT frame_id, sum(v) AS total_count FROM pl GROUP BY frame_id)
SELECT frame_id, bin, round(mean, 6) AS mean, round(total_count, 6) AS total_count FROM b JOIN t USING (frame_id)""")
def i4(spark, sf_dir):
    """A fitted centre, rounded to whole pixels as profiles do, goes with its frame into the profile."""
    centred = centred_frames(planted(spark, sf_dir), START, SIDE, SIDE, 0, 6)
    found = radial.centred_profiles(to_pixels(centred, carry=("center_x", "center_y", "total_count")), SIDE, SIDE, 4, 4)
    return found.select("frame_id", F.posexplode("radial_profile").alias("bin", "mean"), "total_count").select("frame_id", "bin", r6("mean").alias("mean"), r6("total_count").alias("total_count"))


def _fixed_centres(f: DataFrame, x: float, y: float) -> DataFrame:
    return f.select("frame_id", F.lit(x).alias("center_x"), F.lit(y).alias("center_y"))


AZIMUTHAL_SQL = f"""{PX_SQL}, b AS (SELECT frame_id, floor(d / 0.5)::INT AS bin, avg(v) AS mean
  FROM (SELECT frame_id, v, (r - 1)::INT AS r, (c + 1)::INT AS c FROM px) p JOIN grid USING (r, c) WHERE d < 4 GROUP BY ALL)
SELECT e.vec_id AS frame_id, k.bin::INT AS bin, round((k.bin * 0.5 + (k.bin + 1) * 0.5) / 2, 6) AS bin_center, round(mean, 6) + 0.0 AS mean
FROM embeddings e CROSS JOIN (SELECT unnest(range(8)) AS bin) k LEFT JOIN b ON b.frame_id = e.vec_id AND b.bin = k.bin"""


@query("a7_azimuthal_average", AZIMUTHAL_SQL)
def a7(spark, sf_dir):
    f = frames(spark, sf_dir)
    out = radial.azimuthal_average(to_pixels(f), _fixed_centres(f, 3.3, 4.6), SIDE, SIDE, 4, 8)
    return out.select("frame_id", "bin", r6("bin_center").alias("bin_center"), r6("mean").alias("mean"))


@query("a8_azimuthal_exact", f"""{PX_SQL}, b AS (SELECT frame_id, floor(sqrt((c - 3.3::DOUBLE) * (c - 3.3::DOUBLE) + (r - 4.6::DOUBLE) * (r - 4.6::DOUBLE)) / 0.25)::INT AS bin, avg(v) AS mean FROM px GROUP BY ALL)
SELECT e.vec_id AS frame_id, k.bin::INT AS bin, round(coalesce(mean, 0), 6) + 0.0 AS mean FROM embeddings e CROSS JOIN (SELECT unnest(range(12)) AS bin) k LEFT JOIN b ON b.frame_id = e.vec_id AND b.bin = k.bin""")
def a8(spark, sf_dir):
    f = frames(spark, sf_dir)
    return radial.azimuthal_average_exact(to_pixels(f), _fixed_centres(f, *GUESS), 3, 12).select("frame_id", "bin", r6("mean").alias("mean"))


def profiles(spark, sf_dir):
    f = frames(spark, sf_dir)
    p = radial.azimuthal_average(to_pixels(f), _fixed_centres(f, 4.0, 4.0), SIDE, SIDE, 4, 4)
    return f.select("frame_id", "xps_value").join(p, "frame_id")


PROFILE_SQL = f"{PX_SQL}, pr AS (SELECT frame_id, xps_value, floor(d)::INT AS bin, avg(v) AS mean FROM px JOIN grid USING (r, c) WHERE d < 4 GROUP BY ALL)"


@query("a9_profile_stats", f"{PROFILE_SQL} SELECT xps_value, bin, round(avg(mean), 6) + 0.0 AS mean, round(stddev_pop(mean), 6) AS std FROM pr GROUP BY ALL")
def a9(spark, sf_dir):
    return radial.profile_statistics(profiles(spark, sf_dir)).select("xps_value", "bin", r6("mean").alias("mean"), r6("std").alias("std"))


@query("p13_wide_profile", f"{PROFILE_SQL} SELECT frame_id, " + ", ".join(f"round(max(mean) FILTER (bin = {i}), 6) + 0.0 AS radial_bin_{i:03d}" for i in range(4)) + " FROM pr GROUP BY frame_id")
def p13(spark, sf_dir):
    arrays = radial.as_array(profiles(spark, sf_dir)).withColumn("radial_profile", F.transform("radial_profile", r6))
    return radial.wide(arrays, 4)


@query("a10_run_summary", f"""{PROFILE_SQL}, res AS (SELECT frame_id, xps_value, sum(v + 1) AS t, max(r * v) AS y FROM px GROUP BY ALL),
ex AS (SELECT frame_id, max(mean) AS hi, min(mean) AS lo FROM pr GROUP BY ALL)
SELECT xps_value, count(*) AS n_frames, round(avg(y), 6) AS mean_center_y, round(stddev_pop(y), 6) AS std_center_y, round(avg(t), 6) AS mean_total_count, round(stddev_pop(t), 6) AS std_total_count, round(max(hi), 6) AS profile_max, round(min(lo), 6) + 0.0 AS profile_min
FROM res JOIN ex USING (frame_id) GROUP BY xps_value""")
def a10(spark, sf_dir):
    counted = pixels(spark, sf_dir).groupBy("frame_id", "xps_value").agg(F.sum(F.col("v") + 1).alias("total_count"), F.max(F.col("r") * F.col("v")).alias("center_y"))
    arrays = radial.as_array(profiles(spark, sf_dir))
    s = summary.run_summary(counted.withColumn("center_x", F.lit(0.0)).join(arrays, "frame_id"))
    return s.select("xps_value", "n_frames", *[r6(c).alias(c) for c in ("mean_center_y", "std_center_y", "mean_total_count", "std_total_count", "profile_max", "profile_min")])


@query("a15_corner_stats", f"""{PX_SQL}, k AS (SELECT *, CASE WHEN r < 2 THEN 'top' WHEN r >= 6 THEN 'bottom' END || '_' || CASE WHEN c < 2 THEN 'left' WHEN c >= 6 THEN 'right' END AS corner FROM px)
SELECT frame_id, corner, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) + 0.0 AS lowest, round(max(v), 6) + 0.0 AS highest FROM k WHERE corner IS NOT NULL GROUP BY ALL""")
def a15(spark, sf_dir):
    s = summary.corner_statistics(pixels(spark, sf_dir), SIDE, SIDE, 2)
    return s.select("frame_id", "corner", *[r6(c).alias(c) for c in ("mean", "std", "lowest", "highest")])


@query("a16_slice_profile", f"{PX_SQL} SELECT frame_id, r, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std FROM px WHERE c >= 2 AND c < 6 GROUP BY ALL")
def a16(spark, sf_dir):
    s = summary.slice_profile(pixels(spark, sf_dir), 2, 6)
    return s.select("frame_id", "r", r6("mean").alias("mean"), r6("std").alias("std"))


@query("a17_reductions", f"""{PX_SQL}, k AS (SELECT frame_id, CASE WHEN v <= 0.35 THEN v END AS v FROM px)
SELECT frame_id, count(*) AS n, count(v) AS n_known, round(sum(v), 6) + 0.0 AS total, round(avg(v), 6) + 0.0 AS mean, round(median(v), 6) + 0.0 AS median, round(stddev_pop(v), 6) AS std, round(min(v), 6) + 0.0 AS lowest, round(max(v), 6) + 0.0 AS highest,
  CASE WHEN count(v) = count(*) THEN round(sum(v), 6) + 0.0 END AS strict_total, bool_or(v IS NULL) AS any_missing FROM k GROUP BY frame_id""")
def a17(spark, sf_dir):
    s = summary.reductions(pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") <= 0.35, F.col("v"))))
    return s.select("frame_id", "n", "n_known", *[r6(c).alias(c) for c in ("total", "mean", "median", "std", "lowest", "highest", "strict_total")], "any_missing")


@query("a18_ring_total", f"{PX_SQL} SELECT frame_id, round(sum(v), 6) + 0.0 AS total FROM px WHERE sqrt((c - 3.3::DOUBLE) * (c - 3.3::DOUBLE) + (r - 4.6::DOUBLE) * (r - 4.6::DOUBLE)) BETWEEN 1 AND 3 GROUP BY frame_id")
def a18(spark, sf_dir):
    near = pixels(spark, sf_dir).where(geometry.in_ring(geometry.distance(F.col("r"), F.col("c"), *GUESS), *RING))
    return near.groupBy("frame_id").agg(r6(F.sum("v")).alias("total"))


@query("f13_shape_check", "SELECT count(*) AS n, 1 AS n_shapes FROM embeddings")
def f13(spark, sf_dir):
    from ringlake.operators.frames import require_one_shape

    return require_one_shape(frames(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_distinct(F.struct("height", "width")).cast("int").alias("n_shapes"))


# groups

GROUPS_SQL = "groups AS (SELECT date_diff('day', DATE '1990-01-01', o_orderdate::DATE) / 1000.0::DOUBLE AS xps_value, count(*) AS n_files FROM orders GROUP BY 1)"


def date_groups(spark, sf_dir):
    """Orders of a day as a group: its position is the day in thousandths."""
    day = (F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")) / F.lit(1000.0)).alias("xps_value")
    return table(spark, sf_dir, "orders").groupBy(day).agg(F.count("*").alias("n_files"))


@query("a11_group_files", f"WITH {FRAMES_SQL} SELECT xps_text::DOUBLE AS xps_value, count(*) AS n_files, min('/data/run/' || filename || '.tiff') AS first_path, max('/data/run/' || filename || '.tiff') AS last_path FROM frames GROUP BY 1")
def a11(spark, sf_dir):
    ends = [F.max(F.when(F.col("place") == at, F.col("path"))).alias(name) for at, name in ((0, "first_path"), (F.col("n_files") - 1, "last_path"))]
    return grouping.group_files(files(spark, sf_dir)).groupBy("xps_value", "n_files").agg(*ends)


@query("a14_pattern_counts", f"WITH {FRAMES_SQL} SELECT xps_text::DOUBLE AS xps_value, count(*) AS n_files, count(DISTINCT vec_id_ % 3) AS n_patterns FROM (SELECT *, frame_id AS vec_id_ FROM frames) GROUP BY ROLLUP (1)")
def a14(spark, sf_dir):
    return grouping.pattern_summary(files(spark, sf_dir))


@query("f12_name_filter", f"WITH {FRAMES_SQL} SELECT count(*) AS n_kept FROM frames WHERE frame_id % 4 <> 0")
def f12(spark, sf_dir):
    names = frames(spark, sf_dir).select(F.when(F.col("frame_id") % 4 == 0, F.regexp_replace("filename", "_xps", "_noxps")).otherwise(F.col("filename")).alias("path"))
    return grouping.group_sizes(names).agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_kept"))


ISLANDS_SQL = f"WITH {GROUPS_SQL}, big AS (SELECT * FROM groups WHERE n_files > 7), isl AS (SELECT *, sum(coalesce((xps_value - prev > 0.0025)::INT, 0)) OVER (ORDER BY xps_value) AS cluster FROM (SELECT *, lag(xps_value) OVER (ORDER BY xps_value) AS prev FROM big))"


@query("w1_islands", f"{ISLANDS_SQL} SELECT xps_value, n_files, cluster::INT AS cluster FROM isl")
def w1(spark, sf_dir):
    return grouping.islands(date_groups(spark, sf_dir).where("n_files > 7")).withColumn("cluster", F.col("cluster").cast("int"))


@query("a12_weighted_value", f"{ISLANDS_SQL} SELECT cluster::INT AS cluster, round(coalesce(sum(xps_value * n_files) / nullif(sum(n_files), 0), 0), 6) AS center FROM isl GROUP BY 1")
def a12(spark, sf_dir):
    return w1(spark, sf_dir).groupBy("cluster").agg(r6(grouping.weighted_value()).alias("center"))


@query("j4_nearest_cluster", f"{ISLANDS_SQL}, cen AS (SELECT cluster, sum(xps_value * n_files) / sum(n_files) AS center FROM isl GROUP BY 1), pairs AS (SELECT s.xps_value, cluster, row_number() OVER (PARTITION BY s.xps_value ORDER BY abs(s.xps_value - center), cluster) AS k FROM groups s, cen WHERE s.n_files <= 7) SELECT xps_value, cluster::INT AS cluster FROM pairs WHERE k = 1")
def j4(spark, sf_dir):
    groups = date_groups(spark, sf_dir)
    centres = w1(spark, sf_dir).groupBy("cluster").agg(grouping.weighted_value().alias("center"))
    return grouping.nearest_cluster(groups.where("n_files <= 7"), centres)


MERGED_SQL = f"""WITH RECURSIVE {FRAMES_SQL},
groups AS (SELECT xps_text::DOUBLE AS xps_value, count(*) AS n_files FROM frames GROUP BY 1),
big AS (SELECT xps_value, n_files, sum(coalesce((xps_value - prev > 0.0025)::INT, 0)) OVER (ORDER BY xps_value)::INT AS cluster
  FROM (SELECT *, lag(xps_value) OVER (ORDER BY xps_value) AS prev FROM groups WHERE n_files > 49)),
means AS (SELECT cluster, sum(xps_value * n_files) AS s, sum(n_files)::DOUBLE AS n FROM big GROUP BY cluster),
small AS (SELECT xps_value, n_files, row_number() OVER (ORDER BY xps_value) AS k FROM groups WHERE n_files <= 49),
fold(k, ss, ns, chosen) AS (
  SELECT 0::BIGINT, list(s ORDER BY cluster), list(n ORDER BY cluster), []::BIGINT[] FROM means HAVING count(*) > 0
  UNION ALL
  SELECT k + 1, [CASE WHEN i = pos THEN s + x * n ELSE s END FOR s, i IN ss], [CASE WHEN i = pos THEN m + n ELSE m END FOR m, i IN ns], list_append(chosen, pos)
  FROM (SELECT *, list_position(far, list_min(far)) AS pos
    FROM (SELECT f.k, ss, ns, chosen, g.xps_value AS x, g.n_files::DOUBLE AS n, [abs(s / ns[i] - g.xps_value) FOR s, i IN ss] AS far FROM fold f JOIN small g ON g.k = f.k + 1))),
ends AS (SELECT chosen FROM fold ORDER BY k DESC LIMIT 1),
placed AS (SELECT xps_value, n_files, cluster FROM big UNION ALL SELECT xps_value, n_files, (chosen[k] - 1)::INT FROM small, ends),
merged AS (SELECT cluster, sum(xps_value * n_files) / sum(n_files) AS merged_value, sum(n_files)::BIGINT AS merged_files FROM placed GROUP BY cluster)"""


@query("a13_merge_groups", f"{MERGED_SQL} SELECT xps_value, n_files, cluster, round(merged_value, 9) AS merged_value, merged_files FROM placed JOIN merged USING (cluster)")
def a13(spark, sf_dir):
    """Groups of frames by label, as far apart as the default gap; the fold over small groups is a recursive SQL."""
    merged = grouping.merge_groups(grouping.group_sizes(files(spark, sf_dir)), large=49, gap=0.0025)
    return merged.select("xps_value", "n_files", "cluster", F.round("merged_value", 9).alias("merged_value"), "merged_files")


@query("o10_merged_frames", f"{MERGED_SQL}, kept AS (SELECT merged_value FROM merged ORDER BY merged_value LIMIT 2) SELECT frame_id, round(merged_value, 9) AS xps_value FROM frames f JOIN placed p ON f.xps_text::DOUBLE = p.xps_value JOIN merged USING (cluster) WHERE merged_value IN (SELECT merged_value FROM kept)")
def o10(spark, sf_dir):
    found = merged_frames(frames(spark, sf_dir), large=49, gap=0.0025, first=2)
    return found.select("frame_id", F.round("xps_value", 9).alias("xps_value"))


@query("l1_sorted_groups", f"WITH {GROUPS_SQL} SELECT xps_value, n_files, row_number() OVER (ORDER BY xps_value)::INT AS place FROM groups")
def l1(spark, sf_dir):
    return date_groups(spark, sf_dir).select("xps_value", "n_files", F.row_number().over(Window.orderBy("xps_value")).alias("place"))


@query("l2_longest_group", f"WITH {GROUPS_SQL} SELECT * FROM groups ORDER BY n_files DESC, xps_value LIMIT 1")
def l2(spark, sf_dir):
    return grouping.longest_group(date_groups(spark, sf_dir))


@query("u3_other_groups", f"WITH {GROUPS_SQL} SELECT * FROM groups WHERE xps_value <> (SELECT xps_value FROM groups ORDER BY n_files DESC, xps_value LIMIT 1)")
def u3(spark, sf_dir):
    groups = date_groups(spark, sf_dir)
    return grouping.other_groups(groups, grouping.longest_group(groups))


@query("l3_evenly_spaced", """WITH ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
places AS (SELECT DISTINCT event_type, CASE WHEN i = 99 THEN n - 1 ELSE floor(i * ((n - 1) / 99.0::DOUBLE))::BIGINT END AS k FROM (SELECT DISTINCT event_type, n FROM ranked), (SELECT unnest(range(100)) AS i) t)
SELECT event_id, event_type FROM ranked WHERE n <= 100 OR (event_type, k) IN (SELECT (event_type, k) FROM places)""")
def l3(spark, sf_dir):
    return grouping.evenly_spaced(table(spark, sf_dir, "events").select("event_id", "event_type"), 100, "event_type", "event_id")


@query("l4_hash_sample", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || event_id::VARCHAR), event_id) AS k FROM events) WHERE k <= 50")
def l4(spark, sf_dir):
    return grouping.hash_sample(table(spark, sf_dir, "events").select("event_id", "event_type"), 50, 0, "event_type", "event_id")


@query("l5_first_groups", f"WITH {GROUPS_SQL} SELECT * FROM groups ORDER BY xps_value LIMIT 5")
def l5(spark, sf_dir):
    return grouping.first_rows(date_groups(spark, sf_dir), 5, "xps_value")


@query("l6_batches", "SELECT event_type, batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 500)::INT AS batch FROM events) GROUP BY ALL")
def l6(spark, sf_dir):
    numbered = grouping.batches(table(spark, sf_dir, "events").select("event_id", "event_type"), 500, "event_type", "event_id")
    return numbered.groupBy("event_type", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("u1_union_listings", f"WITH {FRAMES_SQL} SELECT filename || '.tiff' AS name FROM frames WHERE frame_id % 2 = 0 UNION ALL SELECT filename || '.tif' FROM frames WHERE frame_id % 2 = 1")
def u1(spark, sf_dir):
    f = frames(spark, sf_dir)
    one = lambda k, s: f.where(F.col("frame_id") % 2 == k).select(F.concat("filename", F.lit(s)).alias("name"))
    return one(0, ".tiff").unionByName(one(1, ".tif"))


# whole chain


def chain_inputs(spark, sf_dir):
    f = raised(frames(spark, sf_dir))
    zero = lookups.grid(spark, SIDE, SIDE).withColumn("bg", F.lit(0.5))
    s = Settings(SIDE, SIDE, GUESS, ring=RING, radius=4, bins=4, sigma=4, ratio=0.5, sample=50, box=2, tolerance=0.1)
    return f, zero, lookups.corner_masks(spark, SIDE, SIDE, 2), s


CLEAN_SQL = f"""med AS (SELECT xps_value, r, c, median(v) AS med FROM up JOIN pick USING (frame_id) GROUP BY ALL),
st0 AS (SELECT xps_value, r, c, med, median(abs(v - med)) AS mad FROM up JOIN pick USING (frame_id) JOIN med USING (xps_value, r, c) GROUP BY ALL),
st AS (SELECT xps_value, r, c, CASE WHEN NOT (r >= 4 AND r < 6 AND c >= 2 AND c < 4) THEN med END AS med, CASE WHEN NOT (r >= 4 AND r < 6 AND c >= 2 AND c < 4) THEN mad END AS mad FROM st0),
fl AS (SELECT up.*, med, mad, v > med + 4 * mad AS hit FROM up JOIN st USING (xps_value, r, c)),
near2 AS (SELECT DISTINCT frame_id, (r + dr)::INT AS r, (c + dc)::INT AS c FROM fl, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dr, dc) WHERE hit),
hy AS (SELECT fl.frame_id, fl.xps_value, fl.r, fl.c, CASE WHEN n.frame_id IS NOT NULL AND v > med + 4 * 0.5 * mad THEN NULL ELSE v END AS v FROM fl LEFT JOIN near2 n USING (frame_id, r, c))"""
RAISED_SQL = f"{PX_SQL}, up AS (SELECT frame_id, xps_value, r, c, v + 0.5 AS v FROM px)"
DRIFT_SQL = "SELECT frame_id, r, c, v - avg(CASE WHEN (r < 2 OR r >= 6) AND (c < 2 OR c >= 6) THEN v END) OVER (PARTITION BY frame_id) AS v"


def _results_sql(cleaned_sql: str, tolerance: float, suffix: str = "") -> str:
    """Centres and profiles of the pixels ``cl``, which ``cleaned_sql`` ends with."""
    parts = [cleaned_sql, *_steps_sql("cl", tolerance)]
    parts.append(f"ce AS (SELECT frame_id, {_moved('gx', 'tx')} AS x, {_moved('gy', 'ty')} AS y, t FROM e)")
    parts.append("pr AS (SELECT p.frame_id, floor(sqrt(pow(c - round_even(x - 4, 0) - 4, 2) + pow(r - round_even(y - 4, 0) - 4, 2)))::INT AS bin, avg(v) AS mean FROM cl p JOIN ce USING (frame_id) WHERE c - round_even(x - 4, 0) BETWEEN 0 AND 7 AND r - round_even(y - 4, 0) BETWEEN 0 AND 7 GROUP BY ALL)")
    bins = ", ".join(f"round((SELECT mean FROM pr WHERE pr.frame_id = ce.frame_id AND bin = {i}), 6) + 0.0 AS radial_bin_{i:03d}" for i in range(4))
    return ", ".join(parts) + f" SELECT filename || '{suffix}' AS filename, xps_text::DOUBLE AS xps_value, round(x, 4) + 0.0 AS center_x, round(y, 4) + 0.0 AS center_y, round(t, 6) + 0.0 AS total_count, {bins} FROM ce JOIN frames USING (frame_id)"


def rounded(results: DataFrame) -> DataFrame:
    """Results as wide rows, rounded for comparison."""
    rows = radial.wide(results, 4)
    bins = [c for c in rows.columns if c.startswith("radial_bin")]
    return rows.select("filename", "xps_value", *[(F.round(c, 4) + 0.0).alias(c) for c in ("center_x", "center_y")], *[r6(c).alias(c) for c in ("total_count", *bins)])


CHAIN_SQL = _results_sql(f"""{RAISED_SQL},
pick AS (SELECT frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY xps_text ORDER BY md5('0:' || frame_id::VARCHAR), frame_id) AS k FROM frames) WHERE k <= 50),
{CLEAN_SQL}, cl AS MATERIALIZED ({DRIFT_SQL} FROM hy)""", 0.1)


@query("o1_process_pixels", CHAIN_SQL)
def o1(spark, sf_dir):
    f, zero, masks, s = chain_inputs(spark, sf_dir)
    return rounded(process_pixels(f, zero, masks, s))


@query("o3_process_frames", CHAIN_SQL)
def o3(spark, sf_dir):
    f, zero, masks, s = chain_inputs(spark, sf_dir)
    return rounded(process_frames(f, zero, masks, s))


@query("o1_process_blocks", CHAIN_SQL)
def o1_blocks(spark, sf_dir):
    f, zero, masks, s = chain_inputs(spark, sf_dir)
    return rounded(process_blocks(f, zero, masks, s, side=3))


@query("o8_screening_image", f"""{RAISED_SQL},
sizes AS (SELECT xps_text, count(*) AS n FROM frames GROUP BY 1),
second AS (SELECT xps_text FROM sizes ORDER BY n DESC, xps_text LIMIT 1 OFFSET 1),
ranked AS (SELECT frame_id, row_number() OVER (ORDER BY filename) - 1 AS k, count(*) OVER () AS n FROM frames WHERE xps_text IN (SELECT xps_text FROM second)),
pick AS (SELECT frame_id FROM ranked WHERE n <= 20 OR k IN (SELECT CASE WHEN i = 19 THEN n - 1 ELSE floor(i * ((n - 1) / 19.0::DOUBLE))::BIGINT END FROM (SELECT DISTINCT n FROM ranked), (SELECT unnest(range(20)) AS i) t)),
{CLEAN_SQL} SELECT xps_value, r, c, CASE WHEN count(v) = count(*) THEN round(avg(v), 6) + 0.0 END AS v FROM hy JOIN pick USING (frame_id) GROUP BY ALL""")
def o8(spark, sf_dir):
    f, zero, _, s = chain_inputs(spark, sf_dir)
    return screening_image(f, zero, s, k=1, size=20).withColumn("v", r6("v"))


# sources and sinks, through files


def sample_results(spark, sf_dir):
    """Results made of pixels, to be written and read back."""
    p = [F.col("pixels")[i] for i in range(7)]
    return frames(spark, sf_dir).select("filename", p[0].alias("center_x"), p[1].alias("center_y"), p[2].alias("total_count"), "xps_value", F.array(*p[3:]).alias("radial_profile"))


def _results_columns_sql(round_to: int = 6) -> str:
    names = ["center_x", "center_y", "total_count", *[f"radial_bin_{i:03d}" for i in range(4)]]
    return ", ".join(f"round(embedding[{i}]::DOUBLE, {round_to}) + 0.0 AS {n}" for i, n in enumerate(names, 1))


@query("s1_tiff_round_trip", f"{PX_SQL}, t AS (SELECT frame_id, round(sum(v * (r * 8 + c)), 6) + 0.0 AS checksum FROM px GROUP BY frame_id) SELECT filename || '.tiff' AS filename, xps_text::DOUBLE AS xps_value, 8 AS height, 8 AS width, 'float64' AS dtype, checksum, NULL::VARCHAR AS error FROM frames JOIN t USING (frame_id)")
def s1(spark, sf_dir):
    """Frames written as compressed TIFF files by their tasks and read again as a folder."""
    folder = new_folder(spark, "tiff")
    write_frames(frames(spark, sf_dir), folder)
    checksum = F.aggregate(F.transform("pixels", lambda v, p: v * p), F.lit(0.0), lambda a, x: a + x)
    return read_frames(spark, folder).select("filename", "xps_value", "height", "width", "dtype", r6(checksum).alias("checksum"), "error")


#: (compression, predictor, tile, byte order) of the files that frames are written to in turn.
LAYOUTS = (
    ("plain", 1, None, "<"), ("plain", 2, (16, 16), ">"), ("lzw", 1, None, ">"), ("lzw", 2, (3, 5), "<"), ("deflate", 1, (4, 4), "<"), ("deflate", 2, None, ">"),
    ("deflate", 3, None, "<"), ("deflate", 3, (3, 3), ">"), ("packbits", 1, (8, 8), "<"), ("packbits", 2, None, ">"), ("lzw", 3, (5, 3), "<"), ("packbits", 3, None, "<"),
)


@query("s1_tiff_layouts", f"{PX_SQL}, t AS (SELECT frame_id, sum(round_even(v * 1000, 0) * (r * 8 + c + 1))::DOUBLE AS checksum FROM px GROUP BY frame_id) SELECT filename || '.tiff' AS filename, page::INT AS page, 8 AS height, 8 AS width, CASE WHEN frame_id % 12 IN (6, 7, 10, 11) THEN 'float64' ELSE 'int32' END AS dtype, checksum * (page + 1) + 0.0 AS checksum, NULL::VARCHAR AS error FROM frames JOIN t USING (frame_id), (SELECT unnest([0, 1]) AS page)")
def s1_layouts(spark, sf_dir):
    """Files of every layout, two images each, written by tasks and read as a frame an image."""
    folder = new_folder(spark, "layouts")

    def content(f) -> bytes:
        compression, predictor, tile, order = LAYOUTS[f.frame_id % len(LAYOUTS)]
        a = np.rint(np.asarray(f.pixels, dtype=float) * 1000).reshape(f.height, f.width).astype("f8" if predictor == 3 else "i4")
        return encode_pages([a, a * 2], compression, predictor, tile, order)

    rows = frames(spark, sf_dir).select("frame_id", "height", "width", "pixels", F.concat("filename", F.lit(".tiff")).alias("filename"))
    write_files(rows, folder, "filename", content)
    checksum = F.aggregate(F.transform("pixels", lambda v, p: v * (p + 1)), F.lit(0.0), lambda a, x: a + x) + 0.0
    return read_frames(spark, folder, pages=True).select("filename", "page", "height", "width", "dtype", checksum.alias("checksum"), "error")


@query("s2_filtered_source", f"{PX_SQL}, t AS (SELECT frame_id, round(sum(v * (r * 8 + c)), 6) + 0.0 AS checksum FROM px GROUP BY frame_id) SELECT filename || '.tiff' AS filename, xps_text::DOUBLE AS xps_value, checksum FROM frames JOIN t USING (frame_id) WHERE xps_text::DOUBLE BETWEEN 120.005 AND 120.0125 AND contains(filename, '_scan1')")
def s2_filtered(spark, sf_dir):
    """A folder as a data source: scan positions and names are filtered in its planning, other files stay closed."""
    folder = new_folder(spark, "source")
    write_frames(frames(spark, sf_dir), folder)
    chosen = frame_source(spark, folder).where("xps_value BETWEEN 120.005 AND 120.0125 AND contains(filename, '_scan1')")
    checksum = F.aggregate(F.transform("pixels", lambda v, p: v * p), F.lit(0.0), lambda a, x: a + x)
    return chosen.select("filename", "xps_value", r6(checksum).alias("checksum"))


@query("s2_broken_files", f"WITH {FRAMES_SQL} SELECT filename || '.tiff' AS filename, frame_id % 5 = 0 AS broken FROM frames")
def s2(spark, sf_dir):
    """A folder in which every fifth file is cut short: a row with an error for each, the others whole."""
    folder = new_folder(spark, "broken")
    rows = frames(spark, sf_dir).select("frame_id", "height", "width", "pixels", F.concat("filename", F.lit(".tiff")).alias("filename"))
    write_files(rows, folder, "filename", lambda f: encode(np.asarray(f.pixels, dtype=float).reshape(f.height, f.width))[: 20 if f.frame_id % 5 == 0 else None])
    return read_frames(spark, folder).select("filename", F.col("error").isNotNull().alias("broken"))


@query("k2_results_round_trip", f"WITH {FRAMES_SQL} SELECT filename, xps_text::DOUBLE AS xps_value, {_results_columns_sql()} FROM frames")
def k2(spark, sf_dir):
    folder = new_folder(spark, "results")
    save_results(sample_results(spark, sf_dir), folder, 4)
    rows = radial.wide(load_results(spark, folder, 4), 4)
    return rows.select("filename", "xps_value", *[r6(c).alias(c) for c in rows.columns if c not in ("filename", "xps_value")])


@query("k3_results_csv", f"WITH {FRAMES_SQL} SELECT filename, xps_text::DOUBLE AS xps_value, {_results_columns_sql().replace('radial_bin_00', 'radial_bin_')} FROM frames")
def k3(spark, sf_dir):
    folder = new_folder(spark, "csv")
    save_results_csv(sample_results(spark, sf_dir), folder, 4)
    rows = spark.read.option("header", True).csv(folder)
    return rows.select("filename", F.col("xps_value").cast("double").alias("xps_value"), *[r6(F.col(c).cast("double")).alias(c) for c in rows.columns if c not in ("filename", "xps_value")])


@query("k5_failures", f"WITH {FRAMES_SQL} SELECT filename, 'a frame of 8 x 7 pixels, not 8 x 8' AS error FROM frames WHERE frame_id % 3 = 0")
def k5(spark, sf_dir):
    """Frames of another shape become failures, written and read again."""
    folder = new_folder(spark, "failed")
    f, zero, masks, s = chain_inputs(spark, sf_dir)
    odd = F.col("frame_id") % 3 == 0
    bent = f.withColumn("width", F.when(odd, SIDE - 1).otherwise(SIDE)).withColumn("pixels", F.when(odd, F.slice("pixels", 1, SIDE * (SIDE - 1))).otherwise(F.col("pixels")))
    save_failures(split_failures(process_frames(bent, zero, masks, s))[1], folder)
    return spark.read.option("header", True).csv(folder)


@query("k6_config", "SELECT '/out/' || vec_id::VARCHAR AS result_directory, label + 0.5::DOUBLE AS sigma, 1 / (label + 1)::DOUBLE AS ratio, 40.0::DOUBLE AS inner_radius FROM embeddings")
def k6(spark, sf_dir):
    """A configuration for each frame, written as text and read again with its types; what isn't given is the default."""
    folder = new_folder(spark, "config")
    label = F.col("label").cast("double")
    given = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("/out/"), F.col("vec_id").cast("string")).alias("result_directory"), F.array(label + 0.5, 1 / (label + 1)).alias("xray_removal_param"))
    save_configs(given, folder)
    params = F.col("xray_removal_param")
    return load_configs(spark, folder).select("result_directory", params[0].alias("sigma"), params[1].alias("ratio"), F.col("center_fitting_param")[0].alias("inner_radius"))


@query("k7_report_counts", f"WITH {FRAMES_SQL} SELECT filename, printf('%.3f', embedding[3]::DOUBLE) AS total_count FROM frames")
def k7(spark, sf_dir):
    folder = new_folder(spark, "report")
    save_report(sample_results(spark, sf_dir), folder, 4, ("counts",))
    return spark.read.option("header", True).csv(f"{folder}/counts")


@query("k8_images", f"{PX_SQL}, e AS (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1) SELECT filename || '.png' AS name, r, c, (round_even((v - lo) / (hi - lo) * 255, 0) >= 128)::INT AS keep FROM px JOIN e USING (frame_id) JOIN frames USING (frame_id)")
def k8(spark, sf_dir):
    """Frames written as grey PNG images by their tasks and read again as masks."""
    folder = new_folder(spark, "images")
    write_images(frames(spark, sf_dir), folder)
    return mask_pixels(read_masks(spark, folder)).select(naming.base_name(F.col("path")).alias("name"), "r", "c", "keep")


@query("k8_coloured_images", f"{PX_SQL}, e AS (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), z AS (SELECT frame_id, r, c, (v - lo) / (hi - lo) AS z FROM px JOIN e USING (frame_id)), rgb AS (SELECT frame_id, r, c, round_even(CASE WHEN z <= 0.5 THEN 510 * z ELSE 255 END, 0)::BIGINT AS red, round_even(CASE WHEN z > 0.5 THEN 510 * (z - 0.5) ELSE 0 END, 0)::BIGINT AS green FROM z) SELECT filename || '.png' AS name, r, c, ((red * 299 + green * 587) // 1000 >= 128)::INT AS keep FROM rgb JOIN frames USING (frame_id)")
def k8_coloured(spark, sf_dir):
    """Frames from black over red to yellow, read again as masks: colours are weighed to grey."""
    folder = new_folder(spark, "coloured")
    write_images(frames(spark, sf_dir), folder, colours=((0, 0, 0), (255, 0, 0), (255, 255, 0)))
    return mask_pixels(read_masks(spark, folder)).select(naming.base_name(F.col("path")).alias("name"), "r", "c", "keep")


#: The whole square of 40 around the guess is left out, so no pixel is a hit; the default step ends the centres.
FOLDER_SQL = _results_sql(f"{RAISED_SQL}, cl AS MATERIALIZED ({DRIFT_SQL} FROM up)", 1.0, ".tiff")


def constants(spark: SparkSession, out: str, level: DataFrame, masks: DataFrame) -> None:
    """Background and masks as the files that a configured run finds beside its results."""
    made = level.join(masks, ["r", "c"]).select(F.explode(F.array(*[F.struct(F.lit(i).alias("frame_id"), F.col(v).cast("double").alias("v"), F.lit(n).alias("filename")) for i, (v, n) in enumerate((("bg", "background"), ("keep", "data_mask"), ("bkg", "background_mask")))])).alias("x"), "r", "c")
    made = to_frames(made.select("x.frame_id", "x.v", F.col("x.filename").alias("xps_value"), "r", "c"), SIDE, SIDE)
    write_frames(made.withColumnRenamed("xps_value", "filename"), out)


@query("o5_run_of_a_folder", FOLDER_SQL)
def o5(spark, sf_dir):
    """A configured run: frames, background and masks are files, found by the configuration's rules."""
    data, out = new_folder(spark, "data"), new_folder(spark, "out")
    f, level, masks, _ = chain_inputs(spark, sf_dir)
    write_frames(f, data)
    constants(spark, out, level, masks)
    config = RunConfig(out, "default", "default", xray_removal_param=[4, 0.5], center_fitting_param=[*RING, *GUESS], azimuthal_avg_param=[4, 4])
    return rounded(load_results(spark, f"{run_configured(spark, config, data, SIDE, SIDE)}/results", 4))


class Stopped(BaseException):
    """A run that is ended from outside."""


@query("o5_resumed_run", FOLDER_SQL)
def o5_resumed(spark, sf_dir):
    """A run that is stopped after its first groups and called again: the rows of one run."""
    data, out = new_folder(spark, "data"), f"{new_folder(spark, 'out')}/run"
    f, level, masks, s = chain_inputs(spark, sf_dir)
    s = replace(s, box=40, tolerance=1.0)
    write_frames(f, data)
    calls = []

    def stopping(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise Stopped
        return process_frames(*args, **options)

    try:
        run_groups(spark, data, out, level, masks, s, stopping, at_once=4)
    except Stopped:
        run_groups(spark, data, out, level, masks, s, at_once=8)
    return rounded(load_results(spark, f"{out}/results", 4))


@query("o10_merged_run", f"""SELECT f.filename, m.xps_value, center_x, center_y, total_count, {', '.join(f'radial_bin_{i:03d}' for i in range(4))} FROM ({FOLDER_SQL}) f
  JOIN ({MERGED_SQL}, kept AS (SELECT merged_value FROM merged ORDER BY merged_value LIMIT 2) SELECT filename || '.tiff' AS filename, round(merged_value, 9) AS xps_value FROM frames JOIN placed p ON xps_text::DOUBLE = p.xps_value JOIN merged USING (cluster) WHERE merged_value IN (SELECT merged_value FROM kept)) m ON m.filename = f.filename""")
def o10_run(spark, sf_dir):
    """A folder whose groups are merged as its configuration says; the first two are processed."""
    data, out = new_folder(spark, "data"), new_folder(spark, "out")
    f, level, masks, _ = chain_inputs(spark, sf_dir)
    write_frames(f, data)
    constants(spark, out, level, masks)
    config = RunConfig(out, "default", "default", xps_grouping_param=[49, 0.0025], xray_removal_param=[4, 0.5], center_fitting_param=[*RING, *GUESS], azimuthal_avg_param=[4, 4])
    found = load_results(spark, f"{run_configured(spark, config, data, SIDE, SIDE, merged=True, first=2)}/results", 4)
    return rounded(found).withColumn("xps_value", F.round("xps_value", 9))


@query("a9_merged_batches", ORACLE["a9_profile_stats"])
def a9_batches(spark, sf_dir):
    """Frames in five batches, each a state of its own, merged into one."""
    cut = profiles(spark, sf_dir).withColumn("cut", F.col("frame_id") % 5)
    states = moments.moments(cut, ("cut", *moments.PROFILE[0]), moments.PROFILE[1]).drop("cut")
    s = moments.profile_statistics_of(moments.merged(states, *moments.PROFILE))
    return s.select("xps_value", "bin", r6("mean").alias("mean"), r6("std").alias("std"))


@query("a9_profile_stream", ORACLE["a9_profile_stats"])
def a9_stream(spark, sf_dir):
    """Profiles that arrive as files, a few a batch, and are merged batch by batch."""
    folder = new_folder(spark, "arriving")
    profiles(spark, sf_dir).repartition(6).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("frame_id long, xps_value double, bin int, bin_center double, mean double").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    merge_batches(stream, *moments.PROFILE, f"{folder}/state", f"{folder}/marks").awaitTermination()
    s = moments.profile_statistics_of(latest_state(spark, f"{folder}/state"))
    return s.select("xps_value", "bin", r6("mean").alias("mean"), r6("std").alias("std"))


@query("a10_merged_batches", ORACLE["a10_run_summary"])
def a10_batches(spark, sf_dir):
    counted = pixels(spark, sf_dir).groupBy("frame_id", "xps_value").agg(F.sum(F.col("v") + 1).alias("total_count"), F.max(F.col("r") * F.col("v")).alias("center_y"))
    results = counted.withColumn("center_x", F.lit(0.0)).join(radial.as_array(profiles(spark, sf_dir)), "frame_id")
    states = [moments.run_state(results.where(F.col("frame_id") % 3 == i)) for i in range(3)]
    s = moments.run_summary_of(moments.merged(states[0].unionByName(states[1]).unionByName(states[2]), *moments.RUN))
    return s.select("xps_value", "n_frames", *[r6(c).alias(c) for c in ("mean_center_y", "std_center_y", "mean_total_count", "std_total_count", "profile_max", "profile_min")])


@query("s8_frame_round_trip", f"{PX_SQL} SELECT frame_id, count(*) AS n, round(sum(v * (r * 8 + c)), 6) + 0.0 AS checksum FROM px GROUP BY frame_id")
def s8(spark, sf_dir):
    back = to_frames(pixels(spark, sf_dir), SIDE, SIDE)
    checksum = F.aggregate(F.transform("pixels", lambda v, p: v * p), F.lit(0.0), lambda a, x: a + x)
    return back.select("frame_id", F.size("pixels").cast("long").alias("n"), r6(checksum).alias("checksum"))


@query("a2_frame_drift", f"{PX_SQL} SELECT DISTINCT frame_id, round(avg(CASE WHEN (r < 2 OR r >= 6) AND (c < 2 OR c >= 6) THEN v END) OVER (PARTITION BY frame_id), 6) + 0.0 AS drift FROM px")
def drift(spark, sf_dir):
    known = pixels(spark, sf_dir).join(F.broadcast(lookups.corner_masks(spark, SIDE, SIDE, 2)), ["r", "c"])
    return known.select("frame_id", r6(F.avg(F.when(F.col("bkg") == 0, F.col("v"))).over(of_frame())).alias("drift")).distinct()


@query("s8_block_round_trip", ORACLE["s8_frame_round_trip"])
def s8_blocks(spark, sf_dir):
    back = bl.from_blocks(bl.to_blocks(frames(spark, sf_dir), BLOCKS), BLOCKS)
    checksum = F.aggregate(F.transform("pixels", lambda v, p: v * p), F.lit(0.0), lambda a, x: a + x)
    return back.select("frame_id", F.size("pixels").cast("long").alias("n"), r6(checksum).alias("checksum"))
