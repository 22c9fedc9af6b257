"""Groups of files by scan position: listing, merging, selection, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlake.functions.naming import base_name, scan_key, scan_value, suffix
from ringlake.sources.scratch import checkpoint

# A large group has more files than this; large groups chain within this gap.
LARGE = 350
GAP = 0.0025


def listed(files: DataFrame) -> DataFrame:
    """(path, name, xps_value, xps_key, suffix) of a table of paths; names without a scan token have null values."""
    name = base_name(F.col("path"))
    return files.select("path", name.alias("name"), scan_value(name).alias("xps_value"), scan_key(name).alias("xps_key"), suffix(name).alias("suffix"))


def group_sizes(files: DataFrame) -> DataFrame:
    """(xps_value, n_files) of the files that have a scan token."""
    return listed(files).where("xps_value IS NOT NULL").groupBy("xps_value").agg(F.count("*").alias("n_files"))


def group_files(files: DataFrame) -> DataFrame:
    """(xps_value, place, path, n_files): the files of each group, numbered from 0 in order of their paths; a row a file, so groups of any size."""
    known = placed(listed(files).where("xps_value IS NOT NULL").select("xps_value", "path"), "xps_value", "path")
    return known.select("xps_value", F.col("__k").alias("place"), "path", F.col("__size").alias("n_files"))


def pattern_summary(files: DataFrame) -> DataFrame:
    """(xps_value, n_files, n_patterns) per group, and a total row with a null xps_value."""
    known = listed(files).where("xps_value IS NOT NULL")
    return known.rollup("xps_value").agg(F.count("*").alias("n_files"), F.count_distinct("suffix").alias("n_patterns"))


def islands(groups: DataFrame, gap: float = GAP) -> DataFrame:
    """``groups`` (xps_value, n_files) with ``cluster``: a new one wherever the value is more than ``gap`` after the one before.

    The window runs over groups, one row a scan position, not over files.
    """
    w = Window.orderBy("xps_value")
    new = F.coalesce((F.col("xps_value") - F.lag("xps_value").over(w) > gap).cast("int"), F.lit(0))
    return groups.withColumn("new", new).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def weighted_value(value: str = "xps_value", n: str = "n_files") -> Column:
    """Mean position by number of files; 0 without files."""
    return F.coalesce(F.sum(F.col(value) * F.col(n)) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))


def nearest_cluster(small: DataFrame, clusters: DataFrame) -> DataFrame:
    """(xps_value, cluster) of the cluster (cluster, center) nearest to each small group; ties to the lowest.

    The nearest centre is the last one at or below, or the first one above: both come from
    running windows over the union in order of position, with no pair of all with all. Both
    tables have a row per group of files. Without clusters no group remains.
    """
    both = small.select("xps_value", F.lit(None).cast("int").alias("cluster")).unionByName(clusters.select(F.col("center").alias("xps_value"), "cluster"))
    at = F.when(F.col("cluster").isNotNull(), F.struct(F.col("xps_value").alias("x"), "cluster"))
    # among equal positions the lowest cluster must be seen from both sides
    below = F.last(at, True).over(Window.orderBy(F.col("xps_value"), F.col("cluster").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(at, True).over(Window.orderBy(F.col("xps_value"), F.col("cluster").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("a", below).withColumn("b", above).where("cluster IS NULL")
    da, db = F.abs(F.col("xps_value") - F.col("a.x")), F.abs(F.col("b.x") - F.col("xps_value"))
    pick = F.when(F.col("b").isNull() | (da < db), F.col("a.cluster")).when(F.col("a").isNull() | (db < da), F.col("b.cluster")).otherwise(F.least("a.cluster", "b.cluster"))
    return seen.select("xps_value", pick.alias("cluster")).where("cluster IS NOT NULL")


def merge_groups(groups: DataFrame, large: int = LARGE, gap: float = GAP, keep_small: bool = False) -> DataFrame:
    """(xps_value, cluster, merged_value) of each group (xps_value, n_files) after merging.

    Groups of more than ``large`` files chain into clusters within ``gap``. The others, in
    ascending order, join the cluster whose weighted mean is nearest at that moment (ties to
    the lowest); a mean moves as groups join. That order matters, so it is a fold over the
    sorted groups in one row: scan positions, never files or frames. Without a large group
    nothing remains, unless ``keep_small`` makes every small group its own cluster.
    """
    big = islands(groups.where(F.col("n_files") > large), gap)
    means = big.groupBy("cluster").agg(F.sum(F.col("xps_value") * F.col("n_files")).alias("s"), F.sum("n_files").cast("double").alias("n"))
    start = F.transform(F.array_sort(F.collect_list(F.struct("cluster", "s", "n"))), lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n")))
    clusters = means.agg(start.alias("clusters"))
    small = groups.where(F.col("n_files") <= large).agg(F.array_sort(F.collect_list(F.struct("xps_value", F.col("n_files").cast("double").alias("n")))).alias("small"))

    def join(state: Column, g: Column) -> Column:
        far = F.transform(state["clusters"], lambda q: F.abs(q["s"] / q["n"] - g["xps_value"]))

        def put(k: Column) -> Column:
            grown = F.transform(state["clusters"], lambda q, i: F.when(i + 1 == k, F.struct((q["s"] + g["xps_value"] * g["n"]).alias("s"), (q["n"] + g["n"]).alias("n"))).otherwise(q))
            return F.struct(grown.alias("clusters"), F.concat(state["chosen"], F.array((k - 1).cast("int"))).alias("chosen"))

        return F.element_at(F.transform(F.array(F.array_position(far, F.array_min(far))), put), 1)

    begin = F.struct(F.col("clusters").alias("clusters"), F.array().cast("array<int>").alias("chosen"))
    folded = clusters.join(F.broadcast(small)).where("size(clusters) > 0").select("small", F.aggregate("small", begin, join).alias("end"))
    joined = folded.select(F.explode(F.arrays_zip(F.col("small.xps_value").alias("xps_value"), F.col("end.chosen").alias("cluster"))).alias("z")).select("z.xps_value", "z.cluster")
    placed = big.select("xps_value", "cluster").unionByName(joined).join(groups.select("xps_value", "n_files"), "xps_value")
    if keep_small:
        alone = groups.join(placed.select("xps_value"), "xps_value", "left_anti")
        placed = placed.unionByName(alone.select("xps_value", (F.row_number().over(Window.orderBy("xps_value")) - 1).alias("cluster"), "n_files"))
    merged = placed.groupBy("cluster").agg(weighted_value().alias("merged_value"), F.sum("n_files").alias("merged_files"))
    return placed.join(merged, "cluster").select("xps_value", "n_files", "cluster", "merged_value", "merged_files")


def longest_group(groups: DataFrame) -> DataFrame:
    """The group of most files; of equal ones that of the lowest position."""
    return groups.orderBy(F.desc("n_files"), "xps_value").limit(1)


def other_groups(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    return groups.join(chosen.select("xps_value"), "xps_value", "left_anti")


def nth_group(groups: DataFrame, k: int) -> DataFrame:
    """The k-th group (from 0) by falling number of files, then position."""
    return groups.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n_files"), "xps_value")) - 1).where(F.col("k") == k).drop("k")


def placed(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The rows with ``__k``, their place (from 0) in their group by ``order``, and ``__size``, the rows of the group.

    Rows are sorted by range over (group, order) and kept so; sizes of a group's ranges are
    added up first and each range then numbers its own rows. So a group of any size is
    numbered by as many tasks as hold it. Rows of equal order come in any order.
    """
    ranged = checkpoint(rows.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()))
    by_part = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    parts = parts.select(F.col(group).alias("__group"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(by_part), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(group)).alias("__size"))
    inside = F.row_number().over(Window.partitionBy("__part", group).orderBy(order)) - 1
    known = ranged.withColumn("__k", inside).join(parts, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__group")))
    return known.select(*[F.col(c) for c in rows.columns], (F.col("__before") + F.col("__k")).alias("__k"), "__size")


def evenly_spaced(files: DataFrame, n: int, group: str = "xps_value", order: str = "path") -> DataFrame:
    """``n`` rows of each group, evenly spaced in order, first and last among them; all of a group that has fewer.

    Places are the whole parts of i * step with step = (size - 1) / (n - 1), the last one
    exact; whether a row's place is one of them is seen by trying the two nearest i.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    ranked = placed(files, group, order)
    step = (F.col("__size") - 1) / F.lit(float(max(n - 1, 1)))
    near = [F.floor(F.col("__k") / step) + j for j in (0, 1)]
    hit = [(i <= n - 2) & (F.floor(i * step) == F.col("__k")) for i in near]
    last = F.col("__k") == (F.col("__size") - 1 if n > 1 else F.lit(0))
    return ranked.where((F.col("__size") <= n) | last | hit[0] | hit[1]).drop("__k", "__size")


def hash_sample(files: DataFrame, n: int = 50, seed: int = 0, group: str = "xps_value", key: str = "path") -> DataFrame:
    """At most ``n`` rows of each group in order of a hash of ``key``."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key)
    return files.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")


def first_rows(files: DataFrame, n: int, *order: str) -> DataFrame:
    return files.orderBy(*order).limit(n)


def batches(files: DataFrame, size: int, group: str = "xps_value", order: str = "path") -> DataFrame:
    """Adds ``batch``: the number of the run of ``size`` rows of the group that a row falls into."""
    return placed(files, group, order).withColumn("batch", F.floor(F.col("__k") / size).cast("int")).drop("__k", "__size")
