"""Near-duplicates by b-bit MinHash: bands choose pairs, packed low bits of minima estimate them, full sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlake.llm.common import join_heavy, map_texts, released, segment_sum, slices, starts_of
from ringlake.llm.hamming import both_ways, components
from ringlake.llm.simhash_dedup import shingle_hashes, voted

#: A pair at similarity s shares no band with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8, less above.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Low bits kept of each minimum; unequal minima agree in them by chance once in 2^BITS.
BITS = 2
WORDS = MINIMA * BITS // 64
#: Deviations that an estimate may lie below the similarity asked for before its pair is left out: fewer than one pair in 10^8.
DEVIATIONS = 7
_rng = np.random.default_rng(42)
XOR = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64)
ODD = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64) | np.uint64(1)
#: Sizes of sets whose quotient is below this are in one class.
SIZE_STEP = 1.02
#: Bits of a filter for each key in it, and the most bits of one (16 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 27
#: Buckets of up to so many sets make all pairs that are still open.
SMALL_BUCKET = 4
#: Sets that are compared with one copy of another.
COMPARED = 512


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    return distinct_hashes([shingle_hashes(t, words) for t in texts])


def distinct_hashes(hashes: list[list[int]]) -> list[np.ndarray]:
    return [np.unique(np.array(h, dtype=np.uint64)) for h in hashes]


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set."""
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA minima of each set that isn't empty, in rows."""
    sets = [s for s in sets if len(s)]
    out = np.empty((len(sets), MINIMA), dtype=np.uint64)
    if sets:
        flat, cut = np.concatenate(sets), starts_of([len(s) for s in sets])[:-1]
        for i in range(MINIMA):
            out[:, i] = np.minimum.reduceat((flat ^ XOR[i]) * ODD[i], cut)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of minima; a key hashes the band's number and its ROWS minima."""
    keys = np.empty((len(least), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(least), b, dtype=np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            key = (key ^ (key >> np.uint64(31)) ^ least[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        keys[:, b] = key
    return keys.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The signature of each row of minima: BITS bits of each, in WORDS 64-bit numbers. High bits mix down first: a product's lowest bits depend on few of a hash's."""
    low = ((least >> np.uint64(40)) & np.uint64((1 << BITS) - 1)).reshape(len(least), WORDS, 64 // BITS)
    places = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low << places, axis=2).view(np.int64) if len(least) else np.zeros((0, WORDS), dtype=np.int64)


def estimated(left: Column, right: Column) -> Column:
    """Similarity of two signatures: the share of minima that agree in all their bits, less what chance makes agree."""
    every = F.lit(sum(1 << i for i in range(0, 64, BITS))).cast("long")
    unequal = F.lit(0)
    for i in range(WORDS):
        x = left[i].bitwiseXOR(right[i])
        either = x
        for k in range(1, BITS):
            either = either.bitwiseOR(F.shiftrightunsigned(x, k))
        unequal = unequal + F.bit_count(either.bitwiseAND(every))
    chance = 2.0**-BITS
    return (1 - unequal / float(MINIMA) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Estimates below this are of pairs below ``percent``, but for one in 10^8."""
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * percent / 100
    return (agree - DEVIATIONS * (agree * (1 - agree) / MINIMA) ** 0.5 - chance) / (1 - chance)


def signatures(docs: DataFrame, words: int, simhash: bool = False) -> DataFrame:
    """(doc_id, h, sid, n, bands, bits) of each row: text hash, set hash, size of the set, band keys and packed signature; with ``simhash`` also fp, the text's SimHash of the same shingles."""

    def work(texts):
        hashes = [shingle_hashes(t, words) for t in texts]
        sets = distinct_hashes(hashes)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        least = minima(sets)
        lists = [pa.ListArray.from_arrays(pa.array(starts_of(np.where(n > 0, size, 0)).astype(np.int32)), pa.array(x.ravel())) for size, x in ((BANDS, band_keys(least)), (WORDS, packed(least)))]
        votes = [pa.array(voted(hashes).view(np.int64))] if simhash else []
        return [pa.array(set_ids(sets)), pa.array(n), *lists, *votes]

    made = "sid long, n long, bands array<long>, bits array<long>" + (", fp long" if simhash else "")
    return map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), work, made, ("doc_id", "h"))


class Filter:
    """Which 64-bit numbers may be among those of a column, as a broadcast of bits: what it hasn't is surely not there.

    It has BITS_A_KEY bits a row, up to MOST_BITS; Spark sets them and the driver gets whole
    words of them. More rows than fit let more numbers through, and none of the column's out.
    """

    def __init__(self, rows: DataFrame, column: str):
        wanted = max(1, rows.count()) * BITS_A_KEY
        self.size = min(MOST_BITS, max(1 << 10, 1 << (wanted - 1).bit_length()))
        place = F.pmod(F.col(column), F.lit(self.size))
        words = rows.select((place / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("b"))
        held = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(self.size // 32, dtype=np.uint32)
        bits[held.column("w").to_numpy()] = held.column("b").to_numpy().astype(np.uint32)
        self.shared: Broadcast = rows.sparkSession.sparkContext.broadcast(bits)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        at = values % self.size
        return (self.shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, set) of the sets in ``wanted`` (sid, h), made again from one text of each: that of hash h."""
    among = Filter(wanted, "h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(among.may_hold(batch.column("h").to_numpy())))
            for a, b in slices(found.column("text")):
                sets = shingle_sets(found.column("text").slice(a, b - a).to_pylist(), words)
                flat = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(starts_of([len(s) for s in sets]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([found.column("h").slice(a, b - a), lists], names=["h", "set"])

    text = F.col("text").cast("string")
    made = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("h"), text.alias("text")).mapInArrow(work, "h long, set array<long>")
    return made.groupBy("h").agg(F.first("set").alias("set")).join(wanted, "h").select("sid", "set")


def able(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (sid, n, other, other_n, ...) whose sizes allow the similarity."""
    return pairs.where(F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent)


def near_enough(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, h_a, h_b), a < b, of the pairs (sid, h, bits, other, other_h, other_bits) whose signatures come near enough to ``percent``."""
    rising = F.col("sid") < F.col("other")
    one = lambda x, y: F.when(rising, F.col(x)).otherwise(F.col(y))
    near = pairs.where(estimated(F.col("bits"), F.col("other_bits")) >= least_estimate(percent))
    return near.select(one("sid", "other").alias("a"), one("other", "sid").alias("b"), one("h", "other_h").alias("h_a"), one("other_h", "h").alias("h_b"))


def promising(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """`near_enough`, once each, of the pairs (sid, other), with what ``marks`` (sid, h, bits) has of both."""
    ordered = pairs.select(F.least("sid", "other").alias("sid"), F.greatest("sid", "other").alias("other")).distinct()
    others = marks.select(F.col("sid").alias("other"), F.col("h").alias("other_h"), F.col("bits").alias("other_bits"))
    return near_enough(ordered.join(marks.select("sid", "h", "bits"), "sid").join(others, "other"), percent)


def common_sizes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs that reach the similarity; rows come as (a, part, b, set), that of a itself (b null) before the others of its part."""
    lead, own = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        if not len(batch):
            continue
        a, part = batch.column("a").to_numpy(), batch.column("part").to_numpy()
        b, sets = batch.column("b"), batch.column("set")
        values, ends = sets.flatten().to_numpy().view(np.uint64), sets.value_lengths().to_numpy().cumsum()
        begins, heads = np.concatenate([[0], ends[:-1]]), b.is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(heads).tolist()
        good = np.zeros(len(a), dtype=bool)
        for i, j in zip([0, *cuts], [*cuts, len(a)]):
            if heads[i]:
                lead, own = (a[i], part[i]), values[begins[i] : ends[i]].copy()
                i += 1
            if i >= j:
                continue
            if lead != (a[i], part[i]):
                raise RuntimeError("a set came without the one that it is compared with")
            mine = values[begins[i] : ends[j - 1]]
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            shared = segment_sum((own[at] == mine).astype(np.int64), np.concatenate([begins[i:j], ends[j - 1 : j]]) - begins[i])
            size = len(own) + ends[i:j] - begins[i:j]
            good[i:j] = shared * 100 >= (size - shared) * percent
        yield pa.RecordBatch.from_arrays([batch.column("a"), b], names=["a", "b"]).filter(pa.array(good))


def ends_of(pairs: DataFrame) -> DataFrame:
    """(sid, h) of all that are in a pair (a, b, h_a, h_b), once each; tasks make them distinct before they meet."""
    ends = [F.struct(F.col(c).alias("sid"), F.col(f"h_{c}").alias("h")) for c in "ab"]
    return pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.sid", "e.h").distinct()


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity.

    Of a pair, the one in more pairs stays and the other's set is sent to it. What meets one
    set is dealt into parts of about COMPARED, each with one copy of that set: however many
    texts are compared with one, no task gets them all and no set is copied beside each.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("m"))
    left, right = (ends.select(F.col("sid").alias(c), F.col("m").alias(f"m_{c}")) for c in "ab")
    first = F.struct("m_a", "a") >= F.struct("m_b", "b")
    turned = pairs.join(left, "a").join(right, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("m_a", "m_b").alias("m"))
    parts = F.ceil(F.col("m") / F.lit(COMPARED)).cast("int")
    dealt = released(turned.select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part")))
    heads = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("sid", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "set")
    members = dealt.join(sets.withColumnRenamed("sid", "b"), "b").select("a", "part", "b", "set")
    rows = heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = rows.mapInArrow(lambda batches: common_sizes(batches, percent), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def prefix_pairs(sets: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(sid, n, other, other_n): pairs of different roots in ``held`` (sid, root, n) that may reach ``percent``; exact.

    Sets of sizes m <= n of that similarity p have at least p (m + n) / (1 + p) shingles in
    common. So, with shingles in one order for all, the rarest first, each has one of them
    among its first shingles, as many as may be missing and one more. The larger set looks
    into classes of sizes one by one, the bound of each being that of its least size. A text
    of which more is nobody else's than may be missing has no pair at all, so groups
    whose members were all changed in their own way make few.
    """
    # rows of two numbers only, as there are most of them; root and size come back with the sorted lists
    grams = sets.join(held, "sid").select("sid", F.explode("set").alias("g"))
    several = grams.groupBy("g").agg(F.count("*").alias("d")).where("d > 1")
    sorted_ = F.array_sort(F.collect_list(F.struct("d", "g")))
    ranked = grams.join(several, "g").groupBy("sid").agg(F.transform(sorted_, lambda x: x["g"]).alias("s"))
    ranked = released(ranked.join(held, "sid"))
    n = F.col("n")

    def class_of(size):
        return F.floor(F.log(size) / F.log(F.lit(SIZE_STEP)) + 1e-9).cast("int")

    def first(least):
        """The shingles of which a partner of ``least`` shingles has one, but for those of no other set, which come before."""
        needed = F.ceil(percent * (n + least) / F.lit(100 + percent))
        return F.slice("s", F.lit(1), F.greatest((F.size("s") - needed + 1).cast("int"), F.lit(0)))

    small = released(ranked.select("sid", "root", "n", class_of(n).alias("class"), F.explode(first(n)).alias("g")))
    classes = F.sequence(class_of(F.greatest(F.ceil(n * percent / F.lit(100)), F.lit(1))), class_of(n))
    large = ranked.select("sid", "root", "n", "s", F.explode(classes).alias("class"))
    least = F.greatest(F.floor(F.pow(F.lit(SIZE_STEP), F.col("class")) * (1 - 1e-9)), F.ceil(n * percent / F.lit(100)))
    large = large.select(F.col("sid").alias("other"), F.col("root").alias("root2"), F.col("n").alias("other_n"), "class", F.explode(first(least)).alias("g"))
    order = (F.col("n") < F.col("other_n")) | ((F.col("n") == F.col("other_n")) & (F.col("sid") < F.col("other")))
    return small.join(large, ["g", "class"]).where(order & (F.col("root") != F.col("root2"))).select("sid", "n", "other", "other_n")


def _two_steps(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b): the least node within two steps."""
    both = both_ways(edges)
    first = both.groupBy("a").agg(F.least("a", F.min("b")).alias("l"))
    second = both.join(first.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.least("a", F.min("l")).alias("root"))
    return second.withColumnRenamed("a", "node")


def near_labels(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b); nodes of equal root are connected, but not all that are connected have an equal one.

    Around one central node two steps are all. A further round takes two steps between what
    is apart then. That leaves out most of what is linked already, at a known cost.
    """
    labels, left = None, edges
    for k in range(rounds):
        found = released(_two_steps(left))
        if labels is None:
            labels = found
        else:
            on = found.select(F.col("node").alias("root"), F.col("root").alias("further"))
            labels = labels.join(on, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        if k + 1 < rounds:
            of = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
            apart = left.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
            left = released(apart.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    return labels


def similar_roots(docs: DataFrame, marked: DataFrame, words: int, percent: int, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of each set that is linked to another; root is the least sid that links reach.

    Sets link at a Jaccard similarity of ``percent`` or more, exact over their shingles.
    Candidates share a band. First one set of each bucket is compared with the others: the
    one that meets the most others over all buckets, which most near copies of one text are
    near to. What then is in one bucket but not connected is compared: all of a bucket of up
    to SMALL_BUCKET sets, and those of larger ones where rare shingles allow a link. So large groups of near copies don't make all their pairs, and no pair of a
    bucket is left out that could join two groups. Signatures leave out what is far from the
    similarity before any set is made or sent.

    ``first`` may give pairs of another search, once each, from rows (sid, n, fp, h, bits): (sid, n, h, bits, other, other_n, other_h, other_bits).
    They are checked before all others; only buckets that they leave apart go on then, and
    only pairs of what is apart.
    """
    votes = [] if first is None else [F.min_by("fp", "h").alias("fp")]
    sized = marked.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.min("h").alias("h"), *votes)
    sized = released(sized)
    known = None
    if first is None:
        keys = sized.select("sid", F.explode("bands").alias("key"))
        several = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        shared = released(keys.join(several, "key").withColumn("root", F.col("sid")))
    else:
        tried = released(near_enough(able(first(sized.select("sid", "n", "fp", "h", "bits")), percent), percent))
        known = released(linked(tried, released(sets_of(docs, released(ends_of(tried)), words)), percent))
        labels = near_labels(known, rounds=1)
        keys = sized.join(labels, sized["sid"] == labels["node"], "left").select("sid", F.coalesce("root", "sid").alias("root"), F.explode("bands").alias("key"))
        several = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", "m")
        shared = released(keys.join(several, "key"))
    meets = released(shared.groupBy("sid").agg(F.sum("m").alias("w")).join(sized.select("sid", "n", "h", "bits"), "sid"))
    weighed = released(shared.select("sid", "key", F.col("root").alias("before")).join(meets.select("sid", "n", "w"), "sid"))
    leaders = weighed.groupBy("key").agg(F.min_by(F.struct("sid", "n", "before"), F.struct(-F.col("w"), F.xxhash64("sid"))).alias("l"))
    pairs = weighed.join(leaders, "key").where("before <> l.before").select("sid", "n", F.col("l.sid").alias("other"), F.col("l.n").alias("other_n"))
    tested = released(promising(able(pairs, percent), meets, percent))
    sets = released(sets_of(docs, released(ends_of(tested)), words))
    edges = released(linked(tested, sets, percent))
    if known is not None:
        edges = released(edges.unionByName(known))
    near = near_labels(edges)
    rooted = weighed.join(near, weighed["sid"] == near["node"], "left").select("key", "sid", "n", F.coalesce("root", "sid").alias("root"))
    ends = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x <> y")
    open_ = released(rooted.join(ends.select("key", "m"), "key"))
    # where few are left their pairs are few too; a bucket of two has met its leader already
    small = open_.where(F.col("m").between(3, SMALL_BUCKET)).select("key", "sid", "n", "root")
    others = small.select("key", F.col("sid").alias("other"), F.col("n").alias("other_n"), F.col("root").alias("root2"))
    within = small.join(others, "key").where("sid < other AND root <> root2").select("sid", "n", "other", "other_n").distinct()
    held = released(open_.where(F.col("m") > SMALL_BUCKET).select("sid", "root", "n").distinct())
    across = within if held.isEmpty() else within.unionByName(prefix_pairs(released(sets_of(docs, released(held.join(meets.select("sid", "h"), "sid").select("sid", "h")), words)), held, percent))
    rest = released(promising(able(across, percent), meets, percent).join(tested, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return components(edges)
    return components(edges.union(released(linked(rest, released(sets_of(docs, released(ends_of(rest)), words)), percent))))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (and set_id, equal for equal sets).

    Texts are sets of ``words``-word shingles (A-Z in lower case; a shorter text is one
    shingle) and link at a Jaccard similarity of ``percent`` in a hundred or more, checked on
    their whole sets; component_id is the smallest doc_id that links reach. Candidates are
    missed with a probability of 6e-8 at 0.8, by their bands or their estimate.

    Null texts and texts without a word have no shingle, link with nothing, and are
    components of their own. Copies count once until the end: their rows then meet their
    component, those of a set that has over a thousandth of all rows by broadcast. Rows of a null doc_id get the smallest doc_id
    of their component, null if it has none; such a row is kept only in the latter case. Repeated rows each return a row. Other columns are ignored. An empty table gives no rows.
    """
    marked = released(signatures(docs, words))
    roots = similar_roots(docs, marked, words, percent)
    least = marked.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    rooted = least.join(roots, least["sid"] == roots["node"], "left").select("sid", "least", "m", F.coalesce("root", "sid").alias("root"))
    named = released(join_heavy(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")), "root", "sets").select("sid", "component_id", "m"))
    rows = marked.select("doc_id", F.col("n").alias("n_shingles"), "sid")
    found = join_heavy(rows.where("n_shingles > 0"), named, "sid", "m").unionByName(rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("sid").alias("set_id"))


#: Every set of four-word shingles, pairs by shared shingles, and the least doc_id that links reach.
ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents WHERE text IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, greatest(len(w) - 2, 2))]) AS g FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(node, least) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.y, r.least FROM reach r JOIN links l ON l.x = r.node WHERE r.least < l.y),
low AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON node = doc_id"""
