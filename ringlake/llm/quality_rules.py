"""Quality rules: text statistics, a base rule and a learned decision list. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlake.llm.common import checkpoint, crc_mod, labelled_sample

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: What the rules see: ratios, so that a rule means the same for short and long texts.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_line": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "CAST(n_words AS DOUBLE)",
}


def _count(text: Column, chars: str) -> Column:
    """Number of code points of ``text`` that are in the character class ``chars``; faster than translating the text."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more.

    Sorting (hash, place) puts equal windows side by side; the places that have an equal
    neighbour, in order, each cover up to WINDOW words that the one before doesn't.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeats(a: Column) -> Column:
        here = F.transform(a, lambda x: x["h"])
        # neighbours by shifted copies: no element is looked up by a computed place
        before = F.concat(F.array(F.lit(None).cast("long")), F.slice(here, 1, F.greatest(F.size(here) - 1, F.lit(0))))
        after = F.concat(F.slice(here, 2, F.size(here)), F.array(F.lit(None).cast("long")))
        flags = F.zip_with(before, after, lambda p, n: F.struct(p.alias("p"), n.alias("n")))
        kept = F.filter(F.zip_with(a, flags, lambda x, f: F.when(x["h"].eqNullSafe(f["p"]) | x["h"].eqNullSafe(f["n"]), x["i"])), lambda i: i.isNotNull())
        return F.array_sort(kept)

    places = F.transform(F.array(placed), repeats)
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"))
    return F.aggregate(F.element_at(places, 1), start, step, lambda s: s["n"])


def text_statistics(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and the statistics of each whole text, one row in, one row out, no shuffle.

    Null texts count as empty. Windows of a text are compared by 64-bit hashes.
    """
    text = docs.select(*[F.col(f"`{c}`") for c in carry], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    split = text.withColumn("__w", F.filter(F.split("__t", r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # each word is hashed once; windows of 2, 4 and 8 words hash two windows of half their size
    full = split.withColumn("__x", F.transform("__w", lambda w: F.xxhash64(w)))
    for half in (1, 2, 4):
        left = F.greatest(F.size("__x") - half, F.lit(0))
        full = full.withColumn("__x", F.zip_with(F.slice("__x", F.lit(1), left), F.slice("__x", F.lit(half + 1), left), lambda a, b: F.xxhash64(a, b)))
    repeated = F.size(F.array_distinct("__x")) < F.size("__x")
    return full.select(
        *[F.col(f"`{c}`") for c in carry],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _count(F.col("__t"), SYMBOLS).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("__x"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        _count(F.col("__t"), "A-Z").alias("n_upper"),
        _count(F.col("__t"), "!?").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Literal, ...]


def _matches(rule: Rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def _any(rules: Sequence[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | _matches(rule)
    return out


Cells = dict[str, list[tuple[int, int]]]


def _binned(labelled: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """The rows with one array column `cells`: for each feature the number of thresholds below its value."""

    def place(value: Column, cuts: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: value > t))

    cells = [F.struct(F.lit(f).alias("f"), place(F.expr(FEATURES[f]), cuts).alias("bin")) for f, cuts in thresholds.items() if cuts]
    return labelled.withColumn("cells", F.array(*cells) if cells else F.array().cast("array<struct<f:string,bin:int>>"))


def _counts(binned: DataFrame, thresholds: dict[str, list[float]]) -> Cells:
    """For each feature, (bad, good) rows in each interval between its thresholds: one Spark job."""
    rows = binned.select("bad", F.explode("cells").alias("c")).groupBy("c.f", "c.bin").agg(F.sum("bad"), F.sum(1 - F.col("bad"))).collect()
    out = {f: [(0, 0)] * (len(cuts) + 1) for f, cuts in thresholds.items()}
    for f, b, bad, good in rows:
        out[f][b] = (bad, good)
    return out


def _best(counts: Cells, thresholds: dict[str, list[float]], least: int, slack: float) -> tuple[Literal, int] | None:
    """The literal of the largest FOIL gain (bits saved on the bad rows that stay covered) and the good rows it covers.

    Of the thresholds of that feature and direction whose gain is within ``slack`` of the
    best, the middle one is taken: a cut right beside either class would overfit it.
    """
    found: dict[tuple[str, bool], list[tuple[float, float, int]]] = {}
    for f, cells in counts.items():
        all_bad, all_good = (sum(c[i] for c in cells) for i in (0, 1))
        before = log2(all_bad / (all_bad + all_good)) if all_bad else 0.0
        bad = good = 0
        for t, (b, g) in zip(thresholds[f], cells):
            bad, good = bad + b, good + g
            for above, p, n in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                if p >= least:
                    found.setdefault((f, above), []).append((p * (log2(p / (p + n)) - before), t, n))
    if not found:
        return None
    f, above = max(found, key=lambda k: (max(found[k])[0], k))
    top = max(found[f, above])[0]
    if top <= 1e-6:
        return None
    near = sorted((t, n) for gain, t, n in found[f, above] if gain >= (1 - slack) * top)
    t, n = near[len(near) // 2]
    return Literal(f, above, t), n


def learn_rules(labelled: DataFrame, max_rules: int = 6, max_literals: int = 3, bins: int = 32, precision: float = 0.9, least: int = 5, slack: float = 0.1) -> list[Rule]:
    """An ordered list of threshold conjunctions that mark bad rows, by sequential covering.

    ``labelled`` has the statistics, ``bad`` (0 or 1) and ``grow`` (boolean, about two
    thirds). A rule grows on the growing rows, literal by literal, by FOIL gain, and is
    pruned on the others: its last literals go while (bad - good) / (bad + good) doesn't
    fall. It enters the list if its precision there reaches ``precision``; the rows it covers
    leave both sets. Learning ends at the first rule that fails or when no bad rows remain.
    Rows never leave Spark: each step reads one table of counts.
    """
    rows = checkpoint(labelled)
    points = [i / bins for i in range(1, bins)]
    # candidates from both classes: bad rows are rare, and their own quantiles separate them
    cuts = [F.percentile_approx(F.when(F.col("bad") == k, F.expr(e)), points, 10000).alias(f"{f}_{k}") for f, e in FEATURES.items() for k in (0, 1)]
    found = rows.agg(*cuts).first()
    thresholds = {f: sorted({float(f"{x:.4g}") for k in (0, 1) for x in (found[f"{f}_{k}"] or [])}) for f in FEATURES}
    rows = checkpoint(_binned(rows, thresholds))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where(~_any(rules))
        rule: Rule = ()
        while len(rule) < max_literals:
            best = _best(_counts(left.where("grow").where(_matches(rule)), thresholds), thresholds, least, slack)
            if best is None:
                break
            rule = (*rule, best[0])
            if best[1] == 0:
                break
        if not rule:
            break
        sums = [x for i in range(1, len(rule) + 1) for x in (F.sum((_matches(rule[:i])).cast("int") * F.col("bad")), F.sum((_matches(rule[:i])).cast("int") * (1 - F.col("bad"))))]
        got = [x or 0 for x in left.where("NOT grow").agg(*sums).first()]
        scored = [((p - n) / (p + n) if p + n else -1.0, -i, p, n) for i, (p, n) in enumerate(zip(got[::2], got[1::2]), 1)]
        _, i, p, n = max(scored)
        if p < max(1, least // 2) or p < precision * (p + n):
            break
        rules.append(rule[:-i])
    return rules


def rules_column(rules: Sequence[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, else 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(_matches(rule), i) if out is None else out.when(_matches(rule), i)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_statistics(docs: DataFrame, labels: DataFrame, per_class: int = 10_000) -> DataFrame:
    """Statistics of a sample of the labelled documents that pass the base rule, with ``bad`` and ``grow``.

    About ``per_class`` documents of quality 0 and as many of quality 1, chosen by the hash
    of their id; all of a class that has fewer.
    """
    sample = labelled_sample(docs, labels, "quality", per_class, "quality sample")
    passed = text_statistics(sample, carry=("doc_id", "quality")).withColumn("__row", F.monotonically_increasing_id())
    passed = passed.where(~base_failed() & (F.col("__row") >= 0)).drop("__row")
    return passed.withColumn("bad", 1 - F.col("quality")).withColumn("grow", crc_mod(F.col("doc_id"), 3) != 0)


def judge(statistics: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds base_failed, rule (number of the first rule that holds, 0 for none) and kept."""
    return statistics.withColumn("base_failed", base_failed()).withColumn("rule", rules_column(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ("doc_id",), per_class: int = 10_000, **options) -> DataFrame:
    """One row per document: ``carry`` columns, its statistics, base_failed, rule and kept.

    The list is learned from a bounded sample of the labelled documents and then applied to
    all in one pass over the texts, without a shuffle. Null texts count as empty (and fail
    the base rule); repeated rows each return a row; rows of a null doc_id are judged but
    never learned from; without labels the list is empty. Other columns are ignored.
    """
    rules = learn_rules(labelled_statistics(docs, labels, per_class), **options)
    return judge(text_statistics(docs, carry), rules)


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the base rule and the learned list keep; all columns.

    The row number keeps the filter above the statistics: pushed below them, each use of a
    statistic would compute it again.
    """
    judged = quality(docs, labels, carry=docs.columns, **options).withColumn("__row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
