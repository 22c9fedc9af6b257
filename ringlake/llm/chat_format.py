"""Preference formatting: common turn prefix as prompt, paired masked completions. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _render(turn: Column) -> Column:
    """One turn as text; a null role is `unknown`, a null text is empty."""
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """`begin-end` code point ranges, comma-joined, of what a loss counts: assistant content with its end mark."""

    def add(state: Column, turn: Column) -> Column:
        stop = state["at"] + F.length(_render(turn))
        body = F.length(F.coalesce(turn["text"], F.lit(""))) + len(CLOSE)
        span = F.concat(F.when(F.length(state["spans"]) > 0, F.lit(",")).otherwise(F.lit("")), (stop - body).cast("string"), F.lit("-"), stop.cast("string"))
        spans = F.when(turn["role"].eqNullSafe(F.lit("assistant")), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")), add, lambda s: s["spans"])


def preference_examples(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One training example per pair (pair_id, chosen_id, rejected_id) of conversations.

    ``turns`` has conv_id, turn, role, text; turns of a conversation come in order of turn,
    then role, then text, nulls first. The longest common prefix of (role, text) is rendered
    once as ``prompt``; what follows it is ``chosen`` and ``rejected``, each with the spans
    that a loss counts. Two equal conversations have empty completions; of a conversation
    and its own beginning one completion is empty.

    Pairs of which a conversation has no turns, and null ids, give no row; repeated turns
    are turns; other columns are ignored. An example is as long as its conversations and
    holds nothing else, so grouping moves each turn once.
    """
    members = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen_id").alias("id"), F.lit(True).alias("is_chosen")), F.struct(F.col("rejected_id").alias("id"), F.lit(False).alias("is_chosen")))).alias("m")).select("pair_id", "m.id", "m.is_chosen")
    own = turns.select("conv_id", F.struct("turn", "role", "text").alias("t")).where("conv_id IS NOT NULL")
    joined = members.join(own, members["id"] == own["conv_id"])

    def side(chosen: bool) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("is_chosen") == chosen, F.col("t"))), _order)

    both = joined.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r")).where("size(c) > 0 AND size(r) > 0")
    return _rendered(both)


def _rendered(both: DataFrame) -> DataFrame:
    """Examples from (pair_id, c, r): the turns of both sides in order; their common prefix is rendered once."""
    least = F.least(F.size("c"), F.size("r"))
    shared = F.zip_with(F.slice("c", 1, least), F.slice("r", 1, least), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    both = both.withColumn("n", F.coalesce(F.nullif(F.array_position(shared, False), F.lit(0)) - 1, F.size(shared)).cast("int"))
    rest = {x: F.slice(x, F.col("n") + 1, F.size(x)) for x in "cr"}
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_prefix"), _text(F.slice("c", 1, F.col("n"))).alias("prompt"),
        _text(rest["c"]).alias("chosen"), _mask(rest["c"]).alias("chosen_spans"),
        _text(rest["r"]).alias("rejected"), _mask(rest["r"]).alias("rejected_spans"),
    )


def _order(x: Column, y: Column) -> Column:
    """Order of turns: by turn, role, text, nulls first."""
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Conversation 2k as chosen, 2k + 1 as rejected, for tables that hold both sides of each preference."""
    ids = turns.where("conv_id IS NOT NULL").select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id")).distinct()
    return ids.select("pair_id", F.shiftleft("pair_id", 1).alias("chosen_id"), (F.shiftleft("pair_id", 1) + 1).alias("rejected_id"))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """One example for each conversation with an assistant turn, for tables that have no preferences.

    Chosen is the conversation up to its last assistant turn; rejected is what comes before
    that turn, answered by the last assistant turn of conversation ``conv_id`` XOR 1, so both
    share all but the reply. Where that conversation has no such turn, or a null one, the
    rejected reply is empty. pair_id is conv_id; turns are ordered as in `preference_examples`.

    Turns after the last reply have no other side and are left out; conversations without an
    assistant turn, and null ids, have no reply to prefer and give no row. If both replies are
    equal, the whole is prompt and completions are empty. Other columns are ignored; an empty
    table gives no rows.
    """
    own = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("pair_id"), F.struct("turn", "role", "text").alias("t"))
    replies = own.where(F.col("t.role") == "assistant").groupBy("pair_id").agg(F.max("t").alias("m"))
    others = replies.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("of"), F.col("m.text").alias("other"))
    whole = own.groupBy("pair_id").agg(F.array_sort(F.collect_list("t"), _order).alias("a"))
    from_end = F.array_position(F.transform(F.reverse("a"), lambda x: x["role"].eqNullSafe(F.lit("assistant"))), True)
    cut = whole.withColumn("last", (F.size("a") + 1 - from_end).cast("int")).where(from_end > 0)
    joined = cut.join(others, F.col("pair_id") == F.col("of"), "left")
    reply = F.struct(F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    return _rendered(joined.select("pair_id", F.slice("a", 1, F.col("last")).alias("c"), F.concat(F.slice("a", 1, F.col("last") - 1), F.array(reply)).alias("r")))


ORACLE = f"""
WITH turns AS (
  SELECT conv_id AS pair_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
lasts AS (SELECT pair_id, max(pos) AS stop FROM turns WHERE role = 'assistant' GROUP BY pair_id),
replies AS (SELECT pair_id, stop, text FROM turns JOIN lasts USING (pair_id) WHERE pos = stop),
sides AS (
  SELECT pair_id, true AS is_chosen, pos, role, text FROM turns JOIN lasts USING (pair_id) WHERE pos <= stop
  UNION ALL SELECT pair_id, false, pos, role, text FROM turns JOIN lasts USING (pair_id) WHERE pos < stop
  UNION ALL SELECT o.pair_id, false, o.stop, 'assistant', coalesce(x.text, '')
  FROM replies o LEFT JOIN replies x ON x.pair_id = xor(o.pair_id, 1)),
lines AS (
  SELECT *, '{OPEN}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line,
    length(coalesce(text, '')) + {len(CLOSE)} AS body
  FROM sides),
prefixes AS (
  SELECT pair_id, coalesce(min(c.pos) FILTER (c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) - 1, max(c.pos))::BIGINT AS n_prefix
  FROM (SELECT * FROM sides WHERE is_chosen) c JOIN (SELECT * FROM sides WHERE NOT is_chosen) r USING (pair_id, pos) GROUP BY pair_id),
rest AS (
  SELECT l.*, n_prefix, pos > n_prefix AS after,
    sum(CASE WHEN pos > n_prefix THEN length(line) ELSE 0 END) OVER (PARTITION BY pair_id, is_chosen ORDER BY pos)::BIGINT AS stop
  FROM lines l JOIN prefixes USING (pair_id))
SELECT pair_id::BIGINT AS pair_id, n_prefix,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (is_chosen AND NOT after), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (is_chosen AND after), '') AS chosen,
  coalesce(string_agg((stop - body) || '-' || stop, ',' ORDER BY pos) FILTER (is_chosen AND after AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT is_chosen AND after), '') AS rejected,
  coalesce(string_agg((stop - body) || '-' || stop, ',' ORDER BY pos) FILTER (NOT is_chosen AND after AND role = 'assistant'), '') AS rejected_spans
FROM rest GROUP BY pair_id, n_prefix
"""
