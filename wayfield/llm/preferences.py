"""Chat formatting of preference pairs.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (same role, same text)
is rendered once, as the prompt; what follows in each is rendered as its completion. Completions are lists of
parts with a flag: the loss counts the assistant's words and their end mark, not headers and other roles' turns.

Cases: a null role is ``unknown`` and a null text is empty; turns are ordered by number (null last), then role and
text, so repeated rows are turns of their own; rows without a conv_id take no part; a pair of equal conversations has
them as prompt and empty completions; an empty table gives an empty result. A training example is one row, so a
conversation's turns are gathered in one row; nothing else is. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm.shared import running_sum, table
from wayfield.sources.scratch import Scratch

END = "<|end|>\n"


def gathered(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as structs ``role, text``."""
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(turn))
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns that two conversations have in common from the start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def masked(turns: Column) -> Column:
    """Parts ``text, loss`` of a completion."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_header(t).alias("text"), F.lit(False).alias("loss")),
        F.struct(F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == "assistant").alias("loss")))))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``prefix_turns, prompt, chosen, rejected`` for ``pairs`` with turns in ``chosen`` and ``rejected``; other columns stay."""
    others = [c for c in pairs.columns if c not in ("chosen", "rejected", "prefix_turns", "prompt")]
    n = F.col("__prefix")
    rest = lambda c: masked(F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0))))
    known = pairs.withColumn("__prefix", common_prefix(F.col("chosen"), F.col("rejected")))
    return known.select(*others, n.alias("prefix_turns"), rendered(F.slice("chosen", F.lit(1), n)).alias("prompt"),
                        rest(F.col("chosen")).alias("chosen"), rest(F.col("rejected")).alias("rejected"))


def paired_by_opening(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, other, chosen, rejected``: each conversation, and what it would be with another's last answer.

    Conversations are numbered by their first turn and id and paired in that order, so those that open alike answer
    each other; the last one of an odd number has its predecessor as other. ``rejected`` has the last assistant turn of the other in place of the own one. Conversations
    without an assistant turn take no part; a single one has no pair.
    """
    whole = gathered(turns)
    answers = F.transform(F.col("turns"), lambda t: t["role"] == "assistant")
    last = F.size("turns") - F.array_position(F.reverse(answers), True)
    convs = scratch.save(whole.where(F.array_contains(answers, True)).select(
        "conv_id", "turns", last.cast("int").alias("last"), F.md5(F.concat(F.col("turns")[0]["role"], F.lit("\n"), F.col("turns")[0]["text"])).alias("opening")), "turns")
    numbered = scratch.save(running_sum(convs.select("conv_id", "opening", F.lit(1).alias("one")), [], ["opening", "conv_id"], "one", scratch, "number"), "numbered")
    highest = numbered.agg(F.max("number")).first()[0] or 0
    across = F.col("number").bitwiseXOR(F.lit(1))
    mates = numbered.select("conv_id", F.when(across > highest, F.col("number") - 1).otherwise(across).alias("mate")).join(
        numbered.select(F.col("conv_id").alias("other"), F.col("number").alias("mate")), "mate")
    answer = convs.select(F.col("conv_id").alias("other"), F.element_at("turns", F.col("last") + 1)["text"].alias("answer"))
    rejected = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("last"), F.col("answer")).otherwise(t["text"]).alias("text")))
    return (mates.drop("mate").join(answer, "other").join(convs.select("conv_id", "turns", "last"), "conv_id")
            .select("conv_id", "other", F.col("turns").alias("chosen"), rejected.alias("rejected")))


def op8_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = format_preferences(paired_by_opening(table(spark, sf_dir, "conversations"), Scratch(spark, "preferences")))
    text = lambda c: F.array_join(F.transform(c, lambda p: p["text"]), "")
    trained = lambda c: F.length(F.array_join(F.transform(F.filter(c, lambda p: p["loss"]), lambda p: p["text"]), ""))
    return formatted.select("conv_id", "other", "prefix_turns", "prompt", text("chosen").alias("chosen"), text("rejected").alias("rejected"),
                            trained("chosen").alias("chosen_trained"), trained("rejected").alias("rejected_trained"))


OP8_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn IS NULL, turn, coalesce(role, 'unknown'), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, count(*) AS turns, max(n) FILTER (role = 'assistant') AS last, md5(max(role || chr(10) || text) FILTER (n = 1)) AS opening
  FROM turns GROUP BY conv_id),
numbered AS (SELECT *, row_number() OVER (ORDER BY opening, conv_id) - 1 AS number FROM convs WHERE last IS NOT NULL),
pairs AS (SELECT a.conv_id, b.conv_id AS other, a.last, b.last AS other_last FROM numbered a JOIN numbered b ON b.number = xor(a.number, 1)),
sides AS (
  SELECT p.conv_id, p.other, t.n, t.role, t.text AS chosen, CASE WHEN t.n = p.last THEN o.text ELSE t.text END AS rejected
  FROM pairs p JOIN turns t ON t.conv_id = p.conv_id JOIN turns o ON o.conv_id = p.other AND o.n = p.other_last),
prefixes AS (SELECT conv_id, coalesce(min(n) FILTER (chosen <> rejected) - 1, count(*)) AS p FROM sides GROUP BY conv_id)
SELECT b.conv_id, any_value(b.other) AS other, any_value(p.p)::INTEGER AS prefix_turns,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || chosen || '<|end|>' || chr(10), '' ORDER BY n) FILTER (n <= p.p), '') AS prompt,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || chosen || '<|end|>' || chr(10), '' ORDER BY n) FILTER (n > p.p), '') AS chosen,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || rejected || '<|end|>' || chr(10), '' ORDER BY n) FILTER (n > p.p), '') AS rejected,
  coalesce(sum(length(chosen) + 8) FILTER (n > p.p AND role = 'assistant'), 0)::INTEGER AS chosen_trained,
  coalesce(sum(length(rejected) + 8) FILTER (n > p.p AND role = 'assistant'), 0)::INTEGER AS rejected_trained
FROM sides b JOIN prefixes p USING (conv_id) GROUP BY b.conv_id
"""
