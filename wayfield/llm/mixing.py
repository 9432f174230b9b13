"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; they share ``share`` times the
words of all documents by weight. No target exceeds ``most`` times its source's words; what is above is
shared again by weight. A source's documents are taken in the order of a hash of their ids: whole epochs
first, then documents up to the exact word at which the target (rounded down) is met.

Cases: null and empty texts have size 0 and are never taken; a null source is a source of its own; rows
that repeat a doc_id are separate documents; an empty table gives an empty result. Only ``doc_id``,
``text`` and ``source`` are read; the others are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfield.llm.shared import WORD, running_sum, table, words_in
from wayfield.sources.scratch import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
                   scratch: Scratch | None = None) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources are numbered by a distributed ranking. The level up to which targets are not capped is
    found in rounds; each is one aggregate of three numbers, however many sources there are.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "targets")
    one = sizes.select("source", "source_size", F.col("source").isNull().alias("_last"), F.lit(1).alias("_one"))
    ranked = running_sum(one, [], ["_last", "source"], "_one", scratch, "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = scratch.save(ranked.select("source", "source_size", weight.alias("w")), "weights")
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        cap = F.col("source_size") * float(most)
        capped = cap < F.col("w") * F.lit(level)
        held, free = weighed.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(~capped, F.col("w")).otherwise(0.0))).first()
        now = (total - held) / free if free else level
        if now <= level:
            break
        level = now
    target = F.least(F.col("source_size") * float(most), F.col("w") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
                seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source)``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    # Written once, as a range sort reads its input twice and the words are dear to count.
    sized = scratch.save(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"),
                                     F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-" + seed))).alias("_key")), "sizes")
    placed = scratch.save(running_sum(sized, ["source"], ["_key", "doc_id", "size"], "size", scratch, "before"), "placed")
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, scratch)
    targets = targets.withColumnRenamed("source", "_source")
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["_source"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its ``n``-th word and the white space behind it, without white space in front."""
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    rest = F.try_element_at(F.split(bare, r"[\x20\x09-\x0D]+", n.cast("int") + 1), n.cast("int") + 1)
    return F.substring(bare, F.lit(1), F.length(bare) - F.coalesce(F.length(rest), F.lit(0)))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice stands twice, one taken in part has its first words only.

    ``doc_id`` must be unique here. Other columns stay, but ``n_chars`` follows the text.
    """
    mixed = mix_sources(docs, **options).where("taken > 0").select(F.col("doc_id").alias("__doc"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    joined = docs.join(mixed, F.col("doc_id") == F.col("__doc"))
    times = joined.withColumn("__time", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")))))
    own = F.least(F.col("__size"), F.col("__taken") - (F.col("__time") - 1) * F.col("__size"))
    text = F.when(own < F.col("__size"), first_words(F.col("text"), own)).otherwise(F.col("text"))
    out = times.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*docs.columns)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '-mix-1') AS k FROM documents),
placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before,
         (sum(size) OVER (PARTITION BY source))::BIGINT AS source_size FROM sized),
sources AS (
  SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM (SELECT DISTINCT source, source_size FROM placed)),
total AS (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE AS t FROM sources),
levels AS (
  SELECT 0 AS round, -1.0::DOUBLE AS was, 0.0::DOUBLE AS level
  UNION ALL
  SELECT round + 1, level, coalesce((SELECT (t - coalesce(sum(CASE WHEN source_size * 2.0::DOUBLE < w * level THEN source_size * 2.0::DOUBLE END), 0))
                    / nullif(coalesce(sum(CASE WHEN NOT source_size * 2.0::DOUBLE < w * level THEN w END), 0), 0) FROM sources, total GROUP BY t), level)
  FROM levels WHERE level > was),
targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, w * (SELECT max(level) FROM levels)) AS target FROM sources)
SELECT p.doc_id, p.size, p.source_size, t.target,
  (CASE WHEN p.source_size > 0 THEN floor(floor(t.target) / p.source_size)::BIGINT ELSE 0 END * p.size
   + greatest(0, least(p.size, floor(t.target)::BIGINT
       - CASE WHEN p.source_size > 0 THEN floor(floor(t.target) / p.source_size)::BIGINT ELSE 0 END * p.source_size - p.before)))::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""
