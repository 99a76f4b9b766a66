"""Temperature mixing of sources, in DataFrame operations only.

Weights are ``w_s ~ share_s ** alpha`` over the sources' token shares.  ``alpha`` is bisected so that the mixture
reaches a target entropy, or stays within a repetition limit, whichever asks for the larger exponent.  The weights
are then realised as block permutations: every source gets its token budget in whole passes plus one partial pass,
and every block of the stream holds all sources in proportion, in an order of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: 15 hexadecimal digits of an md5 are kept as the hash of a row.
HASH_RANGE = float(16 ** 15)
ALPHA_DIGITS = 6
STEPS = 32


def row_hash(*parts: Column) -> Column:
    """A uniform integer below 16**15 from the parts' text (null counts as '')."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bisect(check, low: float = 0.0, high: float = 1.0) -> float:
    """The smallest exponent, to ``ALPHA_DIGITS`` places, from which ``check`` holds (``high`` if none below does)."""
    if check(low):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if check(middle) else (middle, high)
    return round(high, ALPHA_DIGITS)


def choose_alpha(sources: DataFrame, budget_ratio: float, target_entropy: float | None,
                 max_epochs: float | None) -> float:
    """The exponent for ``sources`` (tokens > 0).  Each trial is one aggregation over the source table; only its
    sums reach the driver.  ``target_entropy`` is a share of the greatest possible entropy: the exponent is the
    largest that still reaches it.  ``max_epochs`` bounds how often a source may repeat: the exponent is at least
    the smallest that keeps it."""
    total, n = sources.agg(F.sum("tokens").cast("double"), F.count("*")).first()
    if not total:
        return 1.0
    share = F.col("tokens") / F.lit(total)

    def sums(alpha: float):
        power = F.pow(share, F.lit(alpha))
        return sources.agg(F.sum(power).alias("z"), F.sum(power * F.ln(share)).alias("e"),
                           F.max(F.pow(share, F.lit(alpha - 1.0))).alias("top")).first()

    def flat_enough_no_more(alpha: float) -> bool:  # entropy at or below the target
        s = sums(alpha)
        entropy = math.log(s["z"]) - alpha * s["e"] / s["z"]
        return entropy <= target_entropy * math.log(float(n))

    def within_limit(alpha: float) -> bool:
        s = sums(alpha)
        return budget_ratio * s["top"] / s["z"] <= max_epochs

    if max_epochs is not None and budget_ratio > max_epochs:
        raise ValueError(f"no mixture of {budget_ratio} times all tokens repeats every source at most {max_epochs} times")
    if n < 2:
        return 1.0
    alpha = 0.0
    if target_entropy is not None:
        alpha = max(alpha, bisect(flat_enough_no_more))
    if max_epochs is not None:
        alpha = max(alpha, bisect(within_limit))
    return alpha


def mixing_plan(tokens: DataFrame, budget_ratio: float = 1.0, target_entropy: float | None = 0.95,
                max_epochs: float | None = 4.0, bucket_rows: int = 1_000) -> DataFrame:
    """Per source of ``tokens`` (source, tokens, u = row hash): tokens, weight, target_tokens, epochs, whole passes and
    ``cut``: rows with a hash below it join the partial pass, and ``take`` of the ``copies`` rows that have it.

    The cut is the first row, in hash order, at which the source's remaining budget is reached.  Equal rows are counted
    first, so a row that repeats is one.  Hash buckets of about ``bucket_rows`` rows are summed next; only the one bucket
    of each source that holds the cut is ordered.
    """
    sources = written(tokens.where("tokens > 0").groupBy("source")
                      .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    alpha = choose_alpha(sources, budget_ratio, target_entropy, max_epochs)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    plan = sources.select("source", "tokens", "docs", weight.alias("weight"),
                          F.floor(weight * F.lit(float(total) * budget_ratio) + 0.5).alias("target_tokens"))
    if max_epochs is not None:  # rounding does not pass the limit
        plan = plan.withColumn("target_tokens", F.least("target_tokens", F.floor(F.col("tokens") * F.lit(float(max_epochs)))))
    plan = plan.withColumn("epochs", F.col("target_tokens") / F.col("tokens"))
    plan = plan.withColumn("rest", F.col("target_tokens") % F.col("tokens"))
    plan = plan.withColumn("passes", ((F.col("target_tokens") - F.col("rest")) / F.col("tokens")).cast("long"))
    plan = written(plan.withColumn("buckets", F.ceil(F.col("docs") / F.lit(float(bucket_rows)))), "plan")

    bucket = F.floor(F.col("u") / F.lit(HASH_RANGE) * F.col("buckets"))
    once = tokens.where("tokens > 0").groupBy("source", "u", F.col("tokens").alias("doc_tokens")).agg(F.count("*").alias("copies"))
    rows = with_plan(once, plan).select("source", "u", "doc_tokens", "copies", "rest", bucket.alias("bucket"))
    held = F.col("doc_tokens") * F.col("copies")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (rows.groupBy("source", "bucket").agg(F.sum(held).alias("own"), F.first("rest").alias("rest"))
            .withColumn("before", F.coalesce(F.sum("own").over(upto), F.lit(0)))
            .where("before < rest and before + own >= rest").select("source", "bucket", "before"))
    sums = written(sums, "cut_buckets")  # one row per source at most
    ordered = Window.partitionBy("source").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (rows.join(sums, ["source", "bucket"])
            .withColumn("ahead", F.col("before") + F.coalesce(F.sum(held).over(ordered), F.lit(0)))
            .where("ahead < rest").withColumn("take", F.least("copies", F.ceil((F.col("rest") - F.col("ahead")) / F.col("doc_tokens"))))
            .groupBy("source").agg(F.max("u").alias("cut"), F.max_by("take", "u").alias("take"), F.max_by("copies", "u").alias("copies")))
    return written(plan.join(cuts, "source", "left")
                   .select("source", "tokens", "weight", "target_tokens", "epochs", "passes",
                           F.when(F.col("rest") <= 0, F.lit(-1)).otherwise(F.coalesce("cut", F.lit(16 ** 15)))
                           .alias("cut"), F.coalesce("take", F.lit(1)).alias("take"), F.coalesce("copies", F.lit(1)).alias("copies")), "plan")


def with_plan(rows: DataFrame, plan: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """``rows`` joined to their source's plan row: by broadcast where the counted plan is small, else by a sort-merge
    join whose hot sources the adaptive planner splits."""
    return rows.join(F.broadcast(plan) if plan.count() <= broadcast_rows else plan, "source")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with the equal rows at their source's cut numbered from 1 in ``copy``: by their place in the written part
    and the counts of the parts before it, so no task needs them all."""
    at = F.col("u") == F.col("cut")
    place = F.monotonically_increasing_id()
    ends = written(rows.where(at).withColumn("place", place), "cut_rows")
    ends = ends.withColumn("part", F.shiftrightunsigned("place", 33))
    parts = ends.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("ahead", F.sum("n").over(before) - F.col("n")).select("source", "part", "ahead")
    inside = Window.partitionBy("source", "part").orderBy("place")
    ends = ends.withColumn("copy", F.row_number().over(inside)).join(parts, ["source", "part"])
    ends = ends.withColumn("copy", (F.col("copy") + F.col("ahead")).cast("long"))
    return rows.where(~at).unionByName(ends.select(*rows.columns))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                budget_ratio: float = 1.0, target_entropy: float | None = 0.95, max_epochs: float | None = 4.0,
                block_tokens: int = 250_000, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """The mixed stream: a row per document and pass, with the columns ``keep`` of ``docs`` (default: the id alone),
    source, n_tokens, pass, block and rank (from 1, the order within the block).

    The budget is ``budget_ratio`` times all tokens (words between ASCII white space).  Each source's budget is met
    to within one document.  A null source counts as ''.  Documents without words hold no tokens and take no part.
    Rows with the same id and text share a hash, and as many of them as the budget asks for join the partial pass.  A
    budget of more than ``max_epochs`` times all tokens raises an error.  Empty tables give an empty stream.
    """
    keep = [id_col] if keep is None else keep
    text = text_or_empty(text_col)
    held = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    base = docs.select(
        *held, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        row_hash(F.lit(seed), F.col(id_col), F.md5(text)).alias("u"))
    if keep == [id_col]:
        base = written(base, "tokens")
        tokens = base.select("source", "tokens", "u")
    else:
        tokens = written(base.select("source", "tokens", "u"), "tokens")
    plan = mixing_plan(tokens, budget_ratio, target_entropy, max_epochs)
    budget = plan.agg(F.sum("target_tokens")).first()[0] or 0.0
    blocks = max(1, math.ceil(budget / block_tokens))
    rows = with_plan(base.where("tokens > 0").withColumnRenamed("tokens", "n_tokens"), plan.drop("tokens"))
    rows = rows.withColumn("copy", F.lit(1).cast("long"))
    if plan.where("take < copies").limit(1).count():  # some source ends among equal rows
        rows = numbered(rows)
    partial = (F.col("u") < F.col("cut")) | ((F.col("u") == F.col("cut")) & (F.col("copy") <= F.col("take")))
    times = F.col("passes") + F.when(partial, 1).otherwise(0)
    rows = rows.withColumn("times", times.cast("int")).where("times > 0")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times"))))
    place = (F.col("pass") - 1 + F.col("u") / F.lit(HASH_RANGE)) / F.col("epochs")
    rows = rows.withColumn("block", F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("long"))
    rows = rows.withColumn("turn", row_hash(F.lit(seed), F.col("block"), F.col("pass"), F.col("u")))
    order = Window.partitionBy("block").orderBy("turn", "pass", "u", "copy")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    out = [c for c in keep if c != source_col]
    return rows.select(*[F.col(f"k{keep.index(c)}").alias(c) for c in out], F.col("source").alias(source_col),
                       "n_tokens", "pass", "block", "rank")


#: The same stream in DuckDB: a plain bisection, and one running sum per source.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15)
      AS BIGINT) AS u FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, sum(sum(n_tokens)) OVER () AS total,
        count(*) OVER () AS n FROM t WHERE n_tokens > 0 GROUP BY source),
b(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT step, lo, hi, (SELECT ln(sum(pow(tokens / total, (lo + hi) / 2)))
          - (lo + hi) / 2 * sum(pow(tokens / total, (lo + hi) / 2) * ln(tokens / total))
            / sum(pow(tokens / total, (lo + hi) / 2)) <= 0.95 * ln(max(n)) FROM s) AS ok FROM b WHERE step < 32)),
a AS (SELECT CASE WHEN (SELECT ln(count(*)) <= 0.95 * ln(count(*)) FROM s) THEN 0.0
        ELSE (SELECT round(hi, 6) FROM b WHERE step = 32) END AS alpha),
w AS (SELECT source, tokens, total, pow(tokens / total, alpha) / sum(pow(tokens / total, alpha)) OVER () AS weight
      FROM s, a),
g AS (SELECT source, CAST(tokens AS BIGINT) AS tokens, CAST(floor(weight * total + 0.5) AS BIGINT) AS target FROM w),
p AS (SELECT source, tokens, target, target / CAST(tokens AS DOUBLE) AS epochs, target // tokens AS passes,
        target % tokens AS rest FROM g),
c AS (SELECT t.*, target, epochs, passes, rest, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY u
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM t JOIN p USING (source) WHERE n_tokens > 0),
k AS (SELECT greatest(1, ceil((SELECT sum(target) FROM p) / 250000)) AS blocks),
e AS (SELECT doc_id, source, n_tokens, u, epochs,
        unnest(range(1, CAST(passes AS BIGINT) + CASE WHEN ahead < rest THEN 1 ELSE 0 END + 1)) AS pass FROM c),
f AS (SELECT *, CAST(least(floor((pass - 1 + u / 1152921504606846976.0) / epochs * blocks), blocks - 1) AS BIGINT)
        AS block FROM e, k)
SELECT doc_id, source, n_tokens, CAST(pass AS INTEGER) AS pass, block, row_number() OVER (PARTITION BY block ORDER BY
  CAST('0x' || substr(md5('7:' || block || ':' || pass || ':' || u), 1, 15) AS BIGINT), pass, u) AS rank FROM f
"""
