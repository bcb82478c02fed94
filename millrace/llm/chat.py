"""Preference pairs as one prompt and two masked completions, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The role whose turns are learned.
TRAINED = "assistant"

_TURN = "array<struct<turn:bigint,role:string,text:string>>"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column) -> Column:
    """Code point ranges of the rendered turns that are learned: trained texts and their end marks."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        low = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        high = low + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(low.cast("bigint").alias("start"), high.cast("bigint").alias("end")))
        return F.struct((high + 1).cast("bigint").alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def preference_pairs(turns: DataFrame, pair: Column, is_chosen: Column) -> DataFrame:
    """One row a pair: ``pair_id``, ``n_prompt_turns``, ``prompt`` and, for ``chosen`` and
    ``rejected``, the rendered completion and its learned ranges (``*_mask``).

    ``turns`` has ``turn``, ``role`` and ``text``; ``pair`` numbers the pair of a row and
    ``is_chosen`` tells its side. The prompt holds the longest prefix of turns with equal
    role and text on both sides; what follows it on each side is that side's completion.
    Turns go by ``turn``, then role, then text; repeated rows are turns of their own. A null
    role or text counts as empty and a null turn comes first; rows without a pair or a side
    take no part. A pair with one side only has an empty prompt and null for the other
    side. One shuffle, by pair; a row of the result is as large as its two conversations.
    """
    rows = turns.select(
        pair.cast("bigint").alias("pair_id"),
        is_chosen.alias("__chosen"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    ).filter(F.col("pair_id").isNotNull() & F.col("__chosen").isNotNull())
    both = rows.groupBy("pair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("__chosen") == side, F.col("t")))).alias(name) for name, side in (("c", True), ("r", False))))
    # The first place at which the sides differ; the shorter side's end differs too.
    same = lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    equal = F.zip_with("c", "r", lambda x, y: F.coalesce(same(x, y), F.lit(False)))
    both = both.withColumn("n", F.coalesce(F.array_position(equal, F.lit(False)) - 1, F.lit(0)))
    both = both.withColumn("n", F.when(F.array_position(equal, F.lit(False)) == 0, F.size("c")).otherwise(F.col("n")).cast("int"))
    rest = {k: F.slice(F.col(k), F.col("n") + 1, F.greatest(F.size(k) - F.col("n"), F.lit(0))) for k in ("c", "r")}
    out = both.select("pair_id", F.col("n").cast("bigint").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), *(F.when(F.size(k) > 0, rest[k]).alias(k) for k in ("c", "r")))
    return out.select(
        "pair_id", "n_prompt_turns", _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
        _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"),
    )


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(spans)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k is chosen over conversation 2k + 1."""
    turns = table(spark, sf_dir, "conversations")
    out = preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    return out.withColumns({c: _listed(c) for c in ("chosen_mask", "rejected_mask")})


#: The same in DuckDB's SQL.
OP7_SQL = f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, turn,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, is_chosen ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
sized AS (SELECT pair_id, count(*) FILTER (is_chosen) AS nc, count(*) FILTER (NOT is_chosen) AS nr FROM n GROUP BY pair_id),
differ AS (
  SELECT pair_id, min(k) AS k FROM (
    SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k,
           coalesce(a.role = b.role AND a.text = b.text, false) AS same
    FROM (SELECT * FROM n WHERE is_chosen) a FULL JOIN (SELECT * FROM n WHERE NOT is_chosen) b
      ON a.pair_id = b.pair_id AND a.k = b.k)
  WHERE NOT same GROUP BY pair_id),
p AS (SELECT s.pair_id, s.nc, s.nr, coalesce(d.k - 1, s.nc) AS n FROM sized s LEFT JOIN differ d USING (pair_id)),
r AS (
  SELECT n.*, p.n AS np, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS shown,
         {len(OPEN)} + length(role) + 1 AS head
  FROM n JOIN p USING (pair_id)),
o AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, is_chosen ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low
  FROM r WHERE k > np)
SELECT p.pair_id, p.n::BIGINT AS n_prompt_turns,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM r WHERE r.pair_id = p.pair_id AND is_chosen AND k <= p.n), '') AS prompt,
  CASE WHEN nc > 0 THEN coalesce(c.s, '') END AS chosen, CASE WHEN nc > 0 THEN coalesce(c.m, '') END AS chosen_mask,
  CASE WHEN nr > 0 THEN coalesce(j.s, '') END AS rejected, CASE WHEN nr > 0 THEN coalesce(j.m, '') END AS rejected_mask
FROM p
LEFT JOIN (SELECT pair_id, string_agg(shown, '' ORDER BY k) AS s, string_agg((low + head)::BIGINT || ':' || (low + length(shown) - 1)::BIGINT, ',' ORDER BY k) FILTER (role = '{TRAINED}') AS m FROM o WHERE is_chosen GROUP BY pair_id) c USING (pair_id)
LEFT JOIN (SELECT pair_id, string_agg(shown, '' ORDER BY k) AS s, string_agg((low + head)::BIGINT || ':' || (low + length(shown) - 1)::BIGINT, ',' ORDER BY k) FILTER (role = '{TRAINED}') AS m FROM o WHERE NOT is_chosen GROUP BY pair_id) j USING (pair_id)
"""
