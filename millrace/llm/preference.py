"""Operator 10, preference formatting: native DataFrame functions only.

For a chosen and a rejected conversation the longest common prefix of turns is rendered once, as the prompt; what is
left of each is its completion, masked by spans: only the assistant's turns count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE = "assistant"


def _render(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n<|end|>\n")))
    return F.array_join(parts, "")


def _spans(turns: Column, role: str) -> Column:
    """Where the rendered turns count: the texts of the role's turns with their end marks, without their heads, in code points."""
    span = "struct<start:bigint,end:bigint>"

    def add(a: Column, t: Column) -> Column:
        begin = a["at"] + F.char_length(F.coalesce(t["role"], F.lit(""))) + 5
        end = begin + F.char_length(F.coalesce(t["text"], F.lit(""))) + 9
        own = F.array(F.struct(begin.alias("start"), end.alias("end")).cast(span))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
    return F.aggregate(turns, start, add, lambda a: a["spans"])


def _turn(turn: str, role: str, text: str) -> Column:
    return F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))


def format_pairs(turns: DataFrame, pair: Column, rejected: Column, turn: str = "turn", role: str = "role", text: str = "text", trained: str = ROLE) -> DataFrame:
    """A row per pair from turns: ``pair`` names it, ``rejected`` tells the side of a turn (null: chosen).

    Turns go by number; those with one number (repeated rows) by role and text. Turns of one pair are brought
    together in one shuffle, in one row as the result is. See ``formatted`` for what is returned.
    """
    rows = turns.select(pair.alias("pair_id"), F.coalesce(rejected.cast("boolean"), F.lit(False)).alias("side"), _turn(turn, role, text).alias("t"))
    sides = [F.sort_array(F.collect_list(F.when(side, F.col("t")))).alias(c) for c, side in (("c", ~F.col("side")), ("r", F.col("side")))]
    return formatted(rows.groupBy("pair_id").agg(*sides), trained)


def branched(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = ROLE) -> DataFrame:
    """``pair_id, c, r`` for each conversation of ``turns``: it is the chosen side of the pair that has its number.

    The rejected side is the same conversation up to its last turn of the role ``trained``, in whose place the last
    such turn of its neighbour stands (2k and 2k + 1 are neighbours). Where either has no such turn it is the
    neighbour as it is, if there is one. Turns without a number of their conversation are one, without neighbour.
    """
    rows = turns.select(F.floor(F.col(conv) / 2).cast("long").alias("k"), F.coalesce(F.pmod(conv, F.lit(2)) == 1, F.lit(False)).alias("odd"), _turn(turn, role, text).alias("t"))
    sides = [F.sort_array(F.collect_list(F.when(side, F.col("t")))).alias(c) for c, side in (("even", ~F.col("odd")), ("odd", F.col("odd")))]
    both = rows.groupBy("k").agg(*sides)
    own = [F.struct((2 * F.col("k") + n).alias("pair_id"), F.col(a).alias("c"), F.col(b).alias("m")) for n, a, b in ((0, "even", "odd"), (1, "odd", "even"))]
    each = both.select(F.explode(F.array(*own)).alias("x")).select("x.*").filter(F.size("c") > 0)
    last = [F.array_max(F.transform(c, lambda t, i: F.when(t["role"] == trained, i + 1))).alias(f"last_{c}") for c in ("c", "m")]
    each = each.select("*", *last)
    branch = F.concat(F.slice("c", F.lit(1), F.col("last_c") - 1), F.array(F.element_at("m", F.col("last_m"))))
    return each.select("pair_id", "c", F.when(F.col("last_c").isNotNull() & F.col("last_m").isNotNull(), branch).otherwise(F.col("m")).alias("r"))


def formatted(both: DataFrame, trained: str = ROLE) -> DataFrame:
    """A row for each ``pair_id, c, r``, arrays of turns with ``role`` and ``text``.

    ``prompt`` is the rendered common prefix of ``n_prefix`` turns (equal role and text, nulls equal); ``chosen`` and
    ``rejected`` are the completions, and ``*_spans`` the parts of them that count, in code points from their starts.
    A side without turns gives an empty completion and ``paired`` false. A null role or text is rendered as an empty one.
    """
    # The place of the first turn that differs; a longer side differs where the shorter ends.
    same = F.expr("transform(arrays_zip(c, r), x -> x.c IS NOT NULL AND x.r IS NOT NULL AND x.c.role <=> x.r.role AND x.c.text <=> x.r.text)")
    first = F.array_position(same, False)
    both = both.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int"))
    rest = [F.slice(F.col(k), F.col("n_prefix") + 1, F.size(k)) for k in ("c", "r")]
    both = both.select("pair_id", "n_prefix", F.slice("c", F.lit(1), F.col("n_prefix")).alias("p"), F.size("c").alias("nc"), F.size("r").alias("nr"), rest[0].alias("c"), rest[1].alias("r"))
    return both.select(
        "pair_id", "n_prefix", ((F.col("nc") > 0) & (F.col("nr") > 0)).alias("paired"), _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"), _spans(F.col("c"), trained).alias("chosen_spans"),
        _render(F.col("r")).alias("rejected"), _spans(F.col("r"), trained).alias("rejected_spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Each conversation against a branch of it that ends with its neighbour's reply; spans as ``start-end``, by commas."""
    pairs = formatted(branched(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    listed = {f"{c}_spans": F.array_join(F.transform(f"{c}_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",") for c in ("chosen", "rejected")}
    return pairs.withColumns(listed)


SQL = """
WITH o AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
z AS (SELECT c, max(i) FILTER (WHERE role = 'assistant') AS last FROM o GROUP BY c),
m AS (SELECT z.c, z.last, y.c AS mate, y.last AS mate_last FROM z LEFT JOIN z y ON y.c = CASE WHEN z.c % 2 = 0 THEN z.c + 1 ELSE z.c - 1 END),
t AS (SELECT c AS pair_id, false AS side, i, role, text FROM o
  UNION ALL SELECT o.c, true, o.i, o.role, o.text FROM o JOIN m ON o.c = m.c WHERE m.mate_last IS NOT NULL AND o.i < m.last
  UNION ALL SELECT m.c, true, m.last, o.role, o.text FROM m JOIN o ON o.c = m.mate AND o.i = m.mate_last WHERE m.last IS NOT NULL
  UNION ALL SELECT m.c, true, o.i, o.role, o.text FROM m JOIN o ON o.c = m.mate WHERE m.last IS NULL OR m.mate_last IS NULL),
n AS (SELECT pair_id, count(*) FILTER (WHERE NOT side) AS nc, count(*) FILTER (WHERE side) AS nr FROM t GROUP BY pair_id),
e AS (SELECT a.pair_id, a.i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND NOT a.side AND b.side
    AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text),
k AS (SELECT pair_id, count(*) FILTER (WHERE i = j) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS j FROM e) GROUP BY pair_id),
p AS (SELECT n.pair_id, nc, nr, coalesce(k.n, 0)::INT AS n_prefix FROM n LEFT JOIN k ON n.pair_id = k.pair_id),
x AS (SELECT t.*, p.n_prefix, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS s,
    length(coalesce(text, '')) + 9 AS w FROM t JOIN p ON t.pair_id IS NOT DISTINCT FROM p.pair_id),
g AS (SELECT *, sum(length(s)) OVER (PARTITION BY pair_id, side ORDER BY i) AS stop FROM x WHERE i > n_prefix),
c AS (SELECT pair_id, side, string_agg(s, '' ORDER BY i) AS s, coalesce(string_agg((stop - w) || '-' || stop, ',' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS spans FROM g GROUP BY pair_id, side),
b AS (SELECT pair_id, string_agg(s, '' ORDER BY i) AS s FROM x WHERE i <= n_prefix AND NOT side GROUP BY pair_id)
SELECT p.pair_id, p.n_prefix, nc > 0 AND nr > 0 AS paired, coalesce(b.s, '') AS prompt,
  coalesce(y.s, '') AS chosen, coalesce(y.spans, '') AS chosen_spans, coalesce(r.s, '') AS rejected, coalesce(r.spans, '') AS rejected_spans
FROM p LEFT JOIN b ON b.pair_id IS NOT DISTINCT FROM p.pair_id LEFT JOIN c y ON y.pair_id IS NOT DISTINCT FROM p.pair_id AND NOT y.side
  LEFT JOIN c r ON r.pair_id IS NOT DISTINCT FROM p.pair_id AND r.side
"""
