"""Operator 9, quality rules with host verdicts: native DataFrame functions only.

Each document gets counts and a base verdict. Failures are then aggregated by host, each host's failure rate is
shrunk by a beta prior fitted to all hosts, and the verdict of a host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage_table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _repeat_words(grams: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, from the windows' hashes in text order."""
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return ordered


def with_metrics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` in a struct ``row``, with the metrics of column ``text`` beside it.

    Null text counts as empty: zero everywhere, and the base rule fails. Windows are compared by a 64-bit hash of
    their three words. No column of ``df`` can clash, since all of them stay inside ``row``.
    """
    keep = df.columns if keep is None else keep
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = out.select(
        "row",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.size(F.regexp_extract_all("text", F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    out = out.select(
        "row", "n_symbols",
        F.char_length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) > 3 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").alias("grams"),
    )
    # Most texts repeat no window, which the cheap distinct count shows; only the others pay for a sort.
    out = out.withColumn("ordered", F.when(F.size("grams") > F.size(F.array_distinct("grams")), _repeat_words(F.col("grams"))))
    out = out.withColumn(
        "hits",
        F.sort_array(F.expr("transform(filter(ordered, (x, k) -> (k > 0 AND ordered[k - 1].h = x.h) OR (k + 1 < size(ordered) AND ordered[k + 1].h = x.h)), x -> x.i)")),
    )
    covered = F.expr("aggregate(hits, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)")
    out = out.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(scored: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE, relative: bool = False) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate and ``host_rejected``.

    The prior Beta(a, b) is fitted by moments over all hosts, weighted by their documents: its mean is the overall
    failure rate and its strength follows from the variance between hosts beyond sampling noise (held within 1 and
    a million documents). A null host is a host of its own. ``max_rate`` is a rate, or, if ``relative``, a multiple of the
    overall one.
    """
    hosts = scored.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))
    moments = hosts.agg(
        F.sum("n").alias("n_all"), F.sum("f").alias("f_all"), F.count("*").alias("k"), F.sum(F.col("f").cast("double") * F.col("f") / F.col("n")).alias("ff")
    )
    m = F.col("f_all") / F.col("n_all")
    between = F.col("ff") / F.col("n_all") - m * m
    noise = m * (1 - m) * F.col("k") / F.col("n_all")
    signal = F.greatest(between - noise, F.lit(1e-12))
    strength = F.least(F.greatest(m * (1 - m) / signal - 1, F.lit(1.0)), F.lit(1e6))
    prior = moments.select(m.alias("m"), strength.alias("s"))
    rate = (F.col("f") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    # prior is a single row, the result of a global aggregate.
    return hosts.join(F.broadcast(prior)).select("host", "n", "f", rate.alias("host_rate"), (rate > max_rate * (F.col("m") if relative else 1)).alias("host_rejected"))


def judge(df: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, max_rate: float = MAX_HOST_RATE, relative: bool = False) -> DataFrame:
    """Every row of ``df`` as ``row``, its metrics, host figures and ``kept``.

    The scored rows are written once to the shared folder, so that the rules run once and not again for the hosts.
    """
    keep = df.columns if keep is None else keep
    scored = stage_table(with_metrics(df, text, [*dict.fromkeys([*keep, host])]), "quality")
    hosts = stage_table(host_verdicts(scored.select(F.col("row")[host].alias("h"), "base_failed"), "h", "base_failed", max_rate, relative), "hosts")
    hosts = hosts.select("host", "host_rate", "host_rejected")
    out = scored.join(hosts, F.col("row")[host].eqNullSafe(F.col("host")), "left")
    return out.select("row", *METRICS, "host", "host_rate", (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"))


def keep_good(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, with its own columns."""
    return judge(df, text, host).filter("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), *METRICS, "kept")


PAGE_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def page_query(spark, sf_dir: str) -> DataFrame:
    """The hosts of ``pages``, by their URLs: those that fail more often than pages do overall are rejected with all their pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", F.regexp_extract("url", PAGE_HOST, 1).alias("source"))
    judged = judge(pages, text="html", keep=["page_id"], max_rate=1.0, relative=True)
    return judged.select("row.page_id", "host", F.round("host_rate", 9).alias("host_rate"), "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tok AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS a FROM w),
tri AS (SELECT doc_id, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
cnt AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM tri WHERE c IS NOT NULL),
hit AS (SELECT DISTINCT doc_id, i + j AS i FROM cnt, range(3) r(j) WHERE k > 1),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM f GROUP BY source),
mo AS (SELECT sum(n) AS na, sum(f) / sum(n) AS m, count(*) AS k, sum(f * f / n) AS ff FROM h),
pr AS (SELECT m, least(greatest(m * (1 - m) / greatest(ff / na - m * m - m * (1 - m) * k / na, 1e-12) - 1, 1.0), 1e6) AS s FROM mo),
bad AS (SELECT source, (f + m * s) / (n + s) > 0.5 AS r FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad.r AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""

PAGE_SQL = (
    SQL.replace("SELECT doc_id, source, coalesce(text, '') AS text FROM documents", f"SELECT page_id AS doc_id, regexp_extract(url, '{PAGE_HOST}', 1) AS source, coalesce(html, '') AS text FROM pages")
    .replace("(f + m * s) / (n + s) > 0.5 AS r", f"round((f + m * s) / (n + s), 9) AS host_rate, (f + m * s) / (n + s) > m AS r")
    .replace("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT", "SELECT doc_id AS page_id, f.source AS host, bad.host_rate, base_failed, NOT")
)
