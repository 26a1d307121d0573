"""Quality rules by host: failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import spare, stage

#: Standard deviations of the prior above its mean, and at most this rate, at which a host is rejected.
SPREADS, MAX_RATE = 3.0, 0.5
_SPACES = r"[\x20\x09-\x0D]+"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def _windows(words: Column, width: int) -> Column:
    """(hash, position) of each window of ``width`` words, sorted."""
    own = F.transform(words, lambda w, i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"), i.alias("i")))
    return F.sort_array(F.slice(own, 1, F.greatest(F.size(words) - width + 1, F.lit(0))))


def base_rules(docs: DataFrame, text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``.

    Words are runs of anything but ASCII white space; a null text has none
    and fails. Windows are compared by a 64-bit hash within one text. All is
    done by array functions within the row: the text never leaves its task,
    and the work grows with n log n of its words. Columns of these names are
    replaced.
    """
    names = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"}
    others = [c for c in docs.columns if c.lower() not in names]
    words_, lines_, windows_, at_ = (spare(docs, x) for x in ("words", "lines", "windows", "at"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        *others,
        F.filter(F.split(text, _SPACES), lambda w: w != "").alias(words_),
        lines.alias(lines_),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    out = out.withColumn(windows_, _windows(F.col(words_), width))
    repeated = F.filter(windows_, lambda w, i: F.coalesce(F.get(windows_, i - 1)["h"] == w["h"], F.lit(False)) | F.coalesce(F.get(windows_, i + 1)["h"] == w["h"], F.lit(False)))
    out = out.withColumn(at_, F.sort_array(F.transform(repeated, lambda w: w["i"])))
    covered = F.aggregate(F.transform(at_, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at_, k + 1) - p, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size(words_).cast("long")
    return out.select(
        *others,
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        ((n < 10) | (100 * covered > 20 * n)).alias("base_failed"),
    )


def host_rates(ruled: DataFrame, host_col: str) -> DataFrame:
    """``(host, n, failed, rate, limit)``: documents, failures, the shrunk rate and the rate above which a host is rejected.

    The prior is fitted to all hosts by moments: with m the failure rate of
    all documents and v the variance of the hosts' rates about it, weighted
    by their documents, less what sampling alone gives, its weight is
    s = m (1 - m) / v - 1, at least 1; without excess variance s is the mean
    number of documents of a host. A host's rate is
    (failed + s m) / (n + s). The limit is the prior's mean and ``SPREADS`` of
    its standard deviations, sqrt(m (1 - m) / (s + 1)), or ``MAX_RATE`` if
    that is less. Where hosts are alike, chance alone takes a shrunk rate
    half a deviation away, so none is rejected. Null hosts are no host.
    """
    hosts = ruled.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    total = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("t"), F.sum("failed").alias("f"))
    mean = (F.col("f") / F.col("t")).alias("m")
    # One row each: the broadcasts have a fixed size.
    spread = hosts.crossJoin(F.broadcast(total.select("h", "t", mean))).groupBy("h", "t", "m").agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.col("m"), 2)).alias("q"))
    noise = F.col("m") * (1 - F.col("m")) * (F.col("h") - 1)
    excess = (F.col("q") - noise) / F.col("t")
    weight = F.when(excess > 0, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / excess - 1)).otherwise(F.col("t") / F.col("h"))
    prior = spread.select("m", weight.alias("s"))
    limit = F.least(F.lit(MAX_RATE), F.col("m") + F.lit(SPREADS) * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("s") + 1)))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failed", ((F.col("failed") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))).alias("rate"), limit.alias("limit"))


def host_verdicts(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns of ``base_rules``, ``host_rate`` and ``kept``.

    ``kept`` is false for documents that fail the base rules and for those of
    a host whose shrunk failure rate is above the limit of ``host_rates``. A document
    without a host (null) has a null ``host_rate`` and is judged by its own
    rules. ``carry`` names the columns of ``docs`` to return, all if None;
    those of the rules' names are replaced.

    The rules' results are staged, so that each text is read through once.
    Hosts are aggregated partially before the exchange, so one host with a
    third of all rows sends a row from each task. The verdicts, a row for
    each host, are staged too: their size is then known, Spark broadcasts
    them below its limit, and above it may split a hot host's side. Whole
    texts are used, of very long ones arrays of their words; repeated rows
    are documents of their own; an empty table stays empty.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("host_rate", "kept")]
    host, text, limit = (spare(docs, x) for x in ("host", "whole_text", "limit"))
    ruled = base_rules(docs.select(*carried, F.col(host_col).alias(host), F.col(text_col).alias(text)), text).drop(text)
    ruled = stage(ruled, "rules")
    rates = stage(host_rates(ruled.select(host, "base_failed"), host).select(F.col("host").alias(host), F.col("rate").alias("host_rate"), F.col("limit").alias(limit)), "hosts")
    joined = ruled.join(rates, host, "left").drop(host)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rate") > F.col(limit), F.lit(False))).drop(limit)


SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY 1),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT doc_id, source, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint AS n_symbols,
             coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
             len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dl USING (doc_id)),
hosts AS (SELECT source, count(*)::double AS n, (count(*) FILTER (WHERE base_failed))::double AS f FROM b WHERE source IS NOT NULL GROUP BY 1),
tot AS (SELECT count(*)::double AS h, sum(n) AS t, sum(f) / sum(n) AS m FROM hosts),
spr AS (SELECT h, t, m, (sum(n * (f / n - m) * (f / n - m)) - m * (1 - m) * (h - 1)) / t AS e FROM hosts, tot GROUP BY h, t, m),
pr AS (SELECT m, CASE WHEN e > 0 THEN greatest(1.0, m * (1 - m) / e - 1) ELSE t / h END AS s FROM spr),
v AS (SELECT source, (f + s * m) / (n + s) > least(0.5, m + 3 * sqrt(m * (1 - m) / (s + 1))) AS bad FROM hosts, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM b LEFT JOIN v USING (source)
"""
