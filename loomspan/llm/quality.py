"""Quality rules with host-level verdicts: failures by host, shrunk by an empirical beta prior.

Everything is DataFrame expressions; the only shuffle is one partial sum for each host. Texts are measured once: the
measures are written to the shared folder, and hosts and verdicts are made from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import materialize, read, words

SYMBOLS = "#*$%&|<>"
SHINGLE = 3
#: A document fails softly if any of these holds: share of symbols among word characters, of repeated lines among lines, mean word length outside the range.
MAX_SYMBOLS, MAX_LINES, WORD_LENGTH = 0.1, 0.3, (2.0, 12.0)
#: A host is bad if its shrunk failure rate exceeds this.
BAD_HOST = 0.5
#: Strength of the prior, in documents, where the data cannot tell it: one host, hosts of one document each, or no failure or nothing but failures.
STRENGTH = 10.0
#: Bounds of the share of the spread that lies between hosts (the strength is 1 / share - 1).
SPREAD = (0.001, 0.999)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: The host of a URL; anything else is its own host.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def repeated_words(w: str = "w"):
    """Words inside 3-word windows found twice or more in the array column, first ones included.

    Windows are hashed and sorted with their positions; equal neighbours are repeats. A covered word is counted
    once: each repeat at p adds the words from p up to the next repeat, three at most. Each array is bound to a lambda
    variable, so it is made once and read in order.
    """
    n = F.size(w) - (SHINGLE - 1)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))).alias("h"), i.alias("i"))))

    def covered(s):
        pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        places = F.sort_array(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))
        start = F.struct(F.lit(0).alias("n"), F.lit(-SHINGLE).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + SHINGLE - F.greatest(a["end"], p)).alias("n"), (p + SHINGLE).alias("end")))["n"]

    return F.transform(F.array(windows), covered)[0]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus MEASURES, all of the whole text; a null text is empty. Columns of docs of these names are replaced, others kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = "w"
    while w in docs.columns:
        w += "_"
    out = docs.withColumn(w, words(text_col))
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in MEASURES),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed():
    short, long = (F.col("word_chars") < WORD_LENGTH[0] * F.col("n_words")), (F.col("word_chars") > WORD_LENGTH[1] * F.col("n_words"))
    return base_failed() | (F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars")) | (F.col("n_dup_lines") > MAX_LINES * F.col("n_lines")) | short | long


def host_verdicts(rows: DataFrame, host_col: str, failed_col: str) -> DataFrame:
    """(host, host_docs, host_rate, host_bad): failure rates by host, shrunk towards an empirical beta prior.

    The prior's mean is the rate of all rows. Its strength comes from the beta-binomial moments: the spread of host
    rates, each weighed by its documents, less what the binomial noise of k hosts explains; the rest, as a share of what
    it would be if all spread lay between hosts, is 1 / (strength + 1). Rows of a null host form one host.
    """
    hosts = rows.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col(failed_col).cast("int")).alias("fails"))
    f, d, n, k, m = F.col("fails").cast("double"), F.col("host_docs").cast("double"), F.col("n"), F.col("k"), F.col("m")
    sums = hosts.agg(F.sum(d).alias("n"), F.count("*").alias("k"), F.sum(f).alias("f"), F.sum(f * f / d).alias("ff"), F.sum(d * d).alias("dd")).withColumn("m", F.col("f") / n)
    noise, whole = m * (1 - m), n - F.col("dd") / n - (k - 1)
    share = F.greatest(F.lit(SPREAD[0]), F.least(F.lit(SPREAD[1]), ((F.col("ff") - n * m * m) / noise - (k - 1)) / whole))
    strength = F.when((k > 1) & (noise > 0) & (whole > 1e-9), 1 / share - 1).otherwise(F.lit(STRENGTH))
    prior = sums.select("m", strength.alias("strength"))
    # one row joins all hosts: the row count of the hosts stays
    shrunk = hosts.join(F.broadcast(prior))
    host_rate = (F.col("fails") + F.col("m") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    return shrunk.select("host", "host_docs", host_rate.alias("host_rate")).withColumn("host_bad", F.col("host_rate") > BAD_HOST)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: id, counts, base_failed, kept, host_rate.

    kept is false where a base rule fails, or where the host is bad and the document fails a soft rule. Empty and
    null texts fail for want of words. The host of a URL is its domain, in lower case; any other value is a host itself.
    Texts of any length are read whole. Rows that repeat count each; an empty table gives an empty table. Only the
    three named columns are read, so other columns cannot clash.
    """
    domain = F.lower(F.regexp_extract(F.col(host_col).cast("string"), URL, 1))
    host = F.when(F.length(domain) > 0, domain).otherwise(F.col(host_col).cast("string"))
    each = measured(docs.select(F.col(id_col), host.alias("host"), F.col(text_col).alias("text"))).drop("text")
    each = materialize(each.withColumn("base_failed", base_failed()).withColumn("soft", soft_failed()), "quality")
    hosts = host_verdicts(each, "host", "soft").withColumnRenamed("host", "of")
    out = each.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, with the host's shrunk rate; nulls, empty and very long texts, ties, repeats, empty tables and other columns as in judge."""
    out = judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE = {
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
             row_number() OVER () AS k FROM d),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
c AS (SELECT k, count(DISTINCT i + o.j) AS n FROM r, (VALUES (0), (1), (2)) AS o(j) GROUP BY k),
m AS (SELECT t.k, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
      FROM t LEFT JOIN c ON c.k = t.k),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS (SELECT *, base_failed OR n_symbols > 0.1::DOUBLE * word_chars OR n_dup_lines > 0.3::DOUBLE * n_lines
               OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS soft FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(soft::INT)::DOUBLE AS f FROM s GROUP BY source),
p AS (SELECT sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) AS ff, sum(n * n) AS dd, count(*) AS k FROM h),
q AS (SELECT m, CASE WHEN k > 1 AND m > 0 AND m < 1 AND n - dd / n - (k - 1) > 1e-9
             THEN 1 / greatest(0.001::DOUBLE, least(0.999::DOUBLE, ((ff - n * m * m) / (m * (1 - m)) - (k - 1)) / (n - dd / n - (k - 1)))) - 1 ELSE 10 END AS st FROM p),
z AS (SELECT source, (f + m * st) / (n + st) AS host_rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (host_rate > 0.5 AND soft) AS kept, round(host_rate, 6) AS host_rate
FROM s JOIN z ON s.source IS NOT DISTINCT FROM z.source""",
}
