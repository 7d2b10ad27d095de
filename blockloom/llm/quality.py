"""Quality rules of documents with host verdicts, in DataFrame functions only.

Rules are evaluated inside a row. Their failures are added up by host, rule by rule, the failure rates are drawn towards the rate
of all hosts by a beta prior fitted to the hosts' counts (beta-binomial moments), and hosts with a drawn-in rate above a
limit take their documents with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockloom.llm import common

WINDOW = 5
HOST_LIMIT = 0.5
SYMBOL_SHARE = 10
SURE = 1e6


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text.

    A null text counts as empty. Equal windows are found by 64-bit hashes: two different windows of one text are taken for
    equal with a chance of 2^-64 for each pair. Only texts with a repeat are sorted. No shuffle.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.translate(line, common.BLANKS, "") != "")
    out = docs.withColumn("__words", F.transform(common.words(text), lambda word: F.xxhash64(word)))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    hashes = F.col("__words")
    run = F.transform(hashes, lambda word, i: F.xxhash64(word, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    out = out.withColumn("__runs", F.slice(run, 1, F.greatest(F.size("__words") - (WINDOW - 1), F.lit(0)))).withColumn("__lines", lines)
    sure = F.size(F.array_distinct("__runs")) == F.size("__runs")
    return out.select(
        *[F.col(c) for c in docs.columns], "n_words", F.length(F.translate(whole, common.BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(sure, F.lit(0)).otherwise(_covered(F.col("__runs"))).cast("long").alias("n_repeat_words"))


def _covered(runs: Column) -> Column:
    """Words inside a window that occurs at least twice: windows sorted with their places, twins kept, spans joined."""
    ordered = F.sort_array(F.transform(runs, lambda run, i: F.struct(run.alias("run"), i.alias("at"))))

    def twins(column: Column) -> Column:
        return F.filter(column, lambda e, k: F.coalesce(F.get(column, k - 1)["run"] == e["run"], F.lit(False))
                        | F.coalesce(F.get(column, k + 1)["run"] == e["run"], F.lit(False)))

    # Each step binds its array to a lambda variable, so that it is computed once for a row.
    def bound(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    places = bound(ordered, lambda s: F.sort_array(F.transform(twins(s), lambda e: e["at"])))
    return bound(places, lambda p: F.aggregate(
        F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1), at + WINDOW) - at)),
        F.lit(0), lambda total, part: total + part))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The host-level rules: too few words, repeats, symbols above a tenth of the words."""
    return {"short": F.col("n_words") < 10, "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
            "symbols": 100 * F.col("n_symbols") > SYMBOL_SHARE * F.col("n_words")}


def rule_rates(measured: DataFrame, host: str, failed: dict[str, Column]) -> DataFrame:
    """Documents of each host (a null host is one of its own), and for each rule its failures and drawn-in failure rate.

    With rates r of k hosts of n documents, N = sum(n) and mean m = sum(n r) / N, the sum of n (r - m)^2 is (k - 1) m (1 - m) where all hosts have one rate and
    only chance differs. What is above that, divided by N - sum(n^2) / N, is the variance v between hosts, and the prior is beta(m s, (1 - m) s) with
    s = m (1 - m) / v - 1, held between 1 and 10^6 (10^6 where nothing is above). A host of one document is drawn to the mean.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(f"failures_{name}") for name, c in failed.items()])
    facts = [F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("own")]
    for name in failed:
        f = F.col(f"failures_{name}")
        facts += [F.sum(f).alias(f"f_{name}"), F.sum(f.cast("double") * f / F.col("n")).alias(f"squares_{name}")]
    one = hosts.agg(*facts).select(F.struct("*")).scalar()
    out = hosts.withColumn("all", one)
    rates = []
    for name in failed:
        m, total = F.col(f"all.f_{name}") / F.col("all.total"), F.col("all.total")
        above = F.col(f"all.squares_{name}") - total * m * m - (F.col("all.k") - 1) * m * (1 - m)
        room = total - F.col("all.own") / total
        variance = F.when(room > 0, above / room)
        s = F.when(variance > 1e-12, F.least(F.lit(SURE), F.greatest(F.lit(1.0), m * (1 - m) / variance - 1))).otherwise(F.lit(SURE))
        rates.append(((F.col(f"failures_{name}") + m * s) / (F.col("n") + s)).alias(f"rate_{name}"))
    return out.select("host", "n", *[f"failures_{name}" for name in failed], *rates)


def host_rates(measured: DataFrame, host: str, failed: Column) -> DataFrame:
    """Documents, failures and drawn-in failure rate of each host for one rule."""
    return rule_rates(measured, host, {"it": failed}).withColumnsRenamed({"failures_it": "failures", "rate_it": "rate"})


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts of ``measure``, base_failed, kept, host_blocked.

    A document is kept if it passes the base rules (10 words or more, repeats in at most a fifth of the words) and its host's
    drawn-in rate of failing documents is at most ``limit`` for each of the host-level rules. Repeated rows stay; other columns
    are not read; an empty table gives an empty one. The texts are read once; the per-document counts are staged for the
    second pass. The host table goes to the documents by a join whose kind the planner chooses by size; a hot host is
    pre-aggregated, and its rows are split by the adaptive skew join.
    """
    measured = measure(docs.select("doc_id", F.col(host).alias("host"), "text")).drop("text").withColumn("base_failed", base_failed())
    measured = common.staged(measured, "quality")
    worst = F.greatest(*[F.col(f"rate_{name}") for name in rules()])
    bad = rule_rates(measured, "host", rules()).where(worst > limit).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    out = measured.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    blocked = F.coalesce("bad", F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~blocked).alias("kept"), blocked.alias("host_blocked"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
runs AS (SELECT row, i, words[i:i + 4] AS run FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, run) AS c FROM runs) WHERE c > 1),
cover AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY row),
m AS (SELECT w.row, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN cover ON w.row = cover.row),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
r AS (SELECT source, unnest(['short', 'repeats', 'symbols']) AS rule, unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 100 * n_symbols > 10 * n_words]) AS failed FROM b),
h AS (SELECT source, rule, count(*) AS n, count_if(failed)::DOUBLE AS f FROM r GROUP BY source, rule),
p AS (SELECT rule, count(*) AS k, sum(n) AS t, sum(n::DOUBLE * n) AS own, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM h GROUP BY rule),
v AS (SELECT rule, m, CASE WHEN t - own / t > 0 THEN (q - t * m * m - (k - 1) * m * (1 - m)) / (t - own / t) END AS v FROM p),
s AS (SELECT rule, m, CASE WHEN v > 1e-12 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM v),
bad AS (SELECT source, max((f + m * s) / (n + s)) > 0.5 AS bad FROM h JOIN s ON h.rule = s.rule GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT bad AS kept, bad AS host_blocked
FROM b JOIN bad ON b.source IS NOT DISTINCT FROM bad.source
"""
