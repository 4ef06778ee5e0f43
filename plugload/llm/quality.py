"""Quality rules per document and per host, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plugload.llm.common import let, words
from plugload.session import materialized

SYMBOLS = r"[#*$%&|<>]"
RULES = ("short", "repetitive", "symbols", "copied_lines")


def repeated_words(w: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more among ``w``, the first occurrence included.

    Windows are compared by 64-bit hashes. Sorting (hash, position) brings equal windows together, and the sorted
    positions of the repeated ones give the union of their words, so the work is n log n for any text.
    """
    def covered(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(keyed, lambda s: let(
            F.sort_array(F.transform(
                F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True)),
                lambda x: x["i"],
            )),
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(width), F.get(p, k + 1) - x), F.lit(width))),
                F.lit(0).cast("long"), lambda total, x: total + x,
            ),
        ))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
    )
    repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(repeats)


def document_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts and rule failures of every row: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and fail_* per rule.

    Null texts count as empty and fail as short. Columns beyond the three named are ignored.
    """
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).select(
        "doc_id", "host",
        let(words(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )).alias("m"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )).alias("l"),
    ).select("doc_id", "host", "m.*", "n_symbols", "l.*")
    short = F.col("n_words") < 10
    repetitive = F.col("n_repeat_words") * 100 > F.col("n_words") * 20
    return measured.select(
        "*", (short | repetitive).alias("base_failed"), short.alias("fail_short"), repetitive.alias("fail_repetitive"),
        (F.col("n_symbols") * 10 > F.col("word_chars")).alias("fail_symbols"),
        (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3).alias("fail_copied_lines"),
    )


def host_rates(rules: DataFrame) -> DataFrame:
    """(host, n, rate_* per rule): failure rates of hosts, shrunk to a beta prior fitted to all hosts by moments.

    The prior of a rule has the mean of all documents; its weight follows from how much more the hosts' rates differ
    than chance alone would make them. A host with few documents therefore stays near the mean. Documents without
    host belong to none. Hosts are aggregated with partial sums, so a hot host costs nothing; one row of sums
    reaches the driver.
    """
    counts = [F.sum(F.col(f"fail_{r}").cast("long")).alias(f"k_{r}") for r in RULES]
    hosts = materialized(rules.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *counts))
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        *(F.sum(f"k_{r}").alias(f"k_{r}") for r in RULES),
        *(F.sum(F.col(f"k_{r}").cast("double") * F.col(f"k_{r}") / F.col("n")).alias(f"kk_{r}") for r in RULES),
    ).first()

    def shrunk(rule: str) -> Column:
        n, hosts_n = sums["n"] or 0, sums["hosts"]
        mean = (sums[f"k_{rule}"] or 0) / n if n else 0.0
        chance = mean * (1 - mean)
        free = n - (sums["nn"] or 0) / n - (hosts_n - 1) if n else 0.0
        spread = (sums[f"kk_{rule}"] or 0.0) - mean * mean * n
        share = (spread - chance * (hosts_n - 1)) / (chance * free) if chance * free > 0 else 0.0
        weight = 1 / min(max(share, 1e-3), 0.999) - 1
        return ((F.col(f"k_{rule}") + weight * mean) / (F.col("n") + weight)).alias(f"rate_{rule}")

    return hosts.select("host", "n", *(shrunk(r) for r in RULES))


def host_verdicts(docs: DataFrame, max_rate: float = 0.5, **names: str) -> DataFrame:
    """``document_rules`` with host_rejected and kept: false if the document fails its own rules or its host is rejected.

    A host is rejected if the shrunk rate of any rule is above ``max_rate``. The counts are written once to the
    shared folder and read for the rates and for the join; the join is left to Spark, which broadcasts few hosts and
    splits a hot one. Documents without host are judged alone. Repeated rows stay, an empty table stays empty.
    """
    rules = materialized(document_rules(docs, **names))
    worst = F.greatest(*(F.col(f"rate_{r}") for r in RULES))
    hosts = host_rates(rules).select("host", worst.alias("worst_rate"))
    rejected = F.coalesce(F.col("worst_rate") > max_rate, F.lit(False))
    return rules.join(hosts, "host", "left").withColumn("host_rejected", rejected).withColumn(
        "kept", ~F.col("base_failed") & ~rejected
    )
