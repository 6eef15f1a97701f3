"""Quality rules by document and by host, in DataFrame functions only.

Every document gets counts and the base verdict.  Failures are summed by host; a beta prior is
fitted to the hosts' failure rates by the method of moments, each host's rate is shrunk to
(failures + alpha) / (documents + alpha + beta), and documents of hosts above ``max_rate`` are
rejected as well.

Cases: a null text has no words, so it fails; a null host is a host of its own; one host or
hosts with equal rates get the weak prior of ``WEAK`` documents at the common rate; an empty
table gives no rows; repeated rows count each; of the table only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 50
#: Percent of words in repeated 3-word windows above which a text fails.
MAX_REPEATED = 50
#: Shrunk failure rate above which a host's documents are all rejected.
MAX_RATE = 0.6
#: Documents that the prior stands for where the hosts' rates don't tell.
WEAK = 10.0
SYMBOLS = "[#*$%&|<>]"
#: So many repeated values are looked up one by one; more of them are found by sorting.
FEW = 32


def _again(keyed: Column) -> Column:
    """Places of the keys that occur more than once, from an array of (key, place): sorted, equal ones are neighbours."""

    def kept(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["key"] == x["key"], F.lit(False))
        return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["place"])

    return C.let(F.sort_array(keyed), kept)


def _twice(hashes: Column) -> Column:
    """The values that occur more than once."""
    return C.let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, k: F.coalesce(F.get(s, k - 1) == h, F.lit(False)))))


def _places(hashes: Column, values: Column) -> Column:
    found = F.transform(hashes, lambda h, i: F.when(F.array_contains(values, h), i))
    return F.filter(found, lambda i: i.isNotNull())


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur more than once.

    Hashes of the windows show which texts, and which places in them, can have any; only there
    are the windows themselves built and compared.
    """

    def spread(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def exact(hashes: Column) -> Column:
        likely = C.let(_twice(hashes), lambda few: F.when(F.size(few) <= FEW, _places(hashes, few)).otherwise(_again(F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("place"))))))
        windows = F.transform(likely, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("key"), i.alias("place")))
        return C.let(F.sort_array(_again(windows)), spread)

    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    hashes = F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return C.let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0).cast("long")))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each document, without a shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = C.let(C.words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(w).alias("again")))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(C.WORD))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), counted.alias("counted"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        C.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "host", F.col("counted.n").alias("n_words"), F.col("counted.chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("counted.again").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> tuple[DataFrame, int]:
    """(host, host_docs, host_rate, host_kept) from measured documents, and the number of hosts."""
    by = C.materialize(measured.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    rate = F.col("failed") / F.col("host_docs")
    m = by.agg(F.count("*").alias("n"), F.sum("failed").alias("failed"), F.sum("host_docs").alias("docs"), F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("host_docs")).alias("inv")).first()
    alpha = beta = 0.0
    if m["n"]:
        p = m["failed"] / m["docs"]
        strength = WEAK
        mean, var = m["mean"], m["var"] or 0.0
        between = var - mean * (1 - mean) * m["inv"]  # what sampling alone doesn't explain
        if m["n"] > 1 and between > 1e-12 and 0 < mean < 1:
            strength, p = max(mean * (1 - mean) / between - 1, 1.0), mean
        alpha, beta = p * strength, (1 - p) * strength
    shrunk = (F.col("failed") + F.lit(float(alpha))) / (F.col("host_docs") + F.lit(float(alpha + beta)))
    return by.select("host", "host_docs", shrunk.alias("host_rate"), (shrunk <= F.lit(float(max_rate))).alias("host_kept")), m["n"]


def rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, the counts, base_failed, host_rate and kept of each document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    measured = C.materialize(measures(docs, doc_id, text, host).withColumn("base_failed", failed), "quality")
    by, n = host_verdicts(measured, max_rate)
    out = C.join_keyed(measured, by, "host", n, F.xxhash64("doc_id"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
