"""What the operators share: words, intermediate tables and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.tables import alone, discard, let_go, materialize, shared_path  # noqa: F401

#: A word is a run of anything but these characters: blank, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^ \\t\\n\\x0B\\f\\r]+"

#: Join sides of at most so many rows are broadcast, after counting them.
BROADCAST_ROWS = 10_000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, wherever body names it, in lambdas as well."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that df doesn't use in any case."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_keyed(big: DataFrame, small: DataFrame, key: str, n_small: int, salt: Column, salts: int = 32, how: str = "left") -> DataFrame:
    """big joined with one row a key of small, nulls of the key matching.

    small is broadcast if its counted rows are few; beyond that both sides are dealt by
    (key, salt), with each row of small repeated once a salt, so a hot key has many tasks.
    """
    other = free_name("key_", big.columns)
    small = small.withColumnRenamed(key, other)
    if n_small <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), big[key].eqNullSafe(small[other]), how).drop(other)
    s1, s2 = free_name("salt_a", big.columns), free_name("salt_b", big.columns)
    big = big.withColumn(s1, F.pmod(salt, F.lit(salts)).cast("int"))
    small = small.withColumn(s2, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    on = big[key].eqNullSafe(small[other]) & (big[s1] == small[s2])
    return big.join(small, on, how).drop(other, s1, s2)

#: A filter has so many rows of 32,768 bits: 8 MB, whatever the size of what it is made from.
FILTER_ROWS = 2048


def thinned(big: DataFrame, key: str, few: DataFrame, few_key: str) -> DataFrame:
    """big without most rows whose key (a long) few doesn't have, to shorten the join that follows.

    The keys of few set bits in a table of fixed size, which is broadcast; keys that share
    a bit pass as well, so with very many keys all rows do.
    """
    bits = F.pmod(F.col(few_key), F.lit(FILTER_ROWS * 32768)).alias("bit")
    sets = few.select(bits).groupBy(F.expr("bit div 32768").alias("row_")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits_"))
    at = F.pmod(F.col(key), F.lit(FILTER_ROWS * 32768))
    told = big.withColumn("at_", at)
    held = told.join(F.broadcast(sets), F.expr("at_ div 32768 = row_"))
    byte = F.expr("ascii(decode(substring(bits_, cast(at_ % 32768 div 8 as int) + 1, 1), 'ISO-8859-1'))")
    return held.where(F.call_function("shiftright", byte, (F.col("at_") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*big.columns)
