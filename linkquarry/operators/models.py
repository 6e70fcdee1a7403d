"""Count models of URL bytes: unigram and hashed, interpolated n-gram, fitted and scored as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkquarry.functions.codec import END, VOCABULARY
from linkquarry.rules import CODEC_ALPHABET

BUCKETS = (257, 16384, 32768, 65536)


def symbol(url: Column, i: Column) -> Column:
    """The codec's symbol of the i-th character, from 1; the end symbol before and behind the URL. Compiled, unlike a lambda over an array."""
    known = {c: k for k, c in enumerate(CODEC_ALPHABET)}
    table = F.array(*[F.lit(known.get(chr(c), END)) for c in range(128)])
    return F.when((i < 1) | (i > F.length(url)), END).otherwise(F.element_at(table, F.ascii(F.substring(url, i, F.lit(1))) + 1))


def token_rows(urls: DataFrame, url_col: str = "url", id_col: str = "url", most: int = 511) -> DataFrame:
    """(id, text, pos, target): a row for each symbol of URLs of at most ``most`` bytes, ``pos`` from 1, the end symbol last.

    A byte outside the alphabet fails the job."""
    url = F.col(url_col)
    # The guard is a filter: a column that nothing reads would be pruned, and the failure with it.
    sound = F.when(~url.rlike(r"^[!#-;=?-~]*\z"), F.raise_error(F.lit("a URL holds a byte outside the codec alphabet")).cast("boolean")).otherwise(True)
    fits = urls.filter(F.octet_length(url) <= most).filter(sound).select(F.col(id_col).alias("id"), url.alias("text"))
    return fits.select("id", "text", F.explode(F.sequence(F.lit(1), F.length("text") + 1)).alias("pos")).withColumn("target", symbol(F.col("text"), F.col("pos")))


def excluded_count(urls: DataFrame, url_col: str = "url", most: int = 511) -> DataFrame:
    return urls.agg(F.count("*").alias("urls"), F.count_if(F.octet_length(url_col) > most).alias("excluded"))


def unigram_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("target").agg(F.count("*").alias("n"))


def unigram_bits(train: DataFrame, test: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """(id, bits) of test URLs under train's symbol counts, which are one number a symbol; scoring joins nothing."""
    seen = {r["target"]: r["n"] for r in unigram_counts(token_rows(train)).collect()}
    total = sum(seen.values()) + smoothing * VOCABULARY
    costs = F.array(*[F.lit(-math.log2((seen.get(k, 0) + smoothing) / total)) for k in range(VOCABULARY)])
    return token_rows(test).groupBy("id").agg(F.sum(F.element_at(costs, F.col("target") + 1)).alias("bits"))


def with_contexts(rows: DataFrame, order: int, buckets: tuple[int, ...]) -> DataFrame:
    """(id, target, c1 ..): hashes of the 1 to ``order`` symbols before each position, the end symbol standing before the first.

    The symbols are exploded as one struct, so that each is looked up once and the hashes are arithmetic on them."""
    before = F.struct(*[symbol(F.col("text"), F.col("pos") - k).cast("bigint").alias(f"s{k}") for k in range(1, order + 1)])
    rows = rows.select("id", "target", F.explode(F.array(before)).alias("s"))
    hashes = []
    for n in range(1, order + 1):
        out = F.lit(0).cast("bigint")
        for k in range(n, 0, -1):
            out = (out * VOCABULARY + F.col(f"s.s{k}")) % buckets[n - 1]
        hashes.append(out.alias(f"c{n}"))
    return rows.select("id", "target", *hashes)


def ngram_bits(train: DataFrame, test: DataFrame, order: int = 4, buckets: tuple[int, ...] = BUCKETS, smoothing: float = 0.5, backoff: float = 8.0) -> DataFrame:
    """(id, bits) under interpolated n-grams of order 1 to ``order``: p = (seen + backoff * lower p) / (total + backoff).

    Tables have at most buckets x 92 rows an order, which bounds what a join shuffles on its build side; Spark picks
    broadcast or shuffle by size. Test symbols are counted once for each distinct (contexts, target), which shrinks them before the joins."""
    if not 1 <= order <= len(buckets):
        raise ValueError("unsupported n-gram order")
    names = [f"c{k}" for k in range(1, order + 1)]
    seen = with_contexts(token_rows(train), order, buckets).groupBy("target", *names).agg(F.count("*").alias("n"))
    unigram = seen.groupBy("target").agg(F.sum("n").alias("n0"))
    rows = with_contexts(token_rows(test), order, buckets).groupBy("id", "target", *names).agg(F.count("*").alias("times"))
    total = unigram.agg(F.sum("n0").alias("t0"))
    rows = rows.join(F.broadcast(unigram), "target", "left").crossJoin(F.broadcast(total))
    p = (F.coalesce("n0", F.lit(0)) + smoothing) / (F.col("t0") + smoothing * VOCABULARY)
    rows = rows.withColumn("p", p).drop("n0", "t0")
    for name in names:
        pairs = seen.groupBy(name, "target").agg(F.sum("n").alias("n1"))
        totals = seen.groupBy(name).agg(F.sum("n").alias("t1"))
        rows = rows.join(pairs, [name, "target"], "left").join(totals, name, "left")
        rows = rows.withColumn("p", (F.coalesce("n1", F.lit(0)) + backoff * F.col("p")) / (F.coalesce("t1", F.lit(0)) + backoff)).drop("n1", "t1")
    return rows.groupBy("id").agg(F.sum(-F.log2("p") * F.col("times")).alias("bits"))


def bits_summary(bits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Mean and median bits a URL and bits a symbol; ``lengths`` has (id, tokens)."""
    return bits.join(lengths, "id").agg(F.count("*").alias("urls"), F.avg("bits").alias("mean_bits"), F.median("bits").alias("median_bits"), (F.sum("bits") / F.sum("tokens")).alias("bits_per_token"))


def balanced_score(seen: float, unseen: float) -> float:
    """Mean of the mean bits a URL on seen and unseen hosts."""
    return (seen + unseen) / 2
