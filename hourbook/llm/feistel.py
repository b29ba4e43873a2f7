"""Pseudorandom permutations of 0..n-1 as DataFrame expressions.

An alternating Feistel network on Z_a x Z_b, with a*b just above n: each
round adds a keyed mix of one half to the other half modulo its size, which
is a bijection whatever the mix is.  Values that leave 0..n-1 are sent
through the network again (cycle walking).  At most a - 1 values lie above
n - 1, and ``walk_steps`` counts how long a walk among them can get, so the
number of repeats is exact and not a guess.

Only integer arithmetic modulo a prime below 2^31 is used; every product
stays below 2^62, so any SQL engine with 64-bit integers gives the same
permutation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647
STEP = 48271
ROUNDS = 6


def round_keys(seed: int) -> list[int]:
    """One key per round, from the seed alone."""
    return [((seed + 1) * 1000003 + (r + 1) * 777767777) % PRIME for r in range(ROUNDS)]


def domain(n: Column) -> tuple[Column, Column]:
    """(a, b) with a*b >= n and a*b - n < a."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    return a, F.greatest(F.ceil(n / a), F.lit(1)).cast("long")


def _image(value: Column, a: Column, b: Column, key: Column, seed: int) -> Column:
    """One pass of the network.  The halves swap in each round, and so do
    their sizes; the number of rounds is even, so the sizes end as they began."""
    keys = F.array(*(F.lit(k).cast("long") for k in round_keys(seed)))

    def one_round(x: Column, k: Column) -> Column:
        t = ((x["r"] + key + k) % PRIME) * STEP % PRIME
        mixed = (t * t + k) % PRIME * STEP % PRIME
        return F.struct(x["r"].alias("l"), ((x["l"] + mixed) % x["a"]).alias("r"), x["b"].alias("a"), x["a"].alias("b"))

    def image(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).alias("r"), a.alias("a"), b.alias("b"))
        return F.aggregate(keys, start, one_round, lambda x: x["l"] * x["b"] + x["r"])

    # As a lambda's variable the value is computed once, however often it is used.
    return F.get(F.transform(F.array(value), image), F.lit(0))


def walk_steps(domains: DataFrame, seed: int) -> int:
    """The longest walk of values outside 0..n-1, over all rows of
    ``domains`` (_n, _key): the number of extra passes that ``permute`` needs."""
    a, b = domain(F.col("_n"))
    # _n + j for the fewer than a values beyond it
    rows = domains.withColumn("_a", a).withColumn("_b", b).filter("_a * _b > _n")
    left = rows.withColumn("_v", F.explode(F.expr("sequence(_n, _a * _b - 1)")))
    # Fewer values stay outside after each pass, until none does but those
    # that the network moves among themselves; no value below _n meets these.
    steps, count = 0, left.count()
    while count:
        left = left.withColumn("_v", _image(F.col("_v"), F.col("_a"), F.col("_b"), F.col("_key"), seed)).filter("_v >= _n")
        count, before = left.count(), count
        if count == before:
            break
        steps += 1
    return steps


def longest_walk(domains: list[tuple[int, int]], seed: int) -> int:
    """``walk_steps`` of a short list (n, key) in plain integers, where Spark jobs
    would cost more than the fewer than a values beyond each n."""
    longest = 0
    for n, key in domains:
        a = max(1, int(np.ceil(np.sqrt(float(n)))))
        sizes = [a, max(1, -(-n // a))]
        left, steps = np.arange(n, a * sizes[1], dtype=np.int64), 0
        while len(left):
            high, low, before = left // sizes[1], left % sizes[1], len(left)
            for k in round_keys(seed):
                t = (low + key + k) % PRIME * STEP % PRIME
                high, low = low, (high + (t * t + k) % PRIME * STEP % PRIME) % sizes[0]
                sizes.reverse()
            left = high * sizes[1] + low
            left = left[left >= n]
            if len(left) == before:
                break
            steps += 1
        longest = max(longest, steps)
    return longest


def permute(df: DataFrame, value: str, out: str, seed: int, steps: int) -> DataFrame:
    """``out``: the image of ``value`` under the permutation of 0.._n-1 chosen
    by ``seed`` and the column ``_key``."""
    a, b = domain(F.col("_n"))
    df = df.withColumn("_a", a).withColumn("_b", b)

    def walk(v: Column, i: Column) -> Column:
        again = (i == 0) | (v >= F.col("_n"))
        return F.when(again, _image(v, F.col("_a"), F.col("_b"), F.col("_key"), seed)).otherwise(v)

    turns = F.array(*(F.lit(i) for i in range(steps + 1)))
    return df.withColumn(out, F.aggregate(turns, F.col(value), walk)).drop("_a", "_b")
