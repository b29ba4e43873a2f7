"""Mixing sources to target weights by blocks.

The documents of a source, in an order fixed by a hash of their ids, form
one stream of words that is cut into blocks of ``block_words`` (the last may be
shorter).  Each source gets a target and so a number of block draws.  Each output
shard draws its source counts from the multinomial distribution with these
proportions.  The counts of a source over all shards then miss its number of draws
by chance (by about the root of it), so its surplus draws, picked by a permutation
from all shards alike, are handed to the sources that lack some: the mix meets its
targets and no block is drawn more than twice.  Draw k of a source takes the block
that the source's index permutation gives to ``k mod blocks``; each pass over a
source has its own permutation.  Blocks are joined to slots by (source, index).

Targets: weights 3, 1, 2 repeat over the sources by code point (null last)
and share 150 % of all sizes; a target stops at 2 times its source's size and
the excess goes to the others by weight.

Sizes at scale: prefix sums come from range partitions, never from one window
over a source; shards draw apart; what a shard sends on are its counts.  The
table of sources has one row per source and is the only thing the driver holds.

Defined results: a null text or one without words has size 0 and takes 0; a
null source is a source of its own; equal rows are separate documents; an
empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourbook.llm.common import fresh_name, positions, row_hash, stored, word_array
from hourbook.llm.feistel import longest_walk, permute

BLOCK_WORDS = 64
SLOTS_PER_SHARD = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 10


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) -> also rank, weight and target.  One row
    per source; the windows here run over that small table only."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # With all earlier (tighter) sources at their caps, the rest share by
    # weight; this level rises up to the last capped source and falls after.
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("_level", left / rest)
    target = F.least(F.col("_cap"), F.col("weight") * F.max("_level").over(everything))
    return levels.select("source", "source_size", "rank", "weight", target.alias("target"))


def _before(counts: list[int]) -> list[int]:
    """The sum of all earlier counts."""
    return [0, *accumulate(counts)][: len(counts)]


def _list(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values)).cast("array<bigint>")


def _last_at_most(firsts: Column, n: int, value: Column) -> Column:
    """The place of the last of ``n`` ascending ``firsts`` that is not above
    ``value``, by binary search."""
    halves = F.array(*(F.lit(1 << i).cast("long") for i in reversed(range(max(1, n).bit_length())))).cast("array<bigint>")

    def search(x: Column) -> Column:
        return F.aggregate(halves, F.lit(0).cast("long"), lambda at, step: F.when(F.get(firsts, at + step) <= x, at + step).otherwise(at))

    # As a lambda's variable the value is computed once.
    return F.get(F.transform(F.array(value), search), F.lit(0))


class Mix:
    """The parts of one mix: ``documents`` (a row per document with its place),
    ``sources``, ``shard_counts`` (shard, rank, n: the multinomial draws), ``slots``
    (shard, slot, rank, epoch, block) and ``pieces`` (what each drawn block holds of
    each document)."""

    def __init__(
        self, docs: DataFrame, block_words: int = BLOCK_WORDS, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        row_col: str | None = None, tie_col: str | None = None,
    ):
        """``row_col``: a unique number of each row, kept in ``documents`` as
        ``own_row``; ``tie_col`` orders rows that are equal in id, source and text."""
        spark = docs.sparkSession
        self.block_words, self.seed = block_words, seed
        thin = docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.xxhash64(text_col).alias("text_hash"),
            F.size(word_array(F.col(text_col))).cast("long").alias("size"),
            *([F.col(row_col).alias("own_row")] if row_col else []),
            *([F.col(tie_col).alias("tie")] if tie_col else []),
        )
        order = [F.col("source").asc_nulls_last(), F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash"), F.col("size")]
        order += [F.col("tie")] if tie_col else []
        # Stored, so that drawing the range bounds doesn't count all words again.
        numbered, _, _ = positions(stored(thin, "mix-sizes"), order, F.col("size"))
        sizes = numbered.groupBy("source").agg(F.sum("size").alias("source_size"))
        blocks = F.ceil(F.col("source_size") / block_words).cast("long")
        draws = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * blocks)).otherwise(0).cast("long")
        planned = source_targets(sizes, weights, share, cap).withColumn("blocks", blocks).withColumn("draws", draws)
        # Rows are numbered source by source, so a source starts where the sizes before it end.
        before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        start, first = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("source_size", "draws"))
        planned = planned.withColumn("source_start", start)
        self.sources = stored(planned.withColumn("first_draw", first), "mix-sources")
        s = self.sources.select(F.col("source").alias("_source"), "rank", "source_size", "source_start", "target", "blocks")
        self.documents = numbered.join(s, F.col("source").eqNullSafe(F.col("_source"))).select(
            F.col("_row").alias("row"), "doc_id", "source", "text_hash", "size", "source_size", "target", "rank",
            (F.col("_before") - F.col("source_start")).alias("start"), *(["own_row"] if row_col else []),
        )
        self.slots = self._slots(spark)
        self.pieces = self._pieces()

    def _slots(self, spark) -> DataFrame:
        """shard, slot, rank, epoch, block.  The lists by rank have an entry per source."""
        ranked = [r.asDict() for r in self.sources.select("rank", "draws", "blocks", "first_draw").orderBy("rank").collect()]
        total = sum(r["draws"] for r in ranked)
        shards = -(-total // SLOTS_PER_SHARD)
        drawn = stored(self._shard_counts(spark, [r["first_draw"] for r in ranked], total, shards), "mix-counts")
        self.shard_counts = drawn
        sums = {r["rank"]: r["n"] for r in drawn.groupBy("rank").agg(F.sum("n").alias("n")).collect()}
        got = [sums.get(r["rank"], 0) for r in ranked]
        over = [max(0, n - r["draws"]) for n, r in zip(got, ranked)]
        under = [max(0, r["draws"] - n) for n, r in zip(got, ranked)]
        draws, blocks = _list([r["draws"] for r in ranked]), _list([r["blocks"] for r in ranked])
        got_, got_first, over_first, under_first = _list(got), _list(_before(got)), _list(_before(over)), _list(_before(under))

        # A source's draws are numbered shard by shard, and laid out in a shard source by source.
        numbered, _, _ = positions(drawn, [F.col("rank"), F.col("shard")], F.col("n"))
        numbered = numbered.select("shard", "rank", "n", (F.col("_before") - F.get(got_first, F.col("rank"))).alias("_first"))
        # A row of counts is up to a shard's slots: spread them before they unfold.
        numbered = numbered.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
        in_shard = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        numbered = numbered.withColumn("_laid", F.coalesce(F.sum("n").over(in_shard), F.lit(0)))
        each = numbered.withColumn("_i", F.explode(F.expr("sequence(0L, n - 1)")))
        each = each.select("shard", "rank", (F.col("_first") + F.col("_i")).alias("_k"), (F.col("_laid") + F.col("_i")).alias("_at"))

        # The permutation of a source's draws picks those that it drew too often;
        # they go, in order, to the sources that were drawn too seldom.
        domains = [(n, 64 * rank) for rank, n in enumerate(got) if n]
        steps = longest_walk(domains, self.seed)
        each = each.withColumn("_n", F.get(got_, F.col("rank"))).withColumn("_key", F.col("rank") * 64)
        each = permute(each, "_k", "_index", self.seed, steps)
        surplus = F.col("_index") - F.get(draws, F.col("rank"))
        moved = F.when(surplus >= 0, F.get(over_first, F.col("rank")) + surplus)
        each = each.withColumn("_moved", moved).withColumn("_to", F.when(F.col("_moved").isNotNull(), _last_at_most(under_first, len(ranked), F.col("_moved"))))
        fresh = F.get(got_, F.col("_to")) + F.col("_moved") - F.get(under_first, F.col("_to"))
        each = each.withColumn("_draw", F.coalesce(fresh, F.col("_index"))).withColumn("rank", F.coalesce("_to", "rank"))

        # Draw j of a source takes a block by the permutation of its pass.
        each = each.withColumn("_n", F.get(blocks, F.col("rank")))
        each = each.withColumn("epoch", F.expr("_draw div _n")).withColumn("_in", F.expr("_draw % _n"))
        passes = [(r["blocks"], 64 * r["rank"] + e + 1) for r in ranked if r["draws"] for e in range(-(-r["draws"] // r["blocks"]))]
        steps = longest_walk(passes, self.seed)
        each = permute(each.withColumn("_key", F.col("rank") * 64 + F.col("epoch") + 1), "_in", "block", self.seed, steps)

        # Slots of a shard are shuffled.  Whole shards are a square, so only the last one walks.
        last = total - (shards - 1) * SLOTS_PER_SHARD
        steps = longest_walk([(last, shards - 1)] if total else [], self.seed + 1)
        size = F.when(F.col("shard") == shards - 1, F.lit(last)).otherwise(F.lit(SLOTS_PER_SHARD)).cast("long")
        each = permute(each.withColumn("_n", size).withColumn("_key", F.col("shard")), "_at", "slot", self.seed + 1, steps)
        # None of these is null.  Told so, Spark infers no null filters for the join
        # on rank and block, which it would push below every step above and so
        # run the permutations several times over.
        known = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rank", "epoch", "block"))
        return each.select("shard", "slot", *known)

    def _shard_counts(self, spark, first_draw: list[int], total: int, shards: int) -> DataFrame:
        """shard, rank, n: a multinomial draw for each shard.  Each of its slots
        draws a source by the hash of (seed, shard, slot), in proportion to the
        sources' planned draws; only the counts leave the task."""
        slots = F.expr(f"sequence(0L, least({SLOTS_PER_SHARD}L, {total}L - shard * {SLOTS_PER_SHARD}L) - 1)")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        each = spark.range(0, shards, 1, tasks).select(F.col("id").alias("shard")).withColumn("_slot", F.explode(slots))
        at = F.pmod(F.xxhash64(F.lit(self.seed).cast("long"), F.col("shard"), F.col("_slot")), F.lit(max(1, total)).cast("long"))
        each = each.select("shard", _last_at_most(_list(first_draw), len(first_draw), at).alias("rank"))
        return each.groupBy("shard", "rank").agg(F.count("*").alias("n"))

    def _pieces(self) -> DataFrame:
        """row, doc_id, text_hash, block, from_word (within the document),
        words, times: the part of a document in each block that is drawn."""
        size = self.block_words
        times = self.slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
        parts = self.documents.filter("size > 0").withColumn(
            "block", F.explode(F.expr(f"sequence(start div {size}, (start + size - 1) div {size})"))
        )
        begin, end = F.greatest(F.col("block") * size, F.col("start")), F.least((F.col("block") + 1) * size, F.col("start") + F.col("size"))
        parts = parts.withColumn("from_word", begin - F.col("start")).withColumn("words", end - begin)
        # Spark would take the unfolded draws to be as small as the table of
        # sources that they come from, and broadcast them.
        return parts.join(times.hint("merge"), ["rank", "block"]).select("row", "doc_id", "text_hash", "block", "from_word", "words", "times")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken."""
        words = self.pieces.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        return self.documents.join(words.hint("merge"), "row", "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )


def _runs(parts: Column, copy: int) -> Column:
    """Runs (from_word, words) of neighbouring parts that are drawn at least
    ``copy`` times, from parts sorted by place."""
    drawn = F.filter(parts, lambda p: p["times"] >= copy)

    def add(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["from_word"].alias("from_word"), (last["words"] + p["words"]).alias("words"))
        fresh = F.struct(p["from_word"].alias("from_word"), p["words"].alias("words"))
        follows = F.coalesce(last["from_word"] + last["words"] == p["from_word"], F.lit(False))
        return F.when(follows, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(fresh)))

    empty = F.array().cast("array<struct<from_word:bigint,words:bigint>>")
    return F.aggregate(drawn, empty, add)


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = None, **options
) -> DataFrame:
    """The mix as rows with the columns of ``docs``: for each document and each
    time it is drawn, one row per run of neighbouring drawn blocks with the
    words of that run and the white space between them.  A document that is
    drawn whole keeps its text; ``chars_col`` gets the new length."""
    names = {k: fresh_name(docs, k) for k in ("own_row", "own_tie", "own_runs", "own_part")}
    own, tie, own_runs, own_part = names.values()
    # Every row gets a number, so that rows that are equal in all columns are
    # told apart without meeting.
    marked = stored(docs.withColumn(own, F.monotonically_increasing_id()).withColumn(tie, row_hash(docs)), "mix-rows")
    mix = Mix(marked, id_col=id_col, text_col=text_col, source_col=source_col, row_col=own, tie_col=tie, **options)
    sorted_parts = F.sort_array(F.collect_list(F.struct("from_word", "words", "times")))
    by_row = mix.pieces.groupBy("row").agg(sorted_parts.alias("parts"))
    runs = F.concat(*(_runs(F.col("parts"), copy) for copy in range(1, int(options.get("cap", CAP)) + 1)))
    by_row = by_row.select("row", runs.alias(own_runs))
    drawn = mix.documents.select("row", F.col("own_row").alias(own)).join(by_row.hint("merge"), "row").drop("row")
    joined = marked.join(drawn.hint("merge"), own)
    # Each word with the white space after it.
    clean = F.regexp_replace(F.col(text_col), r"^[\x20\x09-\x0D]+", "")
    spaced = F.split(clean, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")

    def cut(words: Column, run: Column) -> Column:
        part = F.array_join(F.slice(words, (run["from_word"] + 1).cast("int"), run["words"].cast("int")), "")
        return F.when(run["words"] == F.size(words), F.col(text_col)).otherwise(F.regexp_replace(part, r"[\x20\x09-\x0D]+$", ""))

    # As a lambda's variable a text's words are split once, and all its runs are
    # cut from them before they become rows.
    pieces = F.get(F.transform(F.array(spaced), lambda words: F.transform(F.col(own_runs), lambda run: cut(words, run))), F.lit(0))
    # No text is without runs here; from ``explode`` Spark would infer a filter
    # that cuts them twice more.
    out = joined.withColumn(own_part, pieces).withColumn(text_col, F.explode_outer(own_part))
    if chars_col:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
