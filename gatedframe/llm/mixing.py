"""Mixing sources to target weights, with DataFrame functions alone.

The words of each source, its documents in a hashed order, are packed into blocks of fixed length. How many slots of
each output shard a source gets is drawn from the multinomial distribution given the source's total (all slots of the mix are dealt to the shards by one
pseudorandom permutation and counted). The slots of a source are numbered through all shards, and each number is mapped to a block by a
permutation of the source's blocks, a new one each time the source has been used up. A join by block index gives how often each document's words are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch
from gatedframe.llm.words import word_count

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used this often at most.
REPEATS = 3
#: Words in a block, and slots in an output shard.
BLOCK, SHARD_SLOTS = 64, 8192
#: Output shards of a source that are numbered in one task, and slots that are unfolded from one row.
CHUNK_SHARDS, CHUNK_TURNS = 4096, 4096
#: Slots that one task maps, about, and the most tasks; with more slots each task maps more.
TASK_SLOTS, MOST_TASKS = 50_000, 20_000
#: Documents of a source whose offsets one task adds up, about.
SLICE_DOCS = 8192
#: Rows that are alike in everything and unfold from one row at once.
UNFOLDED = 100_000
ROUNDS = 20
SEED = 11


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source, source_size, ...) with rank, weight and target.

    The targets share the sum of all sizes by weight. None is above ``repeats`` times its source's size; what
    is beyond is shared again by weight among the rest. With the sources in ascending order of size
    for their weight, those that reach their limit come first, and a running sum finds where they end.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(named) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("most", F.lit(repeats) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    leveled = ranked.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything)
    target = F.when(F.col("ratio") < F.col("level"), F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return leveled.withColumn("target", target.cast("double")).drop("most", "ratio", "level")


def _rounded(sources: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: ``column`` as a whole number less than one away, such that any first ranks together have their rounded sum."""
    order = Window.orderBy("rank")
    up_to = lambda frame: F.floor(F.coalesce(F.sum(column).over(frame), F.lit(0.0)) + 0.5)
    through, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    return sources.withColumn(out, up_to(through) - up_to(before))


def _tasks(slots: int) -> int:
    return max(1, min(MOST_TASKS, -(-slots // TASK_SLOTS)))


def draw_counts(sources: DataFrame, slots: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(rank, shard, n): how many slots of each output shard each source gets, where that is any; ``sources`` has (rank, total).

    The totals of all sources fill ``slots``. One permutation of all slots deals them to the shards, so that the counts
    of a shard are a multinomial draw given the totals, every shard is filled, and a source's total never depends on what is drawn. There are no more
    rows than slots, however many sources and shards there are.
    """
    ahead = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    turns = sources.select("rank", "total", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead")).where("total > 0")
    turns = turns.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (total - 1) div {CHUNK_TURNS})"))).repartition(_tasks(slots), "rank", "chunk")
    within = F.expr(f"sequence(ahead + chunk * {CHUNK_TURNS}, ahead + least((chunk + 1) * {CHUNK_TURNS}, total) - 1)")
    place = permuted(F.col("turn"), F.lit(slots).cast("long"), F.lit("draw"))
    dealt = turns.select("rank", F.explode(within).alias("turn")).select("rank", place.alias("place"))
    return dealt.groupBy("rank", F.expr(f"place div {shard_slots}").alias("shard")).agg(F.count("*").alias("n"))


def permuted(x: Column, size: Column, *key: Column) -> Column:
    """Image of ``x`` under a keyed pseudorandom permutation of 0 .. size - 1 (rounds of swap-or-not)."""

    def turn(at: Column, round_: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), round_, *key), size) - at, size)
        swap = F.xxhash64(F.lit(SEED + 1), round_, F.greatest(at, other), *key) < 0
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def _block_times(sources: DataFrame, counts: DataFrame, slots: int) -> DataFrame:
    """(rank, block, times) of the blocks that slots map to. Cells of few bytes unfold to many slots, so they are dealt by number of slots.

    Slots are numbered chunk by chunk: each chunk of shards on its own, after the sum of the chunks before it.
    """
    chunked = counts.withColumn("chunk", F.floor(F.col("shard") / CHUNK_SHARDS))
    earlier = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunked.groupBy("rank", "chunk").agg(F.sum("n").alias("n")).select("rank", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("rank", "chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = chunked.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0")
    first = ahead.join(bases, ["rank", "chunk"]).select("rank", "shard", "n", (F.col("base") + F.col("ahead")).alias("first"))
    first = first.repartition(_tasks(slots), "rank", "shard")
    unfolded = first.join(sources.where("blocks > 0").select("rank", "blocks"), "rank").select("rank", "blocks", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    block = permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("rank"), F.expr("slot div blocks"))
    return unfolded.select("rank", block.alias("block")).groupBy("rank", "block").agg(F.count("*").alias("times"))


def _mark(docs: DataFrame) -> Column:
    """128 bits of hash of a row, by which rows alike in every column are one; maps can't be hashed and are passed over."""
    kept = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    return F.struct(F.xxhash64(*kept).alias("a"), F.xxhash64(F.lit(SEED), *kept).alias("b"))


def _plan(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, block: int) -> DataFrame:
    """A row per document with its offset in its source's words, and per block that it touches: how often that is taken.

    Columns: doc_id, size, source_size, target, mark (hash of the row), own (rank, slice, nth), lo, hi (words of the document
    in the block), times. A document without words has one row with null lo, hi and times.
    """
    slim = scratch.table(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _mark(docs).alias("mark")), "sizes"
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    blocks = F.ceil(F.col("source_size") / block)
    sources = source_targets(sizes).withColumn("blocks", blocks).withColumn("slices", F.ceil(F.col("docs") / SLICE_DOCS))
    sources = sources.withColumn("uses", F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    # a source at its limit uses REPEATS times its blocks, which rounding can't exceed but by the last bit of a double
    sources = _rounded(sources, "uses", "total").withColumn("total", F.least("total", REPEATS * F.col("blocks")).cast("long"))
    sources = scratch.table(sources, "sources")
    slots = sources.agg(F.sum("total")).first()[0] or 0
    times = _block_times(sources, scratch.table(draw_counts(sources, slots), "counts"), slots)

    placed = slim.join(sources.select(F.col("source").alias("_source"), "source_size", "target", "rank", "slices"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "mark"), "slices"))
    # rows that are alike in everything are counted together, and unfold again behind the windows, some at a time
    alike = placed.groupBy("rank", "slice", "mark", "doc_id", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    by_slice = alike.groupBy("rank", "slice").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slice.select("rank", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("rank", "slice").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumns({c: F.coalesce(F.sum(of).over(own), F.lit(0)) for c, of in (("nth", "copies"), ("ahead", "words"))})
    some = numbered.join(starts, ["rank", "slice"]).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(UNFOLDED))))
    each = some.withColumn("c", F.explode(F.sequence("c", F.least(F.col("c") + UNFOLDED, F.col("copies")) - 1)))
    at = each.withColumns({"nth": F.col("nth") + F.col("c") + 1, "start": F.col("base") + F.col("ahead") + F.col("c") * F.col("size")})
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    cut = at.select("doc_id", "size", "source_size", "target", "mark", "rank", "slice", "nth", "start", F.explode_outer(touched).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")
    return cut.join(times, ["rank", "block"], "left").select(
        "doc_id", "size", "source_size", "target", "mark", F.struct("rank", "slice", "nth").alias("own"), lo.alias("lo"), hi.alias("hi"), F.coalesce("times", F.lit(0)).alias("times")
    )


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    A null text has size 0. Null sources form one source, behind all others. Rows that repeat an id are rows of
    their own. An empty table gives an empty result. The order within a source and all draws come from
    hashes of ids and rows, so that reruns agree.
    """
    plan = _plan(docs, Scratch(docs.sparkSession, "mixing"), id_col, text_col, source_col, block)
    taken = F.coalesce(F.sum((F.col("hi") - F.col("lo")) * F.col("times")), F.lit(0)).alias("taken")
    return plan.groupBy("own", "doc_id", "size", "source_size", "target").agg(taken).drop("own")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per document of which words are taken.

    Its text holds the taken words with the white space behind them; words taken again follow on a new line, in
    the order of the document. A column ``n_chars`` is counted anew. Documents without words (null, empty or blank texts) go, null sources form one
    source, each of some repeated rows is taken on its own, and an empty table gives an empty result.
    """
    plan = _plan(docs, Scratch(docs.sparkSession, "mixing"), id_col, text_col, source_col, block)
    parts = F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("_parts")
    taken = plan.where("times > 0").groupBy("own", "mark").agg(parts).select(F.col("mark").alias("_mark"), "_parts")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _mark(docs).alias("_mark"), F.col(text_col).alias("_text"))
    once = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_mark").orderBy("_text"))).where("_nth = 1").drop("_nth")
    words = F.split(F.regexp_replace("_text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = once.join(taken, "_mark").withColumn("_words", words)

    def copy(n: int) -> Column:
        chosen = F.filter("_parts", lambda p: p["times"] >= n)
        text = F.array_join(F.transform(chosen, lambda p: F.array_join(F.slice("_words", p["lo"].cast("int") + 1, (p["hi"] - p["lo"]).cast("int")), "")), "")
        return F.when(F.size(chosen) > 0, text)

    mixed = cut.withColumn("_mixed", F.concat_ws("\n", *(copy(n) for n in range(1, REPEATS + 1))))
    fresh = {text_col: F.col("_mixed")} | ({"n_chars": F.length("_mixed").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return mixed.select(*(fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
