"""Document fingerprints by one-permutation MinHash, with DataFrame functions alone.

Five-word shingles are hashed once. The top bits of a hash choose a bin and each bin keeps its smallest hash;
an empty bin borrows the value of a bin probed in a pseudorandom order of its own (optimal densification). Of every
value the low eight bits are stored, and likeness is corrected for bits that agree by chance.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch
from gatedframe.llm.words import word_array

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: Probes tried one by one; a bin that finds none in so many takes the best of all occupied bins by one hash.
PROBES = 8
LOW_BITS = 8
#: Rows of a slice within which neighbours are found, about, and the most slices.
SLICE_ROWS, MOST_SLICES = 2048, 1 << 15
LEAST = -(1 << 63)


def _bin(h: Column) -> Column:
    """The top bits, as 0 .. BINS - 1 in the order of signed hashes."""
    return (F.shiftright(h, 64 - BIN_BITS) + (BINS >> 1)).cast("int")


def with_signature(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with an array<tinyint> of BINS low-order bytes (less 128); null for a text without words.

    A text of fewer words than a shingle is one shingle.
    """
    words, shingles, least, at, filled = (f"_{out}_{x}" for x in ("words", "shingles", "least", "at", "filled"))
    hashed = F.transform(word_array(F.lower(F.col(text_col))), lambda w: F.xxhash64(w))
    n = F.size(words)
    several = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    one = F.when(n > 0, F.array(F.xxhash64(F.col(words)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(words, hashed).withColumn(shingles, F.sort_array(F.when(n >= SHINGLE, several).otherwise(one)))
    # sorted hashes: a bin's smallest is the first of its run
    df = df.withColumn(least, F.filter(shingles, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(shingles, i - 1)))))
    bins = F.transform(least, lambda h: _bin(h))
    lookup = lambda b: F.get(least, F.array_position(f"{at}_bins", b).cast("int") - 1)
    df = df.withColumn(f"{at}_bins", bins).withColumn(at, F.when(F.size(f"{at}_bins") > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lookup)))
    rng = random.Random(17)
    tables = [F.array(*(F.lit(rng.randrange(BINS)) for _ in range(BINS))) for _ in range(PROBES)]

    def borrowed(b: Column) -> Column:
        any_ = F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(b, _bin(h)).alias("p"), h.alias("h"))))["h"]
        return F.coalesce(F.get(at, b), *(F.get(at, F.get(t, b)) for t in tables), any_)

    df = df.withColumn(filled, F.when(F.col(at).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), borrowed)))
    low = F.transform(filled, lambda h: (h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)) - 128).cast("tinyint"))
    return df.withColumn(out, low).drop(words, shingles, least, at, f"{at}_bins", filled)


def packed(signature: Column) -> Column:
    """The signature as lowercase hex, all zeros for a text without words."""
    digits = F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v.cast("int") + 128)), 2, "0")), "")
    return F.coalesce(digits, F.lit("00" * BINS))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures: the share of equal values, less what chance gives."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-LOW_BITS
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(corrected)


def _slice(bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds at or below (``_key``, ``_tie``), by a binary search."""
    if not bounds:
        return F.lit(0)
    keys, ties = (F.array(*map(F.lit, column)) for column in zip(*bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    reached = lambda at: (F.get(keys, at) < F.col("_key")) | ((F.get(keys, at) == F.col("_key")) & (F.get(ties, at) <= F.col("_tie")))
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(reached(found + step - 1), found + step).otherwise(found))


def _bounds(keyed: DataFrame, slices: int) -> list[tuple[int, int]]:
    """Lower ends of all slices but the first. A key that fills several slices (one id repeated, or none) is cut by the tie, which is spread evenly."""
    if slices <= 1:
        return []
    shares = [k / slices for k in range(1, slices)]
    times = Counter(keyed.agg(F.percentile_approx("_key", shares, max(10_000, 20 * slices))).first()[0])
    return sorted((key, LEAST + j * ((1 << 64) // n)) for key, n in times.items() for j in range(n))


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``docs`` with next_<column>: the values of the next row by descending id, and of the first after the last.

    Null ids stand last, and rows of equal id in an order of their own that is drawn from their places in the input. Rows are dealt to ranges of id and place; the
    first row of each range is also sent to the range before, so that neighbours meet without ordering the table, or the rows of one id, in one task.
    Rows are written with their places first, since places given anew could differ.
    """
    keyed = docs.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    keyed = Scratch(docs.sparkSession, "fingerprints").table(keyed, "keyed")
    keyed = keyed.withColumn("_slice", _slice(_bounds(keyed, min(MOST_SLICES, -(-keyed.count() // SLICE_ROWS)))))
    # of each slice the first row in descending order; as many rows as slices
    tops = keyed.groupBy("_slice").agg(F.max(F.struct("_key", "_tie")).alias("_top"))
    before = F.coalesce(F.lead("_slice").over(Window.orderBy("_slice")), F.min("_slice").over(Window.partitionBy()))
    tops = tops.select(F.col("_top._key").alias("_top"), F.col("_top._tie").alias("_top_tie"), before.alias("_to"))
    # tops has MOST_SLICES rows at most
    met = keyed.join(F.broadcast(tops), (F.col("_key") == F.col("_top")) & (F.col("_tie") == F.col("_top_tie")), "left")
    host, guest = F.struct(F.col("_slice").alias("s"), F.lit(0).alias("g")), F.struct(F.col("_to").alias("s"), F.lit(1).alias("g"))
    sent = F.explode(F.when(F.col("_to").isNull(), F.array(host)).otherwise(F.array(host, guest)))
    both = met.withColumn("_sent", sent).withColumn("_slice", F.col("_sent.s")).withColumn("_guest", F.col("_sent.g")).drop("_sent", "_top", "_top_tie", "_to")
    order = Window.partitionBy("_slice").orderBy("_guest", F.desc("_key"), F.desc("_tie"))
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("_guest = 0").drop("_guest", "_slice", "_key", "_tie")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document's
    (or all of them). A null text counts as empty; texts without words are alike to each other alone. Rows that repeat an
    id follow each other. An empty table gives an empty result and other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = with_next(with_signature(slim, "text", "sig"), "doc_id", ["text", "sig"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cast(floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half))
    changed = signed.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    both = with_signature(changed.drop("text", "next_text"), "edited", "edited_sig")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
