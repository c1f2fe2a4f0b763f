"""Fill-in-middle: a text is cut into prefix, middle and suffix between tokens, and rearranged around sentinels.

All of it is expressions: ``regexp_extract_all`` makes the array of units, ``conv`` of digits of a ``sha2`` gives the cuts, ``slice`` and
``array_join`` build the arrangement, and the text is restored by splitting at the sentinels. A row is worked out from itself alone, so nothing is
shuffled, and a row read again after a lost executor gives the same result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word with the gap before it; a gap at the end of the text is one of its own.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Marks that open the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PARTS = 8


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Sentinels that can't be mistaken: none is empty, lies in another, or ends as one begins, so that none arises where text meets a sentinel."""
    prefix, suffix, middle = sentinels
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            meets = any(a.endswith(b[:n]) for n in range(1, len(b)))
            if not a or meets or (i != j and a in b):
                raise ValueError(f"sentinels {a!r} and {b!r} can be mistaken for one another")
    return prefix, suffix, middle


def _draw(digest: Column, nth: int) -> Column:
    """The nth group of 8 hexadecimal digits of ``digest``, from 0, as a number."""
    return F.conv(F.substring(digest, 1 + nth * PARTS, PARTS), 16, 10).cast("long")


def transform(
    docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, sentinels: Sequence[str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text", out: str = "fim"
) -> DataFrame:
    """``docs`` with a struct ``fim`` of n (units of the text), form (``plain``, ``psm`` or ``spm``), prefix, middle, suffix (null if plain) and output.

    Cuts, form and order are drawn from the sha256 of ``seed:id``, so that they stay the same however the table is dealt out. A text stays plain if it is
    empty, holds a sentinel, or isn't drawn (``fim_percent`` are); of the others ``spm_percent`` put the suffix first. A null text counts as empty and a null id as one without digits;
    rows that repeat an id are cut by the same numbers. The struct's name gets underscores behind it until it differs from all columns, in any case of letters. An empty table
    gives an empty result.
    """
    prefix, suffix, middle = _checked(sentinels)
    while out.lower() in {c.lower() for c in docs.columns}:
        out += "_"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    work = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.sha2(key, 256).alias("digest"))
    # each projection names what the one before it worked out, so that a text is matched once
    work = work.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    work = work.withColumn("n", F.size("units").cast("long"))
    cuts = [F.pmod(_draw(F.col("digest"), k), F.col("n") + 1) for k in (0, 1)]
    marked = F.lit(False)
    for s in sentinels:
        marked |= F.contains("text", F.lit(s))
    plain = (F.col("text") == "") | marked | (F.pmod(_draw(F.col("digest"), 2), F.lit(100)) >= fim_percent)
    order = F.when(F.pmod(_draw(F.col("digest"), 3), F.lit(100)) < spm_percent, SPM).otherwise(PSM)
    work = work.withColumns({"a": F.least(*cuts).cast("int"), "b": F.greatest(*cuts).cast("int"), "form": F.when(plain, PLAIN).otherwise(order)})
    part = lambda start, length: F.when(F.col("form") != PLAIN, F.array_join(F.slice("units", start, length), ""))
    work = work.withColumns({"p": part(F.lit(1), F.col("a")), "m": part(F.col("a") + 1, F.col("b") - F.col("a")), "s": part(F.col("b") + 1, F.col("n").cast("int") - F.col("b"))})
    psm = F.concat(F.lit(prefix), "p", F.lit(suffix), "s", F.lit(middle), "m")
    spm = F.concat(F.lit(suffix), "s", F.lit(prefix), "p", F.lit(middle), "m")
    output = F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(F.col("text"))
    found = F.struct("n", "form", F.col("p").alias("prefix"), F.col("m").alias("middle"), F.col("s").alias("suffix"), output.alias("output"))
    return work.select("row.*", found.alias(out))


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that was rearranged, from what its sentinels set apart; null where an arranged text doesn't hold each of them once, in the order of its form."""
    prefix, suffix, middle = _checked(sentinels)
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels))
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    # put together again it must be the output, which tells the order of the sentinels
    whole = lambda a, b, text: F.when((F.size(parts) == 4) & (output == F.concat(F.lit(a), first, F.lit(b), second, F.lit(middle), third)), text)
    restored = F.when(form == PSM, whole(prefix, suffix, F.concat(first, third, second))).when(form == SPM, whole(suffix, prefix, F.concat(second, third, first)))
    return restored.when(form == PLAIN, output)
