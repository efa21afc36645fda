"""Removes passages whose lines stood earlier, by winnowing over line hashes. DataFrame functions only.

From every line on, a window of following lines is taken until it holds `min_words` words; the
line with the smallest hash in a window is its fingerprint. What a window holds depends on its
text alone, so any two runs of equal lines with at least `min_words` words share a window and
hence a fingerprint: none is missed, and a fingerprint that stands in one place only rules out all
its windows. Matches are extended line by line over all earlier places at once. To the left every
extension is itself a matched window (a window that starts one line earlier ends no later). To the
right a window is also taken together with the lines that follow it, one, two and so on, up to where
the next window ends: such a run stands earlier exactly if its hash does, wherever that is. A run
that is not the first with its hash goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, beside, cut, fresh

#: Words that a repeated run of lines must hold to be removed.
MIN_WORDS = 50


def plain(line: Column) -> Column:
    """A line as it is compared: runs of white space are one space, none at the ends."""
    return F.trim(F.regexp_replace(line, f"[{SPACES}]+", " "))


def windows(docs: DataFrame, *, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """For each line with words: its document (id and text hash), place, and the window from it on."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("dk"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    text = lines.select("id", "dk", "pos", plain(F.col("line")).alias("line")).where("line != ''")
    unit = text.select("id", "dk", "pos", F.xxhash64("line").alias("h"), (F.length("line") - F.length(F.translate("line", " ", "")) + 1).cast("long").alias("w"))
    # Repeated rows of one document bring the same lines: one of each place.
    unit = unit.repartition("id", "dk").groupBy("id", "dk", "pos").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    of = Window.partitionBy("id", "dk")
    placed = unit.select("*", (F.sum("w").over(of.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("before"), F.row_number().over(of.orderBy("pos")).alias("nth"))
    # A line is in the window if fewer than min_words words stand between the window's start and it.
    ahead = of.orderBy("before").rangeBetween(0, min_words - 1)
    held = placed.select("id", "dk", "nth", F.collect_list("h").over(ahead).alias("hashes"), (F.max(F.col("before") + F.col("w")).over(ahead) >= F.col("before") + min_words).alias("whole"))
    # The next window, or at the end of the text what is left of it, has the lines that follow this one.
    after, ends = F.lead("hashes").over(of.orderBy("nth")), F.lead("whole").over(of.orderBy("nth"))
    held = held.select("*", after.alias("after"), ends.alias("ends")).where("whole")
    more = F.coalesce(F.size("after") + 1 - F.size("hashes"), F.lit(0))
    beyond = F.slice("after", F.size("after") - more + 1, F.greatest(more - F.col("ends").cast("int"), F.lit(0)))
    return held.select("id", "dk", "nth", "hashes", F.when(more > 0, beyond).otherwise(F.array().cast("array<bigint>")).alias("beyond"))


def repeated(docs: DataFrame, *, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """The lines to remove: id, dk (text hash), numbers array<int> among the lines with words, from 1."""
    full = cut(windows(docs, min_words=min_words, id_col=id_col, text_col=text_col).withColumn("fingerprint", F.array_min("hashes")))
    place = F.xxhash64("id", "dk", F.col("nth") + F.array_position("hashes", F.col("fingerprint")))
    twice = cut(full.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high").select("fingerprint"))
    longer = F.transform(F.sequence(F.lit(0), F.size("beyond")), lambda k: F.struct((F.size("hashes") + k).alias("n"), F.xxhash64("hashes", F.slice("beyond", F.lit(1), k)).alias("run")))
    found = cut(beside(full, twice, "fingerprint").select("id", "dk", "nth", F.explode(longer).alias("r")).select("id", "dk", "nth", "r.n", "r.run"))
    # Of each run, its first place; of a place, all runs that start there are held against that.
    start = F.struct("id", "dk", "nth")
    first = cut(found.groupBy("run").agg(F.min(start).alias("source"), F.max(start).alias("last")).where(~F.col("source").eqNullSafe(F.col("last"))).select("run", "source"))
    again = beside(found, first, "run", rows=100_000).where(~start.eqNullSafe(F.col("source"))).groupBy("id", "dk", "nth").agg(F.max("n").alias("n"))
    gone = again.groupBy("id", "dk").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("nth"), F.col("nth") + F.col("n") - 1))))).alias("numbers"))
    return cut(gone)


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), the value being worked out once even where lambdas inside use it for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def without(lines: Column, numbers: Column) -> Column:
    """The text less the lines of the given numbers among those with words (from 1); in linear time."""
    every = lambda held: F.sequence(F.lit(0), F.size(held) - 1)
    worded = lambda held: F.filter(every(held), lambda i: held[i].rlike(f"[^{SPACES}]"))
    left = lambda held, at: F.array_except(every(held), F.transform(numbers, lambda k: F.get(at, k - 1)))
    return bound(lines, lambda held: bound(worded(held), lambda at: F.array_join(F.transform(left(held, at), lambda i: held[i]), "\n")))


def remove_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with later repeated runs removed from the text, and n_lines, n_removed (long).

    A run is removed if it holds at least `min_words` words and the same lines, in the same order,
    stand earlier: in a document with a smaller id (null ids come first; of texts with one id the
    one with the smaller hash) or earlier in the same document, at whatever place. White space inside lines is not
    compared, blank lines never count. The first place of every line stays, so no text is lost
    altogether. A null text stays null with 0 lines; a text of blank lines is unchanged. Repeated
    rows of one document get the same result. A text whose lines all go becomes empty. A column
    n_chars, where there is one, is set to the new length. Columns named n_lines or n_removed are
    replaced; all others are passed on, whatever their names. An empty table gives an empty table.
    """
    gone = repeated(docs, min_words=min_words, id_col=id_col, text_col=text_col)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    i_, d_, gone_, lines_, text_ = fresh([*docs.columns, "n_lines", "n_removed"], "id", "dk", "gone", "lines", "text")
    gone = gone.select(F.col("id").alias(i_), F.col("dk").alias(d_), F.col("numbers").alias(gone_))
    # Few numbers of lines are broadcast, so that texts do not move; beyond that the texts are joined by a shuffle.
    few = (gone.agg(F.sum(F.size(gone_) + 8)).first()[0] or 0) <= 1_000_000
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(i_)) & (F.xxhash64(f"`{text_col}`") == F.col(d_))
    joined = docs.select(*[F.col(f"`{c}`") for c in kept]).join(F.broadcast(gone) if few else gone, same, "left")
    joined = joined.withColumn(lines_, F.split(f"`{text_col}`", "\n", -1))
    text = F.when(F.col(gone_).isNull(), F.col(f"`{text_col}`")).otherwise(without(F.col(lines_), F.col(gone_)))
    out = joined.withColumn(text_, text)
    columns = [F.col(text_).alias(c) if c == text_col else F.length(text_).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in kept]
    return out.select(*columns, F.coalesce(F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(lines_)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone_), F.lit(0)).cast("long").alias("n_removed"))
