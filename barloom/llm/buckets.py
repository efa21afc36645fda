"""Components of items that share buckets, without expanding a bucket into all its pairs.

Each member of a bucket is compared with one pivot, another in each bucket; the likeliest of these
pairs are proved first, the others only where they still join two components. What is then left are
buckets whose members are in different components. In a bucket of at most MEET members those meet in
pairs. Members of larger ones meet in the groups that `narrow` gives them, which must bring together
every true pair: rare features first, so that members which are alike in common features alone meet
nowhere. Members of one component need no further link between them, and every true pair that
shares a bucket and is in two components is compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, beside, components, release, rows_of

#: Pairs of each member that are proved first.
LIKELY = 4
#: Members of a bucket up to which those of different components meet in pairs.
MEET = 32


def joined_parts(items: DataFrame, alike: Callable[[Column, Column], Column], distance: Callable[[Column, Column], Column], heavy_of: Callable[[DataFrame], DataFrame], exact: Callable[[Column, Column], Column], narrow: Callable[[DataFrame], DataFrame], shelf: Shelf) -> DataFrame:
    """Components (id, component) of `items` (id, keys array<long>, light), ids unique and not null.

    `alike` tells from the light columns of two items whether the pair is worth a proof, and must
    hold for every true pair; `distance` orders pairs, likely ones first. `heavy_of` gives (id,
    heavy) for the ids of a table (id) at least, `exact` tells true pairs by their heavy columns.
    `narrow` gives for a table (id, part) pairs (a, b) and their parts (p, q), different ones, that hold
    every true pair at least. Items without a link may be missing from the result. All tables, the result
    too, are on `shelf`.
    """
    keep = shelf.put
    posted = items.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    # Most keys stand once: they go by a count of bare keys, before ids are moved.
    shared = keep(posted.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("members")).where("members > 1"))
    release(items.sparkSession)
    held = keep(beside(posted, shared, "key"))
    # The pivot is the member whose id is smallest after its bits are flipped by the key's hash.
    flip = F.xxhash64("key")
    pivots = keep(held.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(flip)).alias("p")).select("key", F.col("p").bitwiseXOR(flip).alias("pivot")))
    light = items.select("id", "light")
    lit_up = lambda side: light.select(F.col("id").alias(side), F.col("light").alias(f"l_{side}"))
    la, lb = F.col("l_a"), F.col("l_b")

    def side(heavy: DataFrame, name: str) -> DataFrame:
        return heavy.select(F.col("id").alias(name), F.col("heavy").alias(f"h_{name}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        heavy = heavy_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        found = keep(pairs.join(side(heavy, "a"), "a").join(side(heavy, "b"), "b").where(exact(F.col("h_a"), F.col("h_b"))).select("a", "b"))
        shelf.drop(heavy)
        return found

    def between(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        part = lambda end: label.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
        named = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left")
        return named.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)

    star = beside(held, pivots, "key").where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = keep(star.join(lit_up("a"), "a").join(lit_up("b"), "b").where(alike(la, lb)).select("a", "b", distance(la, lb).alias("d")))
    # A member has at most one pivot for each of its keys, so that no window is large.
    likely = star.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))).where(f"rank <= {LIKELY}")
    likely = keep(likely.select("a", "b"))
    links = confirmed(likely)
    label = components(links, shelf=shelf)
    further = keep(between(star.select("a", "b"), label).join(likely, ["a", "b"], "left_anti"))
    if rows_of(further):
        links = links.union(confirmed(further))
        label = components(links, shelf=shelf)
    # Members of buckets that hold more than one component.
    in_part = keep(held.join(label, "id", "left").select("key", "members", "id", F.coalesce("component", "id").alias("part")))
    mixed = keep(in_part.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("key"))
    rest = keep(beside(in_part, mixed, "key"))
    shelf.drop(held)
    shelf.drop(in_part)
    release(items.sparkSession)

    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    small = rest.where(F.col("members") <= MEET).join(light, "id")
    one = small.select("key", F.col("id").alias("a"), F.col("part").alias("p"), F.col("light").alias("l_a"))
    other = small.select("key", F.col("id").alias("b"), F.col("part").alias("q"), F.col("light").alias("l_b"))
    pairs = one.join(other, "key").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & alike(la, lb)).select("a", "b").distinct()
    pairs = keep(pairs.join(tried, ["a", "b"], "left_anti"))
    if rows_of(pairs):
        links = links.union(confirmed(pairs))
        label = components(links, shelf=shelf)
    large = keep(rest.where(F.col("members") > MEET).select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("part")))
    if not rows_of(large):
        return label
    keyed = items.select("id", "keys", "light")
    end = lambda name: keyed.select(F.col("id").alias(name), F.col("keys").alias(f"k_{name}"), F.col("light").alias(f"l_{name}"))
    met = keep(narrow(large).distinct())
    met = met.join(end("a"), "a").join(end("b"), "b").where(F.arrays_overlap("k_a", "k_b") & alike(la, lb))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), distance(la, lb).alias("d"))
    met = keep(met.join(tried, ["a", "b"], "left_anti"))
    # Of two components the likeliest pairs first: one link joins them.
    first = met.withColumn("rank", F.row_number().over(Window.partitionBy("p", "q").orderBy("d", "a", "b"))).where(f"rank <= {LIKELY}").select("a", "b")
    for pairs in (lambda: first, lambda: between(met.select("a", "b"), label).join(first, ["a", "b"], "left_anti")):
        now = keep(pairs())
        if rows_of(now):
            links = links.union(confirmed(now))
            label = components(links, shelf=shelf)
    return label
