"""MinHash near-deduplication with odd sketches.

Candidates come from banded MinHash buckets. Each document's MinHash samples are also folded into
a parity bitmap (an odd sketch): the population count of two bitmaps' XOR estimates the share of
equal samples precisely where similarity is high, so most false candidates go without their full
sets being fetched. What is left is confirmed on full shingle sets. Chosen links make components.

Copies of one set collapse first; buckets are not expanded into all their pairs (see buckets), and what
is left of large ones meets by rare shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import joined_parts
from .common import Shelf, beside, cut, fresh, release

BANDS, ROWS = 40, 5
#: Shingles that a worker hands on at once: 2 MB.
BATCH_SHINGLES = 250_000
SKETCH_WORDS = 16  # of 64 bits
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: a public 64-bit finaliser


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of x decides about half of the bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct n-word shingles of a text.

    Letters A-Z are lowered; words are runs of anything but space and 09-0D. A text of fewer
    words has its whole sequence as one shingle; one without words has none.
    """

    def __init__(self, size: int, cache: int = 400_000) -> None:
        self.size, self.cache, self.known = size, cache, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.cache:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        with np.errstate(over="ignore"):
            out = h[: len(h) - n + 1]
            for k in range(1, n):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])  # fixed value: 2**64 over the golden ratio
            out = mix(out + np.uint64(n))
        return np.unique(out)


class MinHash:
    """bands x rows MinHash samples of a set of 64-bit hashes, and what is made of them."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        draw = lambda n: rng.integers(0, 2**64, n, np.uint64)
        self.mul, self.add, self.salt, self.bit = draw(bands * rows) | np.uint64(1), draw(bands * rows), draw(bands * rows), draw(bands)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        """Smallest value of each hash function, the high 32 bits of multiply-add."""
        low = np.full(self.mul.size, 2**64 - 1, np.uint64)
        with np.errstate(over="ignore"):
            for s in range(0, shingles.size, 128):
                low = np.minimum(low, (shingles[s : s + 128, None] * self.mul + self.add).min(axis=0))
        return low

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One bucket key for each band; the band's number is part of it."""
        with np.errstate(over="ignore"):
            h = self.bit.copy()
            for column in samples.reshape(self.bands, self.rows).T:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
        return h.view(np.int64)

    def odd_sketch(self, samples: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
        """Parity bitmap: each (function, sample) flips one bit."""
        with np.errstate(over="ignore"):
            at = mix(samples ^ self.salt) % np.uint64(64 * words)
        odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_limit(similarity: float, samples: int, bits: int, sigmas: float = 4.75) -> int:
    """XOR population count that a pair of the given similarity exceeds with probability about
    1e-6: so many standard deviations above its mean. The deviation has two independent parts, the
    number of unequal samples (binomial) and how their two flips each fall on the bits."""
    flips = 2 * samples * (1 - similarity)
    mean = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    slope = 2 * (1 - 2 / bits) ** flips
    falls = bits / 4 * (1 - (1 - 4 / bits) ** flips) + bits**2 / 4 * ((1 - 4 / bits) ** flips - (1 - 2 / bits) ** (2 * flips))
    return math.ceil(mean + sigmas * math.sqrt(slope**2 * samples * similarity * (1 - similarity) + max(0.0, falls)))


def signatures(docs: DataFrame, *, size: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_hash (128 bits in hex; null for no shingles), keys, sketch of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sketch = Shingler(size), MinHash(bands, rows)
        for part in parts:
            n, whole, keys, odd = [], [], [], []
            for text in part.column(1):
                s = shingle(text.as_py())
                n.append(s.size)
                if s.size:
                    low = sketch.samples(s)
                    whole.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                    keys.append(sketch.keys(low))
                    odd.append(sketch.odd_sketch(low))
                else:
                    whole.append(None), keys.append(None), odd.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], ["id", "n_shingles", "set_hash", "keys", "sketch"])

    return docs.select(id_col, text_col).mapInArrow(run, "id long, n_shingles long, set_hash string, keys array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, *, size: int, id_col: str, text_col: str) -> DataFrame:
    """id and the sorted set of shingle hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for part in parts:
            ids, texts, first, sets, held = part.column(0).cast(pa.int64()), part.column(1), 0, [], 0
            for k in range(part.num_rows):
                sets.append(shingle(texts[k].as_py()).view(np.int64))
                held += len(sets[-1])
                if held >= BATCH_SHINGLES or k == part.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])
                    first, sets, held = k + 1, [], 0

    return docs.select(id_col, text_col).mapInArrow(run, "id long, shingles array<long>")


def rare_pairs(sets: DataFrame, millionths: int, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Pairs (a, b) of different parts (p, q) of `sets` (id, part, heavy array<long>, a set) that share a
    shingle among the rarest of each, a superset of the pairs at the similarity.

    Shingles are ordered by how many of the sets have them. A set of n shares at least s * n
    shingles with one at similarity s, so that the first shingle they share is among the first
    n - s * n + 1 of it; for the smaller of the two 2s / (1 + s) takes the place of s. Sets that are
    alike only in shingles that all of them have do not meet. Where both shared places are so late
    that too few shingles follow, the pair is left out at once.
    """
    million = F.lit(1_000_000)
    at_least = lambda n, share: F.ceil(n * share / million).cast("int")
    n = F.size("heavy").cast("long")  # products with a million or two are beyond an int from 1,194 on
    each = sets.select("id", F.explode("heavy").alias("g"))
    common = keep(each.groupBy("g").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    found = beside(each, common, "g").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("gs"))
    both = 2_000_000.0 * millionths / (1_000_000 + millionths)
    sized = sets.select("id", "part", n.alias("n")).join(found, "id").withColumn("alone", F.col("n") - F.size("gs"))
    probe = F.col("n") - at_least(F.col("n"), F.lit(millionths)) + 1
    entries = sized.select("id", "part", "n", F.col("alone"), F.posexplode(F.slice("gs", F.lit(1), F.greatest(probe - F.col("alone"), F.lit(0)).cast("int"))).alias("k", "e"))
    entries = entries.select("id", "part", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("e.g").alias("g"))
    entries = keep(entries)
    first = F.col("n") - F.ceil(F.col("n") * F.lit(both) / million - 1e-9).cast("int") + 1
    a = entries.select("g", F.col("id").alias("a"), F.col("part").alias("p"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    b = entries.where(F.col("at") < first).select("g", F.col("id").alias("b"), F.col("part").alias("q"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    longer = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))
    near = F.col("n_b") * million >= F.col("n_a") * F.lit(millionths)
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = left * F.lit(1_000_000 + millionths) >= (F.col("n_a") + F.col("n_b")) * F.lit(millionths)
    return a.join(b, "g").where((F.col("p") != F.col("q")) & longer & near & enough).select("a", "b", "p", "q")


def near_copies(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups rows whose shingle sets have a Jaccard similarity of at least `similarity`.

    Returns for each row: the id, n_shingles long, component_id (smallest id reachable over links,
    itself included), kept boolean (the id is its component_id). Rows with null, empty or blank
    text have no shingles and are linked with nothing. A row with a null id is linked with nothing
    and kept, its component_id null. Rows that repeat an id are one node, which has the
    links of all their texts: each gets the same component. Ties go to the smallest id. An empty table gives an empty table. Other columns are
    not read, whatever their names.

    A pair at the threshold shares no bucket with probability (1 - s**rows)**bands, 1.3e-7 with the
    defaults, less above it; it fails the sketch test with probability about 1e-6, less above it.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    shelf = Shelf(spark, "near")
    sig = shelf.put(signatures(docs, size=size, bands=bands, rows=rows, id_col=id_col, text_col=text_col))
    usable = sig.where("set_hash IS NOT NULL AND id IS NOT NULL")
    sets = shelf.put(usable.groupBy("set_hash").agg(F.min("id").alias("id"), F.min_by(F.struct("n_shingles", "keys", "sketch"), "id").alias("s")).select("set_hash", "id", "s.*"))
    release(spark)
    limit = sketch_limit(similarity, bands * rows, 64 * SKETCH_WORDS)
    percent = round(similarity * 1_000_000)

    def differing(a: Column, b: Column) -> Column:
        return sum((F.bit_count(a["sketch"][k].bitwiseXOR(b["sketch"][k])) for k in range(SKETCH_WORDS)), F.lit(0))

    def alike(a: Column, b: Column) -> Column:
        sized = F.least(a["n_shingles"], b["n_shingles"]) * F.lit(1_000_000) >= F.greatest(a["n_shingles"], b["n_shingles"]) * F.lit(percent)
        return sized & (differing(a, b) <= limit)

    def heavy_of(ids: DataFrame) -> DataFrame:
        texts = beside(docs.select(F.col(id_col).cast("long").alias("id"), text_col), shelf.put(ids), "id", "left_semi")
        return shelf.put(shingle_sets(texts, size=size, id_col="id", text_col=text_col).select("id", F.col("shingles").alias("heavy")))

    def exact(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b)).cast("long")
        return both * 1_000_000 >= (F.size(a) + F.size(b) - both) * percent

    def narrow(parts: DataFrame) -> DataFrame:
        return rare_pairs(heavy_of(parts.select("id")).join(parts, "id"), percent, shelf.put)

    items = sets.select("id", "keys", F.struct("n_shingles", "sketch").alias("light"))
    label = joined_parts(items, alike, differing, heavy_of, exact, narrow, shelf)
    named = sets.select("set_hash", "id").join(label, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    out = cut(sig.join(named, "set_hash", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")))
    shelf.clear()
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.col("component_id").cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows less near copies: of each group the row with the smallest id stays. Of rows
    that repeat an id, the one with the smallest text stays. Rows with null ids stay."""
    groups = near_copies(docs, size=size, similarity=similarity, id_col=id_col, text_col=text_col)
    mark, nth = fresh(docs.columns, "kept", "nth")
    ids = groups.where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(mark)).distinct()
    named = docs.where(F.col(f"`{id_col}`").isNotNull()).join(ids, F.col(f"`{id_col}`") == F.col(mark), "left_semi")
    first = named.withColumn(nth, F.row_number().over(Window.partitionBy(F.col(f"`{id_col}`")).orderBy(F.col(f"`{text_col}`").asc_nulls_last()))).where(F.col(nth) == 1).drop(nth)
    return first.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
