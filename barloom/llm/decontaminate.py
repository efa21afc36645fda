"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Words are the symbols. A random walk over a word sequence repeats or leaves its current word by a
random bit of (step, word); two sequences at a small edit distance give embeddings at a small
Hamming distance. Sampled coordinates of the embedding are bucket keys; they lie anywhere on the walk over
the whole item. Item-sized windows start at every word of every text, less those that hold too few words
of the benchmark to be within the allowed distance, which loses nothing. Walks that part at an edit meet
again soon after, whatever was inserted or deleted, since a window starts at every word: the sampled
coordinates of one of REPETITIONS walks agree, so that the recall at the allowed distance is at
least 0.95 (measured by tests for edits in front, at the end, in the middle and spread, items of 7 to 2,000 words).
Each candidate is then verified by the edit distance of the item to the best substring around it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, pieces
from .near_dedup import mix

WORDS = re.compile(r"\w+").findall
#: Word edits allowed for each word of an item.
EDITS = 0.2
REPETITIONS, SAMPLES = 32, 2
#: Items of more words have twice as many walks besides, whose samples lie within NEAR steps.
LONG, NEAR = 128, 8
#: A key of more items than this is shared; of items with this share of other keys it proposes those alone of
#: which a rare word is there too.
SHARED, OWN_KEYS = 16, 0.6
#: Text of benchmark items that one pass holds in memory on each worker.
BLOCK_BYTES = 32 << 20
#: Bytes of texts that are looked at together: each look has a cost of its own, whatever it looks at.
LOOK_BYTES = 4_000_000


def words_of(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


def allowed(n: int, edits: float = EDITS) -> int:
    return int(n * edits + 1e-9)


def best_match(item: list, text: list) -> int:
    """Smallest edit distance (in words) of the item to any substring of the text, by Sellers'
    recurrence in bit-parallel form."""
    m = len(item)
    if not m:
        return 0
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = score
    for w in text:
        eq = masks.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus)
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal & full
        best = min(best, score)
    return best


@dataclass
class Shared:
    """Keys of one class of items that many items have, and the rare words of those items."""

    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    marked: np.ndarray
    words: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    reach: int


def grouped(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values, where each one's owners begin, and the owners."""
    order = np.argsort(values, kind="stable")
    unique, first = np.unique(values[order], return_index=True)
    return unique, np.append(first, len(order)), owners[order]


@dataclass
class Index:
    """Buckets of one block of items, by classes of similar length."""

    items: list[tuple[int, list[str]]]
    edits: float = EDITS
    repetitions: int = REPETITIONS
    samples: int = SAMPLES
    seed: int = 11
    proposed: int = 0
    vocabulary: dict[str, int] = field(default_factory=dict)
    classes: list[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = field(default_factory=list)
    shared: list[Shared | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        for _, words in self.items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        longest = max((len(words) for _, words in self.items), default=0)
        self.salts = rng.integers(0, 2**64, (3 * self.repetitions, 2 * longest + 2), np.uint64)
        self.symbols = mix(np.arange(len(self.vocabulary) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
        self.numbered = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in self.items]
        commonness = np.bincount(np.concatenate([np.unique(ids) for ids in self.numbered]), minlength=len(self.vocabulary) + 1) if self.items else np.zeros(1, np.int64)
        by: dict[int, list[int]] = defaultdict(list)
        for k, ids in enumerate(self.numbered):
            if len(ids):
                low = 1
                while max(low + 1, int(low * 1.25)) <= len(ids):
                    low = max(low + 1, int(low * 1.25))
                by[low].append(k)
        for low, members in sorted(by.items()):
            member = np.zeros(len(self.vocabulary) + 1, bool)
            slack = 0
            for k in members:
                member[self.numbered[k]] = True
                slack = max(slack, allowed(len(self.numbered[k]), self.edits))
            # A walk leaves a word after two steps on average, so that this many reach the end of an item.
            steps = 2 * low
            picks = [np.sort(rng.choice(steps, min(self.samples, steps), replace=False)) for _ in range(self.repetitions)]
            if low > LONG:  # of many edits, some part any two far steps; near ones are on one side of them
                picks += [first + np.sort(rng.choice(NEAR, self.samples, replace=False)) for first in rng.integers(0, steps - NEAR, 2 * self.repetitions)]
            lengths = np.array([len(self.numbered[k]) for k in members])
            flat = np.concatenate([self.numbered[k] for k in members])
            ends = np.cumsum(lengths)
            walks = list(self.keys(flat, ends - lengths, ends, picks))
            sizes = [np.unique(np.where(whole, column, 0), return_inverse=True, return_counts=True)[1:] for column, whole in walks]
            own = np.array([whole & (count[place] <= SHARED) for (_, whole), (place, count) in zip(walks, sizes, strict=True)])
            # A phrase that many items share proposes those that have enough keys of their own only together
            # with a rare word. That loses none: an item without its rarest words has too many edits.
            apart = (own.sum(0) >= OWN_KEYS * len(walks)) & (lengths > [allowed(n, self.edits) for n in lengths.tolist()])
            tables, common = [], []
            for (column, whole), mine in zip(walks, own, strict=True):
                used = np.where(apart, mine, whole)
                tables.append(grouped(column[used], np.array(members)[used]))
                common.append(grouped(column[whole & ~used], np.array(members)[whole & ~used]))
            self.classes.append((low, slack, member, tables, picks))
            held = np.unique(np.concatenate([owners for _, _, owners in common])).tolist()
            rare = [self._rarest(k, commonness) for k in held]
            words, first, owners = grouped(np.array([w for ws in rare for w in ws], np.int64), np.repeat(np.array(held, np.int64), [len(ws) for ws in rare]))
            marked = np.zeros(len(self.vocabulary) + 1, bool)
            marked[words] = True
            self.shared.append(Shared(common, marked, words, first, owners, int(lengths.max()) + 2 * slack) if held else None)
        self.width = np.ones(len(self.items), np.int64)
        for low, members in by.items():
            self.width[members] = max(1, low // 2)
        self.distinct = [frozenset(ids.tolist()) for ids in self.numbered]

    def _rarest(self, k: int, commonness: np.ndarray) -> list[int]:
        """The item's rarest words, so many that one of them at least is in every match."""
        words, times = np.unique(self.numbered[k], return_counts=True)
        order = np.argsort(commonness[words], kind="stable")
        enough = int(np.searchsorted(np.cumsum(times[order]), allowed(len(self.numbered[k]), self.edits), "right")) + 1
        return words[order[:enough]].tolist()

    @property
    def pad(self) -> int:
        return max((c[1] for c in self.classes), default=0) + 1

    def keys(self, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, picks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each repetition the bucket key of the walk from each start, and which walks have one: those
        that have not come to their end before the last sampled step."""
        for salt, pick in zip(self.salts, picks):
            at, key, want = starts.copy(), np.zeros(starts.size, np.uint64), set(pick.tolist())
            with np.errstate(over="ignore"):
                for step in range(int(pick[-1]) + 1):
                    symbol = self.symbols[tokens[np.minimum(at, len(tokens) - 1)]]
                    if step in want:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + symbol)
                        whole = at < ends
                    at += (mix(symbol ^ salt[step]) & np.uint64(1)).astype(np.int64)
            yield key, whole

    def search(self, texts: list[list[str]]) -> list[dict[int, int]]:
        """For each text the items found: place in `items` to edit distance."""
        pad, get = self.pad, self.vocabulary.get
        found: list[dict[int, int]] = [{} for _ in texts]
        if not self.classes:
            return found
        parts, begin, total = [], [], 0
        gap = np.zeros(pad, np.int64)
        for words in texts:
            parts += [gap, np.fromiter((get(w, 0) for w in words), np.int64, len(words)), gap]
            begin.append(total + pad)
            total += len(words) + 2 * pad
        tokens = np.concatenate(parts) if parts else gap
        starts_of = np.array(begin, np.int64)
        pairs = []
        for (low, slack, member, tables, picks), common in zip(self.classes, self.shared, strict=True):
            upto = np.concatenate(([0], np.cumsum(member[tokens])))
            starts = np.flatnonzero(upto[low:] - upto[:-low] >= max(1, low - slack)) if len(tokens) >= low else np.empty(0, np.int64)
            if not starts.size:
                continue
            width, hits = max(1, low // 2), []
            for n, ((key, whole), (unique, first, owner)) in enumerate(zip(self.keys(tokens, starts, np.full(starts.size, len(tokens)), picks), tables, strict=True)):
                if common and len(others := common.tables[n][0]):
                    at = np.minimum(np.searchsorted(others, key), len(others) - 1)
                    hit = np.flatnonzero((others[at] == key) & whole)
                    hits.append(np.stack([starts[hit] // width, np.full(hit.size, n), at[hit]], 1))
                if not len(unique):
                    continue
                at = np.minimum(np.searchsorted(unique, key), len(unique) - 1)
                hit = np.flatnonzero((unique[at] == key) & whole)
                lens = first[at[hit] + 1] - first[at[hit]]
                where = np.repeat(starts[hit], lens)
                offset = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
                pairs.append(np.stack([owner[np.repeat(first[at[hit]], lens) + offset], where // width], 1))
            if hits:
                pairs.append(self._by_words(tokens, common, np.concatenate(hits), width, slack))
        proposed = np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []
        self.proposed += len(proposed)
        for item, block in proposed:
            ids, width = self.numbered[item], int(self.width[item])
            limit, n = allowed(len(ids), self.edits), len(ids)
            s, e = max(0, block * width - limit - 1), block * width + width + n + limit + 1
            near = tokens[s:e].tolist()
            # Each word of the item that is missing here altogether costs an edit.
            if len(self.distinct[item]) - len(self.distinct[item].intersection(near)) > limit:
                continue
            distance = best_match(ids.tolist(), near)
            if distance <= limit:
                # The match may touch two texts' padding but not two texts: pads exceed the limit.
                self._credit(found, starts_of, texts, item, ids.tolist(), limit, s, e, tokens, pad)
        return found

    def _by_words(self, tokens: np.ndarray, common: Shared, hits: np.ndarray, width: int, slack: int) -> np.ndarray:
        """(item, block) of items that have a shared key of a hit (block, table, key's place) and a rare word in the block."""
        upto = np.concatenate(([0], np.cumsum(common.marked[tokens])))
        begin, end = (np.clip(hits[:, 0] * width + d, 0, len(tokens)) for d in (-slack - 1, width + common.reach + 1))
        hits = np.unique(hits[upto[end] > upto[begin]], axis=0)
        out = [np.empty((0, 2), np.int64)]
        for of in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1) if len(hits) else []:
            s = int(of[0, 0]) * width
            near = tokens[max(0, s - slack - 1) : s + width + common.reach + 1]
            at = np.searchsorted(common.words, np.unique(near[common.marked[near]]))
            found = np.unique(np.concatenate([common.owners[common.first[k] : common.first[k + 1]] for k in at.tolist()]))
            keyed = [np.intersect1d(found, owners[first[k] : first[k + 1]]) for _, n, k in of.tolist() for _, first, owners in (common.tables[n],)]
            items = np.unique(np.concatenate(keyed))
            out.append(np.stack([items, np.full(items.size, of[0, 0])], 1))
        return np.concatenate(out)

    def _credit(self, found, starts_of, texts, item, ids, limit, s, e, tokens, pad) -> None:
        k = max(0, int(np.searchsorted(starts_of, s, "right")) - 1)
        while k < len(texts) and starts_of[k] < e:
            a, b = max(s, starts_of[k] - pad), min(e, starts_of[k] + len(texts[k]) + pad)
            if a < b:
                distance = best_match(ids, tokens[a:b].tolist())
                if distance <= limit:
                    found[k][item] = min(distance, found[k].get(item, distance))
            k += 1


def find_items(docs: DataFrame, benchmark: DataFrame, *, edits: float = EDITS, repetitions: int = REPETITIONS, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Finds benchmark items in texts: the input's columns, then item_ids array<long> (ascending),
    distance int (smallest word edits of an item found; null if none) and contaminated boolean.

    An item is in a text if a substring of the text's words is within floor(edits * n) word
    insertions, deletions or replacements of its n words; case and punctuation do not count. What is
    reported is exact; of what there is at least 0.95 is found at the allowed distance, exact copies always. Null
    and empty texts, and items without words, match nothing; equal items are all reported; items
    with a null id are left out; an item id that stands twice is reported once. Ids may be null or
    repeat. Input columns named item_ids, distance or contaminated are replaced. An empty table or
    benchmark works. Items are taken in blocks of bounded size, each one broadcast and held against all
    rows; where there are several, a worker reads one at a time and lets it go after a batch. Texts are
    never shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("item_ids", "distance", "contaminated")])
    base = out.columns
    (hit,) = fresh([*base, "item_ids", "distance", "contaminated"], "found")
    out = out.withColumn(hit, F.array().cast("array<struct<i:bigint,d:int>>"))
    for block in range(blocks):
        mine = sorted((r["i"], r["t"]) for r in numbered.where(F.col("block") == block).collect())
        index = Index([(i, words_of(t)) for i, t in mine], edits, repetitions, samples)
        shared = spark.sparkContext.broadcast(index)

        def look(texts, shared=shared):
            index = shared.value if blocks == 1 else shared.load_from_path(shared._path)  # `value` would keep every block
            out = []
            for first, n in pieces(texts, LOOK_BYTES):
                for got in index.search([words_of(t) for t in texts.slice(first, n).to_pylist()]):
                    best: dict[int, int] = {}
                    for item, d in got.items():
                        name = index.items[item][0]
                        best[name] = min(d, best.get(name, d))
                    out.append([{"i": i, "d": d} for i, d in sorted(best.items())])
            give_back()
            return pa.array(out, pa.list_(pa.struct([("i", pa.int64()), ("d", pa.int32())])))

        searched = F.arrow_udf(look, "array<struct<i:bigint,d:int>>")
        out = out.select(*[F.col(f"`{c}`") for c in base], F.concat(hit, searched(F.col(f"`{text_col}`"))).alias(hit))
    ids = F.array_sort(F.array_distinct(F.transform(hit, lambda x: x["i"])))
    return out.select(*[F.col(f"`{c}`") for c in base], ids.alias("item_ids"), F.array_min(F.transform(hit, lambda x: x["d"])).alias("distance"), (F.size(hit) > 0).alias("contaminated"))
