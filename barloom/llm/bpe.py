"""Byte-level BPE over whole partitions: pre-tokens, pair-occurrence merging, encode, decode.

The vocabulary file is a parameter; it is read on the driver and its tables are sent to the
executors as one broadcast variable whose size is fixed by the vocabulary (a few MB).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import give_back, pieces

#: Fixed value: the public byte-level pre-token pattern. White space is spelt out as the
#: Unicode property, since the regular expression libraries differ over 1C to 1F.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NO_RANK = np.int32(2**31 - 1)
#: A batch of texts is encoded together until it holds so many characters or distinct pre-tokens.
BATCH_CHARS = 12_000_000
BATCH_WORDS = 250_000


def byte_letters() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1
    letters stand for themselves, the others are numbered from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """Tables of a byte-level BPE file: merge triples by rank, token bytes by id, special strings."""

    first: np.ndarray
    second: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    token_bytes: list[bytes]
    special: dict[str, int]

    def __post_init__(self) -> None:
        keys = self.first.astype(np.int64) << 32 | self.second
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.byte_rank = np.full((256, 256), NO_RANK, np.int32)
        byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        for r, (a, b) in enumerate(zip(self.first.tolist(), self.second.tolist(), strict=True)):
            if a in byte_of and b in byte_of:
                self.byte_rank[byte_of[a], byte_of[b]] = r

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK).astype(np.int32)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Reads a byte-level BPE tokenizer file; raises ValueError for any other kind."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre = data["model"], data["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or data["normalizer"] or model.get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE file")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
        raise ValueError("added tokens that strip or need word borders are not handled")
    letters, vocab = byte_letters(), model["vocab"]
    of = {c: b for b, c in enumerate(letters)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    token_bytes = [b""] * size
    for s, i in vocab.items():
        token_bytes[i] = bytes(of[c] for c in s)
    for s, i in special.items():
        token_bytes[i] = s.encode()
    column = lambda k: np.array([vocab[p[k]] for p in pairs], np.int32)
    return Vocabulary(column(0), column(1), np.array([vocab[a + b] for a, b in pairs], np.int32), np.array([vocab[c] for c in letters], np.int32), token_bytes, special)


def merge_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """BPE of all words at once: (ids, offsets of the words in ids).

    A pair-occurrence index maps the rank of each pair to all positions where it stands in the
    batch. Active ranks are taken in ascending order from a heap; a rank is applied at all its
    positions in one vector step, and only the pairs beside the merged positions enter the index
    anew. Lists may name positions that earlier merges consumed; they are checked when taken.
    """
    lens = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n = data.size
    ends = np.cumsum(lens)
    if not n:
        return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
    sym = v.byte_ids[data]
    nxt = np.arange(1, n + 1, dtype=np.int32)
    prv = np.arange(-1, n - 1, dtype=np.int32)
    full = lens > 0
    nxt[ends[full] - 1] = -1
    prv[(ends - lens)[full]] = -1
    at = np.flatnonzero(nxt >= 0).astype(np.int32)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray, rank: np.ndarray) -> None:
        known = rank != NO_RANK
        if not known.all():
            places, rank = places[known], rank[known]
        if not rank.size:
            return
        by = np.argsort(rank, kind="stable")
        places, rank = places[by], rank[by]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for s, e, r in zip(starts, [*starts[1:], rank.size], rank[starts].tolist(), strict=True):
            if r in index:
                index[r].append(places[s:e])
            else:
                index[r] = [places[s:e]]
                heapq.heappush(heap, r)

    enter(at, v.byte_rank[data[at], data[at + 1]])
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
        pos = np.unique(pos)
        a, b = v.first[r], v.second[r]
        right = nxt[pos]
        live = (sym[pos] == a) & (right >= 0) & (sym[right] == b)
        if not live.all():
            pos, right = pos[live], right[live]
        if a == b and pos.size > 1:
            # In a run of equal symbols only every second position merges, from the left.
            chained = np.concatenate(([False], right[:-1] == pos[1:]))
            place = np.arange(pos.size)
            begin = np.maximum.accumulate(np.where(chained, 0, place))
            even = (place - begin) % 2 == 0
            pos, right = pos[even], right[even]
        if not pos.size:
            continue
        after = nxt[right]
        sym[pos] = v.merged[r]
        sym[right] = -1
        nxt[pos] = after
        more = after >= 0
        prv[after[more]] = pos[more]
        before = prv[pos]
        left = np.concatenate((before[before >= 0], pos[more]))
        enter(left, v.ranks(sym[left], sym[nxt[left]]))
    alive = sym >= 0
    upto = np.concatenate(([0], np.cumsum(alive)))
    return sym[alive], np.concatenate(([0], upto[ends]))


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Splitter:
    """Pre-tokens of texts; special strings stand apart, as the library's default has them."""

    def __init__(self, special: dict[str, int]) -> None:
        self.find = regex.compile(PRE_TOKENS).findall
        self.special = special
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.apart is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for k, piece in enumerate(self.apart.split(text)):
            out += [piece] if k % 2 else self.find(piece)
        return out


def batches(texts: list[str | None], split: Splitter, chars: int = BATCH_CHARS, words: int = BATCH_WORDS) -> Iterator[tuple[int, list[np.ndarray], Numbered]]:
    """Groups of whole texts: (first row, word numbers of each text, the distinct words)."""
    first, rows, number, held = 0, [], Numbered(), 0
    for k, text in enumerate(texts):
        got = split(text or "")
        rows.append(np.fromiter(map(number.__getitem__, got), np.int32, len(got)))
        held += len(text or "")
        if held >= chars or len(number) >= words:
            yield first, rows, number
            first, rows, number, held = k + 1, [], Numbered(), 0
    if rows:
        yield first, rows, number


def word_ids(v: Vocabulary, number: Numbered) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each distinct word, special strings included: (ids, offsets)."""
    words = list(number)
    special = [(k, v.special[w]) for k, w in enumerate(words) if w in v.special]
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    for k, _ in special:
        raw[k] = b"\0"
    ids, off = merge_words(v, raw)
    for k, i in special:
        ids[off[k]] = i
    return ids, off


def gather(ids: np.ndarray, off: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Ids of one text from its word numbers."""
    starts, lens = off[row], off[row + 1] - off[row]
    total = int(lens.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else starts, lens)
    return ids[shift + np.arange(total)]


def encode_texts(v: Vocabulary, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Token ids of each text, in order; a null text is empty."""
    for _, rows, number in batches(texts, Splitter(v.special)):
        ids, off = word_ids(v, number)
        for row in rows:
            yield gather(ids, off, row)


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of token ids, special tokens kept; bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(v.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Encodes every whole text, then decodes the ids again.

    Returns the id column, n_tokens long, ids array<int> (if with_ids), ids_sha256 string, decoded
    string (if with_text) and decoded_sha256 string. Null and empty texts have no tokens; ids may
    be null or repeat; other columns are not read. One output row for each input row; an empty
    table gives an empty table. Rows stay in their partition: there is no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string" + ", decoded string" * with_text + ", decoded_sha256 string"

    def piece(v: Vocabulary, keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        held: dict[str, list] = {k: [] for k in ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")}
        for ids in encode_texts(v, texts):
            raw = b"".join(map(v.token_bytes.__getitem__, ids.tolist()))
            text = raw.decode("utf-8", "replace")
            held["n_tokens"].append(len(ids))
            held["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            held["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            if with_ids:
                held["ids"].append(ids)
            if with_text:
                held["decoded"].append(text)
        assert len(held["n_tokens"]) == len(texts)
        columns = [keys, pa.array(held["n_tokens"], pa.int64())] + [pa.array(held["ids"], pa.list_(pa.int32()))] * with_ids + [pa.array(held["ids_sha256"], pa.string())] + [pa.array(held["decoded"], pa.string())] * with_text + [pa.array(held["decoded_sha256"], pa.string())]
        names = [id_col, "n_tokens"] + ["ids"] * with_ids + ["ids_sha256"] + ["decoded"] * with_text + ["decoded_sha256"]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for part in parts:
            keys, texts = part.column(0), part.column(1)
            for first, n in pieces(texts):
                yield piece(v, keys.slice(first, n), texts.slice(first, n).to_pylist())
        part = keys = texts = None  # the last batch, else it would not be among what is given back
        give_back()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
