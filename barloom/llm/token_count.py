"""Token counts by the whole-token shortcut.

Offline, each vocabulary string that the pre-token pattern leaves whole is run through the
merges; those that come back as their own single id are proved whole tokens. When counting, a
pre-token in that set is one token by a set lookup; only the others are merged, once for each
distinct one of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proved to encode alone as exactly one token."""
    v = bpe.load(path)
    split = bpe.Splitter({})
    strings: dict[str, int] = {}
    for i, raw in enumerate(v.token_bytes):
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if s and s not in v.special and split(s) == [s]:
            strings[s] = i
    ids, off = bpe.merge_words(v, [s.encode() for s in strings])
    return frozenset(s for k, (s, i) in enumerate(strings.items()) if off[k + 1] - off[k] == 1 and ids[off[k]] == i)


def count_tokens(docs: DataFrame, vocabulary: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of every whole text: id, n_bytes long, n_tokens long, over_limit boolean,
    n_whole long (pre-tokens counted by the shortcut).

    Null and empty texts have 0 bytes and tokens. Special strings inside texts count as one token.
    Ids may be null or repeat; other columns are not read; an empty table gives an empty table.
    Rows stay in their partition: there is no shuffle. The broadcast is bounded by the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bpe.load(vocabulary), whole_tokens(vocabulary)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, whole = shared.value
        split = bpe.Splitter(v.special)
        for part in parts:
            texts = part.column(1).to_pylist()
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            tokens, direct = [], []
            for _, rows, number in bpe.batches(texts, split):
                cost = np.ones(len(number), np.int64)
                rest = [(k, w) for w, k in number.items() if w not in whole and w not in v.special]
                if rest:
                    _, off = bpe.merge_words(v, [w.encode("utf-8", "surrogatepass") for _, w in rest])
                    cost[[k for k, _ in rest]] = np.diff(off)
                alone = np.ones(len(number), np.int64)
                alone[[k for k, _ in rest]] = 0
                tokens += [int(cost[row].sum()) for row in rows]
                direct += [int(alone[row].sum()) for row in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_()), pa.array(direct, pa.int64())], [id_col, "n_bytes", "n_tokens", "over_limit", "n_whole"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
