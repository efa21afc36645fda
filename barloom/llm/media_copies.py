"""Copies among media columns by local image descriptors.

Corners are found at several scales; the patch around each is turned to its own orientation and
reduced to binary tests. Samples of the test bits are keys of Hamming tables: each key that two
images share is a vote for the pair, and pairs with two votes or more are candidates. A candidate
pair is confirmed by geometric consensus: enough mutually nearest descriptors must agree on one
shift, turn and scale. Crops, turned, scaled and brightened copies keep most corners and so are
found. Descriptors are stored once and move only for candidates.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, components, cut, remove, rows_of, scratch, stored
from .near_dedup import mix

#: Corners that describe an image of AREA pixels or fewer; a larger image has more in proportion.
BITS, CORNERS, AREA = 256, 64, 96 * 96
#: Cells of a matrix that are held at a time.
CELLS = 500_000
#: Hamming tables, and how many sampled test bits make a key.
TABLES, LENGTH = 6, 56
#: Table keys that two images must share to be held against each other.
VOTES = 2
#: Images of one key up to which all of them meet in pairs at once.
MEET = 8
#: Keys of larger groups up to which an image's small keys carry a tag of each.
TAGS = 64
#: Pairs of two components that are proved first; all others follow where none of these links the two.
LIKELY = 4
SCALES = (1.0, 0.8, 0.64, 0.512)
RADIUS = 12
#: A descriptor match differs in so many bits at most; a consensus has so many matches at least,
#: each within so many pixels.
NEAR_BITS, CONSENSUS, PIXELS = 48, 9, 3.0
# The PNG signature and the channels of its colour types.
PNG, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}

TESTS = np.clip(np.random.default_rng(23).normal(0, RADIUS / 2, (BITS, 4)), -RADIUS + 1, RADIUS - 1)
PICKS = np.stack([np.random.default_rng(29 + k).permutation(BITS)[:LENGTH] for k in range(TABLES)])
_y, _x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
DISC = (_x**2 + _y**2) <= RADIUS**2
DISC_X, DISC_Y = _x[DISC], _y[DISC]


def encode_png(gray: np.ndarray) -> bytes:
    """8-bit grey PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = gray.shape
    rows = np.concatenate((np.zeros((h, 1), np.uint8), gray.astype(np.uint8)), 1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of an 8-bit PNG that is not interlaced, or of a binary PGM or PPM; None for
    null, empty, cut-off and other data."""
    try:
        if not data:
            return None
        if data[:8] == PNG:
            at, body, head = 8, b"", None
            while at + 8 <= len(data):
                n, kind = struct.unpack(">I4s", data[at : at + 8])
                part = data[at + 8 : at + 8 + n]
                head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
                body += part if kind == b"IDAT" else b""
                at += 12 + n
            w, h, depth, colour, _, _, laced = head
            if depth != 8 or laced or colour not in CHANNELS:
                return None
            k = CHANNELS[colour]
            raw = np.frombuffer(zlib.decompressobj().decompress(body, h * (w * k + 1)), np.uint8).reshape(h, w * k + 1)  # never more than the header says
            pixels = unfilter(raw, k).reshape(h, w, k)
            return pixels[:, :, : 3 if k > 2 else 1].mean(2)
        if data[:2] in (b"P5", b"P6"):
            kind, w, h, top = data.split(maxsplit=4)[:4]
            k = 3 if kind == b"P6" else 1
            size = int(w) * int(h) * k
            if int(top) != 255 or len(data) < size:
                return None
            return np.frombuffer(data[len(data) - size :], np.uint8).reshape(int(h), int(w), k).mean(2)
    except (ValueError, TypeError, struct.error, zlib.error):
        pass
    return None


def unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Undoes the five row filters of PNG."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(raw):
        kind, line = row[0], row[1:]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + above
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
        else:
            now, up = [0] * (len(line) + step), [0] * step + above.tolist()
            for i, v in enumerate(line.tolist()):
                a, b, c = now[i], up[i + step], up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                now[i + step] = (v + guess) & 255
            out[y] = now[step:]
        above = out[y]
    return out


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2r + 1, edges repeated."""
    p = np.pad(a, r + 1, "edge")
    s = p.cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n])[: a.shape[0], : a.shape[1]] / n**2


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    h, w = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, a.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, a.shape[0] - 2)), np.minimum(x.astype(int), max(0, a.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def describe(gray: np.ndarray, corners: int = CORNERS) -> tuple[np.ndarray, np.ndarray]:
    """The strongest corners over all scales: positions (x, y in source pixels, float32) and
    test bits (four 64-bit words each)."""
    corners = max(corners, corners * gray.size // AREA)
    spots, bits, strength = [], [], []
    for scale in SCALES:
        a = gray if scale == 1 else resized(gray, scale)
        m = RADIUS + 1
        if min(a.shape) <= 2 * m + 2:
            continue
        a = box(a, 1)
        gy, gx = np.gradient(a)
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[m:-m, m:-m]
        top = np.ones(inner.shape, bool)
        h, w = r.shape
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dx or dy:
                    near = r[m + dy : h - m + dy, m + dx : w - m + dx]
                    top &= inner >= near if (dy, dx) > (0, 0) else inner > near
        ys, xs = np.nonzero(top & (inner > 1e-3))
        if not ys.size:
            continue
        best = np.argsort(-inner[ys, xs], kind="stable")[:corners]
        ys, xs = ys[best] + m, xs[best] + m
        smooth = box(a, 1)
        for part in np.split(np.arange(len(ys)), range(1024, len(ys), 1024)):
            py_, px_ = ys[part], xs[part]
            patch = smooth[py_[:, None] + DISC_Y, px_[:, None] + DISC_X]
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2((patch * DISC_Y).sum(1), (patch * DISC_X).sum(1))
            c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
            one = lambda px, py: smooth[py_[:, None] + np.rint(s * px + c * py).astype(int).clip(-m, m), px_[:, None] + np.rint(c * px - s * py).astype(int).clip(-m, m)]  # noqa: E731,B023
            less = one(TESTS[:, 0], TESTS[:, 1]) < one(TESTS[:, 2], TESTS[:, 3])
            bits.append(np.packbits(less, axis=1).view(np.int64))
        spots.append(np.stack(((xs + 0.5) / scale, (ys + 0.5) / scale), 1))
        strength.append(inner[ys - m, xs - m])
    if not spots:
        return np.empty((0, 2), np.float32), np.empty((0, BITS // 64), np.int64)
    order = np.argsort(-np.concatenate(strength), kind="stable")[:corners]
    return np.concatenate(spots)[order].astype(np.float32), np.concatenate(bits)[order]


def table_keys(bits: np.ndarray) -> np.ndarray:
    """Keys of the Hamming tables, the different ones of an image; the table's number is part of a key."""
    if not bits.size:
        return np.empty(0, np.int64)
    single = np.unpackbits(bits.view(np.uint8), axis=1)[:, PICKS]
    part = np.zeros((*single.shape[:2], 64), np.uint8)
    part[:, :, :LENGTH] = single
    with np.errstate(over="ignore"):
        key = mix(np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.packbits(part, axis=2).view(np.uint64)[:, :, 0])
    return np.unique(key.reshape(-1).view(np.int64))


def consensus(pa_: np.ndarray, ba: np.ndarray, pb: np.ndarray, bb: np.ndarray, enough: int | None = None) -> int:
    """Mutually nearest descriptors that agree on one similarity transform; once `enough` do, no
    more are looked for."""
    if len(pa_) < 2 or len(pb) < 2:
        return 0
    i = np.arange(len(pa_))
    j, off_j = np.empty(len(pa_), np.int64), np.empty(len(pa_), np.int64)
    back, off_back = np.zeros(len(pb), np.int64), np.full(len(pb), BITS + 1)
    rows = max(1, CELLS // len(pb))
    for k in range(0, len(pa_), rows):
        away = np.bitwise_count(ba[k : k + rows].view(np.uint64)[:, None] ^ bb.view(np.uint64)[None]).sum(2, dtype=np.int64)
        j[k : k + rows], off_j[k : k + rows] = away.argmin(1), away.min(1)
        nearer = away.min(0) < off_back
        back[nearer], off_back[nearer] = away.argmin(0)[nearer] + k, away.min(0)[nearer]
    mutual = (back[j] == i) & (off_j <= NEAR_BITS)
    i, j = i[mutual], j[mutual]
    if len(i) < 2:
        return 0
    a, b = pa_[i, 0] + 1j * pa_[i, 1], pb[j, 0] + 1j * pb[j, 1]
    best, rows = 0, max(1, CELLS // len(i))
    for low in range(0, len(i), rows):
        s, e = np.nonzero(np.arange(low, min(low + rows, len(i)))[:, None] < np.arange(len(i)))
        s = s + low
        far = np.abs(a[s] - a[e]) > 8
        s, e = s[far], e[far]
        turn = (b[e] - b[s]) / (a[e] - a[s])
        sane = (np.abs(turn) > 0.3) & (np.abs(turn) < 3.3)
        turn, s = turn[sane], s[sane]
        shift = b[s] - turn * a[s]
        for k in range(0, len(turn), 512):
            off = np.abs(turn[k : k + 512, None] * a + shift[k : k + 512, None] - b)
            best = max(best, int((off < PIXELS).sum(1).max(initial=0)))
            if enough is not None and best >= enough:
                return best
    return best


def image_copies(media: DataFrame, *, id_col: str = "media_id", image_col: str = "image", corners: int = CORNERS, least: int = CONSENSUS, votes: int = VOTES, decode: Callable[[bytes | None], np.ndarray | None] | None = None) -> DataFrame:
    """Groups media whose images are copies of each other, also cropped or edited ones.

    Returns for each row: the id, n_corners int, component_id (smallest id reachable over links,
    itself included) and kept boolean. Two images are linked if `votes` table keys or more are common
    to them and `least` mutually nearest descriptors or more agree on one geometry. Equal bytes are
    one image. Null, empty and unreadable images (`decode` gives None) have no corners and are linked
    with their exact copies alone (null and empty with nothing); the built-in decoder reads 8-bit PNG,
    PGM and PPM, other formats such as JPEG need a decoder given as `decode`. A row with a null id is
    linked with nothing and kept. Rows that repeat an id are one node. Other columns are not read,
    whatever their names. An empty table gives an empty table. `corners`, the corners that describe
    an image of AREA pixels or fewer, grows with the area of larger images.
    """
    spark = media.sparkSession
    kind = media.schema[id_col].dataType
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("image"))
    read = decode or decode_image

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.empty((0, 2), np.float32), np.empty((0, BITS // 64), np.int64))
        place = TaskContext.get().partitionId() << 36
        seen: dict[bytes, int] = {}  # images that stand often in a task are described once
        for part in parts:
            places, same, n, spots, bits = [], [], [], [], []
            for data in part.column("image"):
                raw = data.as_py()
                key = hashlib.sha256(raw).digest()[:16] if raw else None
                p = b = None
                if key is not None and key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    gray = read(raw)
                    p, b = describe(gray, corners) if gray is not None else none
                    seen[key] = len(p)
                places.append(place), same.append(key), n.append(seen[key] if key else 0)
                spots.append(None if p is None else p.tobytes()), bits.append(None if b is None else b.tobytes())
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), part.column("id"), pa.array(same, pa.binary()), pa.array(n, pa.int32()), pa.array(spots, pa.binary()), pa.array(bits, pa.binary())], ["place", "id", "same", "n_corners", "spots", "bits"])

    folder = scratch(spark, "media")
    each = stored(rows.mapInArrow(run, "place long, id long, same binary, n_corners int, spots binary, bits binary"), f"{folder}/each")
    # One node for each different image: the first place where it was described.
    described = F.min(F.when(F.col("bits").isNotNull(), F.col("place")))
    nodes = cut(each.where("same IS NOT NULL AND id IS NOT NULL").groupBy("same").agg(described.alias("node"), F.min("id").alias("id"), F.first("n_corners").alias("n_corners")).select("same", "id", "n_corners", F.coalesce("node", "id").alias("node")))
    spare = cut(each.where("bits IS NOT NULL AND same IS NOT NULL").select("same", "place").join(nodes.select("same", "node"), "same", "left").where("NOT place <=> node").select("place"))
    images = beside(each.where(F.col("n_corners") >= least).where("bits IS NOT NULL"), spare, "place", "left_anti").withColumnRenamed("place", "node")

    links = candidates_proved(images, folder, votes, least)
    # Rows that repeat an id tie their images together.
    named = nodes.select("same", F.col("node").alias("n"))
    of_id = each.where("same IS NOT NULL AND id IS NOT NULL").select("id", "same").join(named, "same").select("id", "n").distinct()
    tied = of_id.join(of_id.groupBy("id").agg(F.min("n").alias("a"), F.max("n").alias("z")).where("a < z"), "id").where("a != n").select("a", F.col("n").alias("b"))
    label = components(links.unionAll(tied))
    placed = nodes.join(label.select(F.col("id").alias("node"), "component"), "node", "left").select("same", "n_corners", "id", F.coalesce("component", "node").alias("part"))
    least_id = placed.groupBy("part").agg(F.min("id").alias("c"))
    known = cut(placed.join(least_id, "part").select("same", "n_corners", "c"))
    named = each.where("same IS NOT NULL").select("id", "same").join(known, "same", "left").select("id", "n_corners", "c")
    blank = each.where("same IS NULL").select("id")
    blank = blank.join(named.where("id IS NOT NULL").groupBy("id").agg(F.min("c").alias("c")), "id", "left").select("id", F.lit(0).alias("n_corners"), "c")
    out = cut(named.unionAll(blank))
    remove(spark, folder)
    part = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("c", "id"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_corners", F.lit(0)).alias("n_corners"), part.cast(kind).alias("component_id"), F.coalesce(F.col("id") == part, F.lit(True)).alias("kept"))


def candidates_proved(images: DataFrame, folder: str, votes: int, least: int) -> DataFrame:
    """Links (a, b) that connect all pairs of `images` (node, spots, bits) with `votes` common keys
    and a geometric consensus.

    Keys that stand once go by a count of bare keys. In a key's group of at most MEET images all
    pairs meet, and a pair's meetings are its votes. In a larger group, of a corner that many images
    have, each image is held against one of the group, another one for each key. The pairs that may then still
    join two components share two keys of large groups, or one and one of a small group: pairs of an
    image's keys are the groups in which the first meet. All of them do that are in different
    components, the likeliest of any two components first, so that no link is lost. No descriptor
    moves before a pair has its votes.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node and its keys, a row for each different one; a few images at a time."""
        for part in parts:
            for s in range(0, part.num_rows, 256):
                some = part.slice(s, 256)
                keys = [table_keys(np.frombuffer(b.as_py(), np.int64).reshape(-1, BITS // 64)) for b in some.column("bits")]
                nodes = np.repeat(some.column("node").to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(keys))], ["node", "key"])

    posted = images.select("node", "bits").mapInArrow(run, "node long, key long")
    shared = cut(posted.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("members")).where("members > 1"), 200_000)
    held = stored(beside(posted, shared, "key"), f"{folder}/held")
    small = held.where(F.col("members") <= MEET).select("key", "node")
    large = cut(held.where(F.col("members") > MEET).select("key", "node"))

    def prove(one, other):
        def parts(x: dict) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(x["spots"], np.float32).reshape(-1, 2).astype(float), np.frombuffer(x["bits"], np.int64).reshape(-1, BITS // 64)

        return pa.array([consensus(*parts(a), *parts(b), least) for a, b in zip(one.to_pylist(), other.to_pylist(), strict=True)], pa.int32())

    proof = F.arrow_udf(prove, "int")

    def proved(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select("a", "b").distinct(), 5_000)
        ids = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        heavy = beside(images.select("node", F.struct("spots", "bits").alias("h")), ids, "node", "left_semi")
        end = lambda name: heavy.select(F.col("node").alias(name), F.col("h").alias(f"h_{name}"))
        return cut(pairs.join(end("a"), "a").join(end("b"), "b").where(proof("h_a", "h_b") >= least).select("a", "b"))

    lists = cut(large.groupBy("node").agg(F.collect_list("key").alias("keys")), 20_000)  # an image's own keys, as many as it has corners and tables
    # Short tags of an image's large keys travel with its small ones: pairs without a common tag share no
    # large key. An image of many large keys has the tags () instead, and may share any.
    tags = F.when(F.size("keys") > TAGS, F.array().cast("array<smallint>")).otherwise(F.transform("keys", lambda k: (k % 32_768).cast("smallint")))
    if rows_of(large):
        small = small.join(lists.select("node", tags.alias("tags")), "node", "left")
    else:
        small = small.withColumn("tags", F.lit(None).cast("array<smallint>"))
    end = lambda name: small.select("key", F.col("node").alias(name), F.col("tags").alias(f"t_{name}"))
    may = F.coalesce(F.arrays_overlap("t_a", "t_b") | (F.least(F.size("t_a"), F.size("t_b")) == 0), F.lit(False)) & F.col("t_a").isNotNull() & F.col("t_b").isNotNull()
    met = end("a").join(end("b"), "key").where("a < b").select("a", "b", may.alias("may")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.max("may").alias("may"))
    if not rows_of(large):
        return proved(met.where(F.col("met") >= votes))
    met = cut(met.where((F.col("met") >= votes) | F.col("may")))
    side = lambda name: lists.select(F.col("node").alias(name), F.col("keys").alias(f"k_{name}"))
    also = met.where(F.col("met") < votes).join(side("a"), "a").join(side("b"), "b").where(F.col("met") + F.size(F.array_intersect("k_a", "k_b")) >= votes)
    met = met.where(F.col("met") >= votes).select("a", "b").unionAll(also.select("a", "b"))
    flip = F.xxhash64("key")
    pivots = cut(large.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(flip)).alias("p")).select("key", F.col("p").bitwiseXOR(flip).alias("a")))
    star = beside(large, pivots, "key").where("node != a").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= votes)
    links = proved(met.unionAll(star.select("a", "b")))
    label = components(links)
    parted = cut(large.join(label.select(F.col("id").alias("node"), F.col("component").alias("part")), "node", "left").select("key", "node", F.coalesce("part", "node").alias("part")))
    mixed = cut(parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("key"))
    rest = beside(parted, mixed, "key").groupBy("node", "part").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    twos = rest.select("node", "part", F.explode("keys").alias("two"))
    if votes > 1:
        first = rest.select("node", "part", "keys", F.posexplode("keys").alias("at", "x"))
        twos = first.select("node", "part", "x", F.explode(F.slice("keys", F.col("at") + 2, F.size("keys"))).alias("y")).select("node", "part", F.xxhash64("x", "y").alias("two"))
    twos = stored(twos, f"{folder}/twos")
    apart = cut(twos.groupBy("two").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("two"))
    twos = beside(twos, apart, "two")
    pairs = twos.select("two", F.col("node").alias("a"), F.col("part").alias("p")).join(twos.select("two", F.col("node").alias("b"), F.col("part").alias("q")), "two").where("a < b AND p != q")
    pairs = cut(pairs.groupBy("a", "b", "p", "q").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= votes * (votes - 1) // 2))
    best = Window.partitionBy(F.least("p", "q"), F.greatest("p", "q")).orderBy(F.desc("met"), "a", "b")
    likely = cut(pairs.withColumn("nth", F.row_number().over(best)).where(f"nth <= {LIKELY}").select("a", "b"))
    links = cut(links.unionAll(proved(likely)))
    label = components(links)
    part = lambda end: label.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    further = pairs.join(likely, ["a", "b"], "left_anti").join(part("a"), "a", "left").join(part("b"), "b", "left")
    return links.unionAll(proved(further.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b"))))


def picture(vector: list[float], side: int = 96) -> np.ndarray:
    """A made-up grey picture that depends on the vector alone: coarse and fine texture, rectangles."""
    rng = np.random.default_rng(zlib.crc32(np.asarray(vector, np.float32).tobytes()))
    texture = lambda low, high, step: resized(rng.uniform(low, high, (side // step + 2,) * 2), step)[:side, :side]
    a = 0.6 * texture(0, 255, 8) + texture(-60, 60, 3) + 40
    y, x = np.mgrid[0:side, 0:side]
    for cx, cy, w, h, turn, shade in zip(*(rng.uniform(lo, hi, 10) for lo, hi in ((0, side), (0, side), (4, 20), (4, 20), (0, np.pi), (0, 255))), strict=True):
        u, v = (x - cx) * np.cos(turn) + (y - cy) * np.sin(turn), (y - cy) * np.cos(turn) - (x - cx) * np.sin(turn)
        a[(np.abs(u) < w / 2 + 1) & (np.abs(v) < h / 2 + 1)] = shade
    return np.clip(a, 0, 255)


def edited(a: np.ndarray, seed: int) -> np.ndarray:
    """A crop of seven tenths or more of each side, brightened or dimmed; half of them turned by
    quarters, a fifth made smaller."""
    rng = np.random.default_rng(seed)
    n = int(a.shape[0] * rng.uniform(0.72, 0.95))
    y, x = rng.integers(0, a.shape[0] - n + 1, 2)
    b = a[y : y + n, x : x + n] * rng.uniform(0.75, 1.1) + rng.uniform(-12, 18)
    b = np.rot90(b, rng.integers(0, 4)) if rng.random() < 0.5 else b
    return np.clip(resized(b, 0.8) if rng.random() < 0.2 else b, 0, 255)


def media_of(vectors: DataFrame, *, every: int = 5) -> DataFrame:
    """A media table (media_id, image) made of an embedding table: a picture of each vector, and
    an edited copy of it where the id is divisible by `every`. Media ids are 2 * vec_id, copies 1 more.
    Rows with a null id or a null vector have no picture and are left out."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            listed = part.column(1).to_pylist()
            for s in range(0, len(listed), 500):
                ids, images = [], []
                for i, v in zip(part.column(0)[s : s + 500].to_pylist(), listed[s : s + 500], strict=True):
                    if i is None or v is None:
                        continue
                    a = picture(v)
                    ids.append(2 * i), images.append(encode_png(np.clip(a, 0, 255)))
                    if i % every == 0:
                        ids.append(2 * i + 1), images.append(encode_png(edited(a, i)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["media_id", "image"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "media_id long, image binary")
