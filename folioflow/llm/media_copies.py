"""Copies among images in a binary column: local descriptors, Hamming tables, geometric consensus.

Corners are found at several scales; each gets an orientation from the centroid of its patch and 256 binary
tests turned by it. Descriptors meet in tables of four 64-bit bands (two within 3 bits share a band whole; a copy
needs only some of its many corners to meet, and shorter bands of plain corners meet in unrelated images). Images that share enough bands are compared corner by corner, and
link if enough matches agree on one similarity transform, as in a crop, a turn or a change of light.

Tables are made in slices of their keys. One slice of FIRST_SLICES gives first components: each round every component
tries the pair that shares most of its bands. Then all keys are gone through, SLICES runs one after the other, and only
lists of several components are kept; pairs there whose components differ are counted over all slices and compared. A
pair inside one component needs no check, so the components are those of all links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, drop_staged, stage
from .components import components

SCALES = (1.0, 0.87, 0.75)
CORNERS = 40
RADIUS = 11
TESTS = 256
ANGLES = 36
MAX_HAMMING = 48
MIN_SHARED = 2
MIN_INLIERS = 8
NEAR_PIXELS = 3.0
FIRST_SLICES, SLICES = 16, 4
#: Rounds of nearest pairs, and the share of tried pairs that must link for one more. They only decide when pairs are compared.
ROUNDS, LEAST_GAIN = 6, 0.05
#: Images that are compared with one in one task, and pairs whose descriptors travel at a time (as many as images, if those are more).
COMPANY, PAIRS_AT_ONCE = 64, 40_000
_RNG = np.random.default_rng(0xB1E)
_TESTS = np.clip(np.round(_RNG.normal(0, RADIUS / 2.2, (TESTS, 4))), -RADIUS + 3, RADIUS - 3)
_TURNED = np.stack(
    [
        np.stack([np.round(c * _TESTS[:, k] - s * _TESTS[:, k + 1]) if axis == 0 else np.round(s * _TESTS[:, k] + c * _TESTS[:, k + 1]) for k in (0, 2) for axis in (0, 1)], 1)
        for c, s in ((np.cos(2 * np.pi * a / ANGLES), np.sin(2 * np.pi * a / ANGLES)) for a in range(ANGLES))
    ]
).astype(np.int64)  # angle, test, (x1, y1, x2, y2)


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def read_image(data: bytes) -> np.ndarray | None:
    """Grey values of a binary PGM or of a PNG with 8-bit samples and no interlace; None for anything else."""
    try:
        if data[:2] == b"P5":
            head = data.split(None, 4)
            w, h = int(head[1]), int(head[2])
            return np.frombuffer(data[len(data) - w * h :], np.uint8).reshape(h, w).astype(np.float32)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            at, body, w = 8, b"", 0
            while at < len(data):
                size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
                part = data[at + 8 : at + 8 + size]
                if kind == b"IHDR":
                    w, h, depth, color, _, _, interlace = int.from_bytes(part[:4]), int.from_bytes(part[4:8]), *part[8:13]
                    if depth != 8 or interlace or color == 3:
                        return None
                    step = {0: 1, 2: 3, 4: 2, 6: 4}[color]
                elif kind == b"IDAT":
                    body += part
                at += size + 12
            raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
            rows = np.zeros((h + 1, (w + 1) * step), np.int64)
            for y in range(h):
                mode, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), rows[y, step:]
                own = rows[y + 1]
                for x in range(len(line)) if mode in (1, 3, 4) else ():
                    a, b, c = own[x], up[x], rows[y, x]
                    p = a + b - c
                    paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    own[x + step] = (line[x] + {1: a, 3: (a + b) // 2, 4: paeth}[int(mode)]) & 255
                if mode in (0, 2):
                    own[step:] = (line + up * (mode == 2)) & 255
            out = rows[1:, step:].reshape(h, w, step)
            return out[:, :, : 3 if step > 2 else 1].mean(2).astype(np.float32)
    except (ValueError, IndexError, KeyError, zlib.error):
        return None
    return None


def box(image: np.ndarray, r: int) -> np.ndarray:
    s = np.pad(image.astype(np.float64), ((r + 1, r), (r + 1, r)), "edge").cumsum(0).cumsum(1)
    d = 2 * r + 1
    return (s[d:, d:] - s[:-d, d:] - s[d:, :-d] + s[:-d, :-d]) / d**2


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return image
    h, w = max(1, int(image.shape[0] * scale)), max(1, int(image.shape[1] * scale))
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, image.shape[0] - 2), np.clip(np.floor(x).astype(int), 0, image.shape[1] - 2)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x0 + 1] * fx
    low = image[y0 + 1][:, x0] * (1 - fx) + image[y0 + 1][:, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, angle, scale) in pixels of the image, and their descriptors as four 64-bit words."""
    points, words = [], []
    for scale in SCALES:
        im = resized(image, scale)
        if min(im.shape) < 2 * RADIUS + 10:
            continue
        soft = box(im, 1)
        gy, gx = np.gradient(soft)
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        strong = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = strong.copy()
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                peak = np.maximum(peak, np.roll(np.roll(strong, dy, 0), dx, 1))
        m = RADIUS + 4
        inner = np.zeros(im.shape, bool)
        inner[m:-m, m:-m] = True
        ys, xs = np.nonzero((strong == peak) & inner & (strong > 1.0))
        order = np.lexsort((xs, ys, -strong[ys, xs]))[:CORNERS]
        ys, xs = ys[order], xs[order]
        if not len(ys):
            continue
        offs = np.arange(-7, 8)
        dy, dx = np.meshgrid(offs, offs, indexing="ij")
        disc = dx**2 + dy**2 <= 49
        patch = soft[ys[:, None] + dy[disc], xs[:, None] + dx[disc]]
        angle = np.arctan2((patch * dy[disc]).sum(1), (patch * dx[disc]).sum(1))
        turn = np.round(angle / (2 * np.pi) * ANGLES).astype(int) % ANGLES
        softer = box(im, 2)
        t = _TURNED[turn]
        bits = softer[ys[:, None] + t[:, :, 1], xs[:, None] + t[:, :, 0]] < softer[ys[:, None] + t[:, :, 3], xs[:, None] + t[:, :, 2]]
        words.append(np.packbits(bits, axis=1).view(np.uint64))
        points.append(np.stack([xs / scale, ys / scale, angle, np.full(len(xs), scale)], 1))
    if not points:
        return np.empty((0, 4), np.float32), np.empty((0, TESTS // 64), np.uint64)
    return np.concatenate(points).astype(np.float32), np.concatenate(words)


def agreeing(pa: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray) -> int:
    """Most matches that one similarity transform explains; every match proposes the transform of its corners."""
    if not len(pa) or not len(pb):
        return 0
    far = np.bitwise_count(da[:, None] ^ db[None]).sum(2)
    i = np.arange(len(pa))
    j = far.argmin(1)
    good = (far[i, j] <= MAX_HAMMING) & (far.argmin(0)[j] == i)
    a, b = pa[i[good]].astype(np.float64), pb[j[good]].astype(np.float64)
    if len(a) < MIN_INLIERS:
        return 0
    turn, grow = b[:, 2] - a[:, 2], a[:, 3] / b[:, 3]
    c, s = np.cos(turn) * grow, np.sin(turn) * grow
    x = c[:, None] * (a[None, :, 0] - a[:, None, 0]) - s[:, None] * (a[None, :, 1] - a[:, None, 1]) + b[:, None, 0]
    y = s[:, None] * (a[None, :, 0] - a[:, None, 0]) + c[:, None] * (a[None, :, 1] - a[:, None, 1]) + b[:, None, 1]
    fits = np.hypot(x - b[None, :, 0], y - b[None, :, 1]) <= NEAR_PIXELS
    # Corners found at two scales count once.
    places = np.unique(np.round(a[:, :2] / 3), axis=0, return_inverse=True)[1].ravel()
    return int(((fits.astype(np.float32) @ (places[:, None] == np.arange(places.max() + 1)).astype(np.float32)) > 0).sum(1).max())


def bands(words: np.ndarray) -> np.ndarray:
    """Distinct table keys of an image: the 64 bits of each band, mixed with the band's number."""
    salt = np.arange(1, words.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = words ^ salt
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> np.uint64(29))).view(np.int64)


def compared(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b: units; a staged table) whose corners agree. Of a pair a's descriptors travel, and b's once for COMPANY pairs."""
    shares = stage(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / COMPANY).cast("int").alias("n")), "shares")
    dealt = pairs.join(shares, "b").select(F.col("a").alias("unit"), F.col("b").alias("host"), F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("part"), F.lit(True).alias("guest"))
    hosts = shares.select(F.col("b").alias("unit"), F.col("b").alias("host"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(False).alias("guest"))
    seats = stage(dealt.union(hosts), "seats")
    rows = images.join(F.broadcast(seats) if seats.count() <= BROADCAST_ROWS else seats, "unit").select("host", "part", "guest", "unit", "points", "words")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host = near = None
        for batch in batches:
            found = []
            for h, guest, unit, points, words in zip(batch["host"].tolist(), batch["guest"].tolist(), batch["unit"].tolist(), batch["points"], batch["words"], strict=True):
                own = np.frombuffer(points, np.float32).reshape(-1, 4), np.frombuffer(words, np.uint64).reshape(-1, TESTS // 64)
                if not guest:
                    host, near = h, own
                elif h == host and agreeing(*own, *near) >= MIN_INLIERS:
                    found.append((unit, h))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = stage(rows.repartition(parts, "host", "part").sortWithinPartitions("host", "part", "guest").mapInPandas(run, "a long, b long"), "linked")
    drop_staged(shares, seats)
    return out


def token_lists(images: DataFrame, mark: str, part: int, slices: int) -> DataFrame:
    """Staged rows (token, unit, ``mark``) of the keys of one slice, of tokens with several values of ``mark``."""

    @F.pandas_udf("array<long>")
    def keys(words: pd.Series) -> pd.Series:
        made = (bands(np.frombuffer(w, np.uint64).reshape(-1, TESTS // 64)) for w in words)
        return pd.Series([x[x & slices - 1 == part] for x in made], dtype=object)

    columns = list(dict.fromkeys(["unit", mark]))
    rows = images.select(*columns, F.explode(keys("words")).alias("token")).repartition("token")
    several = rows.groupBy("token").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("token")
    return stage(rows.join(several.hint("merge"), "token"), "media-lists")


def first_components(images: DataFrame) -> DataFrame:
    """node, comp by links among pairs that share MIN_SHARED bands of the first slice."""
    lists = token_lists(images, "unit", 0, FIRST_SLICES)
    beside = lists.select("token", F.col("unit").alias("a"), F.lag("unit").over(Window.partitionBy("token").orderBy("unit")).alias("b")).filter("a <> b")
    above = lists.join(lists.groupBy("token").agg(F.max("unit").alias("b")), "token").select("token", F.col("unit").alias("a"), "b").filter("a <> b")
    # A pair may be both in one list.
    pairs = beside.union(above).selectExpr("token", "least(a, b) a", "greatest(a, b) b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= MIN_SHARED)
    rays, comps = stage(pairs, "rays"), components(images.selectExpr("unit a", "unit b").limit(0))
    drop_staged(lists)
    for _ in range(ROUNDS):
        left = rays.withColumns({"ca": F.col("a"), "cb": F.col("b")})
        for x in "ab":
            of = comps.select(F.col("node").alias(x), F.col("comp").alias("_c"))
            left = left.join(of, x, "left").withColumn(f"c{x}", F.coalesce("_c", x)).drop("_c")
        left = stage(left.filter("ca <> cb"), "left")
        ends = left.select(F.col("ca").alias("k"), "a", "b", "c").union(left.select("cb", "a", "b", "c"))
        tried = stage(ends.groupBy("k").agg(F.max(F.struct("c", "b", "a")).alias("r")).select("r.a", "r.b").distinct(), "tried")
        n = tried.count()
        if not n:
            drop_staged(left, tried)
            break
        found = compared(images, tried)
        gained = found.count()
        older, comps = comps, components(found.union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        again = stage(left.select("a", "b", "c").join(tried, ["a", "b"], "left_anti"), "rays")
        drop_staged(rays, left, tried, found, older)
        rays = again
        if gained <= LEAST_GAIN * n:
            break
    drop_staged(rays)
    return comps


def linked_images(images: DataFrame) -> DataFrame:
    """node, comp of linked images (unit, points, words); images that link with none may be missing."""
    comps = first_components(images)
    n = images.count()
    of = comps.withColumnRenamed("node", "unit")
    tagged = images.select("unit", "words").join(F.broadcast(of) if n <= BROADCAST_ROWS else of, "unit", "left").withColumn("comp", F.coalesce("comp", "unit"))
    slices = [token_lists(tagged, "comp", part, SLICES) for part in range(SLICES)]
    lists = slices[0]
    for more in slices[1:]:
        lists = lists.union(more)
    lists = lists.select("token", "unit", "comp").repartition("token")
    major = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp")).getField("comp").alias("major"))
    marked = lists.join(major.hint("merge"), "token")
    a = marked.filter("comp <> major").selectExpr("token", "unit a", "comp ac")
    b = marked.selectExpr("token", "unit b", "comp bc", "comp = major bm")
    met = a.join(b, "token").filter("ac <> bc AND (bm OR a < b)").selectExpr("least(a, b) a", "greatest(a, b) b")
    rest = stage(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= MIN_SHARED).select("a", "b"), "rest")
    drop_staged(*slices)
    turns = -(-rest.count() // max(n, PAIRS_AT_ONCE))
    links = [compared(images, rest.filter(F.pmod(F.xxhash64("b"), F.lit(turns)) == k)) for k in range(turns)]
    every = comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    for found in links:
        every = every.union(found)
    out = components(every)
    drop_staged(comps, rest, *links)
    return out


def media_classes(media: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """``id_col``, class_id (smallest id reachable by links), n_corners, image_crc32 for every row.

    Equal bytes are one image. Null, unreadable and cornerless images link with nothing but equal bytes (nulls
    with nothing at all); their n_corners is 0, and image_crc32 is null for null. Repeated rows and ties share
    a class; null ids come back null. An empty table gives an empty result.
    """
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["image"]:
                if data is None:
                    rows.append((None, 0, None, None, None))
                    continue
                image = read_image(bytes(data))
                points, words = describe(image) if image is not None and min(image.shape) > 1 else describe(np.zeros((1, 1)))
                unit = xxhash.xxh3_64_intdigest(bytes(data)) >> 1
                rows.append((unit, len(points), zlib.crc32(bytes(data)), points.tobytes(), words.tobytes()))
            made = pd.DataFrame(rows, columns=["unit", "n_corners", "image_crc32", "points", "words"]).astype({"unit": "Int64", "image_crc32": "Int64"})
            yield made.assign(id=batch["id"].to_numpy())

    rows = media.select(F.col(id_col).cast("string").alias("id"), F.col(image_col).alias("image"))
    # Pictures are described where they are made or read: only descriptors are staged, once.
    made = rows.mapInPandas(run, "id string, unit long, n_corners int, image_crc32 long, points binary, words binary")
    kind = media.schema[id_col].dataType
    made = stage(made.withColumn("id", F.col("id").cast(kind)).withColumn("row", F.monotonically_increasing_id()), "media")
    images = made.filter("unit IS NOT NULL").select("unit", "points", "words", "row")
    again = stage(images.groupBy("unit").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "equal-images")
    if not again.isEmpty():
        images = images.join(again, "unit", "left").filter("first IS NULL OR first = row")
    images = images.select("unit", "points", "words")

    comps = linked_images(images)
    found = made.filter("unit IS NOT NULL").select("id", "unit", "n_corners", "image_crc32")
    least = found.groupBy("unit").agg(F.min("id").alias("least")).join(comps.withColumnRenamed("node", "unit"), "unit", "left").withColumn("comp", F.coalesce("comp", "unit"))
    roots = least.groupBy("comp").agg(F.min("least").alias("class_id"))
    named = found.join(least.join(roots, "comp").select("unit", "class_id"), "unit")
    named = named.select(F.col("id").alias(id_col), "class_id", "n_corners", "image_crc32")
    empty = made.filter("unit IS NULL").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), "n_corners", "image_crc32")
    return named.unionByName(empty)


VIEW, SCENE = 112, 144
SCENE_SIGNS = 12


def scene_of(embedding: np.ndarray) -> int:
    """The signs of the first values: vectors that agree in them show the same scene."""
    return int((np.asarray(embedding[:SCENE_SIGNS], np.float32) > 0) @ (1 << np.arange(len(embedding[:SCENE_SIGNS]))))


def rendered(embedding: np.ndarray, view_id: int) -> bytes:
    """An image of the vector's scene, as the view's id crops, lights and blurs it.

    The tables hold no images; views of one scene are edited copies of each other, others show other scenes.
    """
    rng = np.random.default_rng([0x5CE, scene_of(embedding)])
    scene = np.full((SCENE, SCENE), 128.0)
    y, x = np.mgrid[:SCENE, :SCENE]
    for _ in range(40):
        cx, cy, w, h, tone = rng.integers(0, SCENE), rng.integers(0, SCENE), rng.integers(4, 18), rng.integers(4, 18), rng.integers(20, 236)
        if rng.random() < 0.7:
            scene[max(0, cy - h) : cy + h, max(0, cx - w) : cx + w] = tone
        else:
            scene[(x - cx) ** 2 / w**2 + (y - cy) ** 2 / h**2 <= 1] = tone
    grain = sum(box(rng.normal(0, 1, scene.shape), r) * (2 * r + 1) for r in (1, 2, 4))
    scene += 22 * grain
    edit = np.random.default_rng(zlib.crc32(str(view_id).encode()))
    top, left = edit.integers(0, SCENE - VIEW + 1, 2)
    view = scene[top : top + VIEW, left : left + VIEW] * edit.uniform(0.85, 1.1) + edit.uniform(-10, 10) + edit.normal(0, 0.7, (VIEW, VIEW))
    return write_pgm(np.clip(view, 0, 255))


def with_images(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col`` and image (binary PGM, null for a null vector)."""
    bounded_batches(vectors.sparkSession)

    @F.pandas_udf("binary")
    def run(ids: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else rendered(v, i) for i, v in zip(ids, found, strict=True)])

    return vectors.select(F.col(id_col), run(F.coalesce(F.col(id_col), F.lit(0)), F.col(vector_col)).alias("image"))
