"""Cropped and edited copies of images, by local descriptors.

Per distinct image: Harris corners on a pyramid of LEVELS sizes, STEP apart (small pictures also enlarged, so
that half a picture's size still has corners with room around them), each with the orientation
of its intensity centroid and BITS comparisons of smoothed pixel pairs turned by that orientation.
Each of TABLES tables draws WIDTH of the bits; a key is a table with a corner's values of them, and images
that share at least SHARED keys are candidates. Corners d bits off share a table's key with a chance
of about (1 - WIDTH / BITS) ** d. A candidate pair is a copy if at least INLIERS of its descriptor matches,
at places of their own, agree on one shift, turn and scale. Keys are no proof against DISTANCE: the share of
true copies that become candidates is measured by tests, for crops, noise, turns, sizes and local edits.
Unlike pictures share keys too (5 in 10,000 pairs of mosaics of 144 px), which adds candidates; so that a chance likeness
of many corners makes no copy, COMMON of the places that the two images have in their common part must agree.

Equal images are one class before anything else, and the candidates of a key go through
links_of_lists(), so neither a picture that a third of all rows share nor a key that
many pictures have is expanded to all pairs of one group of copies. All corners of a pair of pictures are compared,
in parts of MATRIX pairs, matches vote for a turn, size and shift, and those of the fullest bins are tried first,
the same way for few corners and many.

Keys meet in buckets, as 4 bytes each (the rest of a key is its bucket's number), so that little more than
that is on disk while they are counted; two keys that are taken for one only add a candidate. Candidates get their corners
in slices of pairs of about MOVED bytes, and a step's shuffle files go when it ends, so the disk in use is that of
the features and of one slice, however many candidates there are.

Edge cases: images that are null, of another length than width * height, or smaller than a
patch have no features and match equal images only; without pixels an image is its own class; repeated rows get one
row each; an empty table gives no rows; rows without image_id take no part; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm.common import U64, as_long, mix, parts_for, slices, stage_path, staged, table
from gleanwork.llm.components import components, links_of_lists

BITS, RADIUS, ANGLES = 128, 12, 60
#: Tables of keys, bits of a key, and keys that candidates share.
TABLES, WIDTH, SHARED = 6, 40, 2
#: Sizes of the pyramid: each level is so many times smaller than the one before.
LEVELS, STEP = 7, 1.2
#: A picture with a side under so many pixels is enlarged by levels of its own, until it has them.
SMALL = 128
#: A corner's response over the image's largest; descriptors match up to this distance; agreeing matches of a copy.
RESPONSE, DISTANCE, INLIERS = 0.05, 16, 5
#: Pixels by which the place of an agreeing match may be off, more by a share of its distance, and by which two places differ.
OFF, SLOPE, APART = 3.0, 0.15, 4.0
#: Share of the places in the common part of both images that must agree.
COMMON = 0.3
#: Pairs of corners that are compared at once; BINS * TRIED matches are tried, TRIED of a bin first.
MATRIX, BINS, TRIED = 1_000_000, 24, 8
#: Images that are described at once, and bytes of one place: x, y, level and angle in 1/16 pixel and 1/4096 turn.
TOGETHER, PLACE = 8, np.dtype([("x", "<i4"), ("y", "<i4"), ("level", "<i2"), ("turn", "<i2")])
#: Corners whose keys are dealt at once and made at once, keys behind a bucket, and bytes of corners that go to their pairs at once.
CORNERS, CODED, BUCKET, MOVED = 200_000, 40_000, 2_000_000, 256_000_000
#: While copies() runs: rows that a Python worker gets at once, and shuffle files of a stage table go once it is written.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _tests() -> np.ndarray:
    """[angle, bit] -> two flat indices of a patch, drawn from its disc; the pairs come from a fixed seed."""
    rng = np.random.default_rng(7)
    far, at = RADIUS * np.sqrt(rng.uniform(0, 1, (BITS, 2))), rng.uniform(0, 2 * np.pi, (BITS, 2))
    turned = at + 2 * np.pi / ANGLES * np.arange(ANGLES)[:, None, None]
    x, y = np.rint(far * np.cos(turned)).astype(np.int64), np.rint(far * np.sin(turned)).astype(np.int64)
    return (y + RADIUS) * (2 * RADIUS + 1) + x + RADIUS


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r+1)^2 boxes, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide, n = np.pad(x, pad, mode="edge"), x.shape[axis]
        x = sum(wide[:, k : k + n] if axis == 1 else wide[:, :, k : k + n] for k in range(2 * r + 1)) * np.float32(1 / (2 * r + 1))
    return x


def _smaller(images: np.ndarray, scale: float) -> np.ndarray:
    """Images resized by 1 / scale, between the pixels of smoothed ones."""
    if scale == 1:
        return images
    out = _box(images, 1) if scale > 1.3 else images
    for axis in (1, 2):
        n = out.shape[axis]
        at = (np.arange(int(n / scale)) + 0.5) * scale - 0.5
        low = np.clip(np.floor(at).astype(np.int64), 0, n - 1)
        shape = [1, 1, 1]
        shape[axis] = -1
        part = np.clip(at - low, 0, 1).astype(np.float32).reshape(shape)
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, n - 1), axis) * part
    return out


def _peaks(r: np.ndarray, reach: int = 3) -> np.ndarray:
    top = r
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (reach, reach)
        wide, n = np.pad(top, pad, constant_values=-np.inf), r.shape[axis]
        parts = [wide[:, k : k + n] if axis == 1 else wide[:, :, k : k + n] for k in range(2 * reach + 1)]
        top = parts[0].copy()
        for part in parts[1:]:
            np.maximum(top, part, out=top)
    return r == top


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equally large images: (image, PLACE, descriptor bytes) of all corners."""
    tests, found = _tests(), []
    reach = np.arange(-RADIUS, RADIUS + 1, dtype=np.float32)
    disc = (reach[:, None] ** 2 + reach[None, :] ** 2 <= (RADIUS - 2) ** 2).ravel()
    down, right = (np.where(disc, x.ravel(), 0) for x in np.broadcast_arrays(reach[:, None], reach[None, :]))
    window = (np.arange(-RADIUS, RADIUS + 1)[:, None], np.arange(-RADIUS, RADIUS + 1)[None, :])
    enlarged = max(0, int(np.ceil(np.log(SMALL / min(images.shape[1:])) / np.log(STEP) - 1e-9)))
    for level in range(-min(enlarged, LEVELS), LEVELS):
        scale = STEP**level
        if int(min(images.shape[1:]) / scale) <= 2 * RADIUS + 2:
            break
        picture = _smaller(images.astype(np.float32), scale)
        gy, gx = np.gradient(_box(picture, 1), axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
        keep = _peaks(r) & (r > RESPONSE * r.max(axis=(1, 2), keepdims=True)) & (r > 1e-6)
        keep[:, :RADIUS], keep[:, -RADIUS:], keep[:, :, :RADIUS], keep[:, :, -RADIUS:] = False, False, False, False
        i, y, x = np.nonzero(keep)
        if not len(i):
            continue
        flat = _box(picture, 2)[i[:, None, None], y[:, None, None] + window[0], x[:, None, None] + window[1]].reshape(len(i), -1)
        theta = np.arctan2(flat @ down, flat @ right)
        at = tests[np.rint(theta / (2 * np.pi) * ANGLES).astype(np.int64) % ANGLES]
        bits = np.take_along_axis(flat, at[..., 0], 1) < np.take_along_axis(flat, at[..., 1], 1)
        places = np.zeros(len(i), PLACE)
        places["x"], places["y"] = (np.rint(((v + 0.5) * scale - 0.5) * 16) for v in (x, y))
        places["level"], places["turn"] = level, np.rint(theta / (2 * np.pi) * 4096)
        found.append((i, places, np.packbits(bits, axis=1)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, PLACE), np.zeros((0, BITS // 8), np.uint8)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _near(da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of descriptors up to DISTANCE apart; about MATRIX pairs are compared at once."""
    (a, b), found = (np.ascontiguousarray(np.ascontiguousarray(x).view("<u8").T) for x in (da, db)), []
    step = max(1, MATRIX // max(1, b.shape[1]))
    for k in range(0, a.shape[1], step):
        apart = sum(np.bitwise_count(own[k : k + step, None] ^ other) for own, other in zip(a, b, strict=True))
        i, j = np.nonzero(apart <= DISTANCE)
        found.append((i + k, j))
    return tuple(np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _by_votes(turn: np.ndarray, steps: np.ndarray, x: np.ndarray, y: np.ndarray, size: float) -> np.ndarray:
    """Matches to be tried as the transform, BINS * TRIED at most: TRIED of each bin of turn, size and shift, the fullest first, then the others."""
    each, of, turns = np.arange(len(turn)), [], 12
    for dt, ds, dx, dy in itertools.product((0, 1), repeat=4):
        cell = [np.floor(turn / (2 * np.pi) * turns + dt / 2) % turns, (steps + ds) // 2, np.floor(x / size + dx / 2), np.floor(y / size + dy / 2)]
        code = 8 * dt + 4 * ds + 2 * dx + dy
        for k, span in zip(cell, (16, 64, 1 << 20, 1 << 20), strict=True):
            code = code * span + k.astype(np.int64) % span
        of.append(code)
    _, bin_of, votes = np.unique(np.concatenate(of), return_inverse=True, return_counts=True)
    votes_of = votes[bin_of].reshape(16, -1)
    best = np.argmax(votes_of, axis=0)
    votes, bins = votes_of[best, each], bin_of.reshape(16, -1)[best, each]
    order = np.lexsort((each, bins, -votes))
    first = np.flatnonzero(np.append(True, bins[order][1:] != bins[order][:-1]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[np.argsort(rank >= TRIED, kind="stable")][: BINS * TRIED]


def agreeing(pa: np.ndarray, da: np.ndarray, pb: np.ndarray, db: np.ndarray) -> int:
    """Matches of two images, at places of their own, that one similarity transform explains: the most, or INLIERS once so many are found.

    0 where all matches together have fewer places than INLIERS. Matches are tried as the transform in the order of _by_votes(), the fullest Hough bins first.
    """
    if min(len(pa), len(pb)) < INLIERS:
        return 0
    i, j = _near(da, db)
    if len(i) < INLIERS:
        return 0
    (ax, ay, al, at), (bx, by, bl, bt) = ([p[k][f].astype(np.float64) for f in ("x", "y", "level", "turn")] for p, k in ((pa, i), (pb, j)))
    ax, ay, bx, by = ax / 16, ay / 16, bx / 16, by / 16
    turn, steps = (bt - at) * (2 * np.pi / 4096), bl - al
    cells = lambda x, y: np.rint(x / APART).astype(np.int64) * (1 << 32) + np.rint(y / APART).astype(np.int64)
    own_a, own_b = cells(ax, ay), cells(bx, by)
    if min(len(np.unique(own_a)), len(np.unique(own_b))) < INLIERS:
        return 0
    # The places of all corners, each once.
    placed = [np.unique(cells(p["x"] / 16, p["y"] / 16)) for p in (pa, pb)]
    (allx, ally), (bllx, blly) = (((c >> 32) * APART, (c & 0xFFFFFFFF) * APART) for c in placed)
    reach = [(v.min() - OFF, v.max() + OFF) for v in (allx, ally, bllx, blly)]
    inside = lambda x, y, xs, ys: int(((x >= xs[0]) & (x <= xs[1]) & (y >= ys[0]) & (y <= ys[1])).sum())
    grow, mx, my = STEP**steps, allx.mean() - ax, ally.mean() - ay
    c, s = np.cos(turn) * grow, np.sin(turn) * grow
    extent = max(bllx.max() - bllx.min(), blly.max() - blly.min(), APART)
    best = 0
    for k in _by_votes(turn, steps, bx + c * mx - s * my, by + s * mx + c * my, extent / 4):
        grow = STEP ** steps[k]
        c, s = np.cos(turn[k]) * grow, np.sin(turn[k]) * grow
        alike = np.flatnonzero(np.abs(steps - steps[k]) <= 1)
        alike = alike[np.abs((turn[alike] - turn[k] + np.pi) % (2 * np.pi) - np.pi) < 0.4]
        dx, dy = ax[alike] - ax[k], ay[alike] - ay[k]
        miss = np.hypot(bx[k] + c * dx - s * dy - bx[alike], by[k] + s * dx + c * dy - by[alike])
        fit = alike[miss <= OFF * max(1.0, grow) + SLOPE * np.hypot(dx, dy)]
        if len(fit) <= best:
            continue
        own = min(len(np.unique(own_a[fit])), len(np.unique(own_b[fit])))
        if own > best:
            dx, dy, ex, ey = allx - ax[k], ally - ay[k], bllx - bx[k], blly - by[k]
            there = inside(bx[k] + c * dx - s * dy, by[k] + s * dx + c * dy, *reach[2:])
            back = inside(ax[k] + (c * ex + s * ey) / grow**2, ay[k] + (c * ey - s * ex) / grow**2, *reach[:2])
            if own >= COMMON * min(there, back):
                best = min(own, INLIERS)
        if best == INLIERS:
            break
    return best


def local_features(images: DataFrame) -> DataFrame:
    """(class, places binary, bits binary) of images (class, width, height, pixels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (w, h), same in batch.groupby(["width", "height"]):
                for k in range(0, len(same), TOGETHER):
                    part = same.iloc[k : k + TOGETHER]
                    stack = np.stack([np.frombuffer(p, dtype=np.uint8).reshape(h, w) for p in part["pixels"]])
                    i, places, bits = describe(stack)
                    mine = [i == m for m in range(len(part))]
                    yield pd.DataFrame({"class": part["class"], "places": [places[m].tobytes() for m in mine], "bits": [bits[m].tobytes() for m in mine]})

    return images.mapInPandas(run, "class long, places binary, bits binary")


def _drawn() -> np.ndarray:
    """[bit, table] -> the bit's value in the table's code, 0 where it is not drawn; the draws come from a fixed seed."""
    rng, out = np.random.default_rng(9), np.zeros((BITS, TABLES))
    for t in range(TABLES):
        out[rng.permutation(BITS)[:WIDTH], t] = 2.0 ** np.arange(WIDTH)
    return out


def _dealt(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """The keys of each batch by bucket: the nodes that have any there, how many each has, and the keys' tokens; a key is a table and its code of a corner."""
    drawn, tables = _drawn(), np.arange(TABLES, dtype=np.uint64)
    for batch in batches:
        each = (batch["bits"].map(len) // (BITS // 8)).tolist()
        for start, end in slices(each, CORNERS):
            bits = np.frombuffer(b"".join(batch["bits"].iloc[start:end]), dtype=np.uint8).reshape(-1, BITS // 8)
            if not len(bits):
                continue
            codes = np.concatenate([(np.unpackbits(bits[k : k + CODED], axis=1) @ drawn).astype(np.uint64) for k in range(0, len(bits), CODED)])
            keys = mix((codes * np.uint64(TABLES) + tables).ravel())
            nodes = np.repeat(batch["class"].iloc[start:end].to_numpy(), np.array(each[start:end]) * TABLES)
            to, token = (keys % U64(buckets)).astype(np.int32), (keys // U64(buckets)).astype("<u4")
            order = np.lexsort((token, nodes, to))
            to, nodes, token = to[order], nodes[order], token[order]
            new = lambda *columns: np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
            keep = new(to, nodes, token)
            to, nodes, token = to[keep], nodes[keep], token[keep]
            runs = np.append(np.flatnonzero(new(to, nodes)), len(to))
            there, first = np.unique(to[runs[:-1]], return_index=True)
            rows = [(n, nodes[runs[i:j]].tobytes(), np.diff(runs[i : j + 1]).astype("<i4").tobytes(), token[runs[i] : runs[j]].tobytes()) for n, i, j in zip(there, first, np.append(first, len(runs) - 1)[1:], strict=True)]
            yield pd.DataFrame(rows, columns=["bucket", "nodes", "sizes", "tokens"])


def _met(dealt: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """(key, node), each once, of a bucket's keys that several nodes have."""
    read = lambda column, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in dealt[column]])
    token, node = read("tokens", "<u4"), np.repeat(read("nodes", "<i8"), read("sizes", "<i4"))
    order = np.argsort(token, kind="stable")
    token, node = token[order], node[order]
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    several = np.repeat(np.minimum.reduceat(node, begin) < np.maximum.reduceat(node, begin), np.diff(np.append(begin, len(token))))
    key = token[several].astype(U64) * U64(buckets) + U64(dealt["bucket"].iloc[0])
    return pd.DataFrame({"key": as_long(key), "node": node[several]}).drop_duplicates()


def shared_keys(found: DataFrame) -> DataFrame:
    """(key, node), each once, of the keys that several classes of found (class, bits) have."""
    corners = found.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0] // (BITS // 8)
    buckets = parts_for(corners * TABLES, BUCKET, 16)
    dealt = found.select("class", "bits").mapInPandas(lambda b: _dealt(b, buckets), "bucket int, nodes binary, sizes binary, tokens binary")
    return dealt.groupBy("bucket").applyInPandas(lambda b: _met(b, buckets), "key long, node long")


def _consenting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = lambda p, b: (np.frombuffer(p, PLACE), np.frombuffer(b, dtype=np.uint8).reshape(-1, BITS // 8))
        yes = [agreeing(*read(p, b), *read(q, c)) >= INLIERS for p, b, q, c in zip(batch["ap"], batch["ab"], batch["bp"], batch["bb"], strict=True)]
        yield batch.loc[yes, ["a", "b"]]


def consenting(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose corners agree, found out a slice of a and of b at a time."""
    pairs = staged(pairs, "pairs")
    each = found.agg(F.coalesce(F.avg(F.length("places") + F.length("bits")), F.lit(0))).first()[0]
    sides = math.ceil(math.sqrt(parts_for(pairs.count() * each, MOVED)))
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(sides)) == k
    path = stage_path(pairs.sparkSession, "consenting")
    for i, j in itertools.product(range(sides), repeat=2):
        a, b = found.where(own("class", i)).toDF("a", "ap", "ab"), found.where(own("class", j)).toDF("b", "bp", "bb")
        part = pairs.where(own("a", i) & own("b", j)).join(a, "a").join(b, "b")
        part.mapInPandas(_consenting, "a long, b long").write.mode("append").parquet(path)
    return pairs.sparkSession.read.schema("a long, b long").parquet(path)


@contextmanager
def _set(conf, settings: dict[str, str]) -> Iterator[None]:
    before = {k: conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def copies(images: DataFrame) -> DataFrame:
    """(image_id, n_features, class_id, component_id) of images (image_id, width, height, pixels).

    class_id is the smallest image_id of the equal images, component_id the smallest of all copies.
    """
    with _set(images.sparkSession.conf, SETTINGS):
        named = images.where("image_id is not null").withColumn("digest", F.coalesce(F.sha2(F.concat_ws(":", "width", "height", F.hex("pixels")), 256), F.lit("")))
        rows = named.select("image_id", F.when(F.col("pixels").isNull(), F.concat(F.lit("none:"), "image_id")).otherwise(F.col("digest")).alias("digest"), "width", "height", "pixels")
        rows = staged(rows, "images")
        classes = rows.groupBy("digest").agg(F.min("image_id").alias("class"))
        one = rows.join(classes, "digest").where(F.col("image_id") == F.col("class")).dropDuplicates(["class"])
        usable = (F.length("pixels") == F.col("width") * F.col("height")) & (F.least("width", "height") > 0)
        found = staged(local_features(one.where(usable).select("class", "width", "height", "pixels")), "features")
        lists = staged(shared_keys(found), "parts")
        roots = components(links_of_lists(lists, lambda pairs: consenting(pairs, found), "image-links", SHARED))
    counts = found.select(F.col("class").alias("node"), F.floor(F.length("bits") / (BITS // 8)).alias("n"))
    known = classes.join(roots, F.col("class") == F.col("node"), "left").drop("node").join(counts, F.col("class") == F.col("node"), "left")
    known = known.select("digest", F.coalesce("n", F.lit(0)).alias("n_features"), F.col("class").alias("class_id"), F.coalesce("root", "class").alias("component_id"))
    return rows.select("image_id", "digest").join(known, "digest").drop("digest")


#: Pixels of a rendered picture's side, and cells of its side.
SIDE, CELLS = 144, 24


def rendered(vectors: DataFrame) -> DataFrame:
    """(image_id, width, height, pixels): a mosaic of each vector; every tenth row is a cropped, edited copy of the row before.

    The tables have no pictures, so these are made of all rows of embeddings, by rule.
    """
    before = vectors.select((F.col("vec_id") + 1).alias("next"), F.col("embedding").alias("earlier"))
    copy = F.col("vec_id") % 10 == 1
    both = vectors.select("vec_id", "embedding").join(before, F.col("vec_id") == F.col("next"), "left")
    both = both.select("vec_id", (copy & F.col("earlier").isNotNull()).alias("copy"), F.when(copy, F.coalesce("earlier", "embedding")).otherwise(F.col("embedding")).alias("v"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, c = np.mgrid[0:CELLS, 0:CELLS]
        for batch in batches:
            out = []
            for vec, copied, v in zip(batch["vec_id"], batch["copy"], batch["v"], strict=True):
                if v is None or not len(v) or not np.isfinite(v := np.asarray(v, dtype=np.float64)).all():
                    out.append((vec, 0, 0, None))
                    continue
                n = len(v)
                cells = v[(17 * r + 5 * c) % n] + v[(7 * r + 29 * c + 3) % n]
                picture = np.kron(np.clip(128 + 300 * cells, 0, 255), np.ones((SIDE // CELLS, SIDE // CELLS)))
                if copied:
                    left, top = 4 + vec % 7, 4 + vec % 5
                    picture = picture[top : SIDE - 6, left : SIDE - 8] * 0.8 + 20
                out.append((vec, picture.shape[1], picture.shape[0], np.rint(picture).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "pixels"])

    return both.mapInPandas(draw, "image_id long, width int, height int, pixels binary")


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(rendered(table(spark, sf_dir, "embeddings")))
