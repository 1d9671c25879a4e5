"""Image inspection: difference hashes, duplicate clusters, detector reliability, group keys, bit depth, stretching."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns that propose a group key from a file name.
GROUP_PATTERNS = (r"^(.*)_[^_]+$", r"^(.*?)_", r"^(\D*\d+)", r"^(.*?)[._-]?\d+$")


def orientations(side: int) -> list[list[int]]:
    """The eight symmetries of a square grid, as source positions in row order."""
    base = [[r * side + c for c in range(side)] for r in range(side)]
    turn = lambda g: [list(row) for row in zip(*g[::-1], strict=True)]
    flip = lambda g: [row[::-1] for row in g]
    out, g = [], base
    for _ in range(4):
        out += [[x for row in g for x in row], [x for row in flip(g) for x in row]]
        g = turn(g)
    return out


def grid_hash(grid: Column, side: int, positions: list[int] | None = None) -> Column:
    """Bits (as a text of 0 and 1) of a side x side grid in row order: is the right neighbour greater."""
    at = positions or list(range(side * side))
    cell = lambda i: F.element_at(grid, at[i] + 1)
    return F.concat(*(F.when(cell(r * side + c + 1) > cell(r * side + c), "1").otherwise("0") for r in range(side) for c in range(side - 1)))


def canonical_hash(grid: Column, side: int) -> Column:
    """The least hash over all orientations."""
    return F.array_min(F.array(*(grid_hash(grid, side, p) for p in orientations(side))))


def clusters(hashed: DataFrame, hash_column: str, item: str) -> DataFrame:
    """hash, members (sorted), size of hashes that several items share, largest first."""
    groups = hashed.groupBy(F.col(hash_column).alias("hash")).agg(F.sort_array(F.collect_list(item)).alias("members"), F.count(F.lit(1)).alias("size"))
    return groups.where("size > 1").orderBy(F.desc("size"), F.col("members")[0])


def reliability(hashed: DataFrame, hash_column: str) -> DataFrame:
    """n, n_distinct, largest, entropy (of shares, over its maximum), collapsed: whether the hash tells images apart."""
    sizes = hashed.groupBy(hash_column).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.max("size").alias("largest"))
    share = F.col("size") / F.col("n")
    bits = sizes.join(F.broadcast(total), F.lit(True)).agg(F.sum(-share * F.log2(share)).alias("bits"))
    row = total.join(bits, F.lit(True)).withColumn("entropy", F.when(F.col("n_distinct") > 1, F.col("bits") / F.log2(F.col("n_distinct"))).otherwise(0.0))
    collapsed = (F.col("n_distinct") <= F.greatest(F.lit(2), F.floor(F.col("n") / 50))) | (F.col("largest") > 0.5 * F.col("n")) | (F.col("entropy") < 0.3)
    return row.select("n", "n_distinct", "largest", "entropy", collapsed.alias("collapsed"))


def group_by_pattern(items: DataFrame, item: str, pattern: str) -> DataFrame:
    """items with base: the first group that pattern captures at the start of the item. All or nothing: an item that does
    not match would become a group of its own, so any such item is refused."""
    if not re.compile(pattern).groups:
        raise ValueError(f"the pattern captures no group: {pattern}")
    made = items.withColumn("base", F.nullif(F.regexp_extract(item, f"^(?:{pattern})", 1), F.lit("")))
    missed = made.where("base IS NULL").select(item)
    if examples := [r[0] for r in missed.orderBy(item).limit(3).collect()]:
        raise ValueError(f"{missed.count()} items do not match {pattern}, as {examples}")
    return made


def group_candidates(items: DataFrame, item: str) -> DataFrame:
    """pattern, n_groups, matched, n, useful for each pattern that matches at all: useful if it matches nearly all items
    and makes more than one group and fewer than items."""
    keys = F.array(*(F.struct(F.lit(i).alias("pattern_no"), F.lit(p).alias("pattern"), F.nullif(F.regexp_extract(item, p, 1), F.lit("")).alias("key")) for i, p in enumerate(GROUP_PATTERNS)))
    rows = items.select(F.explode(keys).alias("k")).select("k.*").groupBy("pattern_no", "pattern", "key").agg(F.count(F.lit(1)).alias("m"))
    out = rows.groupBy("pattern_no", "pattern").agg(F.count("key").alias("n_groups"), F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("m"))), F.lit(0)).alias("matched"), F.sum("m").alias("n"))
    useful = (F.col("matched") >= 0.95 * F.col("n")) & (F.col("n_groups") > 1) & (F.col("n_groups") < F.col("n"))
    return out.where("matched > 0").select("pattern_no", "pattern", "n_groups", "matched", "n", useful.alias("useful"))


def stretch(pixels: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """An array of pixels mapped to 0..255 between two of its percentiles (else its ends), fractions cut; 0 if flat."""
    values = F.array_sort(F.transform(pixels, lambda x: x.cast("double")))

    def at(v: Column, q: float) -> Column:
        p = (F.size(v) - 1) * F.lit(q)
        a, b = F.element_at(v, (F.floor(p) + 1).cast("int")), F.element_at(v, (F.ceil(p) + 1).cast("int"))
        return a + (b - a) * (p - F.floor(p))

    def scaled(v: Column) -> Column:
        edges = F.when(at(v, high) > at(v, low), F.array(at(v, low), at(v, high))).otherwise(F.array(F.array_min(v), F.array_max(v)))
        one = lambda e: F.transform(pixels, lambda x: F.when(e[1] > e[0], F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x.cast("double") - e[0]) / (e[1] - e[0]))) * 255)).otherwise(0).cast("int"))
        return F.element_at(F.transform(F.array(edges), one), 1)

    return F.when(F.size(pixels) > 0, F.element_at(F.transform(F.array(values), scaled), 1)).otherwise(F.array().cast("array<int>"))


def _decode(batches: Iterator) -> Iterator:
    """Gray planes of PNG files without interlacing, at their full depth; what cannot be read has an error instead."""
    import struct
    import zlib

    import numpy as np
    import pandas as pd

    def plane(data: bytes):
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            raise ValueError("not a PNG file")
        at, body, palette, head = 8, b"", None, None
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + size]
            at += 12 + size
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body += part
            elif kind == b"IEND":
                break
        width, height, depth, color, _, _, interlaced = head
        if interlaced:
            raise ValueError("interlaced")
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        step = max(1, channels * depth // 8)
        line = (width * channels * depth + 7) // 8
        raw = zlib.decompress(body)
        rows, before = np.zeros((height, line), np.uint8), np.zeros(line, np.int64)
        for y in range(height):
            kind, x = raw[y * (line + 1)], np.frombuffer(raw, np.uint8, line, y * (line + 1) + 1).astype(np.int64)
            if kind == 2:
                x = (x + before) & 255
            elif kind in (1, 3, 4):
                for i in range(line):
                    a, b, c = (x[i - step], before[i], before[i - step]) if i >= step else (0, before[i], 0)
                    guess = a if kind == 1 else (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                    x[i] = (x[i] + guess) & 255
            rows[y], before = x, x
        if depth == 16:
            values = rows.view(">u2").astype(np.float32)
        elif depth == 8:
            values = rows.astype(np.float32)
        else:
            bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
            values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, : width * channels].astype(np.float32)
        values = values.reshape(height, width, channels)
        if color == 3:
            values = palette[values[:, :, 0].astype(int)].astype(np.float32)
        if values.shape[2] >= 3:
            values = values[:, :, :3] @ np.array([0.299, 0.587, 0.114], np.float32)
        else:
            values = values[:, :, 0]
        return width, height, depth, values

    for batch in batches:
        out = []
        for path, data in zip(batch["path"], batch["content"], strict=True):
            try:
                w, h, depth, values = plane(data)
                out.append((path, w, h, depth, values.ravel().tolist(), None))
            except Exception as error:  # a damaged file is a row with its error
                out.append((path, None, None, None, None, f"{type(error).__name__}: {error}"))
        yield pd.DataFrame(out, columns=["path", "width", "height", "bit_depth", "pixels", "error"]).astype({"width": "Int32", "height": "Int32", "bit_depth": "Int32"})


def decode_png(files: DataFrame) -> DataFrame:
    """files: path, content (a binaryFile scan). path, width, height, bit_depth, pixels (gray, row order), error.
    Reads 16 bits as 16 bits, unlike the built-in image source."""
    return files.select("path", "content").mapInPandas(_by_value(_decode), "path string, width int, height int, bit_depth int, pixels array<float>, error string")


def _hash(batches: Iterator) -> Iterator:
    import numpy as np
    import pandas as pd

    size = 16

    def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
        """Linear interpolation by a triangle that widens when it shrinks the image."""

        def weights(n_in: int, n_out: int) -> np.ndarray:
            scale = n_in / n_out
            reach = max(1.0, scale)
            center = (np.arange(n_out) + 0.5) * scale
            w = np.maximum(0, 1 - np.abs((np.arange(n_in) + 0.5)[None, :] - center[:, None]) / reach)
            return w / w.sum(axis=1, keepdims=True)

        return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T

    def bits(image: np.ndarray) -> str:
        small = resized(image, size + 1, size)
        return "".join("1" if x else "0" for x in (small[:, 1:] > small[:, :-1]).ravel())

    for batch in batches:
        made = []
        for w, h, pixels in zip(batch["width"], batch["height"], batch["pixels"], strict=True):
            if pixels is None:
                made.append(None)
                continue
            image = np.asarray(pixels, np.float64).reshape(int(h), int(w))
            turns = [np.rot90(image, k) for k in range(4)]
            least = min(bits(x) for t in turns for x in (t, np.fliplr(t)))
            made.append(f"{int(least, 2):0{size * size // 4}x}")
        yield pd.DataFrame({"path": batch["path"], "hash": made})


def image_hash(images: DataFrame) -> DataFrame:
    """path, hash: the canonical 256-bit difference hash (hex) of decoded images."""
    return images.select("path", "width", "height", "pixels").mapInPandas(_by_value(_hash), "path string, hash string")


def _by_value(function):
    """function for Python workers that cannot import this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return function


def depth_counts(images: DataFrame) -> DataFrame:
    """bit_depth, width, height, n; and whether any image has 16 bits."""
    counts = images.groupBy("bit_depth", "width", "height").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("any_16_bit", F.max(F.col("bit_depth") > 8).over(Window.partitionBy(F.lit(0))))


def _encode(batches: Iterator) -> Iterator:
    import struct
    import zlib

    import numpy as np
    import pandas as pd

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    for batch in batches:
        made = []
        for w, h, pixels in zip(batch["width"], batch["height"], batch["pixels"], strict=True):
            if pixels is None:
                made.append(None)
                continue
            gray = np.asarray(pixels, np.uint8).reshape(int(h), int(w), 1)
            lines = np.concatenate([np.zeros((int(h), 1), np.uint8), np.repeat(gray, 3, axis=2).reshape(int(h), -1)], axis=1)
            head = struct.pack(">IIBBBBB", int(w), int(h), 8, 2, 0, 0, 0)
            made.append(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b""))
        yield pd.DataFrame({"path": batch["path"], "content": made})


def encode_png(images: DataFrame) -> DataFrame:
    """path, content: images (path, width, height, pixels) stretched to 8 bits, as RGB files for training."""
    rows = images.select("path", "width", "height", stretch(F.col("pixels")).alias("pixels"))
    return rows.mapInPandas(_by_value(_encode), "path string, content binary")
