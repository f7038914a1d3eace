"""Images as voxel rows. Files are read by Spark (binaryFile) and decoded in the task that holds them.

TIFF: strips or tiles, chunky or planar, uncompressed, LZW, PackBits or deflate, any number of pages, whole numbers of 8 to
32 bits or shares of 1 as floats, gray, RGB(A) or palette. PNG: all depths and colour types, interlaced or not. Other
formats need Pillow.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.scalar import as_uint8, hex_color
from cellweave.operators.image import first_seen_palette
from cellweave.sources.tables import exists, suffix


def _packbits(raw: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(raw):
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += 2 + n
        elif n > 128:
            out += raw[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


def _lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the first bit first; a code widens one entry early."""
    words: list[bytes] = [*(bytes([k]) for k in range(256)), b"", b""]
    out, last, held, bits, width = bytearray(), b"", 0, 0, 9
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del words[258:]
            last, width = b"", 9
            continue
        word = words[code] if code < len(words) else last + last[:1]
        out += word
        if last:
            words.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return bytes(out)


def _tiff_page(raw: bytes, end: str, tags: dict[int, tuple]) -> np.ndarray:
    """One page from its tags: blocks are unpacked and put in their places."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
    form = {1: "u", 3: "f"}.get(one(339, 1))
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(one(259, 1))
    if unpack is None or form is None or (form, bits) not in {("u", 8), ("u", 16), ("u", 32), ("f", 32), ("f", 64)}:
        raise ValueError(f"no reader for TIFF pages of {bits} bits, sample format {one(339, 1)} and compression {one(259, 1)}")
    kind = np.dtype(f"{end}{form}{bits // 8}")
    tiled, planar = 322 in tags, one(284, 1) == 2
    wide, high = (one(322, 0), one(323, 0)) if tiled else (width, min(height, one(278, height)))
    across, down, depth = -(-width // wide), -(-height // high), 1 if planar else samples
    page = np.zeros((down * high, across * wide, samples), kind.newbyteorder("="))
    for k, (place, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        plane, at = divmod(k, across * down)
        y, x = divmod(at, across)
        block = np.frombuffer(unpack(raw[place : place + size]), kind)
        block = block[: len(block) // (wide * depth) * wide * depth].reshape(-1, wide, depth)[:high]
        if one(317, 1) == 2:  # differences along a row
            block = np.cumsum(block, axis=1, dtype=page.dtype)
        page[y * high : y * high + len(block), x * wide : (x + 1) * wide, plane : plane + depth] = block
    page = page[:height, :width]
    if one(262, 1) == 3 and 320 in tags:
        colors = np.asarray(tags[320], np.uint16).reshape(3, -1).T
        page = (colors >> 8).astype(np.uint8)[page[:, :, 0]]
    elif form == "f":
        if not (np.isfinite(page).all() and page.min(initial=0) >= 0 and page.max(initial=0) <= 1):
            raise ValueError("floats of an image are shares between 0 and 1")
        page = np.rint(page * 255).astype(np.uint8)
    elif bits == 32:
        page = np.rint(page / (2**32 - 1) * 255).astype(np.uint8)
    return page if page.shape[2] > 1 else page[:, :, 0]


def tiff_pages(raw: bytes) -> list[np.ndarray]:
    """Pages of a TIFF, rows x columns [x samples]."""
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None or struct.unpack(end + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    kinds = {1: "B", 3: "H", 4: "I"}
    pages, at = [], struct.unpack(end + "I", raw[4:8])[0]
    while at:
        n = struct.unpack(end + "H", raw[at : at + 2])[0]
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack(end + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
            if kind in kinds:
                size = struct.calcsize(kinds[kind]) * count
                place = at + 10 + 12 * k
                if size > 4:
                    place = struct.unpack(end + "I", raw[place : place + 4])[0]
                tags[tag] = struct.unpack(f"{end}{count}{kinds[kind]}", raw[place : place + size])
        pages.append(_tiff_page(raw, end, tags))
        at = struct.unpack(end + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return pages


def write_tiff(pages: Sequence[np.ndarray]) -> bytes:
    """An uncompressed little-endian TIFF of 8-bit pages."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        data = np.ascontiguousarray(page, np.uint8)
        h, w = data.shape[:2]
        samples = data.shape[2] if data.ndim == 3 else 1
        place = len(out)
        out += data.tobytes() + b"\0" * (data.nbytes % 2)
        bits_at = len(out)
        out += struct.pack("<" + "H" * samples, *[8] * samples) + b"\0" * (2 * samples % 4)
        struct.pack_into("<I", out, link, len(out))
        bits = 8 if samples == 1 else bits_at if samples > 2 else 8 | 8 << 16
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, samples, bits), (259, 3, 1, 1), (262, 3, 1, 2 if samples > 2 else 1), (273, 4, 1, place), (277, 3, 1, samples), (278, 4, 1, h), (279, 4, 1, data.nbytes)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def png_array(raw: bytes) -> np.ndarray:
    """Rows x columns [x samples] of a PNG."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    k, body, palette = 8, b"", None
    while k < len(raw):
        n, kind = struct.unpack(">I4s", raw[k : k + 8])
        part = raw[k + 8 : k + 8 + n]
        if kind == b"IHDR":
            width, height, bits, color, _, _, interlace = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        k += 12 + n
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw_lines = zlib.decompress(body)
    # First column and row and the steps of the seven passes of an interlaced file.
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlace else [(0, 0, 1, 1)]
    image = np.zeros((height, width, samples), np.uint16 if bits == 16 else np.uint8)
    at = 0
    for x, y, dx, dy in passes:
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w <= 0 or h <= 0:
            continue
        length = -(-w * samples * bits // 8)
        lines = np.frombuffer(raw_lines, np.uint8, h * (1 + length), at).reshape(h, 1 + length)
        at += lines.size
        image[y::dy, x::dx] = _png_samples(_png_lines(lines, max(1, samples * bits // 8)), w * samples, bits).reshape(h, w, samples)
    if palette is not None:
        return palette[image[:, :, 0]]
    if bits < 8:
        image = image * (255 // (2**bits - 1))
    return image if samples > 1 else image[:, :, 0]


def _png_lines(lines: np.ndarray, step: int) -> np.ndarray:
    """Lines without their filters; step is the bytes from a pixel to the next."""
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.int64)
    for y, (method, *_) in enumerate(lines):
        line = lines[y, 1:].astype(np.int64)
        if method in (0, 2):
            now = (line + (above if method == 2 else 0)) & 255
        else:
            now = np.zeros(len(line), np.int64)
            for x in range(len(line)):
                a = now[x - step] if x >= step else 0
                c = above[x - step] if x >= step else 0
                b = above[x]
                near = a if method == 1 else (a + b) // 2 if method == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[x] = (line[x] + near) & 255
        out[y], above = now, now
    return out


def _png_samples(lines: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The first `count` samples of each line."""
    if bits == 16:
        return np.ascontiguousarray(lines).view(">u2").astype(np.uint16)[:, :count]
    if bits == 8:
        return lines[:, :count]
    shifts = np.arange(8 - bits, -1, -bits)
    return ((lines[:, :, None] >> shifts) & (2**bits - 1)).reshape(len(lines), -1)[:, :count].astype(np.uint8)


def decode(raw: bytes, kind: str) -> list[np.ndarray]:
    """The pages of an image file."""
    if kind in (".tif", ".tiff"):
        return tiff_pages(raw)
    if kind == ".png":
        return [png_array(raw)]
    try:
        from PIL import Image
    except ImportError as error:
        raise ImportError(f"{kind} files need Pillow") from error
    import io

    return [np.asarray(Image.open(io.BytesIO(raw)))]


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, x, y, s array<int>, most): the pixels of image files, x being the row and y the column."""
    if suffix(path) not in (".tif", ".tiff", ".png", ".jpg", ".jpeg", ""):
        raise ValueError(f"no reader for images of kind {suffix(path)!r}")
    if not exists(spark, path):
        raise FileNotFoundError(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                for k, page in enumerate(decode(raw, suffix(name))):
                    cube = page if page.ndim == 3 else page[:, :, None]
                    x, y = np.indices(cube.shape[:2])
                    yield pd.DataFrame({"path": name, "page": k, "x": x.ravel(), "y": y.ravel(), "s": list(cube.reshape(-1, cube.shape[2]).astype(np.int32)), "most": int(np.iinfo(cube.dtype).max) if cube.dtype.kind in "ui" else 1})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, x long, y long, s array<int>, most int")


def load_object_image(spark: SparkSession, path: str, image: str = "O1", background: str | None = "black") -> tuple[DataFrame, list[str]]:
    """Voxels of a colour TIFF and its palette: labels follow the first pixel of a colour, column by column; one page is one z."""
    names = {"black": "#000000", "white": "#FFFFFF", "B": "#000000", "W": "#FFFFFF"}
    level = lambda k: as_uint8(F.get("s", F.when(F.size("s") >= 3, F.lit(k)).otherwise(F.lit(0))), F.col("most").cast("double"))
    pixels = pages(spark, path).select("x", "y", F.col("page").cast("long").alias("z"), hex_color(level(0), level(1), level(2)).alias("color"))
    ordered = pixels.select(F.col("y").alias("x"), F.col("x").alias("y"), "z", "color")  # column-major: columns first
    palette = first_seen_palette(ordered, names.get(background, background) if background else None)
    voxels = pixels.join(F.broadcast(palette), "color").select(F.lit(image).alias("image"), "x", "y", "z", F.lit(1).alias("c"), F.col("label").cast("double").alias("value"))
    return voxels, [r["color"] for r in palette.orderBy("label").collect()]


def load_scalar_image(spark: SparkSession, path: str, channels: int, image: str = "S1", keep: Sequence[int] | None = None) -> DataFrame:
    """Voxels of a gray TIFF whose pages go through the channels of one z after another; keep lists one-based channels, renumbered."""
    if channels <= 0:
        raise ValueError("an image has one channel at least")
    rows = pages(spark, path)
    z, c = F.floor(F.col("page") / channels).cast("long"), (F.col("page") % channels + 1).cast("int")
    voxels = rows.select(F.lit(image).alias("image"), "x", "y", z.alias("z"), c.alias("c"), as_uint8(F.get("s", F.lit(0)), F.col("most").cast("double")).cast("double").alias("value"))
    if keep is None:
        return voxels
    if any(not 1 <= k <= channels for k in keep):
        raise ValueError("channels are counted from 1")
    number = F.create_map(*(F.lit(x) for pair in zip(keep, range(1, len(keep) + 1), strict=True) for x in pair))
    return voxels.where(F.col("c").isin(list(keep))).withColumn("c", number[F.col("c")])


def array_voxels(spark: SparkSession, image: str, array: np.ndarray) -> DataFrame:
    """Voxels of an array: 2-D X,Y; 3-D X,Y,Z for object maps and X,Y,C for scalar maps; 4-D X,Y,Z,C."""
    a = np.asarray(array, float)
    if a.ndim == 2:
        a = a[:, :, None, None]
    elif a.ndim == 3:
        a = a[:, :, :, None] if image.startswith("O") else a[:, :, None, :]
    if a.ndim != 4:
        raise ValueError("an array of these dimensions is no image")
    if image.startswith("O") and a.shape[3] != 1:
        raise ValueError("an object map is one channel")
    at = np.argwhere(a != 0) if image.startswith("O") else np.argwhere(np.ones(a.shape, bool))
    frame = pd.DataFrame(at, columns=["x", "y", "z", "c"]).assign(image=image, value=a[tuple(at.T)])
    frame["c"] += 1
    return spark.createDataFrame(frame[["image", "x", "y", "z", "c", "value"]], "image string, x long, y long, z long, c int, value double")


def voxel_array(voxels: DataFrame, shape: Sequence[int], value: str = "value") -> np.ndarray:
    """A dense array of one image, for files and figures."""
    out = np.zeros(tuple(shape))
    rows = voxels.select("x", "y", "z", value).toPandas()
    out[rows["x"], rows["y"], rows["z"]] = rows[value]
    return out
