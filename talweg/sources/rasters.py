"""GeoTIFF files: a data source that reads the tiles of a window by byte ranges, and a writer.

spark.read.format("geotiff").option("box", "[w, s, e, n]").load(path): rows (path, row, col, x, y, z) of the valid cells, a
partition for each group of tiles (or strips); only their bytes and the header are read, by file or by HTTP. The window is
an option and no pushed condition: Spark 4.1 keeps what was pushed with the relation, and the next query on the same
DataFrame would get its tiles. Uncompressed and deflated files with predictors 1 to 3 are understood, plain and BigTIFF; others are errors.
"""

from __future__ import annotations

import dataclasses
import http.client
import json
import struct
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import checkpointed, ship
from .http import AGENT

# TIFF field types and tags.
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, ROWS, PREDICTOR, FORMAT = 256, 257, 258, 259, 277, 278, 317, 339
STRIPS, STRIP_BYTES, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 273, 279, 322, 323, 324, 325
COLOURS, SCALE, TIE, GEO_KEYS, NODATA = 320, 33550, 33922, 34735, 42113


#: The file of the last server that answered a range with all of it, so that it is fetched once a worker and not once a block.
_whole: dict[str, bytes] = {}
WHOLE_MOST = 1 << 29


def fetched_range(path: str, offset: int, length: int) -> bytes:
    if path in _whole:
        return _whole[path][offset : offset + length]
    asked = urllib.request.Request(path, headers={"Range": f"bytes={offset}-{offset + length - 1}", "User-Agent": AGENT})
    with urllib.request.urlopen(asked, timeout=60) as answer:
        if answer.status != 200:
            return answer.read(length)
        data = answer.read(WHOLE_MOST + 1)
    if len(data) > WHOLE_MOST:
        raise ValueError(f"{path}: the server ignores ranges and the file has more than {WHOLE_MOST} bytes")
    _whole.clear()
    _whole[path] = data
    return data[offset : offset + length]


def read_range(path: str, offset: int, length: int, attempts: int = 3, pause: float = 1.0) -> bytes:
    """Bytes of a file or of an HTTP address; fewer at its end. A request that fails is made again after a growing pause, unless the address is unknown."""
    if path.startswith(("http://", "https://")):
        for attempt in range(attempts):
            try:
                return fetched_range(path, offset, length)
            except urllib.error.HTTPError as e:
                if e.code in (401, 403, 404, 410, 416) or attempt + 1 == attempts:
                    raise
            except (OSError, http.client.HTTPException):
                if attempt + 1 == attempts:
                    raise
            time.sleep(pause * 2**attempt)
    fs, where = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with fs.open_input_file(where) as f:
        return f.read_at(min(length, max(0, f.size() - offset)), offset)


@dataclasses.dataclass(frozen=True)
class Layout:
    """What the header of a file says: sizes, blocks, georeference."""

    width: int
    height: int
    block_width: int
    block_height: int
    offsets: tuple[int, ...]
    lengths: tuple[int, ...]
    kind: str
    samples: int
    compression: int
    predictor: int
    x0: float
    y1: float
    dx: float
    dy: float
    nodata: float | None
    epsg: int | None
    colours: tuple[int, ...]

    def across(self) -> int:
        return -(-self.width // self.block_width)

    def blocks(self, box: list[float] | None) -> list[int]:
        """The blocks that meet a box; all without one."""
        r0, r1, c0, c1 = self.window(box)
        return [i for i in range(len(self.offsets)) if self.lengths[i] and (i // self.across()) * self.block_height < r1 and (i // self.across() + 1) * self.block_height > r0 and (i % self.across()) * self.block_width < c1 and (i % self.across() + 1) * self.block_width > c0]

    def window(self, box: list[float] | None) -> tuple[int, int, int, int]:
        """First and last row and column (exclusive) of a box, kept within the grid."""
        if box is None:
            return 0, self.height, 0, self.width
        w, s, e, n = box
        clamp = lambda v, top: int(min(top, max(0, v)))
        return clamp(np.floor((self.y1 - n) / self.dy), self.height), clamp(np.ceil((self.y1 - s) / self.dy), self.height), clamp(np.floor((w - self.x0) / self.dx), self.width), clamp(np.ceil((e - self.x0) / self.dx), self.width)


def layout(path: str, ahead: int = 65_536) -> Layout:
    head = read_range(path, 0, ahead)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    big = order and struct.unpack_from(order + "H", head, 2)[0] == 43
    if not order or (not big and struct.unpack_from(order + "H", head, 2)[0] != 42):
        raise ValueError(f"{path} is no TIFF file")
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    get = lambda offset, length: head[offset : offset + length] if offset + length <= len(head) else read_range(path, offset, length)
    n = struct.unpack(order + ("Q" if big else "H"), get(at, 8 if big else 2))[0]
    width = 20 if big else 12
    entries, tags = get(at + (8 if big else 2), n * width), {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", entries, i * width)
        count = struct.unpack_from(order + ("Q" if big else "I"), entries, i * width + 4)[0]
        if kind not in SIZES or kind == 5:
            continue
        form = order + (f"{count}s" if kind == 2 else f"{count}{SIZES[kind]}")
        size, inline = struct.calcsize(form), i * width + (12 if big else 8)
        raw = entries[inline : inline + size] if size <= (8 if big else 4) else get(struct.unpack_from(order + ("Q" if big else "I"), entries, inline)[0], size)
        tags[tag] = struct.unpack(form, raw)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    tiled = TILES in tags
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0,) * 6)
    keys = tags.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), None)
    text = one(NODATA, b"").decode().strip("\0 ") if NODATA in tags else ""
    found = Layout(
        one(WIDTH), one(HEIGHT), one(TILE_WIDTH) if tiled else one(WIDTH), one(TILE_HEIGHT) if tiled else min(one(ROWS, one(HEIGHT)), one(HEIGHT)), tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES],
        order + {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS, 8) // 8), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], float(text) if text else None, epsg, tags.get(COLOURS, ()),
    )
    if found.compression not in (1, 8, 32946) or (found.samples > 1 and one(284, 1) != 1):
        raise ValueError(f"{path}: compression {found.compression} or its planes are not understood")
    return found


def unpack(data: bytes, a: Layout, band: int = 0) -> np.ndarray:
    """A band of a block, in rows and columns."""
    raw = zlib.decompress(data) if a.compression != 1 else data
    kind = np.dtype(a.kind)
    rows = len(raw) // (a.block_width * a.samples * kind.itemsize)
    if a.predictor == 3:
        planes = np.frombuffer(raw, np.uint8).reshape(rows, -1).copy()
        for c in range(a.samples, planes.shape[1]):
            planes[:, c] += planes[:, c - a.samples]
        z = planes.reshape(rows, kind.itemsize, -1).transpose(0, 2, 1).copy().view(kind.newbyteorder(">"))[..., 0]
        return z.reshape(rows, a.block_width, a.samples)[:, :, band]
    z = np.frombuffer(raw, kind).reshape(rows, a.block_width, a.samples)
    if a.predictor == 2:
        whole = np.dtype(f"{a.kind[0]}u{kind.itemsize}")
        z = np.cumsum(z.view(whole), axis=1, dtype=whole.newbyteorder("=")).view(kind.newbyteorder("="))
    return z[:, :, band]


class TilePartition(InputPartition):
    def __init__(self, path: str, blocks: list[int]) -> None:
        self.path, self.blocks = path, blocks


class TiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.box, self.group = json.loads(options.get("box", "null")), int(options.get("tiles", 16))
        self.band = int(options.get("band", 0))

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            blocks = layout(path).blocks(self.box)
            found += [TilePartition(path, blocks[i : i + self.group]) for i in range(0, len(blocks), self.group)]
        return found or [TilePartition("", [])]

    def read(self, partition: TilePartition) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        a = layout(partition.path)
        r0, r1, c0, c1 = a.window(self.box)
        for i in partition.blocks:
            z = unpack(read_range(partition.path, a.offsets[i], a.lengths[i]), a, self.band)
            row, col = np.indices(z.shape)
            row, col, z = row.ravel() + i // a.across() * a.block_height, col.ravel() + i % a.across() * a.block_width, z.ravel().astype(float)
            keep = (row >= r0) & (row < r1) & (col >= c0) & (col < c1) & np.isfinite(z) & (z != (np.nan if a.nodata is None else a.nodata))
            row, col, z = row[keep], col[keep], z[keep]
            yield pa.RecordBatch.from_pydict({"path": pa.array([partition.path] * len(z), pa.string()), "row": pa.array(row, pa.int32()), "col": pa.array(col, pa.int32()), "x": a.x0 + (col + 0.5) * a.dx, "y": a.y1 - (row + 0.5) * a.dy, "z": z})


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "path string, row int, col int, x double, y double, z double"

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(self.options)


def read(spark: SparkSession, paths: list[str], box: tuple[float, float, float, float] | None = None, band: int = 0) -> DataFrame:
    """The valid cells of a band of files within a box in their own coordinates."""
    ship(spark).dataSource.register(TiffSource)
    asked = spark.read.format("geotiff").option("paths", json.dumps(paths)).option("band", band)
    return (asked.option("box", json.dumps(list(box))) if box else asked).load()


def header(width: int, height: int, tile: int, lengths: list[int], kind: str, x0: float, y1: float, cell: float, epsg: int, nodata: float, colours: dict[int, tuple[int, int, int]] | None, bands: int = 1) -> bytes:
    """The header of a tiled, deflated file whose tiles follow it in order."""
    form = np.dtype(kind)
    sample = {"u": 1, "i": 2, "f": 3}[form.kind]
    model = (1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    fields: list[tuple[int, int, bytes]] = [
        (WIDTH, 4, struct.pack("<I", width)), (HEIGHT, 4, struct.pack("<I", height)), (BITS, 3, struct.pack(f"<{bands}H", *[form.itemsize * 8] * bands)), (COMPRESSION, 3, struct.pack("<H", 8)), (262, 3, struct.pack("<H", 3 if colours else 2 if bands == 3 else 1)), (SAMPLES, 3, struct.pack("<H", bands)),
        (PREDICTOR, 3, struct.pack("<H", 1 if colours else 2)), (TILE_WIDTH, 3, struct.pack("<H", tile)), (TILE_HEIGHT, 3, struct.pack("<H", tile)), (TILES, 16, b"\0" * 8 * len(lengths)), (TILE_BYTES, 4, struct.pack(f"<{len(lengths)}I", *lengths)), (FORMAT, 3, struct.pack(f"<{bands}H", *[sample] * bands)),
        (SCALE, 12, struct.pack("<3d", cell, cell, 0)), (TIE, 12, struct.pack("<6d", 0, 0, 0, x0, y1, 0)), (GEO_KEYS, 3, struct.pack("<16H", *model)), (NODATA, 2, f"{nodata:g}".encode() + b"\0"),
    ]
    if colours:
        fields.append((COLOURS, 3, struct.pack("<768H", *[257 * colours.get(i, (0, 0, 0))[k] for k in range(3) for i in range(256)])))
    fields.sort()
    start = 16 + 8 + 20 * len(fields) + 8
    total = start + sum(len(v) for _, _, v in fields if len(v) > 8)
    offsets = struct.pack(f"<{len(lengths)}Q", *[total + int(v) for v in np.cumsum([0, *lengths[:-1]])])
    entries, rest = b"", b""
    for tag, kind_, value in fields:
        value = offsets if tag == TILES else value
        count = len(value) // struct.calcsize("<" + ("s" if kind_ == 2 else SIZES[kind_]))
        inline = value.ljust(8, b"\0") if len(value) <= 8 else struct.pack("<Q", start + len(rest))
        entries += struct.pack("<HHQ", tag, kind_, count) + inline
        rest += value if len(value) > 8 else b""
    return struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(fields)) + entries + struct.pack("<Q", 0) + rest


def write(cells: DataFrame, path: str, width: int, height: int, x0: float, y1: float, cell: float, epsg: int, nodata: float = -9999.0, kind: str = "<f4", colours: dict[int, tuple[int, int, int]] | None = None, tile: int = 256, bands: tuple[str, ...] = ("z",)) -> str:
    """Cells (row, col and the columns of `bands`) as one file. Tiles are packed by tasks; one task strings them together, as a file has one end.

    Cells outside the grid are left out, places without a cell hold `nodata`, never 0. The file appears under its name only when
    it is whole.
    """
    across, down = -(-width // tile), -(-height // tile)
    form = np.dtype(kind)
    spark = ship(cells.sparkSession)

    def pack(z: np.ndarray) -> bytes:
        if not colours:
            whole = z.view(f"<u{form.itemsize}")
            z = np.concatenate([whole[:, :1], whole[:, 1:] - whole[:, :-1]], axis=1)
        return zlib.compress(z.tobytes(), 6)

    def packed(t: pa.Table) -> pa.Table:
        z = np.full((tile, tile, len(bands)), nodata, form)
        row, col = t.column("row").to_numpy(), t.column("col").to_numpy()
        z[row % tile, col % tile] = np.stack([t.column(b).to_numpy() for b in bands], axis=-1)
        return pa.table({"tile": pa.array([int(row[0] // tile * across + col[0] // tile)], pa.int64()), "data": pa.array([pack(z)], pa.binary())})

    inside = cells.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands])
    number = F.floor(F.col("row") / tile) * across + F.floor(F.col("col") / tile)
    full = checkpointed(inside.withColumn("tile", number).groupBy("tile").applyInArrow(lambda t: packed(t), "tile long, data binary"))
    sizes = dict(full.select("tile", F.octet_length("data")).collect())  # a number for each tile of 65,536 cells
    blank = pack(np.full((tile, tile, len(bands)), nodata, form))
    lengths = [sizes.get(i, len(blank)) for i in range(across * down)]
    head = header(width, height, tile, lengths, kind, x0, y1, cell, epsg, nodata, colours, len(bands))

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
        at = 0
        with fs.open_output_stream(f"{where}.part", compression=None) as out:
            out.write(head)
            for b in batches:
                for i, data in zip(b.column("tile").to_pylist(), b.column("data").to_pylist(), strict=True):
                    for _ in range(at, i):
                        out.write(blank)
                    out.write(data)
                    at = i + 1
        fs.move(f"{where}.part", where)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    end = spark.createDataFrame([(across * down, b"")], "tile long, data binary")  # after the last tile, so that blank ones before it are written
    full.unionByName(end).coalesce(1).sortWithinPartitions("tile").mapInArrow(string, "path string").collect()
    return path
