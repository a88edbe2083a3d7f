"""Grids as schematics, to and from binary columns, in two formats: Sponge version 2, whose cells are variable-length
numbers, and Litematica version 6, whose cells have a fixed number of bits and may straddle 64-bit words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gatefold.sources import nbt
from gatefold.sources.nbt import BYTES, COMPOUND, INT, INTS, LIST, LONG, LONGS, SHORT, STRING
from gatefold.vocab import CELLS, LAYER, ROWS, SX, SY, SZ

#: Versions of the formats and of the data.
VERSION, DATA_VERSION, LITEMATIC_VERSION = 2, 3465, 6
#: Cells on an edge that a reader takes.
MOST = 64
STATES = [r[7] for r in ROWS]
AUTHOR = "gatefold"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def palette(tokens: bytes) -> tuple[list[int], np.ndarray]:
    """Tokens as they first appear, air always first, and the number of each cell's."""
    if len(tokens) != CELLS:
        raise ValueError(f"a grid has {len(tokens)} cells")
    own = np.frombuffer(tokens, np.uint8)
    if int(own.max()) >= len(STATES) or STATES[int(own.max())] is None:
        raise ValueError(f"token {int(own.max())} is no block")
    values, first = np.unique(own, return_index=True)
    order = [0, *(int(t) for t in values[np.argsort(first)] if t)]
    number = np.zeros(256, np.int64)
    number[order] = np.arange(len(order))
    return order, number[own]


def to_schem(tokens: bytes, name: str = "") -> bytes:
    """The whole volume; air is 0 in the palette, other states are numbered as they first appear; bytes are reproducible."""
    order, cells = palette(tokens)
    root = {
        "Version": (INT, VERSION), "DataVersion": (INT, DATA_VERSION), "Width": (SHORT, SX), "Height": (SHORT, SY), "Length": (SHORT, SZ), "Offset": (INTS, [0, 0, 0]),
        "PaletteMax": (INT, len(order)), "Palette": (COMPOUND, {STATES[t]: (INT, k) for k, t in enumerate(order)}), "BlockData": (BYTES, b"".join(map(varint, cells.tolist()))), "BlockEntities": (LIST, (COMPOUND, [])),
        "Metadata": (COMPOUND, {"Name": (STRING, name), "Author": (STRING, AUTHOR), **{f"WEOffset{c}": (INT, 0) for c in "XYZ"}}),
    }
    return nbt.encode(root, "Schematic")


def _volume(*edges: int) -> int:
    if not all(1 <= x <= MOST for x in edges):
        raise ValueError(f"a volume of {edges}")
    return int(np.prod(edges))


def _named(numbers: np.ndarray, states: dict[int, str]) -> list[str]:
    try:
        return [states[k] for k in numbers.tolist()]
    except KeyError as e:
        raise ValueError(f"no state has number {e.args[0]}") from e


def from_schem(blob: bytes) -> tuple[int, int, int, list[str]]:
    """Width, height, length and the states of all cells; other versions, sizes, palettes and volumes raise ValueError."""
    root = nbt.decode(blob)
    if root.get("Version") != VERSION:
        raise ValueError(f"version {root.get('Version')}")
    size = root["Width"], root["Height"], root["Length"]
    n = _volume(*size)
    states = {k: s for s, k in root["Palette"].items()}
    if len(states) != len(root["Palette"]):
        raise ValueError("two states have one number")
    data = np.frombuffer(root["BlockData"], np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    if len(ends) != n or ends[-1] != len(data) - 1:
        raise ValueError("the volume doesn't match")
    if int((ends - starts).max()) > 4:
        raise ValueError("a number is too long")
    shift = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    numbers = np.add.reduceat((data & 127).astype(np.int64) << (7 * shift), starts)
    return *size, _named(numbers, states)


def packed(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits one after the other, the lowest bit first, in 64-bit words; a number may reach into the next word."""
    flat = (numbers[:, None] >> np.arange(bits)) & 1
    flat = np.concatenate((flat.ravel(), np.zeros(-flat.size % 64, np.int64)))
    return np.packbits(flat.astype(np.uint8), bitorder="little").view("<i8").astype(np.int64)


def unpacked(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    flat = np.unpackbits(words.astype("<i8").view(np.uint8), bitorder="little")
    if len(flat) < n * bits or len(flat) - n * bits >= 64:
        raise ValueError("the volume doesn't match")
    return flat[: n * bits].reshape(n, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def width(states: int) -> int:
    """Bits of a cell for so many states, two at least."""
    return max(2, (states - 1).bit_length())


def to_litematic(tokens: bytes, name: str = "") -> bytes:
    """The whole volume as one region of that name; bytes are reproducible."""
    order, cells = palette(tokens)
    edges = (COMPOUND, {c: (INT, n) for c, n in (("x", SX), ("y", SY), ("z", SZ))})
    region = {
        "Position": (COMPOUND, {c: (INT, 0) for c in "xyz"}), "Size": edges, "BlockStatePalette": (LIST, (COMPOUND, [{"Name": (STRING, STATES[t])} for t in order])), "BlockStates": (LONGS, packed(cells, width(len(order)))),
        **{c: (LIST, (COMPOUND, [])) for c in ("TileEntities", "Entities", "PendingBlockTicks", "PendingFluidTicks")},
    }
    about = {
        "Name": (STRING, name), "Author": (STRING, AUTHOR), "Description": (STRING, ""), "RegionCount": (INT, 1), "TotalVolume": (INT, CELLS), "TotalBlocks": (INT, int(np.count_nonzero(cells[LAYER:]))),
        "TimeCreated": (LONG, 0), "TimeModified": (LONG, 0), "EnclosingSize": edges,
    }
    return nbt.encode({"MinecraftDataVersion": (INT, DATA_VERSION), "Version": (INT, LITEMATIC_VERSION), "Metadata": (COMPOUND, about), "Regions": (COMPOUND, {name: (COMPOUND, region)})}, "")


def from_litematic(blob: bytes) -> tuple[int, int, int, list[str]]:
    """Width, height, length and the states of all cells of a file of one region; all else raises ValueError."""
    root = nbt.decode(blob)
    if root.get("Version") != LITEMATIC_VERSION or len(root.get("Regions", {})) != 1:
        raise ValueError("another version, or not one region")
    (region,) = root["Regions"].values()
    size = tuple(region["Size"][c] for c in "xyz")
    states = [x["Name"] for x in region["BlockStatePalette"]]
    if not states or len(set(states)) != len(states):
        raise ValueError("two states have one name, or there is none")
    return *size, _named(unpacked(region["BlockStates"], width(len(states)), _volume(*size)), dict(enumerate(states)))


#: By name of the format: suffix of its files, writer, reader.
FORMATS: dict[str, tuple[str, Callable, Callable]] = {"schem": (".schem", to_schem, from_schem), "litematic": (".litematic", to_litematic, from_litematic)}


def with_schematic(df: DataFrame, tokens: str, out: str = "schematic", form: str = "schem") -> DataFrame:
    """``df`` with the schematic of each binary grid; a null grid has none."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    write = FORMATS[form][1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = batch.column(batch.schema.get_field_index(tokens)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x and write(x) for x in grids], pa.binary())], schema.names)

    return df.mapInArrow(work, schema)
