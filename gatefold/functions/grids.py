"""Grids as arrays of tokens, in the order y, z, x: counts, boxes, layers, differences, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatefold.vocab import CELLS, LAYER, SX, SY, SZ, lookup


def _seq(a: int, b: int) -> Column:
    return F.sequence(F.lit(a), F.lit(b))


def substrate() -> Column:
    """A layer of solid under air."""
    return F.concat(F.array_repeat(F.lit(1), LAYER), F.array_repeat(F.lit(0), CELLS - LAYER))


def with_cells(grid: Column, cells: Column) -> Column:
    """The grid with the cells of a map (flat index -> token) in place."""
    return F.transform(grid, lambda t, i: F.coalesce(F.try_element_at(cells, i), t))


def material_blocks(grid: Column) -> Column:
    """Cells that aren't air above the substrate."""
    return F.size(F.filter(F.slice(grid, LAYER + 1, CELLS - LAYER), lambda t: t != 0))


def bounding_box(grid: Column) -> Column:
    """Extent by axis above the substrate; zeros if nothing is there."""
    used = F.filter(_seq(LAYER, CELLS - 1), lambda i: F.get(grid, i) != 0)

    def extent(f) -> Column:
        v = F.transform(used, f)
        return F.coalesce(F.array_max(v) - F.array_min(v) + 1, F.lit(0)).cast("int")

    return F.struct(extent(lambda i: i % SX).alias("x"), extent(lambda i: F.floor(i / LAYER)).alias("y"), extent(lambda i: F.floor(i / SX) % SZ).alias("z"))


def occupied_layers(grid: Column) -> Column:
    return F.filter(_seq(0, SY - 1), lambda y: F.exists(F.slice(grid, y * LAYER + 1, LAYER), lambda t: t != 0))


def edit_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, d: s + d)


def differing_cells(a: Column, b: Column) -> Column:
    return F.filter(_seq(0, CELLS - 1), lambda i: F.get(a, i) != F.get(b, i))


def layer_text(grid: Column, y: Column) -> Column:
    """16 lines of 16 glyphs."""
    cells = F.slice(grid, y * LAYER + 1, LAYER)
    return F.concat_ws("\n", F.transform(_seq(0, SZ - 1), lambda z: F.concat_ws("", F.transform(F.slice(cells, z * SX + 1, SX), lambda t: lookup("glyph", t)))))


def render(grid: Column) -> Column:
    """Every occupied layer above the substrate under a heading."""
    return F.concat_ws("\n", F.transform(F.filter(occupied_layers(grid), lambda y: y > 0), lambda y: F.concat(F.lit("-- y="), y.cast("string"), F.lit("\n"), layer_text(grid, y))))


def port_cells(input_z: Column, output_z: Column) -> Column:
    """Cells that the ports fix: a lever on a solid block at each input, a lamp at each output."""
    def entry(x: int, y: int, token: int):
        return lambda z: F.struct(((y * SZ + z) * SX + x).alias("k"), F.lit(token).alias("v"))

    return F.map_from_entries(F.concat(F.transform(input_z, entry(0, 1, 35)), F.transform(input_z, entry(1, 1, 1)), F.transform(output_z, entry(15, 1, 36))))
