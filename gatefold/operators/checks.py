"""Validation of grids and verdicts in column expressions: no Python runs on a grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatefold.vocab import CELLS, CONTROL, LAMP, LAYER, LEVER, OBSERVER, REPEATER, SX, SZ, TORCH, WIRE, lookup


def _at(grid: Column, x: Column, y: Column, z: Column) -> Column:
    """The token of a cell; outside it reads as air."""
    fits = x.between(0, SX - 1) & (y >= 0) & z.between(0, SZ - 1)
    return F.when(fits, F.get(grid, (y * SZ + z) * SX + x)).otherwise(F.lit(0))


def control_cell(grid: Column) -> Column:
    """The first cell that holds no block, or null."""
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.get(grid, i) >= CONTROL), F.lit(0))


def structural_fault(grid: Column, input_z: Column, output_z: Column) -> Column:
    """The first fault in raster order, then missing inputs, then missing outputs: (reason, cell), or null."""
    #: by attachment: floor, N, S, W, E
    dx, dy, dz = (F.array(*map(F.lit, d)) for d in ((0, 0, 0, -1, 1), (-1, 0, 0, 0, 0), (0, -1, 1, 0, 0)))

    def fault(i: Column) -> Column:
        t = F.get(grid, i)
        x, y, z = i % SX, F.floor(i / LAYER).cast("int"), F.floor(i / SX).cast("int") % SZ
        below = _at(grid, x, y - 1, z)
        a = lookup("attach", t)
        support = lookup("conductive", _at(grid, x + F.get(dx, a), y + F.get(dy, a), z + F.get(dz, a)))
        input_port = (x == 0) & (y == 1) & F.array_contains(input_z, z)
        output_port = (x == SX - 1) & (y == 1) & F.array_contains(output_z, z)
        return (
            F.when((t == WIRE) & ~lookup("opaque", below), "floating_dust")
            .when(t.between(TORCH, REPEATER - 1) & ~support, "unsupported")
            .when(t.between(LEVER, LAMP - 1) & ~support, "unsupported")
            .when(t.between(LEVER, LAMP - 1) & ~input_port, "port_violation")
            .when(t.between(REPEATER, LEVER - 1) & ~lookup("opaque", below), "unsupported")
            .when((t == LAMP) & ~output_port, "port_violation")
            .when(t.between(OBSERVER, CONTROL - 1), "excluded_block")
        )

    cells = F.filter(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.struct(fault(i).alias("reason"), i.alias("cell"))), lambda s: s["reason"].isNotNull())

    def missing(rows: Column, x: int, least: int, most: int) -> Column:
        places = F.transform(rows, lambda z: (SZ + z) * SX + x)
        return F.transform(F.filter(places, lambda i: ~F.get(grid, i).between(least, most)), lambda i: F.struct(F.lit("port_violation").alias("reason"), i.alias("cell")))

    return F.get(F.concat(cells, missing(input_z, 0, LEVER, LAMP - 1), missing(output_z, SX - 1, LAMP, LAMP)), F.lit(0))


def constraint_fault(latency: Column, blocks: Column, box_x: Column, box_z: Column, max_latency: Column, max_blocks: Column, region_x: Column, region_z: Column) -> Column:
    """The first constraint that is violated: latency, then blocks, then region; null if none is."""
    return F.when(latency > max_latency, "latency").when(blocks > max_blocks, "blocks").when((box_x > region_x) | (box_z > region_z), "region")


def mismatches(observed: Column, expected: Column) -> Column:
    """(inputs, observed, expected) of each row of a truth table that is wrong."""
    return F.filter(F.zip_with(F.transform(observed, lambda v, m: F.struct(m.alias("m"), v.alias("v"))), expected, lambda o, e: F.struct(o["m"].alias("inputs"), o["v"].alias("observed"), e.alias("expected"))), lambda s: s["observed"] != s["expected"])


def rebuilt(expected: Column, wrong: Column) -> Column:
    """The observed rows of a truth table: the expected ones with the mismatches written over them."""

    def row(e: Column, m: Column) -> Column:
        own = F.get(F.filter(wrong, lambda s: s["inputs"] == m), F.lit(0))
        return F.when(own.isNull(), e).otherwise(own["observed"])

    return F.transform(expected, row)


def verdict_text(kind: Column, latency: Column, blocks: Column, box: Column, n_wrong: Column, constraint: Column, period: Column, reason: Column) -> Column:
    size = F.format_string("(%d, %d, %d)", box["x"], box["y"], box["z"])
    return (
        F.when(kind == "pass", F.format_string("PASS latency=%drt blocks=%d bbox=%s", latency, blocks, size))
        .when(kind == "unstable", F.format_string("UNSTABLE period=%dgt", period))
        .when(kind == "malformed", F.concat(F.lit("MALFORMED "), reason))
        .otherwise(F.concat(F.lit("FAIL "), n_wrong.cast("string"), F.lit(" row(s)"), F.coalesce(F.concat(F.lit(" + constraint "), constraint), F.lit(""))))
    )


def divergence_class(observed: Column, settled: Column, grid: Column) -> Column:
    """Which known difference a disagreement points at: unobserved, unsettled, a solid block between two wires, torches."""
    flanked = F.exists(F.sequence(F.lit(LAYER), F.lit(2 * LAYER - 1)), lambda i: (i % SX).between(1, SX - 2) & (F.get(grid, i) == 1) & (F.get(grid, i - 1) == WIRE) & (F.get(grid, i + 1) == WIRE))
    torch = F.exists(grid, lambda t: t.between(TORCH, REPEATER - 1))
    return F.when(observed.isNull(), "unclassified").when(~settled, "update-order").when(flanked, "weak-vs-strong-power").when(torch, "torch-burnout").otherwise("unclassified")
