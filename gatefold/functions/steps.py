"""Small arithmetic of circuits and training as columns: tokens from their parts, places, signals, ticks, schedules, sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatefold.vocab import AIR, CELLS, COMPARATOR, LAMP, LAYER, LEVER, OBSERVER, REPEATER, SOLID, TARGET, TORCH, WIRE, inside, lookup

#: Size of the block vocabulary, by which prefix tokens are moved in a sequence.
VOCAB_SIZE = 48


def token_of(kind: Column, attach: Column, facing: Column, delay: Column, mode: Column) -> Column:
    """The token of a block from its parts; delays outside 1 to 4 are taken to the nearest."""
    plain = {"air": AIR, "solid": SOLID, "wire": WIRE, "lamp": LAMP, "target": TARGET}
    out = F.lit(None).cast("int")
    for name, token in plain.items():
        out = F.when(kind == name, token).otherwise(out)
    return (
        F.when(kind == "torch", TORCH + attach).when(kind == "repeater", REPEATER + facing * 4 + F.least(F.greatest(delay, F.lit(1)), F.lit(4)) - 1).when(kind == "comparator", COMPARATOR + facing * 2 + mode)
        .when(kind == "lever", LEVER + attach - 1).when(kind == "observer", OBSERVER + facing).otherwise(out)
    )


def manhattan(a: Column, b: Column) -> Column:
    return F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]) + F.abs(a["z"] - b["z"])


def adjacent(a: Column, b: Column) -> Column:
    return manhattan(a, b) == 1


def moved(a: Column, by: Column) -> Column:
    """The place ``by`` further, or null outside the grid."""
    x, y, z = (a[k] + by[k] for k in "xyz")
    return F.when(inside(x, y, z), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def compared(rear: Column, left: Column, right: Column, subtract: Column) -> Column:
    """A comparator's output: what is behind it, less the stronger side or only if that is no stronger."""
    side = F.greatest(left, right)
    return F.when(subtract, F.greatest(rear - side, F.lit(0))).otherwise(F.when(rear >= side, rear).otherwise(0))


def redstone_ticks(game_ticks: Column) -> Column:
    """Two game ticks are one; halves round up."""
    return F.ceil(game_ticks / 2).cast("int")


def learning_rate(step: Column, total: Column, warmup: Column, peak: Column, floor: float = 0.1) -> Column:
    """Linear up to the peak over the warm-up, then half a cosine down to a share of it."""
    done = F.least((step - warmup) / F.greatest(total - warmup, F.lit(1)), F.lit(1.0))
    return F.when(step < warmup, peak * (step + 1) / F.greatest(warmup, F.lit(1))).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.pi() * done))))


def sequence(prefix: Column, grid: Column) -> Column:
    """The training sequence: the prefix's tokens beyond the blocks', then the grid's."""
    return F.concat(F.transform(prefix, lambda t: t + VOCAB_SIZE), grid)


def layer(grid: Column, y: Column) -> Column:
    return F.slice(grid, y * LAYER + 1, LAYER)


def found(grid: Column, kind: str) -> Column:
    """Flat indices of the blocks of a kind, in order."""
    return F.filter(F.sequence(F.lit(0), F.size(grid) - 1), lambda i: lookup("kind", F.get(grid, i)) == kind)


def parameters(vocab: Column, width: Column, layers: Column, inner: Column, cells: int = CELLS) -> Column:
    """About how many numbers a transformer over the cells has: embeddings of tokens and places, four square matrices and
    three of the inner width in each layer, the output."""
    return vocab * width + cells * width + layers * (4 * width * width + 3 * width * inner) + width * vocab
