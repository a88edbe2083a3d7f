"""The 48 tokens of a grid as a dimension table, built by rule, and grid geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a grid, cells in the order y, z, x.
SX, SY, SZ = 16, 6, 16
CELLS, LAYER = SX * SY * SZ, SX * SZ
#: Directions N, S, W, E, up, down; their opposites.
NAMES = ("north", "south", "west", "east", "up", "down")
OPPOSITE = (1, 0, 3, 2, 5, 4)
#: First token of each kind.
AIR, SOLID, WIRE, TORCH, REPEATER, COMPARATOR, LEVER, LAMP, TARGET, OBSERVER, CONTROL = 0, 1, 2, 3, 8, 24, 32, 36, 37, 38, 44
#: Glyphs of kinds.
GLYPHS = {"air": ".", "solid": "#", "wire": "d", "torch": "t", "repeater": ">", "comparator": "c", "lever": "V", "lamp": "L", "target": "T", "observer": "o", "pad": "_", "bos": "^", "eos": "$", "mask": "?"}

SCHEMA = "token int, kind string, attach int, facing int, delay int, mode int, glyph string, state string, opaque boolean, conductive boolean, excluded boolean, control boolean, connect_mask int"


def _rows() -> list[tuple]:
    out = []

    def add(kind: str, state: str | None, attach=None, facing=None, delay=None, mode=None, mask=0) -> None:
        opaque = kind in ("solid", "lamp", "target", "observer")
        conductive = kind in ("solid", "lamp", "target")
        control = kind in ("pad", "bos", "eos", "mask")
        out.append((len(out), kind, attach, facing, delay, mode, GLYPHS[kind], state, opaque, conductive, kind == "observer", control, mask))

    def axis(facing: int) -> int:
        return 0b0011 if facing < 2 else 0b1100

    add("air", "minecraft:air")
    add("solid", "minecraft:stone")
    add("wire", "minecraft:redstone_wire[power=0]", mask=15)
    add("torch", "minecraft:redstone_torch[lit=true]", attach=0, mask=15)
    for d in range(4):
        add("torch", f"minecraft:redstone_wall_torch[facing={NAMES[OPPOSITE[d]]},lit=true]", attach=d + 1, mask=15)
    for d in range(4):
        for t in range(1, 5):
            add("repeater", f"minecraft:repeater[facing={NAMES[OPPOSITE[d]]},delay={t},locked=false,powered=false]", facing=d, delay=t, mask=axis(d))
    for d in range(4):
        for m, name in enumerate(("compare", "subtract")):
            add("comparator", f"minecraft:comparator[facing={NAMES[OPPOSITE[d]]},mode={name},powered=false]", facing=d, mode=m, mask=axis(d))
    for d in range(4):
        add("lever", f"minecraft:lever[face=wall,facing={NAMES[OPPOSITE[d]]},powered=false]", attach=d + 1, mask=15)
    add("lamp", "minecraft:redstone_lamp[lit=false]")
    add("target", "minecraft:target[power=0]")
    for d in range(6):
        add("observer", f"minecraft:observer[facing={NAMES[d]},powered=false]", facing=d)
    for kind in ("pad", "bos", "eos", "mask"):
        add(kind, None)
    return out


ROWS = _rows()


def vocabulary(spark: SparkSession) -> DataFrame:
    """The token table; 48 rows, so every join with it may broadcast it."""
    return spark.createDataFrame(ROWS, SCHEMA)


#: How a viewer shows each kind: glyph, foreground, background. Control tokens are shown as air.
DISPLAY = (
    ("air", " ", "#3A424C", "#12161B"), ("solid", " ", "#8894A2", "#39424E"), ("wire", "·", "#F0392C", "#5A1A17"), ("torch", "◆", "#F0392C", "#40130F"),
    ("repeater", "▶", "#5FB3C4", "#2C333C"), ("comparator", "◆", "#E0A82E", "#2C333C"), ("lever", "⌐", "#DDE4EB", "#2C333C"), ("lamp", "◍", "#221A05", "#F5C542"),
    ("target", "◎", "#A9B4C0", "#3A3040"), ("observer", "◇", "#77828F", "#2A313A"),
)


def display(spark: SparkSession) -> DataFrame:
    """shown (a kind), display_glyph, foreground, background."""
    return spark.createDataFrame(list(DISPLAY), "shown string, display_glyph string, foreground string, background string")


def lookup(column: str, token: Column) -> Column:
    """A property of a token inside higher-order functions, where a join can't run: a literal array by token."""
    k = [c.split()[0] for c in SCHEMA.split(", ")].index(column)
    return F.get(F.array(*[F.lit(r[k]) for r in ROWS]), token)


def index(x: Column, y: Column, z: Column) -> Column:
    return (y * SZ + z) * SX + x


def place(i: Column) -> Column:
    """x, y, z of a flat index."""
    return F.struct((i % SX).alias("x"), F.floor(i / LAYER).cast("int").alias("y"), (F.floor(i / SX).cast("int") % SZ).alias("z"))


def inside(x: Column, y: Column, z: Column) -> Column:
    return x.between(0, SX - 1) & y.between(0, SY - 1) & z.between(0, SZ - 1)


def legal_at(token: Column, y: Column) -> Column:
    """Whether a token may stand in a layer at all: no control, no observer, and in the lowest only air and solid."""
    return ~lookup("control", token) & ~lookup("excluded", token) & ((y > 0) | token.isin(AIR, SOLID))
