"""Specifications as truth tables: rows[m] has bit j set if output j is on under the inputs of m."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatefold.vocab import SZ

_MASK = 0xFFFFFFFF
#: FNV-1a 64-bit offset basis in two halves; its prime is 2**40 + 435.
_HIGH, _LOW = 3421674724, 2216829733


def _bit(x: Column | int, k: Column | int) -> Column:
    return F.call_function("shiftright", x if isinstance(x, Column) else F.lit(x), k if isinstance(k, Column) else F.lit(k)).bitwiseAND(F.lit(1))


def fnv(values: Column) -> Column:
    """16 hex digits of FNV-1a over longs from 0 to 2**32 - 1, each taken in as a whole.

    Products are taken in 32-bit halves, as a 64-bit one would overflow."""

    def step(acc: Column, b: Column) -> Column:
        x = acc["lo"].bitwiseXOR(b)
        lo = x * 435
        hi = acc["hi"] * 435 + x.bitwiseAND(F.lit(0xFFFFFF)) * 256 + F.shiftright(lo, 32)
        return F.struct(hi.bitwiseAND(F.lit(_MASK)).alias("hi"), lo.bitwiseAND(F.lit(_MASK)).alias("lo"))

    start = F.struct(F.lit(_HIGH).cast("long").alias("hi"), F.lit(_LOW).cast("long").alias("lo"))
    return F.aggregate(values, start, step, lambda a: F.lower(F.concat(F.lpad(F.hex(a["hi"]), 8, "0"), F.lpad(F.hex(a["lo"]), 8, "0"))))


def semantic_key(n_inputs: Column, n_outputs: Column, rows: Column) -> Column:
    """``fnv`` over input count, output count and each row's eight little-endian bytes."""
    unsigned = F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.call_function("shiftright", r, k * 8).bitwiseAND(F.lit(255)).cast("long"))))
    return fnv(F.concat(F.array(n_inputs.cast("long"), n_outputs.cast("long")), unsigned))


def world_fingerprint(states: Column) -> Column:
    """``fnv`` over the numbers of the states of all cells, in the order y, z, x: equal worlds have equal fingerprints."""
    return fnv(F.transform(states, lambda s: s.cast("long")))


def table_rows(number: Column, n: int) -> Column:
    """The rows of the one-output function of n inputs with this number: bit m is row m."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: _bit(number, m).cast("long"))


def constant(rows: Column) -> Column:
    return F.size(F.array_distinct(rows)) <= 1


def depends(rows: Column, k: Column) -> Column:
    """Whether turning input k changes some row."""
    return F.exists(F.sequence(F.lit(0), F.size(rows) - 1), lambda m: F.get(rows, m) != F.get(rows, m.bitwiseXOR(F.call_function("shiftleft", F.lit(1), k))))


def depends_on_all(rows: Column, n: Column | int) -> Column:
    return F.forall(F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - 1), lambda k: depends(rows, k))


def enumerate_functions(spark: SparkSession, n: int) -> DataFrame:
    """All non-constant functions of n inputs that depend on each."""
    df = spark.range(1 << (1 << n)).select(F.col("id").alias("tbl"), F.lit(n).alias("n_inputs"), table_rows(F.col("id"), n).alias("rows"))
    return df.filter(~constant(F.col("rows")) & depends_on_all(F.col("rows"), n))


def gray(k: Column) -> Column:
    return k.bitwiseXOR(F.shiftright(k, 1))


def restrict(rows: Column, kept: list[int]) -> Column:
    """Rows over some inputs, the others low. The last kept input is the fastest bit here."""
    parts = [(F.lit(len(kept) - 1 - at), F.lit(k)) for at, k in enumerate(kept)]

    def source(m: Column) -> Column:
        out = F.lit(0)
        for at, k in parts:
            out = out + F.call_function("shiftleft", F.call_function("shiftright", m, at).bitwiseAND(F.lit(1)), k)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit((1 << len(kept)) - 1)), lambda m: F.get(rows, source(m)))


def on_rows(rows: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda m: F.get(rows, m).bitwiseAND(F.lit(1)) == 1)


def sum_of_products(rows: Column, names: Column) -> Column:
    """The canonical sum of products; null if no row is on."""
    def term(m: Column) -> Column:
        return F.concat(F.lit("("), F.concat_ws(" & ", F.transform(names, lambda s, k: F.when(F.call_function("shiftright", m, k).bitwiseAND(F.lit(1)) == 1, s).otherwise(F.concat(F.lit("!"), s)))), F.lit(")"))

    ons = on_rows(rows)
    return F.when(F.size(ons) > 0, F.concat_ws(" | ", F.transform(ons, term)))


def default_rows(n: Column) -> Column:
    """Port rows when none are given: 7 for one port, else spread from 1 to 14; halves round to even."""
    return F.when(n == 1, F.array(F.lit(7))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.bround(1 + k * 13.0 / F.greatest(n - 1, F.lit(1)), 0).cast("int")))


def ports_valid(z: Column, n: Column) -> Column:
    """As many rows as ports, within the grid, and at least two apart."""
    s = F.array_sort(z)
    gaps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: a - b)
    return (F.size(z) == n) & F.forall(z, lambda v: v.between(0, SZ - 1)) & F.forall(gaps, lambda g: g >= 2)


#: Prefix markers, and the number that 0 is written as.
PREFIX_LEN, PREFIX = 32, {"pad": 0, "spec": 1, "nl": 2, "in": 3, "out": 4, "row": 5, "lat": 6, "blk": 7, "reg": 8, "end": 9}
NUMBER, MOST = 16, 63


def prefix_tokens(n_in: Column, n_out: Column, rows: Column, latency: Column, blocks: Column, region_x: Column, region_z: Column, slots: int = 0) -> Column:
    """The 32 tokens that state a specification: ports, constraints, as many rows as fit, an end, padding."""
    p = {k: F.lit(v) for k, v in PREFIX.items()}
    empty = F.array().cast("array<int>")
    head = F.array(p["spec"], *[p["nl"]] * slots, p["in"], NUMBER + n_in, p["out"], NUMBER + n_out)
    for value, mark in ((latency, "lat"), (blocks, "blk")):
        head = F.concat(head, F.when(value.isNotNull(), F.array(p[mark], NUMBER + F.least(value, F.lit(MOST)))).otherwise(empty))
    head = F.concat(head, F.when(region_x.isNotNull(), F.array(p["reg"], NUMBER + region_x, NUMBER + region_z)).otherwise(empty))
    fit = F.floor((PREFIX_LEN - 1 - F.size(head)) / 2).cast("int")  # a row is written while three places are left
    body = F.flatten(F.transform(F.slice(rows, 1, F.greatest(fit, F.lit(0))), lambda r: F.array(p["row"], (NUMBER + r.bitwiseAND(F.lit(MOST).cast("long"))).cast("int"))))
    return F.slice(F.concat(head, body, F.array(p["end"]), F.array_repeat(p["pad"], PREFIX_LEN)), 1, PREFIX_LEN)


_FOLD = str.maketrans({"¬": "!", "∧": "&", "∨": "|", "⊕": "^"})
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_SIGNS = {"not": "!", "and": "&", "or": "|", "xor": "^"}


def rule_column(rule: str, inputs: list[str], assignment: str = "assignment") -> Column:
    """A rule of the specification language over an int column of assignments: input k is bit k.

    Spark's own expression parser reads it: its precedence of &, ^ and | is the language's, ! is ~ with the lowest bit
    kept, and delay and strength stand for their first argument."""
    text = rule.translate(_FOLD)
    names = {w.lower() for w in _WORD.findall(text)} - {"delay", "strength", *_SIGNS}
    unknown = names - {i.lower() for i in inputs}
    if unknown:
        raise ValueError(f"unknown names: {', '.join(sorted(unknown))}")
    text = _WORD.sub(lambda w: _SIGNS.get(w[0].lower(), w[0]), text).replace("!", "~")
    while (cut := re.sub(r"\b(?:delay|strength)\s*\(((?:[^(),]|\([^()]*\))*),\s*\d+\s*\)", r"(\1)", text, flags=re.I)) != text:
        text = cut
    places = {name.lower(): k for k, name in enumerate(inputs)}
    text = _WORD.sub(lambda w: f"shiftright({assignment}, {places[w[0].lower()]})", text)
    return F.expr(f"(({text}) & 1)")


def truth_table(spark: SparkSession, inputs: list[str], rules: dict[str, str]) -> DataFrame:
    """m and outputs: all assignments of the inputs and the bit mask of the rules that hold."""
    df = spark.range(1 << len(inputs)).select(F.col("id").cast("int").alias("assignment"))
    value = F.lit(0)
    for j, rule in enumerate(rules.values()):
        value = value + F.shiftleft(rule_column(rule, inputs), j)
    return df.select(F.col("assignment").alias("m"), value.cast("long").alias("outputs"))


#: Names of functions by (inputs, rows).
NAMED = (
    (1, "01", "buffer"), (1, "10", "NOT gate"),
    (2, "0001", "AND gate"), (2, "0111", "OR gate"), (2, "1110", "NAND gate"), (2, "1000", "NOR gate"),
    (2, "0110", "XOR gate"), (2, "1001", "XNOR gate"), (2, "1011", "implication gate"),
    (3, "00000001", "three-input AND gate"), (3, "01111111", "three-input OR gate"), (3, "11111110", "three-input NAND gate"),
    (3, "10000000", "three-input NOR gate"), (3, "01101001", "three-input XOR gate"), (3, "00010111", "majority gate"),
)


def named(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NAMED), "n_inputs int, bits string, name string")
