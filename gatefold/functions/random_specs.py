"""Random specifications, drawn by hashes of a seed, so that a table of seeds is a table of specifications that can be repeated.

A specification is a random tree over its inputs: leaves are joined two by two by random operators until one is left, and
negations stand on random nodes, none of which has two. A draw that ignores an input, or has too few or too many gates, is
rejected and the next try of the seed drawn. All of it is column expressions; texts and truth tables grow side by side, so
that nothing is parsed or evaluated afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatefold.functions import specs
from gatefold.functions.once import once
from gatefold.functions.texts import constraint_lines, source
from gatefold.sources import shared

#: Names of inputs, signs of the operators.
NAMES = ("A", "B", "C", "D", "E", "F")
SIGNS = {"and": "∧", "or": "∨", "xor": "⊕"}
NOT = "¬"
#: Tries of a seed before sampling fails; the ends of the rounds in which they are drawn.
TRIES = (4, 16, 64, 200)


@dataclass(frozen=True)
class Config:
    """Ranges of gates and inputs, operators to draw from, the share of specifications with a constraint."""

    min_gates: int = 1
    max_gates: int = 6
    min_inputs: int = 1
    max_inputs: int = 4
    gate_set: tuple[str, ...] = ("and", "or", "xor")
    constraint_rate: float = 0.15

    def __post_init__(self) -> None:
        if not 1 <= self.min_inputs <= self.max_inputs <= len(NAMES) or self.max_gates < max(self.min_gates, self.max_inputs - 1):
            raise ValueError("a range that no specification fits")


def drawn(seed: Column, *label: str | Column) -> Column:
    """A number below 2**32 for the seed and a label."""
    parts = [F.lit(x) if isinstance(x, str) else x.cast("string") for x in label]
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed, *parts)), 1, 8), 16, 10).cast("long")


def _between(seed: Column, label: str, low: Column | int, high: Column | int) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + drawn(seed, label) % (high - low + 1)).cast("int")


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def _without(items: Column, place: Column) -> Column:
    return F.filter(items, lambda _, i: i != place)


def _variable(k: Column) -> Column:
    """The truth table of input k as bits: bit m is bit k of m."""
    signed = [int.from_bytes(sum((m >> j & 1) << m for m in range(64)).to_bytes(8), signed=True) for j in range(len(NAMES))]
    return F.get(F.array(*[F.lit(x).cast("long") for x in signed]), k)


def _node(text: Column, table: Column, full: Column, negated: Column, leaf: bool) -> Column:
    """A tree's text and table, negated or not; an inner text has parentheses already, and gets its own in a negation."""
    inside = F.concat(F.lit(NOT), text) if leaf else F.concat(F.lit(NOT + "("), text, F.lit(")"))
    return F.struct(F.when(negated, inside).otherwise(text).alias("text"), F.when(negated, table.bitwiseXOR(full)).otherwise(table).alias("table"))


def _tree(s: Column, config: Config) -> Column:
    """The tree of (s, _n, _binary, _nots, _full)."""
    nots, full, n_binary = F.col("_nots"), F.col("_full"), F.col("_binary")

    def leaf(i: Column) -> Column:
        k = F.when(i < F.col("_n"), i).otherwise((drawn(s, "leaf", i) % F.col("_n")).cast("int"))
        return _node(F.get(F.array(*map(F.lit, NAMES)), k), _variable(k).bitwiseAND(full), full, F.array_contains(nots, i), True)

    def join(pool: Column, pick: Column) -> Column:
        return once(F.struct(F.get(pool, pick["i"]).alias("a"), _without(pool, pick["i"]).alias("rest")), lambda x: joined(x["a"], F.get(x["rest"], pick["j"]), x["rest"], pick))

    def joined(a: Column, b: Column, rest: Column, pick: Column) -> Column:
        tables = {"and": a["table"].bitwiseAND(b["table"]), "or": a["table"].bitwiseOR(b["table"]), "xor": a["table"].bitwiseXOR(b["table"])}
        text = F.concat(F.lit("("), a["text"], F.lit(" "), F.get(F.array(*[F.lit(SIGNS[g]) for g in config.gate_set]), pick["op"]), F.lit(" "), b["text"], F.lit(")"))
        table = F.get(F.array(*[tables[g] for g in config.gate_set]), pick["op"])
        return F.concat(_without(rest, pick["j"]), F.array(_node(text, table, full, pick["not"], False)))

    def pick(k: Column) -> Column:
        """Which two of those left are joined in step k, by what, and whether negated."""
        draws = {"i": drawn(s, "left", k) % (n_binary + 1 - k), "j": drawn(s, "right", k) % (n_binary - k), "op": drawn(s, "op", k) % len(config.gate_set)}
        return F.struct(*[v.cast("int").alias(c) for c, v in draws.items()], F.array_contains(nots, n_binary + 1 + k).alias("not"))

    leaves = F.transform(F.sequence(F.lit(0), n_binary), leaf)
    return F.aggregate(F.transform(_steps(n_binary), pick), leaves, join)


def _matters() -> Column:
    """Whether every input changes the table: of two rows that differ in input k alone some pair differs."""
    table, full = F.col("_tree.table"), F.col("_full")
    low = [_variable(F.lit(k)).bitwiseXOR(F.lit(-1).cast("long")).bitwiseAND(full) for k in range(len(NAMES))]
    turned = [(table.bitwiseXOR(F.call_function("shiftrightunsigned", table, F.lit(1 << k)))).bitwiseAND(low[k]) != 0 for k in range(len(NAMES))]
    return F.forall(F.zip_with(F.array(*turned), F.array(*[F.col("_n") > k for k in range(len(NAMES))]), lambda t, used: t | ~used), lambda x: x)


def tries(seeds: DataFrame, seed: str, first: int, last: int, config: Config) -> DataFrame:
    """seed, try and what each try draws, with ``good``: whether it is a specification."""
    lowest = F.greatest(F.lit(config.min_gates), F.col("_n") - 1)
    s = F.col("_s")
    rows = seeds.select(F.col(seed).alias("seed"), F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("try"))
    rows = rows.withColumn("_s", F.concat_ws("/", F.col("seed").cast("string"), F.col("try").cast("string"))).withColumn("_n", _between(s, "inputs", config.min_inputs, config.max_inputs))
    rows = rows.withColumn("_want", _between(s, "gates", lowest, config.max_gates)).withColumn("_binary", _between(s, "binary", F.col("_n") - 1, F.col("_want")))
    sites = F.col("_binary") * 2 + 1
    rows = rows.withColumn("_nots", F.array_distinct(F.transform(_steps(F.col("_want") - F.col("_binary")), lambda j: (drawn(s, "not", j) % sites).cast("int"))))
    rows = rows.withColumn("_full", F.when(F.col("_n") == 6, F.lit(-1).cast("long")).otherwise(F.expr("shiftleft(1L, shiftleft(1, _n)) - 1")))
    # a generator, so that no filter above has the tree drawn again for each use of it
    rows = rows.select("*", F.explode(_tree(s, config)).alias("_tree")).withColumn("gates", F.col("_binary") + F.size("_nots"))
    bits = F.transform(F.sequence(F.lit(0), F.expr("shiftleft(1, _n) - 1")), lambda m: F.call_function("shiftright", F.col("_tree.table"), m).bitwiseAND(F.lit(1).cast("long")))
    rows = rows.withColumn("rows", bits).withColumn("good", _matters() & F.col("gates").between(config.min_gates, config.max_gates))
    limited = drawn(s, "constraint") % 10_000 < int(config.constraint_rate * 10_000)
    kind = F.when(limited, drawn(s, "kind") % 3)
    limits = {"max_latency": (0, F.col("gates") + _between(s, "loose", 2, 5)), "max_blocks": (1, _between(s, "loose", 60, 120)), "region_x": (2, F.lit(16)), "region_z": (2, _between(s, "loose", 10, 16))}
    return rows.select("seed", "try", F.col("_n").alias("n_inputs"), F.col("_tree.text").alias("rule"), "rows", "gates", *[F.when(kind == k, v).cast("int").alias(c) for c, (k, v) in limits.items()], "good")


def random_specs(seeds: DataFrame, seed: str, config: Config = Config()) -> DataFrame:
    """A specification for each distinct seed: seed, try, n_inputs, rule, rows, gates, max_latency, max_blocks, region_x,
    region_z (null where it has no such constraint). One output; every input matters; the first good try counts.

    Tries are drawn in rounds, each for the seeds that are left, dealt out to all cores as the result's rows are; a seed without a good one in all raises. Null seeds are
    left out."""
    left = shared.stored(seeds.select(F.col(seed).alias("seed")).filter("seed IS NOT NULL").distinct())
    parts: list[DataFrame] = []
    first = 0
    for last in TRIES:
        good = tries(shared.dealt(left), "seed", first, last, config).filter("good").drop("good")
        own = [c for c in good.columns if c != "seed"]
        parts.append(shared.stored(good.groupBy("seed").agg(F.min_by(F.struct(*own), "try").alias("_x")).select("seed", "_x.*")))
        left, first = shared.stored(left.join(parts[-1], "seed", "left_anti")), last
        if not (n := left.count()):
            break
    else:
        raise RuntimeError(f"{n} seeds have no specification in {TRIES[-1]} tries")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return shared.dealt(out)


def ascii_rule(rule: Column) -> Column:
    """A rule with the signs that every keyboard has."""
    return F.translate(rule, NOT + "".join(SIGNS.values()), "!&|^")


def as_source(ascii_only: bool = False) -> Column:
    """The text of a random specification, whose one output is Q."""
    rule = ascii_rule(F.col("rule")) if ascii_only else F.col("rule")
    names = F.slice(F.array(*map(F.lit, NAMES)), F.lit(1), F.col("n_inputs"))
    limits = constraint_lines(F.col("max_latency"), F.col("max_blocks"), F.col("region_x"), F.col("region_z"))
    return source(names, F.array(F.lit("Q")), limits, F.array(F.concat(F.lit("Q = "), rule)))


def with_identity(df: DataFrame) -> DataFrame:
    """``df`` of random specifications with n_outputs, spec_source and spec_hash."""
    one = df.withColumn("n_outputs", F.lit(1))
    return one.withColumn("spec_source", as_source()).withColumn("spec_hash", specs.semantic_key(F.col("n_inputs"), F.col("n_outputs"), F.col("rows")))


def with_constraints(df: DataFrame, **limits: Column | int | None) -> DataFrame:
    """``df`` with other constraints (max_latency, max_blocks, region_x, region_z); those not named go. What a specification
    computes, and so its key, stays."""
    unknown = set(limits) - {"max_latency", "max_blocks", "region_x", "region_z"}
    if unknown:
        raise ValueError(f"unknown constraints: {', '.join(sorted(unknown))}")
    new = {c: limits.get(c) for c in ("max_latency", "max_blocks", "region_x", "region_z")}
    out = df.withColumns({c: (v if isinstance(v, Column) else F.lit(v)).cast("int") for c, v in new.items()})
    return out.withColumn("spec_source", as_source()) if "spec_source" in df.columns else out
