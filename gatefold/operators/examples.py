"""Records of a corpus: specifications, their verified layouts and their prompts put together; what a construction lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatefold.functions.once import once
from gatefold.vocab import AIR, CELLS, LAYER, SX, SZ

#: The fields of a record, in order.
FIELDS = ("spec_source", "spec_hash", "gates", "n_inputs", "n_outputs", "rows", "input_z", "output_z", "tokens", "latency_rt", "blocks", "bbox", "prompts")
#: Ports that a specification may have on a face; x of the faces.
MOST_PORTS, INPUT_X, OUTPUT_X = 6, 0, SX - 1


def examples(specs: DataFrame, layouts: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """A record for each verified layout: FIELDS, from (key, spec_source ... rows), (key, kind, input_z ... bbox) and (key,
    prompt).

    Layouts that didn't pass are none; a specification without layouts has no record. Prompts are the distinct ones of the
    key, sorted, and may be none. Null keys join nothing. Equal layouts give a record each. ``tokens`` may be a grid or what
    stands for one; neither side is broadcast, as Spark takes arrays for far smaller than they are."""
    asked = prompts.filter(F.col("prompt").isNotNull()).groupBy(F.col(key).alias("_p")).agg(F.array_sort(F.collect_set("prompt")).alias("prompts"))
    passed = layouts.filter("kind = 'pass'").select(F.col(key).alias("_l"), "input_z", "output_z", "tokens", "latency_rt", "blocks", "bbox")
    joined = specs.join(passed.hint("merge"), F.col(key) == F.col("_l")).join(asked.hint("merge"), F.col(key) == F.col("_p"), "left")
    return joined.withColumn("prompts", F.coalesce("prompts", F.array().cast("array<string>"))).select(*FIELDS)


def port(x: Column | int, z: Column) -> Column:
    """A port's cell on the floor above the substrate."""
    return F.struct((x if isinstance(x, Column) else F.lit(x)).cast("int").alias("x"), z.cast("int").alias("z"))


def _faced(ports: Column, x: int) -> Column:
    return F.transform(ports, lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z"), F.lit(x).alias("face")))


def construction_fault(inputs: Column, outputs: Column, rows: Column) -> Column:
    """What is first wrong with a construction from ports (x, z) and rows, or null: no or too many inputs, no or too many
    outputs, a table of the wrong length, then, input by input and output by output, a port off its face or one that shares
    its cell with an earlier one. Null arrays are empty."""
    none = F.array().cast("array<struct<x:int,z:int>>")
    ins, outs = (F.coalesce(c, F.filter(c, lambda p: F.lit(False)), none) for c in (inputs, outputs))
    got = F.coalesce(F.when(rows.isNotNull(), F.size(rows)), F.lit(0))
    return once(F.struct(ins.alias("ins"), outs.alias("outs"), got.alias("got")), lambda c: _construction_fault(c["ins"], c["outs"], c["got"]))


def _construction_fault(ins: Column, outs: Column, got: Column) -> Column:
    n, m = F.size(ins), F.size(outs)
    want = F.call_function("shiftleft", F.lit(1), n)

    def port_faults(every: Column) -> Column:
        def fault(p: Column, i: Column) -> Column:
            before = F.exists(F.slice(every, F.lit(1), i), lambda q: (q["x"] == p["x"]) & (q["z"] == p["z"]))
            side = F.when(p["face"] == INPUT_X, "input").otherwise("output")
            off = F.concat(side, F.format_string(" port (%d, %d) is not on the x=%d face", p["x"], p["z"], p["face"]))
            return F.when(p["x"] != p["face"], off).when(before, F.format_string("two ports share (%d, %d)", p["x"], p["z"]))

        return F.get(F.filter(F.transform(every, fault), lambda r: r.isNotNull()), F.lit(0))

    ports = once(F.concat(_faced(ins, INPUT_X), _faced(outs, OUTPUT_X)), port_faults)
    return (
        F.when(n == 0, "no inputs").when(n > MOST_PORTS, F.format_string("%d inputs exceed %d", n, F.lit(MOST_PORTS)))
        .when(m == 0, "no outputs").when(m > MOST_PORTS, F.format_string("%d outputs exceed %d", m, F.lit(MOST_PORTS)))
        .when(got != want, F.format_string("the table has %d rows, not %d", got, want)).otherwise(ports)
    )


def base64_text(c: Column) -> Column:
    """Binary as Base64 in one line, whatever the session breaks lines at."""
    return F.translate(F.base64(c), "\r\n", "")


def payload(c: Column, kind: str) -> Column:
    """A grid as binary, from binary, Base64 text or an array of tokens; another length, or a number that is no byte, raises.
    Null stays null."""
    if kind == "base64":
        out = F.unbase64(c)
    elif kind == "tokens":
        odd = F.exists(c, lambda t: t.isNull() | ~t.between(0, 255))
        out = F.when(odd, F.raise_error(F.lit("a token is no byte"))).otherwise(F.unhex(F.array_join(F.transform(c, lambda t: F.lpad(F.hex(t), 2, "0")), "")))
    else:
        out = c
    return F.when(F.octet_length(out) == CELLS, out).when(out.isNotNull(), F.raise_error(F.concat(F.lit("a grid has "), F.octet_length(out).cast("string"), F.lit(" cells"))))


def cell(tokens: Column, x: Column, y: Column, z: Column) -> Column:
    """The token at a place of an array of tokens; null outside the grid."""
    inside = x.between(0, SX - 1) & z.between(0, SZ - 1) & y.between(0, CELLS // LAYER - 1)
    return F.when(inside, F.get(tokens, (y * LAYER + z * SX + x).cast("int")))


def occupied_size(tokens: Column) -> Column:
    """Edges of the box around all cells that aren't air, the substrate too; zeros for an empty grid."""
    used = F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.get(tokens, i) != AIR)

    def edge(of) -> Column:
        v = F.transform(used, of)
        return F.coalesce(F.array_max(v) - F.array_min(v) + 1, F.lit(0)).cast("int")

    return F.struct(edge(lambda i: i % SX).alias("x"), edge(lambda i: F.floor(i / LAYER)).alias("y"), edge(lambda i: F.floor(i / SX) % SZ).alias("z"))
