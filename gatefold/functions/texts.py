"""Texts of and about specifications and grids: rules, sources, prompts, layers, labels, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatefold.functions.once import once
from gatefold.functions.phrases import LIGHTS, SWITCHES, functional, pick, vague
from gatefold.vocab import CELLS, LAYER, NAMES, SX, SZ, lookup

#: Signs of the rule language and what they are written as in ASCII.
_FOLD = ("¬∧∨⊕", "!&|^")
#: Words of the rule language that are no names.
_KEYWORDS = ("not", "and", "or", "xor", "delay", "strength")
#: What the characters of a drawn layer stand for.
DRAWN = {".": 0, "#": 1, "d": 2, "t": 6, ">": 20, "V": 35, "L": 36, "T": 37, "c": 30}
#: Advice by the stage at which a request failed.
_DENSE = "Routing is placement-sensitive. A wire crossing uses a conservative seven-cell bridge, so more attempts or another seed can help; dense layouts may still exceed the 16x6x16 build volume."
HINTS = {
    "routing": _DENSE, "placement": _DENSE, "signal": _DENSE,
    "netlist": "The spec is outside the v1 primitive set entirely.",
    "verify": "The placer produced a layout the verifier rejected. This is the verifier doing its job — roughly a quarter of routed layouts are discarded this way. Retrying usually finds a good one.",
}
#: The prompt for a text model.
PROMPT = (
    "Build a Minecraft redstone circuit on a 16x16 grid, one layer.\nUse these characters: '.' air, '#' solid block, 'd' redstone dust,\n't' wall torch (attached to the block on its west side),\n'>' repeater facing east, 'V' lever, 'L' lamp.\n"
    "Inputs are levers at x=0 on rows [%s], each with a\nsolid block at x=1. Outputs are lamps at x=15 on rows [%s].\n\nSpecification:\n%s\n\nTruth table:\n%s\n\nReply with exactly 16 lines of 16 characters and nothing else."
)


def folded(rule: Column) -> Column:
    return F.translate(rule, *_FOLD)


def gate_count(rule: Column) -> Column:
    """Operators of a rule, by sign or word; delay and strength are none."""
    return F.regexp_count(F.lower(folded(rule)), F.lit(r"[!&|^]|\b(not|and|or|xor)\b")).cast("int")


def referenced(rule: Column) -> Column:
    """The names in a rule, sorted, each once."""
    names = F.regexp_extract_all(folded(rule), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda w: ~F.lower(w).isin(*_KEYWORDS))))


#: Ports that a specification may have on a side.
MOST_PORTS = 6


def spec_fault(inputs: Column, outputs: Column, rules: Column) -> Column:
    """What is first wrong with a specification of names and rules (name, expression), or null: no rule, too many ports, names
    that are both, outputs without a rule, rules without an output, names in a rule that are no input (rule by rule), inputs
    that no rule uses. None of the arrays is null."""
    names, used = F.transform(rules, lambda r: r["name"]), F.flatten(F.transform(rules, lambda r: referenced(r["expression"])))
    both, missing, extra, unused = F.array_sort(F.array_intersect(inputs, outputs)), F.array_except(outputs, names), F.array_except(names, outputs), F.array_except(inputs, used)
    unknown = F.filter(F.transform(rules, lambda r: F.struct(r["name"].alias("name"), F.array_except(referenced(r["expression"]), inputs).alias("names"))), lambda u: F.size(u["names"]) > 0)

    def said(items: Column, before: str, after: str = "") -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(before), F.array_join(items, ", "), F.lit(after)))

    return F.coalesce(
        F.when(F.size(rules) == 0, "no rule"), *[F.when(F.size(c) > MOST_PORTS, F.concat(F.size(c).cast("string"), F.lit(f" {what} exceed {MOST_PORTS}"))) for c, what in ((inputs, "inputs"), (outputs, "outputs"))],
        said(both, "", " both input and output"), said(missing, "no rule for "), said(extra, "no outputs: "),
        F.when(F.size(unknown) > 0, F.concat(F.get(unknown, F.lit(0))["name"], F.lit(" refers to "), F.array_join(F.get(unknown, F.lit(0))["names"], ", "))), said(unused, "unused: "),
    )


def constraint_lines(latency: Column, blocks: Column, region_x: Column, region_z: Column) -> Column:
    return F.array_compact(F.array(
        F.when(latency.isNotNull(), F.format_string("latency <= %d", latency)), F.when(blocks.isNotNull(), F.format_string("footprint <= %d", blocks)),
        F.when(region_x.isNotNull(), F.format_string("region <= %d x %d", region_x, region_z)),
    ))


def source(inputs: Column, outputs: Column, constraints: Column, rules: Column) -> Column:
    """The text of a specification: ports, constraints, a line for each rule ``name = expression``."""
    return F.concat_ws("\n", F.concat(F.array(F.concat(F.lit("inputs "), F.concat_ws(" ", inputs)), F.concat(F.lit("outputs "), F.concat_ws(" ", outputs))), constraints, rules))


def procedural(n: Column, inverters: Column, depth: Column, light: Column) -> Column:
    """How one would build it; without a netlist, that the inputs are combined."""
    return (
        F.when(inverters.isNull(), F.format_string("combine the %d inputs into one output", n))
        .when(inverters == 0, F.concat(F.lit("run every input onto the same wire and into the "), light))
        .when(inverters == 1, F.concat(F.lit("merge the inputs, then invert once with a torch to drive the "), light))
        .otherwise(F.concat(F.format_string("invert the inputs, merge them, and invert again — %d torches in %d stage", inverters, depth), F.when(depth != 1, "s").otherwise("")))
    )


def terse(name: Column, rule: Column, short: Column) -> Column:
    """The function's name, the short form of it, or the right side of its last rule."""
    return F.when(name.isNull(), F.trim(F.substring_index(F.element_at(F.split(folded(rule), "\n"), -1), "=", -1))).when(short, F.lower(F.replace(name, F.lit(" gate"), F.lit("")))).otherwise(name)


def paraphrases(key: Column, names: Column, rows: Column, name: Column, rule: Column, inverters: Column, depth: Column, count: Column, draws: int = 8) -> Column:
    """Up to ``count`` different texts, spread over the four ways to put a function; words are drawn by a hash of the key."""
    out = []
    for k in range(draws):
        seed = F.concat_ws("/", key, F.lit(str(k)))
        switch, light, n = pick(SWITCHES, seed), pick(LIGHTS, F.concat(seed, F.lit("l"))), F.size(names)
        out += [terse(name, rule, F.lit(k % 2 == 1)), functional(names, rows, switch, light), procedural(n, inverters, depth, light), vague(n, F.pmod(F.xxhash64(seed), F.lit(97)).cast("int"), switch, light)]
    return F.slice(F.array_distinct(F.array(*out)), 1, count)


def prompt(input_z: Column, output_z: Column, text: Column, table: Column) -> Column:
    return F.format_string(PROMPT, F.concat_ws(", ", input_z.cast("array<string>")), F.concat_ws(", ", output_z.cast("array<string>")), text, table)


def scope_hint(stage: Column) -> Column:
    """What to do about a failed request; null for other stages."""
    out = F.lit(None).cast("string")
    for name, text in HINTS.items():
        out = F.when(stage == name, text).otherwise(out)
    return out


def drawn_lines(text: Column) -> Column:
    """Of a drawn layer the lines that hold its characters only; blank and other ones go."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.rtrim(x)), lambda x: x.rlike(r"^[.#dt>VLTc]+$"))


def drawn_layer(text: Column) -> Column:
    """A grid from 16 lines of 16 characters over the substrate, or null for anything else: nothing is repaired."""
    table = F.create_map(*[F.lit(x) for pair in DRAWN.items() for x in pair])

    def cells(own: Column) -> Column:
        # joined once and split into characters, which the table then takes one by one
        read = F.transform(F.regexp_extract_all(F.array_join(own, ""), F.lit("(.)"), F.lit(1)), lambda c: F.element_at(table, c))
        whole = (F.size(own) == SZ) & F.forall(own, lambda x: F.length(x) == SX)
        return F.when(whole, F.concat(F.array_repeat(F.lit(1), LAYER), read, F.array_repeat(F.lit(0), CELLS - 2 * LAYER)))

    return once(drawn_lines(text), cells)


def cell_label(x: Column, y: Column, z: Column, token: Column) -> Column:
    """(x, y, z) and the block's state; a control token shows its number."""
    return F.format_string("(%d, %d, %d)  %s", x, y, z, F.coalesce(lookup("state", token), F.concat(F.lit("control:"), token.cast("string"))))


def parsed_state(text: Column) -> Column:
    """name, properties and error of a block state ``name[key=value,...]``; without brackets there are no properties."""
    inner = F.regexp_extract(text, r"\[(.*)\]$", 1)
    parts = F.filter(F.split(inner, ","), lambda x: x != "")
    keys = F.transform(parts, lambda x: F.trim(F.substring_index(x, "=", 1)))
    error = (
        F.when(~text.rlike(r"^[a-z0-9_.:/-]+(\[.*\])?$"), "malformed").when(F.exists(parts, lambda x: ~x.rlike(r"^[^=]+=[^=]+$")), "property without a value")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "property given twice")
    )
    props = F.map_from_entries(F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring_index(x, "=", -1)).alias("v"))))
    return F.struct(F.regexp_extract(text, r"^[^\[]*", 0).alias("name"), F.when(error.isNull(), props).alias("properties"), error.alias("error"))


def connects_dust(token: Column, direction: Column) -> Column:
    """Whether dust joins a block that lies in a direction (north, south, west, east) from it."""
    return F.call_function("shiftright", lookup("connect_mask", token), direction).bitwiseAND(F.lit(1)) == 1


def direction_name(direction: Column) -> Column:
    return F.get(F.array(*map(F.lit, NAMES)), direction)
