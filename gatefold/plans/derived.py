"""Queries over the given tables that read their rows as cells, grids, drawn layers, specifications, verdicts and nets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatefold import vocab
from gatefold.functions import grids, phrases, specs, steps, texts
from gatefold.functions.once import once
from gatefold.operators import attempts, checks, circuits, loop
from gatefold.plans.exports import _grids
from gatefold.sources import shared
from gatefold.sources.records import tokens_of
from gatefold.vocab import CELLS, LAYER

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), sf_dir)
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


# A line item as a cell: where it stands, what stands there, what is beside it.
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_CELL = f"SELECT {_LINE}, ((l_partkey * 7 + l_suppkey * 13 + l_linenumber) % {CELLS})::INT AS i, ((l_suppkey + l_linenumber * 3) % 48)::INT AS t, ((l_partkey + l_linenumber) % 4)::INT AS d FROM lineitem"
_KIND = "CASE WHEN t = 0 THEN 'air' WHEN t = 1 THEN 'solid' WHEN t = 2 THEN 'wire' WHEN t < 8 THEN 'torch' WHEN t < 24 THEN 'repeater' WHEN t < 32 THEN 'comparator' WHEN t < 36 THEN 'lever' WHEN t = 36 THEN 'lamp' WHEN t = 37 THEN 'target' WHEN t < 44 THEN 'observer' ELSE ['pad', 'bos', 'eos', 'mask'][t - 43] END"
_BACK = "['south', 'north', 'east', 'west'][{} + 1]"
_STATE = f"""CASE WHEN t = 0 THEN 'minecraft:air' WHEN t = 1 THEN 'minecraft:stone' WHEN t = 2 THEN 'minecraft:redstone_wire[power=0]' WHEN t = 3 THEN 'minecraft:redstone_torch[lit=true]' WHEN t < 8 THEN 'minecraft:redstone_wall_torch[facing=' || {_BACK.format("(t - 4)")} || ',lit=true]'
WHEN t < 24 THEN 'minecraft:repeater[facing=' || {_BACK.format("((t - 8) // 4)")} || ',delay=' || ((t - 8) % 4 + 1) || ',locked=false,powered=false]' WHEN t < 32 THEN 'minecraft:comparator[facing=' || {_BACK.format("((t - 24) // 2)")} || ',mode=' || CASE WHEN t % 2 = 0 THEN 'compare' ELSE 'subtract' END || ',powered=false]'
WHEN t < 36 THEN 'minecraft:lever[face=wall,facing=' || {_BACK.format("(t - 32)")} || ',powered=false]' WHEN t = 36 THEN 'minecraft:redstone_lamp[lit=false]' WHEN t = 37 THEN 'minecraft:target[power=0]' WHEN t < 44 THEN 'minecraft:observer[facing=' || ['north', 'south', 'west', 'east', 'up', 'down'][t - 37] || ',powered=false]' END"""


def _cells(t) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return t("lineitem").select(*_LINE.split(", "), ((p * 7 + s * 13 + n) % CELLS).cast("int").alias("i"), ((s + n * 3) % 48).cast("int").alias("t"), ((p + n) % 4).cast("int").alias("d"))


@query(f"""
WITH c AS (SELECT *, i % 16 AS x, i // 256 AS y, i // 16 % 16 AS z FROM ({_CELL}))
SELECT {_LINE}, x::INT AS x, y::INT AS y, z::INT AS z, i AS back, (abs(x - 8) + abs(y - 1) + abs(z - 7))::INT AS distance, abs(x - 8) + abs(y - 1) + abs(z - 7) = 1 AS adjacent,
  CASE d WHEN 0 THEN CASE WHEN z > 0 THEN i - 16 END WHEN 1 THEN CASE WHEN z < 15 THEN i + 16 END WHEN 2 THEN CASE WHEN x > 0 THEN i - 1 END ELSE CASE WHEN x < 15 THEN i + 1 END END::INT AS moved,
  ['north', 'south', 'west', 'east'][d + 1] AS direction, t < 38 AND (y > 0 OR t < 2) AS legal FROM c""")
def b_cell_places(spark, t, sf_dir):
    c = _cells(t).withColumn("p", vocab.place(F.col("i")))
    goal = F.struct(F.lit(8).alias("x"), F.lit(1).alias("y"), F.lit(7).alias("z"))
    by = [F.get(F.array(*map(F.lit, v)), F.col("d")) for v in ((0, 0, -1, 1), (0, 0, 0, 0), (-1, 1, 0, 0))]
    to = steps.moved(F.col("p"), F.struct(*[v.alias(k) for v, k in zip(by, "xyz", strict=True)]))
    c = c.withColumn("to", to)
    return c.select(
        *_LINE.split(", "), "p.x", "p.y", "p.z", vocab.index(F.col("p.x"), F.col("p.y"), F.col("p.z")).cast("int").alias("back"), steps.manhattan(F.col("p"), goal).cast("int").alias("distance"), steps.adjacent(F.col("p"), goal).alias("adjacent"),
        F.when(F.col("to").isNotNull(), vocab.index(F.col("to.x"), F.col("to.y"), F.col("to.z"))).cast("int").alias("moved"), texts.direction_name(F.col("d")).alias("direction"), vocab.legal_at(F.col("t"), F.col("p.y")).alias("legal"),
    )


@query(f"""
WITH c AS ({_CELL})
SELECT {_LINE}, t AS token, {_KIND} AS kind, t IN (1, 36, 37) OR t BETWEEN 38 AND 43 AS opaque, t IN (1, 36, 37) AS conductive, t >= 44 AS control, {_STATE} AS state,
  CASE WHEN t >= 44 THEN ['_', '^', '$', '?'][t - 43] ELSE {{'air': '.', 'solid': '#', 'wire': 'd', 'torch': 't', 'repeater': '>', 'comparator': 'c', 'lever': 'V', 'lamp': 'L', 'target': 'T', 'observer': 'o'}}[{_KIND}] END AS glyph,
  CASE WHEN t < 2 OR t >= 44 THEN ' ' WHEN t = 2 THEN '·' WHEN t < 8 THEN '◆' WHEN t < 24 THEN '▶' WHEN t < 32 THEN '◆' WHEN t < 36 THEN '⌐' WHEN t = 36 THEN '◍' WHEN t = 37 THEN '◎' ELSE '◇' END AS shown,
  CASE WHEN t = 0 OR t >= 44 THEN '#3A424C' WHEN t = 1 THEN '#8894A2' WHEN t < 8 THEN '#F0392C' WHEN t < 24 THEN '#5FB3C4' WHEN t < 32 THEN '#E0A82E' WHEN t < 36 THEN '#DDE4EB' WHEN t = 36 THEN '#221A05' WHEN t = 37 THEN '#A9B4C0' ELSE '#77828F' END AS foreground,
  '(' || i % 16 || ', ' || i // 256 || ', ' || i // 16 % 16 || ')  ' || coalesce({_STATE}, 'control:' || t) AS label,
  CASE WHEN t < 44 THEN t BETWEEN 2 AND 7 OR t BETWEEN 32 AND 35 OR (t BETWEEN 8 AND 23 AND (t - 8) // 8 = d // 2) OR (t BETWEEN 24 AND 31 AND (t - 24) // 4 = d // 2) END AS joins, CASE WHEN t < 44 THEN t END AS again FROM c""".replace("{'air'", "map {'air'"))
def b_cell_tokens(spark, t, sf_dir):
    table = vocab.vocabulary(spark).join(F.broadcast(vocab.display(spark)), F.col("shown") == F.when(F.col("control"), "air").otherwise(F.col("kind")))  # 48 rows
    c = _cells(t).join(F.broadcast(table), F.col("t") == F.col("token"))
    parts = [F.col(x) for x in ("kind", "attach", "facing", "delay", "mode")]
    at = vocab.place(F.col("i"))
    return c.select(
        *_LINE.split(", "), "token", "kind", "opaque", "conductive", "control", "state", "glyph", F.col("display_glyph").alias("shown"), "foreground", texts.cell_label(at["x"], at["y"], at["z"], F.col("t")).alias("label"),
        F.when(~F.col("control"), texts.connects_dust(F.col("t"), F.col("d"))).alias("joins"), F.when(~F.col("control"), steps.token_of(*parts)).cast("int").alias("again"),
    )


@query("""
WITH s AS (SELECT conv_id, turn, role, turn % 6 AS k, length(text) AS n FROM conversations),
t AS (SELECT *, 'minecraft:' || role || CASE k WHEN 0 THEN '' WHEN 1 THEN '[turn=' || turn || ',len=' || n || ']' WHEN 2 THEN '[turn=1,turn=' || n || ']' WHEN 3 THEN '[turn]' WHEN 4 THEN ' of[a=b]' ELSE '[]' END AS state FROM s)
SELECT conv_id, turn, CASE WHEN k = 4 THEN 'minecraft:' || role || ' of' ELSE 'minecraft:' || role END AS name, CASE WHEN k IN (0, 5) THEN '' WHEN k = 1 THEN 'turn=' || turn || ';len=' || n END AS properties, CASE k WHEN 2 THEN 'property given twice' WHEN 3 THEN 'property without a value' WHEN 4 THEN 'malformed' END AS error FROM t""")
def b_block_states(spark, t, sf_dir):
    k, n = F.col("turn") % 6, F.length("text")
    tail = F.when(k == 0, "").when(k == 1, F.format_string("[turn=%d,len=%d]", "turn", n)).when(k == 2, F.format_string("[turn=1,turn=%d]", n)).when(k == 3, "[turn]").when(k == 4, " of[a=b]").otherwise("[]")
    parsed = t("conversations").select("conv_id", "turn", texts.parsed_state(F.concat(F.lit("minecraft:"), "role", tail)).alias("p"))
    pairs = F.transform(F.map_entries("p.properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return parsed.select("conv_id", "turn", "p.name", F.array_join(pairs, ";").alias("properties"), "p.error")


# A turn as a drawn layer: its characters, taken in steps of seven, as those of a layer; some turns lack a line or hold prose.
_DRAWN = "['.', '#', 'd', 't', '>', 'V', 'L', 'T', 'c']"
_SQL_LAYER = f"""
d AS (SELECT conv_id, turn, role, list_transform(range(256), lambda i: (unicode(substr(text, (1 + (i * 7) % length(text))::BIGINT, 1)) + i) % 9) AS c FROM conversations WHERE length(text) > 0),
g AS (SELECT conv_id, turn, role, turn % 4 <> 3 AS readable, list_transform(c, lambda k: [0, 1, 2, 6, 20, 35, 36, 37, 30][k + 1]) AS cells, list_transform(c, lambda k: {_DRAWN}[k + 1]) AS chars FROM d)"""


#: Places of a text that a layer's 256 steps of seven can reach.
_REACH = 255 * 7 + 1


def _layers(t) -> DataFrame:
    own = shared.dealt(t("conversations").select("conv_id", "turn", "role", "text").filter(F.length("text") > 0))
    signs, n = F.array(*map(F.lit, ".#dt>VLTc")), F.length("text")
    letters = F.regexp_extract_all(F.substring("text", 1, _REACH), F.lit("(?s)(.)"), F.lit(1))
    chars = once(F.struct(n.alias("n"), letters.alias("of")), lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.get(signs, (F.ascii(F.get(s["of"], (i * 7) % s["n"])) + i) % 9)), ""))
    lines = F.sequence(F.lit(0), F.when(F.col("turn") % 4 == 3, 14).otherwise(15))
    drawn = once(chars, lambda c: F.array_join(F.transform(lines, lambda y: F.substr(c, y * 16 + 1, F.lit(16))), "\n"))
    return shared.stored(own.select("conv_id", "turn", "role", F.concat(drawn, F.when(F.col("turn") % 3 == 1, "\n\nthat is the layer").otherwise("")).alias("drawn")))


@query(f"""
WITH {_SQL_LAYER}
SELECT conv_id, turn, CASE WHEN readable THEN md5(array_to_string(list_transform(range({CELLS}), lambda i: CASE WHEN i < 256 THEN 1 WHEN i < 512 THEN cells[i - 255] ELSE 0 END), ',')) END AS digest, CASE WHEN readable THEN array_to_string(list_filter(list_transform(range(256), lambda i: CASE WHEN cells[i + 1] = 36 THEN 256 + i END), lambda v: v IS NOT NULL), ',') END AS lamps,
  CASE WHEN readable THEN len(list_filter(cells, lambda c: c <> 0))::INT END AS material, CASE WHEN readable THEN md5('-- y=1' || chr(10) || array_to_string(list_transform(range(16), lambda y: array_to_string(chars[y * 16 + 1:y * 16 + 16], '')), chr(10))) END AS rendered,
  CASE WHEN readable THEN array_to_string(cells, ',') END AS slice FROM g""")
def b_drawn_layers(spark, t, sf_dir):
    read = shared.stored(_layers(t).select("conv_id", "turn", texts.drawn_layer(F.col("drawn")).alias("g")))
    g = F.col("g")
    return read.select("conv_id", "turn", F.md5(F.array_join(g, ",")).alias("digest"), F.array_join(steps.found(g, "lamp"), ",").alias("lamps"), grids.material_blocks(g).alias("material"), F.when(g.isNotNull(), F.md5(grids.render(g))).alias("rendered"), F.array_join(steps.layer(g, F.lit(1)), ",").alias("slice")).withColumn("material", F.when(F.col("digest").isNotNull(), F.col("material")))


@query(f"WITH {_SQL_LAYER} SELECT role, count(*) AS answers, count(*) FILTER (WHERE NOT readable) AS unparseable FROM g GROUP BY role")
def b_unreadable(spark, t, sf_dir):
    return attempts.unreadable(_layers(t), "role", texts.drawn_layer(F.col("drawn")))


# A part as a function of three inputs.
_BIT = "((tbl >> {}::INT) & 1)"
_PART = "SELECT p_partkey, ((p_partkey * 37 + p_size) % 256)::INT AS tbl FROM part"
_ON = "list_filter(range(8), lambda m: (tbl >> m::INT) & 1 = 1)"
_WORDS = "CASE {m} WHEN 0 THEN 'A, B and C are off' WHEN 1 THEN 'A is on and B and C are off' WHEN 2 THEN 'B is on and A and C are off' WHEN 3 THEN 'A and B are on and C is off' WHEN 4 THEN 'C is on and A and B are off' WHEN 5 THEN 'A and C are on and B is off' WHEN 6 THEN 'B and C are on and A is off' ELSE 'A, B and C are on' END"
_SOP = f"array_to_string(list_transform({_ON}, lambda m: '(' || CASE WHEN m & 1 = 1 THEN 'A' ELSE '!A' END || ' & ' || CASE WHEN m >> 1 & 1 = 1 THEN 'B' ELSE '!B' END || ' & ' || CASE WHEN m >> 2 & 1 = 1 THEN 'C' ELSE '!C' END || ')'), ' | ')"
_NAMED = "(VALUES " + ", ".join(f"('{b}', '{name}')" for n, b, name in specs.NAMED if n == 3) + ") n(bits, name)"


def _functions(t) -> DataFrame:
    own = shared.dealt(t("part").select("p_partkey", "p_size")).select("p_partkey", ((F.col("p_partkey") * 37 + F.col("p_size")) % 256).cast("int").alias("tbl"))
    return own.withColumn("rows", specs.table_rows(F.col("tbl"), 3)).withColumn("names", F.array(*map(F.lit, "ABC")))


@query(f"""
WITH p AS ({_PART}), f AS (SELECT *, list_transform(range(8), lambda m: (tbl >> m::INT) & 1) AS rows, {_ON} AS ons FROM p)
SELECT p_partkey, tbl, lpad(lower(format('{{:x}}', list_reduce(list_prepend(14695981039346656037::HUGEINT, ([3, 1] || flatten(list_transform(rows, lambda b: [b, 0, 0, 0, 0, 0, 0, 0])))::HUGEINT[]), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS key,
  tbl IN (0, 255) AS constant, array_to_string(list_filter(range(3), lambda k: len(list_filter(range(8), lambda m: rows[m + 1] <> rows[xor(m, 1 << k::INT) + 1])) > 0), ',') AS depends_on, array_to_string(ons, ',') AS on_rows,
  array_to_string(list_transform(range(4), lambda m: rows[1 + (m >> 1 & 1) + (m & 1) * 4]), ',') AS kept, CASE WHEN tbl > 0 THEN {_SOP} END AS sop, (SELECT name FROM {_NAMED} WHERE n.bits = array_to_string(rows, '')) AS name FROM f""")
def b_part_functions(spark, t, sf_dir):
    rows = F.col("rows")
    f = _functions(t).withColumn("bits", F.array_join("rows", "")).withColumn("n_inputs", F.lit(3)).join(F.broadcast(specs.named(spark)), ["n_inputs", "bits"], "left")  # a name for each of fifteen tables
    used = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: specs.depends(F.col("rows"), k))
    return f.select("p_partkey", "tbl", specs.semantic_key(F.lit(3), F.lit(1), rows).alias("key"), specs.constant(rows).alias("constant"), F.array_join(used, ",").alias("depends_on"), F.array_join(specs.on_rows(rows), ",").alias("on_rows"), F.array_join(specs.restrict(rows, [0, 2]), ",").alias("kept"), specs.sum_of_products(rows, F.col("names")).alias("sop"), "name")


@query(f"""
WITH p AS ({_PART}), f AS (SELECT *, {_ON} AS ons, {_SOP} AS sop, list_filter(range(8), lambda m: (tbl >> m::INT) & 1 = 0) AS offs FROM p WHERE tbl > 0),
j AS (SELECT f.*, n.name, ['switch', 'lever', 'input', 'button'][1 + tbl % 4] AS sw, ['lamp', 'light', 'output', 'bulb'][1 + tbl % 3] AS lt FROM f LEFT JOIN {_NAMED} ON n.bits = array_to_string(list_transform(range(8), lambda m: (tbl >> m::INT) & 1), ''))
SELECT p_partkey, CASE WHEN len(ons) = 1 THEN 'the ' || lt || ' turns on only when ' || {_WORDS.format(m="ons[1]")} WHEN len(ons) = 7 THEN 'the ' || lt || ' stays on except when ' || {_WORDS.format(m="offs[1]")} WHEN len(ons) <= 2 THEN 'the ' || lt || ' lights when ' || {_WORDS.format(m="ons[1]")} || ' or when ' || {_WORDS.format(m="ons[2]")}
    ELSE '3 ' || sw || CASE WHEN sw = 'switch' THEN 'es' ELSE 's' END || ' control one ' || lt || '; it is on for ' || len(ons) || ' of the 8 combinations' END AS functional,
  coalesce(name, sop) AS terse, coalesce(lower(replace(name, ' gate', '')), sop) AS short,
  CASE tbl % 4 WHEN 0 THEN 'combine the 3 inputs into one output' WHEN 1 THEN 'run every input onto the same wire and into the ' || lt WHEN 2 THEN 'merge the inputs, then invert once with a torch to drive the ' || lt ELSE 'invert the inputs, merge them, and invert again — 3 torches in ' || (1 + tbl % 2) || CASE WHEN tbl % 2 = 0 THEN ' stage' ELSE ' stages' END END AS procedural,
  replace(replace(replace(['a 3-{{sw}} safety interlock', 'a little control panel with 3 {{sws}}', 'something that decides when the {{lt}} should come on, from 3 {{sws}}', 'a 3-way check before the {{lt}} lights', 'the logic for a 3-{{sw}} door control'][1 + tbl % 5], '{{sws}}', sw || CASE WHEN sw = 'switch' THEN 'es' ELSE 's' END), '{{sw}}', sw), '{{lt}}', lt) AS vague,
  (len(regexp_extract_all(sop, '[!&|]')))::INT AS gates, 'A,B,C' AS names, len(regexp_extract_all(sop, '[!&|]')) BETWEEN 4 AND 20 AS in_range FROM j""")
def b_part_prompts(spark, t, sf_dir):
    f = _functions(t).filter("tbl > 0").withColumn("bits", F.array_join("rows", "")).withColumn("n_inputs", F.lit(3)).join(F.broadcast(specs.named(spark)), ["n_inputs", "bits"], "left")
    word = lambda words, n: F.get(F.array(*map(F.lit, words)), F.col("tbl") % n)
    f = f.withColumn("sw", word(phrases.SWITCHES, 4)).withColumn("lt", word(phrases.LIGHTS, 3)).withColumn("sop", specs.sum_of_products(F.col("rows"), F.col("names")))
    n, tbl, rule = F.lit(3), F.col("tbl"), F.concat(F.lit("Q = "), F.col("sop"))
    inverters = F.when(tbl % 4 > 0, tbl % 4 - 1 + F.when(tbl % 4 == 3, 1).otherwise(0))
    gates = texts.gate_count(F.col("sop"))
    return f.select(
        "p_partkey", phrases.functional(F.col("names"), F.col("rows"), F.col("sw"), F.col("lt")).alias("functional"), texts.terse(F.col("name"), rule, F.lit(False)).alias("terse"), texts.terse(F.col("name"), rule, F.lit(True)).alias("short"),
        texts.procedural(n, inverters.cast("int"), (1 + tbl % 2).cast("int"), F.col("lt")).alias("procedural"), phrases.vague(n, tbl, F.col("sw"), F.col("lt")).alias("vague"), gates.alias("gates"), F.array_join(texts.referenced(F.col("sop")), ",").alias("names"), gates.between(4, 20).alias("in_range"),
    )


@query(f"""
WITH p AS ({_PART}), s AS (SELECT *, [1, 3, 19, 4, 17] || CASE WHEN tbl % 2 = 0 THEN [6, 16 + least(tbl, 63)] ELSE [] END || CASE WHEN tbl % 3 = 0 THEN [7, 16 + least(tbl + 20, 63)] ELSE [] END || CASE WHEN tbl % 5 = 0 THEN [8, 32, 16 + 10 + tbl % 7] ELSE [] END AS head FROM p),
f AS (SELECT *, list_resize(head || flatten(list_transform(range(least(8, (31 - len(head)) // 2)), lambda m: [5, 16 + ((tbl >> m::INT) & 1)])) || [9], 32, 0) AS prefix FROM s)
SELECT p_partkey, array_to_string(prefix, ' ') AS prefix, md5(array_to_string(list_transform(prefix, lambda v: v + 48) || list_transform(range({CELLS}), lambda i: CASE WHEN i < 256 THEN 1 WHEN i IN (256 + 16, 256 + 128, 256 + 224) THEN 35 WHEN i IN (257 + 16, 257 + 128, 257 + 224) THEN 1 WHEN i = 256 + 127 THEN 36 ELSE 0 END), ',')) AS sequence,
  'inputs A B C' || chr(10) || 'outputs Q' || CASE WHEN tbl % 2 = 0 THEN chr(10) || 'latency <= ' || tbl ELSE '' END || CASE WHEN tbl % 3 = 0 THEN chr(10) || 'footprint <= ' || (tbl + 20) ELSE '' END || CASE WHEN tbl % 5 = 0 THEN chr(10) || 'region <= 16 x ' || (10 + tbl % 7) ELSE '' END || chr(10) || 'Q = A' AS source,
  (tbl % 3 = 0 OR tbl % 5 <> 0) AS ports_fit FROM f""")
def b_part_sequences(spark, t, sf_dir):
    f, tbl, none = _functions(t), F.col("tbl"), F.lit(None).cast("int")
    limits = [F.when(tbl % 2 == 0, tbl).otherwise(none), F.when(tbl % 3 == 0, tbl + 20).otherwise(none), F.when(tbl % 5 == 0, F.lit(16)).otherwise(none), F.when(tbl % 5 == 0, 10 + tbl % 7).otherwise(none)]
    n = F.col("id").cast("int")
    placed = spark.range(1, 7).select(n.alias("n_inputs"), grids.with_cells(grids.substrate(), grids.port_cells(specs.default_rows(n), specs.default_rows(F.lit(1)))).alias("placed"))  # a grid for each number of inputs
    text = texts.source(F.col("names"), F.array(F.lit("Q")), texts.constraint_lines(*limits), F.array(F.lit("Q = A")))
    z = F.when(tbl % 3 == 0, F.array(*map(F.lit, (1, 8, 14)))).when(tbl % 5 == 0, F.array(*map(F.lit, (1, 2, 14)))).otherwise(F.array(*map(F.lit, (14, 0, 2))))
    f = f.withColumn("n_inputs", F.lit(3)).join(F.broadcast(shared.stored(placed)), "n_inputs")
    own = f.select("p_partkey", "placed", specs.prefix_tokens(F.lit(3), F.lit(1), F.col("rows"), *limits).alias("prefix"), text.alias("source"), specs.ports_valid(z, F.lit(3)).alias("ports_fit"))
    return own.select("p_partkey", F.array_join("prefix", " ").alias("prefix"), F.md5(F.array_join(steps.sequence(F.col("prefix"), F.col("placed")), ",")).alias("sequence"), "source", "ports_fit")


@query("SELECT p_partkey, k::INT AS k, xor(k, k >> 1)::INT AS m, CASE WHEN k > 0 THEN xor(xor(k, k >> 1), xor(k - 1, (k - 1) >> 1)) END::INT AS flipped, ((p_partkey * 37 + p_size) % 256)::INT >> xor(k, k >> 1)::INT & 1 AS lit FROM part, range(8) r(k)")
def b_part_sweep(spark, t, sf_dir):
    """The order in which a table's rows are swept, one input turned at a time, and what each step should show."""
    swept = _functions(t).select("p_partkey", "rows", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    m = specs.gray(F.col("k"))
    return swept.select("p_partkey", "k", m.alias("m"), F.when(F.col("k") > 0, m.bitwiseXOR(specs.gray(F.col("k") - 1))).alias("flipped"), F.get("rows", m).cast("int").alias("lit"))


@query(f"""
WITH p AS (SELECT p_partkey, ((p_partkey * 37 + p_size) % 256)::INT AS want, (p_partkey % 256)::INT AS got FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda m: m || ':' || ((got >> m::INT) & 1) || '/' || ((want >> m::INT) & 1)), ' ') AS wrong, len(w)::INT AS n_wrong, array_to_string(list_transform(range(8), lambda m: (got >> m::INT) & 1), '') AS again
FROM (SELECT *, list_filter(range(8), lambda m: (want >> m::INT) & 1 <> (got >> m::INT) & 1) AS w FROM p)""")
def b_part_mismatches(spark, t, sf_dir):
    """Expected against observed tables row by row, and the observed one rebuilt from the expected and what was wrong."""
    f = _functions(t).withColumn("seen", specs.table_rows(F.col("p_partkey") % 256, 3)).withColumn("w", checks.mismatches(F.col("seen"), F.col("rows")))
    text = F.transform("w", lambda s: F.concat(s["inputs"].cast("string"), F.lit(":"), s["observed"].cast("string"), F.lit("/"), s["expected"].cast("string")))
    again = F.array_join(checks.rebuilt(F.col("rows"), F.col("w")), "")
    return f.select("p_partkey", F.array_join(text, " ").alias("wrong"), F.size("w").alias("n_wrong"), again.alias("again"))


# A line item as a verdict on a candidate.
_VERDICT = "SELECT (l_orderkey % 400)::BIGINT AS spec_hash, (l_orderkey * 100000 + l_linenumber * 10000 + l_partkey)::BIGINT AS cand_idx, (l_partkey % 60)::BIGINT AS tokens, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_suppkey % 3 = 0 THEN 'unstable' ELSE 'malformed' END WHEN l_quantity > 25 THEN 'pass' ELSE 'fail' END AS kind, (20 + l_partkey % 17)::INT AS blocks, (2 + l_suppkey % 5)::INT AS latency_rt, (l_linenumber % 4)::INT AS n_wrong FROM lineitem"


def _verdicts(t, specs: int = 400) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", F.when(s % 3 == 0, "unstable").otherwise("malformed")).when(F.col("l_quantity") > 25, "pass").otherwise("fail")
    return t("lineitem").select((F.col("l_orderkey") % specs).alias("spec_hash"), (F.col("l_orderkey") * 100000 + n * 10000 + p).alias("cand_idx"), (p % 60).alias("tokens"), kind.alias("kind"), (20 + p % 17).cast("int").alias("blocks"), (2 + s % 5).cast("int").alias("latency_rt"), (n % 4).cast("int").alias("n_wrong"), F.lit(None).cast("string").alias("constraint"))


_ONCE = f"SELECT spec_hash, tokens, min(cand_idx) AS cand_idx, arg_min(blocks, cand_idx) AS blocks, arg_min(latency_rt, cand_idx) AS latency_rt FROM ({_VERDICT}) WHERE kind = 'pass' GROUP BY ALL"
_TOOK = f"SELECT *, row_number() OVER (PARTITION BY spec_hash ORDER BY blocks, latency_rt, cand_idx)::INT AS place FROM ({_ONCE}) QUALIFY place <= 3"


@query(f"SELECT spec_hash, tokens, cand_idx, blocks, latency_rt, place FROM ({_TOOK})")
def b_accepted(spark, t, sf_dir):
    return loop.accepted(_verdicts(t), 3)


@query(f"""
WITH v AS ({_VERDICT}), a AS ({_TOOK}), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE tokens >= 20) AS novel, avg(blocks) AS b, avg(latency_rt) AS l FROM a),
d AS (SELECT avg(n) AS n FROM (SELECT count(DISTINCT tokens) AS n FROM v WHERE kind = 'pass' GROUP BY spec_hash)), s AS (SELECT count(DISTINCT o_orderkey % 500) AS n FROM orders)
SELECT any_value(s.n) AS specs, count(*) AS candidates, round(count(DISTINCT spec_hash) FILTER (WHERE cand_idx = 0 AND kind = 'pass') / any_value(s.n), 4) AS pass_at_1, round(count(DISTINCT spec_hash) FILTER (WHERE kind = 'pass') / any_value(s.n), 4) AS pass_at_k, any_value(c.n) AS accepted, round(any_value(b), 2) AS mean_blocks,
round(any_value(l), 2) AS mean_latency_rt, round(any_value(d.n), 2) AS layouts_per_spec, round(any_value(novel) / any_value(c.n), 4) AS novelty, round(count(*) FILTER (WHERE kind = 'unstable') / count(*), 4) AS unstable_rate, round(count(*) FILTER (WHERE kind = 'malformed') / count(*), 4) AS malformed_rate, round(count(*) FILTER (WHERE kind = 'fail') / count(*), 4) AS fail_rate FROM v, c, d, s""")
def b_round_report(spark, t, sf_dir):
    asked = t("orders").select((F.col("o_orderkey") % 500).alias("spec_hash")).distinct()
    known = t("lineitem").select((F.col("l_partkey") % 60).alias("tokens")).filter("tokens < 20").distinct()
    return loop.round_report(asked, _verdicts(t), known, 3)


@query(f"""
WITH v AS ({_VERDICT.replace("l_orderkey % 400", "l_orderkey")}), m AS (SELECT spec_hash, min(n_wrong) AS least, arg_min(tokens, (n_wrong, cand_idx)) AS tokens FROM v WHERE kind = 'fail' AND n_wrong > 0 AND spec_hash NOT IN (SELECT spec_hash FROM v WHERE kind = 'pass') GROUP BY 1)
SELECT spec_hash, tokens, spec_hash * 3 AS goal FROM m WHERE least = 1""")
def b_repairs(spark, t, sf_dir):
    """The closest misses of orders without a passing line."""
    v = _verdicts(t, 1 << 62)
    return loop.repairs(v, v.select("spec_hash").distinct().withColumn("tokens", F.col("spec_hash") * 3))


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'PASS latency=' || l_linenumber || 'rt blocks=' || l_quantity::INT || ' bbox=(16, ' || l_linenumber || ', 7)' WHEN l_returnflag = 'N' THEN 'FAIL ' || l_linenumber || ' row(s)' || CASE WHEN l_linestatus = 'F' THEN ' + constraint blocks' ELSE '' END WHEN l_linestatus = 'F' THEN 'UNSTABLE period=' || l_linenumber || 'gt' ELSE 'MALFORMED unsupported' END AS text,
  CASE WHEN l_linenumber > 5 THEN 'latency' WHEN l_quantity > 40 THEN 'blocks' WHEN l_suppkey % 20 > 16 OR l_partkey % 20 > 12 THEN 'region' END AS violated, ((l_linenumber + 1) // 2)::INT AS ticks,
  round(CASE WHEN l_orderkey % 121 < 10 THEN 0.003::DOUBLE * (l_orderkey % 121 + 1) / 10 ELSE 0.003::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least((l_orderkey % 121 - 10) / 90, 1)))) END, 9) AS rate FROM l WHERE k = 1""")
def b_verdict_lines(spark, t, sf_dir):
    """The first line of each order as a verdict in words, the constraint that it breaks, its ticks, a learning rate."""
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    own = t("lineitem").withColumn("k", first).filter("k = 1")
    flag, closed, n, q = F.col("l_returnflag"), F.col("l_linestatus") == "F", F.col("l_linenumber"), F.col("l_quantity").cast("int")
    kind = F.when(flag == "A", "pass").when(flag == "N", "fail").when(closed, "unstable").otherwise("malformed")
    text = checks.verdict_text(kind, n, q, F.struct(F.lit(16).alias("x"), n.alias("y"), F.lit(7).alias("z")), n, F.when(closed, "blocks"), n, F.lit("unsupported"))
    broken = checks.constraint_fault(n, q, F.col("l_suppkey") % 20, F.col("l_partkey") % 20, F.lit(5), F.lit(40), F.lit(16), F.lit(12))
    return own.select("l_orderkey", text.alias("text"), broken.alias("violated"), steps.redstone_ticks(n).alias("ticks"), F.round(steps.learning_rate(F.col("l_orderkey") % 121, F.lit(100), F.lit(10), F.lit(0.003)), 9).alias("rate"))


# An order as a net whose drivers are its suppliers' groups.
_NETS = "SELECT DISTINCT l_orderkey AS net, l_suppkey % 7 AS driver FROM lineitem"


def _nets(t) -> DataFrame:
    return t("lineitem").select(F.col("l_orderkey").alias("net"), (F.col("l_suppkey") % 7).alias("driver"))


@query(f"SELECT driver, count(*) AS fan_out, count(*) > 3 AS too_many, md5(array_to_string(list(net ORDER BY net), ',')) AS nets FROM ({_NETS}) GROUP BY driver")
def b_net_drivers(spark, t, sf_dir):
    lists = circuits.nets_of_driver(_nets(t)).select("driver", F.md5(F.array_join("nets", ",")).alias("nets"))
    return circuits.fan_out(_nets(t)).join(lists, "driver")


@query(f"WITH s AS (SELECT net, list(driver ORDER BY driver) AS d FROM ({_NETS}) GROUP BY net) SELECT net, min(net) OVER (PARTITION BY d) AS stands_for FROM s")
def b_shared_nets(spark, t, sf_dir):
    return circuits.shared_nets(_nets(t))


@query("""
WITH h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, event_type || floor(value / 40)::INT AS state FROM events), f AS (SELECT *, min(t) OVER (PARTITION BY user_id, state) AS since FROM h)
SELECT user_id AS sim, min(t)::INT AS t, (min(t) - arg_min(since, t))::INT AS period FROM f WHERE t > since GROUP BY user_id""")
def b_user_cycles(spark, t, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return circuits.cycles(t("events").select(F.col("user_id").alias("sim"), place.alias("t"), F.concat("event_type", F.floor(F.col("value") / 40).cast("string")).alias("state")))


# An embedding as a grid, as it is exported.
_TOKENS = f"list_transform(range({CELLS}), lambda i: CASE WHEN i < {LAYER} THEN 1 WHEN embedding[1 + i % len(embedding)] > 0 THEN (i * (label + 1)) % 44 ELSE 0 END)"


def _cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.stored(_grids(spark, sf_dir).select("name", tokens_of("tokens").alias("g")))


@query(f"SELECT token::INT AS token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM embeddings) GROUP BY token")
def b_grid_tokens(spark, t, sf_dir):
    return _cubes(spark, sf_dir).select(F.explode("g").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH g AS (SELECT 'vector/' || vec_id AS name, {_TOKENS} AS t FROM embeddings), u AS (SELECT *, list_filter(range({LAYER}, {CELLS}), lambda i: t[i + 1] <> 0) AS used FROM g)
SELECT name, len(used)::INT AS blocks, (list_max(list_transform(used, lambda i: i % 16)) - list_min(list_transform(used, lambda i: i % 16)) + 1)::INT AS x, (list_max(used) // 256 - list_min(used) // 256 + 1)::INT AS y, (list_max(list_transform(used, lambda i: i // 16 % 16)) - list_min(list_transform(used, lambda i: i // 16 % 16)) + 1)::INT AS z,
  '0,' || array_to_string(list_sort(list_distinct(list_transform(used, lambda i: i // 256))), ',') AS layers, len(list_filter(used, lambda i: t[i + 1] = 2))::INT AS wires FROM u""")
def b_grid_sizes(spark, t, sf_dir):
    g = F.col("g")
    box = grids.bounding_box(g)
    return _cubes(spark, sf_dir).select("name", grids.material_blocks(g).alias("blocks"), box["x"].alias("x"), box["y"].alias("y"), box["z"].alias("z"), F.array_join(grids.occupied_layers(g), ",").alias("layers"), F.size(F.filter(steps.found(g, "wire"), lambda i: i >= LAYER)).alias("wires"))


def _at(dx: int, dy: int, dz: int) -> str:
    """The token beside cell i of t, which reads as air outside."""
    fits = [f"i % 16 + {dx} BETWEEN 0 AND 15" if dx else "", f"i // 256 + {dy} >= 0" if dy else "", f"i // 16 % 16 + {dz} BETWEEN 0 AND 15" if dz else ""]
    return f"CASE WHEN {' AND '.join(x for x in fits if x)} THEN t[i + 1 + ({dy * 256 + dz * 16 + dx})] ELSE 0 END"


_BESIDE = f"CASE a WHEN 0 THEN {_at(0, -1, 0)} WHEN 1 THEN {_at(0, 0, -1)} WHEN 2 THEN {_at(0, 0, 1)} WHEN 3 THEN {_at(-1, 0, 0)} ELSE {_at(1, 0, 0)} END"
_FAULT = f"""CASE WHEN t[i + 1] = 2 AND NOT ({_at(0, -1, 0)} IN (1, 36, 37) OR {_at(0, -1, 0)} BETWEEN 38 AND 43) THEN 'floating_dust'
  WHEN t[i + 1] BETWEEN 3 AND 7 AND {_BESIDE.replace("CASE a", "CASE t[i + 1] - 3")} NOT IN (1, 36, 37) THEN 'unsupported' WHEN t[i + 1] BETWEEN 32 AND 35 AND {_BESIDE.replace("CASE a", "CASE t[i + 1] - 31")} NOT IN (1, 36, 37) THEN 'unsupported'
  WHEN t[i + 1] BETWEEN 32 AND 35 AND i NOT IN (256 + 16, 256 + 224) THEN 'port_violation' WHEN t[i + 1] BETWEEN 8 AND 31 AND NOT ({_at(0, -1, 0)} IN (1, 36, 37) OR {_at(0, -1, 0)} BETWEEN 38 AND 43) THEN 'unsupported'
  WHEN t[i + 1] = 36 AND i <> 256 + 127 THEN 'port_violation' WHEN t[i + 1] BETWEEN 38 AND 43 THEN 'excluded_block' END"""


@query(f"""
WITH g AS (SELECT 'vector/' || vec_id AS name, {_TOKENS} AS t0, vec_id FROM embeddings),
h AS (SELECT name, list_transform(range({CELLS}), lambda i: CASE WHEN i >= 512 THEN 0 WHEN vec_id % 3 = 0 AND i >= 256 AND t0[i + 1] NOT IN (0, 1, 2) THEN 1 WHEN vec_id % 50 = 7 AND i = 300 THEN 45 WHEN i >= 256 AND vec_id % 5 = 0 THEN 0 ELSE t0[i + 1] END) AS t FROM g),
f AS (SELECT name, t, list_filter(range({CELLS}), lambda i: ({_FAULT}) IS NOT NULL) AS bad FROM h),
m AS (SELECT *, CASE WHEN len(bad) > 0 THEN bad[1] WHEN t[1 + 272] NOT BETWEEN 32 AND 35 THEN 272 WHEN t[1 + 480] NOT BETWEEN 32 AND 35 THEN 480 WHEN t[1 + 383] <> 36 THEN 383 END AS i FROM f)
SELECT name, CASE WHEN len(bad) > 0 THEN {_FAULT} WHEN i IS NOT NULL THEN 'port_violation' END AS reason, i::INT AS cell, list_filter(range({CELLS}), lambda k: t[k + 1] >= 44)[1]::INT AS control FROM m""")
def b_grid_faults(spark, t, sf_dir):
    """The first structural fault of each grid's lowest layers, of which some are emptied, filled or given a control token."""
    vec = F.split("name", "/")[1].cast("long")
    own = _cubes(spark, sf_dir).withColumn("v", vec)
    cells = F.transform("g", lambda x, i: F.when(i >= 512, 0).when((F.col("v") % 3 == 0) & (i >= 256) & ~x.isin(0, 1, 2), 1).when((F.col("v") % 50 == 7) & (i == 300), 45).when((i >= 256) & (F.col("v") % 5 == 0), 0).otherwise(x))
    own = shared.stored(own.select("name", cells.alias("g")))
    fault = checks.structural_fault(F.col("g"), specs.default_rows(F.lit(2)), specs.default_rows(F.lit(1)))
    return own.select("name", fault.alias("f"), checks.control_cell(F.col("g")).alias("control")).select("name", "f.reason", "f.cell", "control")


@query("""
WITH RECURSIVE l AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY n_chars) AS b FROM documents UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, source, left(text, 9)) FROM documents),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b), r(x, y) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def b_document_clusters(spark, t, sf_dir):
    """Documents that equal lengths or equal beginnings connect, however far."""
    d = t("documents").select("doc_id", "n_chars", "lang", "source", F.substring("text", 1, 9).alias("begins"))
    keys = (["n_chars"], ["lang", "source", "begins"])
    links = [d.join(d.groupBy(*k).agg(F.min("doc_id").alias("b")), k).select(F.col("doc_id").alias("a"), "b") for k in keys]
    return circuits.connected(links[0].union(links[1]).filter("a <> b").distinct())
