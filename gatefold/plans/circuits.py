"""Queries over circuit data, which they build themselves; sf_dir is only there for the common signature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatefold import vocab
from gatefold.functions import grids, phrases, specs
from gatefold.operators import checks, circuits, loop, metrics, neighbours

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _functions(n: int) -> str:
    """DuckDB: non-constant functions of n inputs that depend on all."""
    rows = 1 << n
    dep = " AND ".join(f"EXISTS (SELECT 1 FROM range({rows}) g(m) WHERE (tbl >> m::INT) & 1 <> (tbl >> xor(m, {1 << k})::INT) & 1)" for k in range(n))
    return f"SELECT tbl FROM range({1 << rows}) t(tbl) WHERE tbl NOT IN (0, {(1 << rows) - 1}) AND {dep}"


@query(f"SELECT tbl, list_sum(list_transform(range(8), lambda m: (tbl >> m::INT) & 1))::BIGINT AS n_on FROM ({_functions(3)})")
def a_enum_functions(spark):
    return specs.enumerate_functions(spark, 3).select("tbl", F.aggregate("rows", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_on"))


@query("SELECT tbl, m::INT AS m, (tbl >> m::INT) & 1 AS bit FROM range(16) t(tbl), range(4) g(m)")
def a_truth_long(spark):
    return spark.range(16).select(F.col("id").alias("tbl"), F.posexplode(specs.table_rows(F.col("id"), 2)).alias("m", "bit"))


@query("""
WITH b AS (SELECT tbl, [2, 1] || flatten(list_transform(range(4), lambda m: [(tbl >> m::INT) & 1, 0, 0, 0, 0, 0, 0, 0])) AS bytes FROM range(16) t(tbl))
SELECT tbl, lpad(lower(format('{:x}', list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes::HUGEINT[]), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS key FROM b""")
def a_semantic_key(spark):
    rows = specs.table_rows(F.col("id"), 2)
    return spark.range(16).select(F.col("id").alias("tbl"), specs.semantic_key(F.lit(2), F.lit(1), rows).alias("key"))


@query(f"""
WITH f AS ({_functions(3)})
SELECT a.tbl AS query, b.tbl AS neighbour, bit_count(xor(a.tbl, b.tbl))::INT AS distance, row_number() OVER (PARTITION BY a.tbl ORDER BY bit_count(xor(a.tbl, b.tbl)), b.tbl)::INT AS place
FROM f a JOIN f b ON a.tbl <> b.tbl QUALIFY place <= 3""")
def a_hamming_knn(spark):
    f = specs.enumerate_functions(spark, 3).select("tbl", "n_inputs")
    return neighbours.nearest(f, f, ["n_inputs"], "tbl", "tbl", 3).select("query", "neighbour", "distance", "place")


@query("SELECT n, k, xor(k, k >> 1) AS m, CASE WHEN k > 0 THEN xor(xor(k, k >> 1), xor(k - 1, (k - 1) >> 1)) END AS flipped FROM (SELECT n, unnest(range(1 << n::INT))::INT AS k FROM range(1, 5) t(n))")
def a_gray_walk(spark):
    steps = spark.range(1, 5).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("id").cast("int")) - 1)).alias("k"))
    m = specs.gray(F.col("k"))
    return steps.select("n", "k", m.alias("m"), m.bitwiseXOR(F.lag(m).over(Window.partitionBy("n").orderBy("k"))).alias("flipped"))


@query("SELECT tbl, k::INT AS k, EXISTS (SELECT 1 FROM range(8) g(m) WHERE (tbl >> m::INT) & 1 <> (tbl >> xor(m, (1 << k::INT))::INT) & 1) AS depends FROM range(256) t(tbl), range(3) u(k)")
def a_depends_on(spark):
    df = spark.range(256).select(F.col("id").alias("tbl"), specs.table_rows(F.col("id"), 3).alias("rows"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return df.select("tbl", "k", specs.depends(F.col("rows"), F.col("k")).alias("depends"))


@query("""
WITH n(n_inputs, bits, name) AS (VALUES """ + ", ".join(f"({n}, '{b}', '{name}')" for n, b, name in specs.NAMED) + """),
t AS (SELECT 2 AS n_inputs, tbl, array_to_string(list_transform(range(4), lambda m: (tbl >> m::INT) & 1), '') AS bits FROM range(16) t(tbl))
SELECT t.tbl, n.name FROM t JOIN n USING (n_inputs, bits)""")
def a_named(spark):
    t = spark.range(16).select(F.lit(2).alias("n_inputs"), F.col("id").alias("tbl"), F.concat_ws("", specs.table_rows(F.col("id"), 2).cast("array<string>")).alias("bits"))
    return t.join(F.broadcast(specs.named(spark)), ["n_inputs", "bits"]).select("tbl", "name")


@query("""
SELECT token::INT AS token, CASE WHEN token = 0 THEN 'air' WHEN token = 1 THEN 'solid' WHEN token = 2 THEN 'wire' WHEN token < 8 THEN 'torch' WHEN token < 24 THEN 'repeater' WHEN token < 32 THEN 'comparator' WHEN token < 36 THEN 'lever' WHEN token = 36 THEN 'lamp' WHEN token = 37 THEN 'target' WHEN token < 44 THEN 'observer' ELSE ['pad', 'bos', 'eos', 'mask'][token - 43] END AS kind,
token IN (1, 36, 37) OR token BETWEEN 38 AND 43 AS opaque, token IN (1, 36, 37) AS conductive, token >= 44 AS control,
CASE WHEN token BETWEEN 8 AND 23 THEN ((token - 8) // 4)::INT WHEN token BETWEEN 24 AND 31 THEN ((token - 24) // 2)::INT WHEN token BETWEEN 38 AND 43 THEN (token - 38)::INT END AS facing,
CASE WHEN token BETWEEN 8 AND 23 THEN ((token - 8) % 4 + 1)::INT END AS delay FROM range(48) t(token)""")
def a_vocab(spark):
    return vocab.vocabulary(spark).select("token", "kind", "opaque", "conductive", "control", "facing", "delay")


def _walls(spark) -> DataFrame:
    """Fixture grids: a line of k wires behind an input, on the substrate, with a block of height h at (5, 1, 5)."""
    cells = F.map_from_entries(F.concat(
        F.transform(F.sequence(F.lit(2), F.lit(2) + F.col("k")), lambda x: F.struct(((F.lit(16) + 7) * 16 + x).alias("i"), F.lit(2).alias("t"))),
        F.transform(F.sequence(F.lit(1), F.col("h")), lambda y: F.struct(((y * 16 + 5) * 16 + 5).alias("i"), F.lit(1).alias("t"))),
    ))
    df = spark.range(12).select(F.col("id").alias("grid"), (F.col("id") % 6).cast("int").alias("k"), (F.col("id") % 4 + 1).cast("int").alias("h"))
    ports = grids.port_cells(F.array(F.lit(7)), F.array(F.lit(7)))
    # a shuffle, as a stored column would be: otherwise the optimiser writes the building of a grid into every use of it
    return df.withColumn("cells", grids.with_cells(grids.with_cells(grids.substrate(), cells), ports)).repartition("grid")


@query("SELECT id AS grid, (id % 6 + 1 + id % 4 + 1 + 3)::INT AS blocks, 16 AS x, (id % 4 + 1)::INT AS y, 3 AS z, '0' || array_to_string(list_transform(range(1, id % 4 + 2), lambda y: ',' || y), '') AS layers FROM range(12) t(id)")
def a_grid_stats(spark):
    g = _walls(spark)
    box = grids.bounding_box(F.col("cells"))
    return g.select("grid", grids.material_blocks(F.col("cells")).alias("blocks"), box["x"].alias("x"), box["y"].alias("y"), box["z"].alias("z"), F.concat_ws(",", grids.occupied_layers(F.col("cells")).cast("array<string>")).alias("layers"))


@query("SELECT * FROM (VALUES (0, NULL, NULL::INT), (1, 'floating_dust', 584), (2, 'unsupported', 583), (3, 'port_violation', 330), (4, 'excluded_block', 330), (5, 'port_violation', 368), (6, 'port_violation', 383)) v(fixture, reason, cell)")
def a_structural(spark):
    changes = spark.createDataFrame([(0, 0, 1), (1, 584, 2), (2, 583, 9), (3, 330, 36), (4, 330, 38), (5, 368, 0), (6, 383, 0)], "fixture int, i int, t int")
    ports = grids.port_cells(F.array(F.lit(7)), F.array(F.lit(7)))
    cells = grids.with_cells(grids.with_cells(grids.substrate(), ports), F.create_map("i", "t"))
    fault = checks.structural_fault(F.col("cells"), F.array(F.lit(7)), F.array(F.lit(7)))
    return changes.select("fixture", cells.alias("cells")).repartition("fixture").select("fixture", fault.alias("f")).select("fixture", F.col("f.reason").alias("reason"), F.col("f.cell").alias("cell"))


@query("SELECT (l * 4 + b * 2 + r)::INT AS fixture, CASE WHEN l = 1 THEN 'latency' WHEN b = 1 THEN 'blocks' WHEN r = 1 THEN 'region' END AS violated FROM range(2) t(l), range(2) u(b), range(2) v(r)")
def a_constraints(spark):
    c = F.col("fixture")
    df = spark.range(8).select(F.col("id").cast("int").alias("fixture"))
    fault = checks.constraint_fault(F.when(c >= 4, 5).otherwise(2), F.when(c % 4 >= 2, 50).otherwise(20), F.lit(8), F.when(c % 2 == 1, 9).otherwise(4), F.lit(3), F.lit(30), F.lit(16), F.lit(8))
    return df.select("fixture", fault.alias("violated"))


@query("SELECT m::INT AS inputs, (1 - (m = 3)::INT)::BIGINT AS observed, ((m = 1 OR m = 2)::INT)::BIGINT AS expected FROM range(4) t(m) WHERE 1 - (m = 3)::INT <> (m = 1 OR m = 2)::INT")
def a_mismatches(spark):
    wrong = checks.mismatches(specs.table_rows(F.lit(0b0111), 2), specs.table_rows(F.lit(0b0110), 2))
    return spark.range(1).select(F.explode(wrong).alias("w")).select("w.*")


_ROUNDS = [(k, 0.1 * k + 0.1 * (k % 2), max(0.5, 8.0 - 2.5 * k), max(0.0, 0.9 - 0.35 * k), 0.01 * k * k) for k in range(8)]


@query("WITH r(round, score, variety, fresh, unstable) AS (VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)" for k, a, b, c, d in _ROUNDS) + """), l AS (SELECT *, lag(score, 2) OVER w AS s0, lag(variety, 2) OVER w AS v0, lag(fresh, 2) OVER w AS f0, lag(unstable, 2) OVER w AS u0 FROM r WINDOW w AS (ORDER BY round))
SELECT round, score, variety, fresh, unstable, CASE WHEN score > s0 AND (variety < 0.7::DOUBLE * v0 OR fresh < 0.5::DOUBLE * f0) THEN 'collapsing' WHEN unstable > 2 * u0 + 0.01::DOUBLE THEN 'unstable' END AS alarm FROM l""")
def a_round_alarm(spark):
    return metrics.collapse(spark.createDataFrame(_ROUNDS, "round int, score double, variety double, fresh double, unstable double"), "round", "score", "variety", "fresh", "unstable")


_DRIVERS = [(0, "a"), (0, "b"), (1, "a"), (2, "a"), (3, "a"), (3, "c"), (4, "b"), (5, "b"), (6, "a"), (6, "b")]
_SQL_DRIVERS = "(VALUES " + ", ".join(f"({n}, '{d}')" for n, d in _DRIVERS) + ") v(net, driver)"


def _drivers(spark) -> DataFrame:
    return spark.createDataFrame(_DRIVERS, "net int, driver string")


@query(f"SELECT driver, count(DISTINCT net) AS fan_out, count(DISTINCT net) > 3 AS too_many FROM {_SQL_DRIVERS} GROUP BY driver")
def a_netlist_fanout(spark):
    return circuits.fan_out(_drivers(spark))


@query(f"WITH s AS (SELECT net, list(DISTINCT driver ORDER BY driver) AS d FROM {_SQL_DRIVERS} GROUP BY net) SELECT net, min(net) OVER (PARTITION BY d) AS stands_for FROM s")
def a_netlist_sharing(spark):
    return circuits.shared_nets(_drivers(spark))


_EDGES = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 5), (5, 7), (2, 7)]


@query("WITH RECURSIVE e(source, target) AS (VALUES " + ", ".join(map(str, _EDGES)) + """), c(node, depth) AS (SELECT DISTINCT source, 0 FROM e WHERE source NOT IN (SELECT target FROM e) UNION ALL SELECT e.target, c.depth + 1 FROM c JOIN e ON e.source = c.node)
SELECT node, max(depth) AS depth FROM c GROUP BY node""")
def a_netlist_depth(spark):
    return circuits.depth(spark.createDataFrame(_EDGES, "source int, target int"))


@query("SELECT g AS grid, x::INT AS node, greatest(15 - x, CASE WHEN g = 1 THEN 9 - abs(x - 12) ELSE 0 END)::INT AS strength FROM range(2) t(g), range(20) u(x) WHERE greatest(15 - x, CASE WHEN g = 1 THEN 9 - abs(x - 12) ELSE 0 END) > 0")
def a_dust_reach(spark):
    links = spark.range(2).select(F.col("id").alias("grid"), F.explode(F.sequence(F.lit(0), F.lit(18))).alias("a")).withColumn("b", F.col("a") + 1)
    seeds = spark.createDataFrame([(0, 0, 15), (1, 0, 15), (1, 12, 9)], "grid long, node int, strength int")
    return circuits.dust_strength(links, seeds)


@query("""
WITH s AS (SELECT tbl, list_concat(list_concat([1, 3, 18, 4, 17], CASE WHEN tbl % 2 = 0 THEN [6, 16 + least(tbl * 9, 63)] ELSE [] END), flatten(list_transform(range(4), lambda m: [5, 16 + ((tbl >> m::INT) & 1)]))) || [9] AS p FROM range(16) t(tbl))
SELECT tbl, array_to_string(list_resize(p, 32, 0), ' ') AS prefix FROM s""")
def a_prefix_tokens(spark):
    none = F.lit(None).cast("int")
    t = F.col("id")
    tokens = specs.prefix_tokens(F.lit(2), F.lit(1), specs.table_rows(t, 2), F.when(t % 2 == 0, (t * 9).cast("int")), none, none, none)
    return spark.range(16).select(t.alias("tbl"), F.concat_ws(" ", tokens.cast("array<string>")).alias("prefix"))


@query("""
WITH r AS (SELECT tbl, list_filter(range(4), lambda m: (tbl >> m::INT) & 1 = 1) AS ons FROM range(1, 15) t(tbl)),
d(m, words) AS (VALUES (0, 'A and B are off'), (1, 'A is on and B is off'), (2, 'B is on and A is off'), (3, 'A and B are on'))
SELECT tbl, CASE WHEN len(ons) = 1 THEN 'the lamp turns on only when ' || (SELECT min(words) FROM d WHERE d.m = ons[1]) WHEN len(ons) = 3 THEN 'the lamp stays on except when ' || (SELECT min(words) FROM d WHERE NOT list_contains(ons, d.m)) ELSE 'the lamp lights when ' || (SELECT min(words) FROM d WHERE d.m = ons[1]) || ' or when ' || (SELECT min(words) FROM d WHERE d.m = ons[2]) END AS prompt FROM r""")
def a_paraphrase(spark):
    names = F.array(F.lit("A"), F.lit("B"))
    return spark.range(1, 15).select(F.col("id").alias("tbl"), phrases.functional(names, specs.table_rows(F.col("id"), 2), F.lit("switch"), F.lit("lamp")).alias("prompt"))


@query("SELECT m::INT AS m, ((1 - (m & 1) * (m >> 1 & 1)) + 2 * xor(m & 1, (m >> 1 & 1) & (m >> 2 & 1)) + 4 * (1 - ((m >> 2 & 1) | (m & 1))))::BIGINT AS outputs FROM range(8) t(m)")
def a_rules(spark):
    return specs.truth_table(spark, ["A", "B", "C"], {"Y": "!(A & B)", "X": "delay(A, 2) ^ B & strength(C, 3)", "Z": "not (C or A)"})


@query("SELECT tbl, CASE WHEN tbl > 0 THEN array_to_string(list_transform(list_filter(range(4), lambda m: (tbl >> m::INT) & 1 = 1), lambda m: '(' || CASE WHEN m & 1 = 1 THEN 'A' ELSE '!A' END || ' & ' || CASE WHEN m >> 1 & 1 = 1 THEN 'B' ELSE '!B' END || ')'), ' | ') END AS sop FROM range(16) t(tbl)")
def a_sum_of_products(spark):
    return spark.range(16).select(F.col("id").alias("tbl"), specs.sum_of_products(specs.table_rows(F.col("id"), 2), F.array(F.lit("A"), F.lit("B"))).alias("sop"))


@query("SELECT n::INT AS n, CASE n WHEN 1 THEN '7' WHEN 2 THEN '1,14' WHEN 3 THEN '1,8,14' WHEN 4 THEN '1,5,10,14' WHEN 5 THEN '1,4,8,11,14' ELSE '1,4,6,9,11,14' END AS z FROM range(1, 7) t(n)")
def a_default_ports(spark):
    n = F.col("id").cast("int")
    return spark.range(1, 7).select(n.alias("n"), F.concat_ws(",", specs.default_rows(n).cast("array<string>")).alias("z"))


@query("SELECT * FROM (VALUES (0, 4, 2), (1, 7, 4)) v(sim, t, period)")
def a_cycles(spark):
    rows = [(0, t, [10, 11, 12, 13, 12, 13][t]) for t in range(6)] + [(1, t, [0, 1, 2, 3, 4, 5, 6, 3][t]) for t in range(8)]
    return circuits.cycles(spark.createDataFrame(rows, "sim int, t int, state int"))


@query("SELECT i::INT AS i, (i % 16)::INT AS x, (i // 256)::INT AS y, (i // 16 % 16)::INT AS z, (i % 16 + i // 256 * 256 + (i // 16 % 16) * 16)::INT AS back FROM range(1536) t(i)")
def a_geometry(spark):
    i = F.col("id").cast("int")
    p = vocab.place(i)
    return spark.range(vocab.CELLS).select(i.alias("i"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), vocab.index(p["x"], p["y"], p["z"]).cast("int").alias("back"))


@query("SELECT tbl, array_to_string(list_transform(range(4), lambda m: (tbl >> ((m >> 1 & 1) * 1 + (m & 1) * 4)::INT) & 1), ',') AS kept FROM range(0, 256, 5) t(tbl)")
def a_restrict(spark):
    return spark.range(0, 256, 5).select(F.col("id").alias("tbl"), F.concat_ws(",", specs.restrict(specs.table_rows(F.col("id"), 3), [0, 2]).cast("array<string>")).alias("kept"))


_VERDICTS = [(f"s{g}", i, (g * 7 + i * 3) % 5, ["pass", "fail", "pass", "unstable", "malformed"][(g + i) % 5], 20 + (g * i) % 7, 2 + (g + i) % 3, (g + i) % 3, None) for g in range(6) for i in range(5) if g != 4]
_SQL_VERDICTS = "(VALUES " + ", ".join(f"('{h}', {i}, {t}, '{k}', {b}, {lat}, {w})" for h, i, t, k, b, lat, w, _ in _VERDICTS) + ") v(spec_hash, cand_idx, tokens, kind, blocks, latency_rt, n_wrong)"


def _verdicts(spark) -> DataFrame:
    return spark.createDataFrame(_VERDICTS, "spec_hash string, cand_idx int, tokens int, kind string, blocks int, latency_rt int, n_wrong int, constraint string")


_SQL_ACCEPTED = f"SELECT spec_hash, tokens, cand_idx, blocks, latency_rt, row_number() OVER (PARTITION BY spec_hash ORDER BY blocks, latency_rt, cand_idx)::INT AS place FROM (SELECT * FROM {_SQL_VERDICTS} WHERE kind = 'pass' QUALIFY row_number() OVER (PARTITION BY spec_hash, tokens ORDER BY cand_idx) = 1) QUALIFY place <= 2"


@query(_SQL_ACCEPTED)
def a_accepted(spark):
    return loop.accepted(_verdicts(spark), 2)


@query(f"""
WITH v AS (SELECT * FROM {_SQL_VERDICTS}), a AS ({_SQL_ACCEPTED}), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE tokens NOT IN (0, 1)) AS novel, avg(blocks) AS b, avg(latency_rt) AS l FROM a),
d AS (SELECT avg(n) AS n FROM (SELECT count(DISTINCT tokens) AS n FROM v WHERE kind = 'pass' GROUP BY spec_hash))
SELECT 6::BIGINT AS specs, count(*) AS candidates, round(count(DISTINCT spec_hash) FILTER (WHERE cand_idx = 0 AND kind = 'pass') / 6, 4) AS pass_at_1, round(count(DISTINCT spec_hash) FILTER (WHERE kind = 'pass') / 6, 4) AS pass_at_k, any_value(c.n) AS accepted, round(any_value(b), 2) AS mean_blocks, round(any_value(l), 2) AS mean_latency_rt,
round(any_value(d.n), 2) AS layouts_per_spec, round(any_value(novel) / any_value(c.n), 4) AS novelty, round(count(*) FILTER (WHERE kind = 'unstable') / count(*), 4) AS unstable_rate, round(count(*) FILTER (WHERE kind = 'malformed') / count(*), 4) AS malformed_rate, round(count(*) FILTER (WHERE kind = 'fail') / count(*), 4) AS fail_rate FROM v, c, d""")
def a_round_report(spark):
    return loop.round_report(spark.range(6), _verdicts(spark), spark.createDataFrame([(0,), (1,)], "tokens int"), 2)


@query("SELECT * FROM (VALUES ('pass', 'PASS latency=2rt blocks=29 bbox=(16, 1, 7)'), ('fail', 'FAIL 2 row(s) + constraint latency'), ('unstable', 'UNSTABLE period=4gt'), ('malformed', 'MALFORMED unsupported')) v(kind, text)")
def a_verdict_text(spark):
    rows = [("pass", 2, 29, (16, 1, 7), 0, None, None, None), ("fail", None, None, None, 2, "latency", None, None), ("unstable", None, None, None, 0, None, 4, None), ("malformed", None, None, None, 0, None, None, "unsupported")]
    df = spark.createDataFrame(rows, "kind string, latency int, blocks int, box struct<x:int,y:int,z:int>, wrong int, constraint string, period int, reason string")
    return df.select("kind", checks.verdict_text(*map(F.col, ("kind", "latency", "blocks", "box", "wrong", "constraint", "period", "reason"))).alias("text"))


@query("SELECT * FROM (VALUES (0, 'unclassified'), (1, 'update-order'), (2, 'weak-vs-strong-power'), (3, 'torch-burnout'), (4, 'unclassified')) v(fixture, class)")
def a_divergence_class(spark):
    rows = spark.createDataFrame([(0, None, True, 0, 0), (1, 1, False, 0, 0), (2, 1, True, 370, 2), (3, 1, True, 370, 3), (4, 1, True, 370, 1)], "fixture int, seen int, settled boolean, i int, t int")
    cells = grids.with_cells(grids.with_cells(grids.substrate(), F.create_map(F.lit(371), F.lit(1), F.lit(372), F.lit(2))), F.create_map("i", "t"))
    return rows.withColumn("g", cells).repartition("fixture").select("fixture", checks.divergence_class(F.col("seen"), F.col("settled"), F.col("g")).alias("class"))
