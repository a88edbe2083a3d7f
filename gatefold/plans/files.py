"""Queries that write records, texts, grids and cases of the given tables as files and read them again, and some that carry
references and faults over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatefold.functions import random_specs, specs, steps, texts
from gatefold.operators import examples, loop
from gatefold.plans.derived import _LINE, _TOKENS, _cubes
from gatefold.plans.records import _HASH, _HEAD, _SPECS, _specs
from gatefold.sources import records, shared
from gatefold.vocab import CELLS, LAYER


def b_example_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each part, as JSON Lines by split, read back strictly, with the split that it came from."""
    own = random_specs.with_identity(_specs(spark, sf_dir))
    n = F.col("seed").cast("int") % 200
    layouts = own.select(
        "seed", F.lit("pass").alias("kind"), specs.default_rows(F.col("n_inputs")).alias("input_z"), specs.default_rows(F.lit(1)).alias("output_z"), n.alias("tokens"),
        F.lit(3).alias("latency_rt"), n.alias("blocks"), F.array(F.lit(16), F.lit(1), F.lit(16)).alias("bbox"),
    )
    rows = examples.examples(own, layouts, own.select("seed", F.concat(F.lit('say "'), "rule", F.lit('"')).alias("prompt")), "seed")
    # the joins carry a number for each grid, which is made where it is written
    grid = F.concat(F.array_repeat(F.lit(1), LAYER), F.array_repeat(F.lit(2), F.col("tokens")), F.array_repeat(F.lit(0), F.lit(CELLS - LAYER) - F.col("tokens")))
    path = shared.new_path(spark)
    records.write_examples(rows.withColumn("tokens", grid).withColumn("split", F.when(F.col("blocks") % 10 == 0, "test").otherwise("train")), path)
    parts = [records.read_examples(spark, f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "test")]
    back = parts[0].unionByName(parts[1])
    return back.select("split", "spec_source", "spec_hash", "gates", "n_inputs", F.array_join("rows", "").alias("bits"), F.array_join("input_z", ",").alias("input_z"), F.md5(F.array_join("tokens", ",")).alias("tokens"), "blocks", F.element_at("prompts", 1).alias("prompt"))


def b_spec_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file with a title for each nation's specification, read back whole."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    drawn = random_specs.random_specs(nations, "n_nationkey")
    text = F.concat(F.lit("#  of "), "n_name", F.lit(" \n"), random_specs.as_source(ascii_only=True))
    path = shared.new_path(spark)
    drawn.join(nations, F.col("seed") == F.col("n_nationkey")).select("seed", text.alias("value")).write.partitionBy("seed").text(path)
    back = records.read_specs(spark, f"{path}/*/*.txt")
    return back.select(F.regexp_extract("path", r"seed=(\d+)", 1).cast("long").alias("seed"), "title", "source")


def b_grid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids as JSON arrays, a line each; of equal ones how many there are."""
    path = shared.new_path(spark)
    _cubes(spark, sf_dir).select(F.to_json("g").alias("value")).write.text(path)
    return records.read_grids(spark, path).groupBy(F.md5(F.array_join("tokens", ",")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def b_case_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases behind a header, one for each order, appended in two runs of which the second finds the first's there."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cases = orders.select(F.concat(F.lit("case-"), "o_orderkey").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    path, shape = shared.new_path(spark), "name string, status string, price double"
    spark.createDataFrame([('{"format": "cases", "seed": 7}',)], "value string").coalesce(1).write.text(path)
    for part in (cases.filter("status = 'F'"), cases):
        records.append_new(part, path, "name", shared.stored(records.read_cache(spark, path, 7, shape)))
    return records.read_cache(spark, path, 7, shape)


def b_reference_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layouts of parts as references and those of their first lines as newcomers: who has the fewer cells stays, by the
    old count, which has the substrate's in it, and by the right one."""
    row = lambda n: F.concat(F.array_repeat(F.lit(1), LAYER), F.array_repeat(F.lit(2), n))
    old = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("spec_hash"), row(F.col("p_size")).alias("tokens"))
    first = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    new = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("k", first).filter("k = 1").select((F.col("l_partkey") * 2).alias("spec_hash"), row(F.col("l_quantity").cast("int")).alias("tokens"), F.col("l_quantity").cast("int").alias("blocks"))
    parts = [loop.updated_reference(old, new, fixed).select("spec_hash", F.lit(fixed).alias("fixed"), (F.size("tokens") - LAYER).alias("cells")) for fixed in (False, True)]
    return parts[0].unionByName(parts[1])


def b_world_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cubes(spark, sf_dir).select("name", specs.world_fingerprint(F.transform("g", lambda t: t * 100_003)).alias("fingerprint"))


def b_spec_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a specification put together from each line item's numbers, in which every fault occurs."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_LINE.split(", "))
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    empty = F.array().cast("array<string>")
    ins = F.slice(F.array(*map(F.lit, "ABCDEFGH")), F.lit(1), n % 8)
    outs = F.concat(F.array(F.lit("Q")), F.when(p % 11 == 0, F.array(F.lit("A"))).otherwise(empty), F.when(s % 10 == 9, F.array(*[F.lit(f"R{k}") for k in range(6)])).otherwise(empty))
    rule = F.get(F.array(F.lit("A ∨ B"), F.lit("A and !C xor B"), F.lit("delay(A, 2)")), (p % 3).cast("int"))
    one = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("expression"))
    rules = F.when(p % 13 == 0, F.slice(F.array(one("Q", rule)), 1, 0)).when(s % 9 == 0, F.array(one("Q", rule), one("Z", F.lit("A")))).otherwise(F.array(one("Q", rule)))
    return lines.select(*_LINE.split(", "), texts.spec_fault(ins, outs, rules).alias("fault"))


def b_model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a model as wide as 64 times each part's size."""
    width = F.col("p_size").cast("long") * 64
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", steps.parameters(F.lit(128), width, F.lit(12), width * 3).alias("parameters"))


QUERIES = {f.__name__: f for f in (b_example_files, b_spec_files, b_grid_files, b_case_cache, b_reference_update, b_world_fingerprints, b_spec_faults, b_model_sizes)}

_Z = "['7', '1,14', '1,8,14', '1,5,10,14'][n]"
ORACLE_SQL = {
    "b_example_files": f"""
WITH RECURSIVE {_SPECS}
SELECT CASE WHEN seed % 200 % 10 = 0 THEN 'test' ELSE 'train' END AS split, {_HEAD} || CASE WHEN kind = 0 THEN chr(10) || 'latency <= ' || max_latency WHEN kind = 1 THEN chr(10) || 'footprint <= ' || max_blocks WHEN kind = 2 THEN chr(10) || 'region <= 16 x ' || region_z ELSE '' END || chr(10) || 'Q = ' || rule AS spec_source,
  {_HASH} AS spec_hash, gates, n AS n_inputs, array_to_string(bits, '') AS bits, {_Z} AS input_z, md5(array_to_string(list_transform(range({CELLS}), lambda i: CASE WHEN i < {LAYER} THEN 1 WHEN i < {LAYER} + seed % 200 THEN 2 ELSE 0 END), ',')) AS tokens, (seed % 200)::INT AS blocks, 'say "' || rule || '"' AS prompt FROM z""",
    "b_spec_files": f"""
WITH RECURSIVE {_SPECS.replace("SELECT DISTINCT p_partkey AS seed", "SELECT DISTINCT n_nationkey AS seed").replace("p_partkey || '/'", "n_nationkey || '/'").replace("FROM part,", "FROM nation,")}
SELECT seed, 'of ' || n_name AS title, '#  of ' || n_name || ' ' || chr(10) || {_HEAD} || CASE WHEN kind = 0 THEN chr(10) || 'latency <= ' || max_latency WHEN kind = 1 THEN chr(10) || 'footprint <= ' || max_blocks WHEN kind = 2 THEN chr(10) || 'region <= 16 x ' || region_z ELSE '' END || chr(10) || 'Q = ' || translate(rule, '¬∧∨⊕', '!&|^') || chr(10) AS source
FROM z JOIN nation ON n_nationkey = seed""",
    "b_grid_files": f"SELECT md5(array_to_string({_TOKENS}, ',')) AS digest, count(*) AS n FROM embeddings GROUP BY 1",
    "b_case_cache": "SELECT 'case-' || o_orderkey AS name, o_orderstatus AS status, o_totalprice AS price FROM orders",
    "b_reference_update": f"""
WITH n AS (SELECT l_partkey * 2 AS h, l_quantity::INT AS blocks FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) = 1)
SELECT coalesce(p_partkey, h) AS spec_hash, fixed, CASE WHEN p_partkey IS NULL OR blocks < p_size + CASE WHEN fixed THEN 0 ELSE {LAYER} END THEN blocks ELSE p_size END AS cells FROM part FULL JOIN n ON h = p_partkey, (VALUES (false), (true)) f(fixed)""",
    "b_world_fingerprints": f"""
WITH g AS (SELECT vec_id, list_transform({_TOKENS}, lambda t: t * 100003) AS t FROM embeddings)
SELECT 'vector/' || vec_id AS name, lpad(lower(format('{{:x}}', list_reduce(list_prepend(14695981039346656037::HUGEINT, t::HUGEINT[]), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS fingerprint FROM g""",
    "b_spec_faults": f"""
WITH c AS (SELECT {_LINE}, l_linenumber % 8 AS n, list_slice(['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'], 1, l_linenumber % 8) AS ins, CASE l_partkey % 3 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['A', 'B', 'C'] ELSE ['A'] END AS refs FROM lineitem),
f AS (SELECT *, list_filter(refs, lambda r: NOT list_contains(ins, r)) AS unknown, list_filter(ins, lambda i: NOT list_contains(refs, i)) AS unused FROM c)
SELECT {_LINE}, CASE WHEN l_partkey % 13 = 0 THEN 'no rule' WHEN n > 6 THEN n || ' inputs exceed 6' WHEN l_suppkey % 10 = 9 THEN CASE WHEN l_partkey % 11 = 0 THEN 8 ELSE 7 END || ' outputs exceed 6' WHEN l_partkey % 11 = 0 AND n > 0 THEN 'A both input and output'
  WHEN l_partkey % 11 = 0 THEN 'no rule for A' WHEN l_suppkey % 9 = 0 THEN 'no outputs: Z' WHEN len(unknown) > 0 THEN 'Q refers to ' || array_to_string(unknown, ', ') WHEN len(unused) > 0 THEN 'unused: ' || array_to_string(unused, ', ') END AS fault FROM f""",
    "b_model_sizes": f"SELECT p_partkey, 128 * w + {CELLS} * w + 12 * (4 * w * w + 3 * w * (w * 3)) + w * 128 AS parameters FROM (SELECT p_partkey, p_size::BIGINT * 64 AS w FROM part)",
}
