"""Queries over the driver's tables: each applies a library operator, beside the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatefold.functions import phrases
from gatefold.operators import circuits, corpus, kernels, metrics, neighbours, ordered, sampling, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_KEY = r"md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"


@query(f"""
WITH d AS (SELECT *, {_KEY} AS k FROM documents), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1),
c AS (SELECT * FROM f WHERE k NOT IN (SELECT {_KEY} FROM benchmark)),
s AS (SELECT *, CASE WHEN (n_chars // 200) % 10 = 0 THEN 'test' WHEN (n_chars // 200) % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM c)
SELECT split, count(*) AS n, count(DISTINCT k) AS n_keys, round(avg(n_chars), 4) AS mean_size, max(n_chars) AS max_size FROM s GROUP BY split""")
def b_corpus_report(t):
    docs = corpus.first_occurrence(t("documents").select("doc_id", "n_chars", corpus.canonical_key("text").alias("k")), "k", "doc_id")
    clean = corpus.unseen(docs, t("benchmark").select(corpus.canonical_key("text").alias("bk")), "k", "bk")
    return corpus.report(clean.withColumn("split", corpus.whole_bucket(F.floor(F.col("n_chars") / 200), [0], 10)), "split", "n_chars", "k")


@query(f"SELECT k, min(doc_id) AS doc_id FROM (SELECT doc_id, {_KEY} AS k FROM documents) GROUP BY k")
def b_exact_dedup(t):
    return corpus.first_occurrence(t("documents").select("doc_id", corpus.canonical_key("text").alias("k")), "k", "doc_id").select("k", "doc_id")


@query(f"SELECT k, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, {_KEY} AS k FROM documents) GROUP BY k HAVING count(*) > 1")
def b_dup_groups(t):
    return t("documents").select("doc_id", corpus.canonical_key("text").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


@query(f"""
WITH d AS (SELECT doc_id, {_KEY} AS k, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM documents),
te AS (SELECT k, min(doc_id) AS doc_id FROM d WHERE split = 'test' GROUP BY k ORDER BY doc_id LIMIT 50),
va AS (SELECT k, min(doc_id) AS doc_id FROM d WHERE split = 'val' GROUP BY k HAVING k NOT IN (SELECT k FROM te) ORDER BY doc_id LIMIT 50),
tr AS (SELECT k, min(doc_id) AS doc_id FROM d WHERE split = 'train' GROUP BY k HAVING k NOT IN (SELECT k FROM te) AND k NOT IN (SELECT k FROM va) ORDER BY doc_id LIMIT 500)
SELECT 'test' AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM te UNION ALL SELECT 'val', count(*), sum(doc_id)::BIGINT FROM va UNION ALL SELECT 'train', count(*), sum(doc_id)::BIGINT FROM tr""")
def b_ordered_splits(t):
    part = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "val").otherwise("train")
    d = t("documents").select("doc_id", corpus.canonical_key("text").alias("k"), part.alias("split"))
    picked = corpus.ordered_splits(d, [("test", 50), ("val", 50), ("train", 500)], "k", "doc_id", "split")
    return picked.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(f"""
WITH d AS (SELECT {_KEY} AS k, CASE WHEN (n_chars // 200) % 10 = 0 THEN 'test' WHEN (n_chars // 200) % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM documents)
SELECT k, count(DISTINCT split) AS n_splits FROM d GROUP BY k HAVING count(DISTINCT split) > 1""")
def b_split_leakage(t):
    d = t("documents").select(corpus.canonical_key("text").alias("k"), corpus.whole_bucket(F.floor(F.col("n_chars") / 200), [0], 10).alias("split"))
    return d.groupBy("k").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


@query(f"""
WITH d AS (SELECT {_KEY} AS k FROM documents), b AS (SELECT DISTINCT {_KEY} AS k FROM benchmark)
SELECT count(*) AS n, count(*) FILTER (WHERE b.k IS NULL) AS n_new, round(coalesce(avg((b.k IS NULL)::INT), 0.0), 4) AS novelty FROM d LEFT JOIN b ON d.k = b.k""")
def b_contamination(t):
    return metrics.novelty(t("documents").select(corpus.canonical_key("text").alias("k")), t("benchmark").select(corpus.canonical_key("text").alias("k")), "k")


_REASON = "CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 10000 THEN 'long' WHEN regexp_matches(text, '[0-9]{6,}') THEN 'digits' END"


def _first_reason(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.when(c.isNull() | (F.length(F.trim(c)) == 0), "empty").when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 10000, "long").when(c.rlike("[0-9]{6,}"), "digits").alias("reason")).filter("reason IS NOT NULL")


@query(f"SELECT * FROM (SELECT doc_id, {_REASON} AS reason FROM documents) WHERE reason IS NOT NULL")
def b_first_reason(t):
    return _first_reason(t)


@query(f"SELECT string_agg(reason || '=' || n, ';' ORDER BY reason) AS histogram FROM (SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason)")
def b_reason_hist(t):
    return ordered.histogram(_first_reason(t), "reason")


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 4) AS rate FROM events GROUP BY event_type")
def b_verdict_rates(t):
    return metrics.rates(t("events").select("event_type"), "event_type")


@query("""
WITH r AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
p AS (SELECT user_id, max((ok AND idx < 1)::INT) AS p1, max((ok AND idx < 8)::INT) AS p8, max((ok AND idx < 64)::INT) AS p64 FROM r GROUP BY user_id)
SELECT round(avg(p1), 4) AS pass_at_1, round(avg(p8), 4) AS pass_at_8, round(avg(p64), 4) AS pass_at_64 FROM p""")
def b_pass_at_k(t):
    return metrics.pass_at_k(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")


@query("SELECT p_brand, p_partkey, p_size, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) = 1")
def b_best_candidate(t):
    return metrics.best(t("part"), "p_brand", ["p_size", "p_retailprice", "p_partkey"], ["p_partkey", "p_size", "p_retailprice"])


@query("""
WITH u AS (SELECT p_brand, p_size, p_retailprice, min(p_partkey) AS p_partkey FROM part GROUP BY ALL)
SELECT p_brand, p_size, p_retailprice, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS place FROM u QUALIFY place <= 4""")
def b_keep_top4(t):
    return metrics.keep_per_group(t("part").select("p_brand", "p_size", "p_retailprice", "p_partkey"), "p_brand", ["p_size", "p_retailprice"], ["p_size", "p_retailprice", "p_partkey"], 4).withColumn("place", F.col("place").cast("long"))


@query("""
WITH w AS (SELECT o_orderkey, o_custkey, count(*) FILTER (WHERE l_linestatus = 'O') AS wrong FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT *, min(wrong) OVER (PARTITION BY o_custkey) AS least FROM w WHERE wrong > 0)
SELECT o_custkey, o_orderkey FROM m WHERE least = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY wrong, o_orderkey) = 1""")
def b_closest_miss(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_linestatus") == "O").alias("wrong"))
    return metrics.closest_miss(t("orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey"), "o_custkey", "wrong", ["o_orderkey"], ["o_orderkey"])


@query("""
WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS base FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(avg(o_totalprice / base), 4) AS mean_ratio FROM orders JOIN l ON l_orderkey = o_orderkey WHERE base > 0""")
def b_compactness(t):
    base = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("base"))
    return metrics.mean_ratio(t("orders").select("o_orderkey", "o_totalprice"), base, "o_orderkey", "o_totalprice", "base")


@query("""
WITH d AS (SELECT o_orderkey, c_mktsegment AS segment, min(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS delay FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT segment, avg(delay) AS base FROM d GROUP BY 1)
SELECT count(*) AS n, round(avg(delay / base), 4) AS mean_ratio FROM d JOIN m USING (segment) WHERE base > 0""")
def b_latency_ratio(t):
    first = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    delay = t("orders").join(first, "o_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey").select("segment", F.date_diff("ship", "o_orderdate").alias("delay"))
    return metrics.mean_ratio(delay, delay.groupBy("segment").agg(F.avg("delay").alias("base")), "segment", "delay", "base")


@query("SELECT count(*) AS n_groups, round(avg(d), 3) AS diversity FROM (SELECT count(DISTINCT l_partkey) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey)")
def b_diversity(t):
    return metrics.diversity(t("lineitem").filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query("""
WITH m AS (SELECT min(l_shipdate) + INTERVAL 30 DAY AS cut FROM lineitem), e AS (SELECT DISTINCT l_partkey FROM lineitem, m WHERE l_shipdate < cut),
l AS (SELECT l_partkey FROM lineitem, m WHERE l_shipdate >= cut)
SELECT count(*) AS n, count(*) FILTER (WHERE e.l_partkey IS NULL) AS n_new, round(coalesce(avg((e.l_partkey IS NULL)::INT), 0.0), 4) AS novelty FROM l LEFT JOIN e ON l.l_partkey = e.l_partkey""")
def b_novelty(t):
    rows = t("lineitem").select("l_partkey", "l_shipdate")
    cut = rows.agg((F.min("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("cut"))
    dated = rows.join(F.broadcast(cut))  # one row
    return metrics.novelty(dated.filter("l_shipdate >= cut").select("l_partkey"), dated.filter("l_shipdate < cut").select("l_partkey"), "l_partkey")


@query("SELECT quality, count(*) AS n, round(avg((quality = (n_chars > 500)::INT)::INT), 4) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def b_per_class(t):
    rows = t("labels").select("doc_id", "quality").join(t("documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("guess")), "doc_id")
    return metrics.per_class_accuracy(rows, "quality", "guess")


@query("SELECT DISTINCT p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE (q.p_size <> p.p_size OR q.p_retailprice <> p.p_retailprice) AND q.p_size <= p.p_size AND q.p_retailprice <= p.p_retailprice)")
def b_pareto(t):
    return metrics.skyline(t("part").select("p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("""
WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents)
SELECT CASE WHEN regexp_matches(ch, '[a-z]') THEN 'lower' WHEN regexp_matches(ch, '[A-Z]') THEN 'upper' WHEN regexp_matches(ch, '[0-9]') THEN 'digit' WHEN ch IN (' ', chr(10)) THEN 'space' ELSE 'other' END AS class, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1""")
def b_token_counts(t):
    text = F.col("text")
    classes = {"lower": ascii_lowercase, "upper": ascii_uppercase, "digit": digits, "space": " \n"}
    sums = [F.sum(F.length(text) - F.length(F.translate(text, own, ""))).alias(c) for c, own in classes.items()]
    one = t("documents").agg(*sums, F.sum(F.length(text)).alias("whole"))
    named = [F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in classes] + [F.struct(F.lit("other").alias("class"), (F.col("whole") - sum((F.col(c) for c in classes), F.lit(0))).alias("n"))]
    return one.select(F.inline(F.array(*named))).filter("n > 0")


@query("WITH p AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(least(10.0::DOUBLE, sum(n) OVER () / (count(*) OVER () * n)), 6) AS weight FROM p")
def b_class_weights(t):
    return metrics.class_weights(t("events").select("event_type"), "event_type")


_SIGNS = "list_sum(list_transform(generate_series(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END))::UBIGINT"


@query(f"""
WITH v AS (SELECT vec_id, label, {_SIGNS} AS bits FROM embeddings)
SELECT a.vec_id AS query, b.vec_id AS neighbour, bit_count(xor(a.bits, b.bits))::INT AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.bits, b.bits)), b.vec_id)::INT AS place
FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY place <= 3""")
def b_sign_knn(t):
    v = t("embeddings").select("vec_id", "label", neighbours.sign_bits("embedding").alias("bits"))
    return neighbours.nearest(v.filter("vec_id % 20 = 0"), v, ["label"], "bits", "vec_id", 3).select("query", "neighbour", "distance", "place")


@query("""
SELECT a.vec_id, len(d) AS n_diff, array_to_string(d, ',') AS cells FROM (SELECT a.vec_id, list_filter(generate_series(0, 63), lambda i: (a.embedding[i + 1] > 0) <> (b.embedding[i + 1] > 0)) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""")
def b_cell_diff(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda v: v > 0).alias("s"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("s2")), "vec_id")
    d = neighbours.differing(F.col("s"), F.col("s2"))
    return pairs.select("vec_id", F.size(d).cast("long").alias("n_diff"), F.concat_ws(",", d.cast("array<string>")).alias("cells"))


@query("SELECT event_id, user_id, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) QUALIFY n > 8")
def b_burnout(t):
    return ordered.bursts(t("events").select("event_id", "user_id", "ts"), "user_id", "ts", 86_400, 8)


@query("SELECT event_id, floor(epoch(ts))::BIGINT - floor(epoch(first_value(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)))::BIGINT AS period FROM events")
def b_cycle(t):
    return ordered.since_first(t("events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"], "ts")


@query("""
WITH c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c)
SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island HAVING count(*) >= 3""")
def b_settle(t):
    return ordered.islands(t("events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"], "event_type").filter("n >= 3")


@query("SELECT user_id, max(gap) AS max_gap FROM (SELECT user_id, floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT AS gap FROM events) GROUP BY user_id")
def b_max_latency(t):
    return ordered.largest_gap(t("events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], "ts")


_DAILY = "SELECT ts::DATE::VARCHAR AS day, round(avg((event_type = 'purchase')::INT), 6) AS score, count(DISTINCT user_id)::DOUBLE AS variety, round(avg((event_type = 'view')::INT), 6) AS fresh, round(avg((event_type = 'error')::INT), 6) AS unstable FROM events GROUP BY 1"


def _daily(t):
    def share(kind: str):
        return F.round(F.avg((F.col("event_type") == kind).cast("int")), 6)

    return t("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(share("purchase").alias("score"), F.count_distinct("user_id").cast("double").alias("variety"), share("view").alias("fresh"), share("error").alias("unstable"))


@query(f"""
WITH d AS ({_DAILY}), l AS (SELECT *, lag(score, 2) OVER w AS s0, lag(variety, 2) OVER w AS v0, lag(fresh, 2) OVER w AS f0, lag(unstable, 2) OVER w AS u0 FROM d WINDOW w AS (ORDER BY day))
SELECT day, score, variety, fresh, unstable, CASE WHEN score > s0 AND (variety < 0.7::DOUBLE * v0 OR fresh < 0.5::DOUBLE * f0) THEN 'collapsing' WHEN unstable > 2 * u0 + 0.01::DOUBLE THEN 'unstable' END AS alarm FROM l""")
def b_collapse(t):
    return metrics.collapse(_daily(t), "day", "score", "variety", "fresh", "unstable")


@query(f"WITH d AS ({_DAILY}) SELECT day, score, least(4, coalesce(sum((score >= 0.2::DOUBLE)::INT) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS stage FROM d")
def b_curriculum(t):
    return metrics.curriculum(_daily(t).select("day", "score"), "day", "score", 0.2)


@query("SELECT l_orderkey, bit_or(CASE WHEN l_returnflag = 'R' THEN 1::BIGINT << l_linenumber ELSE 0 END) AS mask FROM lineitem GROUP BY l_orderkey")
def b_bitmask(t):
    return ordered.bit_mask(t("lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linenumber"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def b_mask_unpack(t):
    return ordered.unpack_mask(ordered.bit_mask(t("lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linenumber")), "l_orderkey", "mask", "l_linenumber")


def _statuses(t):
    derived = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus")).otherwise("P").alias("observed"))
    return t("orders").select("o_orderkey", F.col("o_orderstatus").alias("expected")).join(derived, "o_orderkey", "left")


_STATUSES = "SELECT o_orderkey, o_orderstatus AS expected, observed FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS observed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


@query(f"SELECT count(*) AS cases, count(observed) AS checked, count(*) FILTER (WHERE expected = observed) AS agreed, round(coalesce(avg((expected = observed)::INT), 0.0), 5) AS agreement FROM ({_STATUSES})")
def b_agreement(t):
    return metrics.agreement(_statuses(t), "expected", "observed")


@query(f"SELECT CASE WHEN observed IS NULL THEN 'unobserved' WHEN observed = 'P' THEN 'partial' WHEN expected = 'P' THEN 'early' ELSE 'opposite' END AS class, count(*) AS n, min(o_orderkey) AS example FROM ({_STATUSES}) WHERE observed IS NULL OR expected <> observed GROUP BY 1")
def b_divergence(t):
    seen = F.col("observed")
    kind = F.when(seen.isNull(), "unobserved").when(seen == "P", "partial").when(F.col("expected") == "P", "early").otherwise("opposite")
    return _statuses(t).filter(seen.isNull() | (F.col("expected") != seen)).groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("example"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def b_semi_join(t):
    return t("customer").select("c_custkey", "c_name").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def b_anti_join(t):
    return corpus.unseen(t("customer").select("c_custkey", "c_name"), t("orders"), "c_custkey", "o_custkey")


@query("""
WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)""")
def b_set_ops(t):
    c = t("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = t("supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    parts = {"union": c.union(s).distinct(), "intersect": c.intersect(s), "except": c.subtract(s)}
    first, *rest = [df.select(F.lit(op).alias("op"), "k") for op, df in parts.items()]
    for more in rest:
        first = first.unionByName(more)
    return first


@query("""
WITH a AS (SELECT l_orderkey, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R'), []) AS r, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag <> 'R'), []) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_distinct(list_concat(r, n)))::BIGINT AS n_union, len(list_filter(r, lambda x: NOT list_contains(n, x)))::BIGINT AS n_except FROM a""")
def b_array_sets(t):
    a = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("r"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("n"))
    return a.select("l_orderkey", F.size(F.array_union("r", "n")).cast("long").alias("n_union"), F.size(F.array_except("r", "n")).cast("long").alias("n_except"))


@query("SELECT p_type, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS number FROM part GROUP BY p_type")
def b_palette(t):
    return ordered.by_first_appearance(t("part").select("p_type", "p_partkey"), "p_type", "p_partkey")


@query("SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def b_materials(t):
    return ordered.histogram(t("events").select("user_id", "event_type"), "event_type", "user_id")


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def b_transcript(t):
    return ordered.joined_text(t("conversations"), "conv_id", "turn", F.concat(F.col("role"), F.lit(": "), F.col("text")))


@query("SELECT r_name, lpad(count(*)::VARCHAR, 6, ' ') AS cell, repeat('-', length(r_name)) AS rule FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def b_table_text(t):
    per = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    return per.select("r_name", F.lpad(F.col("n").cast("string"), 6, " ").alias("cell"), F.repeat(F.lit("-"), F.length("r_name")).alias("rule"))


@query("""
WITH l AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS v FROM nation GROUP BY 1)
SELECT n_regionkey, CASE WHEN len(v) = 1 THEN v[1] ELSE array_to_string(v[1:len(v) - 1], ', ') || ' and ' || v[len(v)] END AS names FROM l""")
def b_list_join(t):
    return t("nation").groupBy("n_regionkey").agg(phrases.listed(F.array_sort(F.collect_list("n_name"))).alias("names"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN p_name WHEN regexp_matches(p_name, '(s|x|ch|sh)$') THEN p_name || 'es' ELSE p_name || 's' END AS words FROM part")
def b_plural(t):
    return t("part").select("p_partkey", phrases.plural(F.col("p_name"), F.col("p_size")).alias("words"))


@query("SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def b_json_props(t):
    return t("events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("SELECT r_regionkey, r_name FROM region")
def b_json_roundtrip(t):
    return t("region").select(F.from_json(F.to_json(F.struct("r_regionkey", "r_name")), "r_regionkey int, r_name string").alias("r")).select("r.*")


@query(r"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/]*/([a-z]{2})/', 1) AS lang, (strpos(url, 'utm_') > 0) AS tracked FROM pages")
def b_url_parse(t):
    u = F.col("url")
    return t("pages").select("page_id", F.regexp_extract(u, "://([^/?#]*)", 1).alias("host"), F.regexp_extract(u, "://[^/]*/([a-z]{2})/", 1).alias("lang"), F.contains(u, F.lit("utm_")).alias("tracked"))


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_text FROM pages")
def b_html_strip(t):
    return t("pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n_text"))


@query("WITH n AS (SELECT (count(*) * 0.2::DOUBLE / 0.8::DOUBLE)::BIGINT AS k FROM labels WHERE quality = 1) SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= (SELECT floor(count(*) * 0.2::DOUBLE / 0.8::DOUBLE) FROM labels WHERE quality = 1)")
def b_anchor_sample(t):
    n = int(t("labels").filter("quality = 1").count() * 0.2 / 0.8)
    return corpus.sample_ahead(t("documents").select("doc_id"), n, F.md5(F.col("doc_id").cast("string").cast("binary")))


@query("""
WITH p AS (SELECT vec_id, i, embedding[i + 1] > 0 AS s, row_number() OVER (PARTITION BY vec_id ORDER BY md5(vec_id || ':' || i), i) AS r FROM embeddings, generate_series(0, 63) g(i))
SELECT vec_id, string_agg(CASE WHEN s <> (r <= 4) THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM p GROUP BY vec_id""")
def b_corrupt(t):
    return ordered.corrupt(t("embeddings").select("vec_id", F.transform("embedding", lambda v: v > 0).alias("s")), "vec_id", "s", 4)


@query("SELECT * FROM (VALUES ('train', 100::BIGINT), ('val', 20), ('extrapolation', 13), ('ood', 13), ('repair', 1)) v(split, n)")
def b_quotas(t):
    return corpus.quotas(t("region").sparkSession, [("train", 200), ("val", 40), ("extrapolation", 25), ("ood", 25), ("repair", 0)], 0.5)


@query("""
SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def b_star_revenue(t):
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    joined = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per = joined.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))  # before the dimensions
    named = per.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("revenue"))


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, grouping(ts::DATE::VARCHAR, event_type)::BIGINT AS gid FROM events GROUP BY ROLLUP (ts::DATE::VARCHAR, event_type)")
def b_rollup(t):
    return t("events").select(F.to_date("ts").cast("string").alias("day"), "event_type").rollup("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def b_cube(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


@query("SELECT c.event_id, e.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) e ON c.user_id = e.user_id AND c.ts >= e.ts")
def b_asof(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    return ordered.as_of(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", "ts", "event_id", "last_purchase")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id <> a.event_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'signup' AND b.event_type = 'purchase'")
def b_range_join(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    return ordered.within(e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'"), "user_id", "ts", "event_id", 3600)


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY event_type")
def b_quantiles(t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.9), 4).alias("p90"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def b_vector_norm(t):
    return t("embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4).alias("norm"))


@query("SELECT DISTINCT o_custkey AS node, min(s_nationkey) OVER (PARTITION BY c_nationkey) AS component FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_nationkey = c_nationkey")
def b_lookup_component(t):
    nations = t("supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_nationkey").alias("component"))
    return t("customer").join(nations, "c_nationkey").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("node"), "component")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def b_arrow_kernel(t):
    return kernels.norms(t("embeddings"), "vec_id", "embedding")


@query("SELECT user_id, item, count(*) AS n FROM (SELECT user_id, unnest(list_append(CASE WHEN event_type IN ('purchase', 'click') THEN ['active'] ELSE [] END, event_type)) AS item FROM events) GROUP BY ALL")
def b_udtf_explode(t):
    e = t("events").select("user_id", "event_type")
    return kernels.tagged(e, "event_type", {"purchase": "active", "click": "active"}).groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT p_size AS a, p_size + 7 AS b FROM part WHERE p_size % 3 <> 0), n AS (SELECT a AS x FROM e UNION SELECT b FROM e),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(x, y) AS (SELECT x, x FROM n UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y)
SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def b_components(t):
    edges = t("part").filter("p_size % 3 <> 0").select(F.col("p_size").alias("a"), (F.col("p_size") + 7).alias("b")).distinct()
    return circuits.connected(edges)


_CHAIN = "SELECT DISTINCT least(l_partkey, n) AS source, greatest(l_partkey, n) AS target FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <> l_partkey"


@query(f"""
WITH RECURSIVE e AS ({_CHAIN}), r(node, depth) AS (SELECT source, 0 FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT target, depth + 1 FROM r JOIN e ON source = node)
SELECT node, max(depth) AS depth, row_number() OVER (ORDER BY max(depth), node) AS place FROM r GROUP BY node""")
def b_part_order(t):
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = t("lineitem").select("l_partkey", following.alias("n")).filter("n <> l_partkey")
    return circuits.topological(pairs.select(F.least("l_partkey", "n").alias("source"), F.greatest("l_partkey", "n").alias("target")))


@query("""
WITH p AS (SELECT l_extendedprice, min(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS day FROM lineitem GROUP BY 1)
SELECT l_extendedprice, day FROM (SELECT *, min(day) OVER (ORDER BY l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) WHERE before IS NULL OR day < before""")
def b_skyline(t):
    return metrics.skyline(t("lineitem").select("l_extendedprice", F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("day")), "l_extendedprice", "day")


_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query(f"SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (ORDER BY {', '.join(_ORDER)} ROWS UNBOUNDED PRECEDING) AS shipped FROM lineitem")
def b_running_quantity(t):
    return scan.scanned(t("lineitem").select(*_ORDER), _ORDER, "l_quantity", "sum", running="shipped").select("l_orderkey", "l_linenumber", "shipped")


@query(f"""
WITH d AS (SELECT *, {_KEY} AS k FROM documents), f AS (SELECT k, arg_min(lang, doc_id) AS lang, arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM d GROUP BY k),
q AS (SELECT * FROM (VALUES ('en', 150), ('fr', 40), ('es', 100000), ('none', 5)) AS v(lang, quota))
SELECT lang, doc_id FROM f JOIN q USING (lang) WHERE length(text) >= 300 AND text NOT LIKE '%|%' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('draw:' || k)) <= any_value(quota) OVER (PARTITION BY lang)""")
def b_quota_sample(t):
    docs = t("documents").select("doc_id", "lang", "text").withColumn("k", corpus.canonical_key("text"))
    accept = lambda rows: rows.filter((F.length("text") >= 300) & ~F.contains("text", F.lit("|")))
    return sampling.to_quota(docs, "k", "doc_id", "lang", {"en": 150, "fr": 40, "es": 100_000, "none": 5}, accept, "draw").select("lang", "doc_id")


@query("""
WITH n AS (SELECT user_id, event_type, floor(value / 40)::INT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
s AS (SELECT user_id, place, concat_ws(',', last_value(CASE WHEN event_type = 'click' THEN v END IGNORE NULLS) OVER w, 'e', last_value(CASE WHEN event_type = 'error' THEN v END IGNORE NULLS) OVER w, 'p', last_value(CASE WHEN event_type = 'purchase' THEN v END IGNORE NULLS) OVER w,
  's', last_value(CASE WHEN event_type = 'signup' THEN v END IGNORE NULLS) OVER w, 'v', last_value(CASE WHEN event_type = 'view' THEN v END IGNORE NULLS) OVER w) AS state FROM n WINDOW w AS (PARTITION BY user_id ORDER BY place)),
b AS (SELECT user_id, place, lag(place) OVER (PARTITION BY user_id, state ORDER BY place) AS since FROM s)
SELECT user_id, min(place) AS place, arg_min(since, place) AS since, min(place) - arg_min(since, place) AS period FROM b WHERE since IS NOT NULL GROUP BY user_id""")
def b_state_recurrence(t):
    return ordered.recurrence(t("events").withColumn("v", F.floor(F.col("value") / 40)), "user_id", ["ts", "event_id"], "event_type", "v")


@query("""
SELECT 1::BIGINT AS place, '| p_partkey | p_name | p_size |' AS line UNION ALL SELECT 2, '| --- | --- | --- |'
UNION ALL SELECT 2 + row_number() OVER (ORDER BY p_size, p_partkey), '| ' || p_partkey || ' | ' || p_name || ' | ' || p_size || ' |' FROM part""")
def b_card_lines(t):
    return corpus.card_lines(t("part"), ["p_partkey", "p_name", "p_size"], ["p_size", "p_partkey"])
