"""Queries of the trigger evaluation over skills that are derived from the part table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.operators import trigger_eval as E
from rubrica.tables import spread, table_of

MODEL = "recorded-judge"


def nations(spark: SparkSession, sf_dir: str) -> tuple[list[dict[str, str]], dict[str, str]]:
    """A corpus and its bank of requests: one distractor for each nation."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").limit(E.LARGEST_CORPUS).collect()
    return [{"name": r.n_name, "description": f"Handles the affairs of {r.n_name}"} for r in rows], {r.n_name: f"Please see to {r.n_name}" for r in rows}


def part_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill for each part. Every tenth has the name of a distractor, which is left out of its pool then."""
    k = F.col("p_partkey")
    name = F.when(k % 10 == 0, F.concat(F.lit("NATION_"), (k % 25).cast("string"))).otherwise(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), k))
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), "p_partkey").select(F.concat(F.lit("p"), k.cast("string")).alias("path"), name.alias("name"), F.concat(F.lit("Handles "), "p_name", F.lit(" number "), k.cast("string")).alias("description"), k.alias("k"))


def trigger_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distractors of each skill in their sampled order, and where it stands among them in its sixteen scenarios."""
    plan = E.scenarios(part_skills(spark, sf_dir), *nations(spark, sf_dir), MODEL)
    return plan.select("path", F.array_join(F.transform("distractors", lambda d: d["name"]), ",").alias("distractors"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), F.size("negatives").alias("negatives"), "problem")


SCENARIOS_SQL = """
WITH corpus AS (SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation),
s AS (SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 10 = 0 THEN 'NATION_' || (p_partkey % 25) ELSE replace(p_name, ' ', '-') || '-' || p_partkey END AS name, sha256('Handles ' || p_name || ' number ' || p_partkey) AS h FROM part),
p AS (SELECT path, list_filter(names, lambda x: x <> name) AS pool, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::HUGEINT AS seed FROM s, corpus),
k AS (SELECT path, pool, len(pool) AS n, seed, unnest(range(1, len(pool) + 16)) AS k FROM p),
a AS (SELECT *, ((seed + k::HUGEINT * 1831565813) % 4294967296)::BIGINT AS a FROM k),
b AS (SELECT *, ((xor(a, a >> 15))::HUGEINT * (a | 1)::HUGEINT % 4294967296)::BIGINT AS t FROM a),
c AS (SELECT *, xor((t + ((xor(t, t >> 7))::HUGEINT * (t | 61)::HUGEINT % 4294967296)::BIGINT) % 4294967296, t) AS t2 FROM b),
d AS (SELECT path, pool, n, k, xor(t2, t2 >> 14)::DOUBLE / 4294967296 AS x FROM c),
steps AS (SELECT path, any_value(pool) AS pool, list({'l': []::VARCHAR[], 'i': n - k, 'j': floor(x * (n - k + 1))::BIGINT} ORDER BY k) FILTER (k < n) AS steps, list(floor(x * 12)::BIGINT ORDER BY k) FILTER (k >= n) AS positions FROM d GROUP BY path),
o AS (SELECT path, positions, list_reduce(list_prepend({'l': pool, 'i': 0::BIGINT, 'j': 0::BIGINT}, steps),
    lambda acc, s: {'l': list_transform(acc.l, lambda x, q: CASE WHEN q = s.i + 1 THEN acc.l[s.j + 1] WHEN q = s.j + 1 THEN acc.l[s.i + 1] ELSE x END), 'i': 0::BIGINT, 'j': 0::BIGINT}).l AS l FROM steps)
SELECT path, array_to_string(l[1:11], ',') AS distractors, array_to_string(positions, ',') AS positions, 8 AS negatives, NULL::VARCHAR AS problem FROM o
"""


def recorded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge said to each prompt: it writes eight requests, at times only when asked again, and then picks a skill or none by a rule of the part's key."""
    sha = lambda prompt: F.sha2(F.encode(prompt, "UTF-8"), 256)
    k = F.col("k")
    plan = spread(table_of(E.scenarios(part_skills(spark, sf_dir), *nations(spark, sf_dir), MODEL), "eval-scenarios"), "path").withColumn("k", F.substring("path", 2, 20).cast("long"))
    asks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat_ws(" ", F.lit("ask"), k, i))
    wrote = F.concat(F.lit("```json\n"), F.to_json(asks), F.lit("\n```"))
    begun = plan.select(sha(E.generation_prompt()).alias("prompt_sha"), k, F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), wrote.alias("wrote"))
    begun = begun.select("prompt_sha", "attempt", F.when((k % 5 == 0) & ((F.col("attempt") == 1) | (k % 15 == 0)), "I would rather not").otherwise(F.col("wrote")).alias("reply"))
    each = E.routed(plan.withColumn("positives", asks), "k", "name")
    i = F.col("i")
    takes = F.when(i < 8, (k + i) % 7 != 0).otherwise((k + i) % 11 == 0)
    clear = F.when(takes, F.to_json(F.struct(F.col("name").alias("skill")))).otherwise('{"skill": null}')
    told = each.select(sha(F.col("prompt")).alias("prompt_sha"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), k, i, clear.alias("clear"))
    vague = ((k + i) % 6 == 0) & ((F.col("attempt") == 1) | ((k + i) % 24 == 0))
    return begun.union(told.select("prompt_sha", "attempt", F.when(vague, "hard to say").otherwise(F.col("clear")).alias("reply")))


def trigger_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all skills from recorded replies, with what kept the others from being scored. Those whose texts are long are over the cap."""
    skill = part_skills(spark, sf_dir).select("path", "name", F.when(F.col("k") % 13 == 0, F.concat("description", F.repeat(F.lit(" and more of it"), 1000))).otherwise(F.col("description")).alias("description"))
    out = E.evaluate(skill, *nations(spark, sf_dir), recorded_replies(spark, sf_dir), MODEL, 1.0, 5.0, 0.05).results
    return out.withColumn("problem", F.regexp_replace("problem", r"\$0\.[0-9]{4} exceeds", "\\$? exceeds"))  # the price hangs on the length of every prompt


TRIGGER_SQL = """
WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey AS path, CASE WHEN p_partkey % 10 = 0 THEN 'NATION_' || (p_partkey % 25) ELSE replace(p_name, ' ', '-') || '-' || p_partkey END AS name FROM part),
e AS (SELECT *, unnest(range(16)) AS i FROM p WHERE k % 13 <> 0 AND k % 15 <> 0),
y AS (SELECT *, CASE WHEN i < 8 THEN (k + i) % 7 <> 0 ELSE (k + i) % 11 = 0 END AND (k + i) % 24 <> 0 AS yes FROM e),
n AS (SELECT path, name, count(*) FILTER (i < 8 AND yes) AS tp, count(*) FILTER (i < 8 AND NOT yes) AS fn, count(*) FILTER (i >= 8 AND yes) AS fp FROM y GROUP BY path, name),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS p, tp::DOUBLE / (tp + fn) AS r FROM n)
SELECT path, name, 'recorded-judge' AS model, floor(p * 10000 + 0.5) / 10000 AS precision, floor(r * 10000 + 0.5) / 10000 AS recall, floor(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END * 10000 + 0.5) / 10000 AS f1, 16::BIGINT AS scenarios, NULL::VARCHAR AS problem FROM q
UNION ALL SELECT path, name, 'recorded-judge', NULL, NULL, NULL, NULL, 'judge model did not return a parseable JSON array of 8 user prompts after a retry' FROM p WHERE k % 15 = 0 AND k % 13 <> 0
UNION ALL SELECT path, name, 'recorded-judge', NULL, NULL, NULL, NULL, 'estimated eval cost $? exceeds eval.maxUSD ($0.05)' FROM p WHERE k % 13 = 0
"""
QUERIES = {"trigger_scenarios": trigger_scenarios, "trigger_eval": trigger_eval}
ORACLE_SQL = {"trigger_scenarios": SCENARIOS_SQL, "trigger_eval": TRIGGER_SQL}
