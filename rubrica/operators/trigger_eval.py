"""Trigger evaluation of a table of skills: seeded scenarios, prompts, recorded replies with retries, a cost cap, a cache, and scores.

Every skill is a row from start to end, and its draws are expressions on it: the k-th number of the generator follows from the seed and k alone, so nothing is drawn in turn on the driver.
A judge isn't called here. Its replies are a table: prompt_sha (SHA-256 of the prompt), attempt (1, or 2 for the retry), reply.

The corpus of distractors and the bank of their requests are lists of some dozens, checked for their size, and go into the plan as literals.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.config import UserError
from rubrica.functions.text import approximate_tokens, let, trimmed
from rubrica.operators.evaluation import DISTRACTORS, MASK, NEGATIVES, OUTPUT_TOKENS_PER_CALL, POSITIVE_PROMPT_ALLOWANCE, POSITIVES, PROMPTS_VERSION, chosen_skill, metrics
from rubrica.tables import drop_table, spread, table_of, unsent

LARGEST_CORPUS = 1000
SCENARIOS = POSITIVES + NEGATIVES
# The least size of a corpus, and the prompts.
LEAST_CORPUS = 12
ASK_POSITIVES = """You are helping evaluate whether an AI assistant loads the right skill at the right time.

Target skill:
  name: {name}
  description: {description}

Write {count} realistic user requests that this skill SHOULD handle. Vary phrasing,
specificity, and length the way real users do: some terse, some detailed. Never
mention the skill by name.

Answer with ONLY a JSON array of {count} strings. No prose, no code fences."""
ASK_ROUTE = """You are an AI assistant that may load exactly one skill to handle a user request,
or none when no skill clearly applies. Available skills:

{skills}

User request:
{request}

Which skill, if any, should be loaded? Answer with ONLY a JSON object, no prose:
{{"skill": "<name>"}} or {{"skill": null}}"""


def load_corpus(spark: SparkSession, location: str) -> list[dict[str, str]]:
    """Distractors from a JSON array of objects with name and description, in its order."""
    text = spark.read.text(location, wholetext=True).first()
    try:
        items = json.loads(text[0]) if text else None
    except ValueError as e:
        raise UserError(f"{location} is not JSON: {e}") from e
    return checked_corpus(items)


def checked_corpus(items: object) -> list[dict[str, str]]:
    good = isinstance(items, list) and all(isinstance(x, dict) and all(isinstance(x.get(k), str) and x[k] for k in ("name", "description")) for x in items)
    if not good or not LEAST_CORPUS <= len(items) <= LARGEST_CORPUS:
        raise UserError(f"a corpus is a list of {LEAST_CORPUS} to {LARGEST_CORPUS} objects with name and description")
    return [{"name": x["name"], "description": x["description"]} for x in items]


def times(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two numbers of 32 bits."""
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (a.bitwiseAND(F.lit(0xFFFF)) * b + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK))


def seed_of(text: Column) -> Column:
    """The first 32 bits of a text's SHA-256, the lowest byte first."""
    h = F.sha2(F.encode(text, "UTF-8"), 256)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


def drawn(seed: Column, k: Column) -> Column:
    """The k-th number, from 1, in [0, 1) of the generator of evaluation.seeded."""
    low = lambda x, n: F.shiftright(x, n)
    first = lambda a: times(a.bitwiseXOR(low(a, 15)), a.bitwiseOR(F.lit(1)))
    second = lambda t: (t + times(t.bitwiseXOR(low(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)).bitwiseXOR(t)
    third = lambda t: t.bitwiseXOR(low(t, 14)).bitwiseAND(F.lit(MASK)) / F.lit(4294967296.0)
    state = (seed + k.cast("long") * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(MASK))
    return let(let(let(state, first), second), third)


def shuffled(pool: Column, seed: Column) -> Column:
    """An array after a shuffle from its end; it takes draws 1 to n - 1."""
    n = F.size(pool)

    def step(acc: Column, i: Column) -> Column:
        j = F.floor(drawn(seed, n - i) * (i + 1)).cast("int")
        return let(j, lambda j: F.transform(acc, lambda x, p: F.when(p == i, F.get(acc, j)).when(p == j, F.get(acc, i)).otherwise(x)))

    return F.when(n > 1, F.aggregate(F.sequence(F.greatest(n - 1, F.lit(1)), F.lit(1), F.lit(-1)), pool, step)).otherwise(pool)


def text_of(template: str, **parts: Column | str) -> Column:
    """A template with columns for its {names}."""
    out, rest = [], template.replace("{{", "\0").replace("}}", "\1")
    while rest:
        before, brace, rest = rest.partition("{")
        out.append(F.lit(before.replace("\0", "{").replace("\1", "}")))
        if brace:
            name, _, rest = rest.partition("}")
            value = parts[name]
            out.append(value.cast("string") if isinstance(value, Column) else F.lit(value))
    return F.concat(*out)


SKILL = "struct<name:string,description:string>"


def scenarios(skills: DataFrame, corpus: list[dict[str, str]], bank: dict[str, str], model: str) -> DataFrame:
    """The scenario of each skill (path, name, description): distractors, positions (where the target stands among them in each scenario), negatives, key (of the cache), problem (null if there is none)."""
    corpus = checked_corpus(corpus)
    all_ = F.from_json(F.lit(json.dumps(corpus)), f"array<{SKILL}>")
    requests = F.from_json(F.lit(json.dumps(bank)), "map<string,string>")
    own = skills.select("path", "name", "description").withColumn("seed", seed_of(F.col("description")))
    own = own.withColumn("pool", F.filter(all_, lambda c: c["name"] != F.col("name")))
    own = own.withColumn("distractors", F.slice(shuffled(F.col("pool"), F.col("seed")), 1, DISTRACTORS))
    places = F.transform(F.sequence(F.lit(0), F.lit(SCENARIOS - 1)), lambda q: F.floor(drawn(F.col("seed"), F.size("pool") + q) * (DISTRACTORS + 1)).cast("int"))
    asked = F.slice(F.filter(F.transform("distractors", lambda d: F.element_at(requests, d["name"])), lambda x: x.isNotNull()), 1, NEGATIVES)
    few = F.concat(F.lit(f"distractor corpus too small: need {DISTRACTORS}, have "), F.size("pool").cast("string"))
    problem = F.when(F.size("pool") < DISTRACTORS, few).when(F.size(asked) < NEGATIVES, "the bank of requests does not cover the sampled distractors")
    key = F.to_json(F.struct("name", "description", F.col("distractors").alias("corpus"), F.lit(model).alias("model"), F.lit(PROMPTS_VERSION).alias("promptsVersion")))
    return own.select("path", "name", "description", "distractors", places.alias("positions"), asked.alias("negatives"), F.sha2(F.encode(key, "UTF-8"), 256).alias("key"), problem.alias("problem"))


def generation_prompt() -> Column:
    return text_of(ASK_POSITIVES, name=F.col("name"), description=F.col("description"), count=str(POSITIVES))


def routing_prompt(position: Column, request: Column | str) -> Column:
    """The prompt of one scenario: the target stands at its position, from 0, among the distractors."""
    target = F.struct("name", "description")
    before, after = F.slice("distractors", F.lit(1), position), F.slice("distractors", position + 1, F.lit(DISTRACTORS))
    lines = F.transform(F.concat(before, F.array(target), after), lambda s: F.concat(F.lit("- "), s["name"], F.lit(": "), s["description"]))
    return text_of(ASK_ROUTE, skills=F.array_join(lines, "\n"), request=request)


def priced(plan: DataFrame, usd_in: float, usd_out: float, most_usd: float, tokens=approximate_tokens) -> DataFrame:
    """plan with usd, the estimated price of its calls, and a problem where that is over the cap. Requests that aren't written yet count as a fixed number of tokens."""
    known = F.transform(F.arrays_zip(F.col("positions").alias("p"), F.sequence(F.lit(0), F.lit(SCENARIOS - 1)).alias("i")), lambda x: routing_prompt(x["p"], F.when(x["i"] < POSITIVES, F.lit("")).otherwise(F.coalesce(F.get("negatives", x["i"] - POSITIVES), F.lit("")))))
    tokens_in = F.aggregate(F.transform(known, lambda t: tokens(t).cast("long")), tokens(generation_prompt()).cast("long") + POSITIVES * POSITIVE_PROMPT_ALLOWANCE, lambda a, x: a + x)
    tokens_out = (1 + SCENARIOS) * OUTPUT_TOKENS_PER_CALL
    usd = tokens_in / 1e6 * usd_in + F.lit(tokens_out / 1e6 * usd_out)
    over = F.when(usd > most_usd, F.concat(F.lit("estimated eval cost $"), F.format_string("%.4f", usd), F.lit(f" exceeds eval.maxUSD (${most_usd:.2f})")))
    return plan.withColumn("usd", F.when(F.col("problem").isNull(), usd)).withColumn("problem", F.coalesce("problem", over))


def bare_reply(reply: Column) -> Column:
    """A reply without the fence that it may stand in."""
    whole = trimmed(reply)
    inner = F.regexp_extract(whole, r"^```(?:json)?\s*\n?([\s\S]*?)\n?\s*```$", 1)
    return trimmed(F.when(whole.rlike(r"^```(?:json)?\s*\n?([\s\S]*?)\n?\s*```$"), inner).otherwise(whole))


def string_items(value: Column) -> Column:
    """The strings of a JSON array as variants see them; null if it isn't an array."""
    items = F.try_variant_get(F.try_parse_json(value), "$", "array<variant>")
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def written_requests(reply: Column) -> Column:
    """The requests of a generation reply: the first of at least POSITIVES strings that aren't blank; null if it hasn't so many."""
    items = F.filter(string_items(bare_reply(reply)), lambda x: trimmed(x) != "")
    return F.when(F.size(items) >= POSITIVES, F.slice(items, 1, POSITIVES))


class EvalCache:
    """Replies of past evaluations in a table at any location that Spark writes: rows of key and entry in folders by the first two digits of the key.

    The latest row of a key counts. A missing table, a file that can't be read, and an entry of another shape or version are misses, never failures. Storing appends, so readers
    never see a half-written row, and a lost task leaves nothing behind.
    """

    SCHEMA = "key string, entry string, stored_at timestamp, bucket string"

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.option("ignoreCorruptFiles", "true").schema(self.SCHEMA).parquet(self.location)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def found(self, keys: DataFrame) -> DataFrame:
        """(key, positives, responses) of those keys that the cache has."""
        bucket = F.substring("key", 1, 2).alias("bucket")
        own = self.rows().join(keys.select("key", bucket).distinct(), ["bucket", "key"], "left_semi")
        last = own.groupBy("key").agg(F.max_by("entry", "stored_at").alias("entry"))
        part = lambda name: F.get_json_object("entry", f"$.{name}")
        whole = lambda name: F.size(F.try_variant_get(F.try_parse_json(part(name)), "$", "array<variant>")) == F.size(string_items(part(name)))
        good = F.try_parse_json("entry").isNotNull() & (part("promptsVersion") == str(PROMPTS_VERSION)) & whole("positives") & whole("responses")
        return last.where(F.coalesce(good, F.lit(False))).select("key", string_items(part("positives")).alias("positives"), string_items(part("responses")).alias("responses"))

    def store(self, entries: DataFrame) -> None:
        """entries: key, positives, responses."""
        entry = F.to_json(F.struct(F.lit(PROMPTS_VERSION).alias("promptsVersion"), "positives", "responses"))
        entries.select("key", entry.alias("entry"), F.current_timestamp().alias("stored_at"), F.substring("key", 1, 2).alias("bucket")).write.mode("append").partitionBy("bucket").parquet(self.location)


class Evaluation(NamedTuple):
    results: DataFrame  #: path, name, model, precision, recall, f1, scenarios, problem (null if the skill was scored)
    asked: DataFrame  #: path, key: skills whose replies weren't in the cache
    plan: DataFrame  #: a table in the shared folder that the others are read from; drop_table deletes it


def routed(plan: DataFrame, *more: str) -> DataFrame:
    """(path, key, i, prompt) of each scenario, and more columns of the plan, which has positives besides its own."""
    each = plan.select("*", F.posexplode("positions").alias("i", "position"))
    request = F.when(F.col("i") < POSITIVES, F.get("positives", F.col("i"))).otherwise(F.get("negatives", F.col("i") - POSITIVES))
    return each.select("path", "key", "i", routing_prompt(F.col("position"), request).alias("prompt"), *more)


def answered(plan: DataFrame, replies: DataFrame) -> DataFrame:
    """plan with positives and responses from recorded replies, and a problem where no requests could be read, as a table in the shared folder. A reply that can't be read is asked for once more; what is then there is kept as it is.

    Replies are met twice, by the requests and by the scenarios, and so are prices and requests; both are tables, or each would be worked out twice.
    """
    own = table_of(replies.groupBy("prompt_sha").agg(F.max(F.when(F.col("attempt") == 1, F.col("reply"))).alias("one"), F.max(F.when(F.col("attempt") == 2, F.col("reply"))).alias("two")), "eval-replies")
    sha = lambda prompt: F.sha2(F.encode(prompt, "UTF-8"), 256)
    begun = plan.withColumn("prompt_sha", sha(generation_prompt())).join(unsent(own), "prompt_sha", "left")
    begun = begun.withColumn("positives", F.coalesce(written_requests(F.col("one")), written_requests(F.col("two")))).drop("prompt_sha", "one", "two")
    unread = F.when(F.col("positives").isNull(), f"judge model did not return a parseable JSON array of {POSITIVES} user prompts after a retry")
    begun = table_of(begun.withColumn("problem", F.coalesce("problem", unread)), "eval-begun")
    told = routed(begun.where("problem IS NULL")).withColumn("prompt_sha", sha(F.col("prompt"))).join(unsent(own), "prompt_sha", "left")
    reply = F.when(chosen_skill(F.coalesce("one", F.lit("")))["ok"], F.col("one")).otherwise(F.coalesce("two", "one", F.lit("")))
    responses = told.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", reply.alias("r")))), lambda x: x["r"]).alias("responses"))  # one skill's scenarios
    out = table_of(begun.join(unsent(responses), "path", "left"), "eval-answers")
    for t in (own, begun):
        drop_table(t)
    return out


def evaluate(skills: DataFrame, corpus: list[dict[str, str]], bank: dict[str, str], replies: DataFrame, model: str, usd_in: float, usd_out: float, most_usd: float, cache: EvalCache | None = None, tokens=approximate_tokens) -> Evaluation:
    """Scores of all skills (path, name, description). Those in the cache need no reply and no price; the others are priced, answered and stored."""
    plan = scenarios(skills, corpus, bank, model)
    if cache is not None:
        plan = plan.join(cache.found(plan.where("problem IS NULL")).withColumnsRenamed({"positives": "c_positives", "responses": "c_responses"}), "key", "left")
    else:
        plan = plan.withColumns({"c_positives": F.lit(None).cast("array<string>"), "c_responses": F.lit(None).cast("array<string>")})
    plan = table_of(plan, "eval-plan")
    miss = spread(plan.where("c_responses IS NULL").drop("c_positives", "c_responses"), "path")
    live = answered(priced(miss, usd_in, usd_out, most_usd, tokens).drop("usd"), replies)
    if cache is not None:
        cache.store(live.where("problem IS NULL").dropDuplicates(["key"]).select("key", "positives", "responses"))
    old = plan.where("c_responses IS NOT NULL").select("path", "name", "problem", F.col("c_responses").alias("responses"))
    all_ = live.select("path", "name", "problem", "responses").union(old)
    each = all_.where("problem IS NULL").select("path", "name", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(SCENARIOS - 1)), lambda i: F.coalesce(F.get("responses", i), F.lit("")))).alias("i", "r"))
    outcome = each.select("path", "name", F.when(F.col("i") < POSITIVES, "positive").otherwise("negative").alias("kind"), F.coalesce(chosen_skill(F.col("r"))["skill"] == F.col("name"), F.lit(False)).alias("selected"))
    scored = metrics(outcome, "path", "name").select("path", "name", F.lit(model).alias("model"), "precision", "recall", "f1", "scenarios", F.lit(None).cast("string").alias("problem"))
    null = lambda kind: F.lit(None).cast(kind)
    bad = all_.where("problem IS NOT NULL").select("path", "name", F.lit(model).alias("model"), null("double"), null("double"), null("double"), null("long"), "problem")
    return Evaluation(scored.union(bad), miss.where("problem IS NULL").select("path", "key"), plan)
