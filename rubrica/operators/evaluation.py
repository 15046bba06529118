"""Trigger evaluation from recorded replies: seeded scenarios, reply parsing, precision, recall and F1."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import UserError

# Scenario counts and prices.
DISTRACTORS, POSITIVES, NEGATIVES, PROMPTS_VERSION = 11, 8, 8, 1
OUTPUT_TOKENS_PER_CALL, POSITIVE_PROMPT_ALLOWANCE = 200, 100
MASK = 0xFFFFFFFF


def seeded(text: str) -> Callable[[], float]:
    """A generator of numbers in [0, 1) from the first 32 bits of a text's SHA-256 (the public mulberry32 recurrence)."""
    state = struct.unpack("<I", hashlib.sha256(text.encode()).digest()[:4])[0]

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & MASK
        t = (state ^ (state >> 15)) * (1 | state) & MASK
        t = (t + ((t ^ (t >> 7)) * (61 | t) & MASK) & MASK) ^ t
        return ((t ^ (t >> 14)) & MASK) / 4294967296

    return draw


def sample(items: list, n: int, draw: Callable[[], float]) -> list:
    """n items without replacement, by a shuffle from the end."""
    pool = list(items)
    for i in range(len(pool) - 1, 0, -1):
        j = int(draw() * (i + 1))
        pool[i], pool[j] = pool[j], pool[i]
    return pool[:n]


def scenario(target: dict, corpus: list[dict], negative_bank: dict[str, str]) -> dict:
    """Distractors, target positions and negative requests for one skill, all from one generator seeded by its description."""
    draw = seeded(target["description"])
    pool = [c for c in corpus if c["name"] != target["name"]]
    if len(pool) < DISTRACTORS:
        raise UserError(f"distractor corpus too small: need {DISTRACTORS}, have {len(pool)}")
    chosen = sample(pool, DISTRACTORS, draw)
    places = [int(draw() * (DISTRACTORS + 1)) for _ in range(POSITIVES + NEGATIVES)]
    negatives = [negative_bank[d["name"]] for d in chosen if d["name"] in negative_bank][:NEGATIVES]
    return {"distractors": chosen, "positions": places, "negatives": negatives}


def cache_key(target: dict, distractors: list[dict], model: str) -> str:
    """SHA-256 of what determines the replies, as compact JSON."""
    key = {"name": target["name"], "description": target["description"], "corpus": distractors, "model": model, "promptsVersion": PROMPTS_VERSION}
    return hashlib.sha256(json.dumps(key, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def chosen_skill(reply: Column) -> Column:
    """(ok, skill) of a reply: a JSON object with a skill that is a name or null, fenced or not; anything else isn't ok."""
    bare = F.regexp_replace(reply, r"^\s+|\s+$", "")
    inner = F.regexp_extract(bare, r"^```(?:json)?\s*\n?([\s\S]*?)\n?\s*```$", 1)
    body = F.trim(F.when(inner != "", inner).otherwise(bare))
    v = F.try_variant_get(F.try_parse_json(body), "$.skill", "variant")
    kind = F.schema_of_variant(v)
    name = F.trim(F.get_json_object(body, "$.skill"))
    null = (kind == "VOID") | F.is_variant_null(v)
    named = (kind == "STRING") & (name != "")
    return F.struct(F.coalesce(null | named, F.lit(False)).alias("ok"), F.when(F.coalesce(named, F.lit(False)), name).alias("skill"))


def metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    """precision, recall and F1 of (kind: positive or negative, selected), four decimals; 0 where nothing could be counted."""
    yes = F.col("selected")
    n = outcomes.groupBy(*by).agg(F.count_if((F.col("kind") == "positive") & yes).alias("tp"), F.count_if((F.col("kind") == "positive") & ~yes).alias("fn"), F.count_if((F.col("kind") == "negative") & yes).alias("fp"), F.count(F.lit(1)).alias("scenarios"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    round4 = lambda x: F.floor(x * 10_000 + 0.5) / 10_000
    n = n.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = F.when(F.col("p") + F.col("r") == 0, F.lit(0.0)).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return n.select(*by, round4(F.col("p")).alias("precision"), round4(F.col("r")).alias("recall"), round4(f1).alias("f1"), "scenarios")


def cost(prompt_tokens: DataFrame, calls: int, usd_in_per_mtok: float, usd_out_per_mtok: float, *by: str) -> DataFrame:
    """Estimated tokens and price of an evaluation from the tokens of its known prompts."""
    t = prompt_tokens.groupBy(*by).agg((F.sum("tokens") + POSITIVES * POSITIVE_PROMPT_ALLOWANCE).alias("input_tokens"))
    out = calls * OUTPUT_TOKENS_PER_CALL
    return t.select(*by, F.lit(calls).alias("calls"), "input_tokens", F.lit(out).alias("output_tokens"), (F.col("input_tokens") / 1e6 * usd_in_per_mtok + F.lit(out / 1e6 * usd_out_per_mtok)).alias("usd"))
