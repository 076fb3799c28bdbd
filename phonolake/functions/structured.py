"""Structured output of language models: tolerant parsing, defaults, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys of an answer, the intents that it may name, and the one for none.
INTENT_KEY, CONFIRM_KEY = "intent", "requires_confirmation"
INTENTS = ["payment_status", "refund_issue", "account_inquiry", "general_query"]
UNKNOWN = "unknown"
ENTITIES = ["amount", "order_id", "brand_or_product"]


def answer_schema(intent_key: str = INTENT_KEY, confirm_key: str = CONFIRM_KEY) -> str:
    return f"cleaned_transcript string, {intent_key} string, entities struct<{', '.join(f'{e}: string' for e in ENTITIES)}>, {confirm_key} boolean"


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def parse_answer(text: Column, raw: Column, unsure: Column, intent_key: str = INTENT_KEY, confirm_key: str = CONFIRM_KEY) -> Column:
    """Struct of the answer; on any failure the raw text, intent unknown, empty entities, and confirmation where the model was unsure."""
    j = F.from_json(text, answer_schema(intent_key, confirm_key), {"mode": "PERMISSIVE"})
    good = F.coalesce(valid_json(text), F.lit(False))
    empty = F.struct(*[F.lit(None).cast("string").alias(c) for c in ENTITIES])
    return F.struct(
        F.when(good, F.coalesce(j["cleaned_transcript"], raw)).otherwise(raw).alias("cleaned_transcript"),
        F.when(good, F.coalesce(j[intent_key], F.lit(UNKNOWN))).otherwise(F.lit(UNKNOWN)).alias("intent"),
        F.when(good, F.coalesce(j["entities"], empty)).otherwise(empty).alias("entities"),
        F.when(good, F.coalesce(j[confirm_key], unsure)).otherwise(unsure).alias("requires_confirmation"),
    )


def field(text: Column, path: str, default: str = "") -> Column:
    """A field of a JSON text, or the default."""
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def render(value: Column) -> Column:
    """A struct as JSON with its nulls."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def known_intent(intent: Column) -> Column:
    return F.coalesce(intent.isin(INTENTS), F.lit(False))


def last_wins(a: Column, b: Column) -> Column:
    """Two maps as one; the right one's value stands where both have a key."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))), F.map_entries(b)))
