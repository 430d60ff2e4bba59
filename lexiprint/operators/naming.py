"""Names and kinds by ordered rules: model names, categories of headlines, kinds of court documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern, family, name and version of a model; the first pattern that is found counts.
MODEL_NAMES = [
    (r"claude-3[.-]opus", "anthropic", "claude-opus", "3"),
    (r"claude-3[.-]sonnet", "anthropic", "claude-sonnet", "3"),
    (r"claude-3[.-]haiku", "anthropic", "claude-haiku", "3"),
    (r"claude-2", "anthropic", "claude", "2"),
    (r"claude-instant", "anthropic", "claude-instant", "1"),
    (r"claude", "anthropic", "claude", "unknown"),
    (r"gpt-4o", "openai", "gpt-4o", ""),
    (r"gpt-4-turbo", "openai", "gpt-4-turbo", ""),
    (r"gpt-4-\d+", "openai", "gpt-4", "dated"),
    (r"gpt-4", "openai", "gpt-4", ""),
    (r"gpt-3\.5-turbo", "openai", "gpt-3.5-turbo", ""),
    (r"chatgpt", "openai", "chatgpt", ""),
    (r"gemini-pro", "google", "gemini-pro", ""),
    (r"gemini-1\.5", "google", "gemini-1.5", ""),
    (r"gemini", "google", "gemini", ""),
    (r"bard", "google", "bard", ""),
    (r"llama-3[.-]70b", "meta", "llama3-70b", ""),
    (r"llama-3[.-]8b", "meta", "llama3-8b", ""),
    (r"llama-3", "meta", "llama3", ""),
    (r"llama-2-70b", "meta", "llama2-70b", ""),
    (r"llama-2-13b", "meta", "llama2-13b", ""),
    (r"llama-2-7b", "meta", "llama2-7b", ""),
    (r"llama-2", "meta", "llama2", ""),
    (r"llama", "meta", "llama", ""),
    (r"mixtral-8x7b", "mistral", "mixtral-8x7b", ""),
    (r"mixtral", "mistral", "mixtral", ""),
    (r"mistral-7b", "mistral", "mistral-7b", ""),
    (r"mistral-large", "mistral", "mistral-large", ""),
    (r"mistral-medium", "mistral", "mistral-medium", ""),
    (r"mistral", "mistral", "mistral", ""),
    (r"vicuna", "lmsys", "vicuna", ""),
    (r"wizardlm", "microsoft", "wizardlm", ""),
    (r"zephyr", "huggingface", "zephyr", ""),
    (r"yi-", "01ai", "yi", ""),
    (r"qwen", "alibaba", "qwen", ""),
    (r"gemma", "google", "gemma", ""),
    (r"phi-", "microsoft", "phi", ""),
    (r"command", "cohere", "command", ""),
]
# Parts of a name and the family they stand for, in this order.
FAMILIES = [
    ("claude", "anthropic"),
    ("gpt", "openai"),
    ("gemini", "google"),
    ("llama", "meta"),
    ("mistral", "mistralai"),
    ("qwen", "alibaba"),
    ("yi", "01ai"),
    ("human", "human"),
]
# Parts of an identifier, and the family and name they stand for in merged corpora, in this order.
MERGED_NAMES = [
    (r"claude", "anthropic", "claude"),
    (r"gpt-4o", "openai", "gpt-4o"),
    (r"gpt-4", "openai", "gpt-4"),
    (r"gpt-3[.]5", "openai", "gpt-3.5"),
    (r"chatgpt", "openai", "gpt-4o"),
    (r"gemini", "google", "gemini"),
    (r"grok", "xai", "grok"),
    (r"llama", "meta", "llama"),
    (r"mistral", "mistral", "mistral"),
    (r"mixtral", "mistral", "mixtral"),
    (r"gemma", "google-open", "gemma"),
    (r"phi", "microsoft", "phi"),
    (r"qwen", "alibaba", "qwen"),
    (r"human", "human", "human"),
]
# Parts of an identifier that say more, as a name of their own or behind the name, in this order.
MERGED_WHOLE = [(r"sonnet", "claude-sonnet"), (r"opus", "claude-opus")]
MERGED_ENDS = [(r"2[.]0", "-2.0"), (r"1[.]5", "-1.5"), (r"8b", "-8b"), (r"70b", "-70b")]
# Pattern and category of a headline, in this order.
CATEGORIES = [
    (r"dies at|dead at", "obituary"),
    (r"photo|picture|image|video", "media"),
    (r"\?", "analysis"),
    (r"opinion|editorial|letter", "opinion"),
]
# Pattern and kind of a court document, in this order.
DOCUMENT_KINDS = [
    (r"\bcomplaint\b|\bpetition\b|\binitial\s+pleading\b", "COMPLAINT"),
    (r"\bmotion\s+(to|for)\b|\bmotion\s+in\s+limine\b|\bemergency\s+motion\b", "MOTION"),
    (r"\bbrief\b|\bmemorandum\s+(of|in)\s+(law|support|opposition)\b|\bopposition\b|\breply\b", "BRIEF"),
    (r"\border\b|\bjudgment\b|\bdecree\b|\bscheduling\s+order\b", "ORDER"),
    (r"\bopinion\b|\bmemorandum\s+decision\b|\bfindings\s+of\s+fact\b", "OPINION"),
    (r"\bresponse\b|\banswer\b|\breply\b", "RESPONSE"),
    (r"\bdeclaration\b|\baffidavit\b|\baffirmation\b", "DECLARATION"),
]


def by_rules(text: Column, rules: list[tuple[str, str]], other: str | Column) -> Column:
    """What stands beside the first pattern found in the lower-case ``text``, or ``other``; null texts count as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(other) if isinstance(other, str) else other
    for pattern, kind in reversed(rules):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def model_name(model: Column) -> Column:
    """``struct<family, name, version>``; a name no rule knows is its own, of the family 'unknown'."""
    plain = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    part = lambda at, other: by_rules(plain, [(r[0], r[at]) for r in MODEL_NAMES], other)
    return F.struct(part(1, "unknown").alias("family"), part(2, plain).alias("name"), part(3, "").alias("version"))


def merged_name(model: Column) -> Column:
    """``struct<family, name>`` as corpora are merged by; a name no rule knows is its own, of the family 'unknown'."""
    low = F.lower(F.coalesce(model, F.lit("")))
    family = by_rules(low, [(r[0], r[1]) for r in MERGED_NAMES], "unknown")
    name = by_rules(low, [(r[0], r[2]) for r in MERGED_NAMES], low)
    full = by_rules(low, MERGED_WHOLE, F.concat(name, by_rules(low, MERGED_ENDS, "")))
    return F.struct(family.alias("family"), F.when(family == "unknown", low).otherwise(full).alias("name"))


def category(headline: Column) -> Column:
    return by_rules(headline, CATEGORIES, "news")


def document_kind(description: Column) -> Column:
    return by_rules(description, DOCUMENT_KINDS, "OTHER")
