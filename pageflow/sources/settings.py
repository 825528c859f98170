"""Settings documents as JSON: defaults, migration, shallow patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions.text import migrate_endpoint, primary_subtag

# Defaults of a settings document; the target language comes from the locale.
DEFAULTS = {"provider": "google", "developerMode": "false", "debugMode": "false", "customRules": ""}
OPENAI = {"apiKey": "", "baseUrl": "https://api.openai.com/v1", "model": "gpt-4o-mini", "systemPrompt": "You are a translator. Translate the following text to {{targetLang}}. Return only the translation, no explanations. If the text cannot be translated, return it unchanged."}


def read_settings(stored: DataFrame, locale: Column, document: str = "document") -> DataFrame:
    """stored with each setting as a column of strings. A stored openai object replaces the default one whole."""
    value = lambda path: F.get_json_object(document, path)
    openai = value("$.openai")
    out = {k: F.coalesce(value(f"$.{k}"), F.lit(v)) for k, v in DEFAULTS.items()} | {"targetLang": F.coalesce(value("$.targetLang"), primary_subtag(locale))}
    for k, v in OPENAI.items():
        own = value(f"$.openai.{k}")
        if k == "baseUrl":
            own = F.coalesce(own, migrate_endpoint(value("$.openai.endpoint")))
        out[f"openai_{k}"] = F.when(openai.isNull(), F.lit(v)).otherwise(own)
    return stored.withColumns(out)


def patch_settings(old: Column, patch: Column) -> Column:
    """Maps of settings: only what a patch gives is replaced."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, patch)
