"""Limits, provider settings and small lookup tables that results depend on."""

from __future__ import annotations

# Cache limits.
CACHE_ENTRIES, CACHE_DAYS = 10_000, 30

# Batching by provider (milliseconds from the first item, items, characters).
PROVIDERS = {
    "microsoft": {"window_ms": 50, "size": 25, "chars": None},
    "google": {"window_ms": 50, "size": 20, "chars": 14_000},
    "openai": {"window_ms": 100, "size": 8, "chars": 1_000},
}

# Characters of a request, of a short text, growth of an explanation, of a text set on the same line.
REQUEST_CHARS, SHORT_CHARS, EXPLANATION_RATIO, SAME_LINE_CHARS = 950, 20, 3, 40

# Language codes that a provider names otherwise.
LANG_CODES = {
    "zh": "zh-Hans",
    "zh-cn": "zh-Hans",
    "zh-CN": "zh-Hans",
    "zh-tw": "zh-Hant",
    "zh-TW": "zh-Hant",
    "tl": "fil",
    "iw": "he",
    "no": "nb",
    "sr": "sr-Cyrl",
    "mn": "mn-Cyrl",
    "hmn": "mww",
    "ku": "kmr",
}

# Target languages by their own names.
LANGUAGES = {
    "zh": "中文",
    "en": "English",
    "ja": "日本語",
    "ko": "한국어",
    "fr": "Français",
    "de": "Deutsch",
    "es": "Español",
    "pt": "Português",
    "ru": "Русский",
    "ar": "العربية",
    "it": "Italiano",
    "nl": "Nederlands",
    "pl": "Polski",
    "tr": "Türkçe",
    "vi": "Tiếng Việt",
    "th": "ไทย",
    "id": "Bahasa Indonesia",
    "uk": "Українська",
    "cs": "Čeština",
    "sv": "Svenska",
}

# Named entities.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}

# Hours between two reads of a rule file; characters of a message that are kept; of a clone that are compared, and the least.
RULE_HOURS, MESSAGE_CHARS, CLONE_CHARS, CLONE_LEAST = 24, 200, 32, 8

# Milliseconds until a toggle takes effect, and until a page is scanned again after its start or a change of address.
TOGGLE_MS, RESCAN_MS = 100, 1000

# What a provider's error text holds, and what is shown for it, in order.
ERRORS = [
    ("401", "Invalid API key."),
    ("403", "Forbidden — check your API key permissions."),
    ("429", "Rate limited — try again in a moment."),
    ("404", "Model or URL not found — verify the base URL and model name."),
    ("400", "Bad request — likely the model is not supported by this provider, or required fields are missing. Some newer models (e.g. gpt-5 family) only work via OpenAI's Responses API, which this extension doesn't support. Raw: {}"),
]
PROVIDER_DOWN, UNREACHABLE = "Provider error — try again later.", "Cannot reach the server — check the base URL and your network."
