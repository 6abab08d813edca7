"""Settings that a run is given, with their defaults, and what the environment overrides."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from . import catalogue


@dataclass(frozen=True)
class Settings:
    """token_mode: `numbered` gives each value of a type a token of its own, `label` the type's label.

    filters: which checks drop spans that a model found.
    """

    titles: tuple[str, ...] = catalogue.NAME_TITLES
    similarity_threshold: float = 0.85
    similarity_weights: Mapping[str, float] = field(default_factory=lambda: {"levenshtein": 0.5, "jaccard": 0.3, "phonetic": 0.2})
    confidence_weights: Mapping[str, float] = field(default_factory=lambda: {"method": 0.5, "validation": 0.3, "agreement": 0.2})
    context: int = 80
    min_confidence: float = 0.0
    token_mode: str = "numbered"
    filters: Mapping[str, bool] = field(default_factory=lambda: {"stopwords": True, "min_length": True, "capitalization": True, "title_check": True, "require_title": False})
    max_file_bytes: int = 25 * 1024 * 1024
    max_text_chars: int = 10_000_000

    def weights(self) -> dict[str, float]:
        """Similarity weights that sum to 1."""
        total = sum(self.similarity_weights.values())
        return {k: v / total for k, v in self.similarity_weights.items()} if total > 0 else dict(self.similarity_weights)


def from_environment(env: Mapping[str, str] | None = None) -> Settings:
    """Settings by the variables ANONYMIZER_TITLES, ANONYMIZER_SIMILARITY_THRESHOLD and ANONYMIZER_SIMILARITY_WEIGHTS; a value that isn't one is passed over."""
    env = os.environ if env is None else env
    plain, changed = Settings(), {}
    if titles := [t.strip().lower() for t in env.get("ANONYMIZER_TITLES", "").split(",") if t.strip()]:
        changed["titles"] = tuple(titles)
    try:
        changed["similarity_threshold"] = float(env.get("ANONYMIZER_SIMILARITY_THRESHOLD") or plain.similarity_threshold)
    except ValueError:
        pass
    weights = dict(plain.similarity_weights)
    try:
        weights |= {k.strip(): float(v) for k, _, v in (p.partition("=") for p in env.get("ANONYMIZER_SIMILARITY_WEIGHTS", "").split(",")) if v}
    except ValueError:
        pass
    return Settings(**changed, similarity_weights=weights)


def terms(text: str) -> list[str]:
    """One term a line; blank lines and those that start with # are none."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def term_lists(env: Mapping[str, str] | None = None) -> dict[str, list[str]]:
    """Cities, legal terms and titles that are no names: the lists here, a JSON file of lists, and comma-separated variables."""
    env = os.environ if env is None else env
    lists = {"cities": [*catalogue.CITIES], "legal_terms": [*catalogue.LEGAL_TERMS], "titles": [*catalogue.PROFESSIONS]}
    if path := env.get("ANONYMIZER_EXTRA_TERMS_FILE"):
        with open(path, encoding="utf-8") as f:
            for name, more in json.load(f).items():
                lists.setdefault(name, []).extend(more)
    for name in ("cities", "legal_terms", "titles"):
        lists[name] += [t.strip() for t in env.get(f"ANONYMIZER_EXTRA_{name.upper()}", "").split(",") if t.strip()]
    return {name: sorted(set(x)) for name, x in lists.items()}
