"""Configuration: nested dictionaries, with overrides merged into defaults."""

from __future__ import annotations

from . import constants

DEFAULTS: dict = {
    "dataset": {"sources": [], "per_class_cap": {"train": None, "validation": None, "test": None}, "languages": {}, "balance_languages": False},
    "classes": {"names": list(constants.CLASS_NAMES), "remap": {}},
    "known_repos": [],
    "stage2": {"enabled": True, "features": list(constants.FEATURES), "languages": None, "train_on": "agent_commits", "folds": 5},
    "generator_holdout": {"per_generator": {"train": 500, "test": 300}, "seed": 42},
    "agent_commits": {**constants.CORPUS, "languages": constants.CORPUS_LANGUAGES, "licenses": constants.LICENSES, "exclude": constants.EXCLUDE_GLOBS},
    "training": dict(constants.TRAINING),
    "commit_classification": {"max_files_per_commit": constants.MAX_FILES_SCORED, "supported_extensions": constants.SUPPORTED_EXTENSIONS},
}


def merged(base: dict, over: dict) -> dict:
    """base with over's values, dictionaries merged in turn; known_repos are added
    to, not replaced."""
    out = dict(base)
    for key, value in over.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merged(out[key], value)
        elif key == "known_repos":
            out[key] = [*(out.get(key) or []), *(value or [])]
        else:
            out[key] = value
    return out


def load(path: str | None = None) -> dict:
    if path is None:
        return merged(DEFAULTS, {})
    import yaml

    with open(path, encoding="utf-8") as f:
        return merged(DEFAULTS, yaml.safe_load(f) or {})
