"""Settings of a run, with the defaults of the rules, from a dictionary or a file."""
from __future__ import annotations

import dataclasses
import json
import os


@dataclasses.dataclass(frozen=True)
class Gen1:
    """Rules of the first generation."""

    target_language: str = "en"
    min_confidence: float = 0.65
    min_words: int = 50
    max_words: int = 100_000
    min_alpha_ratio: float = 0.5
    min_terminal_punct_ratio: float = 0.3
    max_pii_density: float = 0.3
    toxicity_action: str = "flag"
    extra_domains: tuple[str, ...] = ()
    extra_keywords: tuple[str, ...] = ()


@dataclasses.dataclass(frozen=True)
class Run:
    """Sizes of a run."""

    doc_limit: int = 12_000
    eval_sample_size: int = 500
    audit_sample_size: int = 50
    classifier_train_limit: int = 5_000
    random_seed: int = 42
    output_dir: str = ""
    api_key: str = ""


#: What the two modes set.
MODES = {"smoke_test": {"doc_limit": 12_000, "eval_sample_size": 500, "audit_sample_size": 50}, "full_run": {"doc_limit": 100_000, "eval_sample_size": 2_000, "audit_sample_size": 100}}


def read(path: str) -> dict:
    """A JSON file, or a YAML one where a reader for it is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f) or {}
        return json.load(f)


def lifted(settings: dict, mode: str) -> dict:
    """``settings`` with the block of ``mode`` at the top level, which wins; an unknown mode raises."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return {**{k: v for k, v in settings.items() if k not in MODES}, **MODES[mode], **settings.get(mode, {})}


def _made(kind, settings: dict):
    known = {f.name: f for f in dataclasses.fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items() if k in known})


def run(settings: dict | None = None, mode: str = "smoke_test", generation: int = 1) -> Run:
    """Settings of a run in ``mode``; the key of a service comes from the environment (PIPELINE_API_KEY)."""
    made = lifted(settings or {}, mode)
    made.setdefault("output_dir", f"data/gen{generation}_output/{mode}")
    made["api_key"] = os.environ.get("PIPELINE_API_KEY", made.get("api_key", ""))
    return _made(Run, made)


def gen1(settings: dict | None = None) -> Gen1:
    return _made(Gen1, settings or {})
