"""Settings of a pipeline: sections with bounds, dotted overrides, YAML, short hashes; grids of experiments over them."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any


def _choice(value: Any, *of: Any):
    return field(default=value, metadata={"of": of})


def _within(value: float, low: float | None = None, high: float | None = None, open_ends: bool = False):
    return field(default=value, metadata={"low": low, "high": high, "open": open_ends})


@dataclass(frozen=True)
class Section:
    """Fields check themselves against their choices and bounds; ValueError names the field."""

    def __post_init__(self) -> None:
        for f in fields(self):
            value, meta = getattr(self, f.name), f.metadata
            if "of" in meta:
                if value is False and "off" in meta["of"]:  # YAML reads a bare off as false
                    object.__setattr__(self, f.name, "off")
                elif value not in meta["of"]:
                    raise ValueError(f"{f.name}: {value!r} is none of {', '.join(map(str, meta['of']))}")
            elif "low" in meta:
                low, high, ends = meta["low"], meta["high"], meta["open"]
                if isinstance(value, bool) or not isinstance(value, (int, float)):
                    raise ValueError(f"{f.name}: {value!r} is no number")
                if (low is not None and (value < low or (ends and value == low))) or (high is not None and (value > high or (ends and value == high))):
                    raise ValueError(f"{f.name}: {value!r} is out of bounds")


@dataclass(frozen=True)
class Chunking(Section):
    strategy: str = _choice("structure", "fixed", "recursive", "semantic", "structure")
    size: int = _within(200, 16, 4000)
    overlap: int = _within(30, 0)
    contextual_headers: bool = True
    semantic_percentile: float = _within(85.0, 0, 100, True)
    min_size: int = _within(25, 0)


@dataclass(frozen=True)
class Retrieval(Section):
    mode: str = _choice("hybrid", "dense", "lexical", "hybrid")
    approximate: bool = False
    k: int = _within(5, 1, 50)
    fetch_k: int = _within(30, 1, 500)
    rrf_k: int = _within(60, 1)
    dense_weight: float = _within(1.0, 0)
    lexical_weight: float = _within(1.0, 0)
    rerank: str = _choice("none", "none", "mmr", "maxsim", "llm", "cross_encoder")
    rerank_candidates: int = _within(20, 1)
    mmr_lambda: float = _within(0.7, 0, 1)
    query_expansion: str = _choice("none", "none", "multi_query", "hyde")
    exclude_superseded: bool = True
    num_query_variants: int = _within(3, 1, 8)
    cross_encoder_model: str = "BAAI/bge-reranker-base"


@dataclass(frozen=True)
class Generation(Section):
    prompt: str = "strict"
    max_context_tokens: int = _within(1800, 100)
    context_order: str = _choice("relevance", "relevance", "sandwich")
    max_sentences: int = _within(2, 1, 10)
    abstain_threshold: float = 0.46
    temperature: float = _within(0.0, 0)


@dataclass(frozen=True)
class Guard(Section):
    injection: str = _choice("drop", "off", "flag", "drop")
    grounding: str = _choice("flag", "off", "flag", "abstain")
    grounding_threshold: float = _within(0.5, 0, 1)


SECTIONS = {"chunking": Chunking, "retrieval": Retrieval, "generation": Generation, "guard": Guard}


@dataclass(frozen=True)
class Pipeline:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    guard: Guard = field(default_factory=Guard)

    @classmethod
    def of(cls, data: Mapping[str, Mapping[str, Any]] | None) -> Pipeline:
        """From nested mappings; ValueError for unknown names."""
        made = {}
        for name, values in (data or {}).items():
            if name not in SECTIONS:
                raise ValueError(f"unknown section {name!r}")
            unknown = set(values or {}) - {f.name for f in fields(SECTIONS[name])}
            if unknown:
                raise ValueError(f"unknown fields of {name}: {', '.join(sorted(unknown))}")
            made[name] = SECTIONS[name](**(values or {}))
        return cls(**made)

    @classmethod
    def load(cls, path: str) -> Pipeline:
        """From YAML; the settings may stand under ``pipeline``."""
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        return cls.of(data.get("pipeline", data))

    def with_overrides(self, overrides: Mapping[str, Any]) -> Pipeline:
        """A copy with {"section.field": value}; KeyError for an unknown path."""
        out = self
        for path, value in overrides.items():
            section, _, name = path.partition(".")
            if section not in SECTIONS or name not in {f.name for f in fields(SECTIONS[section])}:
                raise KeyError(f"unknown setting {path!r}")
            out = replace(out, **{section: replace(getattr(out, section), **{name: value})})
        return out

    def get(self, path: str) -> Any:
        section, _, name = path.partition(".")
        return getattr(getattr(self, section), name)

    def fingerprint(self, *sections: str) -> str:
        """Ten hexadecimal digits over all settings, or those of some sections."""
        data = asdict(self)
        return hashlib.sha256(json.dumps({s: data[s] for s in sections or data}, sort_keys=True).encode()).hexdigest()[:10]


def label(value: Any) -> str:
    return {True: "on", False: "off"}[value] if isinstance(value, bool) else str(value)


@dataclass(frozen=True)
class Experiment:
    name: str
    overrides: dict[str, Any]
    config: Pipeline
    factor: str | None = None
    level: Any = None


def experiments(baseline: Mapping, factors: Mapping[str, Sequence], interactions: Sequence[Sequence[str]] = ()) -> tuple[list[Experiment], dict[str, list[tuple[Any, str]]], list[dict]]:
    """The baseline, every factor's levels one at a time, and full blocks of factors; settings that were there before keep their first name.

    Also the name of each factor's levels, and of each block's cells.
    """
    base = Pipeline.of(baseline)
    made = {base.fingerprint(): Experiment("baseline", {}, base)}

    def named(overrides: dict[str, Any], factor: str | None = None) -> str:
        config = base.with_overrides(overrides)
        name = ", ".join(f"{k}={label(v)}" for k, v in overrides.items())
        return made.setdefault(config.fingerprint(), Experiment(name, overrides, config, factor, overrides[factor] if factor else None)).name

    levels = {f: [(v, named({f: v}, f)) for v in values] for f, values in factors.items()}
    blocks = []
    for block in interactions:
        cells = {"|".join(map(label, combo)): named(dict(zip(block, combo))) for combo in itertools.product(*(factors[f] for f in block))}
        blocks.append({"factors": list(block), "levels": [list(map(label, factors[f])) for f in block], "cells": cells})
    return list(made.values()), levels, blocks


# US dollars for a million tokens in and out.
PRICES = {"gpt-6-luna": (0.10, 0.50), "gpt-4o-mini": (0.15, 0.60), "text-embedding-3-small": (0.02, 0.0), "text-embedding-3-large": (0.13, 0.0)}


def prices(environ: Mapping[str, str] = os.environ, name: str = "TESSELLA_PRICES") -> dict[str, tuple[float, float]]:
    """The price table, with what the environment's JSON object adds; malformed JSON adds nothing."""
    try:
        more = {model: (float(pair[0]), float(pair[1])) for model, pair in json.loads(environ.get(name) or "{}").items()}
    except (ValueError, TypeError, IndexError, KeyError, AttributeError):
        more = {}
    return {**PRICES, **more}


@dataclass(frozen=True)
class Settings:
    """What a running engine needs to know, from the environment (``TESSELLA_`` and the field's name in capitals)."""

    data_dir: str = ".tessella"
    collection: str = "default"
    pipeline_config: str = ""
    embedder: str = "auto"
    embedding_model: str = "text-embedding-3-small"
    embedding_cache: bool = True
    generator: str = "auto"
    llm_model: str = "gpt-6-luna"
    llm_base_url: str = ""
    llm_key: str = field(default="", repr=False)
    api_key: str = field(default="", repr=False)
    llm_max_tokens: int = 500
    max_upload_mb: int = 20
    log_level: str = "INFO"
    log_json: bool = False

    @classmethod
    def read(cls, environ: Mapping[str, str] = os.environ) -> Settings:
        kinds = {"bool": lambda s: s.strip().lower() in ("1", "true", "yes", "on"), "int": int, "str": str}
        return cls(**{f.name: kinds[str(f.type)](environ[key]) for f in fields(cls) if (key := f"TESSELLA_{f.name.upper()}") in environ})

    @property
    def resolved_embedder(self) -> str:
        return self.embedder if self.embedder != "auto" else "remote" if self.llm_key else "hashing"

    @property
    def resolved_generator(self) -> str:
        return self.generator if self.generator != "auto" else "llm" if self.llm_key or self.llm_base_url else "extractive"

    def pipeline(self) -> Pipeline:
        return Pipeline.load(self.pipeline_config) if self.pipeline_config and os.path.exists(self.pipeline_config) else Pipeline()
