"""Settings, passed explicitly to the operators that need them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 900
    chunk_overlap: int = 150
    min_chunk_chars: int = 120
    column_tolerance: float = 20.0
    embed_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    embed_dim: int = 384
    embed_batch: int = 64
    embed_device: str = ""
    top_k: int = 5
    retrieval_mode: str = "hybrid"
    distinct_pages: bool = True
    rrf_k: int = 60
    sim_threshold: float = 0.50
    gen_mode: str = "extractive"
    llm_api_key: str = ""
    llm_model: str = "codestral-2508"
    max_answer_tokens: int = 400
    llm_min_interval: float = 1.1
    llm_retries: int = 4


def read_env_file(path: str | Path) -> dict[str, str]:
    """NAME=value lines; blank lines and those that start with # are skipped, quotes around a value go."""
    out: dict[str, str] = {}
    if not Path(path).is_file():
        return out
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def from_env(environ: Mapping[str, str] | None = None, env_file: str | Path | None = None) -> Settings:
    """Environment over file over default. Names are those of the fields in capitals; only "0" turns a
    switch off. Nothing is created on disk."""
    known = read_env_file(env_file) if env_file else {}
    known |= dict(os.environ if environ is None else environ)
    got = {}
    for f in fields(Settings):
        raw = known.get(f.name.upper())
        if raw is not None:
            kind = type(f.default)
            got[f.name] = raw != "0" if kind is bool else kind(raw)
    return Settings(**got)
