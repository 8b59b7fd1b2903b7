"""Defaults of the engine, one frozen dataclass a concern."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75

    def sha(self) -> str:
        """The settings' identity: an epoch of other settings is none of these."""
        return hashlib.sha256(json.dumps({"k1": self.k1, "b": self.b}, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Search:
    dense_top: int = 60
    sparse_top: int = 60
    rrf_k: int = 60
    rerank_max: int = 80
    min_passages: int = 8
    max_passages: int = 12
    token_budget: int = 6000
    max_per_book: int = 4
    rounds: int = 3
    limit_cap: int = 240


@dataclass(frozen=True)
class Chunking:
    target: int = 600
    overlap: int = 100
    maximum: int = 2048
    title_prefix: bool = True
    tokenizer: str = "words"
    tokenizer_path: str | None = None

    def sha(self) -> str:
        """The settings' identity: SHA-256 of their canonical JSON, under the names that stored chunks were made with."""
        own = {"target_tokens": self.target, "overlap_tokens": self.overlap, "max_tokens": self.maximum}
        own |= {"title_prefix": self.title_prefix, "tokenizer": self.tokenizer, "tokenizer_path": self.tokenizer_path}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Normalization:
    collapse_whitespace: bool = True
    dehyphenate: bool = True
    remove_repeated_headers: bool = True
    header_min_pages: int = 2
    header_min_chars: int = 3
    header_max_chars: int = 80


@dataclass(frozen=True)
class Quality:
    sparse_chars: int = 40
    replacement_share: float = 0.05
    image_area: float = 0.5


@dataclass(frozen=True)
class Jobs:
    max_attempts: int = 3
    lease_s: float = 300.0
    defer_s: float = 15.0
    backoff_base_s: float = 1.0
    backoff_cap_s: float = 300.0
    jitter: float = 0.2


@dataclass(frozen=True)
class Upkeep:
    gc_grace_s: float = 600.0
    discover_s: float = 3600.0
    embed_batch: int = 8
    summary_chars: int = 16_000
    min_summary_words: int = 20


@dataclass(frozen=True)
class Embedding:
    model_revision: str = ""
    model_name: str = ""
    dimensions: int = 1024
    dtype: str = "float32"
    normalize: bool = True
    batch: int = 8

    def sha(self) -> str:
        """The identity of what decides vectors' values; how they are batched doesn't."""
        if not self.model_revision:
            raise ValueError("no embedding model is configured")
        own = {"model_revision": self.model_revision, "model_name": self.model_name or self.model_revision, "dimensions": self.dimensions, "dtype": self.dtype, "normalize": self.normalize}
        return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
