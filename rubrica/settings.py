"""Settings of a run: frozen on the driver, literals in plans."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Ingestion:
    pages_per_batch: int = 5
    image_resolution: int = 1024
    model_confidence: float = 0.85
    text_confidence: float = 0.90


@dataclass(frozen=True)
class Generation:
    model_name: str = "default"
    temperature: float = 0.1
    max_tokens: int = 4096
    top_p: float = 0.95
    context_documents: int = 5
    max_retries: int = 3
    retry_delay: float = 2.0


@dataclass(frozen=True)
class Quality:
    composite_threshold: float = 0.75
    readability_weight: float = 0.25
    coherence_weight: float = 0.25
    coverage_weight: float = 0.25
    schema_weight: float = 0.25
    max_remediation_rounds: int = 3


@dataclass(frozen=True)
class Attribution:
    window_size: int = 50
    window_stride: int = 25
    embed_batch: int = 32
    temperature_low: float = 0.8
    temperature_high: float = 1.0
    top_p: float = 0.95
    samples: int = 3
    majority: int = 2
    prefilter_percentile: float = 0.25
    first_year: int = 1990
    last_year: int = 2099


@dataclass(frozen=True)
class Settings:
    domain: str = "cancer"
    ingestion: Ingestion = field(default_factory=Ingestion)
    generation: Generation = field(default_factory=Generation)
    quality: Quality = field(default_factory=Quality)
    attribution: Attribution = field(default_factory=Attribution)
    output_dir: str = ""
    rubric_path: str = ""
    checkpoint_dir: str = ""
    page_references: bool = True
    checkpoints: bool = True

    def digest(self) -> str:
        """16 hexadecimal digits that name these settings."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    def as_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def save(self, path: str) -> None:
        Path(path).write_text(self.as_json())

    @classmethod
    def load(cls, path: str, **over) -> Settings:
        """From a file; what is given besides wins over it."""
        data = json.loads(Path(path).read_text()) | over
        kinds = {f.name: f.default_factory for f in fields(cls) if is_dataclass(f.default_factory)}
        return cls(**{k: kinds[k](**v) if k in kinds and isinstance(v, dict) else v for k, v in data.items()})

    @classmethod
    def for_cancer(cls, **over) -> Settings:
        return cls(domain="cancer", **over)

    @classmethod
    def for_cardiovascular(cls, **over) -> Settings:
        return cls(domain="cvd", **over)
