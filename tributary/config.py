"""Settings of the operators, each overridable by an environment variable.

Blank or unusable values fall back to the default; a number of 0 is kept.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from typing import Any

from tributary.functions.text import BUG_KEYWORDS


def _parse(raw: str, default: Any) -> Any:
    raw = raw.strip()
    if not raw:
        return default
    try:
        if isinstance(default, bool):
            word = raw.lower()
            return True if word in ("1", "true", "yes", "on") else False if word in ("0", "false", "no", "off") else default
        if isinstance(default, int):
            return int(raw)
        if isinstance(default, float):
            return None if raw.lower() == "none" else float(raw)
        if isinstance(default, list):
            return [x.strip().lower() for x in raw.split(",") if x.strip()] or default
    except ValueError:
        return default
    return raw


class FromEnv:
    """``from_env`` reads ``PREFIX_FIELD``, or the name that a field's metadata gives."""

    PREFIX = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None):
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            name, default = f.metadata.get("env", f"{cls.PREFIX}_{f.name.upper()}"), getattr(cls(), f.name)
            if name in env:
                given[f.name] = _parse(env[name], default)
        return cls(**given)


@dataclass
class BloomConfig(FromEnv):
    PREFIX = "BLOOM"
    capacity: int = 200_000
    error_rate: float = 0.01
    buckets: int = 64
    dup_sink: str = "delta/dup_bloom"
    metrics_sink: str = "delta/gold_dup_rate_1m"
    reset_interval_minutes: int = 60
    watermark_minutes: int = 2


@dataclass
class ReservoirConfig(FromEnv):
    PREFIX = "RESERVOIR"
    sample_size: int = 100
    sink: str = "delta/reservoir_samples"
    watermark_minutes: int = 2


@dataclass
class FMConfig(FromEnv):
    PREFIX = "FM"
    num_hash_functions: int = field(default=5, metadata={"env": "FM_NUM_HASHES"})
    sink: str = "delta/fm_distinct_users"
    compute_exact_for_windows_under: int = field(default=1_000_000, metadata={"env": "FM_EXACT_THRESHOLD"})
    window_column: str = "ingest_time"
    window_size: str = "10 seconds"
    watermark_minutes: int = 2


@dataclass
class MetricsConfig(FromEnv):
    storage_seconds: int = field(default=60, metadata={"env": "STORAGE_SECONDS"})
    accuracy_first_seconds: int = field(default=60, metadata={"env": "ACCURACY_FIRST_SECONDS"})
    accuracy_seconds: int = field(default=180, metadata={"env": "ACCURACY_SECONDS"})
    accuracy_windows: int = field(default=50, metadata={"env": "ACCURACY_WINDOWS"})
    performance_sink: str = field(default="delta/performance_metrics", metadata={"env": "PERF_SINK"})
    storage_sink: str = field(default="delta/storage_metrics", metadata={"env": "STORAGE_SINK"})


@dataclass
class DGIMConfig(FromEnv):
    PREFIX = "DGIM"
    window_minutes: int = 60
    compute_exact: bool = True
    sink: str = "delta/gold_dgim_highstar"


@dataclass
class LSHConfig(FromEnv):
    """``bands`` 0 chooses them by ``threshold``; ``dp_seed`` 0 leaves the noise without a seed; ``bug_max_star`` may be None."""

    PREFIX = "LSH"
    # what is read
    source_path: str = "delta/bronze_reviews"
    source_format: str = "parquet"
    text_column: str = "text"
    event_time_column: str = ""
    filter_bug_reviews: bool = True
    bug_keywords: list[str] = field(default_factory=lambda: list(BUG_KEYWORDS))
    bug_max_star: float | None = 3.0
    max_reviews: int = 0
    # how it is compared
    min_token_length: int = 3
    num_perm: int = 128
    threshold: float = 0.85
    bands: int = 0
    random_seed: int = 42
    min_jaccard: float = 0.85
    max_candidates: int = 0
    # how it is told
    dp_epsilon: float = 1.0
    dp_sensitivity: float = 1.0
    dp_min_noisy_count: float = 0.0
    dp_seed: int = 0
    raw_sink: str = "delta/dup_lsh_raw"
    dp_sink: str = "delta/dup_lsh_dp"
    bug_summary_sink: str = "delta/dup_lsh_bug_summary"

    def split(self, recall: float = 0.95) -> int:
        """Bands: the given ones, else the fewest by which a pair at ``threshold`` meets with a probability of at least ``recall``.

        With 128 functions and a threshold of 0.85 these are 16 bands of 8 (0.994); 8 bands of 16 meet with 0.46.
        """
        if self.bands:
            return self.bands
        splits = [b for b in range(1, self.num_perm + 1) if self.num_perm % b == 0]
        return next((b for b in splits if 1 - (1 - self.threshold ** (self.num_perm // b)) ** b >= recall), self.num_perm)


@dataclass
class SourceConfig(FromEnv):
    """Where the stream comes from; a path takes the place of the topic."""

    PREFIX = "STREAM"
    servers: str = "localhost:9092"
    topic: str = "reviews"
    starting: str = "latest"
    path: str = ""
    root: str = "delta"
    trigger: str = "5 seconds"


@dataclass
class ProducerConfig(FromEnv):
    source_file: str = field(default="data/landing/yelp_small.jsonl", metadata={"env": "YELP_SOURCE_FILE"})


@dataclass
class LoaderConfig(FromEnv):
    PREFIX = "PG"
    host: str = "localhost"
    port: int = 5432
    db: str = "reviews"
    user: str = "postgres"
    password: str = "postgres"

    def url(self) -> str:
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.db}"
