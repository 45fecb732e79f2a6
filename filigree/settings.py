"""Settings of the graph engine, read once on the driver and passed as arguments."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

# Weights that edge kinds start with.
Q_SEEDS = {
    "contradicts": 0.85,
    "applies_to": 0.55,
    "is_instance_of": 0.65,
    "extends": 0.60,
    "coordinate_terms": 0.70,
    "synonyms": 0.90,
}
TRUE_WORDS = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    embed_dim: int = 768
    log_level: str = "INFO"
    embed_batch_size: int = 16
    # Thresholds and factors that edges are made with.
    q_min_l15: float = 0.72
    disambig_threshold: float = 0.72
    meta_bary_cos_threshold: float = 0.90
    polysemy_q_floor: float = 0.40
    level_factor_alpha: float = 0.5
    fake_embed: bool = False
    embed_url: str = "http://localhost:11434/api/embed"
    embed_model: str = "nomic-embed-text"
    q_seeds: Mapping[str, float] = field(default_factory=lambda: dict(Q_SEEDS))
    max_depth: int = 15

    @classmethod
    def load(cls, path: str | os.PathLike = ".env", env: Mapping[str, str] | None = None) -> Settings:
        """Settings of a file of ``NAME=value`` lines, if there is one, and of the environment, which wins.

        Blank lines and those that begin with # are skipped; ``export`` before a name and
        quotes around a value are left out.
        """
        found: dict[str, str] = {}
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    name, equals, value = line.strip().removeprefix("export ").partition("=")
                    if equals and not name.startswith("#"):
                        value = value.strip()
                        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                            value = value[1:-1]
                        found[name.strip()] = value
        return cls().with_env({**found, **(os.environ if env is None else env)})

    def with_env(self, env: Mapping[str, str] | None = None) -> Settings:
        """Values of equally named upper-case variables, and ``Q_SEED_<KIND>``."""
        env = os.environ if env is None else env
        kinds = {bool: lambda x: x.strip().lower() in TRUE_WORDS, int: int, float: float, str: str}
        found = {}
        for f in fields(self):
            now = getattr(self, f.name)
            if f.name.upper() in env and type(now) in kinds:
                found[f.name] = kinds[type(now)](env[f.name.upper()])
        seeds = {k: float(env.get(f"Q_SEED_{k.upper()}", v)) for k, v in self.q_seeds.items()}
        return replace(self, **found, q_seeds=seeds)
