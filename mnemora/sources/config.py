"""Configuration: defaults, then a TOML file, then environment variables; all problems are reported together."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from .. import schema as S


@dataclass(frozen=True)
class Config:
    """Settings of the engine."""

    recall_limit: int = S.DEFAULT_LIMIT
    half_life_days: float = S.HALF_LIFE_DAYS
    hybrid: bool = True
    similarity: float = S.SIMILARITY
    group_cap: int = S.GROUP_CAP
    schedule: str = "daily"
    max_calls: int = 100
    max_retired: int = 5000
    job_attempts: int = S.JOB_ATTEMPTS
    embedding_dimensions: int = 64
    extra_categories: tuple[str, ...] = ()

    def problems(self) -> list[str]:
        """What is wrong with the values."""
        checks = {
            "recall_limit must be 1 to 50": 1 <= self.recall_limit <= S.MAX_LIMIT,
            "half_life_days must not be negative": self.half_life_days >= 0,
            "similarity must be above 0 and at most 1": 0 < self.similarity <= 1,
            "group_cap must be at least 2": self.group_cap >= 2,
            "schedule must be hourly, daily or weekly": self.schedule in ("hourly", "daily", "weekly"),
            "budgets must not be negative": min(self.max_calls, self.max_retired) >= 0,
            "job_attempts must be at least 1": self.job_attempts >= 1,
            "embedding_dimensions must be at least 1": self.embedding_dimensions >= 1,
        }
        return [name for name, good in checks.items() if not good]


def parse(kind: str, value: object) -> object:
    """A setting's value from a file or an environment variable."""
    if kind == "bool":
        if str(value).lower() not in ("true", "false", "1", "0"):
            raise ValueError(value)
        return str(value).lower() in ("true", "1")
    if kind.startswith("tuple"):
        return tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(value)
    return {"int": int, "float": float, "str": str}[kind](value)


def load(path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "MNEMORA_") -> Config:
    """The configuration; unknown names, unreadable and bad values raise one error that lists them all."""
    kinds, given, wrong = {f.name: str(f.type) for f in fields(Config)}, {}, []
    if path:
        with open(path, "rb") as f:
            given |= tomllib.load(f)
    env = os.environ if env is None else env
    given |= {k.removeprefix(prefix).lower(): v for k, v in env.items() if k.startswith(prefix)}
    values = {}
    for name, value in given.items():
        if name not in kinds:
            wrong.append(f"unknown setting {name}")
            continue
        try:
            values[name] = parse(kinds[name], value)
        except (TypeError, ValueError, KeyError):
            wrong.append(f"{name} cannot be {value!r}")
    made = replace(Config(), **values)
    wrong += made.problems()
    if wrong:
        raise ValueError("; ".join(wrong))
    return made
