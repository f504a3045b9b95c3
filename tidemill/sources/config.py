"""Settings from the environment, checked once; an error names the variable."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from ..operators.policy import Policy

# The variables, and what each may be.
ROBOTS_MODES = ("ignore", "enforce")
LOG_LEVELS = ("error", "warn", "info", "debug")
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    timeout_ms: int = 30_000
    max_bytes: int = 10 * 1024 * 1024
    max_length_cap: int = 1_000_000
    concurrency: int = 3
    allow_loopback: bool = False
    private_hosts: tuple[str, ...] = ()
    robots: str = "ignore"
    log: str = "warn"

    @property
    def policy(self) -> Policy:
        return Policy(self.allow_loopback, bool(self.private_hosts), self.private_hosts)


def _positive(name: str, value: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", value.strip()) or int(value) == 0 or int(value) >= 1 << 63:
        raise ConfigError(f"{name}: must be a positive whole number")
    return int(value)


def _flag(name: str, value: str) -> bool:
    low = value.strip().lower()
    if low not in TRUE + FALSE:
        raise ConfigError(f"{name}: must be true or false")
    return low in TRUE


def _one_of(name: str, value: str, choices: tuple[str, ...], exact: bool = False) -> str:
    got = value if exact else value.strip().lower()
    if got not in choices:
        raise ConfigError(f"{name}: must be one of {', '.join(choices)}")
    return got


def _hosts(name: str, value: str) -> tuple[str, ...]:
    out = []
    for item in filter(None, (x.strip() for x in value.split(","))):
        host = item.removesuffix(".").lower()
        if not re.fullmatch(r"[a-z0-9_-]+(\.[a-z0-9_-]+)*", host) or len(host) > 253 or re.search(r"(^|\.)([0-9]+|0x[0-9a-f]*)$", host):
            raise ConfigError(f"{name}: {item!r} is not a plain hostname")
        out.append(host)
    return tuple(dict.fromkeys(out))


def load(env: Mapping[str, str] | None = None, prefix: str = "TIDEMILL_") -> Config:
    env = os.environ if env is None else env
    fields = {
        "TIMEOUT_MS": ("timeout_ms", _positive),
        "MAX_BYTES": ("max_bytes", _positive),
        "MAX_LENGTH": ("max_length_cap", _positive),
        "CONCURRENCY": ("concurrency", _positive),
        "ALLOW_LOOPBACK": ("allow_loopback", _flag),
        "ALLOW_PRIVATE_HOSTS": ("private_hosts", _hosts),
        "ROBOTS": ("robots", lambda n, v: _one_of(n, v, ROBOTS_MODES)),
        "LOG": ("log", lambda n, v: _one_of(n, v, LOG_LEVELS, exact=True)),
    }
    return Config(**{field: parse(prefix + name, env[prefix + name]) for name, (field, parse) in fields.items() if prefix + name in env})
