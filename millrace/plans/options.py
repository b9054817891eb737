"""Options of a run, their defaults, and TOML configuration."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from ..functions import patterns as P
from ..operators.formats.custom import CustomFormat

SCHEMA_VERSION = 1


#: How the exact tokenizer cuts a text before it looks pieces up.
TOKEN_PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


class ConfigError(ValueError):
    """A configuration file has an unknown key or a bad value."""


class OptionError(ValueError):
    """Options contradict each other or name something unknown."""


class TokenizerUnavailable(RuntimeError):
    """The exact tokenizer was asked for without a vocabulary file."""


@dataclass(frozen=True)
class SiftOptions:
    """How logs are distilled. ``format`` ``auto`` detects; 0 turns budget, cap and deduplication off."""

    format: str = "auto"
    envelope: str = "auto"
    severity: str = "error"
    keep_warnings: bool = False
    context: int = P.CONTEXT_LINES
    keep_vendor: bool = False
    dedupe_window: int = 0
    budget: int = 0
    budget_reserve: int = P.BUDGET_RESERVE
    max_events: int = 0
    output: str = "text"
    footer: bool = True
    fence: str = ""
    strict: bool = False
    passthrough: bool = False
    tokenizer: str = "heuristic"
    vocabulary: str = ""
    token_pattern: str = TOKEN_PATTERN
    sample_bytes: int = P.SAMPLE_BYTES
    formats: tuple[CustomFormat, ...] = ()
    #: Options that logs of one format get instead: name of the format, and pairs of option and value.
    by_format: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = ()

    def __post_init__(self):
        if self.severity not in ("error", "warn", "info"):
            raise OptionError(f"unknown severity {self.severity!r}")
        if self.output not in ("text", "markdown", "json", "ndjson"):
            raise OptionError(f"unknown output {self.output!r}")
        if self.tokenizer not in ("heuristic", "tiktoken"):
            raise OptionError(f"unknown tokenizer {self.tokenizer!r}; known: heuristic, tiktoken")
        if self.tokenizer == "tiktoken" and not self.vocabulary:
            raise TokenizerUnavailable("the exact tokenizer needs a vocabulary file: set vocabulary to the path of its ranks")
        for name in ("budget", "max_events", "dedupe_window"):
            if getattr(self, name) < 0:
                raise OptionError(f"{name} must not be negative")

    def of(self, fmt: str) -> SiftOptions:
        """The options for logs of one format."""
        return replace(self, by_format=(), **dict(dict(self.by_format).get(fmt, ())))

    @property
    def least(self) -> str:
        """The severity from which events count; keeping warnings lowers it to ``warn`` at most."""
        return "warn" if self.keep_warnings and self.severity == "error" else self.severity


def dedupe_window(dedupe: bool = False, no_dedupe: bool = False, window: int = -1) -> int:
    """Window from the three flags: off wins, then an explicit window, then the default one."""
    return 0 if no_dedupe else window if window >= 0 else P.DEDUPE_WINDOW if dedupe else 0


_KEYS = {
    "default_severity": "severity", "default_budget": "budget", "default_max_events": "max_events", "default_context": "context", "default_output": "output", "keep_vendor": "keep_vendor",
    "keep_warnings": "keep_warnings", "strip_envelope": "envelope", "dedupe_window": "dedupe_window", "strict": "strict", "no_footer": "footer", "default_tokenizer": "tokenizer", "vocabulary": "vocabulary",
}


@dataclass(frozen=True)
class Config:
    """Values of a configuration file: top-level ones, ones per format, and the formats it defines."""

    values: dict
    formats: dict[str, dict]
    custom: tuple[CustomFormat, ...]


def parse_config(text: str) -> Config:
    """Reads ``schema_version = 1``, option keys, ``[formats.NAME]`` with the same keys, and ``[[custom_formats]]``. Unknown keys are errors."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    if data.pop("schema_version", SCHEMA_VERSION) != SCHEMA_VERSION:
        raise ConfigError("unknown schema_version")
    per, listed = data.pop("formats", {}), data.pop("custom_formats", [])
    for where, values in (("", data), *((f"formats.{k}.", v) for k, v in per.items())):
        if unknown := sorted(set(values) - set(_KEYS)):
            raise ConfigError(f"unknown key {where}{unknown[0]}")
    known = {f.name for f in fields(CustomFormat)}
    seen: set[str] = set()
    for c in listed:
        if unknown := sorted(set(c) - known):
            raise ConfigError(f"unknown key custom_formats.{unknown[0]}")
        if c.get("name") in seen:
            raise ConfigError(f"custom format {c['name']!r} is defined twice")
        seen.add(c.get("name"))
    try:
        custom = tuple(sorted((CustomFormat(**c) for c in listed), key=lambda f: f.name))
    except (TypeError, ValueError) as e:
        raise ConfigError(str(e)) from e
    return Config(data, per, custom)


def discover(start: Path, home: Path | None = None, name: str = "millrace.toml") -> list[Path]:
    """Configuration files that apply: the user's first, then the nearest one at ``start`` or above it."""
    found = [p for p in ([(home / ".config" / "millrace" / name)] if home else []) if p.is_file()]
    for folder in (start, *start.parents):
        if (folder / name).is_file():
            return [*found, folder / name]
    return found


def merge(user: Config, project: Config) -> Config:
    """The project's values over the user's; formats of the same name are the project's."""
    formats = {k: user.formats.get(k, {}) | project.formats.get(k, {}) for k in user.formats | project.formats}
    custom = {f.name: f for f in user.custom} | {f.name: f for f in project.custom}
    return Config(user.values | project.values, formats, tuple(custom[k] for k in sorted(custom)))


def apply_config(options: SiftOptions, config: Config, given: set[str] = frozenset()) -> SiftOptions:
    """Options given by the caller win, then values for their format, then top-level ones.

    Where the format is detected, values for formats wait in ``by_format`` until it is known.
    """

    def changes(values: dict) -> dict:
        return {_KEYS[k]: not v if k == "no_footer" else v for k, v in values.items() if _KEYS[k] not in given}

    auto = options.format == "auto"
    own = changes(config.values | ({} if auto else config.formats.get(options.format, {})))
    later = tuple((fmt, tuple(changes(v).items())) for fmt, v in sorted(config.formats.items()) if changes(v)) if auto else ()
    out = replace(options, formats=tuple({f.name: f for f in (*config.custom, *options.formats)}.values()), by_format=later, **own)
    for fmt, _ in later:
        out.of(fmt)  # a bad value is told now
    return out
