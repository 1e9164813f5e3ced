"""Every threshold, score, level cut and path as a frozen options object."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

# Levels from weakest to strongest.
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Scores:
    frequency_violation: int = 3
    sensitive_path: int = 4
    malicious_ua: int = 4
    error_flood: int = 2
    sql_injection: int = 5
    waf_block: int = 5
    ssh_bruteforce: int = 5


@dataclass(frozen=True)
class SourceOptions:
    paths: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    enabled: bool = True


# Where each kind of log is looked for when no path is given.
DEFAULT_SOURCES: dict[str, SourceOptions] = {
    "nginx": SourceOptions(("/www/wwwlogs/*.log",), ("*.gz",)),
    "waf": SourceOptions(
        ("/www/server/panel/plugin/btwaf/logs/*.log", "/www/server/panel/vhost/waf/*.log")
    ),
    "free_waf": SourceOptions(
        ("/www/wwwlogs/free_waf_log/*.log", "/www/wwwlogs/free_waf_log/**/*.log")
    ),
    "ssh": SourceOptions(("/var/log/secure", "/var/log/auth.log")),
}


@dataclass(frozen=True)
class Options:
    frequency_window: int = 300
    max_requests: int = 100
    error_window: int = 120
    max_errors: int = 50
    max_sensitive_hits: int = 5
    scores: Scores = Scores()
    levels: tuple[tuple[str, int], ...] = (("LOW", 2), ("MEDIUM", 4), ("HIGH", 6), ("CRITICAL", 8))
    sources: dict[str, SourceOptions] = field(default_factory=lambda: dict(DEFAULT_SOURCES))
    allow_entries: tuple[str, ...] = ("127.0.0.1", "::1", "0.0.0.0")
    allow_file: str | None = None
    output_format: str = "detailed"
    deduplicate: bool = True
    retention_days: int = 365
    threat_retention_days: int = 30
    naive_time_zone: str = "UTC"

    def with_(self, **changes: Any) -> "Options":
        return replace(self, **changes)

    @classmethod
    def from_dict(cls, config: dict[str, Any]) -> "Options":
        """Options from the nested configuration layout (thresholds, threat_scores, ...)."""
        base = cls()
        limits = config.get("thresholds") or {}
        frequency, errors = limits.get("frequency") or {}, limits.get("error_rate") or {}
        scan = limits.get("path_scan") or {}
        known = {f.name for f in fields(Scores)}
        scores = {k: int(v) for k, v in (config.get("threat_scores") or {}).items() if k in known}
        levels = {**dict(base.levels), **(config.get("threat_levels") or {})}
        sources = dict(base.sources)
        for name, entry in (config.get("log_sources") or {}).items():
            default = sources.get(name, SourceOptions())
            sources[name] = SourceOptions(
                tuple(entry.get("paths") or default.paths),
                tuple(entry.get("exclude") or default.exclude),
                bool(entry.get("enabled", True)),
            )
        output, store = config.get("output") or {}, config.get("database") or {}
        return cls(
            frequency_window=frequency.get("window_seconds", base.frequency_window),
            max_requests=frequency.get("max_requests", base.max_requests),
            error_window=errors.get("window_seconds", base.error_window),
            max_errors=errors.get("max_errors", base.max_errors),
            max_sensitive_hits=scan.get("max_sensitive_hits", base.max_sensitive_hits),
            scores=Scores(**scores),
            levels=tuple((name, int(levels[name])) for name in LEVELS),
            sources=sources,
            allow_entries=tuple(config.get("whitelist") or ()),
            allow_file=config.get("whitelist_file") or None,
            output_format=output.get("format", base.output_format),
            deduplicate=output.get("deduplicate", base.deduplicate),
            retention_days=store.get("retention_days", base.retention_days),
            threat_retention_days=store.get("threat_retention_days", base.threat_retention_days),
        )

    @classmethod
    def from_yaml(cls, path: str) -> "Options":
        import yaml

        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle) or {})
