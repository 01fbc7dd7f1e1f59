"""Settings from the environment, checked."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

_START = re.compile(r"^[A-Za-z]+-\d+$")


@dataclass(frozen=True)
class Config:
    start_id: str
    data_dir: str = "./data/tables"
    request_delay_ms: float = 1000
    max_retries: float = 3
    geocoder_token: str | None = None
    geocode_after_crawl: bool = True
    crawl_parents: bool = False
    save_interval: float = 25
    export_interval: float = 500
    backup_dir: str = "./data/backups"
    export_file: str = "./data/export"
    progress_file: str = "./data/progress.json"

    def __post_init__(self) -> None:
        if not _START.fullmatch(self.start_id):
            raise ValueError(f"not an id: {self.start_id!r}")
        if not (self.request_delay_ms >= 0 and self.max_retries >= 0 and self.save_interval >= 1 and self.export_interval >= 1):
            raise ValueError("delay and retries must be 0 or more, intervals 1 or more")
        if not all((self.data_dir, self.backup_dir, self.export_file, self.progress_file)):
            raise ValueError("paths must not be empty")


def from_env(env: Mapping[str, str] = os.environ, prefix: str = "CRAWLER_") -> Config:
    """Settings that aren't there have their defaults; an empty token is none."""
    given = {name: env[prefix + name.upper()] for name in ("data_dir", "backup_dir", "export_file", "progress_file") if prefix + name.upper() in env}
    given |= {name: float(env[prefix + name.upper()]) for name in ("request_delay_ms", "max_retries", "save_interval", "export_interval") if prefix + name.upper() in env}
    return Config(
        start_id=env.get(prefix + "START_ID", "Person-1"), geocoder_token=env.get("MAPBOX_ACCESS_TOKEN") or None, geocode_after_crawl=env.get(prefix + "GEOCODE_AFTER_CRAWL") != "false",
        crawl_parents=env.get(prefix + "CRAWL_PARENTS") == "true", **given,
    )
