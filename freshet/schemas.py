"""Table schemas, and the settings every site has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


SNAPSHOTS = (
    "site_id STRING, run_ts TIMESTAMP, page_url STRING, content BINARY, html STRING, charset_hint STRING, "
    "http_status INT, error STRING"
)
ATTEMPTS = ("site_id STRING, run_ts TIMESTAMP, attempt INT, http_status INT, failure STRING")
KNOWN = ("site_id STRING, url STRING, title STRING, first_seen TIMESTAMP, seq BIGINT")
RECENT = ("site_id STRING, ord INT, title STRING, url STRING, first_seen TIMESTAMP")
SITE_STATE = (
    "site_id STRING, seeded BOOLEAN, first_checked TIMESTAMP, last_checked TIMESTAMP, last_update TIMESTAMP, "
    "last_status STRING, last_error STRING, consecutive_errors INT"
)
READS = ("reader_id STRING, url STRING, read_at TIMESTAMP")
LINKS = "array<struct<pos:int,url:string,title:string>>"

# Settings of a site that sets nothing itself.
USER_AGENT = "Mozilla/5.0 (compatible; freshet)"
SETTING_DEFAULTS: dict[str, tuple[str, object]] = {
    "selector": ("string", None),
    "include": ("array<string>", []),
    "exclude": ("array<string>", []),
    "use_default_exclude": ("boolean", True),
    "skip_navigation": ("boolean", True),
    "allow_hosts": ("array<string>", []),
    "allow_external": ("boolean", False),
    "min_title_length": ("int", 0),
    "max_items": ("int", 50),
    "timeout": ("int", 20),
    "retries": ("int", 2),
    "user_agent": ("string", USER_AGENT),
    "enabled": ("boolean", True),
}
# The settings that extraction and change detection look at.
PAGE_SETTINGS = [
    "selector", "include", "exclude", "use_default_exclude", "skip_navigation", "allow_hosts", "allow_external",
    "min_title_length", "max_items",
]


def default_setting(name: str) -> Column:
    kind, value = SETTING_DEFAULTS[name]
    literal = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
    return literal.cast(kind)


def known_limit(max_items: Column) -> Column:
    """How many known URLs a site keeps: 40 per shown item, at least 1,000."""
    return F.greatest(F.lit(1000), max_items * 40)
