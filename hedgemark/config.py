"""Limits and fixed values shared by the jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Bounds of the moderation rules; override any of them per call."""

    allowed_kinds: tuple[int, ...] = (30023,)
    max_content_bytes: int = 512_000
    max_tags: int = 200
    max_tag_bytes: int = 2_048
    max_urls_per_event: int = 50
    max_redirects: int = 8
    max_location_bytes: int = 2_048
    max_target_bytes: int = 4_096
    max_list_bytes: int = 8_000_000
    max_list_rules: int = 5_000_000
    min_size_ratio: float = 0.5
    feed_window_s: int = 86_400
    feed_limit: int = 300
    lookup_batch: int = 500
    slow_url_ms: int = 1_000
    rate_window_s: int = 60
    rate_limit: int = 120
    replay_window_s: int = 120
    freshness_window_s: int = 60
    clock_skew_s: int = 5
    recent_events: int = 100
    recent_matches: int = 200
    listed_entries: int = 200
    scanner_version: str = "1.0.0"


DEFAULTS = Limits()

# --- fixed values -----------------------------------------------------------
# Domain suffixes below which the registrable domain has three labels.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au",
    "co.nz", "com.br", "com.mx", "co.jp", "co.kr", "com.cn", "com.hk",
    "co.in", "com.sg", "com.tw", "co.za", "com.ar", "github.io",
    "blogspot.com",
)

# slug, name, description, enabled, blocks_serving
DEFAULT_CATEGORIES = (
    ("adult", "Adult", "Adult sexual content", True, True),
    ("malware", "Malware", "Malware and exploit distribution", True, True),
    ("scam", "Scam", "Fraud and phishing", True, True),
    ("spam", "Spam", "Unsolicited or deceptive promotion", True, False),
)

# Media hosts whose URLs are matched but not followed.
DEFAULT_SKIP_HOSTS = (
    "blossom.primal.net",
    "m.primal.net",
    "image.nostr.build",
    "i.nostr.build",
)

REDIRECT_STATUSES = (301, 302, 303, 307, 308)
ARTICLE_KIND = 30023
LABEL_KIND = 1985

SCAN_STATUSES = ("pending", "running", "clean", "matched", "partial", "failed")
VERSION_STATUSES = ("pending", "validated", "active", "failed", "superseded")
RULE_TYPES = ("domain", "host", "url_prefix")
SOURCE_TYPES = ("remote", "manual")
LIST_FORMATS = ("domains", "hosts", "urls")
REFRESH_STATUSES = (
    "idle", "queued", "downloading", "importing", "ok", "failed", "rejected",
)

# Addresses that must never be contacted: class, first, last.
# Version 6 bounds are 32 hexadecimal digits so that they compare as text.
V4_RANGES = (
    ("unspecified", "0.0.0.0", "0.0.0.0"),
    ("loopback", "127.0.0.0", "127.255.255.255"),
    ("private", "10.0.0.0", "10.255.255.255"),
    ("private", "192.168.0.0", "192.168.255.255"),
    ("private", "172.16.0.0", "172.31.255.255"),
    ("private", "100.64.0.0", "100.127.255.255"),
    ("link_local", "169.254.0.0", "169.254.255.255"),
    ("multicast", "224.0.0.0", "239.255.255.255"),
    ("documentation", "192.0.2.0", "192.0.2.255"),
    ("documentation", "198.51.100.0", "198.51.100.255"),
    ("documentation", "203.0.113.0", "203.0.113.255"),
    ("benchmarking", "198.18.0.0", "198.19.255.255"),
    ("reserved", "0.0.0.0", "0.255.255.255"),
    ("reserved", "240.0.0.0", "240.255.255.255"),
    ("reserved", "255.255.255.255", "255.255.255.255"),
)
V6_RANGES = (
    ("unspecified", "0" * 32, "0" * 32),
    ("loopback", "0" * 31 + "1", "0" * 31 + "1"),
    ("link_local", "fe80" + "0" * 28, "fe80" + "f" * 28),
    ("multicast", "ff00" + "0" * 28, "f" * 32),
    ("documentation", "20010db8" + "0" * 24, "20010db8" + "f" * 24),
    ("unique_local", "fc00" + "0" * 28, "fdff" + "f" * 28),
)
# --- end of fixed values ----------------------------------------------------
