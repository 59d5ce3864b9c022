"""The operators that make sense over an endless input."""

from tallyman.streaming.alerts import stall_alerts
from tallyman.streaming.running import (
    peaks_from_windows,
    resource_windows,
    running_audit,
    unique_digests,
)
from tallyman.streaming.runner import drain_appended, drain_updated
from tallyman.streaming.stored import StoredDedup, drain_against_store

__all__ = [
    "StoredDedup",
    "drain_against_store",
    "drain_appended",
    "drain_updated",
    "peaks_from_windows",
    "resource_windows",
    "running_audit",
    "stall_alerts",
    "unique_digests",
]
