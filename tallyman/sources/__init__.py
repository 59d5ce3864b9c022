"""Reading catalogs, listings, manifests, inventories and readings; writing results."""

from tallyman.sources.catalog import CATALOG_SCHEMA, catalog_tables, read_catalog
from tallyman.sources.feeds import (
    READING_SCHEMA,
    read_product_json,
    read_readings,
    stream_readings,
)
from tallyman.sources.inventory import file_inventory
from tallyman.sources.listings import parse_checksums, parse_lock, read_checksums, read_lock
from tallyman.sources.manifests import TITLE_KEY, manifest_layers
from tallyman.sources.sinks import (
    RefusedError,
    quarantine,
    read_buckets,
    require_ok,
    write_buckets,
    write_checksums,
)

__all__ = [
    "CATALOG_SCHEMA",
    "READING_SCHEMA",
    "RefusedError",
    "TITLE_KEY",
    "catalog_tables",
    "file_inventory",
    "manifest_layers",
    "parse_checksums",
    "parse_lock",
    "quarantine",
    "read_buckets",
    "read_catalog",
    "read_checksums",
    "read_lock",
    "read_product_json",
    "read_readings",
    "require_ok",
    "stream_readings",
    "write_buckets",
    "write_checksums",
]
