"""Column functions shared by the operators. None of them is a Python UDF."""

from tallyman.functions.naming import chunk_suffix, part_letters
from tallyman.functions.paths import (
    ancestors,
    basename,
    components,
    normalise,
    parent,
    prefixes,
    strip_prefix,
)
from tallyman.functions.sizes import entry_cost, long_name_cost, padded
from tallyman.functions.text import origin_rebased, without_definers, words

__all__ = [
    "ancestors",
    "basename",
    "chunk_suffix",
    "components",
    "entry_cost",
    "long_name_cost",
    "normalise",
    "origin_rebased",
    "padded",
    "parent",
    "part_letters",
    "prefixes",
    "strip_prefix",
    "without_definers",
    "words",
]
