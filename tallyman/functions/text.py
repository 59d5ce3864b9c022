"""Text rewriting and tokenising as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The definer clause of a database dump, and where a URL's origin ends.
DEFINER = r"DEFINER=`[^`]*`@`[^`]*`"
ORIGIN_END = r"(?=[/?#\"'<>\s]|$)"


def without_definers(line: Column) -> Column:
    """``line`` without any definer clause."""
    return F.regexp_replace(line, F.lit(DEFINER), F.lit(""))


def origin_rebased(text: Column, origin: str, target: str) -> Column:
    """``text`` with every ``origin`` (``scheme://host[:port]``) replaced by ``target``.

    The origin must end where it stands: ``http://a`` does not match ``http://a.example``
    or ``http://a:80``. Applying it twice changes nothing unless ``target`` starts with
    ``origin`` followed by an origin end, which is the same origin.
    """
    pattern = r"\Q" + origin + r"\E" + ORIGIN_END
    return F.regexp_replace(text, F.lit(pattern), F.lit(re.sub(r"([\\$])", r"\\\1", target)))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
