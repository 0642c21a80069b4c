"""Text functions as native Column expressions (no Python UDF).

Python's ``str.strip``/``split`` treat every Unicode whitespace as space while Spark's
one-argument ``trim`` removes only U+0020, so the whitespace set is spelled out and passed
to ``trim`` (a scan of the two ends, no regex over the whole text).  Regexes use ``\\z`` to
anchor at the very end (Java's ``$`` also matches before a final newline).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (EXPERIMENT_DISPLAY_NAMES, SAFE_NAME_FALLBACK, SAFE_NAME_OTHER_RUN,
                         SAFE_NAME_STRIP_CHARS, WS_CHARS, WS_CLASS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def rstrip_dots(c) -> Column:
    """``str.rstrip('.')``: remove all trailing dots (and nothing else)."""
    return F.rtrim(_c(c), F.lit("."))


def normalize_description(c) -> Column:
    """strip, then drop trailing dots: a text ending in ' ..' keeps its space."""
    return rstrip_dots(strip_ws(c))


def collapse_ws(c) -> Column:
    """``' '.join(s.split())``: strip and collapse every whitespace run to one space."""
    return F.regexp_replace(strip_ws(c), f"{WS_CLASS}+", " ")


def display_label(c) -> Column:
    """Display form of a label or key: underscores become spaces."""
    return F.replace(_c(c), F.lit("_"), F.lit(" "))


def title_case(c) -> Column:
    """Python ``str.title()`` on ASCII text.

    ``initcap`` only starts words after spaces; ``title`` starts one after every non-letter,
    so the text is cut into letter / non-letter runs and each run is capitalised.
    """
    runs = F.regexp_extract_all(_c(c), F.lit("(\\p{L}+|\\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                             F.lower(F.substring(r, 2, 1 << 30)))), "")


def sanitize_name(c) -> Column:
    """Safe experiment name: strip, runs outside [A-Za-z0-9._-] -> '_', strip '._-' ends,
    empty -> 'experiment'.

    A name is empty if its text has no letter or digit, which the first of them settles: the
    whole text is replaced once, not once for the test and once for the value."""
    s = F.regexp_replace(strip_ws(c), SAFE_NAME_OTHER_RUN, "_")
    return F.when(~_c(c).rlike("[A-Za-z0-9]"), F.lit(SAFE_NAME_FALLBACK)).otherwise(F.trim(s, F.lit(SAFE_NAME_STRIP_CHARS)))


def experiment_display_name(c) -> Column:
    """Display name of an experiment key: fixed map, else title-cased key."""
    m = F.create_map(*[x for k, v in EXPERIMENT_DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(c)), title_case(display_label(c)))


_TOKEN_RE = "([\\p{L}\\p{N}]+|[^" + WS_CLASS[1:-1] + "\\p{L}\\p{N}])"


def tokens(c) -> Column:
    """Lower-cased word and punctuation tokens of a text (basic uncased tokenisation):
    runs of letters / digits and single other characters; whitespace separates only, so
    no collapse pass is needed first."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(_TOKEN_RE), 1)
