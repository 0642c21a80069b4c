"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land

# Fixed by the contracts: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda that reads an outer array expression would evaluate it again for every element;
    bound as a lambda variable it is computed once.
    """
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def as_docs(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: an extra column of any name cannot clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def crc_mod(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod`` (null key: as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def packed_row(docs: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """The columns of ``docs`` (other than ``but``) as one struct: whatever their names, they cannot clash."""
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in but]
    return F.struct(*cols) if cols else F.struct(F.lit(None).cast("int").alias("none"))


def numbered(docs: DataFrame) -> DataFrame:
    """(row, row_no): whole rows with a number of their own, landed.

    A number that is made anew by every scan may differ between scans (a changed number of
    executors deals files differently); one that is written with its row cannot.
    """
    return land(docs.select(packed_row(docs).alias("row"), F.monotonically_increasing_id().alias("row_no")), "numbered")


def nullable(col):
    """An Arrow struct column with every field nullable, as Spark declares a result's fields."""
    return col.cast(pa.struct([pa.field(f.name, f.type) for f in col.type])) if pa.types.is_struct(col.type) else col
