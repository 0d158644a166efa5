"""Alignment records: their fields, and lines made of them and read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flags: not aligned; aligned as the reverse complement.
UNMAPPED, REVERSE = 4, 16
FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
#: The format's version, and how this program names itself.
HEADER = ("@HD\tVN:0.3", "@PG\tID:strandflow\tPN:strandflow\tVN:0.1.0")


def tabbed(*columns: Column) -> Column:
    return F.concat_ws("\t", *(c.cast("string") for c in columns))


def blanked(mapq: Column | None = None) -> Column:
    """The line with mate, sequence and quality fields blanked; its own mapq or the given one."""
    own = [F.col(c) for c in FIELDS[:6]]
    if mapq is not None:
        own[4] = mapq
    return tabbed(*own, *map(F.lit, ("*", "0", "0", "*", "*")))


def full(mapq: Column) -> Column:
    """The line's eleven fields with another mapq; tags are lost."""
    return tabbed(*(mapq if c == "mapq" else F.col(c) for c in FIELDS))


def parsed(lines: DataFrame, part: Column, ordinal: str = "ord") -> DataFrame:
    """Records from lines (value, ord): the read id before the first colon, the fields, and `raw`, the line behind it.

    Lines that begin with @ before the first other line are the file's head and must be gone."""
    raw = F.expr("substring(value, instr(value, ':') + 1)")
    fields = F.split(raw, r"\s+")
    kinds = {"flag": "int", "pos": "int", "mapq": "int", "pnext": "int", "tlen": "int"}
    own = [F.get(fields, F.lit(i)).cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(FIELDS)]
    read_id = F.when(F.instr("value", ":") > 0, F.substring_index("value", ":", 1)).cast("long")
    return lines.select(read_id.alias("read_id"), part.alias("part"), F.col(ordinal).alias("ord"), *own, F.regexp_extract(raw, r"^(?:[^\t]*\t){11}(.*)$", 1).alias("tags"), raw.alias("raw"))
