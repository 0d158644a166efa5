"""File names of partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_name(path: str) -> tuple[str, str]:
    """Base name and extension, without folders; a leading dot starts no extension."""
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return (name[:dot], name[dot:]) if dot > 0 else (name, "")


def partition_name(path: str, number: int) -> str:
    """The name of partition `number` (from 1) of a target file."""
    base, extension = split_name(path)
    return f"{base}-{number}{extension or '.fa'}"


def split_columns(path: Column) -> tuple[Column, Column]:
    """split_name as column expressions."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension)), extension


def partition_names(path: Column, number: Column) -> Column:
    """partition_name as a column expression."""
    base, extension = split_columns(path)
    return F.concat(base, F.lit("-"), number.cast("string"), F.when(extension == "", ".fa").otherwise(extension))
