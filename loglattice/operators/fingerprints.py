"""Identities of files from their content, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.operators.records import chunks


def checksum(content: Column, size: int) -> Column:
    """SHA-256 of the first ``size`` bytes, in hex; null for shorter contents and null. Size 0: of all bytes."""
    data = content.cast("binary")
    if size == 0:
        return F.sha2(data, 256)
    return F.when(F.octet_length(data) >= size, F.sha2(F.substring(data, 1, size), 256))


def separator_checksum(content: Column, separator: str, n: int) -> Column:
    """SHA-256 up to and with the n-th separator, found from the left without overlap; null with fewer separators."""
    if not separator or n <= 0:
        raise ValueError("the separator and the number of separators must be given")
    enough = F.size(chunks(content, separator)) > n
    head = F.concat(F.substring_index(content, separator, n), F.lit(separator))
    return F.when(enough, F.sha2(head.cast("binary"), 256))


def file_id(content: Column, strategy: Column, size: int, separator: str) -> Column:
    """The identity by each row's strategy; null for empty contents, unknown strategies and contents too short for it."""
    by_content = F.when(strategy == "checksum", checksum(content, size)).when(strategy == "checksumSeparator", separator_checksum(content, separator, size))
    return F.when(F.octet_length(content) > 0, by_content)
