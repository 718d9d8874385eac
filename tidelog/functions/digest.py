"""Digests that Spark has no function for: XXH64 with seed 0 and XXH3 with 128 bits."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that are read at a time.
CHUNK = 8 << 20


def job_id(name: str, specifier: str = "") -> str:
    """The id of a job. ValueError for a colon in either part, which would make ids ambiguous."""
    if ":" in name or ":" in specifier:
        raise ValueError("neither a job's name nor its specifier may contain a colon")
    return xxhash.xxh64_hexdigest(f"{name}:{specifier}" if specifier else name)


@F.pandas_udf(T.StringType())
def _job_ids(names: pd.Series, specifiers: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else job_id(n, s or "") for n, s in zip(names, specifiers, strict=True)], dtype=object)


def job_id_of(name: Column, specifier: Column) -> Column:
    return _job_ids(name, specifier)


def file_digest(path: str, rel_path: str) -> bytes:
    """XXH3-128 of the relative path and the bytes of a file, in chunks of bounded size."""
    state = xxhash.xxh3_128(rel_path.encode())
    with open(path, "rb") as file:
        while chunk := file.read(CHUNK):
            state.update(chunk)
    return state.digest()


@F.pandas_udf(T.BinaryType())
def file_digests(paths: pd.Series, rel_paths: pd.Series) -> pd.Series:
    return pd.Series([file_digest(p, r) for p, r in zip(paths, rel_paths, strict=True)], dtype=object)


def folded(rows: Iterable[tuple[str, bytes]]) -> str | None:
    """The digest of (relative path, digest) pairs that come in order of the path as text; None if there is none."""
    state, some = xxhash.xxh3_128(), False
    for rel_path, digest in rows:
        state.update(rel_path.encode())
        state.update(digest)
        some = True
    return state.hexdigest() if some else None
