"""Fetched pages: size guard, charset, retry plan, and a source that fetches with a given function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalar import fetch_reason, header_charset
from shelfspark.functions.urls import unsafe_reason

# Largest bodies in bytes, and the charsets that decode natively.
MAX_HTML, MAX_JSON, MAX_OTHER = 5 * 1024 * 1024, 5 * 1024 * 1024, 10 * 1024 * 1024
NATIVE_CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "us-ascii": "US-ASCII", "utf-16": "UTF-16"}


def within_size(df: DataFrame, body: str, most: int = MAX_HTML) -> DataFrame:
    """Rows whose body isn't too large; null bodies stay."""
    return df.filter(F.coalesce(F.octet_length(body), F.lit(0)) <= most)


def charset_of(content_type: Column, body: Column) -> Column:
    """A byte order mark, else the header's charset, else utf-8."""
    mark = F.substring(F.hex(body), 1, 6) == "EFBBBF"
    return F.when(mark, "utf-8").otherwise(F.coalesce(header_charset(content_type), F.lit("utf-8")))


def decode_pages(df: DataFrame, body: str, content_type: str, out: str = "html") -> DataFrame:
    """Bodies as text. Wrong bytes are replaced, unknown charsets are read as utf-8, a byte order mark is dropped."""
    charset = charset_of(F.col(content_type), F.col(body))

    @F.pandas_udf("string")
    def read(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
        def one(b, c):
            if b is None:
                return None
            try:
                return bytes(b).decode(c, errors="replace").removeprefix("﻿")
            except LookupError:
                return bytes(b).decode("utf-8", errors="replace").removeprefix("﻿")

        return pd.Series([one(b, c) for b, c in zip(bodies, charsets, strict=True)])

    return df.withColumn(out, read(F.col(body), charset))


def fetch_outcome(df: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """(successes, failures with a reason)."""
    tagged = df.withColumn("reason", fetch_reason(F.col(status)))
    return tagged.filter("reason = ''").drop("reason"), tagged.filter("reason <> '' or reason is null").withColumn("reason", F.coalesce("reason", F.lit("no_response")))


def fetch_pages(urls: DataFrame, fetch: Callable[[str], tuple[int, str, bytes]], url: str = "url", host_partitions: int = 32) -> DataFrame:
    """(url, status, content_type, body, error) by a given function; unsafe addresses are never fetched.

    Addresses of one host meet in one partition, so that a fetching function can pace itself by host. A failure of one
    address is its own row.
    """
    safe = urls.select(F.col(url).alias("url"), unsafe_reason(F.col(url)).alias("unsafe")).withColumn("host", F.lower(F.regexp_extract("url", r"//([^/?#]*)", 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for u, unsafe in zip(batch["url"], batch["unsafe"], strict=True):
                if unsafe:
                    rows.append((u, None, None, None, f"unsafe_{unsafe}"))
                    continue
                try:
                    status, kind, body = fetch(u)
                    rows.append((u, status, kind, body, None))
                except Exception as problem:  # noqa: BLE001
                    rows.append((u, None, None, None, type(problem).__name__))
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "body", "error"])

    return safe.repartition(host_partitions, "host").select("url", "unsafe").mapInPandas(run, "url string, status int, content_type string, body binary, error string")
