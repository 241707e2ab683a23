"""Ranges of files read inside tasks.

Stores that Arrow opens are read by range; of any other store that Spark reads, Spark brings whole files, and ranges are cut
from their bytes."""

from __future__ import annotations

import re
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.sources.files import contents


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", path), safe=":/@%+,;=~"))


def by_range(root: str) -> bool:
    """Whether files under root can be read by range."""
    try:
        _located(root if ":/" in root else f"file://{root}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False
    return True


class Ranges:
    """A file's bytes: of the store, or of the content that is given."""

    def __init__(self, path: str, content: bytes | None = None):
        self.content, self.file = content, None
        if content is None:
            store, place = _located(path)
            self.file = store.open_input_file(place)
        self.size = self.file.size() if self.file else len(content)

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if self.file else self.content[at : at + n]

    def close(self) -> None:
        if self.file:
            self.file.close()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def listed(spark: SparkSession, root: str, endings: tuple[str, ...]) -> DataFrame:
    """path and content of files under root with these endings, in any case; content is null where ranges can be read."""
    found = contents(spark, root).filter(F.lower("path").rlike(rf"[.]({'|'.join(endings)})$"))
    return found.select("path", F.lit(None).cast("binary").alias("content") if by_range(root) else "content")
