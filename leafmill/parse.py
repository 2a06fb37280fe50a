"""One source or many to levels: what a caller hands over is told apart, checked and decoded; bad configuration and missing files raise.

A batch never stops for one bad file: its error is a row. A single source that cannot be read raises.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.chunks import Sizes
from leafmill.plans.staging import staged
from leafmill.sources import detect

REPRESENTATIONS = ("markdown", "jsonl", "melted")
LEGACY = ("doc", "ppt", "xls", "rtf", "odt")


class UnsupportedSource(ValueError):
    """What was handed over is of no kind that can be read."""


class UnreadableSource(ValueError):
    """A source of a known kind that its decoder could not read."""


@dataclass(frozen=True)
class Config:
    """How sources are cut into chunks and tables are shown; wrong values raise ValueError."""

    most: int = 3200
    optimal: int = 1500
    soft: int = 700
    merge_small: bool = True
    table_representation: str = "markdown"

    def __post_init__(self) -> None:
        for name in ("most", "optimal", "soft"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ValueError(f"{name} must be a positive whole number, not {value!r}")
        if not self.soft <= self.optimal <= self.most:
            raise ValueError(f"sizes must be in order: soft {self.soft} <= optimal {self.optimal} <= most {self.most}")
        if self.table_representation not in REPRESENTATIONS:
            raise ValueError(f"table_representation must be one of {', '.join(REPRESENTATIONS)}, not {self.table_representation!r}")

    @property
    def sizes(self) -> Sizes:
        return Sizes(self.most, self.optimal, self.soft)


def is_url(source: str) -> bool:
    return source.lower().startswith(("http://", "https://"))


def kind_of_delivery(content: bytes, content_type: str = "") -> str:
    """What a fetched answer is, by its first bytes and then its content type; the address says nothing."""
    if content[:4] == b"%PDF" or "application/pdf" in content_type.lower():
        return "pdf"
    if content[:2] == b"PK":
        return "zip"
    return "html"


class Parser:
    """A configuration that is used for many sources. fetch(url) -> (bytes, content type) is asked for addresses, if given."""

    def __init__(self, spark: SparkSession, config: Config | None = None, fetch: Callable[[str], tuple[bytes, str]] | None = None) -> None:
        self.spark, self.config, self.fetch = spark, config or Config(), fetch

    def parse(self, source: bytes | str) -> dict[str, DataFrame]:
        """Levels of one source: bytes, an address, HTML itself or a path. A path with the suffix of a document that is not there raises FileNotFoundError; any other text is HTML."""
        if isinstance(source, bytes):
            return self._one(source, "bytes")
        if is_url(source):
            if self.fetch is None:
                raise UnsupportedSource("addresses need a fetch function")
            content, kind = self.fetch(source)
            return self._one(content, {"pdf": "a.pdf", "html": "a.html"}.get(kind_of_delivery(content, kind), "a"))
        suffix = source.rpartition(".")[2].lower() if "." in source[-8:] else ""
        if os.path.isfile(source):
            if suffix in LEGACY:
                raise UnsupportedSource(f".{suffix} files are not read; save the document in a current format")
            with open(source, "rb") as f:
                return self._one(f.read(), source)
        if suffix in (*detect.SUFFIXES, *LEGACY) and "<" not in source:
            raise FileNotFoundError(source)
        return self._one(source.encode(), "text.html")

    def parse_all(self, folder: str, recursive: bool = False) -> dict[str, DataFrame]:
        """Levels of all supported files of a folder; files that fail are rows of errors."""
        from leafmill.cli import parse_folder

        return parse_folder(self.spark, folder, recursive, self.config)

    def _one(self, content: bytes, name: str) -> dict[str, DataFrame]:
        from leafmill.cli import parse_files

        given = self.spark.createDataFrame([(1, name, bytearray(content))], "doc_id long, path string, content binary")
        files = staged(detect._told_apart(given.withColumn("kind", detect.kind_of(F.col("content"), F.col("path")))))
        kind = files.first().kind
        if kind not in set(detect.SUFFIXES.values()):
            raise UnsupportedSource(f"{name} is of no kind that can be read")
        made = parse_files(files, self.config)
        failed = made["errors"].first()
        if failed is not None:
            raise UnreadableSource(failed.error)
        return made
