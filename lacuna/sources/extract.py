"""The extractor registry and the table function that runs it over file contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..schema import EXTRACTED, Corpus
from . import extract_python, extract_scan
from .extract_python import Row

#: Part of every content hash: raise it whenever what extractors emit changes.
FINGERPRINT = "1"
Extract = Callable[[bytes, str], list[Row]]


def _scanned(lang: extract_scan.Language, content: bytes, path: str) -> list[Row]:
    return extract_scan.scan_braces(content, lang)


def builtin() -> dict[str, tuple[tuple[str, ...], Extract]]:
    """Language to its file extensions and extractor."""
    found: dict[str, tuple[tuple[str, ...], Extract]] = {"python": (extract_python.EXTENSIONS, extract_python.extract)}
    for lang in extract_scan.LANGUAGES:
        found[lang.name] = (lang.extensions, partial(_scanned, lang))
    for name, extensions, scan in (
        ("ruby", (".rb",), extract_scan.scan_ruby),
        ("lua", (".lua",), extract_scan.scan_lua),
        ("bash", (".sh", ".bash"), extract_scan.scan_bash),
    ):
        found[name] = (extensions, lambda content, path, scan=scan: scan(content))
    return found


class Registry:
    """Built-in extractors, with plugins over them by name."""

    def __init__(self, plugins: dict[str, tuple[tuple[str, ...], Extract]] | None = None):
        self.extractors = builtin() | (plugins or {})

    @classmethod
    def discover(cls, group: str = "lacuna.extractors") -> Registry:
        """Plugins are entry points to ``(extensions, extract)``; one that can't be loaded is passed over."""
        from importlib.metadata import entry_points

        found = {}
        for point in entry_points(group=group):
            try:
                extensions, extract = point.load()
                found[point.name] = (tuple(extensions), extract)
            except Exception:  # noqa: BLE001  a broken plugin must not stop a scan
                continue
        return cls(found)

    def by_extension(self, languages: list[str] | None = None) -> dict[str, str]:
        """Extension to language; a later extractor takes an extension over."""
        return {e: lang for lang, (extensions, _) in self.extractors.items() if not languages or lang in languages for e in extensions}

    def with_language(self, files: DataFrame, languages: list[str] | None = None) -> DataFrame:
        """Files of known languages with a ``language`` column."""
        known = self.by_extension(languages)
        lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return files.withColumn("language", lookup[names.extension(names.basename("path"))]).filter("language is not null")

    def extract(self, files: DataFrame) -> DataFrame:
        """Entities with their feature maps from ``path, language, content``; no file stops the scan."""
        extractors = self.extractors

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for path, language, content in zip(batch["path"], batch["language"], batch["content"], strict=True):
                    found = extract_one(extractors[language][1], bytes(content or b""), path)
                    for i, (kind, name, line, features) in enumerate(found):
                        rows.append((f"{path}::{name}", kind, f"{path}::{name}", path, line, i, {k: list(v) for k, v in features.items()}))
                columns = ["entity_id", "kind", "qualified_name", "file_path", "line", "ordinal", "features"]
                yield pd.DataFrame(rows, columns=columns)

        return files.select("path", "language", "content").mapInPandas(run, EXTRACTED)


def extract_one(extract: Extract, content: bytes, path: str) -> list[Row]:
    try:
        return extract(content, path)
    except (ValueError, RecursionError, IndexError, KeyError):
        return []


def corpus(extracted: DataFrame) -> Corpus:
    """Canonical frames from extracted rows, one an id."""
    entities = extracted.drop("features")
    kinds = extracted.select("entity_id", F.explode(F.map_keys("features")).alias("kind"))
    pairs = extracted.select("entity_id", F.explode("features").alias("kind", "vs"))
    values = pairs.select("entity_id", "kind", F.explode("vs").alias("value")).distinct()
    return Corpus(entities, kinds, values)
