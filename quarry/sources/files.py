"""Scan of a source tree into files, entities and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import scanner

LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go"}
SKIPPED_DIRS = ("node_modules", "__pycache__", "venv", "dist", "build", "target", "vendor", "coverage")
TEST_DIRS = ("tests", "test", "__tests__", "spec", "fixtures")
MOST_BYTES, WARN_FILES, MOST_FILES = 500_000, 50_000, 100_000


def scan(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, language, size_bytes, content, content_hash, skip_reason of every file under root. The checks run in a fixed order: folder, extension, size, binary."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    parts = F.split(rel, "/")
    language = F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.regexp_extract(rel, r"\.([A-Za-z]+)$", 1))
    folder = F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_DIRS))) | F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith("."))
    reason = F.when(folder, "directory").when(language.isNull(), "extension").when(F.col("length") > MOST_BYTES, "size").when(F.contains(F.substring("content", 1, 1024), F.unhex(F.lit("00"))), "binary")
    return raw.select(rel.alias("rel_path"), language.alias("language"), F.col("length").alias("size_bytes"), "content", F.sha2("content", 256).alias("content_hash"), reason.alias("skip_reason"))


def kept(files: DataFrame, language: str | None = None, tests: bool = True) -> DataFrame:
    """The files that no check skips; of one language, or without test folders, if asked. A language that isn't known is an error."""
    if language is not None and language not in set(LANGUAGES.values()):
        raise ValueError(f"unknown language: {language}")
    rows = files.where("skip_reason IS NULL").drop("skip_reason")
    rows = rows if language is None else rows.where(F.col("language") == language)
    parts = F.split("rel_path", "/")
    return rows if tests else rows.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, TEST_DIRS))))


def summary(files: DataFrame) -> DataFrame:
    """language, skip_reason, n over the scan; skipped files without a language have null."""
    return files.groupBy("language", "skip_reason").agg(F.count(F.lit(1)).alias("n"))


def within_limits(n_files: int, warn: int = WARN_FILES, most: int = MOST_FILES) -> str | None:
    """None, or a warning; an error beyond the most."""
    if n_files > most:
        raise ValueError(f"{n_files} files are more than {most}")
    return f"{n_files} files are more than {warn}" if n_files > warn else None


def repository(name: str) -> tuple[str, str]:
    """(owner, repository) of owner/repository or a URL."""
    parts = [p for p in name.strip().removesuffix("/").removesuffix(".git").split("://")[-1].split("/") if p]
    if len(parts) < 2:
        raise ValueError(f"not owner/repository: {name}")
    return parts[-2], parts[-1]


ENTITY = "rel_path string, language string, kind string, name string, class_name string, signature string, docstring string, body string, start_line int, end_line int, is_async boolean, is_interface boolean, bases array<string>, methods array<string>, decorators array<string>, complexity int, cognitive int, has_errors boolean"


def file_rows(path: str, language: str, text: str) -> list[tuple]:
    """The rows of one file, its module first. A file that its reader fails on is its module row alone."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    try:
        found, faults = scanner.entities(language, text)
    except Exception:  # one file's fault stays with it
        found, faults = [], True
    module = (path, language, "module", stem, None, None, scanner.module_docstring(language, text), text, 1, text.count("\n") + 1, False, False, [], [], [], None, None, faults)
    return [module, *((path, language, e.kind, e.name, e.class_name, e.signature, e.docstring, e.body, e.start, e.end, e.is_async, e.is_interface, e.bases, e.methods, e.decorators, e.complexity, e.cognitive, faults) for e in found)]


def entities(files: DataFrame) -> DataFrame:
    """Modules, functions, methods, classes and imports of files (rel_path, language, content). Null contents: no rows. Unknown languages: none."""
    import pandas as pd

    names = [c.split(" ")[0] for c in ENTITY.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [e for p, lang, c in zip(batch["rel_path"], batch["language"], batch["content"], strict=True) if c is not None for e in file_rows(p, lang, c.decode("utf-8", "replace"))]
            out = pd.DataFrame(rows, columns=names)
            for c in ("complexity", "cognitive"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.where(F.col("language").isin(*scanner.READERS)).select("rel_path", "language", "content").mapInPandas(run, ENTITY)
