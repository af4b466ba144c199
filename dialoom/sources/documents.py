"""Dictionaries and settings, digests and names of files.

A dictionary or settings file is one small file, whose lines Spark reads, so any store that Spark
reaches will do.  Conversations as files are in ``files``.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("project", "audio", "models", "inference", "knowledge", "qa")


def whole_file(spark: SparkSession, path: str) -> str:
    """The text of one small settings or dictionary file."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_settings(spark: SparkSession, path: str) -> dict:
    """A YAML settings file; raises where a required section is missing."""
    import yaml

    settings = yaml.safe_load(whole_file(spark, path)) or {}
    missing = [name for name in REQUIRED if name not in settings]
    if missing:
        raise ValueError("settings lack " + ", ".join(missing))
    return settings


def resolved(value: str, root: str, packaged: str | None = None, exists=None) -> str:
    """``value`` if absolute, else below ``root``; a path into knowledge/ that ``exists`` denies there
    falls back to ``packaged``."""
    path = PurePosixPath(value)
    if path.is_absolute() or "://" in value:
        return value
    local = f"{root.rstrip('/')}/{path}"
    if exists and packaged and not exists(local) and path.parts[:1] == ("knowledge",) and exists(f"{packaged.rstrip('/')}/{path}"):
        return f"{packaged.rstrip('/')}/{path}"
    return local


def read_topics(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Label to words, both in the file's order."""
    import yaml

    found = (yaml.safe_load(whole_file(spark, path)) or {}).get("topics") or {}
    return {str(label): [str(w) for w in words] for label, words in found.items()}


def read_replacements(spark: SparkSession, path: str) -> dict[str, str]:
    import yaml

    found = (yaml.safe_load(whole_file(spark, path)) or {}).get("replacements") or {}
    return {str(k): str(v) for k, v in found.items()}


def word_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a word list (hot words, redaction terms), trimmed, each once, without blank and # lines.
    A missing file is an error."""
    lines = [line.strip() for line in whole_file(spark, path).splitlines()]
    return list(dict.fromkeys(x for x in lines if x and not x.startswith("#")))


def redaction_terms(spark: SparkSession, inline: list[str], path: str | None = None) -> list[str]:
    """Terms given inline and in a file, each once, in order."""
    terms = [str(t).strip() for t in inline] + (word_lines(spark, path) if path else [])
    return list(dict.fromkeys(t for t in terms if t))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file's content."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def output_name(name: Column, kind: str) -> Column:
    """Names of outputs from names of inputs: raw recogniser output, structured, v2 or analysis."""
    stem = F.regexp_replace(name, r"^.*/", "")
    if kind == "raw":
        return F.concat(F.regexp_replace(F.regexp_replace(stem, r"\.16k\.wav$", ""), r"\.[^.]*$", ""), F.lit(".funasr.json"))
    bare = F.when(stem.endswith(".funasr.json"), F.regexp_replace(stem, r"\.funasr\.json$", "")).otherwise(F.regexp_replace(stem, r"\.[^.]*$", ""))
    if kind == "structured":
        return F.concat(bare, F.lit(".json"))
    return F.concat(F.regexp_replace(bare, r"\.v2$", ""), F.lit({"v2": ".v2.json", "analysis": ".analysis.json"}[kind]))
