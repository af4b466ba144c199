"""A ledger of provider requests: each distinct request is answered once, whatever is retried.

An answer is a file named by its request's digest, written beside and moved into place by the task
that asked, as soon as it has it.  Requests whose answer lies there are left out by an anti-join
before any call; a task that is tried again looks for the answers its earlier attempt left before it
asks.  The ledger outlives the job: a later run with the same requests asks nothing.  (Two attempts
of one task at the same moment, as under speculation, may ask twice; the last answer stays.)"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.sources.stored import fresh_path, stored

ANSWERS = "digest string, result string"


def filesystem(uri: str):
    """(file system, path) of a folder that driver and executors reach."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def place(folder: str, digest: str) -> str:
    """256 folders, by the digest's first byte."""
    return f"{folder}/{digest[:2]}/{digest}"


class Ledger:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or fresh_path(spark, "ledger")).rstrip("/")

    def answers(self) -> DataFrame:
        """(digest, result) of all answered requests; parts of a file being written are hidden by name."""
        from pyarrow.fs import FileType

        fs, at = filesystem(self.path)
        if fs.get_file_info(at).type == FileType.NotFound:
            return self.spark.createDataFrame([], ANSWERS)
        files = self.spark.read.option("recursiveFileLookup", "true").text(self.path, wholetext=True)
        return files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("digest"), F.col("value").alias("result")).filter(F.length("digest") == 64)

    def ask(self, requests: DataFrame, analyze: Callable[[str], str]) -> DataFrame:
        """(digest, result) of ``requests`` (digest, json; rows may repeat): those not answered yet are
        put to ``analyze``, each once, in the tasks."""
        path = self.path
        filesystem(path)[0].create_dir(filesystem(path)[1])

        def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow.fs import FileType

            fs, folder = filesystem(path)
            for frame in frames:
                for digest, json in zip(frame["digest"], frame["json"], strict=True):
                    final = place(folder, digest)
                    if fs.get_file_info(final).type == FileType.NotFound:
                        answer = analyze(json)
                        fs.create_dir(final.rsplit("/", 1)[0])
                        part = f"{final.rsplit('/', 1)[0]}/_{digest}.{uuid.uuid4().hex}"
                        with fs.open_output_stream(part) as f:
                            f.write(answer.encode())
                        fs.move(part, final)
                yield frame[["digest"]]

        todo = requests.dropDuplicates(["digest"]).join(self.answers().select("digest"), "digest", "left_anti")
        stored(todo.select("digest", "json").mapInPandas(call, "digest string"), "ledger-asked")
        return self.answers().join(requests.select("digest").distinct(), "digest", "left_semi")
