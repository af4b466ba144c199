"""Conversations as JSON files: raw recogniser output, first- and second-version documents, analyses.

A file is read whole and parsed to VARIANT, so that any shape is taken; a conversation's id is a hash
of its file's path, which is kept beside it.  Files that hold no JSON object keep a null document:
``quarantined`` lists them and no reader stops for them.  Writing goes through a data source with
commit and abort: tasks write below a hidden folder of the job, attempt by attempt, and only a
commit moves what the successful attempts wrote to its place, one file a conversation."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SENTENCE = "struct<text:string,start:double,end:double,spk:string,timestamp:array<array<double>>>"
NODE = (
    "struct<id:string,node_type:string,relation_to_previous:string,asked_by:string,role_confidence:double,phase:string,start:double,end:double,speaker_ids:array<string>,"
    "segment_ids:array<string>,text:string,topic:struct<label:string,keywords:array<string>>,answers:array<struct<role:string,role_confidence:double,start:double,end:double,speaker_ids:array<string>,"
    "segment_ids:array<string>,text:string>>,children:array<variant>>"
)
MOVES = 16


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, path, document (VARIANT; null where the file holds no JSON object), content."""
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")
    at = F.col("_metadata.file_path")
    parsed = F.array(F.try_parse_json("content"))
    document = F.transform(parsed, lambda v: F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), v))
    return files.select(F.xxhash64(at).alias("conv_id"), at.alias("path"), F.explode(document).alias("document"), "content")  # exploded: parsed once, whoever filters by it


def quarantined(documents: DataFrame) -> DataFrame:
    """path, n_chars, sha256 of the files that hold no JSON object."""
    return documents.filter("document is null").select("path", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


def of_version(documents: DataFrame, version: str) -> DataFrame:
    """Documents of that schema_version; any other raises, named by its path."""
    told = F.try_variant_get("document", "$.schema_version", "string")
    wrong = F.raise_error(F.concat(F.lit(f"not schema_version {version}: "), "path")).cast("variant")
    return documents.filter("document is not null").withColumn("document", F.when(told == version, F.col("document")).otherwise(wrong))


def field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def elements(v: Column, path: str) -> Column:
    return F.coalesce(field(v, path, "array<variant>"), F.array().cast("array<variant>"))


def unwrapped(v: Column) -> Column:
    """The first element of lists of any depth: a list's leading brackets say how deep it goes."""
    turns = F.length(F.regexp_extract(F.coalesce(F.to_json(v), F.lit("")), r"^\[*", 0))
    inner = F.aggregate(F.sequence(F.lit(1), turns), v, lambda now, _: F.coalesce(F.try_variant_get(now, "$[0]", "variant"), F.parse_json(F.lit("null"))))
    return F.when(turns > 0, inner).otherwise(v)


def raw_results(documents: DataFrame) -> DataFrame:
    """conv_id, path, result as ``segments.from_raw`` takes it: the first result of each raw document,
    however deep its lists.  A number stands for a speaker as well as a string does."""
    r = unwrapped(field(F.col("document"), "$.result", "variant"))
    rows = documents.filter("document is not null").select("conv_id", "path", F.explode(F.array(r)).alias("r"))
    stamps = lambda v: field(v, "$.timestamp", "array<array<double>>")
    sentence = lambda s: F.struct(
        field(s, "$.text", "string").alias("text"), field(s, "$.start", "double").alias("start"), field(s, "$.end", "double").alias("end"), field(s, "$.spk", "string").alias("spk"), stamps(s).alias("timestamp")
    )
    one = F.struct(field(F.col("r"), "$.text", "string").alias("text"), stamps(F.col("r")).alias("timestamp"), F.transform(elements(F.col("r"), "$.sentence_info"), sentence).alias("sentence_info"))
    return rows.select("conv_id", "path", F.explode(F.array(one)).alias("one")).select("conv_id", "path", F.array("one").alias("result"))


def tree_of(documents: DataFrame) -> DataFrame:
    """The question trees of second-version documents, a row a node, as ``questions.question_tree`` gives them."""
    roots = documents.select("conv_id", F.posexplode(elements(F.col("document"), "$.question_tree")).alias("root", "v")).select("conv_id", "root", field(F.col("v"), "$", NODE).alias("n"))
    kids = F.transform("n.children", lambda c, k: F.struct((k + 1).alias("child_no"), field(c, "$", NODE).alias("n")))
    every = F.concat(F.array(F.struct(F.lit(0).alias("child_no"), F.col("n").alias("n"))), F.coalesce(kids, F.slice(F.array(F.struct(F.lit(0).alias("child_no"), F.col("n").alias("n"))), 1, 0)))
    rows = roots.select("conv_id", (F.col("root") + 1).alias("root_no"), F.col("n.id").alias("root_id"), F.explode(every).alias("x"))
    n, child = F.col("x.n"), F.col("x.child_no")
    order = F.row_number().over(by_node())
    return rows.select(
        "conv_id", order.alias("prompt_no"), "root_no", child.alias("child_no"), n["id"].alias("node_id"), F.when(child > 0, F.col("root_id")).alias("parent_id"),
        *[n[c].alias(c) for c in ("node_type", "relation_to_previous", "asked_by", "role_confidence", "phase", "start", "end", "speaker_ids", "segment_ids", "text", "topic")], F.get(n["answers"], F.lit(0)).alias("answer"),
    )


def by_node():
    from pyspark.sql.window import Window as W

    return W.partitionBy("conv_id").orderBy("root_no", "x.child_no")


def statistics_of(documents: DataFrame, names: list[str]) -> DataFrame:
    """conv_id and the named counts of second-version documents; absent ones are 0."""
    return documents.select("conv_id", *[F.coalesce(field(F.col("document"), f"$.statistics.{c}", "bigint"), F.lit(0)).alias(c) for c in names])


def segments_of(documents: DataFrame) -> DataFrame:
    """Segments of first- or second-version documents: conv_id, idx, id, start, end, speaker, v1_role, text."""
    rows = documents.select("conv_id", F.posexplode(elements(F.col("document"), "$.segments")).alias("pos", "s"))
    text = lambda path, default: F.coalesce(field(F.col("s"), path, "string"), F.lit(default))
    return rows.select(
        "conv_id", (F.col("pos") + 1).alias("idx"), field(F.col("s"), "$.id", "string").alias("id"), *[field(F.col("s"), f"$.{c}", "double").alias(c) for c in ("start", "end")],
        text("$.speaker", "speaker_unknown").alias("speaker"), text("$.role", "unknown").alias("v1_role"), text("$.text", "").alias("text"),
    )


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceWriter):
    """Rows of (name, content) as files of a folder that all executors reach."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def store(self):
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else "file://" + os.path.abspath(self.path))
        return fs, at, f"{at}/_writing-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        fs, _, hidden = self.store()
        folder, names = f"{hidden}/{uuid.uuid4().hex}", set()
        fs.create_dir(folder, recursive=False)  # a task that outlives its job's abort finds no place to write
        for row in iterator:
            if not row["name"] or "/" in row["name"] or row["name"] in names:
                raise ValueError(f"no name for a file, or not the only one of it: {row['name']}")
            names.add(row["name"])
            with fs.open_output_stream(f"{folder}/{row['name']}") as f:
                f.write((row["content"] or "").encode())
        return Written(folder, len(names))

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector

        fs, at, hidden = self.store()
        done = [m for m in messages if m is not None]
        moves = [f for m in done for f in fs.get_file_info(FileSelector(m.folder))]
        names = {f.base_name for f in moves}
        if len(names) < len(moves) or len(moves) < sum(m.files for m in done):
            self.abort(messages)
            raise ValueError("two conversations share a file's name")
        fs.create_dir(at)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: fs.move(f.path, f"{at}/{f.base_name}"), moves))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, _, hidden = self.store()
        for tried in range(5):  # a task that still writes may put a file into what is being emptied
            try:
                if fs.get_file_info(hidden).type != FileType.NotFound:
                    fs.delete_dir(hidden)
                return
            except OSError:
                if tried == 4:
                    raise


class ConversationFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "conversation_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        writer = FileWriter(self.options["path"])
        fs, _, hidden = writer.store()
        fs.create_dir(hidden)
        return writer


def write_files(files: DataFrame, path: str) -> None:
    """Writes each row of (name, content) as a file of ``path``; a file of that name is replaced.  Nothing
    appears before all tasks are done, and a failed job leaves nothing."""
    spark = files.sparkSession
    spark.dataSource.register(ConversationFiles)
    files.select("name", "content").write.format("conversation_files").mode("append").save(path)


def write_documents(documents: DataFrame, path: str, name: Column, column: str = "document") -> None:
    """Documents as JSON files, nulls kept; ``name`` gives each file's."""
    write_files(documents.select(name.alias("name"), F.to_json(column, {"ignoreNullFields": "false"}).alias("content")), path)


def write_markdown(markdown: DataFrame, path: str, name: Column) -> None:
    """Reports, a file a conversation."""
    write_files(markdown.select(name.alias("name"), F.col("markdown").alias("content")), path)
