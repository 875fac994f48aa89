"""A file tree as a relation, by a Python data source: hidden, empty and underscored files too, which file formats skip.

    spark.dataSource.register(ArtifactTree)
    spark.read.format("artifact_tree").option("root", "/data/repo").load()
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, size_bytes long, mode int, modified_at string, content binary, error string"


class Part(InputPartition):
    def __init__(self, top: str | None):
        self.top = top


class ArtifactTree(DataSource):
    """Options: root; prune (names of directories that are left out, comma-separated); closed (names of directories that
    have a row and aren't entered); max_bytes of content."""

    @classmethod
    def name(cls) -> str:
        return "artifact_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["root"])
        self.prune = {x for x in options.get("prune", ".git,node_modules").split(",") if x}
        self.closed = {x for x in options.get("closed", "").split(",") if x}
        self.max_bytes = int(options.get("max_bytes", 50 << 20))
        if os.path.islink(options["root"]) or not os.path.isdir(self.root):
            raise ValueError(f"the root must be a directory and no link: {options['root']}")

    def partitions(self) -> list[InputPartition]:
        """One for each entry of the root: subtrees are walked by the executors."""
        return [Part(name) for name in sorted(os.listdir(self.root))] or [Part(None)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.top is not None:
            yield from self._entry(partition.top)

    def _entry(self, rel: str) -> Iterator[tuple]:
        full = os.path.join(self.root, rel)
        try:
            st = os.lstat(full)
        except OSError as e:
            yield (rel, "other", None, None, None, None, str(e))
            return
        when = datetime.fromtimestamp(st.st_mtime, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        if stat.S_ISLNK(st.st_mode):
            yield (rel, "symlink", None, st.st_mode & 0o777, when, None, None)
        elif stat.S_ISDIR(st.st_mode):
            if os.path.basename(rel) in self.prune:
                return
            try:
                names, error = sorted(os.listdir(full)) if os.path.basename(rel) not in self.closed else [], None
            except OSError as e:
                names, error = [], str(e)
            yield (rel, "directory", None, st.st_mode & 0o777, when, None, error)
            for n in names:
                yield from self._entry(f"{rel}/{n}")
        elif not stat.S_ISREG(st.st_mode):
            yield (rel, "other", st.st_size, st.st_mode & 0o777, when, None, None)
        else:
            content, error = None, None
            if st.st_size <= self.max_bytes:
                try:
                    with open(full, "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = str(e)
            yield (rel, "file", st.st_size, st.st_mode & 0o777, when, content, error)


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArtifactTree)
    return spark.read.format("artifact_tree").options(root=root, **options).load()


def text_probe(entries: DataFrame, content: str = "content") -> DataFrame:
    """probe: text, binary (a NUL byte) or unsupported_encoding, by the first 8192 bytes; a character cut there is no fault."""
    from pyspark.sql import functions as F

    head = F.substring(F.col(content), 1, 8192)
    full = F.octet_length(content) > 8192
    whole = F.expr(f"is_valid_utf8(substring(`{content}`, 1, 8192))")
    tails = (("C[2-9A-F]|D.|E.|F[0-4]", ""), ("E.|F[0-4]", "[89AB]."), ("F[0-4]", "[89AB].[89AB]."))  # the beginning of a longer character
    cut = F.expr(" OR ".join(f"(is_valid_utf8(substring(`{content}`, 1, {8191 - k})) AND rlike(hex(substring(`{content}`, {8192 - k}, {k + 1})), '^({lead}){rest}$'))" for k, (lead, rest) in enumerate(tails)))
    nul = F.locate("00", F.regexp_replace(F.hex(head), "(..)", "$1 ")) > 0
    return entries.withColumn("probe", F.when(F.col(content).isNull(), "unreadable").when(nul, "binary").when(whole | (full & cut), "text").otherwise("unsupported_encoding"))


def artifacts(entries: DataFrame) -> DataFrame:
    """(path, body, size_bytes, is_dir, bytes_hash, modified_at) of a tree's files and folders, for the operators.

    The body is the text, empty where the content isn't UTF-8; bytes_hash is the hash of the content as it is, whatever
    it is, and null for a folder and a file that wasn't read.
    """
    from pyspark.sql import functions as F

    text = F.coalesce(F.expr("try_validate_utf8(CAST(content AS STRING))"), F.lit(""))
    return entries.where("kind IN ('file', 'directory')").select("path", text.alias("body"), "size_bytes", (F.col("kind") == "directory").alias("is_dir"), F.sha2("content", 256).alias("bytes_hash"), "modified_at")
