"""Tables of the lakehouse: overwrite, replace, append, cache, remove."""

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark.sources.scratch import delete_tree, exists, is_complete

BATCH_COLUMN = "batch_id"
# Formats that are files in folders; any other has its own transactions.
FILE_FORMATS = {"parquet", "orc", "json", "csv", "avro"}


@dataclass(frozen=True)
class TableStore:
    """Tables below one root path.

    ``table_format`` is Parquet unless another installed format, such as a
    transactional one, is named.
    """

    spark: SparkSession
    root: str
    table_format: str = "parquet"

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read.format(self.table_format)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(self.path(table))

    def overwrite(self, frame: DataFrame, table: str, files: int | None = None) -> DataFrame:
        """Replace rows; ``files`` bounds the file count of a small dimension."""
        (frame.coalesce(files) if files else frame).write.mode("overwrite").format(
            self.table_format
        ).save(self.path(table))
        return self.read(table, frame.schema)

    def overwrite_by(self, frame: DataFrame, table: str, by: Sequence[str]) -> DataFrame:
        """Replace rows, in a folder for each value of ``by``, which filters then choose among.

        Folders of any size: Spark cuts large ones into several files and merges small tasks.
        Returns the table with its columns in the order of ``frame``.
        """
        dealt = frame.hint("rebalance", *(F.col(name) for name in by))
        dealt.write.mode("overwrite").format(self.table_format).partitionBy(*by).save(self.path(table))
        return self.read(table, frame.schema).select(*frame.columns)

    def replace(self, frame: DataFrame, table: str) -> DataFrame:
        """Replace rows and schema."""
        frame.write.mode("overwrite").option("overwriteSchema", "true").format(
            self.table_format
        ).save(self.path(table))
        return self.read(table, frame.schema)

    def append(self, frame: DataFrame, table: str, batch: str, schema: T.StructType) -> None:
        """Add one batch after checking its schema.

        A batch replaces the rows it wrote before, so a retried append does not double
        them: with formats of files it owns a folder, others replace where the batch is.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        self._check(frame, table, schema)
        writer = frame.write.format(self.table_format)
        if self.table_format in FILE_FORMATS:
            writer.mode("overwrite").save(f"{self.path(table)}/{BATCH_COLUMN}={batch}")
        else:
            named = frame.withColumn(BATCH_COLUMN, F.lit(batch)).write.format(self.table_format)
            named.mode("overwrite").partitionBy(BATCH_COLUMN).option(
                "replaceWhere", f"{BATCH_COLUMN} = '{batch}'"
            ).save(self.path(table))

    def append_batches(
        self, frame: DataFrame, table: str, batch: Column, schema: T.StructType
    ) -> None:
        """Add many batches, named by a column, in one job; each replaces its own rows."""
        self._check(frame, table, schema)
        named = frame.withColumn(BATCH_COLUMN, batch).repartition(BATCH_COLUMN)
        named.write.format(self.table_format).mode("overwrite").partitionBy(BATCH_COLUMN).option(
            "partitionOverwriteMode", "dynamic"
        ).save(self.path(table))

    def replace_batches(self, frame: DataFrame, table: str, schema: T.StructType) -> None:
        """Replace the rows of the batches that are in ``frame``, in its last column.

        Batches of any size: Spark cuts large ones into several files and merges small tasks.
        """
        self._check(frame.drop(BATCH_COLUMN), table, schema)
        dealt = frame.hint("rebalance", F.col(BATCH_COLUMN))
        dealt.write.format(self.table_format).mode("overwrite").partitionBy(BATCH_COLUMN).option(
            "partitionOverwriteMode", "dynamic"
        ).save(self.path(table))

    def batch_files(self, table: str) -> DataFrame:
        """Files of an appended table with their batch; no file is opened.

        Empty if the table is not there. Only for formats that are files in folders.
        """
        if self.table_format not in FILE_FORMATS:
            raise ValueError(f"{self.table_format} keeps its own list of files")
        if not self.is_there(table):
            return self.spark.createDataFrame([], f"{BATCH_COLUMN} string, path string, "
                                              "modificationTime timestamp, length long")
        # The folder name is escaped as in a URL, but for the plus sign.
        name = F.regexp_extract("path", f"/{BATCH_COLUMN}=([^/]*)/[^/]*$", 1)
        batch = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
        files = self.spark.read.format("binaryFile").load(f"{self.path(table)}/{BATCH_COLUMN}=*")
        return files.select(batch.alias(BATCH_COLUMN), "path", "modificationTime", "length")

    def is_there(self, table: str) -> bool:
        """Whether anything was written under the table's name."""
        return exists(self.spark, self.path(table))

    @staticmethod
    def _check(frame: DataFrame, table: str, schema: T.StructType) -> None:
        found = [(f.name, f.dataType) for f in frame.schema]
        wanted = [(f.name, f.dataType) for f in schema]
        if found != wanted:
            raise ValueError(f"schema of {table} is {wanted}, not {found}")

    def read_appended(self, table: str, schema: T.StructType) -> DataFrame:
        """All batches of an appended table, without the batch column."""
        return self.read_batches(table, schema).drop(BATCH_COLUMN)

    def read_batch(self, table: str, batch: str, schema: T.StructType) -> DataFrame:
        """One batch of an appended table, empty if it is not there; no other folder is listed."""
        at = table
        if self.table_format in FILE_FORMATS:
            at = f"{table}/{BATCH_COLUMN}={batch}"
        if not self.is_there(at):
            return self.spark.createDataFrame([], schema)
        if at != table:
            return self.read(at, schema)
        return self.read_batches(table, schema).where(F.col(BATCH_COLUMN) == batch).drop(BATCH_COLUMN)

    def read_batches(self, table: str, schema: T.StructType) -> DataFrame:
        """All batches of an appended table; the batch column is a partition of its files."""
        batched = T.StructType(schema.fields + [T.StructField(BATCH_COLUMN, T.StringType())])
        return self.read(table, batched)

    def cached(self, frame: DataFrame, table: str, refresh: bool = False) -> DataFrame:
        """Write unless a whole table is there and no refresh is asked for; then read.

        What a failed writer left does not count as a table of files.
        """
        files = self.table_format in FILE_FORMATS
        torn = files and not is_complete(self.spark, self.path(table))
        mode = "overwrite" if refresh or torn else "ignore"
        frame.write.mode(mode).format(self.table_format).save(self.path(table))
        return self.read(table, frame.schema)

    def drop_all(self, inside: str) -> bool:
        """Remove the whole store, provided that it lies below ``inside``."""
        return delete_tree(self.spark, self.root, inside)
