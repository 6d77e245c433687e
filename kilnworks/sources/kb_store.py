"""Files stored by knowledge base, with the grants beside them.

The sink writes a folder for each knowledge base. Files are dealt to tasks by kb and a hash
of doc_id, so a knowledge base that holds a third of all files is written by many tasks,
and each task writes a few knowledge bases. A read for a principal joins the files with
the principal's grants, a table of its own, and Spark's dynamic partition pruning leaves the
folders of other knowledge bases unread: isolation is a matter of which files are opened,
not only of which rows are shown.

Nulls: a null kb belongs to nobody; its files are stored, and no grant opens them. Repeated
rows stay. A column that would clash isn't added: all columns of the files are stored as they
are. An empty table gives an empty store, which reads as no rows of the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kilnworks.sources.shared import shared_folder

#: Tasks that write one knowledge base, at most.
SPREAD = 64


@dataclass
class KbStore:
    spark: SparkSession
    folder: str
    schema: StructType

    def files(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/files")

    def grants(self) -> DataFrame:
        """(principal, kb)"""
        return self.spark.read.schema("principal string, kb string").parquet(f"{self.folder}/grants")

    def visible(self, principal: str) -> DataFrame:
        """The files that one principal is granted; repeated grants change nothing."""
        own = self.grants().where(F.col("principal") == principal).select("kb")
        return self.files().join(own, "kb", "left_semi")

    def append(self, files: DataFrame) -> None:
        """Adds files; knowledge bases that they don't name aren't touched."""
        _write(files, f"{self.folder}/files")


def _write(files: DataFrame, path: str) -> None:
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    files.repartition(F.col("kb"), salt).write.mode("append").partitionBy("kb").parquet(path)


def store(files: DataFrame, acl: DataFrame, folder: str | None = None) -> KbStore:
    """Writes files (doc_id, kb, others) and acl (principal, kb)."""
    spark = files.sparkSession
    out = KbStore(spark, folder or shared_folder(spark, "kb-store"), files.schema)
    out.append(files)
    acl.select("principal", "kb").write.parquet(f"{out.folder}/grants")
    return out
