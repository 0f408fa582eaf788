"""What several operators share: table reads, lineage cuts and Arrow batch bounds."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Bytes that one Arrow batch on its way to a Python worker may hold.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts cannot swell a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared checkpoint folder.

    The folder is the one the session names. Only where none is named, one is set: a
    temporary folder for a local master, else a folder beside the warehouse, which is shared.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            local = sc.master == "local" or sc.master.startswith("local[")
            named = tempfile.mkdtemp(prefix="checkpoints") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hash_unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


class Carried:
    """Columns that a Python stage passes on untouched; the text, which it reads anyway, crosses once."""

    def __init__(self, docs: DataFrame, columns: list[str], text_col: str) -> None:
        self.columns, self.text_col = columns, text_col
        self.others = [c for c in columns if c != text_col]
        self.given = [F.col(f"`{c}`").alias(f"carried{i}") for i, c in enumerate(self.others)]
        kinds = [f"carried{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(self.others)]
        self.schema = "".join(f", {k}" for k in [*kinds, *["carried_text string"] * (text_col in columns)])
        self.names = [*[f"carried{i}" for i in range(len(self.others))], *["carried_text"] * (text_col in columns)]

    def arrays(self) -> Callable[[pa.RecordBatch, int, int], list[pa.Array]]:
        """A function for the carried columns of a batch, given where its text is and where its other columns begin."""
        with_text = self.text_col in self.columns
        return lambda batch, text_at, first: [*batch.columns[first:], *[batch.column(text_at)] * with_text]

    def restored(self) -> list[Column]:
        """The columns under their own names and in their order."""
        return [F.col("carried_text" if c == self.text_col else f"carried{self.others.index(c)}").alias(c) for c in self.columns]
