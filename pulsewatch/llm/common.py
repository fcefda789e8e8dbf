"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import scratch_path

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once per application, so that
    the Python workers import it by name and keep their caches between tasks."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="pulsewatch-code-"), "pulsewatch_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, in a session that has this package on its executors."""
    ship(spark)
    return table(spark, sf_dir, "documents")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: cuts the lineage, keeps the columns' types, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(col: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Say in a Python worker that ``owner``'s tables are in use; those that
    other operators left there are cleared, so a worker that runs several
    operators in turn holds the tables of one, and Arrow's unused memory goes back."""
    for other in [o for o in _held if o != owner]:
        _held.pop(other)()
    _held[owner] = clear
    gc.collect()
    pa.default_memory_pool().release_unused()


#: UTF-8 bytes of the texts made into strings and handed to a text function at
#: once (or one longer text): bounds its memory and its output batch.
BATCH_BYTES = 2_000_000


def map_texts(df: DataFrame, text_col: str, outputs: list[T.StructField], start: Callable[[], Callable[[list[str]], list[list]]],
              keep_text: bool = False) -> DataFrame:
    """Add ``outputs`` made from the texts of ``text_col`` (null read as the
    empty text) and drop that column unless ``keep_text``.  ``start()`` runs
    once per task and gives the function from a list of texts to one list per
    output.  All other columns go through as they are."""
    ship(df.sparkSession)
    names = [f.name for f in df.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*[df.schema[n] for n in names], *outputs])
    kinds = [to_arrow_type(f.dataType) for f in outputs]
    labels = [*names, *[f.name for f in outputs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            low, taken = 0, 0
            for i, n_bytes in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
                taken += n_bytes or 0
                if taken >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(low, i + 1 - low)
                    made = work([t or "" for t in part.column(at).to_pylist()])
                    arrays = [part.column(part.schema.get_field_index(n)) for n in names] + [pa.array(c, k) for c, k in zip(made, kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=labels)
                    low, taken = i + 1, 0

    return df.mapInArrow(run, schema)
