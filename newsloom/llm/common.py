"""What the operators share: keeping rows whole on their way through Arrow stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Words, as every operator of this folder takes them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Rows turned into Python objects at a time, whatever the Arrow batch size.
SLICE_ROWS = 256


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add; names as Spark compares them."""
    taken = {name.lower() for name in names}
    return df.drop(*(c for c in df.columns if c.lower() in taken))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fields(df: DataFrame) -> str:
    """The schema of ``df`` as a DDL string."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def with_columns(
    df: DataFrame, text: str, added: str, compute: Callable[[], Callable[[list[str]], list]], rows: int = SLICE_ROWS
) -> DataFrame:
    """Add columns that Python computes from the texts of a few rows at a time.

    ``added`` names and types them, as DDL; ``compute()`` is called once per task and
    gives a function from texts (NULL: empty) to one list or Arrow array per column.
    Columns of ``df`` with these names are replaced.
    """
    names = [part.split()[0] for part in added.split(",")]
    source = without(df, *names)
    position = [c.lower() for c in source.columns].index(text.lower())
    kept = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        for part in slices(batches, rows):
            texts = [x or "" for x in part.column(position).to_pylist()]
            columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in function(texts)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*kept, *names])

    return source.mapInArrow(run, f"{fields(source)}, {added}")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))
