"""Tables by rows, by columns or by size."""

from __future__ import annotations

import json
import tempfile
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.native import structured
from .base import Splitter


class RowColumnSplitter(Splitter):
    """num_rows: so many rows a chunk, as an aligned Markdown table; num_cols: so many columns, as lists; neither: as many
    rows as fit chunk_size under the header. A float overlap is a share of the rows or columns of a chunk. The text is
    read by the document's conversion_method. oversize: see `structured.split_table_size`."""

    method = "row_column_splitter"

    def __init__(
        self,
        chunk_size: int = 1000,
        num_rows: int = 0,
        num_cols: int = 0,
        chunk_overlap: float | int = 0,
        *,
        oversize: str = "emit",
        on_empty: str = "fail",
    ):
        super().__init__(chunk_size, on_empty)
        if num_rows and num_cols:
            raise ValueError("num_rows and num_cols exclude each other")
        if isinstance(chunk_overlap, float) and chunk_overlap >= 1:
            raise ValueError("a float chunk_overlap must be below 1")
        if oversize not in ("emit", "compat"):
            raise ValueError("oversize must be emit or compat")
        self.num_rows, self.num_cols, self.chunk_overlap, self.oversize = num_rows, num_cols, chunk_overlap, oversize

    def params(self) -> dict[str, Any]:
        return super().params() | {"num_rows": self.num_rows, "num_cols": self.num_cols, "chunk_overlap": self.chunk_overlap}

    def _overlap(self, size: int) -> int:
        return int(size * self.chunk_overlap) if isinstance(self.chunk_overlap, float) else int(self.chunk_overlap)

    def split_table(self, text: str | None, method: str | None) -> tuple[list[str], list[dict]]:
        """Chunks, and the metadata of each."""
        table = structured.parse_table(text, method)
        if self.num_rows:
            found = structured.split_table_rows(table, self.num_rows, self._overlap(self.num_rows))
            return [c for c, _ in found], [{"rows": r, "type": "row"} for _, r in found]
        if self.num_cols:
            found = structured.split_table_columns(table, self.num_cols, self._overlap(self.num_cols))
            return [c for c, _ in found], [{"cols": c, "type": "column"} for _, c in found]
        chunks = structured.split_table_size(table, self.chunk_size, self.chunk_overlap, self.oversize)
        return chunks, [{"type": "char"} for _ in chunks]

    def split_text(self, text: str | None) -> list[str]:
        return self.split_table(text, "csv")[0]

    def prepare(self, docs: DataFrame) -> DataFrame:
        split = self.split_table

        @F.pandas_udf("chunks array<string>, metadata string")
        def cut(texts: pd.Series, methods: pd.Series) -> pd.DataFrame:
            found = [split(t, m) for t, m in zip(texts, methods, strict=True)]
            return pd.DataFrame({"chunks": [c for c, _ in found], "metadata": [json.dumps({"chunks": m}) for _, m in found]})

        return docs.withColumn("__cut", cut("text", "conversion_method")).withColumn("__chunks", F.col("__cut.chunks"))

    def metadata(self) -> Column:
        return F.col("__cut.metadata")


def written_once(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names, or in one of its own on a local master."""
    sc = df.sparkSession.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chunkspark-"))
    return df.checkpoint()


def split_rows(table: DataFrame, order: list[str], num_rows: int, overlap: int = 0) -> DataFrame:
    """chunk_index, row_in_chunk and the columns, for a table that is a DataFrame already: num_rows rows a chunk in the
    given total order, each chunk beginning num_rows - overlap rows after the one before.

    Rows are numbered without bringing them to one task: sorted partitions are counted, and each adds what comes
    before it. The counts, one row a partition, are broadcast.
    """
    step = max(1, num_rows - overlap)
    # Both the counts and the numbers read one sort: it is written once, so that a second evaluation can't cut it elsewhere.
    ordered = table.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    ordered = written_once(ordered)
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.select(
        "__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    # The generated ids count up within a partition, from the partition's number in the upper bits.
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ordered.join(F.broadcast(offsets), "__part").withColumn("__row", (within + F.col("__before")).cast("long"))
    # Row r is in chunks c with c * step <= r < c * step + num_rows.
    last = F.floor(F.col("__row") / step)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("__row") - num_rows + 1) / step))
    out = numbered.where(first <= last).withColumn("chunk_index", F.explode(F.sequence(first, last)))
    return out.select(
        F.col("chunk_index").cast("int").alias("chunk_index"),
        (F.col("__row") - F.col("chunk_index") * step).cast("int").alias("row_in_chunk"),
        *[f"`{c}`" for c in table.columns],
    )


def column_groups(names: list[str], num_cols: int, overlap: int = 0) -> list[list[str]]:
    step = max(1, num_cols - overlap)
    return [names[i : i + num_cols] for i in range(0, len(names), step)]


def split_columns(table: DataFrame, keys: list[str], num_cols: int, overlap: int = 0) -> DataFrame:
    """The keys, chunk_index, and the values of the chunk's columns as an array of strings: one pass, no shuffle."""

    def chunk(index: int, group: list[str]) -> Column:
        values = F.array(*[F.col(f"`{c}`").cast("string") for c in group])
        return F.struct(F.lit(index).alias("chunk_index"), F.lit(",".join(group)).alias("column_names"), values.alias("cells"))

    groups = column_groups([c for c in table.columns if c not in keys], num_cols, overlap)
    return table.select(*keys, F.inline(F.array(*[chunk(k, group) for k, group in enumerate(groups)])))
