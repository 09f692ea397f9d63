"""Splitting where the meaning turns: distances between neighbouring sentence windows, and a threshold."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.embedding import Embedding, cosine_distance
from ..functions.native import prose
from .base import Splitter

#: Thresholds and their default amounts.
AMOUNTS = {"percentile": 95.0, "standard_deviation": 3.0, "interquartile": 1.5, "gradient": 95.0}
SEPARATORS = [".", "!", "?"]


def distances(vectors: np.ndarray) -> np.ndarray:
    a, b = vectors[:-1], vectors[1:]
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return 1 - (a * b).sum(axis=1) / np.maximum(norms, 1e-12)


def threshold(d: np.ndarray, kind: str, amount: float) -> tuple[float, np.ndarray]:
    """The threshold, and the values that it is compared with: the distances, or their slope."""
    if kind == "percentile":
        return float(np.percentile(d, amount)), d
    if kind == "standard_deviation":
        return float(d.mean() + amount * d.std()), d
    if kind == "interquartile":
        low, high = np.percentile(d, [25, 75])
        return float(d.mean() + amount * (high - low)), d
    slope = np.gradient(d)
    return float(np.percentile(slope, amount)), slope


class SemanticSplitter(Splitter):
    """Cuts after a sentence whose window differs from the next by more than the threshold, or at the number_of_chunks - 1
    greatest distances (of equals the first). A chunk below chunk_size characters grows on. One request a document."""

    method = "semantic_splitter"

    def __init__(
        self,
        embedding: Embedding,
        *,
        buffer_size: int = 1,
        breakpoint_threshold_type: str = "percentile",
        breakpoint_threshold_amount: float | None = None,
        number_of_chunks: int | None = None,
        chunk_size: int = 1000,
        on_empty: str = "fail",
    ):
        super().__init__(chunk_size, on_empty)
        if breakpoint_threshold_type not in AMOUNTS:
            raise ValueError(f"breakpoint_threshold_type must be one of {', '.join(AMOUNTS)}")
        amount = AMOUNTS[breakpoint_threshold_type] if breakpoint_threshold_amount is None else float(breakpoint_threshold_amount)
        if breakpoint_threshold_type in ("percentile", "gradient") and 0 < amount <= 1:
            amount *= 100
        self.embedding, self.buffer_size, self.kind, self.amount, self.number = embedding, buffer_size, breakpoint_threshold_type, amount, number_of_chunks

    def params(self) -> dict[str, Any]:
        return super().params() | {
            "buffer_size": self.buffer_size,
            "model_name": self.embedding.model_name,
            "breakpoint_threshold_type": self.kind,
            "breakpoint_threshold_amount": self.amount,
            "number_of_chunks": self.number,
        }

    def split_text(self, text: str | None) -> list[str]:
        if not text or not text.strip():
            raise ValueError("the text is empty")
        parts = prose.sentences(text, SEPARATORS)
        if len(parts) <= 1 or (self.kind == "gradient" and len(parts) == 2):
            return parts
        b = self.buffer_size
        windows = [" ".join(parts[max(0, i - b) : i + b + 1]) for i in range(len(parts))]
        d = distances(np.array(self.embedding.embed_documents(windows), float))
        if self.number is not None:
            most = np.argsort(-d, kind="stable")[: max(0, min(self.number - 1, len(d)))]
            cuts = sorted(most.tolist())
        else:
            limit, values = threshold(d, self.kind, self.amount)
            cuts = np.flatnonzero(values > limit).tolist()
        out, begin = [], 0
        for c in cuts:
            chunk = " ".join(parts[begin : c + 1])
            if len(chunk) >= self.chunk_size:
                out.append(chunk)
                begin = c + 1
        return [*out, " ".join(parts[begin:])] if begin < len(parts) else out


# ---- The same steps for vectors that are columns already ----


def neighbour_distances(vectors: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """group, order, distance: from each row's vector to the next one's in its group; the last row has none."""
    w = Window.partitionBy(group).orderBy(order)
    d = vectors.select(group, order, F.col(vector).alias("a"), F.lead(vector).over(w).alias("b")).where("b IS NOT NULL")
    return d.select(group, order, cosine_distance(F.col("a"), F.col("b")).alias("distance"))


def group_thresholds(d: DataFrame, group: str, order: str, kind: str, amount: float | None = None) -> DataFrame:
    """group, threshold: one row a group, by partial aggregates where the kind has them."""
    amount = AMOUNTS[kind] if amount is None else amount
    x = F.col("distance")
    if kind == "gradient":
        w = Window.partitionBy(group).orderBy(order)
        before, after = F.lag(x).over(w), F.lead(x).over(w)
        slope = F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)
        d, x, kind = d.withColumn("slope", slope), F.col("slope"), "percentile"
    limit: Column = {
        "percentile": F.percentile(x, amount / 100),
        "standard_deviation": F.avg(x) + amount * F.stddev_pop(x),
        "interquartile": F.avg(x) + amount * (F.percentile(x, 0.75) - F.percentile(x, 0.25)),
    }[kind]
    return d.groupBy(group).agg(limit.alias("threshold"))


def top_breakpoints(d: DataFrame, group: str, order: str, number_of_chunks: int) -> DataFrame:
    """The rows after which number_of_chunks chunks of a group are cut."""
    w = Window.partitionBy(group).orderBy(F.desc("distance"), order)
    return d.withColumn("n", F.row_number().over(w)).where(F.col("n") < number_of_chunks).drop("n")
