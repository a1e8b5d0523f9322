"""Models as columns, and chains of stages in which only undecided rows go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "label string, confidence double"

_loaded: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """The model of this name, loaded once in a worker process, whatever number of tasks and batches it serves."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def labeler(name: str, load: Callable[[], object], predict: Callable[[object, list[str]], list[tuple[str | None, float | None]]]) -> Callable[[Column], Column]:
    """A column function that labels texts with a model, in Arrow batches: struct of label and confidence.

    Null texts are not given to the model, and get a null label; a batch of none does not load it.
    """

    @F.pandas_udf(LABEL)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found: list[tuple[str | None, float | None]] = [(None, None)] * len(texts)
            asked = np.flatnonzero(texts.notna())
            if len(asked):
                for i, pair in zip(asked, predict(loaded(name, load), texts.iloc[asked].tolist())):
                    found[i] = pair
            yield pd.DataFrame({"label": pd.Series([x for x, _ in found], dtype=object), "confidence": pd.Series([c for _, c in found], dtype="float64")})

    return lambda text: label(text)


def scorer(name: str, load: Callable[[], object], predict: Callable[[object, list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A column function that scores pairs of query and passage with a model, for retrieval.model_rerank; null where either is."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages in batches:
            out = np.full(len(queries), np.nan)
            asked = np.flatnonzero(queries.notna() & passages.notna())
            if len(asked):
                out[asked] = predict(loaded(name, load), queries.iloc[asked].tolist(), passages.iloc[asked].tolist())
            yield pd.Series(out).astype("Float64")

    return lambda q, p: score(q, p)


def embedder(name: str, load: Callable[[], object], embed: Callable[[object, list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A column function that embeds texts with a model; null texts get no vector."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = [None] * len(texts)
            asked = np.flatnonzero(texts.notna())
            if len(asked):
                for i, vector in zip(asked, embed(loaded(name, load), texts.iloc[asked].tolist())):
                    out[i] = vector
            yield pd.Series(out, dtype=object)

    return lambda text: vectors(text)


class Stage:
    """A step of a chain: a column function of the text that gives label and confidence, the labels it may give, and how sure it must be."""

    def __init__(self, name: str, label: Callable[[Column], Column], valid: list[str], least: float = 0.0):
        self.name, self.label, self.valid, self.least = name, label, valid, least


def chain(rows: DataFrame, text: str, stages: list[Stage], fallback: str) -> DataFrame:
    """rows with label, confidence and stage: those of the first stage that decides, else the fallback.

    A stage decides a row by a valid label with enough confidence. Only rows that all stages before left undecided
    reach it: others are null to it, in one pass without a shuffle. Columns of rows by these three names are replaced.
    """
    df, settled = rows.withColumn("_found", F.lit(None).cast("struct<label:string,confidence:double,stage:string>")), "_found"
    for stage in stages:
        df = df.withColumn("_said", stage.label(F.when(F.col(settled).isNull(), F.col(text))))
        sure = F.col("_said.label").isin(stage.valid) & (F.coalesce("_said.confidence", F.lit(0.0)) >= stage.least)
        own = F.when(sure, F.struct(F.col("_said.label").alias("label"), F.col("_said.confidence").alias("confidence"), F.lit(stage.name).alias("stage")))
        df = df.withColumn(settled, F.coalesce(settled, own)).drop("_said")
    none = F.struct(F.lit(fallback).alias("label"), F.lit(0.0).alias("confidence"), F.lit("fallback").alias("stage"))
    names = [c for c in rows.columns if c not in ("label", "confidence", "stage")]
    return df.withColumn("_found", F.coalesce("_found", none)).select(*names, "_found.label", "_found.confidence", "_found.stage")
