"""The boundary to models: detectors, recognisers and descriptor extractors are plain callables that run on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

TEXT_BLOCKS = "array<struct<text:string,center_x:double,center_y:double,conf:double>>"
DETECTIONS = "array<struct<x1:double,y1:double,x2:double,y2:double,conf:double,cls:int>>"
DESCRIPTORS = "array<array<int>>"


def with_model(df: DataFrame, loader: Callable[[], Callable[[list], list]], content: str, output: str, schema: str) -> DataFrame:
    """``df`` with a column of a model's results for ``content``.

    ``loader`` runs once in each task and returns a callable from a list of inputs to a list of results; an input on which the model raises gets null, the others of its batch are
    not lost.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in it:
            inputs = pdf[content].tolist()
            try:
                results = model(inputs)
            except Exception:  # one bad input must not cost the batch
                results = []
                for x in inputs:
                    try:
                        results += model([x])
                    except Exception:
                        results.append(None)
            yield pdf.assign(**{output: pd.Series(results, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, f"{fields}, `{output}` {schema}")


def rotated_reading(angle: int) -> int:
    """The turn that brings a crop of a recognised angle upright."""
    return (360 - angle) % 360
