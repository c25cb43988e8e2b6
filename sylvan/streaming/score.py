"""Scoring a stream: scoring keeps no state, so a streaming DataFrame is scored like a static one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sylvan.booster import BoostedModel


def score_stream(model: BoostedModel, stream: DataFrame) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return model.predict(stream)
