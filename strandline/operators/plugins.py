"""Where models plug in: encoders, pair scorers and generators run over Arrow batches, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def generate(df: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], column: str = "prompt", out: str = "answer", batch: int = 32) -> DataFrame:
    """``df`` with the model's answer to each prompt. ``load`` makes the model in the worker; a call that fails gives nulls, not a failed job."""

    def run(frames):
        model = load()
        for frame in frames:
            answers: list = []
            prompts = frame[column].fillna("").tolist()
            for k in range(0, len(prompts), batch):
                part = prompts[k : k + batch]
                try:
                    answers += model(part)
                except Exception:
                    answers += [None] * len(part)
            yield frame.assign(**{out: pd.Series(answers, index=frame.index, dtype="object")})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` string"])
    return df.mapInPandas(run, schema)


def encode(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], column: str = "text", out: str = "embedding", batch: int = 16) -> DataFrame:
    """``df`` with the encoder's vector of each text."""

    def run(frames):
        model = load()
        for frame in frames:
            texts = frame[column].fillna("").tolist()
            vectors = [v for k in range(0, len(texts), batch) for v in model(texts[k : k + batch])]
            yield frame.assign(**{out: pd.Series([list(map(float, v)) for v in vectors], index=frame.index, dtype="object")})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` array<float>"])
    return df.mapInPandas(run, schema)
