"""A cross-encoder as a scorer of (query, document) pairs, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .embed import PROVIDERS

MAX_TOKENS, BATCH = 512, 32


class OnnxCrossEncoder:
    """An exported sequence classifier over pairs; one logit a pair.  Needs onnxruntime,
    tokenizers and the two files."""

    def __init__(self, model_path: str, tokenizer_path: str, providers: list[str] | None = None) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        have = set(onnxruntime.get_available_providers())
        picked = [x for x in providers or () if x in have] or PROVIDERS["onnx-cpu"]
        self.session = onnxruntime.InferenceSession(model_path, providers=picked)
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.enable_truncation(MAX_TOKENS)
        self.tokenizer.enable_padding()
        self.inputs = {x.name for x in self.session.get_inputs()}

    def scores(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        found = self.tokenizer.encode_batch(pairs)
        feed = {
            "input_ids": np.array([x.ids for x in found], np.int64), "attention_mask": np.array([x.attention_mask for x in found], np.int64),
            "token_type_ids": np.array([x.type_ids for x in found], np.int64),
        }
        out = self.session.run(None, {k: v for k, v in feed.items() if k in self.inputs})[0]
        return np.asarray(out, np.float64).reshape(len(pairs), -1)[:, -1]


def scorer(make: Callable[[], OnnxCrossEncoder]) -> Callable[[Column, Column], Column]:
    """A scorer for :func:`siltstone.operators.search.rerank`; ``make`` builds the model in each
    worker.  Where the model is missing or fails the scores are null, and words decide."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = make()
        except Exception:  # no model: every score is null
            model = None
        for asked, docs in parts:
            pairs = list(zip(asked.fillna("").tolist(), docs.fillna("").tolist(), strict=True))
            try:
                found = np.concatenate([model.scores(pairs[k : k + BATCH]) for k in range(0, len(pairs), BATCH)])
                yield pd.Series(found)
            except Exception:
                yield pd.Series([None] * len(pairs), dtype="float64")

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")
