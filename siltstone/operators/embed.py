"""Embedding as a column operator with a pluggable backend."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions.text import PY_TOKEN

#: Characters of a text that are embedded; the stored text stays whole.
MAX_CHARS, BATCH, DIMENSION = 4000, 32, 256
_WORD = re.compile(PY_TOKEN)


class Embedder(Protocol):
    """Made once a worker; ``encode`` maps texts to rows of unit length."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of search tokens: deterministic and without a model file."""

    def __init__(self, dimension: int = DIMENSION) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        found = [_WORD.findall(x.lower()) for x in texts]
        number: dict[str, int] = {}
        code = np.array([number.setdefault(w, len(number)) for words in found for w in words], np.int64)
        # A batch's different words are hashed once each; their places and signs are then looked up.
        h = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in number], np.uint64)
        place, sign = ((h >> np.uint64(1)) % np.uint64(self.dimension)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0)
        row = np.repeat(np.arange(len(texts)), [len(words) for words in found])
        cell = row * self.dimension + place[code] if len(code) else code
        sums = np.bincount(cell, sign[code] if len(code) else None, len(texts) * self.dimension)
        return normalize(sums.reshape(len(texts), self.dimension).astype(np.float32))


class OnnxEmbedder:
    """An exported encoder: first-token pooling, unit length.  Needs onnxruntime, tokenizers,
    and the two files."""

    def __init__(self, model_path: str, tokenizer_path: str, max_tokens: int = 512, providers: list[str] | None = None) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        have = set(onnxruntime.get_available_providers())
        picked = [x for x in providers or () if x in have] or ["CPUExecutionProvider"]
        self.session = onnxruntime.InferenceSession(model_path, providers=picked)
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.enable_truncation(max_tokens)
        self.tokenizer.enable_padding()
        self.inputs = {x.name for x in self.session.get_inputs()}

    def encode(self, texts: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch(texts)
        feed = {
            "input_ids": np.array([x.ids for x in found], np.int64), "attention_mask": np.array([x.attention_mask for x in found], np.int64),
            "token_type_ids": np.array([x.type_ids for x in found], np.int64),
        }
        hidden = self.session.run(None, {k: v for k, v in feed.items() if k in self.inputs})[0]
        return normalize(hidden[:, 0, :].astype(np.float32))


def normalize(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def embed(text: Column, make=HashingEmbedder, batch: int = BATCH) -> Column:
    """array<float> of each text; ``make`` builds the backend in each worker, once."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = make()
        for part in parts:
            texts = part.fillna("").tolist()
            rows = [v for k in range(0, len(texts), batch) for v in backend.encode(texts[k : k + batch])]
            yield pd.Series([v.astype(np.float32) for v in rows])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, t.ArrayType(t.FloatType()))(truncate(text))


def truncate(text: Column) -> Column:
    return F.substring(text, 1, MAX_CHARS)


def with_embedding(items: DataFrame, make=HashingEmbedder) -> DataFrame:
    return items.withColumn("embedding", embed(F.col("text"), make))


#: Execution providers by backend name; ``auto`` takes the first that exists.
PROVIDERS = {
    "onnx-cpu": ["CPUExecutionProvider"], "onnx-cuda": ["CUDAExecutionProvider"], "onnx-rocm": ["ROCMExecutionProvider"],
    "auto": ["CUDAExecutionProvider", "ROCMExecutionProvider", "CPUExecutionProvider"],
}


def backend(name: str, model: str = "", tokenizer: str = ""):
    """A builder for :func:`embed`: ``hashing``, or ONNX with a model folder or file.  Unknown
    names mean ONNX on the CPU; a quantised model beside the full one is preferred."""
    if name == "hashing":
        return HashingEmbedder

    def build() -> Embedder:
        import os

        path = model
        if os.path.isdir(model):
            found = [os.path.join(model, x) for x in ("model_quantized.onnx", "model.onnx")]
            path = next((x for x in found if os.path.exists(x)), found[-1])
        words = tokenizer or os.path.join(os.path.dirname(path), "tokenizer.json")
        return OnnxEmbedder(path, words, providers=PROVIDERS.get(name, PROVIDERS["onnx-cpu"]))

    return build


def info(make=HashingEmbedder) -> dict:
    """What a backend is: its class, width and unit length of a probe."""
    probe = make().encode(["probe text"])
    return {"backend": type(make()).__name__, "dimension": int(probe.shape[1]), "norm": round(float(np.linalg.norm(probe[0])), 6), "max_chars": MAX_CHARS}
