"""Embedding providers, applied in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
import urllib.parse
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold_text
from tessera.runtime import ship
from tessera.settings import Settings

BATCH, RUNES, SHORT_RUNES, TIMEOUT_S = 32, 1024, 508, 60


class Embedder(ABC):
    """One vector for each text, in order."""

    model: str = ""
    dim: int = 0

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def close(self) -> None:
        return None


class HashingEmbedder(Embedder):
    """Feature hashing of tokens, of unit length; needs no model."""

    def __init__(self, dim: int = 256) -> None:
        self.model, self.dim = f"hashing-md5-{dim}", dim

    def embed(self, texts):
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[^\W_]+", fold_text(text)):
                row[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim] += 1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).tolist()


class OllamaEmbedder(Embedder):
    """The /api/embed call of a local model server."""

    def __init__(self, host: str, model: str) -> None:
        self.host, self.model = host.rstrip("/"), model
        self.dim = len(self.embed(["warm up"])[0])

    def embed(self, texts):
        if not texts:
            return []
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.host}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as response:
            got = json.load(response)
        if got.get("error"):
            raise RuntimeError(f"embedding failed: {got['error']}")
        if len(got.get("embeddings") or []) != len(texts):
            raise RuntimeError(f"asked for {len(texts)} vectors, got {len(got.get('embeddings') or [])}")
        return got["embeddings"]


class OnnxEmbedder(Embedder):
    """A sentence model with its tokenizer; mean of token vectors, of unit length.

    Texts are cut to RUNES code points; a batch that fails is retried one by one, and a text that
    fails is retried cut to SHORT_RUNES.
    """

    def __init__(self, model: str, model_dir: str, onnx_file: str, host: str = "") -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        folder = os.path.join(model_dir, *model.split("/"))
        if host and not all(os.path.isfile(os.path.join(folder, x)) for x in ("tokenizer.json", onnx_file)):
            fetch_model(model, folder, onnx_file, host)
        self.model = model
        self._tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
        self._session = onnxruntime.InferenceSession(os.path.join(folder, onnx_file))
        self._inputs = [x.name for x in self._session.get_inputs()]
        self.dim = len(self.embed(["warm up"])[0])

    def _run(self, texts):
        encoded = self._tokenizer.encode_batch(texts)
        width = max(len(e.ids) for e in encoded)
        pad = lambda f: np.array([f(e) + [0] * (width - len(f(e))) for e in encoded], dtype=np.int64)
        feed = {"input_ids": pad(lambda e: e.ids), "attention_mask": pad(lambda e: e.attention_mask), "token_type_ids": pad(lambda e: e.type_ids)}
        hidden = self._session.run(None, {k: feed[k] for k in self._inputs})[0]
        mask = feed["attention_mask"][..., None]
        mean = (hidden * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).tolist()

    def embed(self, texts):
        return with_fallback(self._run, [t[:RUNES] for t in texts])


def with_fallback(run, texts: list[str]) -> list[list[float]]:
    try:
        return run(texts)
    except Exception:
        out = []
        for t in texts:
            try:
                out += run([t])
            except Exception:
                out += run([t[:SHORT_RUNES]])
        return out


def wanted_model_files(files: list[str], onnx_file: str) -> list[str]:
    """Of a model repository: the ONNX file and its external data, root json and txt files, and the pooling config."""
    if onnx_file not in files:
        raise ValueError(f"{onnx_file} is not in the repository; it has {', '.join(f for f in files if f.endswith('.onnx')) or 'no .onnx file'}")
    root = lambda f: "/" not in f and f.endswith((".json", ".txt"))
    return [f for f in files if f in (onnx_file, f"{onnx_file}_data", "1_Pooling/config.json") or root(f)]


def fetch_model(model: str, folder: str, onnx_file: str, host: str) -> list[str]:
    """Fetch what a model needs from a model hub into ``folder``; what is there already stays. Returns the files fetched.

    A file appears under its name once it is whole, so a run that was broken off is taken up by the next.
    """
    def get(path: str):
        return urllib.request.urlopen(f"{host.rstrip('/')}/{urllib.parse.quote(path)}", timeout=TIMEOUT_S)

    with get(f"api/models/{model}") as response:
        names = [x["rfilename"] for x in json.load(response).get("siblings", [])]
    fetched = []
    for name in wanted_model_files(names, onnx_file):
        target = os.path.realpath(os.path.join(folder, *name.split("/")))
        if not target.startswith(os.path.realpath(folder) + os.sep):
            raise ValueError(f"{name} would lie outside of {folder}")
        if os.path.isfile(target) and os.path.getsize(target):
            continue
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with get(f"{model}/resolve/main/{name}") as response, tempfile.NamedTemporaryFile(dir=os.path.dirname(target), suffix=".part", delete=False) as part:
            try:
                shutil.copyfileobj(response, part)
                part.close()
                os.replace(part.name, target)
            except BaseException:
                os.unlink(part.name)
                raise
        fetched.append(name)
    return fetched


def create(settings: Settings) -> Embedder:
    if settings.embed_provider == "hashing":
        return HashingEmbedder(settings.embed_dim)
    if settings.embed_provider == "onnx":
        return OnnxEmbedder(settings.embed_model, settings.model_dir, settings.onnx_file, settings.model_host)
    if settings.embed_provider == "ollama":
        return OllamaEmbedder(settings.ollama_host, settings.embed_model)
    raise ValueError(f"unknown embed provider {settings.embed_provider!r}")


@lru_cache(maxsize=2)
def _created(settings: Settings) -> Embedder:
    return create(settings)


def embed_chunks(chunks: DataFrame, embedder: Settings | Embedder, text: str = "content") -> DataFrame:
    """``chunks`` with embedding (array of float); a model is built once in each Python worker."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tessera.operators.embed import BATCH, _created
        from tessera.settings import Settings

        e = _created(embedder) if isinstance(embedder, Settings) else embedder
        for texts in batches:
            out: list = []
            for i in range(0, len(texts), BATCH):
                part = texts.iloc[i : i + BATCH].tolist()
                vectors = e.embed(part)
                if len(vectors) != len(part):
                    raise RuntimeError(f"asked for {len(part)} vectors, got {len(vectors)}")
                out += vectors
            yield pd.Series(out)

    return chunks.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))
