"""Settings from the environment, validated; an empty variable counts as unset."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from pathlib import Path

PREFIX = "TESSERA_"
PROVIDERS = ("hashing", "onnx", "ollama")
DEFAULT_MODELS = {"hashing": "hashing-md5", "onnx": "sentence-transformers/all-MiniLM-L6-v2", "ollama": "nomic-embed-text"}


@dataclass(frozen=True)
class Settings:
    index_dir: str = ""
    embed_provider: str = "hashing"
    embed_model: str = ""
    embed_dim: int = 256
    model_dir: str = ""
    onnx_file: str = "onnx/model.onnx"
    model_host: str = "https://huggingface.co"
    ollama_host: str = "http://localhost:11434"
    index_concurrency: int = 0
    low_priority: bool = True

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        home = Path.home() / ".tessera"
        put("index_dir", self.index_dir or str(home / "index"))
        put("model_dir", self.model_dir or str(home / "models"))
        put("embed_model", self.embed_model or DEFAULT_MODELS.get(self.embed_provider, ""))
        put("index_concurrency", self.index_concurrency or min(os.cpu_count() or 1, 4))
        if self.embed_provider not in PROVIDERS:
            raise ValueError(f"embed provider must be one of {', '.join(PROVIDERS)}: {self.embed_provider!r}")
        if self.embed_dim <= 0:
            raise ValueError("embed dimension must be positive")
        if self.index_concurrency <= 0:
            raise ValueError("index concurrency must be positive")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {}
        for name, kind in (("index_dir", str), ("embed_provider", str), ("embed_model", str), ("embed_dim", int), ("model_dir", str), ("onnx_file", str), ("model_host", str), ("ollama_host", str), ("index_concurrency", int), ("low_priority", bool)):
            raw = env.get(PREFIX + name.upper(), "")
            if not raw:
                continue
            if kind is bool:
                if raw.lower() not in ("1", "0", "true", "false", "yes", "no"):
                    raise ValueError(f"{PREFIX}{name.upper()} must be a boolean: {raw!r}")
                given[name] = raw.lower() in ("1", "true", "yes")
            else:
                try:
                    given[name] = kind(raw)
                except ValueError as e:
                    raise ValueError(f"{PREFIX}{name.upper()} must be a whole number: {raw!r}") from e
                if kind is int and given[name] <= 0:
                    raise ValueError(f"{PREFIX}{name.upper()} must be positive")
        return cls(**given)

    def index_path(self, root: str) -> str:
        """The folder of one corpus: a hash of its absolute root."""
        return str(Path(self.index_dir) / hashlib.sha256(os.path.abspath(root).encode()).hexdigest())
