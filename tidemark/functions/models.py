"""Model calls as columns: one client per partition, bounded concurrency, retries, and errors as rows rather than failures.

The default engine is a deterministic stub whose answer depends on the prompt alone, so partitioning and retries can't
change results.  Engines for remote or local services are used only if their packages are installed.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS


_LOADING = threading.Lock()


class Client(Protocol):
    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str: ...


def top_words(text: str, k: int = 3) -> list[str]:
    counts: dict[str, int] = {}
    for w in re.findall(r"[a-z]{3,}", text.lower()):
        if w not in STOP_WORDS:
            counts[w] = counts.get(w, 0) + 1
    return sorted(counts, key=lambda w: -counts[w])[:k] or ["unknown"]


@dataclass
class StubClient:
    """Answers by the kind of prompt: cluster choices by common keywords, letters, verdicts, or the prompt's first sentence."""

    responses: tuple[str, ...] = ()
    failing: str = ""

    def generate(self, prompt: str, max_tokens: int = 500, temperature: float = 0.7) -> str:
        if self.failing and self.failing in prompt:
            raise RuntimeError("the stub was told to fail")
        digest = int.from_bytes(hashlib.sha256(prompt.encode()).digest()[:8], "big")
        if self.responses:
            return self.responses[digest % len(self.responses)]
        if "[TASK: cluster]" in prompt:
            return self._cluster(prompt)
        if "[TASK: answer]" in prompt:
            return "ABCD"[digest % 4]
        if "[TASK: judge]" in prompt:
            return json.dumps({"criteria": [{"is_satisfied": bool(digest & 1)}, {"is_satisfied": bool(digest & 2)}]})
        if "[TASK: validate]" in prompt:
            return json.dumps({"is_valid": digest % 4 > 0, "overall_reason": "by digest"})
        if "[TASK: rephrase]" in prompt:
            return prompt.rpartition("[QUESTION]")[2].strip()
        if "[TASK: keywords]" in prompt:
            return json.dumps(top_words(prompt.rpartition("[DOCUMENT]")[2], 5))
        body = prompt.rpartition("[DOCUMENTS]")[2].strip() or prompt
        return " ".join(body.split()[: max(1, max_tokens // 2)])

    @staticmethod
    def _cluster(prompt: str) -> str:
        table, _, document = prompt.rpartition("[DOCUMENT]")
        own = set(top_words(document, 5))
        known = [(int(i), set(json.loads(w))) for i, w in re.findall(r"^Cluster (\d+): (\[.*\])$", table, re.M)]
        best = max(known, key=lambda c: (len(c[1] & own), -c[0]), default=None)
        if best and best[1] & own:
            return f"({best[0]}, {json.dumps(sorted(best[1] | own)[:5])})"
        new = re.search(r"^Next: (\d+)$", table, re.M)
        return f"({new[1] if new else 0}, {json.dumps(sorted(own))})"


@dataclass
class OpenAIClient:
    """Any service with the OpenAI chat interface; needs the openai package."""

    model: str
    options: dict = field(default_factory=dict)

    def generate(self, prompt: str, max_tokens: int = 500, temperature: float = 0.7) -> str:
        import openai

        client = openai.OpenAI(**self.options)
        out = client.chat.completions.create(model=self.model, max_tokens=max_tokens, temperature=temperature, messages=[{"role": "user", "content": prompt}])
        return out.choices[0].message.content or ""


@dataclass
class VllmClient:
    """A local vLLM engine; needs the vllm package."""

    model: str
    options: dict = field(default_factory=dict)

    def generate(self, prompt: str, max_tokens: int = 500, temperature: float = 0.7) -> str:
        import vllm

        with _LOADING:  # threads of a task share one engine
            self._engine = getattr(self, "_engine", None) or vllm.LLM(self.model, **self.options)
        return self._engine.generate([prompt], vllm.SamplingParams(max_tokens=max_tokens, temperature=temperature))[0].outputs[0].text


ENGINES: dict[str, Callable[..., Client]] = {"stub": StubClient, "openai": OpenAIClient, "together": OpenAIClient, "vllm": VllmClient}


def make_client(engine: str, **options) -> Client:
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}")
    return ENGINES[engine](**options)


def generate(prompt: Column | str, engine: str = "stub", max_tokens: int = 500, temperature: float = 0.7, workers: int = 8, tries: int = 3, **options) -> Column:
    """struct(text, error) for each prompt; a call that fails ``tries`` times gives its error and a null text."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make_client(engine, **options)

        def call(p: str | None) -> tuple[str | None, str | None]:
            error = ""
            for _ in range(tries):
                try:
                    return client.generate(p or "", max_tokens, temperature), None
                except Exception as e:  # noqa: BLE001  one bad prompt must not end the run
                    error = f"{type(e).__name__}: {e}"
            return None, error

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(call, batch)), columns=["text", "error"])

    return run(prompt)


def embed(text: Column | str, dims: int = 64) -> Column:
    """A deterministic embedding: hashed words, weighted by the root of their counts, at length 1; no words give zeros."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([hashed_vector(t, dims).tolist() for t in batch])

    return run(text)


def hashed_vector(text: str | None, dims: int = 64) -> np.ndarray:
    out = np.zeros(dims, np.float32)
    counts: dict[str, int] = {}
    for w in re.findall(r"\w+", (text or "").lower()):
        counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        out[h % dims] += (1 if h >> 32 & 1 else -1) * n**0.5
    length = float(np.linalg.norm(out))
    return out / length if length else out


def token_match(hyp: Column | str, ref: Column | str, dims: int = 64) -> Column:
    """F of greedy matching between the token embeddings of two texts; any model of tokens may take the place of the hashes."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def rows(text: str | None) -> np.ndarray:
            found = re.findall(r"\w+", (text or "").lower())
            return np.stack([hashed_vector(w, dims) for w in found]) if found else np.zeros((0, dims), np.float32)

        for h, r in batches:
            yield pd.Series([greedy_match(rows(x), rows(y)) for x, y in zip(h, r)], dtype="float64")

    return run(hyp, ref)


def greedy_match(a: np.ndarray, b: np.ndarray) -> float:
    """F of greedy matching of token embeddings, rows of unit length."""
    if not len(a) or not len(b):
        return 0.0
    sim = a @ b.T
    p, r = float(sim.max(1).mean()), float(sim.max(0).mean())
    return 2 * p * r / (p + r) if p + r > 0 else 0.0
