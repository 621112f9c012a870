"""Embedding, cross-encoding and generation behind one interface each, with offline defaults that always give the same result."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np

from strataseek.config import EMBEDDING_BATCH, EMBEDDING_DIM
from strataseek.errors import ProviderError

WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


class CrossEncoder(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def stream(self, messages: list[dict[str, str]], model: str) -> Iterator[str]: ...


class HashEmbedder:
    """Signed feature hashing of lower-case tokens, at unit length."""

    def __init__(self, dim: int = EMBEDDING_DIM):
        self.dim = dim

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in WORD.findall(text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[(h >> 1) % self.dim] += 1 if h & 1 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


class OverlapCrossEncoder:
    """Share of the query's tokens that a text has."""

    def scores(self, query: str, texts: list[str]) -> list[float]:
        wanted = set(WORD.findall(query.lower()))
        return [len(wanted & set(WORD.findall(t.lower()))) / max(1, len(wanted)) for t in texts]


class ExtractiveGenerator:
    """The sources of the context, with a confidence by how many there are."""

    def stream(self, messages: list[dict[str, str]], model: str) -> Iterator[str]:
        context = messages[-1]["content"]
        sources = re.findall(r"^Source: (.+)$", context, re.M)
        yield "Relevant code: " if sources else "Nothing relevant was found. "
        yield from (s + ("; " if i < len(sources) - 1 else ". ") for i, s in enumerate(sources))
        yield f"Confidence: {'HIGH' if len(sources) >= 3 else 'MEDIUM' if sources else 'LOW'}"


# What tells errors that may pass.
RETRYABLE_NAMES = ("apitimeouterror", "ratelimiterror", "apiconnectionerror")
RATE_LIMIT_WORDS = ("rate", "429", "too many")


def is_retryable(e: BaseException) -> bool:
    """A timeout, a rate limit or a lost connection, by the error's type, name or message."""
    name, said = type(e).__name__.lower(), str(e).lower()
    if isinstance(e, TimeoutError) or name in RETRYABLE_NAMES:
        return True
    by_name = "timeout" in name or all(w in name for w in ("rate", "limit")) or all(w in name for w in ("connection", "error"))
    return by_name or any(w in said for w in ("timeout", "rate limit", "ratelimit"))


def is_rate_limit(e: BaseException) -> bool:
    return any(w in str(e).lower() for w in RATE_LIMIT_WORDS)


def with_retries(call: Callable[[], list], attempts: int = 3, pause: float = 0.5, most: float = 120.0, on: Callable[[BaseException], bool] = is_retryable) -> list:
    """Up to ``attempts`` calls, with pauses that double up to ``most`` seconds; errors that don't pass come out at once."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if not on(e) or i == attempts - 1:
                raise ProviderError(str(e)) from e
            time.sleep(min(most, pause * 2**i))
    raise ProviderError("no attempt was made")


def embed_batches(
    embedder: Embedder, texts: list[str], kind: str = "document", size: int = EMBEDDING_BATCH, between: float = 0.0, attempts: int = 3, pause: float = 0.5, on: Callable[[BaseException], bool] = is_retryable
) -> list[list[float]]:
    """In order, ``size`` texts a call; counts and dimensions are checked. between: seconds between calls."""
    if size <= 0:
        raise ValueError("a batch needs at least one text")
    out: list[list[float]] = []
    for at in range(0, len(texts), size):
        own = texts[at : at + size]
        if at and between:
            time.sleep(between)
        new = with_retries(lambda own=own: embedder.embed(own, kind), attempts, pause, on=on)
        if len(new) != len(own) or any(len(v) != embedder.dim for v in new):
            raise ProviderError(f"{len(own)} texts need {len(own)} vectors of {embedder.dim} numbers")
        out += new
    return out


def embed_limited(embedder: Embedder, texts: list[str], kind: str = "document", size: int = 20, pause: float = 25.0, attempts: int = 5) -> list[list[float]]:
    """For a provider with a rate limit: small batches, a pause between them, and longer ones each time the limit is met."""
    return embed_batches(embedder, texts, kind, size, pause, attempts, pause, is_rate_limit)


def complete(generator: Generator, messages: list[dict[str, str]], models: list[str], used: list[str] | None = None) -> Iterator[str]:
    """Text pieces of the first model that answers, whose name goes to ``used``.

    The next model is only asked if nothing came yet and the error is one that may pass.
    """
    names = list(dict.fromkeys(m.strip() for m in models if m and m.strip()))
    for i, model in enumerate(names):
        some = False
        try:
            for piece in generator.stream(messages, model):
                if piece:
                    if not some and used is not None:
                        used.append(model)
                    some = True
                    yield piece
            if some:
                return
        except Exception as e:
            if some or i == len(names) - 1 or not is_retryable(e):
                raise ProviderError(f"{', '.join(names[: i + 1])}: {e}") from e
    raise ProviderError(f"no answer from {', '.join(names) or 'any model'}")
