"""Embedding of texts: pluggable backends, batches, length checks, the vector cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X

Backend = Callable[[list[str]], np.ndarray]


def hash_backend(dims: int = X.DIMS) -> Backend:
    """Feature hashing of words to unit vectors: deterministic, without a model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), "f4")
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = crc32(w.encode())
                out[i, h % dims] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


@lru_cache(maxsize=4)
def _loaded(factory: Callable[[], Backend]) -> Backend:
    """A backend once in each worker."""
    return factory()


def embed(text: Column, factory: Callable[[], Backend], dims: int = X.DIMS, batch: int = 64) -> Column:
    """ARRAY<FLOAT> of a text; null for a null text. A vector of another length than `dims` fails the run."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = _loaded(factory)
        for s in batches:
            here = np.flatnonzero(s.notna().to_numpy())
            out: list = [None] * len(s)
            for a in range(0, len(here), batch):
                at = here[a : a + batch]
                vectors = backend([str(s.iloc[i]) for i in at])
                if vectors.shape != (len(at), dims):
                    raise ValueError(f"vectors of length {vectors.shape[-1]}, {dims} expected")
                for i, v in zip(at, vectors):
                    out[i] = v.tolist()
            yield pd.Series(out)

    return F.pandas_udf(run, "array<float>")(text)


def embed_missing(inputs: DataFrame, cache: DataFrame, factory: Callable[[], Backend], identity: dict[str, object], strict: bool = False) -> DataFrame:
    """(episode_id, show_id, embedding, source): vectors of the cache of this identity, and of the backend for the rest.

    `strict` fails on the first input that the cache lacks. Inputs without a text have no vector.
    """
    ok = (F.col("model_name") == identity["model"]) & (X.clean_version(F.col("embedding_version")) == identity["version"]) & (F.size("embedding") == identity["dims"])
    hits = cache.where(F.coalesce(ok, F.lit(False))).groupBy("episode_id").agg(F.max_by("embedding", F.struct("embedded_at", "vec_id")).alias("_v"))
    rows = inputs.where(X.blank_to_null(F.col("text")).isNotNull()).join(hits, "episode_id", "left")
    found = rows.where(F.col("_v").isNotNull()).select("episode_id", "show_id", F.col("_v").alias("embedding"), F.lit("cache").alias("source"))
    missing = rows.where(F.col("_v").isNull())
    if strict:
        made = missing.select("episode_id", "show_id", F.raise_error(F.concat(F.lit("no vector for "), F.col("episode_id"))).cast("array<float>").alias("embedding"), F.lit("none").alias("source"))
    else:
        made = missing.select("episode_id", "show_id", embed(F.col("text"), factory, int(identity["dims"])).alias("embedding"), F.lit("backend").alias("source"))
    return found.unionByName(made)


def score_pairs(query: Column, text: Column) -> Column:
    """Stand-in for a model that scores pairs: the share of the query's words that the text has."""
    q, t = F.array_distinct(X.tokens(query)), F.array_distinct(X.tokens(text))
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))


def rebuild_shows(inputs: DataFrame, factory: Callable[[], Backend], identity: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """New cache rows of whole shows, and a row for each show: ok, or zero_episodes where no input has a text."""
    rows = embed_missing(inputs, inputs.sparkSession.createDataFrame([], "episode_id string, model_name string, embedding_version string, embedding array<float>, embedded_at timestamp, vec_id bigint"), factory, identity)
    vectors = rows.select("episode_id", "show_id", F.lit(identity["model"]).alias("model_name"), F.lit(identity["version"]).alias("embedding_version"), F.lit(identity["dims"]).alias("embedding_dimensions"), "embedding")
    usable = F.count_if(X.blank_to_null(F.col("text")).isNotNull())
    return vectors, inputs.groupBy("show_id").agg(usable.alias("episodes"), F.when(usable > 0, "ok").otherwise("zero_episodes").alias("status"))


def http_backend(url: str, attempts: int = 3, timeout: float = 30.0, pause: float = 0.5) -> Backend:
    """A service that answers {"input": [texts]} with {"data": [{"index", "embedding"}]}. A single text is tried again after a
    failure of the server, a batch never is; refusals and timeouts end the run."""
    import json
    import time
    import urllib.error
    import urllib.request

    def embed(texts: list[str]) -> np.ndarray:
        request = urllib.request.Request(url, json.dumps({"input": texts}).encode(), {"Content-Type": "application/json"})
        tries = attempts if len(texts) == 1 else 1
        for n in range(tries):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    data = json.load(answer)["data"]
                return np.array([d["embedding"] for d in sorted(data, key=lambda d: d["index"])], "f4")
            except urllib.error.HTTPError as e:
                if e.code < 500 or n == tries - 1:
                    raise
            except TimeoutError:
                raise
            except urllib.error.URLError:
                if n == tries - 1:
                    raise
            time.sleep(pause * 2**n)
        raise RuntimeError("no answer")

    return embed


def chunks(inputs: DataFrame) -> DataFrame:
    """(episode_id, chunk_index, text): one chunk an episode; rows without an id or a text are dropped."""
    return inputs.where(F.col("episode_id").isNotNull() & X.blank_to_null(F.col("text")).isNotNull()).select("episode_id", F.lit(0).alias("chunk_index"), "text")
