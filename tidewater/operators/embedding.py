"""Vectors from a provider, in batches inside tasks; what fails is told row by row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Embed = Callable[[list[str]], list[list[float]]]


def embedded(rows: DataFrame, text: str, embed: Embed, prefix: str = "", size: int = 10, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """``rows`` with ``embedding`` and ``embed_error``, one of which is null.

    A batch of ``size`` texts is tried ``tries`` times, with pauses of ``pause`` seconds, then twice as long; a batch that
    fails every time goes text by text, once each, so that one bad text costs one row.  A null text is an error of its row.
    """

    def batch(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        for k in range(tries):
            try:
                found = embed(texts)
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                return [(list(map(float, v)), None) for v in found]
            except Exception as e:  # whatever the provider raises
                last = f"{type(e).__name__}: {e}"[:300]
                if k + 1 < tries:
                    time.sleep(pause * 2**k)
        return [(None, last)] if len(texts) == 1 else [x for t in texts for x in alone(t)]

    def alone(text: str) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(list(map(float, embed([text])[0])), None)]
        except Exception as e:
            return [(None, f"{type(e).__name__}: {e}"[:300])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = part[text].tolist()
            good = [i for i, t in enumerate(texts) if t is not None]
            found: list[tuple[list[float] | None, str | None]] = [(None, "no text")] * len(texts)
            for at in range(0, len(good), size):
                own = good[at : at + size]
                for i, x in zip(own, batch([prefix + texts[i] for i in own]), strict=True):
                    found[i] = x
            yield part.assign(embedding=[v for v, _ in found], embed_error=[e for _, e in found])

    rows = rows.drop("embedding", "embed_error")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, embedding array<float>, embed_error string")
