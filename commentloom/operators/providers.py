"""Extension point: services that detect, translate or embed batches of texts."""

from __future__ import annotations

import inspect
import logging
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from commentloom.config import RetrySettings
from commentloom.sources.store import FAILED, OK

log = logging.getLogger(__name__)

DEFAULT_TARGET = "en"


class BatchProvider(Protocol):
    """A picklable service client.

    `provider_id` names the model; results of different ids never mix.
    Calling it with texts of one language returns one value per text, null for
    a text without a result. A translator into other languages than English has one more
    parameter, `target`.
    """

    provider_id: str

    def __call__(self, texts: list[str], lang: str | None) -> list[Any]: ...


def with_retry(
    call: Callable[[], Any],
    max_attempts: int = 3,
    wait: float = 2.0,
    sleep: Callable[[float], None] = time.sleep,
) -> Any:
    """Call up to `max_attempts` times, waiting wait, wait², … seconds in between."""
    for attempt in range(1, max_attempts + 1):
        try:
            return call()
        except Exception as problem:
            if attempt == max_attempts:
                raise
            log.warning("Attempt %d failed: %s", attempt, problem)
            sleep(wait**attempt)


def run_batches(
    requests: DataFrame,
    provider: BatchProvider,
    batch_size: int,
    value_type: str,
    retry: RetrySettings = RetrySettings(),
    sleep: Callable[[float], None] = time.sleep,
    target: str | None = None,
) -> DataFrame:
    """`request_key, status, value` for materialised requests `request_key, text[, lang]`.

    Requests are spread by key over as many tasks as there are batches, up to
    `max_parallel_calls`; the explicit number is kept by adaptive execution. No language
    makes a hot task, and each leaves at most one part-filled batch per task. Inside a task, texts of one language gather to full batches; a batch that fails after its
    retries yields null values and leaves the other batches alone.
    """
    has_lang = "lang" in requests.columns
    more = {} if target is None else {"target": target}
    if more and "target" not in inspect.signature(provider).parameters:
        if target != DEFAULT_TARGET:
            raise ValueError(f"the translator {provider.provider_id} has no target language to set to {target!r}")
        more = {}
    tasks = max(1, min(retry.max_parallel_calls, -(-requests.count() // batch_size)))

    def call(lang: str | None, held: list[tuple[str, str]]) -> pd.DataFrame:
        texts = [text for _, text in held]
        try:
            values = with_retry(
                lambda: provider(texts, lang, **more), retry.max_attempts, retry.wait, sleep
            )
            if len(values) != len(texts):
                raise ValueError(f"{len(values)} results for {len(texts)} texts")
        except Exception as problem:
            log.warning("Batch failed: %s", problem)
            values = [None] * len(texts)
        return pd.DataFrame(
            {
                "request_key": [key for key, _ in held],
                "status": [FAILED if v is None else OK for v in values],
                "value": values,
            }
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str | None, list[tuple[str, str]]] = {}
        for frame in frames:
            langs = frame["lang"] if has_lang else [None] * len(frame)
            for key, text, lang in zip(frame["request_key"], frame["text"], langs):
                held = waiting.setdefault(lang, [])
                held.append((key, text))
                if len(held) == batch_size:
                    yield call(lang, waiting.pop(lang))
        for lang, held in waiting.items():
            yield call(lang, held)

    return requests.repartition(tasks, "request_key").mapInPandas(
        run, f"request_key string, status string, value {value_type}"
    )
