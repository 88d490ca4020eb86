"""The two places where a model is plugged in: text generation and embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENERATED = [
    T.StructField("response", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
    T.StructField("prompt_tokens", T.IntegerType()),
    T.StructField("completion_tokens", T.IntegerType()),
    T.StructField("error", T.StringType()),
]

EMBEDDING = T.StructField("embedding", T.ArrayType(T.FloatType()))


def generate(
    requests: DataFrame,
    model: Callable[[list[str]], list[dict]],
    chat: str = "chat",
    chats_per_call: int = 64,
) -> DataFrame:
    """Runs ``model`` over the chats on the executors, ``chats_per_call`` at a time.

    ``model`` gets a list of JSON chats and returns one dict per chat with ``content``
    and, if it has them, ``finish_reason``, ``prompt_tokens`` and ``completion_tokens``.
    A call that fails is repeated chat by chat; a chat that still fails does not fail the
    job, its row carries the message in ``error``.
    """
    schema = T.StructType([*requests.schema.fields, *GENERATED])
    names = schema.fieldNames()

    def ask(chats: list[str]) -> list[dict]:
        try:
            answers = list(model(chats))
            if len(answers) != len(chats):
                raise ValueError(f"{len(answers)} answers to {len(chats)} chats")
            return answers
        except Exception as problem:  # noqa: BLE001 - any model failure becomes data
            if len(chats) == 1:
                return [{"error": str(problem)}]
            return [answer for one in chats for answer in ask([one])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chats = batch[chat].tolist()
            answers = [a for i in range(0, len(chats), chats_per_call) for a in ask(chats[i: i + chats_per_call])]
            yield batch.assign(
                response=[a.get("content") for a in answers],
                finish_reason=[a.get("finish_reason", "unknown") for a in answers],
                prompt_tokens=pd.array([a.get("prompt_tokens") for a in answers], dtype="Int32"),
                completion_tokens=pd.array([a.get("completion_tokens") for a in answers], dtype="Int32"),
                error=[a.get("error") for a in answers],
            )[names]

    return requests.mapInPandas(run, schema)


def recorded(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Joins answers that were made earlier, in place of a model call."""
    return requests.join(responses, key, "left")


def embed(
    texts: DataFrame,
    text: str,
    model: Callable[[list[str]], list[list[float]]],
    texts_per_call: int = 256,
    empty_on_error: bool = False,
) -> DataFrame:
    """Adds ``embedding``: the model's vector of each text.

    A failing model fails the job, or with ``empty_on_error`` a call that fails is repeated
    text by text and only a text that still fails gets an empty vector. The rows pass through
    one Python step, so the model sees a text once however many filters and readers follow in
    the same job.
    """
    schema = T.StructType([*[f for f in texts.schema.fields if f.name != "embedding"], EMBEDDING])
    names = schema.fieldNames()

    def ask(part: list[str]) -> list[list[float]]:
        try:
            found = list(model(part))
            if len(found) != len(part):
                raise ValueError(f"{len(found)} vectors for {len(part)} texts")
            return found
        except Exception:  # noqa: BLE001 - the caller chose what a failure means
            if not empty_on_error:
                raise
            return [[]] if len(part) == 1 else [vector for one in part for vector in ask([one])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[text].tolist()
            found = [v for i in range(0, len(asked), texts_per_call) for v in ask(asked[i: i + texts_per_call])]
            yield batch.assign(embedding=pd.Series(found, index=batch.index, dtype=object))[names]

    return texts.mapInPandas(run, schema)
