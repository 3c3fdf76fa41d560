"""Models as injected functions: the contracts that their results must keep, around batches that Arrow brings.

No model is part of this package. A loader is a function without arguments that returns the model, a function over
lists; it is called once in every worker. Results that break the contract raise ModelError, which fails the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import config as C

Loader = Callable[[], Callable]


class ModelError(RuntimeError):
    """A model returned another number of values than it was asked for."""


def batches(lengths: Sequence[int], most_inputs: int = C.BATCH_INPUTS, most_tokens: int | None = C.BATCH_TOKENS) -> list[list[int]]:
    """Indices of inputs in batches of similar length: at most most_inputs, and most_tokens once all are padded to the
    longest. An input that is too long by itself has a batch of its own."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        size = len(out[-1]) + 1 if out else 0
        if out and size <= most_inputs and (most_tokens is None or size * lengths[i] <= most_tokens):
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _in_batches(model: Callable, inputs: list, most_tokens: int | None) -> list[np.ndarray]:
    """A row of numbers for each input, in the order of inputs."""
    rows: list = [None] * len(inputs)
    for group in batches([len(str(x)) for x in inputs], most_tokens=most_tokens):
        found = np.asarray(model([inputs[i] for i in group]), np.float64).reshape(-1)
        if not len(found) or len(found) % len(group):
            raise ModelError(f"{len(found)} numbers for {len(group)} inputs")
        for i, row in zip(group, found.reshape(len(group), -1), strict=True):
            rows[i] = row
    if len({len(r) for r in rows}) > 1:
        raise ModelError("rows of different sizes")
    return rows


def embedder(loader: Loader, least_norm: float | None = None, most_tokens: int | None = C.BATCH_TOKENS):
    """Column of texts to vectors of length 1 (nulls stay). least_norm bounds the length that is divided by."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for texts in parts:
            known = texts[texts.notna()]
            rows = _in_batches(model, known.tolist(), most_tokens)
            norms = [np.sqrt(r @ r) for r in rows]
            norms = norms if least_norm is None else [max(n, least_norm) for n in norms]
            with np.errstate(invalid="ignore", divide="ignore"):
                units = {i: (r / n).tolist() for i, r, n in zip(known.index, rows, norms, strict=True)}
            yield pd.Series([units.get(i) for i in texts.index])

    return run


def reranker(loader: Loader, most_tokens: int | None = C.BATCH_TOKENS):
    """Columns of questions and sentences to probabilities, from one logit a pair."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loader()
        for questions, sentences in parts:
            rows = _in_batches(model, list(zip(questions, sentences, strict=True)), most_tokens)
            if any(len(r) != 1 for r in rows):
                raise ModelError("more than one logit a pair")
            yield pd.Series([float(1 / (1 + np.exp(-r[0]))) for r in rows], dtype="float64")

    return run


def _one_by_one(loader: Loader, kind: str, check: Callable):
    """Columns of arguments to what the model, called once a row, gives; check(row of arguments, result) returns it."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = loader()
        for args in parts:
            yield pd.Series([check(a, model(*a)) for a in zip(*args, strict=True)])

    return run


def tool_model(loader: Loader, most: int = 64 * 1024):
    """Columns (system, tools, command) to the JSON text of a tool-calling model, of at most 64 KB."""

    def check(_, answer):
        if not isinstance(answer, str) or len(answer.encode()) > most:
            raise ModelError("no text, or one that is too long")
        return answer

    return _one_by_one(loader, "string", check)


def detector(loader: Loader):
    """Columns (picture as bytes, width, height) to rows of eight numbers each, as operators.geometry.decoded reads them."""

    def check(_, found):
        rows = np.asarray(found, np.float64).reshape(-1)
        if len(rows) % 8:
            raise ModelError("rows are not of eight numbers")
        return rows.reshape(-1, 8).tolist()

    return _one_by_one(loader, "array<array<double>>", check)


def state_model(loader: Loader):
    """Column of crops to whether the field is filled: the second of two logits is the greater one."""

    def check(_, logits):
        if len(logits) != 2:
            raise ModelError(f"{len(logits)} logits instead of 2")
        return bool(logits[1] > logits[0])

    return _one_by_one(loader, "boolean", check)


def recogniser(loader: Loader):
    """Columns (grey picture, width, height, languages) to tab-separated rows, as sources.tsv reads them."""

    def check(_, rows):
        if not isinstance(rows, str):
            raise ModelError("no text")
        return rows

    return _one_by_one(loader, "string", check)


def script_model(loader: Loader):
    """Columns (grey picture, width, height) to a struct of script and confidence."""

    @F.pandas_udf("struct<script:string,confidence:double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = loader()
        for args in parts:
            found = [model(*a) for a in zip(*args, strict=True)]
            if any(len(x) != 2 for x in found):
                raise ModelError("not a script and a confidence")
            yield pd.DataFrame(found, columns=["script", "confidence"])

    return run
