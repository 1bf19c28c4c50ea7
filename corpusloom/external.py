"""Interfaces to models, with deterministic offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class Encoder(Protocol):
    """Texts to vectors of one length."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Completer(Protocol):
    """A prompt to a completion."""

    def __call__(self, prompt: str) -> str: ...


class HashingEncoder:
    """Signed hashing of character trigrams, unit length; needs no model."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            padded = f" {text or ''} "
            for j in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[j : j + 3].encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def encode(texts: DataFrame, id_col: str, text_col: str, encoder: Encoder) -> DataFrame:
    """``(id, vec)``: texts encoded in batches inside the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "vec": list(encoder([t or "" for t in frame["text"]]))})

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, vec array<float>")


def encode_missing(texts: DataFrame, known: DataFrame, id_col: str, text_col: str, encoder: Encoder) -> DataFrame:
    """Vectors of the rows that ``known`` lacks."""
    return encode(texts.join(known.select(F.col("id").alias(id_col)), id_col, "left_anti"), id_col, text_col, encoder)


def complete(prompts: DataFrame, id_col: str, prompt_col: str, completer: Completer, retries: int = 3) -> DataFrame:
    """``(id, status, text)``: completions in the tasks; a row that fails keeps its error as text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt in zip(frame["id"], frame["prompt"]):
                status, text = "failed", ""
                for _ in range(retries):
                    try:
                        status, text = "success", completer(prompt)
                        break
                    except Exception as error:  # noqa: BLE001 - any failure of the service is the row's result
                        text = str(error)
                rows.append((key, status, text))
            yield pd.DataFrame(rows, columns=["id", "status", "text"])

    rows = prompts.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, status string, text string")


def repair_json(text: str) -> str | None:
    """Valid JSON from nearly valid JSON: fences, trailing commas, single quotes, unclosed brackets; else null."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text or "")
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    stack, quoted, out = [], False, []
    for i, ch in enumerate(body):
        if quoted:
            if ch == '"' and body[i - 1] != "\\":
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not stack or stack.pop() != ch:
                break
        out.append(ch)
        if not stack and not quoted:
            break
    candidate = "".join(out) + ('"' if quoted else "") + "".join(reversed(stack))
    for fixed in (candidate, re.sub(r",(\s*[}\]])", r"\1", candidate), re.sub(r",(\s*[}\]])", r"\1", candidate.replace("'", '"'))):
        try:
            return json.dumps(json.loads(fixed), ensure_ascii=False)
        except ValueError:
            continue
    return None


def repaired_json() -> Callable:
    """``repair_json`` as an Arrow-batched function for columns."""

    @F.pandas_udf(StringType())
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repair_json(t))

    return repair
