"""Text generation as a pluggable step over batches, and the tokens of training examples."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from marginalia.functions.boxed import scan_boxes
from marginalia.session import checkpoint, ship


class Generator(Protocol):
    """Answers prompts; built once per task."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


#: Whether a growing text may end here.
Stop = Callable[[str], bool]


def stop_rule(multiple_choice: bool, most: int | None = None) -> Stop:
    """When a growing text may end: once it names a letter, or has a closed box behind its first thought; or at a length."""
    letter = re.compile(r"FINAL\s*:\s*[A-J]\b|\\boxed\{\s*[A-J]\s*\}", re.I)

    def stop(text: str) -> bool:
        if most is not None and len(text) >= most:
            return True
        if multiple_choice and letter.search(text):
            return True
        return "</think>" in text and bool(scan_boxes(text.split("</think>", 1)[1]))

    return stop


def stub() -> Generator:
    """A deterministic stand-in: a letter or a number that follows from the prompt."""

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            n = int(hashlib.md5(p.encode()).hexdigest()[:6], 16)
            out.append(f"We compare the values step by step. Therefore the answer is \\boxed{{{chr(65 + n % 4) if 'Valid choices:' in p else n % 100}}}.")
        return out

    return answer


def generate(prompted: DataFrame, make: Callable[[], Generator] = stub) -> DataFrame:
    """prompted: id, prompt. Gives id, raw, n_tokens (words), cut from lineage at once, so that a generator that isn't deterministic never runs twice for what is used."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = make()
        for b in batches:
            raw = g(b["prompt"].tolist())
            yield pd.DataFrame({"id": b["id"], "raw": raw, "n_tokens": [len(r.split()) for r in raw]})

    ship(prompted.sparkSession)
    return checkpoint(prompted.select("id", "prompt").mapInPandas(run, "id long, raw string, n_tokens int"))


#: Marks tokens that carry no loss.
MASKED = -100


def masked_tokens(examples: DataFrame, encode: Callable[[str], list[int]], longest: int) -> DataFrame:
    """prompt_text, target to input_ids and labels: cut on the left, the prompt masked, examples of nothing but masks dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b["prompt_text"], b["target"]):
                n, ids = len(encode(p)), encode(p + t)
                drop = max(0, len(ids) - longest)
                ids, n = ids[drop:], max(0, n - drop)
                labels = [MASKED] * min(n, len(ids)) + ids[n:]
                if any(x != MASKED for x in labels):
                    rows.append((ids, labels))
            yield pd.DataFrame(rows, columns=["input_ids", "labels"])

    return examples.select("prompt_text", "target").mapInPandas(run, "input_ids array<int>, labels array<int>")
