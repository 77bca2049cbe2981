"""Runs of pipelines: stage lists, result folders, tokenizer names, progress files, assets, prompts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import json_in


def stages(wanted: str | Sequence[str], order: Sequence[str], aliases: Mapping[str, str] | None = None) -> list[str]:
    """Stages named by a list or a comma-separated text of names, aliases and ranges "a-b", in the
    pipeline's order. They must be known, ranges must ascend, and there may be no gap."""
    names = {**{s.lower(): s for s in order}, **{k.lower(): v for k, v in (aliases or {}).items()}}
    place = {s: i for i, s in enumerate(order)}

    def known(token: str) -> str:
        if (found := names.get(token.strip().lower())) is None:
            raise ValueError(f"unknown stage: {token}")
        return found

    chosen: set[int] = set()
    for token in wanted.split(",") if isinstance(wanted, str) else wanted:
        if not (token := str(token).strip()):
            continue
        if token.lower() in names or "-" not in token:
            chosen.add(place[known(token)])
            continue
        first, last = (place[known(t)] for t in token.split("-", 1))
        if first > last:
            raise ValueError(f"descending range of stages: {token}")
        chosen.update(range(first, last + 1))
    if not chosen:
        raise ValueError("no stage selected")
    if len(chosen) != max(chosen) - min(chosen) + 1:
        raise ValueError("stages must follow one another")
    return [order[i] for i in sorted(chosen)]


def result_folder(folders: Mapping[str, str | None], candidates: Sequence[str], aliases: Sequence[str]) -> str | None:
    """Of result folders, each with the model name of its metrics, the first candidate by name, else the
    first in order whose model name is an alias, case and separators aside."""

    def plain(name: str) -> str:
        return "-".join(p for p in "".join(c if c.isalnum() else " " for c in name.lower()).split())

    for name in candidates:
        if name in folders:
            return name
    wanted = {plain(a) for a in aliases}
    return next((f for f in sorted(folders) if folders[f] and plain(folders[f] or "") in wanted), None)


def tokenizer_path(model: str | None, given: str | None, known: Mapping[str, str], fallback: str) -> str:
    """The given path, else the one of the model's name, case and white space aside, else the fallback."""
    return given or known.get((model or "").strip().lower(), fallback)


def hadoop_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_atomically(spark: SparkSession, path: str, value: object) -> None:
    """A JSON file that readers see whole or not at all: written beside its place and moved there."""
    jvm = spark._jvm
    where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"can't move {path}.part to {path}")


def progress(done: int, whole: int, began: float, now: float | None = None) -> dict[str, float | int | None]:
    """Snapshot of a run: done, total, share, seconds, rate a second and seconds left; no rate before
    anything is done."""
    seconds = (time.time() if now is None else now) - began
    rate = done / seconds if seconds > 0 and done else None
    return {"done": done, "total": whole, "share": done / whole if whole else 1.0, "seconds": seconds, "rate": rate, "left": (whole - done) / rate if rate else None}


def asset(spark: SparkSession, path: str, fetch: Callable[[], bytes]) -> str:
    """The path of a cached asset, fetched only if it isn't there."""
    if not hadoop_exists(spark, path):
        jvm = spark._jvm
        where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        out = fs.create(beside, True)
        out.write(bytearray(fetch()))
        out.close()
        fs.rename(beside, where)
    return path


class Generator(Protocol):
    """A language model: the answers to prompts, in their order."""

    def generate(self, prompts: Sequence[str]) -> list[str]: ...


class TableGenerator:
    """A stand-in that answers from a table of prompts, else with a fixed text."""

    def __init__(self, answers: Mapping[str, str] | None = None, otherwise: str = "mock response") -> None:
        self.answers, self.otherwise = dict(answers or {}), otherwise

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return [self.answers.get(p, self.otherwise) for p in prompts]


def answered(df: DataFrame, prompt: str, make: Callable[[], Generator], attempts: int = 1, score: Callable[[str], float] | None = None) -> DataFrame:
    """``df`` with ``answer`` and ``answer_error``: one batch of prompts a call. With several attempts the answer of
    the best score is kept, the first of equals, and an attempt that fails counts as none. Null prompts
    have neither."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            at = [i for i, p in enumerate(pdf[prompt]) if isinstance(p, str)]
            best: list[tuple[float, str] | None] = [None] * len(pdf)
            error: list[str | None] = [None] * len(pdf)
            for _ in range(attempts if at else 0):
                try:
                    found = model.generate([pdf[prompt].iloc[i] for i in at])
                except Exception as e:  # noqa: BLE001
                    for i in at:
                        error[i] = f"{type(e).__name__}: {e}"
                    continue
                for i, answer in zip(at, found):
                    value = score(answer) if score else 0.0
                    if best[i] is None or value > best[i][0]:
                        best[i] = (value, answer)
            yield pdf.assign(answer=[b[1] if b else None for b in best], answer_error=[None if b else e for b, e in zip(best, error)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", answer string, answer_error string"
    return df.mapInPandas(run, schema)


def stage_of(df: DataFrame, prompt: Column, make: Callable[[], Generator], schema: str, **options) -> DataFrame:  # noqa: ANN003
    """A model stage: the prompt of each row, its answer, and the JSON in it as ``result`` of the given
    schema; null where there is none. The rows stay, so one that failed can be tried again."""
    x = answered(df.withColumn("prompt", prompt), "prompt", make, **options)
    return x.withColumn("result", F.from_json(json_in(F.col("answer")), schema)).drop("prompt")
