"""Connectors to model servers: answers, vectors and extractions as Arrow batches, and cached downloads.

A client is any picklable callable; the HTTP ones below speak the two common JSON dialects. It is made
once for each task. A call that fails makes a row whose done_reason is ``error:<type>``, so that a
lost server costs rows that a resumed run asks for again, never the job.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import PAYLOAD, status

Answer = tuple[str, dict]
_FIELDS = "answer string, wall_s double, prompt_tokens long, gen_tokens long, done_reason string, thinking_len long"


def post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.loads(r.read())


#: Where the two protocols put each part of an answer, as the servers document them.
GENERATE_PROTOCOL = {"answer": "response", "prompt_tokens": "prompt_eval_count", "gen_tokens": "eval_count", "done_reason": "done_reason", "thinking": "thinking"}
CHAT_PROTOCOL = {"answer": "choices/0/message/content", "prompt_tokens": "usage/prompt_tokens", "gen_tokens": "usage/completion_tokens", "done_reason": "choices/0/finish_reason", "thinking": "choices/0/message/reasoning_content"}


def at_path(reply: object, path: str) -> object:
    """What lies at a path of keys and places; None where it ends early."""
    for step in path.split("/"):
        try:
            reply = reply[int(step)] if isinstance(reply, list) else reply[step]
        except (KeyError, IndexError, TypeError):
            return None
    return reply


def parsed(reply: dict, protocol: dict[str, str]) -> Answer:
    """A reply under a protocol; parts that a server leaves out are empty, or no tokens."""
    part = {name: at_path(reply, path) for name, path in protocol.items()}
    text = {name: part.pop(name) or "" for name in ("answer", "thinking")}
    tokens = {name: int(part.pop(name) or 0) for name in ("prompt_tokens", "gen_tokens")}
    return text["answer"].strip(), {**tokens, **part, "thinking_len": len(text["thinking"])}


class Generate:
    """One prompt, one completion, at temperature 0."""

    def __init__(self, url: str, model: str, tokens: int = 64, context: int = 8192, schema: dict | None = None, timeout: float = 1800):
        self.url, self.timeout = url, timeout
        self.body = {"model": model, "stream": False, "think": False, "options": {"temperature": 0, "seed": 0, "num_ctx": context, "num_predict": tokens}}
        if schema:
            self.body["format"] = schema

    def __call__(self, prompt: str) -> Answer:
        return parsed(post(self.url, self.body | {"prompt": prompt}, self.timeout), GENERATE_PROTOCOL)


class Chat:
    """A chat completion whose reasoning comes in a field of its own."""

    def __init__(self, url: str, system: str = "", tokens: int = 1024, timeout: float = 1800):
        self.url, self.timeout = url, timeout
        self.before = [{"role": "system", "content": system}] if system else []
        self.body = {"temperature": 0, "seed": 0, "max_tokens": tokens}

    def __call__(self, prompt: str) -> Answer:
        turns = [*self.before, {"role": "user", "content": prompt}]
        return parsed(post(self.url, self.body | {"messages": turns}, self.timeout), CHAT_PROTOCOL)


class Embed:
    """A vector for each of a list of texts, each cut to ``longest`` characters if that is set."""

    def __init__(self, url: str, model: str, longest: int | None = None, timeout: float = 600):
        self.url, self.model, self.longest, self.timeout = url, model, longest, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        asked = [t[: self.longest] for t in texts]
        vectors = at_path(post(self.url, {"model": self.model, "input": asked}, self.timeout), "embeddings") or []
        if len(vectors) != len(asked):
            raise ValueError(f"the server gave {len(vectors)} vectors for {len(asked)} texts")
        return vectors


def generate(prompts: DataFrame, client: Callable[[str], Answer], prompt: str = "prompt") -> DataFrame:
    """The rows without their prompts, with answer, wall_s, token counts, done_reason and thinking_len."""
    kept = [f for f in prompts.schema.fields if f.name != prompt]
    columns = [f.name for f in kept]

    def ask(text: str | None) -> tuple:
        began = time.time()
        try:
            answer, meta = client(text or "")
        except Exception as e:  # noqa: BLE001 - the row says what failed
            answer, meta = "", {"done_reason": f"error:{type(e).__name__}"}
        return answer, round(time.time() - began, 3), meta.get("prompt_tokens", 0), meta.get("gen_tokens", 0), meta.get("done_reason"), meta.get("thinking_len", 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        for rows in batches:
            found = pd.DataFrame([ask(p) for p in rows[prompt]], columns=names, index=rows.index)
            yield pd.concat([rows[columns], found], axis=1)

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return prompts.mapInPandas(run, own + _FIELDS)


def extract(chunks: DataFrame, client: Callable[[str], Answer], prompt: str = "prompt") -> DataFrame:
    """The rows with wall_s, token counts, status, entities and relationships; lists only where status is ok."""
    rows = generate(chunks, client, prompt)
    failed = F.coalesce(F.col("done_reason").startswith("error"), F.lit(False))
    rows = rows.withColumn("status", F.when(failed, F.col("done_reason")).otherwise(status(F.col("done_reason"), F.col("answer"))))
    read = F.when(F.col("status") == "ok", F.from_json("answer", PAYLOAD))
    return rows.withColumn("_r", read).select("*", "_r.entities", "_r.relationships").drop("_r", "answer", "done_reason", "thinking_len")


def embed(texts: DataFrame, client: Callable[[list[str]], list[list[float]]], id_col: str, text: str, batch: int = 32) -> DataFrame:
    """``id_col``, vec: vectors of unit length. A batch that fails fails its task, which Spark tries again."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                m = np.asarray(client(part["t"].tolist()), np.float32)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "vec": list(m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12))})

    rows = texts.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}, vec array<float>")


def fetch(url: str, path: str, timeout: float = 600) -> str:
    """The local path of a download; what is there isn't fetched again, half a file never stays."""
    target = Path(path)
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")
        with urllib.request.urlopen(url, timeout=timeout) as r, part.open("wb") as f:
            while block := r.read(1 << 20):
                f.write(block)
        part.replace(target)
    return str(target)


def load_npy(spark, path: str, rows_per_task: int = 65_536) -> DataFrame:
    """row, vec of a two-dimensional .npy file on shared storage; each task maps its own rows."""
    import numpy as np

    n = np.load(path, mmap_mode="r").shape[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.load(path, mmap_mode="r")
        for rows in batches:
            yield pd.DataFrame({"row": rows["id"], "vec": [np.asarray(table[i], np.float32) for i in rows["id"]]})

    return spark.range(0, n, 1, max(1, -(-n // rows_per_task))).mapInPandas(run, "row long, vec array<float>")


def save_npy(vectors: DataFrame, path: str, row: str = "row", vec: str = "vec") -> None:
    """A .npy file of rows 0 to n - 1, written in place as they arrive, one partition at a time."""
    import numpy as np

    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d"), F.max(row).alias("last")).first()
    if shape.n and shape.last != shape.n - 1:
        raise ValueError("rows aren't numbered from 0 without a gap")
    out = np.lib.format.open_memmap(path, "w+", np.float32, (shape.n, shape.d or 0))
    for r in vectors.select(row, vec).toLocalIterator():
        out[r[0]] = r[1]
    out.flush()
