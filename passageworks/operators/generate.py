"""Generators: an extractive stand-in, and a client for a model server with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds between tries, how long to wait for the server to answer at all, and the settings of a request.
WAITS = (5, 15, 30, 60, 120)
SERVER_WAIT = 30
URL, MODEL, TEMPERATURE, NUM_PREDICT, KEEP_ALIVE = "http://localhost:11434/api/chat", "llama3.2", 0.0, 512, "60m"


def extract_answer(texts: Column | str) -> Column:
    """The first sentence of the first text; empty if there is none."""
    first = F.coalesce(F.try_element_at(F.col(texts) if isinstance(texts, str) else texts, F.lit(1)), F.lit(""))
    return F.regexp_extract(first, r"(?s)^(.*?[.!?])(\s|\z)|^(.*)\z", 0)


def _answers(url: str) -> bool:
    """Whether anything answers at the host of ``url``."""
    parts = urllib.parse.urlsplit(url)
    try:
        with urllib.request.urlopen(f"{parts.scheme}://{parts.netloc}/", timeout=1):
            return True
    except urllib.error.HTTPError:
        return True
    except OSError:
        return False


@dataclass
class ModelServer:
    """A streaming chat server; ``send`` may be replaced in tests."""

    url: str = URL
    model: str = MODEL
    temperature: float = TEMPERATURE
    num_predict: int = NUM_PREDICT
    keep_alive: str = KEEP_ALIVE
    tries: int = 5
    send: Callable[[str, dict], Iterator[dict]] | None = None
    sleep: Callable[[float], None] = time.sleep

    def _stream(self, body: dict) -> Iterator[dict]:
        if self.send:
            return self.send(self.url, body)
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        return map(json.loads, urllib.request.urlopen(request, timeout=600))

    def wait(self, ping: Callable[[str], bool] | None = None) -> bool:
        """Asks once a second whether the server answers, for ``SERVER_WAIT`` seconds."""
        ask = ping or _answers
        for _ in range(SERVER_WAIT):
            if ask(self.url):
                return True
            self.sleep(1)
        return False

    def generate(self, prompt: str) -> dict:
        """answer, prompt_tokens, completion_tokens, tokens_per_sec and ttft_ms; fails after the last try."""
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": True, "keep_alive": self.keep_alive, "options": {"temperature": self.temperature, "num_predict": self.num_predict}}
        for attempt in range(self.tries):
            try:
                began, first, parts, last = time.time(), None, [], {}
                for last in self._stream(body):
                    token = last.get("message", {}).get("content", "")
                    if token and first is None:
                        first = (time.time() - began) * 1000
                    parts.append(token)
                n, ns = last.get("eval_count"), last.get("eval_duration")
                return {"answer": "".join(parts), "prompt_tokens": last.get("prompt_eval_count"), "completion_tokens": n, "tokens_per_sec": n / (ns / 1e9) if n and ns and ns > 0 else None, "ttft_ms": first}
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                self.sleep(WAITS[min(attempt, len(WAITS) - 1)])
        raise AssertionError("unreachable")


def generate(prompts: DataFrame, server: ModelServer, key: str, prompt: str = "prompt") -> DataFrame:
    """``key``, the answer and its token figures for every prompt, streamed through the server by partition."""
    figures = "answer string, prompt_tokens long, completion_tokens long, tokens_per_sec double, ttft_ms double"
    names = ["answer", "prompt_tokens", "completion_tokens", "tokens_per_sec", "ttft_ms"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [server.generate(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[n] for o in out], kind) for n, kind in zip(names, kinds)]], [key, *names])

    return prompts.select(key, F.col(prompt)).mapInArrow(run, f"`{key}` {prompts.schema[key].dataType.simpleString()}, {figures}")
