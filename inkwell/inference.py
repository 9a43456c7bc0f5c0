"""The boundary for real models: adapters, their registry, and a transformer that runs one over a table."""

from __future__ import annotations

import base64
import importlib
import inspect
import json
import re
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ALL_COMPLETED, FIRST_COMPLETED, Future, wait

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import strings

COLUMNS = ["case_id", "model", "text", "latency", "status", "error", "device", "raw_response", "reasoning", "input_tokens", "output_tokens", "tokens_per_second", "timing"]
SCHEMA = "case_id long, model string, text string, latency double, status string, error string, device string, raw_response string, reasoning string, input_tokens long, output_tokens long, tokens_per_second double, timing string"
#: The timing of an answer that came after its case was given up.
LATE = "late_after_timeout"


class Adapter:
    """One model. ``perform`` gets a path, and a prompt if it takes one, and returns at least a text."""

    def perform(self, case: dict) -> dict:
        raise NotImplementedError

    def close(self) -> None:
        """Called after a partition, whatever happened."""


class Mock(Adapter):
    """Repeats what weak recognition does to the ground truth, from the case's number alone."""

    LOOK_ALIKES = str.maketrans(*strings.LOOK_ALIKES)

    def __init__(self, name: str, number: int, percent: int) -> None:
        self.name, self.number, self.percent = name, number, percent

    def perform(self, case: dict) -> dict:
        k, m = case["case_id"], self.number
        words = list(enumerate(case["ground_truth"].split()))
        left = [(i, w) for i, w in words if (k * 31 + i * 17 + m * 7) % 100 >= self.percent / 2]
        text = " ".join(w.translate(self.LOOK_ALIKES) if (k * 13 + i * 29 + m * 11) % 100 < self.percent else w for i, w in left)
        return {"text": text, "latency": 0.3 + (k * 37 + m * 11) % 900 / 1000, "device": "cpu"}


class Http(Adapter):
    """A model behind a chat interface: messages with an image's content go out, a message with token counts comes back.

    ``timeout`` is the connection's; a deadline on the case is ``infer``'s.
    """

    def __init__(self, name: str, host: str, timeout: float = 600.0) -> None:
        self.name, self.host, self.timeout = name, host.rstrip("/"), timeout

    def perform(self, case: dict) -> dict:
        messages = [{"role": "system", "content": case["system"]}] if case.get("system") else []
        messages.append({"role": "user", "content": case.get("prompt") or "Transcribe this image.", "images": [base64.b64encode(image_of(case)).decode()]})
        body = json.dumps({"model": self.name, "messages": messages, "stream": False, "options": {"temperature": 0.0}}).encode()
        began = time.monotonic()
        request = urllib.request.Request(f"{self.host}/api/chat", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            raw = answer.read().decode()
        found = json.loads(raw)
        message, out, spent = found.get("message") or {}, found.get("eval_count"), found.get("eval_duration")
        return {
            "text": unfenced((message.get("content") or "").strip()),
            "raw_response": raw,
            "reasoning": message.get("thinking") or message.get("reasoning"),
            "latency": time.monotonic() - began,
            "device": "remote",
            "input_tokens": found.get("prompt_eval_count"),
            "output_tokens": out,
            "tokens_per_second": out / (spent / 1e9) if out is not None and spent else None,
        }


def image_of(case: dict) -> bytes:
    """The image's bytes: the case's ``content`` if it has one (Spark's binaryFile reads any store), else the file at its path."""
    if case.get("content") is not None:
        return bytes(case["content"])
    store, path = fs.FileSystem.from_uri(case["image_path"])
    with store.open_input_stream(path) as f:
        return f.read()


def unfenced(text: str) -> str:
    """Without a fence that is bare or says markdown, html or text."""
    found = re.fullmatch(r"(?is)```[ \t]*(?:markdown|html|text)?[ \t]*\n(.*?)\n?```", text)
    return found[1].strip() if found else text


class Local(Adapter):
    """A model of an optional package that reads an image's path: ``read`` comes from module:function, imported where it runs."""

    def __init__(self, name: str) -> None:
        module, _, function = name.partition(":")
        self.read = getattr(importlib.import_module(module), function or "read")

    def perform(self, case: dict) -> dict:
        began = time.monotonic()
        text = self.read(case["image_path"])
        return {"text": text if isinstance(text, str) else "\n".join(map(str, text)), "latency": time.monotonic() - began, "device": "cpu"}


class Registry:
    """Adapters by provider; a specification is provider:name."""

    def __init__(self) -> None:
        self.factories: dict[str, Callable[[str], Adapter]] = {}

    def register(self, provider: str, factory: Callable[[str], Adapter]) -> None:
        if ":" in provider or not provider:
            raise ValueError("a provider's name has no colon")
        if provider in self.factories:
            raise ValueError(f"{provider} is there already")
        self.factories[provider] = factory

    def factory(self, spec: str) -> Callable[[], Adapter]:
        provider, _, name = spec.partition(":")
        if provider not in self.factories:
            raise KeyError(f"unknown provider {provider}; known: {', '.join(sorted(self.factories))}")
        make = self.factories[provider]
        return lambda: make(name)


def call(adapter: Adapter, case: dict) -> dict:
    """The adapter's answer, with only the arguments it takes."""
    names = inspect.signature(adapter.perform).parameters
    return adapter.perform(case) if len(names) == 1 else adapter.perform(**{n: case.get(n) for n in names})


def row_of(case: dict, spec: str, **known: object) -> dict:
    return dict.fromkeys(COLUMNS) | {"case_id": case["case_id"], "model": spec, "latency": 0.0, "status": "failed", "timing": "on_time"} | known


def answered(adapter: Adapter, case: dict, spec: str) -> dict:
    """The row of a call that has come back, whether with an answer or an error."""
    began = time.monotonic()
    try:
        return row_of(case, spec, status="success") | {k: v for k, v in call(adapter, case).items() if k in COLUMNS}
    except Exception as e:
        return row_of(case, spec, error=f"{type(e).__name__}: {e}", latency=time.monotonic() - began)


class Calls:
    """Calls of one adapter under a deadline.

    Each call has a thread. One that is overdue has its case answered with a timeout, and goes on
    behind the next calls; at most ``most_overdue`` do so at once: beyond, cases wait for
    one of these to end, a deadline at most, and fail without a call. Threads are daemons, so a
    call that never ends holds no process.
    """

    def __init__(self, adapter: Adapter, spec: str, timeout: float | None, at_once: int, most_overdue: int) -> None:
        self.adapter, self.spec, self.timeout, self.at_once, self.most_overdue = adapter, spec, timeout, at_once, most_overdue
        self.overdue: set[Future] = set()

    def start(self, case: dict) -> Future:
        found: Future = Future()
        threading.Thread(target=lambda: found.set_result(answered(self.adapter, case, self.spec)), daemon=True).start()
        return found

    def late(self) -> Iterator[dict]:
        """Answers that have come after their deadline."""
        done = {f for f in self.overdue if f.done()}
        self.overdue -= done
        for f in done:
            yield f.result() | {"timing": LATE}

    def rows(self, cases: list[dict]) -> Iterator[dict]:
        """A row for each case, in their order, and late answers as they come."""
        if self.timeout is None and self.at_once == 1:
            yield from (answered(self.adapter, case, self.spec) for case in cases)
            return
        for i in range(0, len(cases), self.at_once):
            group = cases[i : i + self.at_once]
            if len(self.overdue) >= self.most_overdue:
                wait(self.overdue, self.timeout, FIRST_COMPLETED)
            yield from self.late()
            room = max(0, self.most_overdue - len(self.overdue))
            began, calls = time.monotonic(), [self.start(case) for case in group[:room]]
            for case, f in zip(group, calls, strict=False):
                wait([f], None if self.timeout is None else max(0.0, self.timeout - (time.monotonic() - began)))
                row = f.result() if f.done() else None
                # an adapter's own measure counts too: a reported latency beyond the deadline makes a late answer
                if row and (self.timeout is None or row["latency"] <= self.timeout):
                    yield row
                    continue
                yield row_of(case, self.spec, status="timeout", latency=row["latency"] if row else self.timeout, timing="timeout", error=f"no answer within {self.timeout:g} seconds")
                self.overdue.add(f)
            yield from (row_of(case, self.spec, error=f"not called: {self.most_overdue} calls are overdue") for case in group[room:])

    def rest(self, linger: float) -> Iterator[dict]:
        """Late answers that come within so many seconds; the other calls are given up."""
        wait(self.overdue, linger, ALL_COMPLETED)
        yield from self.late()


def infer(cases: DataFrame, spec: str, registry: Registry, timeout: float | None = None, at_once: int = 1, linger: float = 60.0, most_overdue: int = 32, rows_at_once: int = 64) -> DataFrame:
    """A row for each case, and one more for each answer that comes after the deadline.

    A partition makes one adapter; an error is a failed row. With a timeout a case that isn't answered
    in time has its timeout row at once, whatever the call does. Its answer, if it comes while
    the partition runs or within ``linger`` seconds after, is a row with the timing
    late_after_timeout: it belongs to the trace and changes no score (``scored``, ``run``).
    ``at_once`` calls run side by side; an adapter must bear that, and its overdue calls going on.
    """
    factory = registry.factory(spec)
    timeout = None if timeout is not None and timeout <= 0 else timeout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=COLUMNS).astype({"input_tokens": "Int64", "output_tokens": "Int64", "tokens_per_second": "float64"})

        adapter, reason = None, None
        try:
            adapter = factory()
        except Exception as e:  # a model that can't be loaded still gives its rows
            reason = f"{type(e).__name__}: {e}"
        calls = Calls(adapter, spec, timeout, at_once, most_overdue)
        try:
            for batch in batches:
                for i in range(0, len(batch), rows_at_once):
                    group = batch.iloc[i : i + rows_at_once].to_dict("records")
                    yield frame(list(calls.rows(group)) if adapter else [row_of(case, spec, error=reason) for case in group])
            if adapter:
                yield frame(list(calls.rest(linger)))
        finally:
            if adapter:
                adapter.close()

    return cases.mapInPandas(run, SCHEMA)


def scored(rows: DataFrame) -> DataFrame:
    """What counts: one row for each case."""
    return rows.where(F.col("timing") != LATE)


def run(cases: DataFrame, spec: str, registry: Registry, path: str, **options: object) -> tuple[DataFrame, DataFrame]:
    """Call the model once, write every row under ``path``, and return what counts and the trace of all answers."""
    infer(cases, spec, registry, **options).write.parquet(path)
    rows = cases.sparkSession.read.schema(SCHEMA).parquet(path)
    return scored(rows), rows


def mock_registry() -> Registry:
    """The mock provider: the name is number/percent."""
    registry = Registry()
    registry.register("mock", lambda name: Mock(name, *map(int, name.split("/"))))
    return registry


def default_registry(host: str = "http://localhost:11434", timeout: float = 600.0) -> Registry:
    """The mock, models of a chat server, and readers of optional packages."""
    registry = mock_registry()
    registry.register("http", lambda name: Http(name, host, timeout))
    registry.register("local", Local)
    return registry
