"""Calls of outside models: injected functions, retried, several at a time, one set-up per task."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import queue
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[str], str]
#: A model that is asked several prompts at once and gives as many replies, in their order.
BatchModel = Callable[[list[str]], list[str]]


class Transient(Exception):
    """A failure that may pass: too many requests, or an error of the server. ``retry_after`` are the seconds that the server asks to wait."""

    def __init__(self, message: str = "", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class TimedOut(Exception):
    """A call that took longer than it may."""


class Pace:
    """Begins calls no faster than ``rate`` a second (None: as they come), and none before a wait that a server asked for is over. One per task."""

    def __init__(self, rate: float | None = None, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.next, self.lock, self.sleep = 1.0 / rate if rate else 0.0, 0.0, threading.Lock(), sleep

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            begins = max(now, self.next)
            self.next = begins + self.gap
        if begins > now:
            self.sleep(begins - now)

    def hold(self, seconds: float) -> None:
        with self.lock:
            self.next = max(self.next, time.monotonic() + seconds)


class Callers:
    """Threads that call a function for one item each, ``in_flight`` at a time.

    A call that takes longer than ``seconds`` is given up with TimedOut and its thread replaced, so
    a hung call holds nothing up. Threads can't be ended from outside; once ``spare`` of them hang,
    no more are started and what is left is given up too.
    """

    def __init__(self, call: Callable, in_flight: int, seconds: float | None = None, spare: int = 64):
        self.call, self.in_flight, self.seconds, self.spare, self.lost = call, max(1, in_flight), seconds, spare, 0

    def _worker(self, asked: queue.SimpleQueue, told: queue.SimpleQueue) -> None:
        while (item := asked.get()) is not None:
            number, value = item
            try:
                told.put((number, self.call(value), None))
            except Exception as failure:  # a reply's failure is data, not the job's end
                told.put((number, None, failure))

    def _start(self, told: queue.SimpleQueue) -> queue.SimpleQueue:
        asked: queue.SimpleQueue = queue.SimpleQueue()
        threading.Thread(target=self._worker, args=(asked, told), daemon=True).start()
        return asked

    def run(self, items: list) -> list[tuple]:
        """(reply, failure) of each item, in their order."""
        results: list = [None] * len(items)
        told: queue.SimpleQueue = queue.SimpleQueue()
        idle = [self._start(told) for _ in range(min(self.in_flight, len(items)))]
        busy: dict[int, tuple[queue.SimpleQueue, float]] = {}
        at, left = 0, len(items)
        while left:
            while idle and at < len(items):
                worker = idle.pop()
                busy[at] = worker, time.monotonic()
                worker.put((at, items[at]))
                at += 1
            if not busy:  # every thread hangs
                for k in range(at, len(items)):
                    results[k] = None, TimedOut("too many calls hang")
                break
            ends = None if self.seconds is None else max(0.0, min(began for _, began in busy.values()) + self.seconds - time.monotonic())
            try:
                number, reply, failure = told.get(timeout=ends)
            except queue.Empty:
                late = [k for k, (_, began) in busy.items() if time.monotonic() - began >= self.seconds]
                for k in late:
                    worker, _ = busy.pop(k)
                    worker.put(None)  # should it ever come back, it ends
                    results[k], left, self.lost = (None, TimedOut(f"no reply within {self.seconds} s")), left - 1, self.lost + 1
                    if self.lost < self.spare:
                        idle.append(self._start(told))
                continue
            if number in busy:
                worker, _ = busy.pop(number)
                idle.append(worker)
                results[number], left = (reply, failure), left - 1
        for worker in idle:
            worker.put(None)
        return results


def with_time_limit(model: Model, seconds: float) -> Model:
    """``model``, given up with TimedOut after so many seconds, retries included; a call that hangs doesn't hold the task up."""
    callers = Callers(model, 1, seconds)

    def call(prompt: str) -> str:
        ((reply, failure),) = callers.run([prompt])
        if failure is not None:
            raise failure
        return reply

    return call


def stub_model(prompt: str) -> str:
    """A model for tests: its reply depends on the prompt alone."""
    number = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
    return json.dumps({"correctness": {"score": number % 2, "explanation": ""}, "completeness": {"score": number // 2 % 2, "explanation": ""}, "verdict": f"[[{'ABC'[number % 3]}]]"})


def with_retries(model: Model, attempts: int = 3, delay: float = 1.0, factor: float = 2.0, longest: float = 60.0, limit: float | None = None, sleep: Callable[[float], None] = time.sleep, pace: Pace | None = None) -> Model:
    """``model`` tried up to ``attempts`` times on Transient failures, waiting delay, delay * factor, ... at most ``longest``.

    factor 1 waits evenly. A failure that says when to retry is waited for so long at least, and
    ``pace`` then holds the task's other calls back too. After ``limit`` seconds in all it is not
    tried again. Other failures are not retried.
    """

    def call(prompt: str) -> str:
        wait, began = delay, time.monotonic()
        for attempt in range(1, attempts + 1):
            if pace:
                pace.wait()
            try:
                return model(prompt)
            except Transient as failure:
                due = max(wait, failure.retry_after or 0.0)
                if attempt == attempts or (limit is not None and time.monotonic() - began + due > limit):
                    raise
                if pace and failure.retry_after:
                    pace.hold(failure.retry_after)
                sleep(due)
                wait = min(wait * factor, longest)
        raise AssertionError("unreachable")

    return call


#: Prompts that a task holds with their replies before it hands them on.
PORTION = 1024


def generate(prompts: DataFrame, key: str, make_model: Callable[[], Model], prompt: str = "prompt", in_flight: int = 1, seconds: float | None = None, rate: float | None = None, tasks: int | None = None, attempts: int = 1, delay: float = 1.0) -> DataFrame:
    """(key, response, error): each prompt's reply, or what went wrong; the id stays with its prompt.

    ``make_model`` runs once per task, so a heavy model or client is set up once there. A task has
    ``in_flight`` calls under way at a time; each has ``seconds``, its retries (``attempts``,
    ``delay``) included. ``rate`` is what the job as a whole may begin in a second; each of its
    ``tasks`` (as many as run at once, by default) gets an even part of it.
    """
    kind = prompts.schema[key].dataType.simpleString()
    share = rate / (tasks or prompts.sparkSession.sparkContext.defaultParallelism) if rate else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        callers = None
        for part in parts:
            if callers is None:
                pace = Pace(share)
                callers = Callers(with_retries(make_model(), attempts, delay, pace=pace), in_flight, seconds)
            for at in range(0, len(part), PORTION):
                piece = part.iloc[at : at + PORTION]
                results = callers.run(list(piece[prompt]))
                yield pd.DataFrame({key: piece[key], "response": [r for r, _ in results], "error": [None if f is None else str(f)[:500] or type(f).__name__ for _, f in results]})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, response string, error string")


def _asked_together(model: BatchModel, texts: list[str]) -> list[tuple[str | None, Exception | None]]:
    """Replies to a batch; one that fails is asked again in halves, until what fails stands alone."""
    try:
        replies = model(texts)
        if len(replies) != len(texts):
            raise ValueError(f"{len(replies)} replies to {len(texts)} prompts")
        return [(r, None) for r in replies]
    except Exception as failure:
        if len(texts) == 1:
            return [(None, failure)]
        half = len(texts) // 2
        return _asked_together(model, texts[:half]) + _asked_together(model, texts[half:])


def generate_batches(prompts: DataFrame, key: str, make_model: Callable[[], BatchModel], size: int, prompt: str = "prompt", in_flight: int = 1, seconds: float | None = None) -> DataFrame:
    """As ``generate``, of a model that takes ``size`` prompts at once; ``seconds`` are those of a batch.

    Prompts of like length are asked together within a portion, so a padded batch wastes little.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        callers = None
        for part in parts:
            if callers is None:
                model = make_model()
                callers = Callers(lambda texts: _asked_together(model, texts), in_flight, seconds)
            for at in range(0, len(part), PORTION):
                piece = part.iloc[at : at + PORTION]
                texts = list(piece[prompt])
                order = sorted(range(len(texts)), key=lambda k: len(texts[k] or ""))
                batches = [order[i : i + size] for i in range(0, len(order), size)]
                results: list = [None] * len(texts)
                for batch, (replies, failure) in zip(batches, callers.run([[texts[k] for k in b] for b in batches])):
                    for k, told in zip(batch, replies if failure is None else [(None, failure)] * len(batch)):
                        results[k] = told
                yield pd.DataFrame({key: piece[key], "response": [r for r, _ in results], "error": [None if f is None else str(f)[:500] or type(f).__name__ for _, f in results]})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, response string, error string")


class Registry:
    """Model makers by name."""

    def __init__(self):
        self.makers: dict[str, Callable[[], Model]] = {"stub": lambda: stub_model}

    def register(self, name: str, maker: Callable[[], Model]) -> None:
        self.makers[name] = maker

    def get(self, name: str) -> Callable[[], Model]:
        if name not in self.makers:
            raise ValueError(f"no model named {name!r}; known are {', '.join(sorted(self.makers))}")
        return self.makers[name]


def load_plugin(spec: str) -> Callable:
    """The function that 'path/to/file.py:name' names."""
    path, colon, name = spec.rpartition(":")
    if not colon or not path.endswith(".py"):
        raise ValueError(f"a plug-in is written file.py:function, not {spec!r}")
    found = importlib.util.spec_from_file_location("chronoloom_plugin", path)
    module = importlib.util.module_from_spec(found)
    found.loader.exec_module(module)
    if not hasattr(module, name):
        raise ValueError(f"{path} has no function {name!r}")
    return getattr(module, name)
