import threading
import time

import pytest

from chronoloom.operators import calls


def test_several_calls_are_in_flight_and_keep_their_order():
    most, now, lock = [0], [0], threading.Lock()

    def model(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return x * 2

    began = time.monotonic()
    assert calls.Callers(model, 8).run(list(range(64))) == [(2 * k, None) for k in range(64)]
    assert most[0] == 8 and time.monotonic() - began < 64 * 0.05 / 4
    assert calls.Callers(model, 8).run([]) == []


def test_a_hung_call_holds_nothing_up():
    def model(x):
        if x % 10 == 0:
            time.sleep(3)
        return x

    began = time.monotonic()
    found = calls.Callers(model, 4, seconds=0.2).run(list(range(40)))
    assert time.monotonic() - began < 2
    assert [k for k, (_, failure) in enumerate(found) if failure] == [0, 10, 20, 30] and all(isinstance(found[k][1], calls.TimedOut) for k in (0, 10))
    assert found[7] == (7, None)
    before = threading.active_count()
    found = calls.Callers(lambda x: time.sleep(3), 2, seconds=0.05, spare=3).run(list(range(20)))
    assert all(isinstance(f, calls.TimedOut) for _, f in found) and threading.active_count() - before <= 5


def test_pace_spaces_calls_and_heeds_retry_after():
    slept = []
    pace = calls.Pace(10.0, slept.append)
    for _ in range(3):
        pace.wait()
    assert len(slept) == 2 and 0.08 < slept[0] < 0.11 and 0.18 < slept[1] < 0.21
    waits, left = [], [1]

    def model(x):
        if left:
            left.pop()
            raise calls.Transient("busy", retry_after=7.0)
        return x

    pace = calls.Pace(None, waits.append)
    assert calls.with_retries(model, 3, 1.0, sleep=waits.append, pace=pace)("a") == "a"
    assert waits[0] == 7.0 and 6.5 < waits[1] <= 7.0
    assert calls.with_retries(lambda x: x, pace=calls.Pace(None))("b") == "b"


def test_generate_concurrently(spark):
    prompts = spark.createDataFrame([(i, None if i == 5 else f"p{i}") for i in range(40)], "k int, prompt string").coalesce(1)

    def maker():
        def model(text):
            time.sleep(0.05)
            if text == "p7":
                raise ValueError("no")
            return text.upper()

        return model

    got = {r.k: r for r in calls.generate(prompts, "k", maker, in_flight=8, seconds=5).collect()}
    assert got[3].response == "P3" and got[7].error == "no" and got[5].response is None and len(got) == 40
    assert calls.generate(prompts.limit(0), "k", maker, in_flight=8).count() == 0


def test_batches_are_asked_together_and_failures_stand_alone(spark):
    prompts = spark.createDataFrame([(i, "x" * (i % 9) + f"p{i}") for i in range(50)], "k int, prompt string").coalesce(1)

    def maker():
        def model(texts):
            assert len(texts) <= 8
            if any(t.endswith("p13") for t in texts):
                raise ValueError("thirteen")
            return [f"{t}/{len(texts)}" for t in texts]

        return model

    got = {r.k: r for r in calls.generate_batches(prompts, "k", maker, 8).collect()}
    assert got[13].error == "thirteen" and sum(r.error is not None for r in got.values()) == 1
    assert all(r.response.startswith("x" * (k % 9) + f"p{k}/") for k, r in got.items() if k != 13)
    assert sum(r.response.endswith("/8") for r in got.values() if r.response) >= 40
    short = calls.generate_batches(prompts, "k", lambda: lambda texts: texts[:-1], 4)
    assert short.where("error IS NULL").count() == 0


def test_a_model_fails_with_its_own_words():
    with pytest.raises(KeyError):
        calls.with_time_limit(lambda p: {}[p], 1)("x")
