from callscope.operators import chain
from tests.helpers import call, frame


def loop(first, steps, at, app="app", system="Do the task."):
    messages, out = [("system", system), ("user", f"task {first}")], []
    for s in range(steps):
        out.append(call(first + s, list(messages), app=app, seconds=at + 10 * s))
        messages += [("assistant", f"step {first}.{s}", ["go"]), ("tool", f"result {first}.{s}")]
    return out


def report(spark, rows):
    found, runs, walked = chain.reconstruct(frame(spark, rows))
    return {r.app_id: r for r in found.collect()}, runs, walked


def test_two_runs(spark):
    found, runs, walked = report(spark, loop(0, 3, 0) + loop(100, 4, 500))
    assert found["app"].verdict == "reliable" and found["app"].max_steps == 4 and found["app"].mean_steps == 3.5
    assert {r.run_id: r.requests for r in runs.collect()}["r0100"] == [f"r{100 + k:04}" for k in range(4)]
    assert walked.count() == 7 and chain.top_paths(runs).first().runs == 1


def test_single_steps_retries_and_compaction(spark):
    single = [call(k, [("system", "s"), ("user", f"u{k}")], app="single", seconds=60 * k) for k in range(10)]
    retry = [call(300 + k, [("system", "s"), ("user", "same")], app="retry", seconds=2 * k) for k in range(2)]
    compact = [call(400 + k, [("system", "s"), ("user", f"summary {k}"), ("assistant", f"a{k}"), ("user", f"next {k}")], app="compact", seconds=10 * k) for k in range(10)]
    found, runs, _ = report(spark, single + retry + compact)
    assert found["single"].verdict == "single_step" and found["single"].runs == 10
    assert found["retry"].runs == 1 and found["retry"].retries == 1
    assert found["compact"].verdict == "unusable" and found["compact"].orphans >= 8


def test_relaxed_keys_where_the_system_message_changes(spark):
    rows = []
    messages = [("user", "task")]
    for s in range(4):
        rows.append(call(s, [("system", f"now is {s}"), *messages], seconds=10 * s))
        messages += [("assistant", f"a{s}"), ("tool", f"t{s}")]
    found, _, _ = report(spark, rows)
    assert found["app"].runs == 1 and found["app"].max_steps == 4


def test_long_gap_is_no_link(spark):
    rows = loop(0, 2, 0)
    late = call(50, [("system", "Do the task."), ("user", "task 0"), ("assistant", "step 0.0", ["go"]), ("tool", "result 0.0")], seconds=5000)
    found, _, _ = report(spark, rows[:1] + [late])
    assert found["app"].linked == 0
