import random

import pytest

from landspan.operators import journal, script_events
from landspan.operators.scans import nearest
from landspan.workspace import materialize

EVENTS = "script_id string, stmt long, action string, schema string, name string, type string, temp boolean"


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_nearest_equals_brute_force_with_a_hot_key(spark, ahead, width):
    rng = random.Random(width)
    rows = [("hot", i, rng.choice([None, None, f"v{i}"])) for i in rng.sample(range(400), 120)]
    rows += [(f"k{i % 9}", i, rng.choice([None, f"w{i}"])) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, pos long, val string")
    got = {(r["key"], r["pos"]): r["out"]
           for r in nearest(df, "key", "pos", "val", "out", ahead, width).collect()}
    assert len(got) == len(rows)
    for key, pos, _ in rows:
        near = [(p, x) for k, p, x in rows if k == key and x and (p > pos if ahead else p < pos)]
        want = (min(near) if ahead else max(near))[1] if near else None
        assert got[(key, pos)] == want


class Script:
    """Plain state machine over one script's events, to compare with."""

    def __init__(self):
        self.new, self.gone, self.need, self.temp = set(), set(), set(), set()
        self.tx, self.tx_new, self.tx_gone, self.broken = False, set(), set(), False

    def apply(self, action, obj, temp):
        seen = obj in self.new or obj in self.tx_new
        if action == "begin":
            self.broken |= self.tx
            self.tx = True
        elif action in ("commit", "rollback"):
            self.broken |= not self.tx
            if action == "commit":
                self.new |= self.tx_new
                self.gone |= self.tx_gone
            self.tx, self.tx_new, self.tx_gone = False, set(), set()
        elif action == "create":
            (self.temp if temp else self.tx_new if self.tx else self.new).add(obj)
        elif action == "drop":
            if self.tx and obj in self.tx_new:
                self.tx_gone.add(obj)
            if not self.tx and obj in self.new:
                self.gone.add(obj)
        elif action in ("alter", "update"):
            self.broken |= not seen
        elif action in ("reference", "analyze") or not seen:
            self.need.add(obj)


def test_random_scripts_equal_a_state_machine(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for s in range(150):
        script, tx = Script(), False
        for stmt in range(rng.randrange(2, 25)):
            action = rng.choice(["begin", "commit", "rollback", "create", "create", "drop", "insert",
                                 "reference", "analyze"] + (["alter", "update"] if s % 3 == 0 else []))
            if s % 5:  # mostly balanced transactions
                if action in ("begin", "commit", "rollback"):
                    action = rng.choice(["commit", "rollback"]) if tx else "begin"
                    tx = not tx
            name, temp = rng.choice("abc"), action == "create" and rng.random() < 0.2
            control = action in script_events.CONTROL
            obj = None if control else ("s", name, "relation")
            rows.append((f"s{s}", stmt, action, *(obj or (None, None, None)), temp))
            script.apply(action, obj, temp)
        if tx and s % 5:
            rows.append((f"s{s}", 99, "commit", None, None, None, False))
            script.apply("commit", None, False)
        script.broken |= script.tx
        want[f"s{s}"] = script
    spans = materialize(script_events.transactions(spark.createDataFrame(rows, EVENTS)), "spans")
    broken = {r["script_id"] for r in script_events.violations(spans).collect()}
    assert broken == {s for s, m in want.items() if m.broken}
    found = script_events.report(spans, [script_events.violations(spans)]).collect()
    for name, machine in want.items():
        mine = {(r["role"], r["schema"], r["name"], r["type"]) for r in found if r["script_id"] == name}
        if machine.broken:
            assert not mine
            continue
        assert mine == {("created", *o) for o in machine.new - machine.gone} | {
            ("dependency", *o) for o in machine.need - machine.temp - machine.new}


def test_log_levels(spark):
    head = "Traceback (most recent call last):"
    lines = {
        "plain": (["start", "a WARNING", "an Error here", "end"], ["info", "warning", "error", "info"]),
        "sticky": (["start", head, "  File x", "warn"], ["info", "error", "error", "error"]),
        "error_head": ([f"error: {head}", "next"], ["error", "info"]),
        "warn_head": ([f"warn: {head}", "next"], ["warning", "info"]),
        "late_head": (["x", "error", head, "y"], ["info", "error", "error", "error"]),
    }
    rows = [(run, i, text) for run, (texts, _) in lines.items() for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "run_id string, line_no long, text string")
    got = journal.log_levels(df, "run_id", ["line_no"], "text").collect()
    for run, (_, want) in lines.items():
        mine = sorted((r["line_no"], r["level"]) for r in got if r["run_id"] == run)
        assert [level for _, level in mine] == want, run
