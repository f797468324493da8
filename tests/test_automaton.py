"""State machines that walk chunks from every state, against walking the whole file."""
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from opslens.operators.automaton import Inherited, Machine, Walk, finals, run
from opslens.sources import captures, csv_tail

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test


class Toy(Machine):
    """Letters set a word, digits move the state; ``!`` lines are emitted in even states."""
    states = 3
    texts = ("word",)
    counts = ("seen",)
    reads = ("value",)

    def step(self, state, memory, value):
        memory[1] += value == "!"
        if value.isdigit():
            return (state + int(value)) % 3, False
        if value == "-":
            memory[0] = None
        elif value == "0x":
            return 0, False
        elif value != "!":
            memory[0] = value
        return state, value == "!" and state != 1


def by_hand(machine, values):
    state, memory, out = 0, [None] * len(machine.texts) + [0] * len(machine.counts), []
    for at, value in enumerate(values):
        before = state
        state, emit = machine.step(state, memory, value)
        if emit:
            out.append((at, value, before, *memory))
    return out, (state, *memory)


@pytest.mark.parametrize("chunk", [1, 3, 10, 1000])
def test_walk_equals_walking_the_whole_file(lines, chunk):
    rng = random.Random(chunk)
    files = {f"f{k}": [rng.choice(["1", "2", "0x", "a", "b", "-", "!", "!", "!"]) for _ in range(rng.randint(1, 120))] for k in range(5)}
    table, machine = lines(files, chunk=chunk), Toy()
    got = run(table, machine, ["value"], totals=True).collect()
    for name, values in files.items():
        expected, end = by_hand(machine, values)
        rows = sorted(r for r in got if r["file"] == name)
        rows = sorted((r["pos"], r["value"], r["state"], r["word"], r["seen"]) for r in rows)
        assert rows == [(at, value, state, word, seen) for at, value, state, word, seen in expected]
        assert {(r["final_state"], r["total_seen"]) for r in got if r["file"] == name} <= {(end[0], end[2])}
    last = {r["file"]: (r["state"], r["word"], r["seen"]) for r in finals(table, machine).collect()}
    assert last == {name: by_hand(machine, values)[1] for name, values in files.items()}


def test_walks_that_meet_go_on_as_one():
    walk = Walk(Toy())
    assert len(walk.paths) == 3
    walk.line(0, ("0x",))
    assert [(mask, state) for mask, state, _ in walk.paths] == [(7, 0)] and walk.paths[0][2] == [Inherited, 0]


def test_lines_are_shuffled_and_sorted_once(lines):
    plan = run(lines({"f": ["a", "!"]}), Toy(), ["value"])._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Window" not in plan


CSV = {"plain": "h1,h2\n1,a\n2,b\n3,c\n", "quoted": 'h1,"h\n2"\n1,"two\n\nlines"\n2,"x ""y"", z"\n3,"tail\n"\n', "short": "h\n1\n", "blank": "\n\nh\n\n1\n2\n\n",
       "open": 'h\n1\n2,"never closed\n3\n4\n'}
TAILS = {"plain": ("h1,h2", "2,b", False), "quoted": ('h1,"h\n2"', '2,"x ""y"", z"', False), "short": ("h", None, False), "blank": ("h", "1", False), "open": ("h", None, True)}


@pytest.mark.parametrize("chunk", [1, 2, 5, 100])
def test_csv_tail_with_quotes(lines, chunk):
    found = csv_tail.csv_tail_summary(lines({name: text.split("\n") for name, text in CSV.items()}, chunk=chunk))
    assert {r["file"]: (r["header"], r["last_row"], r["unbalanced"]) for r in found.collect()} == TAILS


def test_csv_fields(spark):
    df = spark.createDataFrame([('1,"a, b","say ""hi""",,x',), ('"",",",y',), ("",)], "v STRING")
    assert [r[0] for r in df.select(csv_tail.csv_fields(F.col("v"))).collect()] == [["1", "a, b", 'say "hi"', "", "x"], ["", ",", "y"], [""]]


@pytest.mark.parametrize("chunk", [1, 2, 50])
def test_ycsb_and_simulation_logs_by_walking(lines, chunk):
    command, result, mark = captures.YCSB_COMMAND, captures.YCSB_RESULT, captures.SIM_MARK
    logs = {"a": [f"{command} one", f"{command} two", f"{result}, 5.5", f"{command} three", f"{result}, 7"], "b": ["noise", f"{command} only"], "c": ["nothing"]}
    got = {r["file"]: (r["throughput"], r["command_line"]) for r in captures.ycsb_summary(lines(logs, chunk=chunk)).collect()}
    assert got["b"] == (None, f"{command} only") and got["c"] == (None, None) and got["a"][1] == f"{command} two"
    sims = {"a": ["x", mark, "first", "y", mark, "second", "z"], "b": ["x"], "c": [mark, "r", mark], "d": [mark, mark, "r"]}
    assert {r["file"]: r["report"] for r in captures.sim_reports(lines(sims, chunk=chunk)).collect()} == {"a": "second", "b": None, "c": None, "d": "r"}
