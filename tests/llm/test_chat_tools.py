import json
import random

import pytest

from cvframe.llm import chat_tools

TOOLS = {"add": {"a": ("integer", True), "b": ("number", False), "o": ("object", False)}, "ping": {}}
CALL = "conv_id long, turn long, idx int, call_id string, name string, arguments string, after array<string>, level int"
RESULT = "conv_id long, turn long, call_id string, content string, status string"


def kind(v):
    if isinstance(v, bool):
        return "boolean"
    if v is None:
        return "null"
    if isinstance(v, int) or isinstance(v, float) and v == int(v) and abs(v) < 1e9:
        return "integer"
    return {float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def brute(calls, results, tools):
    out, same = [], {}
    calls = list({(c[0], c[1], c[2]): c for c in sorted(calls, key=lambda c: json.dumps(c[3:], sort_keys=True), reverse=True)}.values())
    for c in calls:
        same.setdefault((c[0], c[3]), []).append(c)
    for conv, turn, idx, cid, name, args, after in calls:
        faults = ["no_id"] if cid is None else []
        try:
            value = json.loads(args)
        except (TypeError, ValueError):
            value = None
        want = tools.get(name)
        faults += ["unknown_tool"] if want is None else []
        faults += ["not_an_object"] if not isinstance(value, dict) else []
        if want is not None and isinstance(value, dict):
            faults += [f"missing:{f}" for f, (_, r) in sorted(want.items()) if r and f not in value]
            faults += [f"type:{f}" for f, (t, _) in sorted(want.items())
                       if f in value and kind(value[f]) != t and not (t == "number" and kind(value[f]) == "integer")]
            faults += [f"extra:{f}" for f in sorted(value) if f not in want]
        if cid is not None and len(same[conv, cid]) > 1:
            faults.append("repeated_id")
        own = [r for r in results if r[0] == conv and r[2] == cid and cid is not None]
        first = min(own, key=lambda r: (r[1], r[3])) if own else None
        more, deps = set(), []
        for ref in after or []:
            turns = [c[1] for c in same.get((conv, ref), [])] if ref is not None else []
            if not turns:
                more.add("unknown_reference")
            elif min(turns) > turn:
                more.add("later_reference")
            elif min(turns) == turn:
                deps.append(min(c[2] for c in same[conv, ref] if c[1] == turn))
        out.append([conv, turn, None, idx, cid, name, "linked" if own else "no_result", len(own), faults, more, deps,
                    {"arguments": value, "call_id": cid, "name": name, "result": first[3] if first else None}])
    at = {(r[0], r[1], r[3]): r for r in out}

    def level(key, seen):
        if key in seen:
            return -1
        row = at[key]
        if row[2] is None:
            below = [level((key[0], key[1], d), seen | {key}) for d in row[10]]
            got = -1 if -1 in below else 1 + max(below, default=-1)
            if got == -1 and seen:
                return -1
            row[2] = got
        return row[2]

    for key in at:
        level(key, frozenset())
        if at[key][2] == -1:
            at[key][9].add("cycle")
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], ",".join(r[8] + sorted(r[9])),
             json.dumps(r[11], sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for r in out]
    for conv, cid in {(r[0], r[2]) for r in results}:
        if cid is None or (conv, cid) not in same:
            own = [r for r in results if (r[0], r[2]) == (conv, cid)]
            first = min(own, key=lambda r: (r[1], r[3]))
            rows.append((conv, first[1], 0, None, cid, None, "orphan_result", len(own), "",
                         json.dumps({"arguments": None, "call_id": cid, "name": None, "result": first[3]}, separators=(",", ":"),
                                    ensure_ascii=False)))
    return sorted(rows, key=str)


def link(spark, calls, results):
    a = spark.createDataFrame([(*c, 0) for c in calls], CALL)
    b = spark.createDataFrame([(*r, "x") for r in results], RESULT)
    return sorted((tuple(r) for r in chat_tools.link(a, b, TOOLS).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    arguments = ['{"b": 2.5, "a": 1}', '{"a":"x"}', '{"a":7,"z":[1,{"y":null,"x":"é\\"q"}]}', "[1]", "{bad", "", None, '{"a":1,"o":{"k":true,"b":1}}', "{}"]
    calls, results = [], []
    for conv in range(6):
        for turn in range(0, 8, 2):
            n = rng.randrange(1, 7)
            for idx in range(n):
                refs = [rng.choice([f"c{turn}-{rng.randrange(n)}", f"c{turn - 2}-0", f"c{turn + 2}-0", "nothing"])
                        for _ in range(rng.choice([0, 0, 1, 1, 2]))]
                calls.append((conv, turn, idx, f"c{turn}-{idx}", rng.choice(["add", "add", "ping", "other", None]), rng.choice(arguments), refs))
                if rng.random() < 0.6:
                    results.append((conv, turn + 1, f"c{turn}-{idx}", f"out {rng.randrange(9)}"))
        results.append((conv, 1, "lost", "x"))
    calls += [(9, 0, 0, None, "ping", "{}", None), (9, 0, 1, "d", "ping", "{}", []), (9, 2, 0, "d", "ping", "{}", ["d"]), calls[0]]
    results += [(9, 1, "d", "second"), (9, 1, "d", "first"), (9, 3, None, "no id")]
    assert link(spark, calls, results) == brute(calls, results, TOOLS)


def test_chain_and_cycle(spark):
    n = 12
    calls = [(1, 0, i, f"k{i}", "ping", "{}", [f"k{i - 1}"] if i else []) for i in range(n)]
    calls += [(2, 0, i, f"k{i}", "ping", "{}", [f"k{(i + 1) % 3}"]) for i in range(3)] + [(2, 0, 3, "k3", "ping", "{}", ["k0"])]
    got = link(spark, calls, [])
    assert sorted(r[2] for r in got if r[0] == 1) == list(range(n))
    assert all(r[2] == -1 and r[8] == "cycle" for r in got if r[0] == 2)


def test_null_keys_and_empty_tables(spark):
    got = link(spark, [(None, None, 0, "a", "ping", "{}", [])], [(None, 1, "a", "r")])
    assert [(r[0], r[1], r[6]) for r in got] == [(None, None, "linked")]
    assert link(spark, [], []) == []
    assert [r[6] for r in link(spark, [], [(1, 1, "a", None)])] == ["orphan_result"]


def test_no_python_in_the_plan(spark, sf_small):
    calls, results = chat_tools.from_conversations(spark.read.parquet(f"{sf_small}/conversations.parquet"))
    plan = chat_tools.link(calls, results, chat_tools.TOOLS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.fixture(scope="module")
def derived(spark, sf_small):
    calls, results = chat_tools.from_conversations(spark.read.parquet(f"{sf_small}/conversations.parquet"))
    return calls.collect(), results.collect(), chat_tools.link(calls, results, chat_tools.TOOLS).collect()


def test_derived_calls(derived):
    calls, results, got = derived
    plain = [(c["conv_id"], c["turn"], c["idx"], c["call_id"], c["name"], c["arguments"], c["after"]) for c in calls]
    said = [(r["conv_id"], r["turn"], r["call_id"], r["content"]) for r in results]
    want = {r[:9]: r[9] for r in brute(plain, said, chat_tools.TOOLS)}
    mine = {tuple(r)[:9]: r["record"] for r in got}
    assert mine.keys() == want.keys()
    assert all(json.loads(mine[k]) == json.loads(want[k]) for k in mine)
