"""Linked tool calls against a plain linker, with arguments that JSON readers trip over."""

import json
import random

import pytest

from parlance.llm import chat

SCHEMAS = {"answer": {"question": {"type": "string", "required": True}, "turn": {"type": "integer", "required": True}}}
GOOD = '{"turn": 3, "question": "é\\u00e9 \\" x"}'
TEXTS = [GOOD, '{"question":"x"}', "[1]", "{", "", None, '{"turn":1e400,"question":"x"}', '"\\ud800"', "[" * 200000 + "]" * 200000,
         '{"turn":true,"question":"x"}', '{"question":"x","turn":' + "9" * 5000 + "}", '{"turn":NaN}', '{"turn":2,"question":"x","more":0}']


def calls_and_results():
    rng = random.Random(12)
    calls, results = [], []
    for conv in [1, 2, 3, None]:
        ids = [f"c{i}" for i in range(25)] + [None]
        for i in range(40):
            name = rng.choice(["answer", "answer", "other", None])
            calls.append((conv, rng.choice(ids), rng.choice([None, i % 7]), name, rng.choice([GOOD, *TEXTS]), rng.choice([None, "absent", *ids[:25]])))
            results.append((conv, rng.choice([*ids, "z"]), rng.choice([None, i % 5]), rng.choice([None, "r\n", "{}"])))
    calls += [(9, f"k{i}", i, "answer", GOOD, f"k{i - 1}") for i in range(300)]  # a long chain
    calls += [(8, "a", 0, "answer", GOOD, "b"), (8, "b", 0, "answer", GOOD, "a"), (8, "c", 0, "answer", GOOD, "a"), (8, "d", 0, "answer", GOOD, "d")]
    return calls + calls[:20], results + results[:20]


def null_first(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def by_hand(calls, results):
    def chosen(rows, order):
        best, aside = {}, []
        for row in sorted(set(rows), key=lambda r: null_first([r[i] for i in order])):
            if row[0] is None or row[1] is None:
                aside.append((row, "unlinked"))
            elif (row[0], row[1]) in best:
                aside.append((row, "superseded"))
            else:
                best[row[0], row[1]] = row
        return best, aside

    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    one, call_aside = chosen(calls, (2, 4, 3, 5))
    back, result_aside = chosen(results, (2, 3))
    out = [(r[0], r[1], r[2], None, r[3], why, dump({"id": r[1], "name": r[3], "arguments": r[4]})) for r, why in call_aside]
    out += [(r[0], r[1], r[2], None, None, why, dump({"id": r[1], "result": r[3]})) for r, why in result_aside]
    out += [(*k, r[2], None, None, "orphan_result", dump({"id": k[1], "result": r[3]})) for k, r in back.items() if k not in one]
    for key, row in one.items():
        seen, at = [], key
        while at in one and at not in seen:
            seen.append(at)
            at = (key[0], one[at][5])
        depth = None if at in one else len(seen) - 1
        shown = {"id": key[1], "name": row[3]} | ({"result": back[key][3]} if key in back else {})
        try:
            arguments = json.loads(row[4] or "", parse_constant=lambda n: 1 / 0)
            dump(arguments).encode()
            shown["arguments"] = arguments
            rules = SCHEMAS.get(row[3])
            fits = rules and isinstance(arguments, dict) and set(arguments) == set(rules) and type(arguments["turn"]) is int
            status = "unknown_tool" if not rules else "invalid_arguments" if not fits else "cycle" if depth is None else "ok" if key in back else "no_result"
        except (ValueError, RecursionError, ZeroDivisionError):
            status, shown["arguments"] = "invalid_json", row[4]
        out.append((*key, row[2], depth, row[3], status, dump(shown)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    calls, results = calls_and_results()
    kind = "conv_id long, call_id string, turn long, "
    return (
        spark.createDataFrame([(*c, "x") for c in calls], kind + "name string, arguments string, after string, depth string"),
        spark.createDataFrame([(*r, 1) for r in results], kind + "content string, TURN_ int"),
    )


def test_links_match_a_plain_linker(tables):
    want = by_hand(*calls_and_results())
    got = chat.link_tool_calls(*tables, schemas=SCHEMAS)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {w[5] for w in want} == {
        "ok", "no_result", "orphan_result", "unknown_tool", "invalid_json", "invalid_arguments", "cycle", "superseded", "unlinked"
    }
    assert max(w[3] or 0 for w in want) == 299


@pytest.mark.parametrize("text", ['{"turn": 1e400}', '"\\ud800"', "[" * 200000, '{"a":' * 100000 + "1" + "}" * 100000])
def test_arguments_that_cannot_be_written_are_invalid(text):
    with pytest.raises(ValueError):
        chat.parsed(text)
