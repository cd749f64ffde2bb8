import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm.chat import canonical, fits, link_tools

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"},
                                                    "how": {"enum": ["x", "y"]}, "l": {"type": "array", "items": {"type": "string"}}},
                   "required": ["a"], "additionalProperties": False}}
KIND = "conv_id long, turn long, kind string, role string, content string, call_id string, after string, name string, arguments string"


def call(conv, turn, name, after=None, arguments='{"a":1}'):
    return (conv, turn, "call", "assistant", None, name, after, "add", arguments)


def result(conv, turn, name, content="r"):
    return (conv, turn, "result", "tool", content, name, None, None, None)


def test_schema_checks():
    good = ['{"a":1}', '{"a":1.0,"b":2.5}', '{"a":0,"how":"x","l":["p"]}']
    bad = ['{}', '{"a":-1}', '{"a":"1"}', '{"a":true}', '{"a":1,"c":2}', '{"a":1,"how":"z"}', '{"a":1,"l":[1]}', '[]', '3', 'null']
    assert all(fits(json.loads(x), SCHEMAS["add"]) for x in good)
    assert not any(fits(json.loads(x), SCHEMAS["add"]) for x in bad)
    assert canonical({"b": "é\n", "a": [1, None]}) == '{"a":[1,null],"b":"é\\n"}'


def linked(spark, rows):
    got = link_tools(spark.createDataFrame(rows, KIND).withColumn("Position", F.lit(9)), SCHEMAS)
    return sorted(got.collect(), key=lambda r: (r.conv_id if r.conv_id is not None else -1, r.position))


def test_order_and_links(spark):
    got = linked(spark, [
        (1, 0, "message", "user", "hi", None, None, None, None),
        result(1, 1, "p"), call(1, 3, "p"),                         # a result that came before its call
        call(1, 2, "q", after="p"), result(1, 4, "q"),              # needs p, but stands before it
        call(1, 5, "z"), result(1, 6, "nobody"), call(1, 7, "z"),   # no result; no call; repeated identifier
        call(1, 8, "u", after="missing", arguments="{broken"), result(1, 9, "u"), result(1, 10, "u", None)])
    assert [(r.kind[0], r.call_id, r.linked) for r in got] == [
        ("m", None, None), ("c", "p", True), ("r", "p", True), ("c", "q", True), ("r", "q", True), ("c", "z", False),
        ("r", "nobody", False), ("c", "z", False), ("c", "u", True), ("r", "u", True), ("r", "u", True)]
    assert [r.position for r in got] == list(range(11)) and not any(r.circular for r in got)
    assert [r.valid for r in got if r.kind == "call"] == [True, True, True, True, False]
    assert json.loads(got[8].line)["tool_calls"][0]["function"]["arguments"] == "{broken"
    assert json.loads(got[10].line) == {"role": "tool", "tool_call_id": "u", "content": None}


def test_long_chains_and_circles(spark):
    draw = random.Random(3)
    turns = list(range(130))
    draw.shuffle(turns)
    rows = []
    for i, t in enumerate(turns):                                   # call i needs call i - 1
        rows += [call(7, 2 * t, f"c{i}", after=f"c{i - 1}" if i else None), result(7, 2 * t + 1, f"c{i}")]
    rows += [call(8, 1, "a", after="b"), call(8, 2, "b", after="a"), call(8, 3, "c", after="b"), call(9, 0, "s", after="s")]
    got = linked(spark, rows)
    place = {(r.kind, r.call_id): r.position for r in got if r.conv_id == 7}
    for i in range(130):
        assert place["call", f"c{i}"] < place["result", f"c{i}"]
        assert i == 0 or place["result", f"c{i - 1}"] < place["call", f"c{i}"]
    assert [(r.call_id, r.circular) for r in got if r.conv_id == 8] == [("a", True), ("b", True), ("c", True)]
    assert [r.circular for r in got if r.conv_id == 9] == [True]


def test_nulls_and_empty(spark):
    rows = [(None, None, None, None, None, None, None, None, None), call(1, None, "x"), result(1, 0, None),
            call(1, 1, None, arguments=None), (1, 2, "message", None, "m" * 100000, None, None, None, None),
            (1, 2, "message", None, "same", None, None, None, None), (1, 2, "message", None, "same", None, None, None, None)]
    got = linked(spark, rows)
    assert len(got) == len(rows) and sorted(r.position for r in got if r.conv_id == 1) == list(range(6))
    assert link_tools(spark.createDataFrame([], KIND), SCHEMAS).count() == 0


def test_hostile_arguments():
    from tidewatch.llm.chat import canonical, check_schema, fits, parsed

    integer = {"type": "object", "properties": {"n": {"type": "integer"}}}
    assert parsed('{"n": %s}' % ("9" * 400), integer)[1] and not parsed('{"n": NaN}', integer)[1]
    assert parsed('{"n": "\\ud800"}', integer) == ('{"n": "\\ud800"}', False)
    assert parsed("[" * 5000 + "]" * 5000, {})[1] is False and parsed(None, {}) == (None, False)
    assert parsed('{"n": 1e999}', integer)[1] is False
    assert fits(None, {"type": ["string", "null"]}) and not fits(3, {"type": ["string", "null"]})
    assert not fits(True, {"enum": [1]}) and fits(1.0, {"enum": [1]}) and canonical([1.0, 2.5]) == "[1,2.5]"
    assert not fits("abc", {"pattern": "^b"}) and not fits([1], {"minItems": 2}) and fits(4, {"anyOf": [{"const": 4}]})
    with pytest.raises(ValueError, match="not supported"):
        check_schema({"properties": {"a": {"oneOf": []}}})
