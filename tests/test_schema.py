"""The schema language: every word, references that meet themselves, what is refused, and rows checked by column."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import schema, shapes

REF = {"$defs": {"node": {"type": "object", "properties": {"v": {"type": "integer"}, "next": {"anyOf": [{"$ref": "#/$defs/node"}, {"type": "null"}]}}, "required": ["v"]}}, "$ref": "#/$defs/node"}
CASES = [
    ({"const": 1}, [1, 1.0], [True, "1", None]),
    ({"enum": [1, "a", None, [1]]}, [1, "a", None, [1.0]], [True, "b", [True]]),
    ({"type": ["integer", "null"]}, [3, 3.0, None], [3.5, "3", True]),
    ({"pattern": "^a+$"}, ["aa", 7], ["ab", ""]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "éèà", []], ["a", "abcd"]),
    ({"minimum": 1, "exclusiveMaximum": 3}, [1, 2.9, "0"], [0, 3]),
    ({"exclusiveMinimum": 1, "maximum": 3}, [1.1, 3], [1, 4]),
    ({"multipleOf": 0.1}, [0.3, 7, "x"], [0.35]),
    ({"items": {"type": "string"}, "uniqueItems": True}, [["a", "b"], "x", []], [["a", "a"], [1]]),
    ({"uniqueItems": True}, [[1, True, "1", [1], {"a": 1}]], [[1, 1.0], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
    ({"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": False}, [["a", 1], ["a"], []], [["a", 1, 2], [1]]),
    ({"contains": {"const": 5}, "minContains": 2, "maxContains": 3}, [[5, 5], [5, 1, 5, 5]], [[5], [5] * 4]),
    ({"properties": {"a": {"type": "string"}}, "additionalProperties": False, "required": ["a"]}, [{"a": "x"}, 3], [{}, {"a": 1}, {"a": "x", "b": 1}]),
    ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, [{"n_a": 1, "b": "x"}], [{"n_a": "x"}, {"b": 1}]),
    ({"propertyNames": {"maxLength": 2}, "minProperties": 1, "maxProperties": 2}, [{"a": 1}], [{}, {"abc": 1}, {"a": 1, "b": 2, "c": 3}]),
    ({"dependentRequired": {"a": ["b"]}}, [{"a": 1, "b": 1}, {"b": 1}, {}], [{"a": 1}]),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 2], [0, 3]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 5], [4]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 3], [6, 5]),
    ({"not": {"type": "null"}}, [1], [None]),
    ({"if": {"properties": {"k": {"const": "a"}}}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}, [{"k": "a", "x": 1}, {"k": "b", "y": 1}], [{"k": "a"}, {"k": "b", "x": 1}]),
    (REF, [{"v": 1, "next": {"v": 2, "next": None}}], [{"v": 1, "next": {"v": "x"}}, {}, 5]),
    (True, [1, None], []),
    (False, [], [1]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_words(case):
    shape, good, bad = CASES[case]
    program = schema.compiled(shape)
    assert [v for v in good if list(program.run(v))] == [] and [v for v in bad if not list(program.run(v))] == []


def test_deep_values_and_places():
    deep = {"v": 0}
    for k in range(1, 60):
        deep = {"v": k, "next": deep}
    assert shapes.faults(deep, REF) == []
    shape = {"type": "object", "properties": {"a/b": {"items": {"$ref": "#/$defs/~0t~1"}}}, "$defs": {"~t/": {"type": "string"}}}
    assert shapes.faults({"a/b": ["x", 1, None]}, shape) == ["/a~1b/1: string expected", "/a~1b/2: string expected"]


@pytest.mark.parametrize("shape", [{"minimal": 1}, {"properties": {"a": {"typ": "x"}}}, {"$ref": "#/$defs/none"}, {"$ref": "http://x/y"}, {"pattern": "("}, {"type": "text"}, {"items": 3}, {"anyOf": [{"x": 1}]}])
def test_what_is_no_program_is_refused(shape):
    assert shapes.unknown_words(shape) and shapes.unknown_words({"allOf": [shape]})
    with pytest.raises(schema.SchemaError):
        schema.compiled(shape)


def test_rows(spark):
    rows = [(1, '{"v": 1}'), (2, '{"v": "x"}'), (3, "{"), (4, None)]
    df = spark.createDataFrame(rows, "k int, t string").select("k", shapes.fault_column(F.col("t"), REF).alias("f"))
    assert {r["k"]: r["f"] for r in df.collect()} == {1: [], 2: ["/v: integer expected"], 3: ["/: no JSON"], 4: ["/: nothing there"]}
