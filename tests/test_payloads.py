"""JSON documents over several lines, and lookups with a name more than once."""

from formulake.operators import joins as J
from formulake.sources import files as S


def test_schema_of_documents_over_several_lines(spark):
    rows = spark.createDataFrame(
        [(1, '{"a": 1,\n "b": "x"}'), (2, '{"a": 2.5, "b": "y\\nz"}'), (3, '{\r\n"c": true}'), (4, None)],
        "id bigint, payload string")
    schema = S.infer_payload_schema(rows, "payload")
    assert schema.simpleString() == "struct<a:double,b:string,c:boolean>"
    got = sorted(S.expand_payload(rows, "payload", schema).collect())
    assert [tuple(r) for r in got] == [(1, 1.0, "x", None), (2, 2.5, "y\nz", None), (3, None, None, True), (4, None, None, None)]


def test_a_name_twice_in_the_lookup_multiplies_nothing(spark):
    rows = spark.createDataFrame([(1, " A ", ""), (2, "A", "own"), (3, "B", None)], "id bigint, name string, v string")
    lookup = spark.createDataFrame([("A", "y"), ("A", "x"), ("C", "z")], "name string, v string")
    got = sorted(map(tuple, J.lookup_backfill(rows, lookup, "name", "v").collect()))
    assert got == [(1, " A ", "x"), (2, "A", "own"), (3, "B", None)]
