import json

import brute

from presslake.operators import nested

KEYS = ["source_split", "source_row_number"]
E1 = {"entity_id": "E1", "label": "a", "mentions": [{"surface": "x", "offsets": [1]}, {"surface": None}], "members": [{"id": "E2", "members": [{"entity_id": None}]}]}


def test_variants():
    assert nested.entities_of([E1])[0] == "list"
    assert nested.entities_of(E1) == ("entity", [E1])
    assert nested.entities_of({"entities": [E1]}) == ("wrapped", [E1])
    assert nested.entities_of({"version": 3, "payload": {"entities": [E1], "count": 1}}) == ("payload", [E1])
    for nothing in (None, {}, [], 3, "x", {"payload": None}, {"entities": None}):
        assert nested.entities_of(nothing)[1] == []


def test_rows_follow_the_definition():
    for value in ([E1, E1], E1, {"entities": [E1]}, {"payload": {"entities": [E1]}}, {}, [{}]):
        text = json.dumps(value)
        got = [(r[2], r[5], r[12], r[13]) for r in nested.rows_of(text) if r[0] == "mention" or r[10] == 0]
        assert sorted(got) == sorted(brute.mentions(text))


def test_invalid_json_gives_nothing():
    deep = "[" * 100_000
    for text in (None, "", "null", "[{", '[{"id": "E1"}', "[NaN]", '[] x', deep, deep + "]" * 100_000):
        assert list(nested.rows_of(text)) == []
    assert list(nested.rows_of('[{"id": "\\ud800"}]'))[0][5] == "?"


def test_tables(spark):
    text = json.dumps([E1])
    schema = "source_split string, source_row_number bigint, title_entities string, kind string, _text string"
    rows = [("train", 1, text, "k", "t"), ("train", 1, text, "k2", "t"), ("train", 2, None, "k", "t"), (None, None, "[{}]", "k", "t"), ("dev", 1, "[", "k", "t"), ("dev", 2, "[]", "k", "t"), ("dev", 2, "[{}]", "k", "t")]
    flat = nested.flatten_entities(spark.createDataFrame(rows, schema), ["title_entities"], KEYS)
    entities = flat.filter("kind = 'entity'").select("source_split", "item_path", "parent_path", "item_key").collect()
    assert sorted(map(tuple, entities), key=repr) == sorted(
        [("train", "0", None, "E1"), ("train", "0.0", "0", "E2"), ("train", "0.0.0", "0.0", ""), (None, "0", None, ""), ("dev", "0", None, "")], key=repr
    )
    assert flat.filter("kind = 'mention'").count() == 2
    assert nested.flatten_entities(spark.createDataFrame([], schema), ["title_entities"], KEYS).count() == 0


def test_candidates(spark):
    schema = "source_split string, source_row_number bigint, impressions array<struct<position:int,news_id:string,clicked:tinyint>>, item_path string"
    a = [(0, "N1", 1), (1, None, None)]
    rows = [("train", 1, a, "x"), ("train", 1, a, "y"), ("train", 1, [(0, "N1", 0), (None, "N2", 0)], "x"), ("dev", 1, None, "x"), ("dev", 2, [], "x"), ("dev", 3, [(0, "N1", 1), (0, "N1", 1)], "x")]
    out = nested.flatten_candidates(spark.createDataFrame(rows, schema), "impressions", KEYS).collect()
    assert sorted(map(tuple, out)) == [("dev", 3, "0", "N1"), ("train", 1, "0", "N1"), ("train", 1, "1", ""), ("train", 1, "1", "N2")]


def test_shapes_route_to_subtypes():
    located, plain = {"surface": "x", "offsets": [3]}, {"surface": "y"}
    value = [
        {"entity_id": "A", "mentions": [located, plain, {"note": 1}]},
        {"id": "B", "entity_id": "", "members": [{"entity_id": "C"}, {"label": "no id"}, {"note": 1}]},
        {"foo": 1},
        {},
        7,
    ]
    rows = [(r[0], r[15], r[2], r[5]) for r in nested.rows_of(json.dumps(value))]
    assert rows == [
        ("entity", "current", "0", "A"), ("mention", "located", "0", "A"), ("mention", "plain", "0", "A"), ("entity", "legacy_group", "1", "B"),
        ("entity", "current", "1.0", "C"), ("entity", "unkeyed", "1.1", ""), ("entity", "unkeyed", "3", ""),
    ]
    assert {r[15] for r in nested.rows_of(json.dumps(value)) if r[0] == "entity"} <= set(nested.ENTITY_SUBTYPES)
    # A child's state decides its parent's: members that are no entities make no group.
    assert [r[15] for r in nested.rows_of('[{"id": "B", "members": [{"note": 1}]}]')] == ["legacy"]


def test_any_depth_is_read():
    deep = '{"payload":' * 2_000 + '{"entities":[{"id":"E1"}]}' + "}" * 2_000
    assert [r[5] for r in nested.rows_of(deep)] == ["E1"]
    n = 100_000
    lists = '[{"id":"E1","x":' + "[" * n + "]" * n + "}]"
    assert [r[5] for r in nested.rows_of(lists)] == ["E1"]
    members = '{"id":"E","members":[' * 500 + "]}" * 500
    rows = list(nested.rows_of(members))
    assert len(rows) == 500 and rows[-1][4] == 499 and rows[0][15] == "legacy_group" and rows[-1][15] == "legacy"
    assert list(nested.rows_of('{"payload":' * n + "[1,]" + "}" * n)) == []


def test_deep_parser_agrees():
    for text in ['[]', '{}', ' [1, 2.5e3, "a\\"b", {"k": [null, true], "k": {}}] ', '[[[]],[{}]]', "7", '"x"']:
        assert nested.parse_deep(text) == json.loads(text)
    for text in ["[1,]", "[,1]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", "[1]]", "", "{1:2}", "[NaN]", '["a\tb"]'.replace("\\t", "\t"), "01", "nul"]:
        try:
            json.loads(text, parse_constant=nested._refuse)
            valid = True
        except ValueError:
            valid = False
        try:
            nested.parse_deep(text)
            assert valid, text
        except ValueError:
            assert not valid, text
