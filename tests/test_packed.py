import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presslake.operators import packed
from presslake.plans import general

PIECES = st.sampled_from(['"', "'", '""', "''", "\\", '\\"', "\\'", " ", "N1", "N22-0", ",", ";", "|", "px_9", "PX 7;b", " ", "\n", '"PX 7;b"'])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_segmentation_follows_the_definition(field):
    expected = brute.split_values(field)
    assert packed.Segmenter().split(field) == expected
    # Known written forms protect the same spans, so they change nothing where the grammar is unambiguous.
    assert packed.Segmenter({'"PX 7;b"': "PX 7;b"}).split(field) == expected


@pytest.mark.parametrize(
    "field, values",
    [
        (None, []),
        ("", []),
        (" \t", []),
        ("[]", []),
        ('"N1"', ["N1"]),
        ('"N1, N2"', ["N1", "N2"]),
        ('"""PX 9-1""|N5-0"', ["PX 9-1", "N5-0"]),
        ('N1;"PX \\"3\\""', ["N1", 'PX "3"']),
        ('"N4, N3', ["N4", "N3"]),
        ("<'N1'>' N2 '>", ["N1", "N2"]),
        ('"",""', []),
    ],
)
def test_examples(field, values):
    assert packed.Segmenter().split(field) == values


def test_known_values_protect_delimiters_outside_quotes():
    known = packed.Segmenter({"PX 7;b": "PX 7;b", "N1": "N1"})
    assert known.split("N1 PX 7;b N2") == ["N1", "PX 7;b", "N2"]
    assert known.split("N11 xPX 7;b") == ["N11", "xPX", "7", "b"]


def test_long_fields_are_read_whole():
    field = '"a b",' * 50_000
    assert len(packed.Segmenter({'"a b"': "a b"}).split('x,' + field)) == 50_001
    for end in ("x", '"', ""):
        field = '"' + '""' * 50_000 + end
        assert packed.Segmenter().split(field) == brute.split_values(field)


def test_rows_repeats_conflicts_and_clashing_columns(spark):
    schema = "export_id bigint, history_raw string, impressions string, _key string, packed_field string, text string"
    rows = [
        (1, "N1 N1", '"N2"', "x", "y", "z"),
        (1, "N1 N1", '"N2"', "other", "y", "z"),
        (2, None, "", "x", "y", "z"),
        (3, "N3", None, "x", "y", "z"),
        (3, "N3 N4", None, "x", "y", "z"),
        (None, "N9", None, "x", "y", "z"),
    ]
    df = spark.createDataFrame(rows, schema)
    out = packed.split_packed(df, "export_id", ["history_raw", "impressions"], packed.harvest(df, ["history_raw", "impressions"]))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted(
        [(1, "history_raw", 0, "N1"), (1, "history_raw", 1, "N1"), (1, "impressions", 0, "N2"), (3, "history_raw", 0, "N3"), (3, "history_raw", 1, "N4"), (None, "history_raw", 0, "N9")], key=repr
    )
    assert packed.split_packed(df.limit(0), "export_id", ["history_raw"]).count() == 0


def test_the_dictionary_decides_on_a_table(spark):
    """A value that is quoted in one row is kept whole where others write it bare; without the dictionary it falls apart."""
    schema = "export_id bigint, history_raw string"
    rows = [(1, 'N1,"PX 7;b",N2'), (2, "N1;PX 7;b|N3"), (3, "N11 xPX 7;b"), (4, '"PX 7;b"'), (5, "PX 7;bN1"), (6, "'a, b' N1 a, b"), (7, None)]
    df = spark.createDataFrame(rows, schema)
    known = packed.harvest(df, ["history_raw"], bare=True)
    assert {r.value for r in known.collect()} == {"PX 7;b", "a, b"}
    truth = {
        1: ["N1", "PX 7;b", "N2"], 2: ["N1", "PX 7;b", "N3"], 3: ["N11", "xPX", "7", "b"], 4: ["PX 7;b"], 5: ["PX", "7", "bN1"], 6: ["a, b", "N1", "a, b"],
    }

    def values(**how):
        out: dict[int, dict[int, str]] = {}
        for r in packed.split_packed(df, "export_id", ["history_raw"], **how).collect():
            out.setdefault(r.export_id, {})[r.item_position] = r.item_value
        return {k: [v[i] for i in range(len(v))] for k, v in out.items()}

    assert values(known=known) == truth
    assert values(known=known, most_characters=0) == truth  # the join on spans gives the same edges
    plain = values()
    assert plain[2] == ["N1", "PX", "7", "b", "N3"] and plain[6] == ["a, b", "N1", "a", "b"]
    assert {k for k in truth if plain[k] != truth[k]} == {2, 4, 6}


def test_a_dictionary_is_gathered_only_where_it_decides(spark, monkeypatch):
    fields = {1: 'N1,"PX 7;b",N2', 2: "N1;PX 7;b|N3", 3: "'a, b' N1 a, b", 4: '"N1;""PX 7;b"""', 5: 'N4, "PX 7;b', 6: None}
    df = spark.createDataFrame([(k, t, "") for k, t in fields.items()], "export_id bigint, history_raw string, impressions string")
    gathered, harvest = [], packed.harvest
    monkeypatch.setattr(general, "table", lambda *_: df)
    monkeypatch.setattr(packed, "harvest", lambda *a, **how: gathered.append(how) or harvest(*a, **how))
    found = set(map(tuple, general.p1_found(spark, "").collect()))
    assert found == {(k, "history_raw", i, v) for k, t in fields.items() if t for i, v in enumerate(brute.split_values(t))}
    assert gathered == []
    protected = set(map(tuple, general.p1_protected(spark, "").collect()))
    assert gathered == [{"bare": True}]
    assert (2, "history_raw", 1, "PX 7;b") in protected - found and (3, "history_raw", 2, "a, b") in protected - found
