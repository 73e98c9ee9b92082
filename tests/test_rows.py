import brute
import pytest

from presslake.operators import rows

KEYS = ["source_split", "source_row_number"]
NEWS = [
    "N1\ta\tb\tc\td\te\tf\tg",
    ' N1 \t"a\tb"\tb\t"said ""no"""\t\t\t[]\t',
    "N1\ta\tb",
    "",
    None,
    "N\ta\tb\tc\td\te\tf\tg",
    'N1\t"a\tb\tc\td\te\tf\tg',
    'N1\t"a"x\tb\tc\td\te\tf\tg',
    '"N7"\ta"b"\tb\tc\td\te\tf\tg\r',
    '""\ta\tb\tc\td\te\tf\tg',
    "N1.0\ta\tb\tc\td\te\tf\tg",
    'N1\t"' + '""' * 60_000 + '"\tb\tc\td\te\tf\tg',
    "N1" + "\t" * 60_000,
    "N1\t" + "x" * 200_000 + "\tb\tc\td\te\tf\tg",
]
TIMES = [
    "1/2/2020 3:04:05 AM", "01/02/2020 12:00:00 pm", "2/29/2019 1:00:00 AM", "2/29/2020 1:00:00 AM", "2/29/1900 1:00:00 AM", "13/1/2020 1:00:00 AM", "1/1/2020 0:00:00 AM", "1/1/2020 13:00:00 AM",
    "1/1/2020 1:60:00 AM", "2020-01-02 03:04:05", "2020-01-02T03:04:05.5Z", "2020-01-02T03:04:05.1234567+0530", "2020-01-02 03:04:05-23:59", "2020-01-02 03:04:05+24:00", "2020-01-02 03:04:05+01:60",
    "2020-01-02 24:00:00", "2020-1-2 03:04:05", "0000-01-01 00:00:00", "9999-12-31 23:59:59", "yesterday", "", " 1/2/2020 3:04:05 AM ", "2020-04-31 00:00:00", "1/2/2020x 3:04:05 AM",
]
BEHAVIORS = (
    [f"1\tU\t{t}\tN1\tN1-0" for t in TIMES]
    + [f"1\tU\t2020-01-02 03:04:05\tN1\t{x}" for x in ["", " ", "N1 N2-1", "N1-2", "N1-", "n1", "N1--1", "N1 N2-0 ", '"N1 N2-0"', '"N1 x"', "-1", "N1-0\r", "BROKEN-x"]]
    + ["\tU\t2020-01-02 03:04:05\tN1\tN1", "1\t \t2020-01-02 03:04:05\tN1\tN1", '" "\tU\t2020-01-02 03:04:05\tN1\tN1', "1\tU\tx\tN1", '1\tU\t"x', '1\tU\t2020-01-02 03:04:05\t"N1\tN1', '"1"\t"U"\t"2020-01-02 03:04:05"\t""\t"N1"']
    + ["1\tU\t2020-01-02 03:04:05\tN1\tN1\tN2"]
)


def frame(spark, lines):
    return spark.createDataFrame([("train", k, line, "x", "y") for k, line in enumerate(lines)], "source_split string, source_row_number bigint, line string, reason string, fields string")


@pytest.mark.parametrize("feed, lines", [(rows.NEWS, NEWS), (rows.BEHAVIORS, BEHAVIORS)])
def test_reasons(spark, feed, lines):
    df = frame(spark, lines)
    got = {r.source_row_number: r.reason for r in rows.failures(df.unionAll(df), feed, KEYS).collect()}
    assert got == {k: r for k, line in enumerate(lines) if (r := brute.reason(line, feed.name))}
    assert rows.failures(df.limit(0), feed, KEYS).count() == 0


def test_typed_rows_complete_the_failures(spark):
    df = frame(spark, BEHAVIORS)
    typed = {r.source_row_number: r for r in rows.typed_behaviors(df, KEYS).collect()}
    assert set(typed) == {k for k, line in enumerate(BEHAVIORS) if brute.reason(line, "behaviors") is None}
    for k, t in enumerate(TIMES):
        if k in typed:
            assert typed[k].timestamp == brute.instant(t.strip())
    first = typed[len(TIMES) + 2]
    assert [tuple(c) for c in first.impressions] == [(0, "N1", None), (1, "N2", 1)] and first.history == ["N1"]
    assert rows.typed_news(frame(spark, NEWS), KEYS).count() == sum(brute.reason(line, "news") is None for line in NEWS)


def test_first_broken_field(spark):
    lines = {
        "N1\ta\tb": "title", "": "news_id", None: "news_id", "N\ta\tb\tc\td\te\tf\tg": "news_id", 'N1\t"a\tb\tc\td\te\tf\tg': "category", 'N1\ta\tb\t"c"x\td\te\tf\tg': "title",
        "N1\ta\tb\tc\td\te\tf\tg\th": rows.BEYOND, 'N1\ta\tb\tc\td\te\tf\tg\t"h': rows.BEYOND, 'x\ta\tb\tc\td\te\tf\t"g': "abstract_entities", "N1\ta\tb\tc\td\te\tf\tg": None,
    }
    # Of an empty line the only column is an empty one, so that the second is the first that is missing.
    lines |= {"": "category", None: "category"}
    parsed = rows.parse_lines(frame(spark, list(lines)), rows.NEWS)
    assert {r.line: r.first_broken_field for r in parsed.collect()} == lines
    lines = {
        "1\tU\t1/2/2020 3:04:05 AM\tN1\tN1-0": None, "1\tU\t2/30/2020 3:04:05 AM\tN1\tN1-0": "timestamp", "1\tU\tsoon\tN1\tx": "timestamp", "1\t \tsoon\tN1\tx": "user_id", '1\t ""\t1/2/2020 3:04:05 AM\tN1\tx': "impressions",
        '"""1"\tU\t"2020-01-02 03:04:05"\t""\t"N1"': None, '""\tU\tsoon\t""\t"N1"': "impression_id", "1\tU\tsoon\tN1": "impressions",
    }
    parsed = rows.parse_lines(frame(spark, list(lines)), rows.BEHAVIORS)
    assert {r.line: r.first_broken_field for r in parsed.collect()} == lines
