from datetime import UTC, datetime, timedelta

import brute
from hypothesis import given, settings
from hypothesis import strategies as st

from presslake.operators.sessions import sessions

SCHEMA = "impression_id string, user_id string, timestamp timestamp, u string, ts bigint, b int"
START = datetime(2020, 2, 28, 23, 0, tzinfo=UTC)


def run(spark, events, **options):
    rows = [(i, u, None if t is None else START + timedelta(microseconds=t), "x", 1, 2) for i, u, t in events]
    return sorted(map(tuple, sessions(spark.createDataFrame(rows, SCHEMA), **options).collect()))


def expected(events):
    base = int(START.timestamp() * 1e6)
    return sorted(brute.sessions([(i, u, None if t is None else base + t) for i, u, t in events]))


def test_gap_is_exact_to_the_microsecond(spark):
    gap = 1_800_000_000
    events = [("a", "U", 0), ("b", "U", gap), ("c", "U", 2 * gap + 1), ("c", "U", 2 * gap + 1), ("d", "U", 2 * gap + 1), ("e", None, 5), ("f", "U", None), (None, "U", 7)]
    assert run(spark, events) == expected(events)
    assert [r[3] for r in run(spark, events)] == [2, 2]


def test_sessions_across_buckets_and_before_1970(spark):
    hour = 3_600_000_000
    events = [(f"i{k}", "U", k * hour // 3) for k in range(200)] + [(f"j{k}", "V", -(10**15) * 2 + k * hour) for k in range(30)]
    assert run(spark, events) == expected(events)
    assert run(spark, events, bucket_us=1_800_000_000) == expected(events)


def test_empty(spark):
    assert run(spark, []) == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60).map(str), st.sampled_from(["U", "V", None]), st.one_of(st.none(), st.integers(0, 400).map(lambda x: x * 600_000_000))), max_size=60))
def test_random(spark, events):
    events = list({e[0]: e for e in events}.values())
    assert run(spark, events) == expected(events)


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace as Stub
    from unittest.mock import MagicMock

    import pytest

    from presslake import session

    context = MagicMock()
    context.getConf.return_value.get.return_value = None
    context._jsc.sc.return_value.getCheckpointDir.return_value.isDefined.return_value = False
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        context.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(Stub(sparkContext=context, conf=Stub(get=lambda *a: None)))
    for master in ("local", "local[4]", "local[*]"):
        context.master = master
        assert "presslake-" in session.shared_folder(Stub(sparkContext=context, conf=Stub(get=lambda *a: None)))
    context.master = "yarn"
    assert session.shared_folder(Stub(sparkContext=context, conf=Stub(get=lambda *a: "hdfs:///shared"))) == "hdfs:///shared"
