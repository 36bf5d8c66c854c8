"""Every registered query against its SQL on the small tables, and no nested-loop join in any plan."""

import io
from contextlib import redirect_stdout

import pytest

from checks import collect
from checks.compare import compare, connect

QUERIES, ORACLES = collect()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, con, name):
    verdict, _, _, detail = compare(spark, con, small, name, QUERIES[name], ORACLES.get(name))
    assert verdict.startswith(("ok", "rows-only")) and "TYPES" not in verdict, f"{verdict}\n{detail}"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


NO_STREAMS = [n for n in QUERIES if not n.startswith(("w", "s2", "s4", "s5", "s6"))]


@pytest.mark.parametrize("name", NO_STREAMS)
def test_plan_has_no_nested_loop(spark, small, name):
    text = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["h1_recent_messages", "h2_history"])
def test_top_rows_are_cut_before_the_exchange(spark, small, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, small))


def test_scan_reads_only_what_is_needed(spark, small):
    text = plan_of(QUERIES["c5_adjacent_similarity"](spark, small))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in plan_of(QUERIES["h2_history"](spark, small)).replace("event_type), ", "")
