"""Regression guards for the physical plans the scale design relies on."""

import contextlib
import io
import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return re.sub(r"#\d+L?", "", buf.getvalue())


def test_filters_and_pruning_reach_the_scan(spark):
    import __spark_entry__ as E
    p = plan_of(E.queries()["filtered_sum"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), In(o_orderstatus, [F,O])" in p
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in p
    assert "partial_sum" in p and "TakeOrderedAndProject" in p


def test_fill_windows_are_partitioned_by_block(spark):
    import __spark_entry__ as E
    p = plan_of(E.queries()["ffill"](spark, SF))
    assert "windowspecdefinition(_blk" in p
    # every single-partition exchange reads a table of one row per partition or per block
    lines = p.splitlines()
    singles = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert singles
    for i in singles:
        child = lines[i + 1]
        assert re.search(r"keys?=\[(_tc_pid|_blk)\]", child), child


def test_dedup_is_aggregate_plus_semi_join(spark):
    import __spark_entry__ as E
    p = plan_of(E.queries()["keep_first"](spark, SF))
    assert "LeftSemi" in p and "min(_row_id" in p
    assert "row_number()" not in p


def test_group_samples_use_partial_group_limit(spark):
    import __spark_entry__ as E
    p = plan_of(E.queries()["dup_groups"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_statistics_on_demand(spark):
    """A mean needs neither the value-count nor the quantile pass, a mode no quantiles."""
    from tablecare.operators.analysis import Analysis
    from tablecare.operators.clean import clean
    df = spark.range(0, 100).select(F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("x"), F.lit("a").alias("s"))
    a = Analysis(df)
    assert clean(a, "Missing Values", ["x"], "Fill with Mean").where("x IS NULL").count() == 0
    assert "_distinct" not in a.__dict__ and "_quantiles" not in a.__dict__
    clean(a, "Missing Values", ["s"], "Fill with Mode").count()
    assert "_distinct" in a.__dict__ and "_quantiles" not in a.__dict__


def test_page_is_cut_before_it_is_flagged(spark):
    """The flags of a page join the page's rows, never the whole table, to the repeated keys."""
    from tablecare.operators.analysis import Analysis
    from tablecare.operators.rowid import with_row_id
    from tablecare.plans.quality import table_page
    df = with_row_id(spark.range(0, 500).select((F.col("id") % 50).alias("k"), F.lit("text").alias("s")), ["k"])
    rows, stats = table_page(Analysis(df), search_term="TEXT", sort="k", limit=20)
    got = rows.collect()
    assert len(got) == 20 and all(r._is_duplicate for r in got) and [r._row_id for r in got] == list(range(20))
    assert stats.first().filtered_rows == 500 and stats.first().total_pages == 25
    plan = plan_of(Analysis(df).flag_rows(df.orderBy("k").limit(20)))
    keys = plan[plan.index("_pk"):]
    assert "BroadcastHashJoin" in plan and "BroadcastExchange" in keys  # the table meets the page's keys, broadcast
