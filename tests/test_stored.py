"""Pruned reads, rejected lines and a catalog that grows."""

import glob
import json
import re

import pytest
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.plans.ingest import ingest_lenient, load_events, sort_lines
from queuescope.sources import logs as L
from queuescope.sources import tables as S
from tests.test_sources import DAY, SESSION, line, write


@pytest.fixture
def stored(spark, tmp_path):
    """Three policies with 40 sessions each, in small row groups."""
    rows = spark.range(120_000).selectExpr("id % 120 as session_id", "id as seq", "cast(id % 120 div 40 as string) as policy")
    path = f"{tmp_path}/table"
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "4096")
    try:
        S.write_table(rows.coalesce(1), path, ["policy"], ["session_id"])
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.block.size")
    return path


def scanned(df):
    """Rows that the scan handed on, and its plan."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        leaf = plan.collectLeaves().apply(0)
        return leaf.metrics().apply("numOutputRows").value(), plan.toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_only_the_folders_and_row_groups_that_are_asked_for(spark, stored):
    part = S.read_sessions(spark, stored, ["1"], [45, 46])
    rows, plan = scanned(part)
    assert re.search(r"PartitionFilters: \[[^\]]*policy[^\]]*", plan) and "PushedFilters: [" in plan
    assert part.count() == 2000 <= rows < 20_000
    assert S.read_sessions(spark, stored, ["0", "1"], range(38, 42), without=[40]).count() == 3000
    assert S.read_sessions(spark, stored, None, []).count() == 0
    assert S.read_sessions(spark, stored).count() == 120_000


def test_files_of_other_policies_are_not_opened(spark, stored):
    for name in glob.glob(f"{stored}/policy=0/*.parquet") + glob.glob(f"{stored}/policy=2/*.parquet"):
        with open(name, "wb") as file:
            file.write(b"this is no table" * 100)
    schema = "session_id long, seq long, policy string"
    assert S.read_sessions(spark, stored, ["1"], [45, 46], schema=schema).agg(F.sum("seq")).first()[0] > 0
    with pytest.raises(Exception, match="(?i)parquet|checksum"):
        S.read_sessions(spark, stored, None, [1, 119], schema=schema).agg(F.sum("seq")).first()


def test_another_query_chooses_the_folders(spark, stored, tmp_path):
    spark.createDataFrame([("1", 45, 0.5), ("1", 47, 0.9), ("2", 90, 0.1)], "policy string, session_id long, score double").write.parquet(f"{tmp_path}/scores")
    chosen = spark.read.parquet(f"{tmp_path}/scores").filter("score > 0.3")
    part = S.read_chosen(spark, stored, chosen)
    assert "dynamicpruning" in part._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(r[0] for r in part.select("session_id").distinct().collect()) == [45, 47]
    assert part.count() == 2000


BAD = ["not json", '{"timestamp":"' + DAY + '01","fields":{"mess', "[1, 2]", "7", '"text"']
UNTIMED = [line("soon", vocab.START, tid="a"), json.dumps({"fields": {"message": "x"}}), "{}"]


def test_rejected_lines_keep_file_and_order(spark, tmp_path):
    root = tmp_path / "logs"
    mixed = [BAD[0], *SESSION[:3], BAD[1], UNTIMED[0], "", *SESSION[3:], *BAD[2:], *UNTIMED[1:], "   "]
    folder = write(root, "Landlord", mixed)
    write(root, "Greedy", SESSION[:2])
    got = ingest_lenient(spark, str(root), str(tmp_path / "out"))
    rejected = got.rejected.orderBy("session_id", "seq").collect()
    assert [(r.line, r.reason) for r in rejected] == [
        (x, L.NOT_JSON if x in BAD else L.NO_TIME) for x in mixed if x in BAD + UNTIMED
    ]
    assert {r.path for r in rejected} == {f"file:{folder}/{vocab.LOG_FILE}"}
    assert got.counts == {"lines": 18, "events": 10, "not_json": 5, "no_time": 3}
    events = got.events.filter("policy = 'Landlord'").orderBy("seq").collect()
    assert [r.message for r in events] == [json.loads(x)["fields"]["message"] for x in SESSION]
    assert got.events.filter("ts_ns is null").count() == 0
    # The same events as from the strict reader on the lines that are left.
    clean = tmp_path / "clean"
    write(clean, "Landlord", SESSION)
    write(clean, "Greedy", SESSION[:2])
    columns = ["policy", "ts_ns", "tid", "message", "fqdn", "queue_len", "e2etime", "gpu_est_total"]
    same = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert same(got.events) == same(load_events(spark, str(clean)))
    assert same(load_events(spark, str(root), mode="PERMISSIVE").filter("ts_ns is not null")) == same(got.events)


def test_lines_without_a_fault_and_no_lines(spark, tmp_path):
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(SESSION)], "seq long, line string")
    good = sort_lines(lines, f"{tmp_path}/good")
    assert good.rejected.count() == 0 and good.events.count() == len(SESSION) == good.counts["lines"]
    none = sort_lines(lines.limit(0), f"{tmp_path}/none")
    assert none.events.count() == none.rejected.count() == 0 == none.counts["lines"]


def test_numbers_of_known_sessions_never_change(spark, tmp_path):
    stored, seen = f"{tmp_path}/catalog", {}
    keys = ["m/b", "m/a", "z/x", "a/a", "a/b", "m/aa"]
    for upto in (2, 2, 3, 6):
        paths = [(f"/logs/short/a1/b2/load-1/0/{k}/c3/{vocab.LOG_FILE}",) for k in keys[:upto]]
        rows = L.update_catalog(spark, stored, spark.createDataFrame(paths * 2, "path string")).collect()
        now = {r.session_key: r.session_id for r in rows}
        assert len(rows) == upto and sorted(now.values()) == list(range(upto))
        assert seen.items() <= now.items()
        seen = now
    assert [k.split("/0/")[1] for k in sorted(seen, key=seen.get)] == [f"{k}/c3" for k in ["m/a", "m/b", "z/x", "a/a", "a/b", "m/aa"]]


def test_a_log_that_sorts_first_changes_no_number(spark, tmp_path):
    root, out = tmp_path / "logs", str(tmp_path / "out")
    write(root, "Landlord", SESSION)
    first = ingest_lenient(spark, str(root), out, catalog=f"{tmp_path}/catalog")
    assert {r[0] for r in first.events.select("session_id").distinct().collect()} == {0}
    write(root, "AlwaysGPU", SESSION[:3])
    again = ingest_lenient(spark, str(root), out, catalog=f"{tmp_path}/catalog")
    numbers = {(r.policy, r.session_id) for r in again.events.select("policy", "session_id").distinct().collect()}
    assert numbers == {("Landlord", 0), ("AlwaysGPU", 1)}
    assert again.events.filter(F.col("session_id") == 1).count() == 3
