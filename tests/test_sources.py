"""Reading worker logs and profiles in their file formats."""

import json

import pytest
from pyspark.sql import functions as F

from queuescope import vocab
from queuescope.functions import fields as fx
from queuescope.operators.profiles import join_profile, profile_means
from queuescope.plans import ingest
from queuescope.plans.features import arrival_features
from queuescope.sources import logs as L
from queuescope.sources import profiles as P
from queuescope.sources import tables as S

DAY = "2026-01-10 14:14:"


def line(time, message, span_tid=None, **fields):
    record = {"timestamp": time, "level": "INFO", "fields": {"message": message, **fields},
              "target": "worker"}
    if span_tid:
        record["span"] = {"tid": span_tid, "name": "x"}
    return json.dumps(record)


SESSION = [
    line(DAY + "01", vocab.SWITCH, queue="cupy-4-0.0.1", queue_len=2, new_state="Active"),
    line(DAY + "01.5", vocab.ARRIVAL, span_tid="a"),
    line(DAY + "02.61030405", vocab.START, tid="a", num_running_funcs=3),
    line(DAY + "03.10927", vocab.COLD_START, tid="a", unknown_key={"deep": [1, 2]}),
    line(DAY + "04.123456789", vocab.COMPLETE, tid="a", fqdn="cupy-4-0.0.1", e2etime=3.25,
         compute="GPU", gpu_est_total="2.5"),
    line(DAY + "05", vocab.ARRIVAL, tid="b"),
    line(DAY + "06", vocab.COMPLETE, tid="b", fqdn="ffmpeg-1", e2etime=1.0, compute="CPU"),
    line(DAY + "07", vocab.SWITCH, queue="ffmpeg-1", queue_len=None, new_state="Odd"),
]


def write(root, policy, lines, workload="load-1*x", sub="", rep="0"):
    folder = root / "short" / "a1" / "b2" / workload / rep / policy / "c3" / "d4" / sub
    folder.mkdir(parents=True, exist_ok=True)
    (folder / vocab.LOG_FILE).write_text("".join(x + "\n" for x in lines))
    return folder


@pytest.fixture()
def root(tmp_path):
    write(tmp_path, "Landlord", SESSION)
    write(tmp_path, "Landlord", ["not json"], sub=vocab.PRECLEANUP)
    write(tmp_path, "Landlord", [], rep="1")
    write(tmp_path, "WeightedRandom_0.5", SESSION[:2], workload="wide-4")
    (tmp_path / "orchestration.log").write_text("text\n")
    return tmp_path


def test_discovery_and_paths(spark, root):
    every = L.read_worker_logs(spark, str(root))
    assert every.count() == len(SESSION) + 2
    landlord = L.read_worker_logs(spark, str(root), policy="landlord")
    assert landlord.count() == len(SESSION)
    catalog = L.session_catalog(every.select("path")).orderBy("session_id").collect()
    assert [(r.session_id, r.duration, r.workload, r.repetition, r.policy) for r in catalog] == [
        (0, "short", "load-1*x", "0", "Landlord"),
        (1, "short", "wide-4", "0", "WeightedRandom_0.5"),
    ]
    noisy = L.read_worker_logs(spark, str(root), mode="PERMISSIVE", include_precleanup=True)
    assert [r[L.CORRUPT] for r in noisy.collect() if r[L.CORRUPT]] == ["not json"]


def test_corrupt_line_fails_by_default(spark, root):
    with pytest.raises(Exception, match="(?i)malformed"):
        L.read_worker_logs(spark, str(root), include_precleanup=True).collect()


def test_typed_events(spark, root):
    raw = L.read_worker_logs(spark, str(root), policy="Landlord").withColumn("session_id", F.lit(0))
    rows = L.typed_events(raw).orderBy("seq").collect()
    assert [r.message for r in rows] == [json.loads(x)["fields"]["message"] for x in SESSION]
    start = 1768054441 * 10**9
    assert [r.ts_ns - start for r in rows[:5]] == [
        0, 500_000_000, 1_610_304_050, 2_109_270_000, 3_123_456_789,
    ]
    assert [r.tid for r in rows] == [None, "a", "a", "a", "a", "b", "b", None]
    assert rows[4].e2etime == 3.25 and rows[4].gpu_est_total == 2.5
    assert rows[0].queue_len == 2 and rows[7].queue_len is None
    assert rows[2].ts.isoformat(sep=" ") == DAY + "02.610304"


def test_unknown_keys_stay_in_the_map(spark, root):
    raw = L.read_worker_logs(spark, str(root), policy="Landlord")
    flat = L.flatten_fields(raw, ["message", "unknown_key"])
    found = flat.filter("unknown_key is not null").collect()
    assert [json.loads(r.unknown_key) for r in found] == [{"deep": [1, 2]}]
    assert found[0].fields["tid"] == "a"


def test_line_order_survives_splits(spark, tmp_path):
    lines = [line(DAY + "01", f"m{i:05d}", tid="x") for i in range(3000)]
    write(tmp_path, "Landlord", lines)
    keep = {k: spark.conf.get(k) for k in
            ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10000")
        raw = L.read_worker_logs(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 5
        flat = L.flatten_fields(raw, ["message"])
        got = [r.message for r in flat.orderBy("seq").select("message").collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == [f"m{i:05d}" for i in range(3000)]


def test_features_from_files(spark, root, tmp_path):
    raw = L.read_worker_logs(spark, str(root), policy="Landlord").withColumn(
        "session_id", F.lit(0).cast("bigint")
    )
    S.write_table(L.typed_events(raw), str(tmp_path / "typed"), cluster_by=["session_id"])
    events = S.read_table(spark, str(tmp_path / "typed"))
    (row,) = arrival_features(events, None, [1]).collect()
    assert (row.tid, row.fqdn, row.base_function) == ("a", "cupy-4-0.0.1", "cupy")
    assert (row.target_queue_len, row.target_queue_status, row.is_cold_start) == (2, "Active", 1)
    assert row.num_running_funcs_filled == 2 and row.e2etime == 3.25


def test_ingest(spark, root, tmp_path):
    profile = tmp_path / "profile.json"
    profile.write_text(json.dumps(PROFILE))
    events = ingest.ingest(spark, str(root), str(tmp_path / "events"))
    sizes = {(r.session_id, r.policy, r.workload): r["count"] for r in
             events.groupBy("session_id", "policy", "workload").count().collect()}
    # The empty log keeps its number.
    assert sizes == {(0, "Landlord", "load-1*x"): len(SESSION), (2, "WeightedRandom_0.5", "wide-4"): 2}
    catalog = L.session_catalog(L.list_logs(spark, str(root))).orderBy("session_id").collect()
    assert [(r.session_id, r.policy, r.repetition) for r in catalog] == [
        (0, "Landlord", "0"), (1, "Landlord", "1"), (2, "WeightedRandom_0.5", "0"),
    ]
    ingest.write_estimate_errors(events, str(tmp_path / "errors"))
    (e,) = S.read_table(spark, str(tmp_path / "errors")).collect()
    assert (e.fqdn, e.e2etime, e.gpu_est_total, e.absolute_error) == ("cupy-4-0.0.1", 3.25, 2.5, 0.75)
    ingest.write_features(events, str(tmp_path / "features"), str(profile))
    (f,) = S.read_table(spark, str(tmp_path / "features")).collect()
    assert (f.session_id, f.tid, f.gpu_warm_results_sec, f.target_queue_len) == (0, "a", 1.5, 2)


def test_nanos(spark):
    texts = {
        "2026-01-10 14:14:53": 0, "2026-01-10 14:14:53.5": 500_000_000,
        "2026-01-10 14:14:53.102030405": 102_030_405, "2026-01-10 14:14:53.00000001": 10,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    keep = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r.t: r.ns for r in df.select("t", fx.nanos(F.col("t")).alias("ns")).collect()}
            assert {t: ns - 1768054493 * 10**9 for t, ns in got.items()} == texts
    finally:
        spark.conf.set("spark.sql.session.timeZone", keep)
    bad = spark.createDataFrame([("soon",), (None,)], "t string")
    assert [r.ns for r in bad.select(fx.nanos(F.col("t")).alias("ns")).collect()] == [None, None]


def test_coercion_lenient_and_strict(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), (None,)], "e2etime string")
    assert [r.e2etime for r in L.coerce_fields(df).collect()] == [1.5, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        L.coerce_fields(df, strict=True).collect()


def test_base_function_and_flags(spark):
    names = {"cupy-4-0.0.1": "cupy", "7zip-1": None, "a-b-": "a-b", "--x1": "x", "-3": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.b for r in df.select("n", fx.base_function(F.col("n")).alias("b")).collect()}
    assert got == names
    flags = fx.policy_flags(F.col("n"))
    df = spark.createDataFrame([("WeightedRandom_0.5",), ("NEW_MICE",), ("Else",)], "n string")
    on = [
        [k for k, v in r.asDict().items() if v == 1]
        for r in df.select(*[c.alias(k) for k, c in flags.items()]).collect()
    ]
    assert on == [["policy_WeightedRandom"], ["policy_NEW_MICE"], []]


PROFILE = {
    "data": {
        "cupy": {"resource_data": {"gpu": {"warm_results_sec": [1.0, 2.0], "cold_results_sec": [5]}}},
        "half": {"resource_data": {"gpu": {"warm_results_sec": [4.0]}}},
        "empty": {"resource_data": {"gpu": {"warm_results_sec": [], "cold_results_sec": [1.0]}}},
        "cpu": {"resource_data": {"cpu": {"warm_results_sec": [9.0]}}},
        "bare": {},
        "none": None,
    }
}


def test_profile(spark, tmp_path):
    path = tmp_path / "profile.json"
    path.write_text(json.dumps(PROFILE, indent=1))
    means = profile_means(P.read_profile(spark, str(path)))
    got = {r[0]: (r[1], r[2]) for r in means.collect()}
    assert got == {
        "cupy": (1.5, 5.0), "half": (4.0, 0.0), "empty": (0.0, 1.0), "cpu": (0.0, 0.0),
        "bare": (0.0, 0.0), "none": (0.0, 0.0),
    }
    requests = spark.createDataFrame([("cupy-4-0.0.1",), ("new-1",), ("7zip-1",)], "fqdn string")
    joined = {r.fqdn: (r.gpu_warm_results_sec, r.gpu_cold_results_sec)
              for r in join_profile(requests, means).collect()}
    assert joined == {"cupy-4-0.0.1": (1.5, 5.0), "new-1": (0.0, 0.0), "7zip-1": (0.0, 0.0)}


def test_odd_samples_and_broken_profiles(spark, tmp_path):
    entries = {
        "null": ([1.0, None], [2.0]), "text": (["x", 4.0], [2.0]), "cold": ([1.0], ["y"]),
        "fine": ([1, 3.0], [2.0]),
    }
    data = {
        k: {"resource_data": {"gpu": {"warm_results_sec": w, "cold_results_sec": c}}}
        for k, (w, c) in entries.items()
    }
    path = tmp_path / "profile.json"
    path.write_text(json.dumps({"data": data}))
    got = {r[0]: (r[1], r[2]) for r in profile_means(P.read_profile(spark, str(path))).collect()}
    assert got == {"null": (0.0, 0.0), "text": (0.0, 0.0), "cold": (0.0, 0.0), "fine": (2.0, 2.0)}
    path.write_text('{"data": {"cupy": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        profile_means(P.read_profile(spark, str(path))).collect()
    texts = spark.createDataFrame([("{oops",)], "text string")
    with pytest.raises(Exception, match="(?i)malformed"):
        profile_means(P.parse_profiles(texts, "text")).collect()


def test_missing_profile_gives_zeros(spark, tmp_path):
    assert P.read_profile(spark, str(tmp_path / "absent.json")) is None
    requests = spark.createDataFrame([("cupy-4",)], "fqdn string")
    (row,) = join_profile(requests, None).collect()
    assert (row.base_function, row.gpu_warm_results_sec, row.gpu_cold_results_sec) == ("cupy", 0, 0)


def test_table_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("P", 1, 0.5, "a,b"), ("Q", 2, None, 'x"y')],
                               "policy string, session_id bigint, v double, t string")
    S.write_table(df, str(tmp_path / "t"), ["policy"], ["session_id"])
    back = S.read_table(spark, str(tmp_path / "t")).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    S.write_csv(df, str(tmp_path / "c"))
    again = S.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def test_a_profile_text_is_parsed_once(spark):
    """A filter on maps without entries, below the explosion, parsed every text once or twice more."""
    texts = ['{"data":{"f":{"resource_data":{"gpu":{"warm_results_sec":[1,3]}}}}}', '{"data":{}}', "{}", None]
    stored = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, k int").repartition(2, "k")
    means = profile_means(P.parse_profiles(stored, "text"))
    assert [tuple(r) for r in means.collect()] == [("f", 2.0, 0.0)]
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
