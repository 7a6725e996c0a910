"""SQL twins of the registered queries, for DuckDB on the same tables.

Common table expressions are named parts; ``sql`` puts the needed ones in front. Where there is a
choice they use another formulation than the DataFrame code (ASOF joins, segments, row numbers).
"""

from __future__ import annotations

from queuescope import vocab
from queuescope.registry.adapter import FUNCTIONS, SESSION_POLICIES


def _case(index: str, names: list) -> str:
    def text(name):
        return "null" if name is None else f"'{name}'"

    whens = " ".join(f"when {i} then {text(n)}" for i, n in enumerate(names[:-1]))
    return f"case {index} {whens} else {text(names[-1])} end"


def _base(fqdn: str) -> str:
    stem = f"trim(regexp_extract({fqdn}, '{vocab.BASE_FUNCTION_PATTERN}', 1), '-')"
    return f"nullif({stem}, '')"


def _flags(column: str, prefix: str, names: list[str]) -> str:
    return ", ".join(
        f"coalesce(({column} = '{n}')::int, 0) as \"{prefix}_{n}\"" for n in names
    )


_STATUS_FLAGS = _flags("{}", "is_status", vocab.QUEUE_STATES)

PARTS: dict[str, tuple[list[str], str]] = {}


def _part(name: str, needs: str, body: str) -> None:
    PARTS[name] = (needs.split(), body)


_part("raw", "", """
    select event_id as seq, user_id % 8 as session_id, epoch_us(ts) * 1000 as ts_ns, user_id,
           event_type, value, cast(props->>'$.k' as int) as k, ts
    from events""")

_part("ev", "raw", f"""
    select session_id, seq, ts_ns, user_id || '-' || n as tid,
           case when event_type = 'click' then '{vocab.ARRIVAL}'
                when event_type = 'view' then '{vocab.START}'
                when event_type = 'purchase' then '{vocab.COMPLETE}'
                when event_type = 'signup' then '{vocab.SWITCH}'
                when event_type = 'error' and k % 3 = 0 then '{vocab.COLD_START}'
                else 'Other' end as message,
           case when event_type in ('click', 'purchase')
                then {_case('(user_id + n) % 6', FUNCTIONS)} end as fqdn,
           case when event_type = 'signup' then {_case('k % 6', FUNCTIONS)} end as queue,
           case when event_type = 'signup' then (k % 7)::bigint end as queue_len,
           case when event_type = 'signup'
                then {_case('k % 4', [*vocab.QUEUE_STATES, None])} end as new_state,
           case when event_type = 'view' and k % 3 = 0
                then (k % 5)::bigint end as num_running_funcs,
           case when event_type = 'view' then value end as gpu_est_total,
           case when event_type = 'purchase' then value end as e2etime,
           case when event_type = 'purchase'
                then case when k % 4 = 0 then 'CPU' else '{vocab.GPU}' end end as compute
    from (select *, row_number() over (partition by user_id, event_type order by ts_ns, seq) as n
          from raw)""")

_part("gpu", "ev", f"""
    select distinct session_id, tid from ev
    where fqdn is not null and e2etime is not null and compute = '{vocab.GPU}'""")

_part("cold", "ev", f"""
    select distinct session_id, tid from ev where message = '{vocab.COLD_START}'""")

_part("arr", "ev gpu", f"""
    select * from ev semi join gpu using (session_id, tid) where message = '{vocab.ARRIVAL}'
    qualify row_number() over (partition by session_id, tid order by ts_ns, seq) = 1""")

_part("req", "arr ev cold", """
    select a.session_id, a.tid, a.ts_ns, a.seq, o.fqdn, o.e2etime,
           (c.tid is not null)::int as is_cold_start
    from arr a
    left join (select * from ev where e2etime is not null
               qualify row_number() over (partition by session_id, tid
                                          order by ts_ns desc, seq desc) = 1) o
      on a.session_id = o.session_id and a.tid = o.tid
    left join cold c on a.session_id = c.session_id and a.tid = c.tid""")

_part("run", "ev", f"""
    select session_id, tid, seq,
           c + coalesce(last_value(b ignore nulls) over w,
                        first_value(b ignore nulls) over (partition by session_id
                          order by ts_ns, seq
                          rows between current row and unbounded following)) - 1 as running,
           message
    from (select *, num_running_funcs - c as b
          from (select *, sum(case when message = '{vocab.ARRIVAL}' then 1
                                   when message = '{vocab.COMPLETE}' then -1 else 0 end)
                          over (partition by session_id order by ts_ns, seq
                                rows between unbounded preceding and current row)::bigint as c
                from ev
                where num_running_funcs is not null or e2etime is not null
                      or message in ('{vocab.START}', '{vocab.ARRIVAL}')))
    window w as (partition by session_id order by ts_ns, seq
                 rows between unbounded preceding and current row)""")

_part("chg", "ev", f"""
    select session_id, queue, ts_ns, seq, 'set' as change, queue_len as set_len,
           new_state as set_status
    from ev where message = '{vocab.SWITCH}' and queue is not null
    union all
    select e.session_id, f.fqdn, e.ts_ns, e.seq, 'dec', null, null
    from ev e
    join (select session_id, tid, max(fqdn) as fqdn from ev where fqdn is not null
          group by session_id, tid) f using (session_id, tid)
    where e.message = '{vocab.START}'""")

_part("hist", "chg", f"""
    select session_id, queue, ts_ns, seq, change, len,
           coalesce(last_value(set_status ignore nulls) over w, '{vocab.INITIAL_STATE}') as status,
           len - coalesce(lag(len) over (partition by session_id, queue order by ts_ns, seq), 0)
             as delta
    from (select *, greatest(0, coalesce(max(set_len) over (partition by session_id, queue, seg), 0)
                     - sum((set_len is null)::int) over (partition by session_id, queue, seg
                         order by ts_ns, seq
                         rows between unbounded preceding and current row))::bigint as len
          from (select *, sum((set_len is not null)::int) over (partition by session_id, queue
                            order by ts_ns, seq
                            rows between unbounded preceding and current row) as seg
                from chg))
    window w as (partition by session_id, queue order by ts_ns, seq
                 rows between unbounded preceding and current row)""")

_part("hist1", "hist", """
    select * from hist
    qualify row_number() over (partition by session_id, queue, ts_ns order by seq desc) = 1""")

_part("tot", "hist", """
    select session_id, ts_ns, seq, sum(delta) over (partition by session_id order by ts_ns, seq
             rows between unbounded preceding and current row)::bigint as total
    from hist""")

_part("tot1", "tot", """
    select * from tot
    qualify row_number() over (partition by session_id, ts_ns order by seq desc) = 1""")

_part("tgt", "req hist1 tot1", f"""
    select r.session_id, r.tid, r.ts_ns, r.seq, r.fqdn, r.e2etime, r.is_cold_start,
           coalesce(h.len, 0) as len, coalesce(h.status, '{vocab.INITIAL_STATE}') as status,
           coalesce(t.total, 0) as total
    from req r
    asof left join hist1 h
      on r.session_id = h.session_id and r.fqdn = h.queue and r.ts_ns >= h.ts_ns
    asof left join tot1 t on r.session_id = t.session_id and r.ts_ns >= t.ts_ns""")

_part("docs", "ev", f"""
    select {_base('fqdn')} as base_function, e2etime, seq from ev
    where message = '{vocab.COMPLETE}' and {_base('fqdn')} is not null""")

_part("prof", "docs", """
    select base_function,
           round((sum(e2etime) + 1.5 * count(*)) / (2 * count(*)), 9) as gpu_warm_results_sec,
           round(avg(e2etime), 9) as gpu_cold_results_sec
    from docs group by base_function""")

_part("feat", "tgt run prof", f"""
    select t.session_id, {_case('t.session_id', SESSION_POLICIES)} as policy,
           'load-' || (t.session_id % 3) as workload, t.tid, t.ts_ns as invocation_ts_ns, t.seq,
           strftime(make_timestamp(t.ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%f') as invocation_ts, t.fqdn,
           {_base('t.fqdn')} as base_function, t.e2etime,
           coalesce((t.ts_ns - lag(t.ts_ns) over s) / 1e9, 0.0) as iat,
           coalesce((t.ts_ns - lag(t.ts_ns) over (partition by t.session_id, t.fqdn
                                                  order by t.ts_ns, t.seq)) / 1e9, 0.0) as iat_fqdn,
           r.running as num_running_funcs_filled,
           t.len as target_queue_len, t.status as target_queue_status,
           t.total - t.len as others_len_queue, t.total,
           {_STATUS_FLAGS.replace('{}', 't.status')},
           coalesce(p.gpu_warm_results_sec, 0.0) as gpu_warm_results_sec,
           coalesce(p.gpu_cold_results_sec, 0.0) as gpu_cold_results_sec,
           t.is_cold_start
    from tgt t
    join run r on t.session_id = r.session_id and t.seq = r.seq
    left join prof p on p.base_function = {_base('t.fqdn')}
    window s as (partition by t.session_id order by t.ts_ns, t.seq)""")


def _lag_parts(lags) -> str:
    """A chain of parts, one ASOF join per lag."""
    shifted = ", ".join(
        f"lag(invocation_ts_ns, {k}) over s as back_{k}, "
        f"coalesce(lag(total, {k}) over s, 0) as total_{k}, "
        f"coalesce(lag(num_running_funcs_filled, {k}) over s, 0) as running_{k}"
        for k in lags
    )
    _part(f"shift{len(lags)}", "feat", f"""
        select *, {shifted} from feat
        window s as (partition by session_id order by invocation_ts_ns, seq)""")
    before = f"shift{len(lags)}"
    for k in lags:
        name = f"look{len(lags)}_{k}"
        _part(name, f"{before} hist1", f"""
            select b.*, coalesce(h.len, 0) as target_queue_len_lag_{k},
                   b.total_{k} - coalesce(h.len, 0) as others_len_queue_lag_{k},
                   b.running_{k} as num_running_funcs_filled_lag_{k}
            from {before} b asof left join hist1 h
              on b.session_id = h.session_id and b.fqdn = h.queue and b.back_{k} >= h.ts_ns""")
        before = name
    return before


_LAGGED = _lag_parts(vocab.DEFAULT_LAGS)
_LAGGED_WIDE = _lag_parts(vocab.TRAINING_LAGS)
_LAGGED_ONE = _lag_parts([1])

_part("roll", "ev", f"""
    select session_id, tid, max(gpu_est_total) as gpu_est_total, max(e2etime) as e2etime,
           max(fqdn) as fqdn,
           bool_or(e2etime is not null and coalesce(compute, '') = '{vocab.GPU}') as is_gpu
    from ev group by session_id, tid
    having max(gpu_est_total) is not null and max(e2etime) is not null and max(fqdn) is not null""")

_ERRORS = (
    "abs({0} - {1}) as absolute_error, ({0} - {1}) * ({0} - {1}) as squared_error, "
    "({0} - {1}) / nullif({0}, 0) * 100.0 as percentage_relative_error"
)
_part("err", "roll", f"""
    select session_id, fqdn, tid, e2etime, gpu_est_total,
           {_ERRORS.format('e2etime', 'gpu_est_total')}
    from roll where is_gpu""")

_part("done", "ev", """
    select session_id, tid, fqdn, seq, e2etime from ev where e2etime is not null""")

_part("paths", "raw", f"""
    select seq, '/logs/short/a1/b2/load-' || (session_id % 3 + 1) || '*x/' || user_id || '/'
           || {_case('session_id', SESSION_POLICIES)} || '/c3/d4/'
           || case when user_id % 5 = 0 then 'precleanup/' else '' end || 'worker1.log' as path,
           user_id, session_id
    from raw""")


def sql(needs: str, body: str) -> str:
    """``body`` behind the parts it needs, each part after those it builds on."""
    ordered: list[str] = []

    def add(name):
        for n in PARTS[name][0]:
            add(n)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    parts = ",\n".join(f"{n} as ({PARTS[n][1]})" for n in ordered)
    return f"with {parts}\n{body}" if parts else body


_FEATURES = (
    "session_id, policy, workload, tid, seq, invocation_ts_ns, invocation_ts, fqdn, base_function, e2etime, iat, iat_fqdn, "
    "num_running_funcs_filled, target_queue_len, target_queue_status, others_len_queue, "
    + ", ".join(f'"is_status_{s}"' for s in vocab.QUEUE_STATES)
    + ", gpu_warm_results_sec, gpu_cold_results_sec, is_cold_start"
)


def _lag_columns(lags, names=("target_queue_len", "others_len_queue", "num_running_funcs_filled")):
    return ", ".join(f"{n}_lag_{k}" for k in lags for n in names)


def _bucket(*columns: str) -> str:
    text = " || '|' || ".join(columns)
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint) % 100"


def _histogram(source: str, value: str, bins: int) -> str:
    """Bins by numbers; the last one is closed, and rounding at edges is repaired."""
    return f"""
    , b as (select min({value}) as lo, (max({value}) - min({value})) / {bins} as w from {source}),
    g as (select {value} as v, lo, w, least(floor(({value} - lo) / w), {bins - 1}) as i
          from {source}, b where {value} is not null),
    c as (select (i - (v < i * w + lo)::int
                  + (v >= (i + 1) * w + lo and i < {bins - 1})::int)::int as bin, count(*) as n
          from g group by 1)
    select r.range::int as bin, round(r.range * w + lo, 6) as lower,
           round((r.range + 1) * w + lo, 6) as upper, coalesce(c.n, 0) as n
    from range({bins}) r cross join b left join c on c.bin = r.range"""


def _box(key: str) -> str:
    return sql("done", f"""
    , q as (select {key}, count(*) as n, quantile_cont(e2etime, 0.25) as q25,
                   quantile_cont(e2etime, 0.5) as q50, quantile_cont(e2etime, 0.75) as q75
            from done group by {key})
    select d.{key}, any_value(n) as n, round(any_value(q25), 6) as q25,
           round(any_value(q50), 6) as q50, round(any_value(q75), 6) as q75,
           min(e2etime) filter (where e2etime between q25 - 1.5 * (q75 - q25)
                                                  and q75 + 1.5 * (q75 - q25)) as whisker_low,
           max(e2etime) filter (where e2etime between q25 - 1.5 * (q75 - q25)
                                                  and q75 + 1.5 * (q75 - q25)) as whisker_high,
           count(*) filter (where not (e2etime between q25 - 1.5 * (q75 - q25)
                                                   and q75 + 1.5 * (q75 - q25))) as outliers
    from done d join q on d.{key} = q.{key} group by d.{key}""")


def _describe(source: str, value: str, digits: int) -> str:
    stats = {
        "mean": f"avg({value})", "std": f"stddev_samp({value})", "min": f"min({value})",
        "q25": f"quantile_cont({value}, 0.25)", "q50": f"quantile_cont({value}, 0.5)",
        "q75": f"quantile_cont({value}, 0.75)", "max": f"max({value})",
    }
    cols = ", ".join(f'round({e}, {digits}) as "{n}"' for n, e in stats.items())
    return f'select count({value}) as "count", {cols} from {source}'


_TRACE = "user_id || '-' || event_id"
_WIDE = ", ".join(
    f"coalesce(last_value(case when queue = '{q}' then len end ignore nulls) over w, 0) "
    f"as \"{q}_len\", "
    f"coalesce(last_value(case when queue = '{q}' then status end ignore nulls) over w, "
    f"'{vocab.INITIAL_STATE}') as \"{q}_status\""
    for q in FUNCTIONS
)
_CORR = (
    "round(corr(target_queue_len, e2etime), 6) as corr_target_queue_len_e2etime, "
    "round(corr(others_len_queue, e2etime), 6) as corr_others_len_queue_e2etime"
)
_MEANS = ", ".join(
    f"round(avg({c}), 4) as {c}"
    for c in ("e2etime", "gpu_est_total", "absolute_error", "squared_error",
              "percentage_relative_error")
)
_PATH_RE = "/".join(["([^/]+)"] * 8) + "/worker1[.]log$"


def _path_level(level: int) -> str:
    return f"regexp_extract(path, '{_PATH_RE}', {level})"


_part("train", "feat", """
    select *, ln(1 + e2etime) as log_latency, session_id in (5, 6, 7) as is_test
    from feat where e2etime is not null and num_running_funcs_filled is not null""")

# A depth-1 tree on a 0/1 feature predicts the mean label of each group of the training rows.
_part("stump", "train", """
    select t.*, p.log_mean as predicted_log, exp(p.log_mean) - 1 as rf_prediction
    from train t
    join (select is_cold_start, avg(log_latency) as log_mean from train where not is_test
          group by is_cold_start) p using (is_cold_start)""")

_SCORED = f"""session_id, fqdn, tid, round(e2etime, 4) as e2etime,
    round(rf_prediction, 4) as rf_prediction, round(abs(e2etime - rf_prediction), 4) as absolute_error,
    round((e2etime - rf_prediction) * (e2etime - rf_prediction), 4) as squared_error,
    round((e2etime - rf_prediction) / nullif(e2etime, 0) * 100.0, 4) as percentage_relative_error, is_test"""

_MODEL_INPUTS = [
    *vocab.BASE_FEATURES,
    *[f"{n}_lag_{k}" for k in vocab.DEFAULT_LAGS
      for n in ("target_queue_len", "others_len_queue", "num_running_funcs_filled")],
]

_CAUSAL = (
    _FEATURES.replace("num_running_funcs_filled", "early_running as num_running_funcs_filled")
    .replace("is_cold_start", "(earlier = 0)::int as is_cold_start")
)
_part("early", "ev req", f"""
    select session_id, seq, c + last_value(b ignore nulls) over w - 1 as early_running,
           coalesce(sum(done) over f, 0) as earlier
    from (select *, num_running_funcs - c as b, (message = '{vocab.COMPLETE}')::int as done
          from (select *, sum(case when message = '{vocab.ARRIVAL}' then 1
                                   when message = '{vocab.COMPLETE}' then -1 else 0 end)
                          over (partition by session_id order by ts_ns, seq
                                rows between unbounded preceding and current row)::bigint as c
                from (select e.session_id, e.seq, e.ts_ns, e.message, e.num_running_funcs, e.e2etime,
                             coalesce(r.fqdn, e.fqdn) as fqdn
                      from ev e left join req r on e.session_id = r.session_id and e.seq = r.seq)
                where num_running_funcs is not null or e2etime is not null
                      or message in ('{vocab.START}', '{vocab.ARRIVAL}')))
    window w as (partition by session_id order by ts_ns, seq
                 rows between unbounded preceding and current row),
           f as (partition by session_id, fqdn order by ts_ns, seq
                 rows between unbounded preceding and current row)""")

ORACLES: dict[str, str] = {
    "features_lagged_time": sql(
        _LAGGED, f"select {_FEATURES}, {_lag_columns(vocab.DEFAULT_LAGS)} from {_LAGGED}"
    ),
    "features_lagged_range": sql(
        _LAGGED, f"select {_FEATURES}, {_lag_columns(vocab.DEFAULT_LAGS)} from {_LAGGED}"
    ),
    "features_causal": sql("feat req early", f"select {_CAUSAL} from feat join early using (session_id, seq)"),
    "features_policy": sql("feat", f"""
        select session_id, policy, workload, tid,
               {_flags("replace(policy, '_0.5', '')", "policy", vocab.POLICIES)} from feat"""),
    "table_round_trip": sql("req", f"""
        select session_id, tid, seq, fqdn, e2etime,
               {_case('session_id', SESSION_POLICIES)} as policy from req"""),
    "stored_sessions": sql("req", f"""
        select policy, session_id, tid, seq, fqdn, e2etime
        from (select *, {_case('session_id', SESSION_POLICIES)} as policy from req)
        where session_id between 1 and 6 and session_id <> 2
              and policy in ({", ".join(f"'{p}'" for p in SESSION_POLICIES[:4])})"""),
    "stored_chosen": sql("req", f"""
        , best as (select session_id from req group by session_id
                   order by round(avg(e2etime), 6) desc nulls last, session_id limit 2)
        select {_case('session_id', SESSION_POLICIES)} as policy, session_id, tid, seq, fqdn, e2etime
        from req where session_id in (from best)"""),
    "rejected_lines": """
        select event_id as seq, case when event_id % 17 = 0 then 'no JSON record' else 'no readable time' end as reason,
               case event_id % 17 when 0 then '{"timestamp":"' || left(strftime(ts, '%Y-%m-%d'), 6)
                                  when 1 then '{"level":"INFO","tar' else '{"timestamp":"soon",' end as line_start
        from events where event_id % 17 < 3""",
    "accepted_events": f"""
        select event_id as seq, epoch_us(ts) * 1000 as ts_ns, {_TRACE} as tid, value as e2etime,
               case when event_id % 5 <> 0 then cast(props->>'$.k' as bigint) end as queue_len
        from events where event_id % 17 > 2""",
    "line_counts": """
        select count(*) as lines, count(*) filter (event_id % 17 > 2) as events,
               count(*) filter (event_id % 17 = 0) as not_json, count(*) filter (event_id % 17 in (1, 2)) as no_time
        from events""",
    "catalog_extended": sql("paths", f"""
        , k as (select distinct path, regexp_replace(path, '/worker1[.]log$', '') as session_key, user_id % 2 = 0 as later
                from paths where path not like '%precleanup%')
        select row_number() over (order by later, session_key) - 1 as session_id, session_key,
               {_path_level(1)} as duration, {_path_level(4)} as workload,
               {_path_level(5)} as repetition, {_path_level(6)} as policy
        from k"""),
    "describe_ranked": _describe("lineitem", "l_extendedprice", 4),
    "fold_assignment": sql("req", """
        select session_id, ((dense_rank() over (order by session_id) - 1) % 3)::int as fold
        from (select distinct session_id from req)"""),
    "stump_results": sql("stump", f"select {_SCORED} from stump"),
    "stump_metrics": sql("stump", """
        select is_test, count(*) as n,
               round(1 - sum((log_latency - predicted_log) ** 2)
                     / (var_pop(log_latency) * count(*)), 4) as r2_log,
               round(avg((e2etime - rf_prediction) ** 2), 4) as mse,
               round(avg(abs(e2etime - rf_prediction)), 4) as mae
        from stump group by is_test"""),
    "baseline_fit": sql("train", "select is_test, count(*) as n from train group by is_test"),
    "grid_search": f"""
        select unnest({vocab.FOREST_GRID["numTrees"]}) as "numTrees", "maxDepth", "minInstancesPerNode",
               "featureSubsetStrategy", true as error_is_plausible
        from (select unnest({vocab.FOREST_GRID["maxDepth"]}) as "maxDepth")
        cross join (select unnest({vocab.FOREST_GRID["minInstancesPerNode"]}) as "minInstancesPerNode")
        cross join (select unnest({vocab.FOREST_GRID["featureSubsetStrategy"]}) as "featureSubsetStrategy")""",
    "grid_closed_form": sql("train", """
        , f as (select is_cold_start, log_latency, (dense_rank() over (order by session_id) - 1) % 3 as fold from train),
        folds as (select unnest(range(3)) as held),
        means as (select held, avg(log_latency) as mean from f join folds on fold <> held group by held),
        groups as (select held, is_cold_start, avg(log_latency) as mean from f join folds on fold <> held
                   group by held, is_cold_start),
        errors as (select held, avg((log_latency - m.mean) ** 2) as flat,
                          avg((log_latency - coalesce(g.mean, m.mean)) ** 2) as split
                   from f join means m on fold = m.held
                   left join groups g using (held, is_cold_start) group by held),
        mse as (select avg(flat) as flat, avg(split) as split from errors)
        select t::bigint as "numTrees", d::bigint as "maxDepth", l::bigint as "minInstancesPerNode",
               round(case when d = 1 and l = 1 then split else flat end, 6) as mse
        from mse, (values (1), (2)) a(t), (values (0), (1)) b(d), (values (1), (100000000)) c(l)"""),
    "forest_cells": sql("train", """
        , p as (select is_cold_start, "is_status_Active", avg(log_latency) as log_mean from train where not is_test
                group by all)
        select session_id, tid, is_cold_start, "is_status_Active", round(log_mean, 6) as predicted_log,
               round(exp(log_mean) - 1, 6) as rf_prediction, round((e2etime - (exp(log_mean) - 1)) ** 2, 6) as squared_error
        from train join p using (is_cold_start, "is_status_Active")"""),
    "importance_cells": sql("train", """
        , t as (select is_cold_start as a, "is_status_Active" as b, log_latency as y from train where not is_test),
        -- Sums of squares around the means: of all rows, of the groups of either flag, of the four cells.
        s as (select var_pop(y) * count(*) as everything from t),
        by_a as (select sum(q) as q from (select var_pop(y) * count(*) as q from t group by a)),
        by_b as (select sum(q) as q from (select var_pop(y) * count(*) as q from t group by b)),
        cells as (select sum(q) as q from (select var_pop(y) * count(*) as q from t group by a, b)),
        gains as (select everything - by_a.q as gain_a, everything - by_b.q as gain_b, by_a.q - cells.q as after_a,
                         by_b.q - cells.q as after_b, everything - cells.q as whole
                  from s, by_a, by_b, cells)
        select 'is_cold_start' as feature, round(case when gain_a >= gain_b then gain_a else after_b end / whole, 6) as importance
        from gains
        union all
        select 'is_status_Active', round(case when gain_a >= gain_b then after_a else gain_b end / whole, 6) from gains"""),
    "feature_importance": f"""
        select unnest({_MODEL_INPUTS}) as feature, true as is_share, 1.0::double as total""",
    "scored_results": sql("train", """
        select session_id, fqdn, tid, e2etime, is_test, true as errors_agree from train"""),
    "batch_score": sql("feat", """
        select session_id, tid, num_running_funcs_filled is not null as is_scored from feat"""),
    "features_base": sql("feat", f"select {_FEATURES} from feat"),
    "features_lagged": sql(
        _LAGGED, f"select {_FEATURES}, {_lag_columns(vocab.DEFAULT_LAGS)} from {_LAGGED}"
    ),
    "features_training_lags": sql(
        _LAGGED_WIDE,
        f"select {_FEATURES}, {_lag_columns(vocab.TRAINING_LAGS)} from {_LAGGED_WIDE}",
    ),
    "log_discovery": sql("paths", """
        select distinct path from paths
        where path not like '%precleanup%' and path like '%/Landlord/%'"""),
    "session_catalog": sql("paths", f"""
        select dense_rank() over (order by regexp_replace(path, '/worker1[.]log$', '')) - 1
                 as session_id,
               regexp_replace(path, '/worker1[.]log$', '') as session_key,
               {_path_level(1)} as duration, {_path_level(4)} as workload,
               {_path_level(5)} as repetition, {_path_level(6)} as policy
        from (select distinct path from paths where path not like '%precleanup%')"""),
    "session_numbers": sql("paths", f"""
        select seq, dense_rank() over (order by regexp_replace(path, '/worker1[.]log$', '')) - 1
                 as session_id,
               {_path_level(6)} as policy, {_path_level(4)} as workload
        from paths where path not like '%precleanup%'"""),
    "log_flatten": f"""
        select event_id as seq, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')
                 as timestamp,
               'INFO' as level, 'worker' as target, event_type as message, {_TRACE} as tid,
               case when event_id % 5 <> 0 then props->>'$.k' else 'n/a' end as queue_len_text,
               case when event_id % 2 = 1 then 4 else 5 end as n_fields
        from events""".replace(f"{_TRACE} as tid", f"case when event_id % 2 = 0 then {_TRACE} end as tid"),
    "coerce_fields": """
        select event_id as seq, epoch_us(ts) * 1000 as ts_ns,
               strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts_text, value as e2etime,
               case when event_id % 5 <> 0 then cast(props->>'$.k' as bigint) end as queue_len
        from events""",
    "trace_id": f"select event_id as seq, {_TRACE} as tid from events",
    "function_profile": sql("prof", "select * from prof"),
    "base_function": sql(
        "ev",
        f"select seq, fqdn, {_base('fqdn')} as base_function from ev where fqdn is not null",
    ),
    "status_onehot": sql("ev", f"""
        select seq, new_state, {_STATUS_FLAGS.replace('{}', 'new_state')}
        from ev where message = '{vocab.SWITCH}'"""),
    "policy_onehot": sql("raw", f"""
        select seq, policy, {_flags("replace(policy, '_0.5', '')", "policy", vocab.POLICIES)}
        from (select seq, {_case('session_id', SESSION_POLICIES)} as policy from raw)"""),
    "log_target": sql("raw", """
        select seq, round(ln(1 + value), 6) as log_latency, round(value, 6) as latency
        from raw where event_type = 'purchase'"""),
    "session_subset": sql("raw", """
        select session_id, seq, ts_ns, value from raw where session_id <> 4 and session_id > 1"""),
    "model_rows": sql(_LAGGED_ONE, f"""
        select session_id, tid, round(ln(1 + e2etime), 6) as log_latency from {_LAGGED_ONE}
        where e2etime is not null and num_running_funcs_filled is not null"""),
    "gpu_invocations": sql("ev gpu", """
        select session_id, tid, seq, message from ev semi join gpu using (session_id, tid)"""),
    "cold_start_flag": sql("ev cold", f"""
        select e.session_id, e.tid, e.seq, (c.tid is not null)::int as is_cold_start
        from ev e left join cold c on e.session_id = c.session_id and e.tid = c.tid
        where e.message = '{vocab.ARRIVAL}'"""),
    "arrival_outcome": sql("req", """
        select session_id, tid, ts_ns as invocation_ts_ns, seq, fqdn, e2etime, is_cold_start
        from req"""),
    "profile_join": sql("req prof", f"""
        select session_id, tid, fqdn, r.base_function,
               coalesce(gpu_warm_results_sec, 0.0) as gpu_warm_results_sec,
               coalesce(gpu_cold_results_sec, 0.0) as gpu_cold_results_sec
        from (select *, {_base('fqdn')} as base_function from req) r
        left join prof p on r.base_function = p.base_function"""),
    "queue_asof": sql("ev", f"""
        select p.session_id, p.tid, p.fqdn as queue, p.ts_ns,
               coalesce(s.queue_len, 0) as queue_len,
               coalesce(s.state, '{vocab.INITIAL_STATE}') as new_state
        from (select * from ev where message = '{vocab.ARRIVAL}') p
        asof left join
          (select session_id, queue, ts_ns, queue_len,
                  last_value(new_state ignore nulls) over (partition by session_id, queue
                    order by ts_ns, seq) as state
           from ev where message = '{vocab.SWITCH}') s
          on p.session_id = s.session_id and p.fqdn = s.queue and p.ts_ns >= s.ts_ns"""),
    "estimator_comparison": sql("err stump", """
        select fqdn, round(a.v, 4) as current_relative_error,
               round(b.v, 4) as rf_model_relative_error, round(b.v - a.v, 4) as improvement
        from (select fqdn, avg(percentage_relative_error) as v from err
              where session_id in (select session_id from stump where is_test) group by fqdn) a
        join (select fqdn, avg((e2etime - rf_prediction) / nullif(e2etime, 0) * 100.0) as v
              from stump where is_test group by fqdn) b using (fqdn)"""),
    "iat": sql("feat", "select session_id, tid, iat from feat"),
    "iat_by_key": sql("feat", "select session_id, tid, fqdn, iat_fqdn from feat"),
    "running_fill": sql("run", f"""
        select session_id, tid, seq, running as num_running_funcs_filled from run
        where message = '{vocab.ARRIVAL}'"""),
    "queue_events": sql("chg", "select * from chg"),
    "queue_replay": sql("hist", "select * from hist"),
    "last_per_key": sql("ev", f"""
        select session_id, queue, ts_ns, seq, queue_len, new_state from ev
        where message = '{vocab.SWITCH}'
        qualify row_number() over (partition by session_id, queue
                                   order by ts_ns desc, seq desc) = 1"""),
    "target_queue": sql("tgt", """
        select session_id, tid, fqdn, len as target_queue_len, status as target_queue_status
        from tgt"""),
    "stream_replay": sql("hist", "select session_id, queue, ts_ns, seq, change, len, status, delta from hist"),
    "stream_target_queue": sql("tgt", """
        select session_id, tid, fqdn, len as target_queue_len, status as target_queue_status
        from tgt"""),
    "others_queue": sql("feat", """
        select session_id, tid, target_queue_len, others_len_queue from feat"""),
    "lag_target": sql(_LAGGED, f"""
        select session_id, tid, {_lag_columns(vocab.DEFAULT_LAGS, ["target_queue_len"])}
        from {_LAGGED}"""),
    "lag_global": sql(_LAGGED, f"""
        select session_id, tid,
               {_lag_columns(vocab.DEFAULT_LAGS, ["others_len_queue", "num_running_funcs_filled"])}
        from {_LAGGED}"""),
    "queue_wide": sql("hist req", f"""
        select * exclude (kind, queue, len, status)
        from (select session_id, tid, ts_ns, seq, kind, queue, len, status, {_WIDE}
              from (select session_id, null as tid, ts_ns, seq, 0 as kind, queue, len, status
                    from hist
                    union all select session_id, tid, ts_ns, seq, 1, null, null, null from req)
              window w as (partition by session_id order by ts_ns, kind, seq
                           rows between unbounded preceding and current row))
        where kind = 1"""),
    "current_estimate_errors": sql("err", "select * from err"),
    "invocation_rollup": sql("roll", "select * from roll"),
    "row_errors": sql("roll", f"""
        select session_id, tid, {_ERRORS.format('e2etime', 'gpu_est_total')} from roll"""),
    "error_summary": sql("err", """
        select count(*) as n, round(avg(squared_error), 4) as mse,
               round(avg(absolute_error), 4) as mae,
               round(avg(percentage_relative_error), 4) as mpre,
               round(stddev_samp(gpu_est_total - e2etime), 4) as std_error
        from err"""),
    "error_by_session": sql("err", """
        select session_id, round(avg(absolute_error), 4) as mae,
               round(stddev_samp(gpu_est_total - e2etime), 4) as std_error
        from err group by session_id"""),
    "error_by_key": sql("err", f"select fqdn, {_MEANS} from err group by fqdn"),
    "common_keys": sql("err cold", "select tid from err intersect select tid from cold"),
    "session_sizes": sql("req", """
        select min(n) as min_rows, max(n) as max_rows, round(avg(n), 6) as mean_rows,
               count(*) as sessions
        from (select count(*) as n from req group by session_id)"""),
    "session_means": sql("done", """
        select session_id, round(avg(e2etime), 6) as mean_value from done group by session_id"""),
    "grand_mean": sql("done", """
        select round(avg(m), 6) as grand_mean
        from (select avg(e2etime) as m from done group by session_id)"""),
    "describe": sql("done", _describe("done", "e2etime", 6)),
    "describe_prices": _describe("lineitem", "l_extendedprice", 4),
    "describe_sketched": """
        select count(l_extendedprice) as "count", round(avg(l_extendedprice), 4) as mean,
               round(stddev_samp(l_extendedprice), 4) as std, round(min(l_extendedprice), 4) as "min",
               round(max(l_extendedprice), 4) as "max", true as ranks_within
        from lineitem""",
    "box_sketched": sql("done", """
        select fqdn, count(*) as n, true as ranks_within, true as outliers_agree, true as whiskers_agree
        from done where e2etime is not null group by fqdn"""),
    "quantiles_merged": sql("done", """
        select fqdn, count(*) as n, min(e2etime) as least, max(e2etime) as most, true as ranks_within
        from done where e2etime is not null group by fqdn"""),
    "series_reduced": sql("feat", """
        , known as (select session_id, invocation_ts_ns, seq, tid, e2etime,
                           min(invocation_ts_ns) over s as first, max(invocation_ts_ns) over s as last
                    from feat where e2etime is not null window s as (partition by session_id)),
        parts as (select *, (invocation_ts_ns - first)::hugeint * 10 // (last - first + 1) as part from known),
        placed as (select *,
                          row_number() over (partition by session_id, part order by invocation_ts_ns, seq) as a,
                          row_number() over (partition by session_id, part order by invocation_ts_ns desc, seq desc) as b,
                          row_number() over (partition by session_id, part order by e2etime, invocation_ts_ns, seq) as c,
                          row_number() over (partition by session_id, part order by e2etime desc, invocation_ts_ns, seq) as d
                   from parts)
        select session_id, invocation_ts_ns, seq, tid, e2etime from placed where 1 in (a, b, c, d)"""),
    "scatter_sample": sql("feat", """
        select session_id, tid, others_len_queue, e2etime from feat
        qualify row_number() over (partition by session_id order by md5('=' || session_id || ',=' || tid)) <= 25"""),
    "histogram": sql("done", _histogram("done", "e2etime", 20)),
    "histogram_log": sql(
        "done",
        ", l as (select ln(1 + e2etime) as x from done)" + _histogram("l", "x", 30),
    ),
    "box_summary": _box("fqdn"),
    "box_summary_sessions": _box("session_id"),
    "topk_subset": """
        select o_orderkey, o_custkey, o_totalprice from orders
        where o_custkey in (select o_custkey from orders group by o_custkey
                            order by count(*) desc, o_custkey limit 10)""",
    "value_counts": sql("feat", """
        select others_len_queue, count(*) as n from feat group by others_len_queue"""),
    "value_counts_quantity": """
        select l_quantity, count(*) as n from lineitem group by l_quantity""",
    "correlation": sql("feat", f"select {_CORR} from feat"),
    "correlation_by_session": sql(
        "feat", f"select session_id, {_CORR} from feat group by session_id"
    ),
    "session_series": sql("feat", """
        select invocation_ts_ns, tid, e2etime, others_len_queue from feat where session_id = 0
        order by invocation_ts_ns, seq"""),
    "union_sessions": sql("err done", """
        select session_id, tid, gpu_est_total, null::double as e2etime from err
        union all select session_id, tid, null, e2etime from done"""),
    "distinct_keys": sql("done", "select distinct session_id, fqdn from done"),
    "random_split": sql("req", f"""
        select session_id, tid, {_bucket('session_id', 'tid')} < 20 as is_test from req"""),
    "session_split": sql("req", """
        select session_id, tid, session_id in (5, 6, 7) as is_test from req"""),
    "model_metrics": sql("err", f"""
        , l as (select {_bucket('session_id', 'tid')} < 20 as is_test, ln(1 + e2etime) as y,
                       ln(1 + gpu_est_total) as p, e2etime - gpu_est_total as d
                from err)
        select is_test, count(*) as n,
               round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) as r2_log,
               round(avg(d * d), 4) as mse, round(avg(abs(d)), 4) as mae
        from l group by is_test"""),
    "session_sequences": sql("feat", """
        select session_id, part, count(*) as length,
               string_agg(tid, ',' order by place) as tids,
               sum(target_queue_len)::bigint as sum_target_len
        from (select *, ((place - 1) // 100)::int as part
              from (select *, row_number() over (partition by session_id
                                                 order by invocation_ts_ns, seq) as place
                    from feat))
        group by session_id, part"""),
}

ORACLES["queue_wide_map"] = ORACLES["queue_wide"]
