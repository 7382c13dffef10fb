"""The same queries as SQL for DuckDB. Written from the definitions, not from the Spark plans:
plain windows and theta joins where the Spark side uses runs, cells and merges."""

from __future__ import annotations

from tideline.plans.catalog import CHAIN_FAN, CUT, CUTS, FAULTS_UNTIL, SLICE

EV = """ev as (
  select event_id, user_id, ts, epoch_us(ts) as ts_us, event_type as kind,
         cast(value as decimal(18,2)) as amount,
         cast(json_extract_string(props, '$.k') as integer) as k
  from events)"""

OBS = EV + """,
obs as (
  select event_id, user_id, ts, ts_us, kind,
         cast(amount + case when event_id % 101 = 5 then 1 else 0 end as decimal(18,2)) as amount, k
  from ev where event_id % 97 <> 13
  union all
  select event_id, user_id, ts, ts_us, kind,
         cast(amount + case when event_id % 101 = 5 then 1 else 0 end as decimal(18,2)) as amount, k
  from ev where event_id % 97 <> 13 and event_id % 89 = 7
  union all
  select event_id + 1000000000, user_id, ts + interval 1 second, ts_us + 1000000, kind, amount, k
  from ev where event_id % 211 = 3),
obs1 as (select distinct * from obs)"""


def incidents(gap: str = "24 hours", name: str = "inc") -> str:
    return f"""{name}_f as (
  select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id)
         <= interval '{gap}' then 0 else 1 end as f
  from ev where kind = 'error'),
{name}_n as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding)
  as incident_no from {name}_f),
{name} as (
  select user_id, cast(incident_no as bigint) as incident_no, min(ts) as start_ts, max(ts) as end_ts,
         epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us, count(*) as n_errors
  from {name}_n group by user_id, incident_no)"""


INC = EV + ",\n" + incidents()

TIMELINE = INC + """,
tl as (
  select i.user_id, i.incident_no, i.start_ts, i.end_ts, e.event_id, e.ts, e.ts_us, e.kind,
         e.amount, e.k, e.ts_us - i.start_us as offset_us
  from ev e join inc i on e.user_id = i.user_id
   and e.ts >= i.start_ts - interval '1 hour' and e.ts <= i.end_ts + interval '1 hour')"""

STATE = """count(*) as n, cast(sum(amount) as varchar) as amount,
         arg_max(kind, (ts_us, event_id)) as last_kind, max(ts_us) as last_ts_us,
         arg_max(event_id, (ts_us, event_id)) as last_event_id"""

SNAPS = """cells as (
  select user_id, time_bucket(interval '1 day', ts) + interval '1 day' as cut_ts, count(*) as c,
         sum(amount) as s, arg_max(kind, (ts_us, event_id)) as last_kind,
         max(ts_us) as last_ts_us, arg_max(event_id, (ts_us, event_id)) as last_event_id
  from ev group by all),
snaps as (
  select user_id, cut_ts, cast(sum(c) over w as bigint) as n,
         cast(cast(sum(s) over w as decimal(38,2)) as varchar) as amount,
         last_kind, last_ts_us, last_event_id
  from cells window w as (partition by user_id order by cut_ts rows unbounded preceding))"""

POINTS = INC + ",\n" + SNAPS + """,
targets as (select user_id, max(start_ts) as target_ts from inc group by user_id),
points as (
  select t.user_id, t.target_ts, s.cut_ts, s.n, s.amount, s.last_kind, s.last_ts_us,
         s.last_event_id
  from targets t left join snaps s on s.user_id = t.user_id and s.cut_ts <= t.target_ts
  qualify row_number() over (partition by t.user_id order by s.cut_ts desc nulls last) = 1)"""


def field(c: str) -> str:
    t = f"length({c}) || ':' || {c}" if c == "kind" else f"cast({c} as varchar)"
    return f"coalesce({t}, 'N')"


def canonical(*cols: str) -> str:
    return " || '|' || ".join(field(c) for c in cols)


def fingerprint(*cols: str) -> str:
    return f"cast(('0x' || substr(md5({canonical(*cols)}), 1, 15)) as hugeint)"


CONTENT = ("user_id", "ts_us", "kind", "amount")
EVENT = ("event_id", *CONTENT)
EVENT_SQL = ", ".join(EVENT)

CHAIN = f"""seqs as (
  select *, row_number() over (partition by user_id order by ts, event_id) as seq from ev),
leaves as (
  select user_id, (seq - 1) // {CHAIN_FAN} as seg,
         list_reduce(list(event_id || '|' || kind order by seq), lambda a, x: sha256(a || '|' || x),
                     '') as head
  from seqs group by all),
chains as (
  select user_id, case when count(*) = 1 then min(head) else
         list_reduce(list(head order by seg), lambda a, x: sha256(a || '|' || x), '') end as chain
  from leaves group by user_id)"""

PAIRS = OBS + """,
pairs as (
  select coalesce(e.event_id, o.event_id) as event_id, coalesce(e.user_id, o.user_id) as user_id,
         case when o.event_id is null then 'missing' when e.event_id is null then 'extra'
              when (e.user_id, e.ts_us, e.kind, e.amount) = (o.user_id, o.ts_us, o.kind, o.amount)
              then 'match' else 'altered' end as status,
         e.user_id as eu, e.ts_us as et, e.kind as ek, e.amount as ea, o.amount as oa
  from ev e full join obs1 o on e.event_id = o.event_id)"""

PART = OBS + f""",
part as (
  select * from obs where ts < timestamp '{FAULTS_UNTIL}'
  union all select * from ev where ts >= timestamp '{FAULTS_UNTIL}')"""

DIFF = """d as (
  select {cols}, sum(a) as only_a, sum(b) as only_b, sum(c) as shared from (
    select *, 1 as a, 0 as b, 0 as c from (select {cols} from {x} except all select {cols} from {y})
    union all
    select *, 0, 1, 0 from (select {cols} from {y} except all select {cols} from {x})
    union all
    select *, 0, 0, 1 from (select {cols} from {x} intersect all select {cols} from {y}))
  group by all)"""

DIFF_OUT = """select event_id, user_id, ts_us, kind, cast(amount as varchar) as amount,
  cast(only_a as bigint) as only_a, cast(only_b as bigint) as only_b,
  cast(shared as bigint) as shared from d"""

TTR = """ttr as (
  select i.user_id, i.incident_no, i.end_ts, min(e.ts) as recovered_ts,
         min(e.ts_us) - i.end_us as recovery_us
  from inc i left join ev e on e.user_id = i.user_id and e.kind <> 'error' and e.ts > i.end_ts
  group by i.user_id, i.incident_no, i.end_ts, i.end_us)"""

LEAVES = f"""la as (select date_trunc('month', ts)::date as m, ts::date as d, ts_us - ts_us % 3600000000 as h,
  (user_id % 16)::int as s, count(*) as n, sum({fingerprint(*EVENT)}) as g from ev group by all),
lb as (select date_trunc('month', ts)::date as m, ts::date as d, ts_us - ts_us % 3600000000 as h,
  (user_id % 16)::int as s, count(*) as n, sum({fingerprint(*EVENT)}) as g from part group by all),
leaves as (select coalesce(la.m, lb.m) as trunc_month, coalesce(la.d, lb.d) as day, coalesce(la.h, lb.h) as hour,
  coalesce(la.s, lb.s) as share, la.n is distinct from lb.n or la.g is distinct from lb.g as differs
  from la full join lb on la.h = lb.h and la.s = lb.s)"""

ORACLE: dict[str, str] = {
    "read_events": "select event_id, ts, user_id, event_type, value, props from events",

    "parse_quarantine": """
select event_id, case event_id % 50 when 1 then 'not an event' when 2 then 'no user_id'
  else 'ok' end as reason from events""",

    "stream_quarantine": """
select event_id, case event_id % 50 when 1 then null when 2 then -1 else user_id end as user_id,
  case event_id % 50 when 1 then 'not an event' else 'ok' end as reason from events""",

    "write_timeline": f"""with {TIMELINE}
select cast(start_ts as date) as incident_date, user_id, incident_no, event_id,
  cast(amount as varchar) as amount, offset_us from tl""",

    "idempotent_sink": "select event_id, user_id, event_type as kind from events",

    "canonical_events": f"""with {EV}
select event_id, user_id, ts, ts_us, kind, cast(amount as varchar) as amount, k from ev""",

    "dedupe_events": f"""with {OBS}
select event_id, user_id, ts, ts_us, kind, cast(amount as varchar) as amount, k from obs
qualify row_number() over (partition by event_id order by ts) = 1""",

    "total_order": f"""with {EV}
select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as seq
from ev""",

    "out_of_order_audit": f"""with {EV},
arr as (select *, event_id + case when event_id % 53 = 11 then 500 else 0 end as arrival from ev),
run as (select *, max(ts_us) over (order by arrival, event_id
  rows between unbounded preceding and 1 preceding) as m from arr)
select event_id, user_id, ts, arrival, m - ts_us as late_us, m - ts_us > 3600000000 as beyond_lateness
from run where ts_us < m""",

    "sequence_gaps": """
with t as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as p
  from conversations where (conv_id * 31 + turn) % 7 <> 0)
select conv_id, p + 1 as missing_from, turn - 1 as missing_to, turn - p - 1 as missing
from t where turn - p > 1""",

    "duplicate_report": f"""with {OBS}
select event_id, count(*) as copies from obs group by event_id having count(*) > 1""",

    "replay_slice": f"""with {EV}
select event_id, user_id, ts, ts_us, kind, cast(amount as varchar) as amount, k from ev
where ts >= timestamp '{SLICE[0]}' and ts < timestamp '{SLICE[1]}'
  and kind in ('error', 'purchase')
  and user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",

    "enrich_entity": """
select event_id, user_id, event_type as kind, c_mktsegment as segment, n_name as nation,
  r_name as region
from events left join customer on user_id = c_custkey left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey""",

    "detect_incidents": f"with {INC} select * from inc",

    "incident_sessions": f"with {INC} select user_id, start_ts, end_ts, n_errors from inc",

    "incident_timeline": f"""with {TIMELINE}
select * replace (cast(amount as varchar) as amount) from tl""",

    "incident_summary": f"""with {TIMELINE}
select user_id, incident_no, start_ts, end_ts, count(*) as n_events,
  count(*) filter (kind = 'click') as n_click, count(*) filter (kind = 'error') as n_error,
  count(*) filter (kind = 'purchase') as n_purchase,
  count(*) filter (kind = 'signup') as n_signup, count(*) filter (kind = 'view') as n_view,
  cast(sum(amount) as varchar) as amount,
  date_diff('microsecond', start_ts, end_ts) as duration_us
from tl group by user_id, incident_no, start_ts, end_ts""",

    "incident_path": f"""with {TIMELINE},
seqs as (select event_id, row_number() over (partition by user_id order by ts, event_id) as seq
  from ev)
select user_id, incident_no, min(seq) as from_seq, count(*) as n_events,
  string_agg(kind, '>' order by ts, event_id) as path
from (select *, min(seq) over (partition by user_id, incident_no) as b from tl join seqs using (event_id))
group by user_id, incident_no, (seq - b) // 1024""",

    "precursor_event": f"""with {EV},
p as (
  select *,
    last_value(case when kind <> 'error' then event_id end ignore nulls) over w as prior_id,
    last_value(case when kind <> 'error' then kind end ignore nulls) over w as prior_kind,
    last_value(case when kind <> 'error' then ts_us end ignore nulls) over w as prior_us
  from ev window w as (partition by user_id order by ts, event_id
                       rows between unbounded preceding and 1 preceding))
select event_id, user_id, ts, prior_id, prior_kind, ts_us - prior_us as since_us
from p where kind = 'error'""",

    "time_to_recovery": f"with {INC}, {TTR} select * from ttr",

    "merge_overlapping": f"""with {EV}, {incidents('6 hours', 'sh')},
c as (select * from sh where n_errors >= 2),
m as (select *, max(end_ts) over (order by start_ts, end_ts, user_id
  rows between unbounded preceding and 1 preceding) as open_until from c),
g as (select *, sum(case when open_until is null or start_ts > open_until then 1 else 0 end)
  over (order by start_ts, end_ts, user_id rows unbounded preceding) as outage_no from m)
select cast(outage_no as bigint) as outage_no, min(start_ts) as start_ts, max(end_ts) as end_ts,
  count(*) as n_incidents, cast(sum(n_errors) as bigint) as n_errors
from g group by outage_no""",

    "concurrent_incidents": f"""with {INC},
b as (select start_ts as at_ts, 0 as side from inc union all select end_ts, 1 from inc),
c as (select at_ts, side, count(*) as changes from b group by at_ts, side)
select at_ts, cast(side as bigint) as side, changes,
  cast(sum(case when side = 0 then changes else -changes end)
       over (order by at_ts, side rows unbounded preceding) as bigint) as open_incidents from c""",

    "error_rate_tumbling": f"""with {EV}
select time_bucket(interval '1 hour', ts) as window_start, count(*) as n_events,
  count(*) filter (kind = 'error') as n_errors,
  count(*) filter (kind = 'error') / count(*) as error_share
from ev group by time_bucket(interval '1 hour', ts)""",

    "error_rate_sliding": f"""with {EV}
select time_bucket(interval '15 minutes', ts) - to_minutes(15 * o.i) as window_start,
  count(*) as n_events, count(*) filter (kind = 'error') as n_errors,
  count(*) filter (kind = 'error') / count(*) as error_share
from ev, (values (0), (1), (2), (3)) o(i) group by 1""",

    "error_burst": f"""with {EV},
b as (select *, count(*) filter (kind = 'error') over (partition by user_id order by ts
  range between interval '1 day' preceding and current row) as errors_in_width from ev)
select event_id, user_id, ts, kind, errors_in_width from b where errors_in_width >= 3""",

    "state_spans": f"""with {EV},
s as (select *, case when kind <> 'error' then 'healthy'
    when lag(kind) over (partition by user_id order by ts, event_id) = 'error' then 'failed'
    else 'degraded' end as state from ev),
c as (select *, lag(state) over (partition by user_id order by ts, event_id) as p from s)
select user_id, state, event_id as first_event_id, ts as start_ts,
  lead(ts) over (partition by user_id order by ts, event_id) as end_ts
from c where p is null or p <> state""",

    "event_transitions": f"""with {EV},
p as (select kind, lag(kind) over (partition by user_id order by ts, event_id) as prior_kind from ev)
select prior_kind, kind, count(*) as n from p where prior_kind is not null group by all""",

    "daily_rollup": f"""with {EV}, d as (select cast(ts as date) as day, kind from ev)
select day, kind, count(*) as n, cast(grouping(day, kind) as bigint) as level
from d group by rollup (day, kind)""",

    "recovery_percentiles": f"""with {INC}, {TTR}
select round(quantile_cont(recovery_us, 0.5), 2) as p50_us,
  round(quantile_cont(recovery_us, 0.9), 2) as p90_us,
  round(quantile_cont(recovery_us, 0.99), 2) as p99_us from ttr""",

    "worst_incidents": f"""with {INC},
r as (select cast(start_ts as date) as start_day, row_number() over (
    partition by cast(start_ts as date) order by n_errors desc, user_id, incident_no) as rank,
  user_id, incident_no, n_errors from inc)
select * from r where rank <= 3""",

    "timeline_grid": f"""with {EV},
g as (select unnest(generate_series(time_bucket(interval '1 hour', min(ts)),
    time_bucket(interval '1 hour', max(ts)), interval '1 hour')) as window_start from ev)
select window_start, count(ts) as n_errors
from g left join ev on kind = 'error' and time_bucket(interval '1 hour', ts) = window_start
group by window_start""",

    "overlapping_incidents": f"""with {INC}
select a.user_id, a.incident_no, a.start_ts, a.end_ts, count(b.user_id) as n_overlapping
from inc a left join inc b on a.user_id <> b.user_id
 and a.start_ts <= b.end_ts and b.start_ts <= a.end_ts
group by a.user_id, a.incident_no, a.start_ts, a.end_ts""",

    "replay_running_state": f"""with {EV}
select event_id, user_id, ts, count(*) over w as n, cast(sum(amount) over w as varchar) as amount,
  kind as last_kind
from ev window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",

    "replay_as_of": f"""with {EV}
select user_id, {STATE} from ev where ts < timestamp '{CUT}' group by user_id""",

    "replay_final_state": f"with {EV} select user_id, {STATE} from ev group by user_id",

    "snapshots": f"with {EV}, {SNAPS} select * from snaps",

    "extended_snapshots": " union all ".join(
        f"(with {EV} select timestamp '{cut}' as cut_ts, user_id, {STATE} from ev "
        f"where ts < timestamp '{cut}' group by user_id)" for cut in CUTS),

    "recover_state": f"with {EV} select user_id, {STATE} from ev group by user_id",

    "recovery_point": f"with {POINTS} select * from points",

    "tail_events": f"""with {POINTS}
select e.event_id, e.user_id, e.ts, e.ts_us, e.kind, cast(e.amount as varchar) as amount, e.k
from ev e join points p on e.user_id = p.user_id
where (p.cut_ts is null or e.ts >= p.cut_ts) and e.ts < p.target_ts""",

    "repair_log": f"""with {PAIRS}
select event_id, eu as user_id, et as ts_us, ek as kind, cast(ea as varchar) as amount,
  case status when 'missing' then 'added' when 'altered' then 'restored' else 'kept' end as action
from pairs where status <> 'extra'""",

    "fold_events": f"""with {EV},
s as (select user_id, kind, ts, sum(case when kind <> 'error' then 1 else 0 end)
  over (partition by user_id order by ts, event_id rows unbounded preceding) as g from ev),
r as (select user_id, g, count(*) filter (kind = 'error') as l, count(*) as c from s group by all)
select user_id, cast(sum(c) as bigint) as n, max(l) as longest from r group by user_id""",

    "fold_events_py": f"""with {EV},
s as (select user_id, kind, amount, sum(case when kind = 'error' then 1 else 0 end)
  over (partition by user_id order by ts, event_id rows unbounded preceding) as g from ev),
r as (select user_id, g, coalesce(sum(amount) filter (kind <> 'error'), 0) as a,
  count(*) filter (kind = 'error') as e from s group by all)
select user_id, cast(max(a) * 100 as bigint) as best, cast(sum(e) as bigint) as errors
from r group by user_id""",

    "row_digest": f"""with {EV}, z as (select * replace (nullif(k, 0) as k) from ev)
select event_id, sha256({canonical(*EVENT, "k")}) as digest from z""",

    "multiset_digest": f"""with {OBS}
select user_id, count(*) as n, cast(sum({fingerprint(*EVENT)}) as varchar) as digest
from obs group by user_id""",

    "ordered_digest": f"""with {EV},
s as (select *, row_number() over (partition by user_id order by ts, event_id) as seq from ev)
select user_id, count(*) as n, cast(sum({fingerprint("seq", *EVENT)}) as varchar) as digest
from s group by user_id""",

    "hash_chain": f"with {EV}, {CHAIN} select * from chains",

    "reconcile_events": f"""with {PAIRS}
select event_id, user_id, status, cast(ea as varchar) as expected_amount,
  cast(oa as varchar) as observed_amount from pairs""",

    "first_divergence": f"""with {PAIRS},
re as (select event_id, user_id, ts_us, kind, count(*) over w as n, sum(amount) over w as s
  from ev window w as (partition by user_id order by ts_us, event_id rows unbounded preceding)),
ro as (select event_id, user_id, ts_us, kind, count(*) over w as n, sum(amount) over w as s
  from obs1 window w as (partition by user_id order by ts_us, event_id rows unbounded preceding)),
f as (
  select coalesce(re.user_id, ro.user_id) as user_id, coalesce(re.event_id, ro.event_id) as event_id,
         coalesce(re.ts_us, ro.ts_us) as ts_us
  from re full join ro on re.user_id = ro.user_id and re.event_id = ro.event_id
  where (re.n, re.s, re.kind) is distinct from (ro.n, ro.s, ro.kind)
  qualify row_number() over (partition by coalesce(re.user_id, ro.user_id)
    order by coalesce(re.ts_us, ro.ts_us), coalesce(re.event_id, ro.event_id)) = 1)
select f.user_id, f.event_id, make_timestamp(f.ts_us) as ts, p.status,
  (select count(*) from ev e where e.user_id = f.user_id
    and (e.ts_us, e.event_id) <= (f.ts_us, f.event_id)) as expected_n,
  (select cast(sum(amount) as varchar) from ev e where e.user_id = f.user_id
    and (e.ts_us, e.event_id) <= (f.ts_us, f.event_id)) as expected_amount,
  (select count(*) from obs1 e where e.user_id = f.user_id
    and (e.ts_us, e.event_id) <= (f.ts_us, f.event_id)) as observed_n,
  (select cast(sum(amount) as varchar) from obs1 e where e.user_id = f.user_id
    and (e.ts_us, e.event_id) <= (f.ts_us, f.event_id)) as observed_amount
from f join pairs p using (event_id)""",

    "determinism_check": f"""with {EV}, {CHAIN}
select user_id, chain as digest, cast(3 as bigint) as runs, true as ok from chains""",

    "failure_check": f"""with {EV}, {CHAIN}
select user_id, chain as digest, cast(2 as bigint) as runs, true as ok from chains""",

    "idempotence_check": f"""with {EV}
select user_id, {STATE}, true as ok from ev group by user_id""",

    "snapshot_check": f"""with {EV}
select user_id, {STATE}, true as ok from ev group by user_id""",

    "invariant_report": f"""with {EV}
select 'null_id' as rule, count(*) as checked,
  count(*) filter (event_id is null or user_id is null or ts is null) as violations from ev
union all select 'negative_amount', count(*), count(*) filter (amount < 0) from ev
union all select 'unknown_kind', count(*), count(*) filter (kind is null
  or kind not in ('click', 'error', 'purchase', 'signup', 'view')) from ev
union all select 'bad_payload', count(*), count(*) filter (k is null) from ev
union all select 'amount_over_50', count(*), count(*) filter (amount > 50) from ev
union all select 'unknown_entity', count(*), count(*) filter (c_custkey is null)
  from ev left join customer on user_id = c_custkey""",

    "log_diff": f"""with {OBS}, {DIFF.format(cols=EVENT_SQL, x='ev', y='obs')} {DIFF_OUT}""",

    "bucket_digests": f"""with {PART},
a as (select time_bucket(interval '1 day', ts) as b, count(*) as n,
  sum({fingerprint(*EVENT)}) as g from ev group by 1),
o as (select time_bucket(interval '1 day', ts) as b, count(*) as n,
  sum({fingerprint(*EVENT)}) as g from part group by 1)
select coalesce(a.b, o.b) as bucket_ts, a.n as n_a, o.n as n_b, cast(a.g as varchar) as digest_a,
  cast(o.g as varchar) as digest_b,
  a.n is not distinct from o.n and a.g is not distinct from o.g as ok
from a full join o on a.b = o.b""",

    "digest_tree_levels": f"""with {PART}, {LEAVES},
l as (select trunc_month as m, day as d, hour as h, share as s, differs from leaves)
select 0 as depth, 'month' as level, count(*) as compared, count(*) filter (x) as differing
from (select m, bool_or(differs) as x from l group by m)
union all select 1, 'day', count(*), count(*) filter (x) from (select m, d, bool_or(differs) as x from l
  where m in (select m from l where differs) group by all)
union all select 2, 'hour', count(*), count(*) filter (x) from (select d, h, bool_or(differs) as x from l
  where d in (select d from l where differs) group by all)
union all select 3, 'leaf', count(*), count(*) filter (differs) from l
  where h in (select h from l where differs)""",

    "digest_tree_leaves": f"""with {PART}, {LEAVES}
select day, hour, share from leaves where differs""",

    "bucket_digest_diff": f"""with {PART}, {DIFF.format(cols=EVENT_SQL, x='ev', y='part')}
{DIFF_OUT} where only_a > 0 or only_b > 0""",

    "validation_summary": f"""with {PAIRS}
select 'determinism' as "check", count(distinct user_id) as checked, cast(0 as bigint) as failed,
  true as passed from ev
union all select 'idempotence', count(distinct user_id), 0, true from ev
union all select 'snapshot', count(distinct user_id), 0, true from ev
union all select 'states', count(*), count(*) filter (e is distinct from o),
  count(*) filter (e is distinct from o) = 0 from
  (select user_id, (count(*), sum(amount), max(ts_us), arg_max(event_id, (ts_us, event_id)),
    arg_max(kind, (ts_us, event_id))) as e from ev group by user_id) x full join
  (select user_id, (count(*), sum(amount), max(ts_us), arg_max(event_id, (ts_us, event_id)),
    arg_max(kind, (ts_us, event_id))) as o from obs1 group by user_id) y using (user_id)
union all select 'events', count(*), count(*) filter (status <> 'match'),
  count(*) filter (status <> 'match') = 0 from pairs""",

    "read_events_stream": "select event_id, ts, user_id, event_type, value, props from events",

    "stream_error_rate": f"""with {EV}
select time_bucket(interval '1 hour', ts) as window_start, count(*) as n_events,
  count(*) filter (kind = 'error') as n_errors
from ev group by 1
having time_bucket(interval '1 hour', any_value(ts)) + interval '1 hour'
  <= (select max(ts) from ev) - interval '1 hour'""",

    "stream_incidents": f"""with {INC}
select user_id, start_ts, end_ts, n_errors from inc
where end_ts + interval '24 hours' <= (select max(ts) from ev where kind = 'error')
  - interval '1 hour'""",

    "stream_dedupe": f"""with {OBS}
select distinct event_id, user_id, kind as event_type, cast(amount as double) as value from obs""",

    "stream_replay_state": f"""with {EV}
select event_id, user_id, ts, row_number() over w as n,
  cast(cast(sum(amount) over w as decimal(38,2)) as varchar) as amount, kind as last_kind
from ev
window w as (partition by user_id order by ts_us, event_id rows unbounded preceding)
qualify ts <= date_trunc('millisecond', max(ts) over ()) - interval '1 hour'""",

    "stream_period_state": f"""with {EV},
cells as (
  select user_id, time_bucket(interval '1 hour', ts) + interval '1 hour' as cut_ts, count(*) as c,
         sum(amount) as s, arg_max(kind, (ts_us, event_id)) as last_kind,
         arg_max(event_id, (ts_us, event_id)) as last_event_id
  from ev group by all)
select user_id, cut_ts, cast(sum(c) over w as bigint) as n,
  cast(cast(sum(s) over w as decimal(38,2)) as varchar) as amount, last_kind, last_event_id
from cells where cut_ts <= (select max(ts) from ev) - interval '1 hour'
window w as (partition by user_id order by cut_ts rows unbounded preceding)""",

    "stream_late_audit": f"""with {EV},
p as (select ts, time_bucket(interval '1 hour', ts) as h,
  case when event_id % 53 = 11 then 3
    else (ts_us - min(ts_us) over ()) * 4 // (max(ts_us) over () - min(ts_us) over () + 1) end as part from ev),
m as (select a.part, max(b.ts) - interval '1 hour' as mark
  from (select distinct part from p) a join p b on b.part < a.part group by a.part),
l as (select h, coalesce(h + interval '1 hour' <= mark, false) as late
  from p left join m on p.part = m.part)
select h as window_start, count(*) as n_events, count(*) filter (not late) as n_counted,
  count(*) filter (late) as n_late, true as ok
from l group by h
having h + interval '1 hour' <= (select max(ts) from ev) - interval '1 hour'
  and count(*) filter (not late) > 0""",

    "stream_batch_parity": f"""with {EV}
select time_bucket(interval '1 hour', ts) as window_start, count(*) as n_events,
  count(*) filter (kind = 'error') as n_errors, true as ok
from ev group by 1
having time_bucket(interval '1 hour', any_value(ts)) + interval '1 hour'
  <= (select max(ts) from ev) - interval '1 hour'""",

    "stream_restart": f"""with {EV}
select time_bucket(interval '1 hour', ts) as window_start, count(*) as n_events,
  count(*) filter (kind = 'error') as n_errors
from ev group by 1
having time_bucket(interval '1 hour', any_value(ts)) + interval '1 hour'
  <= (select max(ts) from ev) - interval '1 hour'""",

    "stream_open_windows": f"""with {EV}
select time_bucket(interval '1 hour', ts) as window_start, count(*) as n_events,
  count(*) filter (kind = 'error') as n_errors, true as ok
from ev group by 1
having time_bucket(interval '1 hour', any_value(ts)) + interval '1 hour'
  > (select max(ts) from ev) - interval '1 hour'""",

    "stream_late_metric": f"""with {EV},
p as (select ts, time_bucket(interval '1 hour', ts) + interval '1 hour' as h,
  case when event_id % 53 = 11 then 3
    else (ts_us - min(ts_us) over ()) * 4 // (max(ts_us) over () - min(ts_us) over () + 1) end as part from ev),
k as (select cast(range as int) as delivery from range(4)),
m as (select delivery, max(ts) - interval '1 hour' as mark from k join p on part <= delivery group by delivery),
l as (select p.*, coalesce(h <= mark, false) as late from p left join m on m.delivery = p.part - 1),
c as (select m.delivery, count(*) filter (part = m.delivery) as n_arrived,
    count(*) filter (part = m.delivery and late) as n_late,
    count(*) filter (not late and h <= mark) as closed, count(*) filter (not late and h > mark) as n_open
  from m join l on part <= m.delivery group by m.delivery)
select delivery, n_arrived, closed - coalesce(lag(closed) over (order by delivery), 0) as n_emitted, n_open,
  n_late as n_dropped, n_late as n_listed, true as ok from c""",

    "stream_error_recovery": f"""with {EV},
w as (select date_trunc('millisecond', max(ts)) - interval '1 hour' as mark from ev),
e as (select distinct user_id, ts from ev where kind = 'error'),
r as (select e.user_id, e.ts as error_ts, min(o.ts) as recovered_ts
  from e left join ev o on o.user_id = e.user_id and o.kind <> 'error'
    and o.ts > e.ts and o.ts <= e.ts + interval '1 hour'
  group by e.user_id, e.ts)
select user_id, error_ts, recovered_ts from r
where coalesce(recovered_ts, error_ts + interval '1 hour') <= (select mark from w)""",

    "stream_enrich": """
select event_id, user_id, ts, event_type, c_mktsegment as segment
from events left join customer on user_id = c_custkey""",
}
