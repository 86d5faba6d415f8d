"""What each report must return, in SQL over the test tables."""

from __future__ import annotations

from ferrybook.plans.reports import DESTINATIONS, EDGES, END, SOURCES, START

FLOWS = """
flows as (
  select s.n_name as source,
         c.n_name as destination,
         o_custkey as user_id,
         cast(o_orderdate as date) as event_day,
         cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))
              as decimal(18,4)) as amount
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join nation c on c_nationkey = c.n_nationkey
  join supplier on l_suppkey = s_suppkey
  join nation s on s_nationkey = s.n_nationkey
  where s.n_nationkey <> c.n_nationkey
)"""

VOLUME = "cast(sum(amount) as decimal(38,4)) as volume"
COUNTS = f"count(*) as transfers, count(distinct user_id) as users, {VOLUME}"
RUNNING = "rows between unbounded preceding and current row"


def _start(unit: str) -> str:
    return f"cast(date_trunc('{unit}', event_day) as date)"


def _volumes(unit: str) -> str:
    return f"sums as (select {_start(unit)} as period, {VOLUME} from flows group by 1)"


def _list(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{name}'" for name in names)


CALENDAR = """
calendar as (
  select cast(unnest(generate_series(min(event_day), max(event_day), interval 1 day)) as date)
         as period
  from flows
)"""

CHOSEN_DAYS = f"event_day >= date '{START}' and event_day < date '{END}'"


def _by_period(unit: str) -> str:
    return f"with {FLOWS} select {_start(unit)} as period, {COUNTS} from flows group by 1"


def _cumulative(unit: str) -> str:
    return f"""
with {FLOWS}, {_volumes(unit)}
select period, volume,
       case when period is not null then
         cast(sum(volume) over (partition by period is null order by period {RUNNING})
              as decimal(38,4)) end as cumulative_volume
from sums"""


def _calendar(unit: str) -> str:
    return f"""
calendar as (
  select cast(unnest(generate_series(date_trunc('{unit}', min(event_day)),
                                     date_trunc('{unit}', max(event_day)), interval 1 {unit}))
              as date) as period
  from flows)"""


def _by_period_filled(unit: str) -> str:
    return f"""
with {FLOWS}, {_calendar(unit)}
select period, count(source) as transfers, count(distinct user_id) as users,
       cast(coalesce(sum(amount), 0) as decimal(38,4)) as volume
from calendar left join flows on period = {_start(unit)}
group by period"""


def _trailing(days: int) -> str:
    return f"""
with {FLOWS}, sums as (select event_day, {VOLUME} from flows group by 1), recent as (
  select event_day, volume,
         cast(sum(volume) over (order by event_day
              range between interval {days - 1} days preceding and current row)
              as decimal(38,4)) as trailing_volume
  from sums)
select *, cast(trailing_volume as double) / {days} as trailing_mean from recent"""


def _top_routes(where: str) -> str:
    return f"""
with {FLOWS}, routes as (
  select source, destination, count(*) as transfers, {VOLUME}
  from flows where {where} group by source, destination)
select row_number() over (order by volume desc, source, destination) as rank,
       source, destination, transfers, volume,
       round(cast(volume as double)
             / nullif(cast((select sum(volume) from routes) as double), 0), 10)
         as share
from routes
order by volume desc, source, destination
limit 10"""


def _new_vs_returning(unit: str) -> str:
    return f"""
with {FLOWS}, active as (select distinct user_id, {_start(unit)} as period from flows),
firsts as (select user_id, min(period) as first from active group by user_id)
select period,
       count(*) filter (where period = first) as new_users,
       count(*) filter (where period <> first) as returning_users
from active join firsts using (user_id)
group by period"""


def _bands() -> str:
    lows = [None, *EDGES]
    highs = [*EDGES, None]
    return ", ".join(
        f"({i}, {'null' if low is None else low}, {'null' if high is None else high})"
        for i, (low, high) in enumerate(zip(lows, highs))
    )


def report_sql() -> dict[str, str]:
    return {
        "flows": f"with {FLOWS} select * from flows",
        "filter_flows": f"""
with {FLOWS}
select * from flows
where {CHOSEN_DAYS} and source in ({_list(SOURCES)}) and destination in ({_list(DESTINATIONS)})""",
        "totals": f"""
with {FLOWS}
select {COUNTS},
       cast(median(cast(amount as double)) as decimal(20,5)) as median_amount
from flows""",
        "by_day": _by_period("day"),
        "by_day_filled": f"""
with {FLOWS}, {CALENDAR}
select period, count(source) as transfers, count(distinct user_id) as users,
       cast(coalesce(sum(amount), 0) as decimal(38,4)) as volume
from calendar left join flows on period = event_day
group by period""",
        "as_flows": """
select l_returnflag as source, l_linestatus as destination, l_suppkey as user_id,
       cast(l_shipdate as date) as event_day, cast(l_extendedprice as decimal(18,4)) as amount
from lineitem""",
        "by_week_filled": _by_period_filled("week"),
        "by_month_filled": _by_period_filled("month"),
        "cumulative_day_filled": f"""
with {FLOWS}, {_calendar("day")}, sums as (
  select period, cast(coalesce(sum(amount), 0) as decimal(38,4)) as volume
  from calendar left join flows on period = event_day
  group by period)
select period, volume,
       cast(sum(volume) over (order by period {RUNNING}) as decimal(38,4)) as cumulative_volume
from sums""",
        "by_week": _by_period("week"),
        "by_month": _by_period("month"),
        "cumulative_week": _cumulative("week"),
        "cumulative_month": _cumulative("month"),
        "period_change_day_filled": f"""
with {FLOWS}, {CALENDAR}, sums as (
  select period, cast(coalesce(sum(amount), 0) as decimal(38,4)) as volume
  from calendar left join flows on period = event_day
  group by period)
select period, volume,
       cast(volume - lag(volume) over (partition by period is null order by period) as decimal(38,4)) as change
from sums""",
        "period_change_month": f"""
with {FLOWS}, {_volumes("month")}
select period, volume,
       cast(volume - lag(volume) over (partition by period is null order by period) as decimal(38,4)) as change
from sums""",
        "trailing_volume_7": _trailing(7),
        "trailing_volume_30": _trailing(30),
        "top_routes": _top_routes("true"),
        "top_routes_filtered": _top_routes(f"{CHOSEN_DAYS} and source in ({_list(SOURCES)})"),
        "net_flow": f"""
with {FLOWS}, entries as (
  select source as place, amount as outgoing, 0 as incoming from flows
  union all
  select destination, 0, amount from flows)
select place,
       cast(sum(outgoing) as decimal(38,4)) as outflow,
       cast(sum(incoming) as decimal(38,4)) as inflow,
       cast(sum(incoming) - sum(outgoing) as decimal(38,4)) as net
from entries group by place""",
        "new_vs_returning_week": _new_vs_returning("week"),
        "new_vs_returning_month": _new_vs_returning("month"),
        "size_buckets": f"""
with {FLOWS}, bands (band, low, high) as (values {_bands()})
select cast(band as bigint) as band,
       cast(low as decimal(18,4)) as low, cast(high as decimal(18,4)) as high,
       count(*) as transfers, {VOLUME}
from flows join bands
  on (low is null or amount >= low) and (high is null or amount < high)
group by band, low, high""",
        "route_rollup": f"""
with {FLOWS}
select source, destination, count(*) as transfers, {VOLUME},
       cast(grouping(source) as bigint) as all_sources,
       cast(grouping(destination) as bigint) as all_destinations
from flows group by rollup (source, destination)""",
        "route_median": f"""
with {FLOWS}
select source, destination,
       cast(median(cast(amount as double)) as decimal(20,5)) as median_amount
from flows group by source, destination""",
    }
