"""Common parts of the queries' SQL."""

from __future__ import annotations

BASE = "with pts as (select vec_id, embedding::double[] v, label from embeddings) "


def lloyd(rounds: int, start: str = "select vec_id k, unnest(range(64)) pos, unnest(v) x from pts where vec_id < 8") -> str:
    """Tables c0, a0, e0 .. of unrolled Lloyd rounds: centres, assignments, and exploded points."""
    sql = BASE + f", c0 as ({start})"
    for r in range(rounds + 1):
        sql += f", l{r} as (select k, list(x order by pos) c from c{r} group by k)"
        sql += f", d{r} as (select vec_id, k, sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))) dist from pts, l{r})"
        sql += f", a{r} as (select vec_id, arg_min(k, (dist, k)) k, min(dist) dist from d{r} group by vec_id)"
        sql += f", e{r} as (select a{r}.k k, unnest(range(64)) pos, unnest(v) x from a{r} join pts using (vec_id))"
        sql += f", c{r + 1} as (select c{r}.k k, c{r}.pos pos, coalesce(n.x, c{r}.x) x from c{r} left join (select k, pos, avg(x) x from e{r} group by k, pos) n on n.k = c{r}.k and n.pos = c{r}.pos)"
    return sql + " "


RUNS = """with run_groups as (
  select user_id * 10 + case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end id,
         min(ts) start_ts, max(ts) finish_ts, avg(value) initialization_time, list(value order by event_id) l
  from events group by 1),
run_nodes as (select *, 1 + [1, 2, 4, 8, 16][id % 5 + 1]::bigint nodes from run_groups),
runs as (
  select id, start_ts, finish_ts, initialization_time, nodes,
         case when id % 17 = 0 then 1 else 0 end tracing, case when id % 3 <> 0 then 1 else 0 end dataclay, case when id % 19 = 0 then null when id % 3 = 2 then 1 else 0 end use_split,
         (case when id % 7 = 0 then null when id % 7 = 1 then 0 else 1 end)::bigint copy_fit_struct,
         (case when id % 2 = 0 then 64000 else 3072000 end)::bigint points_per_fragment,
         ((nodes - 1) * case when id % 2 = 0 then 2304 else 48 end)::bigint number_of_fragments,
         case when id % 11 = 0 then null when id % 13 = 0 then []::double[] else l end iteration_time
  from run_nodes) """
