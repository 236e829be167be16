"""Queries of the search utilities: suppliers' account balance and their parts' price stand for two objectives, one configuration a nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as se
from ..sources import fixtures as fx
from .registry import query

_P = "p as (select c_nationkey k, min(c_acctbal) o1, -max(c_acctbal)+count(*)%7*50.0::double o2, (count(*)%11)::double o3 from customer group by 1)"
OBJS = ["o1", "o2", "o3"]
_DOM = "q.o1<=p.o1 and q.o2<=p.o2 and q.o3<=p.o3 and (q.o1<p.o1 or q.o2<p.o2 or q.o3<p.o3)"
_F = f"{_P}, f as (select * from p where not exists (select 1 from p q where {_DOM}))"


def points(spark, d):
    c = fx.table(spark, d, "customer")
    return c.groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_acctbal").alias("o1"), (-F.max("c_acctbal") + F.count("*") % 7 * 50.0).alias("o2"), (F.count("*") % 11).cast("double").alias("o3"))


@query("opt_pareto", f"with {_F} select k, o1, o2, o3 from f")
def pareto(spark, d):
    return se.pareto(points(spark, d), OBJS)


@query("jn_pareto_dominance", f"with {_P} select p.k, count(q.k) dominated_by from p left join p q on {_DOM} group by p.k")
def dominance(spark, d):
    p = points(spark, d)
    return p.alias("p").join(p.alias("q"), se._dominates(OBJS, "q", "p"), "left").groupBy(F.col("p.k").alias("k")).agg(F.count("q.k").alias("dominated_by"))


@query("opt_fronts", f"with recursive {_P}, r(k, front) as (select k, 0 from p union select p.k, r.front + 1 from r join p q on q.k = r.k join p on {_DOM}) select k, max(front)::int front from r group by k")
def fronts(spark, d):
    """Every configuration's front; the SQL takes the longest chain of dominating points."""
    return se.fronts(points(spark, d), OBJS, "k").select("k", "front")


@query("opt_crowding", f"""with {_F}, g as (select k, {', '.join(f"case when lag({o}) over (order by {o}, k) is null or lead({o}) over (order by {o}, k) is null then 'infinity'::double when max({o}) over () > min({o}) over () then (lead({o}) over (order by {o}, k)-lag({o}) over (order by {o}, k))/(max({o}) over ()-min({o}) over ()) else 0 end g{o}" for o in OBJS)} from f)
 select k, round(go1+go2+go3,6) crowding from g""")
def crowding(spark, d):
    return se.crowding(se.pareto(points(spark, d), OBJS), OBJS, "k").select("k", "crowding")


@query("opt_knee", f"with {_F}, g as (select k, {'+'.join(f'case when max({o}) over () > min({o}) over () then ({o}-min({o}) over ())/(max({o}) over ()-min({o}) over ()) else 0 end' for o in OBJS)} t from f) select k, round(t,6) total from g order by 2, 1 limit 1")
def knee(spark, d):
    return se.knee(points(spark, d), OBJS, "k").select("k", "total")


@query("opt_hypervolume", f"""with {_F}, e as (select {', '.join(f'min({o}) lo_{o}, max({o})+0.1*abs(max({o})) hi_{o}' for o in OBJS)} from f), s as (select i, {', '.join(f"lo_{o}+(hi_{o}-lo_{o})*(('0x'||substr(md5('42:{o}:'||i),1,8))::bigint)/4294967296.0::double s_{o}" for o in OBJS)} from range(2000) t(i), e),
 h as (select count(*) hits from s where exists (select 1 from f where {' and '.join(f'{o}<=s_{o}' for o in OBJS)})) select hits, round(hits/2000*{'*'.join(f'(hi_{o}-lo_{o})' for o in OBJS)},6) hypervolume from h, e""")
def hypervolume(spark, d):
    return se.hypervolume(se.pareto(points(spark, d), OBJS), OBJS)
