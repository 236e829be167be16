"""Queries of the resampling statistics."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import f1, safe_ratio, u32
from ..operators import statistics as st
from ..scratch import Scratch
from ..sources import fixtures as fx
from ..sources.fixtures import with_
from .evaluation import counts, facts
from .registry import query

REPS = 40  #: of the queries that have SQL
FULL, FULL_METRIC = 10_000, 1_000  #: the reference's defaults: of contrasts, and of a metric's interval
_PAIR = """pair as (select note, a.tp tp_a, a.fp fp_a, a.fn fn_a, b.tp tp_b, b.fp fp_b, b.fn fn_b from counts_a a join counts_b b using (note))"""
_D = "round(2*sum({w}tp_a)/(2*sum({w}tp_a)+sum({w}fp_a)+sum({w}fn_a))-2*sum({w}tp_b)/(2*sum({w}tp_b)+sum({w}fp_b)+sum({w}fn_b)),9)"
_W = "(select *, " + "+".join(f"(u>={t})::int" for t in st.POISSON) + " w from (select *, r rep, ('0x'||substr(md5('{seed}:boot:'||r||':'||note),1,8))::bigint u from {t}, range({reps}) t(r)))"
_BOOT = _PAIR + f""", reps as (select rep, {_D.format(w="w*")} d from {_W.format(seed=42, t="pair", reps=REPS)} group by rep)"""


def pairs(spark, d, *cols):
    cols = cols or ("tp", "fp", "fn")
    return st.paired(counts(spark, d, "a").select("note", *cols), counts(spark, d, "b").select("note", *cols))


@query("st_bootstrap_delta", with_("counts_a counts_b", f"with {_BOOT} select count(*) replicates, list_sort(list(d))[least(floor(0.025*count(*)),count(*)-1)::int+1] lo, list_sort(list(d))[least(floor((1-0.025)*count(*)),count(*)-1)::int+1] hi from reps"))
def bootstrap_delta(spark, d, reps=REPS):
    return st.interval(st.bootstrap(pairs(spark, d), reps, 42, {"d": st.delta_f1(9)}), "d")


@query("st_randomization", with_("counts_a counts_b", f"""with {_PAIR}, sw as (select r rep, case when ('0x'||substr(md5('42:swap:'||r||':'||note),1,8))::bigint % 2 = 1 then [tp_b,fp_b,fn_b,tp_a,fp_a,fn_a] else [tp_a,fp_a,fn_a,tp_b,fp_b,fn_b] end v from pair, range({REPS}) t(r)),
 o as (select {_D.format(w="")} o from pair), s as (select rep, round(2*sum(v[1])/(2*sum(v[1])+sum(v[2])+sum(v[3]))-2*sum(v[4])/(2*sum(v[4])+sum(v[5])+sum(v[6])),9) x from sw group by rep)
 select max(o) observed, round((count(*) filter (abs(x)>=abs(o))+1)/(count(*)+1),6) p from s, o"""))
def randomization(spark, d, reps=REPS):
    return st.randomization(pairs(spark, d), reps, 42, 9)


@query("st_note_counts", with_("counts_a", "select * from counts_a"))
def note_counts(spark, d):
    return counts(spark, d)


#: Six cells on the same notes: capacity (small, middle, large) by context (with the note, without).
CELLS = {"3_note": "b", "3_none": "c", "7_note": "a", "7_none": "d", "14_note": "e", "14_none": "f"}
_CELL = ", ".join(f"sum({r}.{c})::bigint {c}_{k}" for k, r in CELLS.items() for c in ("tp", "fp", "fn"))
_CELLS = f"s as (select count(*) notes, {_CELL} from counts_a a " + " ".join(f"join counts_{r} {r} using (note)" for r in "bcdef") + ")"
_F = lambda k: f"2*tp_{k}/(2*tp_{k}+fp_{k}+fn_{k})"
_RUNS = " ".join(f"counts_{r}" for r in "abcdef")


def cells(spark, d, names=tuple(CELLS)):
    """One row a note: its counts in each cell."""
    return st.aligned(fx.run_masks(spark, d, {k: CELLS[k] for k in names}), list(names)).drop("runs")


def did(low: str, high: str, f=st.f1_of, cols=("tp", "fp", "fn")):
    """Simple effects and interaction of a capacity step, and the swaps under which the interaction is exchangeable."""
    e = {c: f(f"{high}_{c}") - f(f"{low}_{c}") for c in ("note", "none")}
    return e["note"], e["none"], e["note"] - e["none"], [st.sides(f"{high}_{c}", f"{low}_{c}", cols) for c in ("note", "none")]


@query("st_did", with_(_RUNS, f"with {_CELLS} select notes shared_notes, round({_F('7_note')}-{_F('3_note')},9) effect_note, round({_F('7_none')}-{_F('3_none')},9) effect_none, round(({_F('7_note')}-{_F('3_note')})-({_F('7_none')}-{_F('3_none')}),8) interaction from s"))
def did_points(spark, d):
    """2 x 2 contrast, point estimates; ``st_did_full`` has the intervals and tests."""
    note, none, both, _ = did("3", "7")
    c = cells(spark, d, ("3_note", "3_none", "7_note", "7_none"))
    sums = c.agg(F.count("*").alias("shared_notes"), *[F.sum(x).alias(x) for x in c.columns if x != "note"])
    return sums.select("shared_notes", F.round(note, 9).alias("effect_note"), F.round(none, 9).alias("effect_none"), F.round(both, 8).alias("interaction"))


@query("st_did_full")
def did_full(spark, d, reps=FULL):
    note, none, both, swaps = did("3", "7", st.f1_by_errors, ("tp", "e"))
    names = ("3_note", "3_none", "7_note", "7_none")
    c = st.errors(cells(spark, d, names), names)
    return st.contrasts(c, {"effect_note": note, "effect_none": none, "interaction": both}, reps, 42, {"interaction": swaps})


@query("st_capacity_curve", with_(_RUNS, f"with {_CELLS} " + " union all ".join(f"select '{k}' cell, notes, round({_F(k)},6) f1, round(tp_{k}/(tp_{k}+fp_{k}),6) p, round(tp_{k}/(tp_{k}+fn_{k}),6) r, round((tp_{k}+fp_{k})/notes,2) codes_per_note from s" for k in CELLS)))
def capacity(spark, d):
    c = cells(spark, d)
    sums = c.agg(F.count("*").alias("notes"), *[F.sum(x).alias(x) for x in c.columns if x != "note"])
    col = lambda x, k: F.col(f"{x}_{k}")
    each = [F.struct(F.lit(k).alias("cell"), F.round(st.f1_of(k), 6).alias("f1"), F.round(safe_ratio(col("tp", k), col("tp", k) + col("fp", k)), 6).alias("p"), F.round(safe_ratio(col("tp", k), col("tp", k) + col("fn", k)), 6).alias("r"), F.round((col("tp", k) + col("fp", k)) / F.col("notes"), 2).alias("codes_per_note")) for k in CELLS]
    return sums.select("notes", F.explode(F.array(*each)).alias("x")).select("x.cell", "notes", "x.f1", "x.p", "x.r", "x.codes_per_note")


_BITS = " + ".join(f"max(case when {k} then {2 << i} else 0 end)" for i, k in enumerate(fx.KEEP.values()))
_SUBSETS = [sum(2 << i for i in c) for n in (2, 4, 6) for c in itertools.combinations(range(6), n)]


@query("jn_run_masks", with_("lines", f"with m as (select note, ({_BITS})::int runs from lines group by note) select s::int subset, bit_count(s::int)::int runs, count(*) notes from m, (values {', '.join(f'({x})' for x in _SUBSETS)}) t(s) where runs & s = s group by s"))
def run_masks(spark, d):
    """How many notes the runs of each pair, each four and all six have in common: one shuffle by note, then sums over masks."""
    own = {r: r for r in fx.KEEP}
    m = st.aligned(fx.run_masks(spark, d, own), list(own)).groupBy("runs").agg(F.count("*").alias("n"))  # 128 masks at most
    s = m.select("runs", "n", F.explode(F.array(*map(F.lit, _SUBSETS))).alias("subset")).where("runs & subset = subset")
    return s.groupBy("subset").agg(F.sum("n").alias("notes")).select("subset", F.bit_count("subset").alias("runs"), "notes")


STEPS = [("3", "7"), ("7", "14"), ("3", "14")]


@query("st_capacity_curve_full")
def capacity_full(spark, d, reps=FULL):
    """Simple effects of context and capacity with intervals, and the interaction of each capacity step with its test.

    Each step is drawn on its own four cells, which far fewer notes tell apart than all six.
    """
    effect = lambda hi, lo: st.f1_by_errors(hi) - st.f1_by_errors(lo)
    c = Scratch(spark, "capacity").save(st.cells_of(st.errors(cells(spark, d), list(CELLS))), "cells")  # one pass over the lines
    out, seen = None, set()
    for a, b in STEPS:
        *_, both, swaps = did(a, b, st.f1_by_errors, ("tp", "e"))
        stats = {f"context_at_{k}": effect(f"{k}_note", f"{k}_none") for k in (a, b) if k not in seen}
        stats |= {f"capacity_{a}_to_{b}_{x}": effect(f"{b}_{x}", f"{a}_{x}") for x in ("note", "none")} | {f"interaction_{a}_to_{b}": both}
        own = c.select("m", *(f"{x}_{k}_{y}" for k in (a, b) for y in ("note", "none") for x in ("tp", "e")))
        one = st.contrasts(own, stats, reps, 42, {f"interaction_{a}_to_{b}": swaps})
        out, seen = one if out is None else out.unionByName(one), seen | {a, b}
    return out


@query("st_paired_report_full")
def paired_report(spark, d, reps=FULL):
    """Differences b - a of F1 and of the discriminative lift on the shared notes."""
    rows = pairs(spark, d, "tp", "fp", "fn", "sg", "st", "ug", "ut")
    return st.contrasts(rows, {"delta_micro_f1": st.f1_of("b") - st.f1_of("a"), "delta_lift": st.lift_of("b") - st.lift_of("a")}, reps, 42, {"delta_micro_f1": [st.sides("a", "b")]})


@query("st_ratio_bootstrap", with_("counts_a counts_b", f"""with pr as (select note, a.sg sg_a, a.st st_a, b.sg sg_b, b.st st_b from counts_a a join counts_b b using (note)),
 reps as (select rep, round(sum(w*sg_a)/sum(w*st_a)-sum(w*sg_b)/sum(w*st_b),9) d from {_W.format(seed=7, t="pr", reps=REPS)} group by rep), o as (select round(sum(sg_a)/sum(st_a)-sum(sg_b)/sum(st_b),9) o from pr)
 select max(o) observed, round((count(*) filter (abs(d-o)>=abs(o))+1)/(count(*)+1),6) centred_p from reps, o"""))
def ratio_bootstrap(spark, d):
    return _centred(pairs(spark, d, "sg", "st"), lambda rows, stats: st.bootstrap(rows, REPS, 7, stats))


def _centred(rows, draw):
    diff = F.round(safe_ratio(F.col("sg_a"), F.col("st_a")) - safe_ratio(F.col("sg_b"), F.col("st_b")), 9)
    seen = rows.agg(*[F.sum(c).alias(c) for c in ("sg_a", "st_a", "sg_b", "st_b")]).select(diff.alias("observed"))
    drawn = draw(rows, {"d": diff})
    return drawn.crossJoin(F.broadcast(seen)).agg(F.max("observed").alias("observed"), F.round((F.count_if(F.abs(F.col("d") - F.col("observed")) >= F.abs("observed")) + 1) / (F.count("*") + 1), 6).alias("centred_p"))


@query("st_metric_bootstrap", with_("counts_a counts_b", f"with {_BOOT} select round(avg(d),8) mean, round(stddev_pop(d),8) std, round(quantile_cont(d,0.025),8) lo, round(quantile_cont(d,0.975),8) hi from reps"))
def metric_bootstrap(spark, d):
    return _spread(st.bootstrap(pairs(spark, d), REPS, 42, {"d": st.delta_f1(9)}))


def _spread(r):
    return r.agg(F.round(F.avg("d"), 8).alias("mean"), F.round(F.stddev_pop("d"), 8).alias("std"), F.round(F.percentile("d", F.lit(0.025)), 8).alias("lo"), F.round(F.percentile("d", F.lit(0.975)), 8).alias("hi"))


GRID = [1, 2, 3, 5, 8, 10, 15, 20, 30, 50]
_FLOOR = """g as (select s.split, gold.note, code from gold join splits s on gold.note=s.note), top as (select code, row_number() over (order by count(*) desc, code)-1 pos from g where split='train' group by code),
 sc as (select sp split, k, (select count(*) from g join top using (code) where g.split=sp and pos<k) tp, (select count(distinct note) from g where g.split=sp) notes, (select count(*) from top where pos<k) used, (select count(*) from g where g.split=sp) tot from (values ('validation'),('test')) s(sp), (values (1),(2),(3),(5),(8),(10),(15),(20),(30),(50)) v(k)),
 f as (select split, k::int k, tp, notes*used-tp fp, tot-tp fn, round(2*tp/(2*tp+notes*used-tp+tot-tp),9) f1 from sc)"""


@query("st_floor_valk", with_("gold splits", f"with {_FLOOR} select k, tp, fp, fn, f1 from f where split='test' and k=(select k from f where split='validation' order by f1 desc, k limit 1)"))
def floor_valk(spark, d):
    """Micro-F1 of the note-blind floor: K chosen on validation notes, scored once on test notes."""
    g = fx.gold(spark, d).withColumn("split", fx.split_of(F.col("subject")))
    part = lambda s: g.where(F.col("split") == s)
    k = st.best(st.floor_scores(part("train"), part("validation"), GRID), "f1", F.col("k")).select("k")
    return st.floor_scores(part("train"), part("test"), GRID).join(F.broadcast(k), "k")  # one row


@query("st_floor_grid", with_("gold splits", f"with {_FLOOR} select k, tp, fp, fn, f1 from f where split='validation'"))
def floor_grid(spark, d):
    g = fx.gold(spark, d).withColumn("split", fx.split_of(F.col("subject")))
    return st.floor_scores(g.where("split = 'train'"), g.where("split = 'validation'"), GRID)


def _floor_pair(spark, d):
    """Counts of the floor (K chosen on validation) and of run a on each test note."""
    g = fx.gold(spark, d).withColumn("split", fx.split_of(F.col("subject")))
    part = lambda s: g.where(F.col("split") == s)
    k = st.best(st.floor_scores(part("train"), part("validation"), GRID), "f1", F.col("k")).select("k")
    top = st.top_labels(part("train")).crossJoin(F.broadcast(k)).where("pos < k").select("code", F.lit(1).alias("hit"))
    used = top.agg(F.count("*").alias("used"))
    n = part("test").join(F.broadcast(top), "code", "left").groupBy("note").agg(F.count("*").alias("g"), F.count("hit").alias("h")).crossJoin(F.broadcast(used))
    floor = n.select("note", F.col("h").alias("tp_b"), (F.col("used") - F.col("h")).alias("fp_b"), (F.col("g") - F.col("h")).alias("fn_b"))
    return counts(spark, d).select("note", F.col("tp").alias("tp_a"), F.col("fp").alias("fp_a"), F.col("fn").alias("fn_a")).join(floor, "note")


@query("st_floor_contrast", with_("gold splits counts_a", f"""with {_FLOOR}, bk as (select k from f where split='validation' order by f1 desc, k limit 1), fl as (select code from top, bk where pos<k),
 n as (select note, count(*) g, count(*) filter (code in (from fl)) h from g where split='test' group by note)
 select round(2*sum(h)/(2*sum(h)+sum((select count(*) from fl)-h)+sum(g-h)),6) floor_f1, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),6) run_f1, count(*) notes from n join counts_a using (note)"""))
def floor_contrast(spark, d):
    p = _floor_pair(spark, d)
    return p.agg(F.count("*").alias("notes"), *[F.sum(c).alias(c) for c in p.columns if c != "note"]).select(F.round(st.f1_of("b"), 6).alias("floor_f1"), F.round(st.f1_of("a"), 6).alias("run_f1"), "notes")


@query("st_floor_contrast_full")
def floor_contrast_full(spark, d, reps=FULL):
    """The floor's lead over run a on test notes, with interval and test."""
    return st.contrasts(_floor_pair(spark, d), {"delta_micro_f1": st.f1_of("b") - st.f1_of("a")}, reps, 42, {"delta_micro_f1": [st.sides("a", "b")]})


@query("st_oracle_random_null", with_("facts_b counts_a", """with p as (select f.*, tp+fp budget, row_number() over (partition by f.note order by in_gold desc, f."rank") o, row_number() over (partition by f.note order by ('0x'||substr(md5('42:null:'||f.note||':'||code),1,8))::bigint, code) r from facts_b f join counts_a a using (note) where in_pred), g as (select note, count(*) g from facts_b where in_gold group by note),
 s as (select note, count(*) filter (in_gold and o<=budget) ho, count(*) filter (in_gold and r<=budget) hr, count(*) filter (o<=budget) e from p group by note), t as (select (select sum(g) from g join counts_a using (note)) gold)
 select round(2*sum(ho)/(sum(e)+max(gold)),6) oracle_f1, round(2*sum(hr)/(sum(e)+max(gold)),6) random_f1, sum(e)::bigint emitted from s, t"""))
def oracle_null(spark, d):
    """Over run b's shortlist, each note with run a's number of codes: gold first, and at random."""
    budget = counts(spark, d, "a").select("note", (F.col("tp") + F.col("fp")).alias("budget"))
    f = facts(spark, d, "b").join(budget, "note")
    p = f.where("in_pred")
    o = F.row_number().over(Window.partitionBy("note").orderBy(F.desc("in_gold"), "rank"))
    r = F.row_number().over(Window.partitionBy("note").orderBy(u32("42:null", F.col("note"), F.col("code")), "code"))
    p = p.withColumn("o", o).withColumn("r", r).agg(F.count_if(F.expr("in_gold and o <= budget")).alias("ho"), F.count_if(F.expr("in_gold and r <= budget")).alias("hr"), F.count_if(F.expr("o <= budget")).alias("emitted"))
    g = f.agg(F.count_if("in_gold").alias("gold"))
    return p.crossJoin(F.broadcast(g)).select(F.round(2 * F.col("ho") / (F.col("emitted") + F.col("gold")), 6).alias("oracle_f1"), F.round(2 * F.col("hr") / (F.col("emitted") + F.col("gold")), 6).alias("random_f1"), "emitted")


@query("st_pruning_nulls", with_("facts_b counts_a", """with n as (select f.note, count(*) filter (in_pred) s, count(*) filter (in_pred and in_gold) h, count(*) filter (in_gold) g, max(tp+fp) k from facts_b f join counts_a a using (note) group by f.note), e as (select *, least(s, k) e from n)
 select count(*) notes, sum(e)::bigint emitted, round(2*sum(least(e,h))/(sum(e)+sum(g)),6) oracle_f1, round(2*sum(case when s>0 then e*h/s else 0 end)/(sum(e)+sum(g)),6) random_f1, round(2*sqrt(sum(case when s>1 then e*(h/s)*(1-h/s)*(s-e)/(s-1) else 0 end))/(sum(e)+sum(g)),6) random_std from e"""))
def pruning_nulls(spark, d):
    """Over run b's shortlist, each note with run a's number of codes: the oracle, and the exact moments of random pruning."""
    budget = counts(spark, d, "a").select("note", (F.col("tp") + F.col("fp")).alias("budget"))
    n = facts(spark, d, "b").groupBy("note").agg(F.count_if("in_pred").alias("shortlist"), F.count_if(F.expr("in_pred and in_gold")).alias("hits"), F.count_if("in_gold").alias("gold"))
    out = st.pruning_nulls(n.join(budget, "note"))
    return out.select("notes", "emitted", *(F.round(c, 6).alias(c) for c in ("oracle_f1", "random_f1", "random_std")))


@query("st_cardinality_sweep", with_("facts_a", """select b budget, round(2*count(*) filter (in_gold and "rank"<=b)/(count(*) filter ("rank"<=b)+count(*) filter (in_gold)),6) f1, count(*) filter ("rank"<=b) emitted from facts_a, (values (1),(2),(3),(4),(5),(8),(10),(15),(999)) v(b) group by b"""))
def sweep(spark, d):
    budgets = F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 5, 8, 10, 15, 999)))).alias("budget")
    # Counts by rank first, so budgets multiply a handful of rows and not the facts.
    by_rank = facts(spark, d).groupBy("rank").agg(F.count_if("in_gold").alias("g"), F.count("*").alias("n"))
    x = by_rank.select("*", budgets).groupBy("budget")
    hit, out, gold = F.sum(F.when(F.col("rank") <= F.col("budget"), F.col("g")).otherwise(0)), F.sum(F.when(F.col("rank") <= F.col("budget"), F.col("n")).otherwise(0)), F.sum("g")
    return x.agg(F.round(2 * hit / (out + gold), 6).alias("f1"), out.alias("emitted"))


_GRID = "(select (i*5)/100.0::double t from range(1, 20) x(i)), (values (1),(2),(3),(5),(8)) c(cap)"


@query("st_split_half", with_("facts_a", f"""with h as (select note%2 half, t, cap, count(*) filter (in_pred and in_gold and (confidence is null or confidence>=t) and "rank"<=cap) tp, count(*) filter (in_pred and (confidence is null or confidence>=t) and "rank"<=cap) e, count(*) filter (in_gold) g from facts_a, {_GRID} group by 1,2,3),
 f as (select half, t, cap, round(2*tp/(e+g),9) f1 from h), b as (select half, t, cap, f1 from f qualify row_number() over (partition by half order by f1 desc, t, cap)=1)
 select b.half tuned_on, b.t, b.cap, b.f1 tuned_f1, f.f1 held_out_f1 from b join f on f.half=1-b.half and f.t=b.t and f.cap=b.cap"""))
def split_half(spark, d):
    """Threshold and cap tuned on one half of the notes, scored on the other; the first best of the grid."""
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3, 5, 8))), lambda c: F.struct((i * 5 / 100.0).alias("t"), c.alias("cap")))))).alias("x")
    # Confidence steps of .05 and ranks are all that the grid can see: facts shrink to those cells first.
    step = F.when(F.col("in_pred"), F.when(F.col("confidence").isNull(), F.lit(99)).otherwise(F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: i * 5 / 100.0), lambda t: F.col("confidence") >= t))))
    cells = facts(spark, d).groupBy((F.col("note") % 2).alias("half"), step.alias("step"), F.least("rank", F.lit(9)).alias("rank"), "in_pred", "in_gold").agg(F.count("*").alias("n"))
    x = cells.select("*", grid).select("*", "x.t", "x.cap")
    kept = F.col("in_pred") & (F.col("step") >= F.round(F.col("t") * 20)) & (F.col("rank") <= F.col("cap"))
    h = x.groupBy("half", "t", "cap").agg(F.sum(F.when(kept & F.col("in_gold"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col("in_gold"), F.col("n")).otherwise(0)).alias("g"))
    f = h.select("half", "t", "cap", F.round(2 * F.col("tp") / (F.col("e") + F.col("g")), 9).alias("f1"))
    b = f.withColumn("r", F.row_number().over(Window.partitionBy("half").orderBy(F.desc("f1"), "t", "cap"))).where("r = 1")
    o = f.select((1 - F.col("half")).alias("half"), "t", "cap", F.col("f1").alias("held_out_f1"))
    return b.join(o, ["half", "t", "cap"]).select(F.col("half").alias("tuned_on"), "t", "cap", F.col("f1").alias("tuned_f1"), "held_out_f1")


@query("st_label_space_trend", with_("facts_a", """with top as (select code, row_number() over (order by count(*) desc, code) r from gold group by code) select n labels, count(distinct note) notes, round(2*count(*) filter (in_gold and in_pred)/(count(*) filter (in_gold)+count(*) filter (in_pred)),6) f1 from facts_a join top using (code), (values (50),(100),(200)) v(n) where r<=n group by n"""))
def trend(spark, d):
    top = st.top_labels(fx.gold(spark, d)).select("code", "pos")
    sizes = F.explode(F.filter(F.array(*map(F.lit, (50, 100, 200))), lambda n: F.col("pos") < n)).alias("labels")
    x = facts(spark, d).join(top, "code").select("note", "in_gold", "in_pred", sizes)
    return x.groupBy("labels").agg(F.countDistinct("note").alias("notes"), F.round(2 * F.count_if(F.expr("in_gold and in_pred")) / (F.count_if("in_gold") + F.count_if("in_pred")), 6).alias("f1"))


@query("st_arm_summary", with_("counts_a", "select count(*) n, round(sum(tp)/sum(tp+fp),4) p, round(sum(tp)/sum(tp+fn),4) r, round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),4) f1, round(sum(tp+fp)/count(*),2) codes_per_note, round((sum(sg)/sum(st))/(sum(ug)/sum(ut)),4) lift from counts_a"))
def arm(spark, d):
    s = F.sum
    return counts(spark, d).agg(F.count("*").alias("n"), F.round(s("tp") / s(F.expr("tp+fp")), 4).alias("p"), F.round(s("tp") / s(F.expr("tp+fn")), 4).alias("r"), F.round(f1(s("tp"), s("fp"), s("fn")), 4).alias("f1"), F.round(s(F.expr("tp+fp")) / F.count("*"), 2).alias("codes_per_note"), F.round((s("sg") / s("st")) / (s("ug") / s("ut")), 4).alias("lift"))


@query("ml_threshold_grid", with_("facts_a", """with s as (select t, count(*) filter (in_pred and in_gold and confidence>=t) tp, count(*) filter (in_pred and confidence>=t) e, count(*) filter (in_gold) g from facts_a, (select (4+i)/100.0::double t from range(1, 57) x(i)) group by t) select t, round(2*tp/(e+g),9) f1 from s order by 2 desc, 1 limit 1"""))
def threshold_grid(spark, d):
    """The best of 56 global thresholds .05 to .60; the first of equals."""
    ts = [(4 + i) / 100.0 for i in range(1, 57)]
    passed = F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: F.col("confidence") >= t))
    cells = facts(spark, d).groupBy(F.when(F.col("in_pred"), F.coalesce(passed, F.lit(0))).alias("passed"), "in_pred", "in_gold").agg(F.count("*").alias("n"))
    x = cells.select("*", F.posexplode(F.array(*map(F.lit, ts))).alias("i", "t"))
    kept = F.col("in_pred") & (F.col("passed") > F.col("i"))
    s = x.groupBy("t").agg(F.sum(F.when(kept & F.col("in_gold"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col("in_gold"), F.col("n")).otherwise(0)).alias("g"))
    return st.best(s.select("t", F.round(2 * F.col("tp") / (F.col("e") + F.col("g")), 9).alias("f1")), "f1", F.col("t"))


@query("ml_label_thresholds", with_("facts_a", """with s as (select code, t, count(*) filter (in_pred and in_gold and confidence>=t) tp, count(*) filter (in_pred and confidence>=t) e, count(*) filter (in_gold) g from facts_a, (select i/100.0::double t from range(5, 71) x(i)) group by 1,2),
 f as (select code, t, case when g=0 then null when e+g>0 then round(2*tp/(e+g),9) else 0 end f1 from s) select code, case when max(f1) is null then 0.5 else arg_max(t, (f1, -t)) end threshold from f group by code"""))
def label_thresholds(spark, d):
    return label_thresholds_full(spark, d)


@query("st_bootstrap_delta_full")
def bootstrap_delta_full(spark, d, reps=FULL):
    return st.interval(st.resample(pairs(spark, d), reps, 42).select("rep", st.delta_f1(9).alias("d")), "d")


@query("st_randomization_full")
def randomization_full(spark, d, reps=FULL):
    rows = pairs(spark, d)
    seen = rows.agg(*[F.sum(c).alias(c) for c in rows.columns if c != "note"]).select(st.delta_f1(9).alias("observed"))
    drawn = st.resample(rows, reps, 42, [st.sides("a", "b")]).select(st.delta_f1(9).alias("v")).crossJoin(F.broadcast(seen))
    return drawn.agg(F.max("observed").alias("observed"), F.round((F.count_if(F.abs("v") >= F.abs("observed")) + 1) / (F.count("*") + 1), 6).alias("p"))


@query("st_ratio_bootstrap_full")
def ratio_bootstrap_full(spark, d, reps=FULL):
    return _centred(pairs(spark, d, "sg", "st"), lambda rows, stats: st.resample(rows, reps, 7).select("rep", *[v.alias(k) for k, v in stats.items()]))


@query("st_metric_bootstrap_full")
def metric_bootstrap_full(spark, d, reps=FULL_METRIC):
    return _spread(st.resample(pairs(spark, d), reps, 42).select("rep", st.delta_f1(9).alias("d")))


@query("ml_label_thresholds_full")
def label_thresholds_full(spark, d):
    """The best of 66 thresholds .05 to .70 for each label, the first of equals; labels without gold notes keep .5."""
    ts = [i / 100.0 for i in range(5, 71)]
    passed = F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: F.col("confidence") >= t))
    # How many thresholds a confidence passes is all that the grid can see: thresholds multiply those cells, not the facts.
    cells = facts(spark, d).groupBy("code", F.when(F.col("in_pred") & F.col("confidence").isNotNull(), passed).otherwise(0).alias("passed"), "in_gold").agg(F.count("*").alias("n"))
    x = cells.select("*", F.posexplode(F.array(*map(F.lit, ts))).alias("i", "t"))
    kept = F.col("passed") > F.col("i")
    s = x.groupBy("code", "t").agg(F.sum(F.when(kept & F.col("in_gold"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col("in_gold"), F.col("n")).otherwise(0)).alias("g"))
    f = s.withColumn("f1", F.when(F.col("g") > 0, F.round(2 * F.col("tp") / (F.col("e") + F.col("g")), 9)))
    return f.groupBy("code").agg(F.when(F.max("f1").isNull(), F.lit(0.5)).otherwise(F.max_by("t", F.when(F.col("f1").isNotNull(), F.struct("f1", -F.col("t"))))).alias("threshold"))


CAPS = [1, 2, 3, 4, 5, 6, 8, 10, 12, 15]


@query("st_split_half_full")
def split_half_full(spark, d):
    """Twenty thresholds, ten caps, all codes or supported ones only, tuned on one half of the notes (by parity) and scored on the other.

    The cap counts the codes that threshold and support leave; codes without confidence pass every threshold and come
    last. ``tuned_on`` 2 is the best on all notes, an upper bound without held-out score; ``held_out_mean`` is the mean of both halves.
    """
    ts = [i / 20 for i in range(20)]
    f = facts(spark, d).withColumn("half", (F.col("note") % 2).cast("int"))
    p = f.where("in_pred").select("note", "half", "code", "in_gold", "confidence", "rank", F.explode(F.when(F.col("supported"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("only"))
    p = p.withColumn("step", F.when(F.col("confidence").isNotNull(), F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: F.col("confidence") >= t))))
    note = Window.partitionBy("note", "only")
    p = p.withColumn("rank", F.row_number().over(note.orderBy("rank"))).withColumn("steps", F.when(F.col("step").isNull(), F.collect_list("step").over(note)))
    have = p.where("step > 0").select("half", "only", F.lit(0).alias("lo"), (F.col("step") - 1).alias("hi"), "rank", "in_gold")
    # Codes without confidence move up by the codes that a threshold takes away before them.
    lack = p.where("step is null").select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("lo"))
    lack = lack.select("half", "only", "lo", F.col("lo").alias("hi"), (F.col("rank") - F.size(F.filter("steps", lambda s: s <= F.col("lo")))).alias("rank"), "in_gold")
    both = F.explode(F.array("half", F.lit(2))).alias("half")
    cells = have.unionByName(lack).where(F.col("rank") <= CAPS[-1]).groupBy("half", "only", "lo", "hi", "rank", "in_gold").agg(F.count("*").alias("n")).select(both, "only", "lo", "hi", "rank", "in_gold", "n")
    gold = f.where("in_gold").groupBy("half").agg(F.count("*").alias("n")).select(both, "n").groupBy("half").agg(F.sum("n").alias("g"))
    grid = spark.createDataFrame([(i, t, c, o) for i, t in enumerate(ts) for c in CAPS for o in (False, True)], "i int, t double, cap int, only boolean")
    grid = gold.crossJoin(F.broadcast(grid))  # 1200 rows
    hit = cells.join(F.broadcast(grid.select("half", "i", "cap", "only")), ["half", "only"]).where("lo <= i and i <= hi and rank <= cap")
    hit = hit.groupBy("half", "only", "i", "cap").agg(F.sum(F.when(F.col("in_gold"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("e"))
    s = grid.join(hit, ["half", "only", "i", "cap"], "left").select("half", "t", "cap", "only", F.round(2 * F.coalesce("tp", F.lit(0)) / (F.coalesce("e", F.lit(0)) + F.col("g")), 9).alias("f1"))
    b = s.withColumn("r", F.row_number().over(Window.partitionBy("half").orderBy(F.desc("f1"), "t", "cap", "only"))).where("r = 1")
    o = s.where("half < 2").select((1 - F.col("half")).alias("half"), "t", "cap", "only", F.col("f1").alias("held_out_f1"))
    out = b.join(o, ["half", "t", "cap", "only"], "left").select(F.col("half").alias("tuned_on"), "t", "cap", F.col("only").alias("supported_only"), F.col("f1").alias("tuned_f1"), "held_out_f1")
    return out.withColumn("held_out_mean", F.round(F.avg("held_out_f1").over(Window.partitionBy()), 9))  # three rows
