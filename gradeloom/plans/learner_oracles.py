"""Equivalent SQL for DuckDB of the learners' queries, where their results can be enumerated."""

from __future__ import annotations

from gradeloom.operators.boosted import UNIT
from gradeloom.plans.learners import CATEGORIES, FEW_VALUES, M, NETWORKS, ONE_ROUND, STRENGTH, plain_weights
from gradeloom.plans.oracles import BUILDINGS, C, ORACLES, P, SIGNAL, add, argmax, block, folds_cte, pick, rnd, softmax_cte, split_cte

__all__ = ["ORACLES"]

_p_out = ", ".join(f"{rnd(p)} as {p}" for p in P)
_few = ", ".join(f"{e.replace('`', '')} as f{k}" for k, e in enumerate(FEW_VALUES.values()))
_places = ", ".join(str(k) for k in range(len(FEW_VALUES)))
_values = ", ".join(f"f{k}" for k in range(len(FEW_VALUES)))
FEW = f"""few as (select row_id, y, {_few} from labelled),
  x as (select row_id, unnest([{_places}]) as k, unnest([{_values}]) as v from few)"""


def boosted_ctes(member: str, depth: int, name: str = "") -> str:
    """CTE ``margins`` after one round of trees, for each set ``s`` of rows; ``member`` has s, row_id, y, train."""
    rate, penalty = ONE_ROUND["stepSize"], ONE_ROUND["leafPenalty"]
    t = name
    out = [
        f"""vals{t} as (select s, k, coalesce(v + (lead(v) over (partition by s, k order by v) - v) / 2, 'infinity'::double) as cut
          from (select distinct s, k, v from {member} join x using (row_id) where train and v is not null))""",
        f"""st{t}_0 as materialized (select s, c.range as c, row_id, y, train, 0 as node,
          cast(round((0.2e0 - (y = c.range)::int) * {UNIT!r}) as bigint) as g,
          cast(round(2 * 0.2e0 * 0.8e0 * {UNIT!r}) as bigint) as h from {member}, range({C}) c)""",
    ]
    for level in range(depth):
        out.append(f"""agg{t}_{level} as (select s, c, node, k, v, sum(g) as g, sum(h) as h from st{t}_{level} join x using (row_id)
          where train and node >= {(1 << level) - 1} group by all)""")
        sums = ", ".join(
            f"cast(sum(case when {when} then a.{s} else 0 end) as double) / {UNIT!r} as {s}{n}"
            for n, when in (("l", "a.v <= cut"), ("m", "a.v is null"), ("t", "true")) for s in "gh"
        )
        out.append(f"""cand{t}_{level} as (select a.s, a.c, a.node, a.k, cut, {sums}
          from agg{t}_{level} a join vals{t} using (s, k) group by a.s, a.c, a.node, a.k, cut)""")
        out.append(f"""side{t}_{level} as (select *, gl + side * gm as l, hl + side * hm as lh,
          case when gm <> 0 or hm <> 0 then side = 1 else hl >= ht - hl end as mleft from cand{t}_{level}, (values (0), (1)) sides(side))""")
        out.append(f"""best{t}_{level} as materialized (select * from (select *, l * l / (lh + {penalty}) + (gt - l) * (gt - l) / (ht - lh + {penalty})
            - gt * gt / (ht + {penalty}) as gain from side{t}_{level} where lh >= 1 and ht - lh >= 1)
          where gain > 1e-9 qualify row_number() over (partition by s, c, node order by gain desc, k, cut, side) = 1)""")
        out.append(f"""st{t}_{level + 1} as materialized (select r.s, r.c, r.row_id, r.y, r.train, r.g, r.h, case when b.k is null then r.node
            when (case when x.v is null then mleft else x.v <= cut end) then 2 * r.node + 1 else 2 * r.node + 2 end as node
          from st{t}_{level} r left join best{t}_{level} b using (s, c, node) left join x on x.row_id = r.row_id and x.k = b.k)""")
    values = ", ".join(f"max(value) filter (where c = {k}) as z{k}" for k in range(C))
    out.append(f"""leaf{t} as (select s, c, node, -{rate!r}e0 * (sum(g) / {UNIT!r}) / (sum(h) / {UNIT!r} + {penalty}) as value
      from st{t}_{depth} where train group by s, c, node)""")
    out.append(f"margins{t} as (select s, row_id, y, train, {values} from st{t}_{depth} join leaf{t} using (s, c, node) group by s, row_id, y, train)")
    return ", ".join(out)


_z = [f"z{k}" for k in range(C)]
ORACLES["boosted_one_round"] = f"""with {BUILDINGS}, {FEW}, member as (select 0 as s, row_id, y, true as train from few),
  {boosted_ctes('member', ONE_ROUND['maxDepth'])}, {softmax_cte('probs', 'margins', 'row_id, y', _z)}
  select row_id, y, {_p_out} from probs"""

_search = ", ".join(
    boosted_ctes("member", d, f"_{d}")
    + f""", accuracy_{d} as (select avg(a) as accuracy from (select s, avg(cast(y = {argmax(_z)} as int)) as a
      from margins_{d} where not train group by s))"""
    for d in (1, 2)
)
ORACLES["boosted_search"] = f"""with {BUILDINGS}, {FEW}, {folds_cte()},
  member as (select held.range as s, row_id, y, fold <> held.range as train from folds, range(5) held), {_search},
  found as (select 0 as setting, 'maxDepth=1' as parameters, accuracy from accuracy_1
    union all select 1, 'maxDepth=2', accuracy from accuracy_2)
  select setting, parameters, {rnd('accuracy')} as accuracy, row_number() over (order by accuracy desc, setting) = 1 as best from found"""


# ---------------------------------------------------------------- categories as inputs

_key = "coalesce(concat('=', cast({} as varchar)), '')"


def shares_sql(counts: list[str], prior: list[str], strength: float = STRENGTH) -> list[str]:
    total = add(counts)
    return [f"({n} + {strength!r}e0 * {p}) / ({total} + {strength!r}e0)" for n, p in zip(counts, prior)]


_prior = ", ".join(f"avg(cast(y = {k} as int)) as q{k}" for k in range(C))
_q = [f"q{k}" for k in range(C)]
_before = {
    c: [f"""coalesce(count(*) filter (where y = {k}) over (partition by {c} order by md5(concat('42:', cast(row_id as varchar))), row_id
      rows between unbounded preceding and 1 preceding), 0)""" for k in range(C)]
    for c in CATEGORIES
}
ORACLES["ordered_statistics"] = f"""with {BUILDINGS}, prior as (select {_prior} from labelled),
  counted as (select row_id, y, {', '.join(f'{n} as {c}_n{k}' for c, ns in _before.items() for k, n in enumerate(ns))} from labelled)
  select row_id, y, {', '.join(f"{rnd(e)} as {c}_p{k}" for c in CATEGORIES
      for k, e in enumerate(shares_sql([f'{c}_n{j}' for j in range(C)], _q)))} from counted, prior"""

_tables = ", ".join(
    f"t_{c} as (select {c} as key, {', '.join(f'count(*) filter (where y = {k}) as n{k}' for k in range(C))} from train group by {c})"
    for c in CATEGORIES
)
_joins = " ".join(f"left join t_{c} on r.{c} is not distinct from t_{c}.key" for c in CATEGORIES)
ORACLES["target_statistics"] = f"""with {BUILDINGS}, {split_cte('labelled', 'y', '0.3e0', '0.0e0', 42)},
  train as (select * from split where split <> 'test'), prior as (select {_prior} from train), {_tables}
  select row_id, y, {', '.join(f"{rnd(e)} as {c}_p{k}" for c in CATEGORIES
      for k, e in enumerate(shares_sql([f'coalesce(t_{c}.n{j}, 0)' for j in range(C)], _q)))}
  from split r {_joins}, prior where split = 'test'"""


# ---------------------------------------------------------------- enumerable trees

_cuts = """filled as (select row_id, k, coalesce(v, -1.0e0) as v from x),
  cuts as (select k, v + (lead(v) over (partition by k order by v) - v) / 2 as cut from (select distinct k, v from filled)
    qualify cut is not null)"""
_left = ", ".join(f"cast(count(*) filter (where y = {k} and v <= cut) as double) as l{k}" for k in range(C))
_right = ", ".join(f"cast(count(*) filter (where y = {k} and v > cut) as double) as r{k}" for k in range(C))
_nl, _nr = add(f"l{k}" for k in range(C)), add(f"r{k}" for k in range(C))
_gini = f"{add(f'l{k} * l{k}' for k in range(C))} / {_nl} + {add(f'r{k} * r{k}' for k in range(C))} / {_nr}"
_sides = ", ".join(f"{rnd(f'case when v <= cut then l{k} / {_nl} else r{k} / {_nr} end')} as p{k}" for k in range(C))
ORACLES["forest_of_stumps"] = f"""with {BUILDINGS}, {FEW}, {_cuts},
  sides as (select k, cut, {_left}, {_right} from filled join cuts using (k) join few using (row_id) group by k, cut),
  best as (select * from sides order by round({_gini}, 6) desc, k, cut limit 1)
  select row_id, y, {_sides} from few join filled using (row_id) join best using (k)"""


def stump_ctes(stage: int, source: str, goals: list[str]) -> str:
    """CTE ``o{stage}``: a regression stump per class on ``goals``."""
    out = [f"g{stage} as materialized (select row_id, y, unnest(range({C})) as c, unnest([{', '.join(goals)}]) as t from {source})"]
    out.append(f"""c{stage} as (select c, k, cut, sum(t) filter (where v <= cut) as sl, count(*) filter (where v <= cut) as nl,
        sum(t) filter (where v > cut) as sr, count(*) filter (where v > cut) as nr
      from (select c, k, v, t, cut from g{stage} join filled using (row_id) join cuts using (k)) group by c, k, cut)""")
    out.append(f"b{stage} as (select * from c{stage} qualify row_number() over (partition by c order by round(sl * sl / nl + sr * sr / nr, 8) desc, k, cut) = 1)")
    values = ", ".join(f"max(case when v <= cut then sl / nl else sr / nr end) filter (where c = {k}) as o{k}" for k in range(C))
    out.append(f"o{stage} as (select row_id, {values} from filled join b{stage} using (k) group by row_id)")
    return ", ".join(out)


_first = stump_ctes(0, "few", [f"(y = {k})::int * 1.0e0" for k in range(C)])
_gap = [f"0.5e0 * ((y = {k})::int - p{k})" for k in range(C)]
ORACLES["regression_stumps"] = f"""with {BUILDINGS}, {FEW}, {_cuts}, {_first},
  s0 as (select row_id, y, {', '.join(f'o{k} as z{k}' for k in range(C))} from few join o0 using (row_id)),
  {softmax_cte('p0_', 's0', 'row_id, y', _z)}, {stump_ctes(1, 'p0_', _gap)}
  select row_id, y, {', '.join(f'{rnd(f"z{k} + o{k}")} as s{k}' for k in range(C))} from s0 join o1 using (row_id)"""


# ---------------------------------------------------------------- networks

_UNITS = {"relu": "greatest({}, 0.0e0)", "tanh": "tanh({})"}
_inputs = ", ".join(c for m in range(len(M)) for c in block(m))


def forward_cte(name: str, shape: str) -> str:
    """CTE with the class probabilities of a network under the weights of the rule."""
    settings = NETWORKS[shape]
    weights = plain_weights([len(M) * C, *settings["hidden"], C])
    x = f"[{_inputs}]"
    for layer, w in enumerate(weights):
        columns = "[" + ", ".join("[" + ", ".join(f"{row[j]!r}e0" for row in w) + "]" for j in range(len(w[0]))) + "]"
        unit = _UNITS[settings["activation"]] if layer + 1 < len(weights) else "{}"
        x = f"list_transform({columns}, lambda w{layer}: {unit.format(f'list_dot_product(a{layer}, w{layer})')})"
        source = "signal" if layer == 0 else f"(select *, {previous} as x{layer} from {source})"
        before = f"[{_inputs}]" if layer == 0 else f"x{layer}"
        source = f"(select *, list_append({before}, 1.0e0) as a{layer} from {source})"
        previous = x
    outputs = ", ".join(f"z[{k + 1}] as z{k}" for k in range(C))
    logits = f"(select row_id, y, {outputs} from (select row_id, y, {previous} as z from {source}))"
    return softmax_cte(name, logits, "row_id, y", _z)


_forward = ", ".join(forward_cte(f"net_{s}", s) for s in NETWORKS)
ORACLES["network_forward"] = f"with {SIGNAL}, {_forward} " + " union all ".join(
    f"select row_id, y, '{s}' as shape, {_p_out} from net_{s}" for s in NETWORKS
)
ORACLES["score_network_file"] = f"with {SIGNAL}, {_forward} select row_id, y, {_p_out} from net_narrow"
_slopes = ", ".join(f"{rnd(f'avg(p{k} - (y = {k})::int)')} as g{k}" for k in range(C))
ORACLES["network_gradient"] = f"with {SIGNAL}, {_forward} " + " union all ".join(
    f"select '{s}' as shape, {rnd(f'avg(-ln({pick('y', P)}))')} as loss, {_slopes} from net_{s}" for s in NETWORKS
)
_slots = len(M) * (C + 3) + C + 3
ORACLES["logistic_gradient"] = f"""select cast(c.range as int) as label, cast(s.range as int) as slot, 0.0e0 as slope
  from range({C}) c, range({_slots}) s"""
