"""Equivalent SQL for DuckDB, over the same tables."""

from __future__ import annotations

from gradeloom.plans.inputs import EMBEDDING_SIZE
from gradeloom.plans.queries import BOOST_KEYS, DIGITS, TEMPERATURES
from gradeloom.spec import FLAG_COLUMNS, FOREIGN_CONSTANTS, GRADE_NAMES

C = 5
K = 3
D = DIGITS
ORACLES: dict[str, str] = {}


def rnd(expression: str, digits: int = D) -> str:
    return f"round({expression}, {digits}) + 0.0e0"


def add(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def argmax(cols: list[str]) -> str:
    top = f"greatest({', '.join(cols)})"
    return "case " + " ".join(f"when {c} = {top} then {k}" for k, c in enumerate(cols)) + " end"


def softmax_cte(name: str, source: str, keep: str, cols: list[str], scale: str = "1.0e0") -> str:
    """CTE ``name`` with columns p0.. from logit columns of ``source``."""
    z = [f"{c} / {scale}" for c in cols]
    top = f"greatest({', '.join(z)})"
    e = ", ".join(f"exp({v} - {top}) as e{k}" for k, v in enumerate(z))
    s = add(f"e{k}" for k in range(len(cols)))
    p = ", ".join(f"e{k} / {s} as p{k}" for k in range(len(cols)))
    return f"{name} as (select {keep}, {p} from (select {keep}, {e} from {source}))"


def pick(y: str, cols: list[str]) -> str:
    return f"case {y} " + " ".join(f"when {k} then {c}" for k, c in enumerate(cols)) + " end"


FLAGS = ", ".join(f"(o_orderkey >> {i}) & 1 as {f}" for i, f in enumerate(FLAG_COLUMNS))

BUILDINGS = f"""buildings as (
  select o_orderkey as building_id,
    cast(substr(o_orderpriority, 1, 1) as int) as damage_grade,
    case when o_orderkey % 17 <> 0 then 1.0e0 + o_totalprice / 10000.0e0 end as distance_mi,
    case when o_orderkey % 13 <> 0 then 1 + o_custkey % 9 end as count_floors_pre_eq,
    case when o_orderkey % 11 <> 0 then o_orderkey % 60 end as age_building,
    abs(c_acctbal) as plinth_area_sq_ft,
    3.0e0 * (1 + o_custkey % 9) as total_height_m,
    o_orderstatus as foundation_type,
    case when o_orderkey % 19 <> 0 then c_mktsegment end as roof_type,
    c_nationkey % 5 as ground_floor_type, {FLAGS}
  from orders join customer on o_custkey = c_custkey),
labelled as (select building_id as row_id, damage_grade - 1 as y, * exclude (building_id, damage_grade) from buildings)"""

FOREIGN = """foreign_survey as (
  select case when l_partkey % 23 <> 0 then l_quantity end as age,
    l_linenumber % 7 as stories, 0.05e0 + l_discount as pga, 3.0e0 * l_linenumber as height,
    l_extendedprice / 100.0e0 as area,
    substr('NLMSCX', cast(1 + l_partkey % 6 as int), 1) as letter
  from lineitem),
graded as (select *, case letter when 'N' then 0 when 'L' then 1 when 'M' then 2 when 'S' then 3 when 'C' then 4 end as grade
  from foreign_survey)"""


def ranked(source: str, stratum: str, seed: int, name: str = "ranked") -> str:
    part = f"partition by {stratum} " if stratum else ""
    return f"""{name} as (select *,
      row_number() over ({part}order by md5(concat('{seed}:', cast(row_id as varchar))), row_id) as rk,
      count(*) over ({part.strip()}) as size from {source})"""


def split_cte(source: str, stratum: str, test: str, valid: str, seed: int) -> str:
    return (
        ranked(source, stratum, seed)
        + f""", cuts as (select *, floor(size * {test} + 0.5e0) as cut from ranked),
    split as (select * exclude (rk, size, cut), case when rk <= cut then 'test'
        when rk <= cut + floor((size - cut) * {valid} + 0.5e0) then 'valid' else 'train' end as split from cuts)"""
    )


def folds_cte(source: str = "labelled") -> str:
    return ranked(source, "y", 42, "fold_rank") + (
        ", folds as (select * exclude (rk, size), cast((rk - 1) % 5 as int) as fold from fold_rank)"
    )


def score(m: int, k: int) -> str:
    return (
        f"1.0e0 + (row_id * {(m + 2) * (k + 3)} % 97)"
        f" + (case when (y + {m}) % 5 = {k} then 20.0e0 else 0.0e0 end)"
    )


_scores = ", ".join(f"{score(m, k)} as s{m}_{k}" for m in range(K) for k in range(C))
_probs = ", ".join(
    f"s{m}_{k} / {add(f's{m}_{j}' for j in range(C))} as m{m}_p{k}" for m in range(K) for k in range(C)
)
SIGNAL = f"""{BUILDINGS},
scores as (select row_id, y, {_scores} from labelled),
signal as (select row_id, y, {_probs} from scores)"""
LOGITS = f"""{BUILDINGS},
logits as (select row_id, y, {', '.join(f'({score(0, k)}) / 10.0e0 as z{k}' for k in range(C))} from labelled)"""
Z = [f"z{k}" for k in range(C)]


def block(m: int) -> list[str]:
    return [f"m{m}_p{k}" for k in range(C)]


def long_signal(models=range(K)) -> str:
    return "long as (" + " union all ".join(
        f"select row_id, y, 'm{m}' as model, " + ", ".join(f"{c} as p{k}" for k, c in enumerate(block(m))) + " from signal"
        for m in models
    ) + ")"


def report_cte(source: str, by: str, extra: str = "") -> str:
    """CTE ``report`` per group of ``by``; ``source`` has y, yp and loss."""
    groups = ", ".join(by.split())
    return f"""labels_of as (
      select {groups}, y as label, (y = yp)::int as tp, 1 as sup, 0 as pr, loss from {source}
      union all select {groups}, yp, 0, 0, 1, 0.0e0 from {source}),
    per_label as (select {groups}, label, sum(tp) as tp, sum(sup) as sup, sum(pr) as pr, sum(loss) as loss,
      2.0e0 * sum(tp) / (sum(sup) + sum(pr)) as f from labels_of group by {groups}, label),
    report as (select {groups}, cast(sum(sup) as bigint) as n,
      {rnd('sum(tp) / cast(sum(sup) as double)')} as accuracy,
      {rnd('avg(f)')} as f1_macro,
      {rnd('sum(f * sup) / sum(sup)')} as f1_weighted,
      {rnd('sum(loss) / sum(sup)')} as log_loss from per_label group by {groups})"""


def loss_of(y: str, cols: list[str]) -> str:
    eps = "2.220446049250313e-16"
    return f"-ln(least(greatest({pick(y, cols)} / {add(cols)}, {eps}), 1.0e0 - {eps}))"


P = [f"p{k}" for k in range(C)]

# ---------------------------------------------------------------- sources

_locale = f"with {BUILDINGS} select building_id, distance_mi, roof_type, damage_grade from buildings"
ORACLES["scan_locale_csv"] = _locale
ORACLES["scan_csv_skipping_lines"] = _locale
ORACLES["csv_round_trip"] = _locale
ORACLES["prediction_store"] = (
    f"with {SIGNAL}, {long_signal([0, 2])} select row_id, y, model, "
    + ", ".join(f"{rnd(p)} as {p}" for p in P)
    + " from long"
)
ORACLES["prediction_store_in_turn"] = f"with {SIGNAL}, {long_signal()} " + " union all ".join(
    f"select row_id, y, '{m}' as model, " + ", ".join(f"{rnd(p)} as {p}" for p in P) + f" from long where model = '{shown}'"
    for m, shown in (("m0", "m0"), ("m1", "m0"), ("m2", "m2"))
)
_by_model = f"""with {SIGNAL}, {long_signal()},
  scored as (select model, y, {argmax(P)} as yp, {loss_of('y', P)} as loss from long),
  {report_cte('scored', 'model')}"""
ORACLES["metrics_json"] = f"{_by_model} select model, accuracy, f1_macro, n from report"
ORACLES["metrics_by_model"] = f"{_by_model} select * from report"

# ---------------------------------------------------------------- preparation


def pga_sql(distance_km: str, mag: str = "7.8e0", e_mech: str = "0.4539e0", vs30: str = "250.0e0") -> str:
    r = f"sqrt(({distance_km}) * ({distance_km}) + 20.25e0)"
    over = f"({mag} - 5.5e0)"
    rock = (
        f"({e_mech} + (case when {over} <= 0 then 1.431e0 * {over} + 0.05053e0 * {over} * {over}"
        f" else -0.1662e0 * {over} end)"
        f" + (-1.134e0 + 0.1917e0 * ({mag} - 4.5e0)) * ln({r}) - 0.008088e0 * ({r} - 1.0e0))"
    )
    site = (
        f"(-0.6e0 * ln(least({vs30}, 1500.0e0) / 760.0e0)"
        f" + -0.15e0 * (exp(-0.00701e0 * (least({vs30}, 760.0e0) - 360.0e0)) - exp(-0.00701e0 * 400.0e0))"
        f" * ln((exp({rock}) + 0.1e0) / 0.1e0))"
    )
    return f"exp({rock} + {site})"


KM = "distance_mi * 1.60934e0"
ORACLES["prep_pga"] = (
    f"with {BUILDINGS} select building_id, {rnd(KM, 7)} as distance_km, {rnd(pga_sql(KM), 7)} as pga_g from buildings"
)
ORACLES["pga_per_distinct_distance"] = (
    f"with {BUILDINGS} select building_id, {rnd(pga_sql(KM), 7)} as pga_g from buildings"
)
ORACLES["prep_pga_by_event"] = f"""with {BUILDINGS},
  events_of as (select building_id, {KM} as km, 5.0e0 + ground_floor_type * 0.5e0 as mag,
    case ground_floor_type when 0 then 0.2459e0 when 1 then 0.2459e0 when 2 then 0.4856e0
      when 3 then 0.4539e0 else 0.4539e0 end as e_mech,
    200.0e0 + age_building * 30.0e0 as vs from buildings)
  select building_id, case when vs is not null then {rnd(pga_sql('km', 'mag', 'e_mech', 'vs'), 7)} end as pga_g
  from events_of"""
_h = "total_height_m * 3.28084e0"
ORACLES["prep_units_ratio"] = f"""with {BUILDINGS} select building_id, {rnd(_h)} as height_ft,
  {rnd('plinth_area_sq_ft * 10.7639e0')} as area_sq_ft,
  {rnd(f'{_h} / count_floors_pre_eq')} as per_height_ft,
  {rnd(f'{_h} / nullif(ground_floor_type, 0)')} as per_zero_ft from buildings"""
ORACLES["label_map_filter"] = (
    f"with {FOREIGN} select age, {rnd('area')} as area, grade as damage_grade from graded where grade is not null"
)
ORACLES["unlabelled_counts"] = f"""with {FOREIGN} select count(*) as rows_before,
  count(*) - count(grade) as rows_unlabelled, count(grade) as rows_after from graded"""
_constants = ", ".join(f"{v} as const_{c}" for c, v in FOREIGN_CONSTANTS.items())
ORACLES["age_flags_constants"] = f"""with {BUILDINGS} select building_id,
  coalesce(age_building > 23, false)::int as non_engineered,
  coalesce(age_building <= 23, false)::int as engineered, {_constants} from buildings"""


def mode_sql(column: str, source: str) -> str:
    return (
        f"(select {column} from {source} where {column} is not null"
        f" group by {column} order by count(*) desc, {column} limit 1)"
    )


def filled(column: str, source: str) -> str:
    return f"coalesce({column}, (select median({column}) from {source}))"


_flags = ", ".join(FLAG_COLUMNS)
ORACLES["prepare_home_survey"] = f"""with {BUILDINGS},
  home as (select *, round({pga_sql(KM)}, 7) as pga, 3.0e0 * total_height_m as per_height from buildings)
  select building_id, {rnd(filled('pga', 'home'), 7)} as "PGA_g",
    cast({filled('count_floors_pre_eq', 'home')} as double) as count_floors_pre_eq,
    {rnd(f"cast({filled('age_building', 'home')} as double)", 7)} as age_building,
    plinth_area_sq_ft, {rnd('per_height', 7)} as per_height_ft_pre_eq, foundation_type,
    coalesce(roof_type, {mode_sql('roof_type', 'home')}) as roof_type, ground_floor_type, {_flags},
    damage_grade - 1 as damage_grade from home"""
_foreign_constants = ", ".join(f"{v} as {c}" for c, v in FOREIGN_CONSTANTS.items())
ORACLES["prepare_foreign_survey"] = f"""with {FOREIGN},
  shaped as (select age, stories, pga, area * 10.7639e0 as area, height * 3.28084e0 / nullif(stories, 0) as per_height,
    coalesce(age > 23, false)::int as old, coalesce(age <= 23, false)::int as young, grade
    from graded where grade is not null)
  select {rnd(filled('pga', 'shaped'))} as "PGA_g", cast({filled('stories', 'shaped')} as double) as count_floors_pre_eq,
    {filled('age', 'shaped')} as age_building, {rnd(filled('area', 'shaped'))} as plinth_area_sq_ft,
    {rnd(filled('per_height', 'shaped'))} as per_height_ft_pre_eq, {_foreign_constants},
    old as has_superstructure_rc_non_engineered, young as has_superstructure_rc_engineered,
    grade as damage_grade from shaped"""
ORACLES["columns_in_header_order"] = f"with {FOREIGN} " + " union all ".join(
    f"""select '{c}' as "column", {i} as position, count({v}) as n_values from graded where grade is not null"""
    for i, (c, v) in enumerate(
        [("roof_type", "2"), ("age_building", "age"), ("foundation_type", "4"), ("PGA_g", "pga"), ("damage_grade", "grade")]
    )
)
ORACLES["zero_based_target"] = (
    f"with {BUILDINGS} select building_id, damage_grade - 1 as damage_grade from buildings"
)
ORACLES["impute_median_mode"] = f"""with {BUILDINGS} select building_id,
  {rnd(filled('distance_mi', 'buildings'))} as distance_mi,
  cast({filled('count_floors_pre_eq', 'buildings')} as double) as count_floors_pre_eq,
  cast({filled('age_building', 'buildings')} as double) as age_building,
  coalesce(roof_type, {mode_sql('roof_type', 'buildings')}) as roof_type, foundation_type from buildings"""
ORACLES["impute_from_train"] = f"""with {BUILDINGS}, {split_cte('labelled', 'y', '0.3e0', '0.3e0', 42)},
  train as (select * from split where split = 'train')
  select row_id, y, split, {rnd(filled('distance_mi', 'train'))} as distance_mi,
  cast({filled('age_building', 'train')} as double) as age_building,
  coalesce(roof_type, {mode_sql('roof_type', 'train')}) as roof_type from split"""
ORACLES["column_report"] = f"with {BUILDINGS} " + " union all ".join(
    f"""select '{c}' as "column", count(*) as n_rows, count({c}) as n_values, count(distinct {c}) as n_distinct,
    {rnd(f'cast(min({c}) as double)')} as lowest, {rnd(f'cast(max({c}) as double)')} as highest from buildings"""
    for c in ("distance_mi", "count_floors_pre_eq", "age_building", "plinth_area_sq_ft", "damage_grade")
)
ORACLES["scale_standard"] = f"""with {BUILDINGS}, {split_cte('labelled', 'y', '0.3e0', '0.0e0', 42)}
  select row_id, y, split, """ + ", ".join(
    f"""{rnd(f"({c} - (select avg({c}) from split where split = 'train')) / (select stddev_pop({c}) from split where split = 'train')")} as {c}"""
    for c in ("distance_mi", "plinth_area_sq_ft", "total_height_m")
) + " from split"

# ---------------------------------------------------------------- encoding and splits


def code_sql(column: str, source: str = "buildings", start: int = 0) -> str:
    return (
        f"(select {column} as v, cast(row_number() over (order by {column}) - 1 + {start} as int) as code"
        f" from (select distinct {column} from {source} where {column} is not null))"
    )


_keys = ("foundation_type", "roof_type", "ground_floor_type")
ORACLES["label_encode"] = (
    f"with {BUILDINGS} select building_id, "
    + ", ".join(f"coalesce(d{i}.code, -1) as {c}" for i, c in enumerate(_keys))
    + " from buildings "
    + " ".join(f"left join {code_sql(c)} d{i} on buildings.{c} = d{i}.v" for i, c in enumerate(_keys))
)
ORACLES["label_encode_unseen"] = f"""with {BUILDINGS} select l_orderkey, l_linenumber,
  coalesce(a.code, 0) as market, coalesce(b.code, 0) as status from lineitem
  left join {code_sql('roof_type', start=1)} a on l_returnflag = a.v
  left join {code_sql('foundation_type', start=1)} b on l_linestatus = b.v"""
ORACLES["split_stratified"] = (
    f"with {BUILDINGS}, {split_cte('labelled', 'y', '0.3e0', '0.3e0', 42)} select row_id, y, split from split"
)
ORACLES["split_plain"] = (
    f"with {BUILDINGS}, {split_cte('labelled', '', '0.3e0', '0.0e0', 0)} select row_id, y, split from split"
)
ORACLES["kfold_stratified"] = f"with {BUILDINGS}, {folds_cte()} select row_id, y, fold from folds"
ORACLES["train_valid_union"] = f"""with {BUILDINGS}, {split_cte('labelled', 'y', '0.3e0', '0.3e0', 42)}
  select y, count(*) as n_union, count(*) as n_filter from split where split in ('train', 'valid') group by y"""
_weights = f"""with {BUILDINGS}, counts as (select y as label, count(*) as n from labelled group by y),
  class_weight as (select label, n, 1.0e0 / n / (select sum(1.0e0 / n) from counts) * 5 as inverse,
    ln(1.0e0 + (select sum(n) from counts) / cast(n as double)) as log,
    (select sum(n) from counts) / (5.0e0 * n) as balanced from counts)"""
ORACLES["class_weight_table"] = (
    f"{_weights} select label, n, {rnd('inverse')} as inverse, {rnd('log')} as log, {rnd('balanced')} as balanced"
    " from class_weight"
)

# ---------------------------------------------------------------- probability algebra

EMBEDDED = "emb as (select vec_id as row_id, label % 5 as y, " + ", ".join(
    add(f"cast(embedding[{j + 1}] as double)" for j in range(k, EMBEDDING_SIZE, C)) + f" as z{k}" for k in range(C)
) + " from embeddings)"
_p_out = ", ".join(f"{rnd(p)} as {p}" for p in P)
ORACLES["softmax_argmax"] = (
    f"with {EMBEDDED}, {softmax_cte('probs', 'emb', 'row_id, y', Z)} select row_id, y, {argmax(P)} as y_pred, {_p_out} from probs"
)
ORACLES["softmax_with_temperature"] = (
    f"with {LOGITS}, {softmax_cte('probs', 'logits', 'row_id, y', Z, '2.5e0')} select row_id, y, {_p_out} from probs"
)


def clip_log(p: str) -> str:
    c = f"least(greatest({p}, 1e-12), 1.0e0)"
    return f"{c} * ln({c})"


def entropy(cols: list[str]) -> str:
    return f"-{add(clip_log(c) for c in cols)}"


def nth(cols: list[str], n: int) -> str:
    return f"list_reverse_sort([{', '.join(cols)}])[{n}]"


def by_model(sql) -> str:
    """The rows of ``sql(m)`` for each model."""
    return " union all ".join(f"select 'm{m}' as model, t.* from ({sql(m)}) t" for m in range(K))


ORACLES["entropy_margin"] = by_model(lambda m: f"""with {SIGNAL} select row_id, {rnd(nth(block(m), 1))} as top1,
  {rnd(nth(block(m), 2))} as top2, {rnd(f'{nth(block(m), 1)} - {nth(block(m), 2)}')} as margin,
  {rnd(entropy(block(m)))} as entropy from signal""")
ORACLES["onehot_residual"] = (
    f"with {LOGITS}, {softmax_cte('probs', 'logits', 'row_id, y', Z)} select row_id, y, 1 as n_set, "
    + ", ".join(f"{rnd(f'(y = {k})::int - p{k}')} as r{k}" for k in range(C))
    + " from probs"
)
ORACLES["block_width_check"] = (
    f"with {SIGNAL}, {long_signal()} select model, 5 as width, count(*) as n from long group by model"
)

# ---------------------------------------------------------------- joins of blocks

_all_blocks = ", ".join(f"{rnd(c)} as {c}" for m in range(K) for c in block(m))
ORACLES["wide_from_long"] = f"with {SIGNAL} select row_id, y, {_all_blocks} from signal"
ORACLES["target_by_key"] = f"""with {BUILDINGS} select y, count(*) as n, cast(sum(age_building) as bigint) as age_sum
  from labelled group by y"""
ORACLES["oof_completeness"] = (
    f"with {BUILDINGS}, {folds_cte()} select if(roof_type is null, -1, fold) as fold, count(*) as n from folds group by 1"
)

# ---------------------------------------------------------------- metrics



def scored_by(m: int, y: str = "y") -> str:
    return f"with {SIGNAL}, scored as (select row_id, {y} as y, {argmax(block(m))} as yp, 0.0e0 as loss from signal)"


ORACLES["confusion"] = by_model(lambda m: f"""{scored_by(m)}, grid as (select a.range as y, b.range as y_pred from range(5) a, range(5) b)
  select cast(grid.y as int) as y, cast(grid.y_pred as int) as y_pred, count(scored.row_id) as n
  from grid left join scored on grid.y = scored.y and grid.y_pred = scored.yp group by all""")
_labels = """labels_of as (select y as label, (y = yp)::int as tp, 1 as sup, 0 as pr from scored
    union all select yp, 0, 0, 1 from scored),
  per_label as (select label, cast(sum(tp) as double) as tp, sum(sup) as sup, sum(pr) as pr from labels_of group by label)"""
_acc = f"label, {rnd('case when sup > 0 then tp / sup else 0.0e0 end')} as accuracy, cast(sup as bigint) as support"
ORACLES["class_accuracy"] = by_model(lambda m: f"{scored_by(m)}, {_labels} select {_acc} from per_label")
ORACLES["class_accuracy_skip_empty"] = by_model(
    lambda m: f"{scored_by(m, 'y - y % 2')}, {_labels} select {_acc} from per_label where sup > 0"
)
ORACLES["f_scores"] = by_model(lambda m: f"""{scored_by(m)}, {_labels} select label, {rnd('2.0e0 * tp / (sup + pr)')} as f1,
  {rnd('5.0e0 * tp / (4.0e0 * sup + pr)')} as f2 from per_label""")
ORACLES["macro_f2_by_model"] = f"""with {SIGNAL}, {long_signal()},
  scored as (select model, y, {argmax(P)} as yp from long),
  labels_of as (select model, y as label, (y = yp)::int as tp, 1 as sup, 0 as pr from scored
    union all select model, yp, 0, 0, 1 from scored),
  per_label as (select model, label, cast(sum(tp) as double) as tp, sum(sup) as sup, sum(pr) as pr
    from labels_of group by model, label)
  select model, {rnd('avg(5.0e0 * tp / (4.0e0 * sup + pr))')} as f_macro from per_label group by model"""
_names = pick("label", [f"'{n}'" for n in GRADE_NAMES])
ORACLES["class_report"] = by_model(lambda m: f"""{scored_by(m)}, {_labels},
  rows_of as (select label, tp, sup, case when pr > 0 then tp / pr else 0.0e0 end as p,
    case when sup > 0 then tp / sup else 0.0e0 end as r, 2.0e0 * tp / (sup + pr) as f from per_label)
  select {_names} as label, {rnd('p')} as precision, {rnd('r')} as recall, {rnd('f')} as f1, cast(sup as bigint) as support from rows_of
  union all select 'accuracy', null, null, {rnd('sum(tp) / sum(sup)')}, cast(sum(sup) as bigint) from rows_of
  union all select 'macro avg', {rnd('avg(p)')}, {rnd('avg(r)')}, {rnd('avg(f)')}, cast(sum(sup) as bigint) from rows_of
  union all select 'weighted avg', {rnd('sum(p * sup) / sum(sup)')}, {rnd('sum(r * sup) / sum(sup)')},
    {rnd('sum(f * sup) / sum(sup)')}, cast(sum(sup) as bigint) from rows_of""")


def auc_cte(source: str, by: str, n: int = C) -> str:
    """CTE ``auc_of`` from rows with ``by``, y and p0..: mid-rank statistic per class."""
    g = by + ", " if by else ""
    stacked = " union all ".join(
        f"select {g}{k} as label, (y = {k})::int as hit, p{k} as s from {source}" for k in range(n)
    )
    return f"""stacked as ({stacked}),
  mid as (select {g}label, hit, (rank() over w + count(*) over (partition by {g}label, s) / 2.0e0 - 0.5e0) as mr
    from stacked window w as (partition by {g}label order by s)),
  auc_of as (select {g}label, cast(sum(hit) as bigint) as support,
    (sum(mr * hit) - cast(sum(hit) as double) * (sum(hit) + 1) / 2.0e0) / (cast(sum(hit) as double) * sum(1 - hit)) as auc
    from mid group by {g}label)"""


ORACLES["auc_ovr"] = f"""with {SIGNAL}, {long_signal()}, {auc_cte('long', 'model')}
  select model, label, {rnd('auc')} as auc, support from auc_of"""
ORACLES["auc_mean"] = f"""with {SIGNAL}, {long_signal()}, {auc_cte('long', 'model')}
  select model, {rnd('sum(auc * support) / sum(support)')} as auc_weighted, {rnd('avg(auc)')} as auc_macro
  from auc_of group by model"""
ORACLES["auc_small_classes"] = f"""with small as (select quality as y, 1.0e0 - cast(doc_id % 7 as double) / 7.0e0 as p0,
  cast(doc_id % 7 as double) / 7.0e0 as p1 from labels), {auc_cte('small', '', 2)}
  select label, {rnd('auc')} as auc, support from auc_of"""
_logp = f"""zn as (select *, greatest({', '.join(Z)}) as top from logits),
  lp as (select y, """ + ", ".join(
    f"z{k} - top - ln({add(f'exp(z{j} - top)' for j in range(C))}) as l{k}" for k in range(C)
) + " from zn)"
_counts = "counts as (select y as label, count(*) as n from labelled group by y)"
L = [f"l{k}" for k in range(C)]
ORACLES["smoothed_cross_entropy"] = f"""with {LOGITS}, {_logp}, {_counts},
  w as (select label, 1.0e0 / n / (select sum(1.0e0 / n) from counts) * 5 as w from counts),
  terms as (select w.w, -{pick('y', L)} as nll, {add(f'-l{k} * (select w from w where label = {k})' for k in range(C))} as spread
    from lp join w on lp.y = w.label)
  select {rnd('(0.95e0 * sum(w * nll) + 0.01e0 * sum(spread)) / sum(w)')} as cross_entropy from terms"""
ORACLES["focal_score"] = f"""with {LOGITS}, {_logp}, {_counts},
  w as (select label, ln(1.0e0 + (select sum(n) from counts) / cast(n as double)) as w from counts),
  ce as (select sum(w.w * -{pick('y', L)}) / sum(w.w) as ce from lp join w on lp.y = w.label)
  select {rnd('ce')} as cross_entropy, {rnd('power(1.0e0 - exp(-ce), 2.0e0) * ce')} as focal from ce"""

# ---------------------------------------------------------------- blending

_raw = ["ground_floor_type - 2.0e0", "building_id % 7 - 3.0e0", "building_id % 3 - 1.0e0"]
_clip = [f"greatest({w}, 0.0e0)" for w in _raw]
ORACLES["blend_weights"] = f"""with {BUILDINGS} select building_id, """ + ", ".join(
    f"{rnd(f'case when {add(_clip)} > 0 then {w} / {add(_clip)} else 1.0e0 / 3.0e0 end')} as w{i}"
    for i, w in enumerate(_clip)
) + " from buildings"


def blend(weights: list[str], k: int) -> str:
    return add(f"{w} * m{m}_p{k}" for m, w in enumerate(weights))


_third = ["(1.0e0 / 3.0e0)"] * K
_uniform = (
    "uniform as (select row_id, y, " + ", ".join(f"{blend(_third, k)} as p{k}" for k in range(C)) + " from signal)"
)
ORACLES["blend_uniform"] = (
    f"with {SIGNAL}, {_uniform} select row_id, y, {argmax(P)} as y_pred, {_p_out} from uniform"
)
ORACLES["blend_long_table"] = f"with {SIGNAL} select row_id, y, " + ", ".join(
    f"{rnd(blend(['0.5e0', '0.25e0', '0.25e0'], k))} as p{k}" for k in range(C)
) + " from signal"


def grid_cte(source: str = "signal") -> str:
    """CTE ``report`` per weight vector in steps of 0.1."""
    blends = ", ".join(f"{blend(['w0', 'w1', 'w2'], k)} as p{k}" for k in range(C))
    return f"""steps as (select a.range as a, b.range as b from range(11) a, range(11) b where a.range + b.range <= 10),
  grid as (select cast(row_number() over (order by a, b) - 1 as int) as candidate, a / 10.0e0 as w0, b / 10.0e0 as w1,
    (10 - a - b) / 10.0e0 as w2 from steps),
  mixed as (select candidate, w0, w1, w2, y, {blends} from {source}, grid),
  scored as (select candidate, w0, w1, w2, y, {argmax(P)} as yp, 0.0e0 as loss from mixed),
  {report_cte('scored', 'candidate w0 w1 w2')}"""


ORACLES["blend_grid"] = f"""with {SIGNAL}, {grid_cte()}
  select candidate, w0, w1, w2, n, accuracy, f1_macro, f1_weighted from report"""
ORACLES["blend_grid_best"] = f"""with {SIGNAL}, {grid_cte()}
  select candidate, w0, w1, w2, f1_weighted as score from report order by f1_weighted desc, candidate limit 1"""
_mixed = ", ".join(f"{blend(['w0', 'w1', 'w2'], k)} as p{k}" for k in range(C))
ORACLES["blend_grid_best_auc"] = f"""with {SIGNAL},
  steps as (select a.range as a, b.range as b from range(11) a, range(11) b where a.range + b.range <= 10),
  grid as (select cast(row_number() over (order by a, b) - 1 as int) as candidate, a / 10.0e0 as w0, b / 10.0e0 as w1,
    (10 - a - b) / 10.0e0 as w2 from steps),
  mixed as (select candidate, y, {_mixed} from signal, grid), {auc_cte('mixed', 'candidate')}
  select candidate, w0, w1, w2, {rnd('sum(auc * support) / sum(support)')} as score from auc_of join grid using (candidate)
  group by candidate, w0, w1, w2 order by round(sum(auc * support) / sum(support), 12) desc, candidate limit 1"""
_four = ", ".join(f"s3_{k} / {add(f's3_{j}' for j in range(C))} as m3_p{k}" for k in range(C))
_mixed = ", ".join(f"{blend(['w0', 'w1', 'w2', 'w3'], k)} as p{k}" for k in range(C))
ORACLES["blend_grid_four_models"] = f"""with {SIGNAL},
  fourth as (select row_id, {', '.join(f'{score(3, k)} as s3_{k}' for k in range(C))} from labelled),
  four as (select signal.*, {_four} from signal join fourth using (row_id)),
  steps as (select a.range as a, b.range as b, c.range as c from range(11) a, range(11) b, range(11) c
    where a.range + b.range + c.range <= 10),
  grid as (select cast(row_number() over (order by a, b, c) - 1 as int) as candidate, a / 10.0e0 as w0, b / 10.0e0 as w1,
    c / 10.0e0 as w2, (10 - a - b - c) / 10.0e0 as w3 from steps),
  mixed as (select candidate, w0, w1, w2, w3, y, {_mixed} from four, grid),
  scored as (select candidate, w0, w1, w2, w3, y, {argmax(P)} as yp, 0.0e0 as loss from mixed),
  {report_cte('scored', 'candidate w0 w1 w2 w3')} select candidate, w0, w1, w2, w3, n, accuracy, f1_macro, f1_weighted from report"""

_q = ", ".join(f"{pick('y', block(m))} as q{m}" for m in range(K))


EM_STEPS = 100


def em_ctes(source: str, steps: int) -> str:
    """CTEs em0.. of mixture weights, em0 uniform, each the likelihood step of the one before."""
    out = [
        f"shares as materialized (select {_q} from {source})",
        "em0 as (select " + ", ".join(f"1.0e0 / 3.0e0 as w{m}" for m in range(K)) + ")",
    ]
    for i in range(steps):
        mix = add(f"w{m} * q{m}" for m in range(K))
        raw = ", ".join(f"avg(w{m} * q{m} / {mix}) as a{m}" for m in range(K))
        out.append(
            f"em{i + 1} as materialized (select {', '.join(f'a{m} / (a0 + a1 + a2) as w{m}' for m in range(K))}"
            f" from (select {raw} from shares, em{i}))"
        )
    return ", ".join(out)


_mix = add(f"q{m} / 3.0e0" for m in range(K))
ORACLES["blend_em_step"] = f"with {SIGNAL}, shares as (select {_q} from signal) select " + ", ".join(
    f"{rnd(f'avg(q{m} / 3.0e0 / {_mix})')} as w{m}" for m in range(K)
) + f", {rnd(f'avg(ln({_mix}))')} as log_likelihood from shares"
_em_blend = ", ".join(f"{blend(['w0', 'w1', 'w2'], k)} as p{k}" for k in range(C))
ORACLES["blend_optimised"] = f"""with {SIGNAL}, {em_ctes('signal', EM_STEPS)}, {_uniform},
  fitted as (select y, {_em_blend} from signal, em{EM_STEPS})
  select {', '.join(f'{rnd(f"w{m}")} as w{m}' for m in range(K))},
    (select {rnd(f'avg(cast(y = {argmax(P)} as int))')} from uniform) as uniform_accuracy,
    (select {rnd(f'avg(cast(y = {argmax(P)} as int))')} from fitted) as fitted_accuracy from em{EM_STEPS}"""
_grid_valid = grid_cte("valid").replace("scored", "grid_scored").replace("report", "grid_report")
_grid_valid = _grid_valid.replace("labels_of", "grid_labels").replace("per_label", "grid_label")
ORACLES["method_compare"] = f"""with {SIGNAL}, {split_cte('signal', 'y', '0.3e0', '0.3e0', 42)},
  valid as (select * from split where split = 'valid'), test as (select * from split where split = 'test'),
  {_grid_valid}, {em_ctes('valid', EM_STEPS)},
  best as (select w0, w1, w2 from grid_report order by f1_weighted desc, candidate limit 1),
  chosen as (select 'uniform' as method, w0, w1, w2 from em0 union all select 'grid_search', w0, w1, w2 from best
    union all select 'optimization', w0, w1, w2 from em{EM_STEPS}),
  blends as (select method, y, {_em_blend} from test, chosen),
  scored as (select method, y, {argmax(P)} as yp, {loss_of('y', P)} as loss from blends),
  {report_cte('scored', 'method')} select * from report"""

# ---------------------------------------------------------------- stacking

FREQUENCY = {"by_foundation": "foundation_type", "by_roof": "roof_type", "by_ground_floor": "ground_floor_type"}


def frequency_ctes(keys: dict[str, str], source: str = "folds") -> str:
    """CTE ``oof`` with blocks name_p0.. of smoothed out-of-fold frequencies."""
    tables, joins, cols = [], [], []
    for i, (name, key) in enumerate(keys.items()):
        counts = ", ".join(f"count(*) filter (where y = {k}) as n{k}" for k in range(C))
        others = ", ".join(f"sum(n{k}) over (partition by key) - n{k} as o{k}" for k in range(C))
        tables.append(
            f"t{i} as (select key, fold, {others} from (select {key} as key, fold, {counts} from {source} group by 1, 2))"
        )
        joins.append(f"join t{i} on {source}.{key} is not distinct from t{i}.key and {source}.fold = t{i}.fold")
        total = add(f"t{i}.o{j}" for j in range(C))
        cols += [f"(t{i}.o{k} + 1.0e0) / ({total} + 5.0e0) as {name}_p{k}" for k in range(C)]
    return (
        ", ".join(tables)
        + f", oof as (select {source}.row_id, {source}.y, {source}.fold, {', '.join(cols)} from {source} {' '.join(joins)})"
    )


_freq_out = ", ".join(f"{rnd(f'{m}_p{k}')} as {m}_p{k}" for m in FREQUENCY for k in range(C))
ORACLES["oof_frequency"] = f"""with {BUILDINGS}, {folds_cte()}, {frequency_ctes(FREQUENCY)}
  select row_id, y, fold, {_freq_out} from oof"""
_flow = {"by_pga": "pga_bin", "by_age": "age_bin", "by_roof": "roof"}
_flow_blocks = {m: [f"{m}_p{k}" for k in range(C)] for m in _flow}
_flow_long = " union all ".join(
    f"select '{m}' as model, y, " + ", ".join(f"{c} as p{k}" for k, c in enumerate(cols)) + " from oof"
    for m, cols in _flow_blocks.items()
) + " union all select 'blend', y, " + ", ".join(
    add(f"(1.0e0 / 3.0e0) * {m}_p{k}" for m in _flow) for k in range(C)
) + " from oof"
ORACLES["survey_to_scores"] = f"""with {BUILDINGS},
  with_pga as (select *, {pga_sql(KM)} as pga from labelled),
  prepared as (select row_id, y, floor({filled('pga', 'with_pga')} * 20.0e0) as pga_bin,
    floor({filled('age_building', 'with_pga')} / 10.0e0) as age_bin,
    coalesce(roof_type, {mode_sql('roof_type', 'with_pga')}) as roof from with_pga),
  {folds_cte('prepared')}, {frequency_ctes(_flow)}, long as ({_flow_long}),
  scored as (select model, y, {argmax(P)} as yp, {loss_of('y', P)} as loss from long),
  {report_cte('scored', 'model')} select * from report"""


def meta_sql(enhanced: list[int], raw: list[int], mean_entropy: bool = True) -> list[tuple[str, str]]:
    """``(name, expression)`` in slot order; needs CTE ``averaged`` with mean_p0.. for ``enhanced``."""

    def figures(name: str, cols: list[str], n: int = 3) -> list[tuple[str, str]]:
        return [
            (f"{name}_top1", nth(cols, 1)),
            (f"{name}_margin", f"{nth(cols, 1)} - {nth(cols, 2)}"),
            (f"{name}_entropy", entropy(cols)),
        ][:n]

    mean = [f"mean_p{k}" for k in range(C)]
    out = [(c, c) for m in enhanced for c in block(m)]
    for m in enhanced:
        out += figures(f"m{m}", block(m))
    out += [(c, c) for c in mean] + figures("mean", mean, 3 if mean_entropy else 2)
    return out + [(c, c) for m in raw for c in block(m)]


def averaged(enhanced: list[int]) -> str:
    means = ", ".join(
        f"{add(f'm{m}_p{k}' for m in enhanced)} / {len(enhanced)}.0e0 as mean_p{k}" for k in range(C)
    )
    return f"averaged as (select *, {means} from signal)"


def meta_oracle(enhanced: list[int], raw: list[int], mean_entropy: bool = True) -> str:
    cols = ", ".join(f"{rnd(e)} as {n}" for n, e in meta_sql(enhanced, raw, mean_entropy))
    return f"with {SIGNAL}, {averaged(enhanced)} select row_id, {cols} from averaged"


ORACLES["meta_features"] = meta_oracle([0, 1, 2], [])
ORACLES["meta_features_short"] = meta_oracle([0, 1, 2], [], False)
ORACLES["meta_features_mixed"] = meta_oracle([0, 1], [2])
ORACLES["meta_dimension"] = f"with {SIGNAL} select {len(meta_sql([0, 1], [2]))} as meta_dim, count(*) as n from signal"
_strengths = " union all ".join(
    f"select 'm{m}' as model, avg(c) as strength from (" + " union all ".join(
        f"select abs(avg({c})) as c from signal group by y" for c in block(m)
    ) + ")"
    for m in range(K)
)
ORACLES["usage_share"] = f"""with {SIGNAL}, strengths as ({_strengths})
  select model, {rnd('strength')} as strength, {rnd('strength / ((select sum(strength) from strengths) + 1e-12)')} as share
  from strengths"""
_ablated = " union all ".join(
    f"select '{name}' as ablated, y, " + ", ".join(
        add(f"(1.0e0 / 3.0e0) * {'0.2e0' if name == f'm{m}' else f'm{m}_p{k}'}" for m in range(K)) + f" as p{k}"
        for k in range(C)
    ) + " from signal"
    for name in ("none", "m0", "m1", "m2")
)
ORACLES["ablation_blend"] = f"""with {SIGNAL}, variants as ({_ablated}),
  scored as (select ablated, y, {argmax(P)} as yp, 0.0e0 as loss from variants),
  {report_cte('scored', 'ablated').replace(rnd('avg(f)'), 'avg(f)').replace(rnd('sum(tp) / cast(sum(sup) as double)'), 'sum(tp) / cast(sum(sup) as double)')},
  base as (select accuracy as a, f1_macro as f from report where ablated = 'none')
  select ablated, {rnd('accuracy')} as accuracy, {rnd('f1_macro')} as f1_macro,
    {rnd('a - accuracy')} as accuracy_drop, {rnd('f - f1_macro')} as f1_macro_drop from report, base"""

# ---------------------------------------------------------------- calibration and boosting


def scaled_loss(t: str) -> str:
    z = [f"z{k} / {t}" for k in range(C)]
    top = f"greatest({', '.join(z)})"
    norm = add(f"exp({v} - {top})" for v in z)
    return f"-({pick('y', z)} - {top} - ln({norm}))"


ORACLES["temperature_grid"] = f"with {LOGITS} " + " union all ".join(
    f"select {t}e0 as temperature, {rnd(f'avg({scaled_loss(str(t) + 'e0')})')} as nll from logits"
    for t in TEMPERATURES
)


def newton_ctes(steps: int) -> str:
    """CTEs b0.. of the inverse temperature, each one Newton step further."""
    out = ["b0 as (select 0.1e0 as b)"]
    for i in range(steps):
        top = f"greatest({', '.join(f'z{k} * b' for k in range(C))})"
        e = ", ".join(f"exp(z{k} * b - {top}) as e{k}" for k in range(C))
        s = add(f"e{k}" for k in range(C))
        mean = f"({add(f'e{k} * z{k}' for k in range(C))} / {s})"
        square = f"({add(f'e{k} * z{k} * z{k}' for k in range(C))} / {s})"
        out.append(
            f"b{i + 1} as (select b - avg({mean} - {pick('y', Z)}) / avg({square} - {mean} * {mean}) as b"
            f" from (select y, {', '.join(Z)}, b, {e} from logits, b{i}) group by b)"
        )
    return ", ".join(out)


_after = scaled_loss("(1.0e0 / b)")
ORACLES["temperature_fit"] = f"""with {LOGITS}, {newton_ctes(12)}
  select {rnd('1.0e0 / max(b)', 6)} as temperature, {rnd(f'avg({scaled_loss("1.0e0")})', 6)} as nll_before,
    {rnd(f'avg({_after})', 6)} as nll_after from logits, b12"""


def isotonic_ctes(pools: dict[str, str]) -> str:
    """CTE ``fit_{name}`` (g, s, v) per pool: least-squares non-decreasing fit of ``select g, s, n, hits`` in each group
    ``g``, as a max over starts of a min over ends."""
    out = []
    for t, source in pools.items():
        out.append(f"""pool_{t} as (select g, s, n, hits, row_number() over w as i, sum(n) over w as cn, sum(hits) over w as ch
      from (select g, s, cast(count(*) as double) as n, cast(sum(hit) as double) as hits from ({source}) group by g, s)
      window w as (partition by g order by s)),
    runs_{t} as (select a.g, a.i as a, b.i as b, b.s, min((b.ch - a.ch + a.hits) / (b.cn - a.cn + a.n))
        over (partition by a.g, a.i order by b.i desc) as lowest
      from pool_{t} a join pool_{t} b on a.g = b.g and a.i <= b.i),
    fit_{t} as (select g, s, max(lowest) as v from runs_{t} group by g, s)""")
    return ", ".join(out)


def calibrated_sql(values: list[str]) -> list[str]:
    total = add(values)
    return [f"case when {total} > 0 then {v} / {total} else 0.2e0 end" for v in values]


_iso = {f"{m}_{k}": f"select 0 as g, {m}_p{k} as s, (y = {k})::int as hit from oof" for m in FREQUENCY for k in range(C)}
_iso_out = [
    f"{rnd(e)} as {m}_p{k}" for m in FREQUENCY for k, e in enumerate(calibrated_sql([f"fit_{m}_{j}.v" for j in range(C)]))
]
ORACLES["calibrate_isotonic"] = f"""with {BUILDINGS}, {folds_cte()}, {frequency_ctes(FREQUENCY)}, {isotonic_ctes(_iso)}
  select row_id, y, {', '.join(_iso_out)}
  from oof {' '.join(f'join fit_{m}_{k} on fit_{m}_{k}.s = oof.{m}_p{k}' for m in FREQUENCY for k in range(C))}"""
_floored = ", ".join(f"floor(m0_p{k} * 1000.0e0) / 1000.0e0 as s{k}" for k in range(C))
_iso = {str(k): f"select 0 as g, s{k} as s, (y = {k})::int as hit from floored" for k in range(C)}
_iso_out = [f"{rnd(e)} as p{k}" for k, e in enumerate(calibrated_sql([f"fit_{j}.v" for j in range(C)]))]
ORACLES["calibrate_many_scores"] = f"""with {SIGNAL}, floored as (select row_id, y, {_floored} from signal), {isotonic_ctes(_iso)}
  select row_id, y, {', '.join(_iso_out)} from floored {' '.join(f'join fit_{k} on fit_{k}.s = s{k}' for k in range(C))}"""
_counts = ", ".join(f"count(*) filter (where y = {k} and fold <> g) as n{k}" for k in range(C))
_total = add(f"n{k}" for k in range(C))
_shares3 = ", ".join(f"(n{k} + 1.0e0) / ({_total} + 5.0e0) as s{k}" for k in range(C))
_iso = {str(k): f"select g, s{k} as s, (y = {k})::int as hit from parts join thirds on fold = g and key is not distinct from roof_type" for k in range(C)}
_calibrated = ", ".join(f"{e} as q{k}" for k, e in enumerate(calibrated_sql([f"fit_{j}.v" for j in range(C)])))
_cross_out = ", ".join(f"{rnd(f'avg(q{k})')} as p{k}" for k in range(C))
ORACLES["calibrate_cross"] = f"""with {BUILDINGS}, {ranked('labelled', 'y', 42)},
  thirds as (select row_id, y, roof_type, (rk - 1) % 3 as fold from ranked),
  parts as materialized (select g, key, {_shares3} from (select part.range as g, roof_type as key, {_counts}
    from thirds, range(3) part group by part.range, roof_type)), {isotonic_ctes(_iso)},
  calibrated as (select parts.g, key, {_calibrated} from parts
    {' '.join(f'join fit_{k} on fit_{k}.g = parts.g and fit_{k}.s = s{k}' for k in range(C))})
  select row_id, y, {_cross_out} from thirds join calibrated on key is not distinct from roof_type group by row_id, y"""


def boost_ctes(keys: list[str]) -> str:
    """CTE f{i}: summed outputs s0.. after stage i."""
    out = []
    source = "split"
    for i, key in enumerate(keys):
        if i == 0:
            goal = [f"cast(y = {k} as int) * 1.0e0" for k in range(C)]
            out.append(f"g0 as (select *, {', '.join(f'{g} as g{k}' for k, g in enumerate(goal))} from split)")
        else:
            top = f"greatest({', '.join(f's{k}' for k in range(C))})"
            norm = add(f"exp(s{k} - {top})" for k in range(C))
            goal = [f"0.2e0 * ((y = {k})::int - exp(s{k} - {top}) / {norm})" for k in range(C)]
            out.append(f"g{i} as (select *, {', '.join(f'{g} as g{k}' for k, g in enumerate(goal))} from {source})")
        means = ", ".join(f"avg(g{k}) as a{k}" for k in range(C))
        out.append(f"h{i} as (select {key} as key, {means} from g{i} where split = 'train' group by 1)")
        before = [f"r.s{k} + " if i else "" for k in range(C)]
        sums = ", ".join(f"{before[k]}h{i}.a{k} as s{k}" for k in range(C))
        keep = ", ".join(f"r.{c}" for c in ("row_id", "y", "split", *keys))
        out.append(
            f"f{i} as (select {keep}, {sums} from {source} r join h{i} on r.{key} is not distinct from h{i}.key)"
        )
        source = f"f{i}"
    return ", ".join(out)


_boost = f"with {BUILDINGS}, {split_cte('labelled', 'y', '0.0e0', '0.3e0', 1)}, {boost_ctes(BOOST_KEYS)}"
ORACLES["boost_group_mean"] = (
    f"{_boost} select row_id, y, " + ", ".join(f"{rnd(f's{k}')} as s{k}" for k in range(C)) + " from f2"
)
S_COLS = [f"s{k}" for k in range(C)]
ORACLES["boost_accuracy"] = f"{_boost} " + " union all ".join(
    f"""select {i} as step, {rnd(f"avg(cast(y = {argmax(S_COLS)} as int)) filter (where split = 'train')")} as train_accuracy,
    {rnd(f"avg(cast(y = {argmax(S_COLS)} as int)) filter (where split = 'valid')")} as valid_accuracy from f{i}"""
    for i in range(len(BOOST_KEYS))
)

# ---------------------------------------------------------------- transfer and predict-only models

_transfer = {
    "by_floors": "floors",
    "by_engineered": "engineered",
    "by_ground_floor": "ground",
}


def fitted_ctes(keys: dict[str, str]) -> str:
    tables, joins, cols = [], [], []
    for i, (name, key) in enumerate(keys.items()):
        counts = ", ".join(f"count(*) filter (where y = {k}) as n{k}" for k in range(C))
        tables.append(f"t{i} as (select {key} as key, {counts} from home group by 1)")
        joins.append(f"left join t{i} on both_.{key} = t{i}.key")
        total = add(f"t{i}.n{j}" for j in range(C))
        cols += [f"coalesce((t{i}.n{k} + 1.0e0) / ({total} + 5.0e0), 0.2e0) as {name}_p{k}" for k in range(C)]
    return (
        ", ".join(tables)
        + f", blocks_of as (select both_.domain, both_.y, {', '.join(cols)} from both_ {' '.join(joins)})"
    )


_transfer_long = " union all ".join(
    f"select domain, '{m}' as model, y, " + ", ".join(f"{m}_p{k} as p{k}" for k in range(C)) + " from blocks_of"
    for m in _transfer
) + " union all select domain, 'blend', y, " + ", ".join(
    add(f"(1.0e0 / 3.0e0) * {m}_p{k}" for m in _transfer) for k in range(C)
) + " from blocks_of"
ORACLES["transfer_metrics"] = f"""with {BUILDINGS}, {FOREIGN},
  med as (select median(count_floors_pre_eq) as v from buildings),
  home as (select 'home' as domain, coalesce(count_floors_pre_eq, (select v from med)) as floors,
    has_superstructure_rc_engineered as engineered, ground_floor_type as ground, damage_grade - 1 as y from buildings),
  away as (select 'foreign' as domain, coalesce(stories, (select v from med)) as floors,
    coalesce(age <= 23, false)::int as engineered, 4 as ground, grade as y from graded where grade is not null),
  both_ as (select * from home union all select * from away), {fitted_ctes(_transfer)}, long as ({_transfer_long}),
  scored as (select domain, model, y, {argmax(P)} as yp, {loss_of('y', P)} as loss from long),
  {report_cte('scored', 'domain model')} select * from report"""
_linear = ", ".join(
    f"plinth_area_sq_ft * {(k + 1) * 0.0001!r}e0 + total_height_m * {-(k + 1) * 0.02!r}e0"
    f" + {add(FLAG_COLUMNS)} * {(k + 1) * 0.1!r}e0 as z{k}"
    for k in range(C)
)
ORACLES["score_linear_model"] = f"""with {BUILDINGS}, linear as (select row_id, y, {_linear} from labelled),
  {softmax_cte('probs', 'linear', 'row_id, y', Z)} select row_id, y, {_p_out} from probs"""

_shares = ", ".join(rnd(f"avg(cast(y = {k} as int))", 4) + f" as p{k}" for k in range(C))
ORACLES["logistic_saturated"] = (
    f"with {BUILDINGS}, {folds_cte()} select ground_floor_type, {_shares} from folds group by ground_floor_type"
)
ORACLES["logistic_out_of_fold"] = f"""with {BUILDINGS}, {folds_cte()},
  held as (select range as fold from range(5)), others as (select held.fold, y, ground_floor_type from folds join held on folds.fold <> held.fold)
  select ground_floor_type, cast(fold as int) as fold, {_shares} from others group by ground_floor_type, fold"""
