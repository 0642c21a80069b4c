"""DuckDB oracle SQL, one statement per query key (column names match the Spark side)."""

from __future__ import annotations

from labelbench.constants import AMBIGUITY_TYPES, EXPERIMENT_DISPLAY_NAMES, NA_TOKENS

from .fixtures_sql import LABELS, with_fixtures as W

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NUM = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*\z"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def norm(x: str) -> str:
    return f"regexp_replace({strip(x)}, '\\.+\\z', '')"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{WS}+', ' ', 'g')"


def lenient(x: str) -> str:
    n = f"regexp_extract({x}, '{NUM}', 1)"
    return f"(case when {n} <> '' then cast(trunc(cast({n} as double)) as int) else 0 end)"


def pct(x: str, t: str) -> str:
    return f"round(coalesce({x} * cast(100 as double) / nullif({t}, 0), 0), 6)"


LABEL_COLS = ", ".join(LABELS)
REQ_COLS = ["row_id", "description", "source", "ambuiguity", "ambiguity_type", "comments", *LABELS, "goal"]
REQ_TYPES = ["bigint", "string", "string", "int", "int", "string"] + ["bigint"] * 6 + ["string"]

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- 2.2 filters / casts
SQL["filter_annotated"] = W("req") + """
select row_id, ambuiguity, ambiguity_type, source from req where ambuiguity is not null"""

SQL["labels_strict"] = W("req") + f"""
select row_id, {', '.join(f'cast({l} as int) as {l}' for l in LABELS)} from req where ambuiguity is not null"""

SQL["cast_lenient"] = W("req") + f"""
select row_id, goal, {lenient('goal')} as goal_int, {lenient('cast(ambuiguity as varchar)')} as ambuiguity_int
from req"""

# ---------------------------------------------------------------- 2.3 text
SQL["normalize_text"] = W("req") + f"""
select row_id, {strip('description')} as stripped, {norm('description')} as description,
       lower({norm('description')}) as dedupe_key
from req"""

SQL["collapse_ws"] = W("req") + f"""
select row_id, {collapse('description')} as collapsed from req"""

# ---------------------------------------------------------------- 2.4 aggregates / de-dup
_ANN_NORM = f""",
ann as (select row_id, {norm('description')} as description, {LABEL_COLS} from req where ambuiguity is not null)"""

SQL["duplicate_count"] = W("req") + _ANN_NORM + """
select cast(coalesce(sum(n - 1), 0) as bigint) as duplicates
from (select count(*) as n from ann group by lower(description))"""

SQL["dedupe_keep_first"] = W("req") + _ANN_NORM + f"""
select row_id, description, {LABEL_COLS} from ann
where row_id in (select min(row_id) from ann group by lower(description))"""

SQL["dedupe_by_repeats"] = SQL["dedupe_keep_first"]

SQL["duplicate_flags"] = W("req") + _ANN_NORM + """
select row_id, row_number() over (partition by lower(description) order by row_id) > 1 as is_duplicate from ann"""

SQL["label_counts"] = W("req") + ",\nw as (select " + ", ".join(
    f"cast(sum(coalesce({l}, 0)) as bigint) as {l}" for l in LABELS) + " from req where ambuiguity is not null)\n" + \
    "\nunion all\n".join(f"select {i} as position, '{l}' as label, {l} as positives from w"
                         for i, l in enumerate(LABELS))


def _dist(col_expr: str) -> str:
    return W("req") + f""",
a as (select {col_expr} as v from req where ambuiguity is not null),
w as (select cast(sum(case when v = 0 then 1 else 0 end) as bigint) as v0,
             cast(sum(case when v = 1 then 1 else 0 end) as bigint) as v1 from a)
select 0 as value, v0 as n, {pct('v0', 'v0 + v1')} as pct from w
union all
select 1 as value, v1 as n, {pct('v1', 'v0 + v1')} as pct from w"""


SQL["goal_distribution"] = _dist(lenient("goal"))
SQL["ambiguity_distribution"] = _dist("coalesce(ambuiguity, 0)")

SQL["label_by_ambiguity"] = W("req") + ",\nw as (select " + ", ".join(
    f"cast(sum(case when coalesce(cast(ambuiguity as double) <> 0, true) then coalesce({l}, 0) else 0 end) as bigint) as a_{l}, "
    f"cast(sum(case when coalesce(cast(ambuiguity as double) <> 0, true) then 0 else coalesce({l}, 0) end) as bigint) as n_{l}"
    for l in LABELS) + " from req where ambuiguity is not null)\n" + "\nunion all\n".join(
    f"select {i} as position, '{l}' as label, a_{l} as ambiguous, n_{l} as non_ambiguous, a_{l} + n_{l} as total, "
    f"{pct(f'a_{l}', f'a_{l} + n_{l}')} as ambiguous_pct, {pct(f'n_{l}', f'a_{l} + n_{l}')} as non_ambiguous_pct from w"
    for i, l in enumerate(LABELS))

SQL["null_profile"] = W("req") + ",\na as (select * from req where ambuiguity is not null)\n" + "\nunion all\n".join(
    f"select '{c}' as \"column\", cast(count(*) - count({c}) as bigint) as nulls from a" for c in REQ_COLS)

SQL["table_info"] = W("req") + ",\na as (select * from req where ambuiguity is not null)\n" + "\nunion all\n".join(
    f"select {i} as position, '{c}' as \"column\", '{t}' as dtype, cast(count({c}) as bigint) as non_null from a"
    for i, (c, t) in enumerate(zip(REQ_COLS, REQ_TYPES)))

# ---------------------------------------------------------------- subsets / split
TYPES = AMBIGUITY_TYPES
_PREP = f""",
prep_all as (select row_id, {norm('description')} as description, source, ambuiguity, ambiguity_type, comments,
                    {LABEL_COLS}, goal from req where ambuiguity is not null),
prep as (select * from prep_all where row_id in (select min(row_id) from prep_all group by lower(description)))"""

_SUITE_CONDS = [("baseline", "true"), ("no_ambiguity", "ambuiguity = 0")] + [
    (f"no_{n}_ambiguity", f"ambiguity_type is distinct from {c}") for c, n in TYPES.items()]

_SUITE = _PREP + ",\nsuite as (\n" + "\n  union all\n".join(
    f"  select '{e}' as experiment, row_id, description, {LABEL_COLS} from prep where {c}" for e, c in _SUITE_CONDS) + "\n)"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|\\P{{L}}+)', 1), "
            f"lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')")


def sanitize(x: str) -> str:
    s1 = f"regexp_replace({strip(x)}, '[^A-Za-z0-9._-]+', '_', 'g')"
    s2 = f"regexp_replace({s1}, '^[._-]+|[._-]+\\z', '', 'g')"
    return f"(case when {s2} = '' then 'experiment' else {s2} end)"


DISPLAY = EXPERIMENT_DISPLAY_NAMES


def display(x: str) -> str:
    cases = " ".join(f"when {x} = '{k}' then '{v}'" for k, v in DISPLAY.items())
    return f"(case {cases} else {title(f'replace({x}, {chr(39)}_{chr(39)}, {chr(39)} {chr(39)})')} end)"


SQL["prepare_baseline"] = W("req") + _PREP + f"""
select row_id, description, {LABEL_COLS} from prep"""

SQL["subset_no_ambiguity"] = W("req") + _PREP + f"""
select row_id, {LABEL_COLS} from prep where ambuiguity = 0"""

SQL["subset_drop_type"] = W("req") + _PREP + "\n" + "\nunion all\n".join(
    f"select {c} as dropped_type, row_id from prep where ambiguity_type is distinct from {c}" for c in TYPES)

SQL["filter_subset"] = W("req") + _PREP + """
select row_id from prep where (ambiguity_type is null or ambiguity_type <> 2) and compute = 1"""

SQL["subset_transform"] = W("req") + _PREP + """
select row_id, network, compute from prep where network + compute > 0"""

SQL["subset_suite"] = W("req") + _SUITE + """
select experiment, row_id from suite"""

SQL["subset_sizes"] = W("req") + _PREP + "\n" + "\nunion all\n".join(
    f"select '{'benchmark_all' if e == 'baseline' else e}' as dataset, cast(count(*) as bigint) as rows "
    f"from prep where {c}" for e, c in _SUITE_CONDS)

SQL["ambiguity_type_names"] = W("req") + """
select row_id, ambiguity_type, case ambiguity_type """ + " ".join(
    f"when {c} then '{n}'" for c, n in TYPES.items()) + """ end as type_name
from req where ambuiguity is not null"""

SQL["overlay_rewrites"] = W("rewrites") + _PREP + """
select p.row_id,
       case when p.ambuiguity = 1 and w.rewritten is not null then w.rewritten else p.description end as description,
       coalesce(p.ambuiguity = 1 and w.rewritten is not null, false) as is_rewritten
from prep p left join rewrites w on p.row_id = w.row_id"""

SQL["sanitize_name"] = W("req") + f"""
select row_id, {sanitize('description')} as safe_name from req"""

SQL["display_names"] = W("req") + _SUITE + f""",
names as (
  select experiment as name, count(*) as rows from suite group by experiment
  union all
  select {sanitize("concat(source, '_set')")} as name, count(*) as rows from req group by 1
)
select name, {display('name')} as display_name, cast(rows as bigint) as rows from names"""

_SPLIT = _SUITE + """,
ranked as (
  select *, row_number() over (partition by experiment order by md5(concat('42', ':', cast(row_id as varchar))), row_id) as rank,
         cast(ceil(cast(0.15 as double) * count(*) over (partition by experiment)) as bigint) as nv
  from suite
),
split as (
  select *, case when rank <= nv then 'valid' else 'train' end as split,
         case when rank <= nv then rank else rank - nv end as split_rank
  from ranked
)"""

SQL["split_exact"] = W("req") + _SPLIT + """
select experiment, row_id, cast(rank as bigint) as rank, split from split"""

SQL["batch_assign"] = W("req") + _SPLIT + """
select experiment, row_id, split, cast((split_rank - 1) // 16 as bigint) as batch_id from split"""

SQL["class_distribution"] = W("req") + _SPLIT + "\n" + "\nunion all\n".join(
    f"select experiment, split, '{l}' as label, cast(sum({l}) as bigint) as positives from split group by experiment, split"
    for l in LABELS)

SQL["dense_row_number"] = W("req") + _PREP + """
select row_id, cast(row_number() over (order by row_id) - 1 as bigint) as row_number from prep"""

# ---------------------------------------------------------------- metrics
T = "cast(0.2 as double)"
LABEL_LIST = "[" + ", ".join(f"'{l}'" for l in LABELS) + "]"
_CELLS = f""",
cells as (select row_id, label, y, p, case when p >= {T} then 1 else 0 end as yhat,
                 case when p > {T} then 1 else 0 end as yhat_gt,
                 list_position({LABEL_LIST}, label) - 1 as pos from pred),
conf as (select label, cast(count(*) filter (where y > 0 and yhat > 0) as bigint) as tp,
                cast(count(*) filter (where y = 0 and yhat > 0) as bigint) as fp,
                cast(count(*) filter (where y > 0 and yhat = 0) as bigint) as fn,
                cast(count(*) filter (where y = 0 and yhat = 0) as bigint) as tn from cells group by label),
rows_s as (select row_id, count(*) filter (where y > 0) as n_true, count(*) filter (where yhat > 0) as n_pred,
                  count(*) filter (where y > 0 and yhat > 0) as n_both,
                  count(*) filter (where (y > 0) <> (yhat > 0)) as n_wrong,
                  count(*) filter (where (y > 0) <> (yhat_gt > 0)) as n_wrong_gt from cells group by row_id),
req_flags as (select row_id, n_true > 0 as true_req, n_pred > 0 as pred_req from rows_s),
lists as (select row_id,
                 coalesce(string_agg(label, '|' order by pos) filter (where y = 1), '') as t_raw,
                 coalesce(string_agg(label, '|' order by pos) filter (where p > {T}), '') as p_raw,
                 string_agg(printf('%.3f', round(p, 3)), ',' order by pos) as probabilities
          from cells group by row_id),
sent as (select row_id, {norm('description')} as sentence from req where ambuiguity is not null),
results as (select l.row_id, s.sentence, replace(t_raw, '_', ' ') as true_label, replace(p_raw, '_', ' ') as predicted,
                   t_raw = p_raw as correctness, probabilities
            from lists l join sent s on l.row_id = s.row_id),
sconf as (select row_id, cast(predicted <> '' as int) as predicted, cast(true_label <> '' as int) as true_label,
                 sentence as text,
                 cast(predicted <> '' and true_label <> '' as int) as TP, cast(predicted = '' and true_label = '' as int) as TN,
                 cast(predicted <> '' and true_label = '' as int) as FP, cast(predicted = '' and true_label <> '' as int) as FN
          from results)"""


def sdiv(a: str, b: str) -> str:
    return f"coalesce(cast({a} as double) / nullif({b}, 0), 0)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


M = W("pred") + _CELLS

SQL["binarize_ge"] = M + "\nselect row_id, label, y, p, yhat from cells"
SQL["predicted_labels"] = M + "\nselect row_id, t_raw as true_labels, p_raw as predicted_labels from lists"
SQL["is_requirement"] = M + "\nselect row_id, true_req, pred_req from req_flags"
SQL["sentence_results"] = M + "\nselect row_id, sentence, true_label, predicted, correctness, probabilities from results"
SQL["sentence_confusion"] = M + "\nselect row_id, predicted, true_label, text, TP, TN, FP, FN from sconf"
SQL["precision_recall"] = M + f""",
t as (select cast(sum(TP) as bigint) as tp, cast(sum(TN) as bigint) as tn, cast(sum(FP) as bigint) as fp,
             cast(sum(FN) as bigint) as fn from sconf),
pr as (select *, {sdiv('tp', 'tp + fp')} as precision, {sdiv('tp', 'tp + fn')} as recall from t)
select tp, tn, fp, fn, {r6('precision')} as precision, {r6('recall')} as recall,
       {r6(sdiv('2 * precision * recall', 'precision + recall'))} as f1_score from pr"""
SQL["binary_confusion"] = M + """
select a as true_req, b as pred_req, cast(count(r.row_id) as bigint) as n
from (values (false), (true)) as x(a) cross join (values (false), (true)) as z(b)
left join req_flags r on r.true_req = a and r.pred_req = b group by a, b"""
SQL["binary_report"] = M + f""",
w as (select count(*) filter (where true_req and pred_req) as tp, count(*) filter (where not true_req and pred_req) as fp,
             count(*) filter (where true_req and not pred_req) as fn,
             count(*) filter (where not true_req and not pred_req) as tn from req_flags),
c as (select *, tp + fp + fn + tn as n,
             {sdiv('tn', 'tn + fn')} as p0, {sdiv('tn', 'tn + fp')} as r0, {sdiv('2 * tn', '2 * tn + fn + fp')} as f0, tn + fp as s0,
             {sdiv('tp', 'tp + fp')} as p1, {sdiv('tp', 'tp + fn')} as r1, {sdiv('2 * tp', '2 * tp + fp + fn')} as f1, tp + fn as s1
      from w)
select 0 as position, 'False' as row_name, {r6('p0')} as precision, {r6('r0')} as recall, {r6('f0')} as f1_score, cast(s0 as bigint) as support from c
union all select 1, 'True', {r6('p1')}, {r6('r1')}, {r6('f1')}, cast(s1 as bigint) from c
union all select 2, 'accuracy', null, null, {r6(sdiv('tp + tn', 'n'))}, cast(n as bigint) from c
union all select 3, 'macro avg', {r6('(p0 + p1) / 2')}, {r6('(r0 + r1) / 2')}, {r6('(f0 + f1) / 2')}, cast(n as bigint) from c
union all select 4, 'weighted avg', {r6(sdiv('p0 * s0 + p1 * s1', 'n'))}, {r6(sdiv('r0 * s0 + r1 * s1', 'n'))},
                 {r6(sdiv('f0 * s0 + f1 * s1', 'n'))}, cast(n as bigint) from c"""
SQL["per_label_confusion"] = M + "\nselect label, tp, fp, fn, tn from conf"
SQL["per_label_accuracy"] = M + f"\nselect label, {r6(sdiv('tp + tn', 'tp + fp + fn + tn'))} as accuracy from conf"
SQL["exact_match"] = M + f"""
select '>=' as comparator, cast(count(*) filter (where n_wrong = 0) as bigint) as exact_rows, cast(count(*) as bigint) as rows,
       {r6(sdiv('count(*) filter (where n_wrong = 0)', 'count(*)'))} as exact_match from rows_s
union all
select '>', cast(count(*) filter (where n_wrong_gt = 0) as bigint), cast(count(*) as bigint),
       {r6(sdiv('count(*) filter (where n_wrong_gt = 0)', 'count(*)'))} from rows_s"""
SQL["hamming_loss"] = M + f"""
select cast(count(*) filter (where (y > 0) <> (yhat > 0)) as bigint) as wrong_cells, cast(count(*) as bigint) as cells,
       {r6(sdiv('count(*) filter (where (y > 0) <> (yhat > 0))', 'count(*)'))} as hamming_loss from cells"""
SQL["jaccard_macro"] = M + f"\nselect {r6('avg(' + sdiv('tp', 'tp + fp + fn') + ')')} as jaccard from conf"
_SAMPLES = f"""select {r6('avg(' + sdiv('n_both', 'n_pred') + ')')} as precision, {r6('avg(' + sdiv('n_both', 'n_true') + ')')} as recall,
       {r6('avg(' + sdiv('2 * n_both', 'n_true + n_pred') + ')')} as f1_score, cast(sum(n_true) as bigint) as support,
       'samples avg' as row_name from rows_s"""
SQL["report_samples_avg"] = M + "\n" + _SAMPLES
SQL["classification_report"] = M + f""",
per as (select list_position({LABEL_LIST}, label) - 1 as position, replace(label, '_', ' ') as row_name,
               {sdiv('tp', 'tp + fp')} as precision, {sdiv('tp', 'tp + fn')} as recall,
               {sdiv('2 * tp', '2 * tp + fp + fn')} as f1_score, tp + fn as support, tp, fp, fn from conf),
tot as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, avg(precision) as m_p, avg(recall) as m_r, avg(f1_score) as m_f,
               sum(precision * support) as w_p, sum(recall * support) as w_r, sum(f1_score * support) as w_f,
               sum(support) as support from per),
s as ({_SAMPLES})
select cast(position as int) as position, row_name, {r6('precision')} as precision, {r6('recall')} as recall,
       {r6('f1_score')} as f1_score, cast(support as bigint) as support from per
union all select 6, 'micro avg', {r6(sdiv('tp', 'tp + fp'))}, {r6(sdiv('tp', 'tp + fn'))}, {r6(sdiv('2 * tp', '2 * tp + fp + fn'))},
                 cast(support as bigint) from tot
union all select 7, 'macro avg', {r6('m_p')}, {r6('m_r')}, {r6('m_f')}, cast(support as bigint) from tot
union all select 8, 'weighted avg', {r6(sdiv('w_p', 'support'))}, {r6(sdiv('w_r', 'support'))}, {r6(sdiv('w_f', 'support'))},
                 cast(support as bigint) from tot
union all select 9, row_name, precision, recall, f1_score, support from s"""

# ---------------------------------------------------------------- ROC
_ROC = """,
agg as (select label, p, count(*) filter (where y > 0) as pos, count(*) filter (where not (y > 0)) as neg
        from pred group by label, p
        union all
        select 'micro', p, count(*) filter (where y > 0), count(*) filter (where not (y > 0)) from pred group by p),
cum as (select label, p as threshold, pos, neg,
               sum(pos) over (partition by label order by p desc rows between unbounded preceding and current row) as tps,
               sum(neg) over (partition by label order by p desc rows between unbounded preceding and current row) as fps,
               sum(pos) over (partition by label) as P, sum(neg) over (partition by label) as N from agg),
pts as (select label, threshold, pos, neg, tps, fps, P, N from cum
        union all
        select label, null, 0, 0, 0, 0, max(P), max(N) from cum group by label),
rates as (select *, cast(fps as double) / nullif(cast(N as double), 0) as fpr,
                 cast(tps as double) / nullif(cast(P as double), 0) as tpr from pts),
auc as (select label, cast(sum(neg * (2 * tps - pos)) as double) / nullif(2.0 * max(P) * max(N), 0) as auc
        from rates group by label),
grid as (select l.label, k, case when k = 99 then cast(1 as double) else k * (cast(1 as double) / 99) end as x
         from (select distinct label from pred) l cross join range(100) t(k)),
ab as (select g.label, g.k, g.x,
              max(r.fpr) filter (where r.fpr <= g.x) as ax, max(r.tpr) filter (where r.fpr <= g.x) as ay,
              min(r.fpr) filter (where r.fpr > g.x) as bx, min(r.tpr) filter (where r.fpr > g.x) as by_
       from grid g join rates r on r.label = g.label and r.fpr is not null and r.tpr is not null
       group by g.label, g.k, g.x),
interp as (select g.label, g.k, g.x,
                  case when ab.ax is null then null
                       when ab.bx is null or ab.ax = g.x then ab.ay
                       else (ab.by_ - ab.ay) / (ab.bx - ab.ax) * (g.x - ab.ax) + ab.ay end as t
           from grid g left join ab on g.label = ab.label and g.k = ab.k),
curve as (select k, min(x) as fpr, case when count(t) = count(*) then avg(t) end as tpr from interp group by k),
macro as (select case when count(tpr) = count(*) then sum(s) end as auc
          from (select tpr, (lead(fpr) over (order by k) - fpr) * (tpr + lead(tpr) over (order by k)) / 2 as s from curve))"""
R = W("pred") + _ROC
SQL["roc_points"] = R + """
select label, threshold, cast(tps as bigint) as tps, cast(fps as bigint) as fps, round(fpr, 6) as fpr, round(tpr, 6) as tpr
from rates"""
SQL["roc_points_reduced"] = R + """,
near as (select *, lag(tps) over o as t0, lag(fps) over o as f0, lead(tps) over o as t2, lead(fps) over o as f2
         from rates window o as (partition by label order by threshold desc nulls first))
select label, threshold, cast(tps as bigint) as tps, cast(fps as bigint) as fps, round(fpr, 6) as fpr, round(tpr, 6) as tpr from near
where t0 is null or t2 is null or (tps - t0) * (f2 - fps) <> (fps - f0) * (t2 - tps)"""
SQL["roc_auc_per_label"] = R + "\nselect label, round(auc, 6) as auc from auc where label <> 'micro'"
SQL["roc_auc_micro"] = R + "\nselect label, round(auc, 6) as auc from auc where label = 'micro'"
SQL["roc_macro_curve"] = R + "\nselect cast(k as int) as k, round(fpr, 6) as fpr, round(tpr, 6) as tpr from curve"
SQL["roc_auc_macro"] = R + "\nselect 'macro' as label, round(auc, 6) as auc from macro"

# ---------------------------------------------------------------- loss history
_TRACE = """,
t1 as (select *, min(valid_loss) over (partition by experiment order by epoch
                                       rows between unbounded preceding and 1 preceding) as best_before from history),
t2 as (select *, coalesce(valid_loss > best_before, false) as is_worse from t1),
trace as (select *, coalesce(max(cast(is_worse as int)) over (partition by experiment order by epoch
                                 rows between unbounded preceding and 1 preceding), 0) = 0 as ran from t2)"""
SQL["early_stop_trace"] = W("history") + _TRACE + """
select experiment, epoch, valid_loss, best_before, is_worse, ran, ran and not is_worse as saved from trace"""
SQL["best_epoch"] = W("history") + _TRACE + """
select experiment, cast(count(*) as int) as epochs_run, max(epoch) filter (where not is_worse) as best_epoch,
       arg_max(valid_loss, epoch) filter (where not is_worse) as best_valid_loss,
       arg_max(train_loss, epoch) filter (where not is_worse) as best_train_loss,
       max(cast(is_worse as int)) = 1 as stopped_early
from trace where ran group by experiment"""
_BCE = "greatest(x, cast(0 as double)) - x * y + ln(1 + exp(-abs(x)))"
SQL["sigmoid_scores"] = W("logits") + "\nselect row_id, label, round(1 / (1 + exp(-x)), 6) as p from logits"
SQL["bce_loss"] = W("logits") + f"\nselect round(avg({_BCE}), 6) as bce, cast(count(*) as bigint) as cells from logits"
SQL["bce_batch_mean"] = W("logits") + f""",
rows_ as (select row_id, (row_number() over (order by md5(concat('42', ':', cast(row_id as varchar))), row_id) - 1) // 16
                 as batch_id from (select distinct row_id from logits)),
b as (select r.batch_id, avg({_BCE}) as batch_loss from logits l join rows_ r on l.row_id = r.row_id group by r.batch_id)
select round(avg(batch_loss), 6) as bce_batch_mean, cast(count(*) as bigint) as batches from b"""

# ---------------------------------------------------------------- encoding
TOKEN_RE = r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"
_VOCAB = _PREP + f""",
tk as (select row_id, regexp_extract_all(lower({collapse('description')}), '{TOKEN_RE}', 1) as toks from prep),
voc as (select token, cast(count(*) as bigint) as count from (select unnest(toks) as token from tk) group by token),
vocab as (select token, cast(row_number() over (order by md5(concat('0', ':', token)), token) + 3 as int) as token_id, count
          from voc)"""
SQL["build_vocab"] = W("req") + _VOCAB + "\nselect token, token_id, count from vocab"
SQL["encode_tokens"] = W("req") + _VOCAB + """,
ex as (select row_id, unnest(toks) as token, unnest(generate_series(0, len(toks) - 1)) as pos from tk),
ids as (select e.row_id, string_agg(cast(coalesce(v.token_id, 1) as varchar), ' ' order by e.pos) as s, count(*) as n
        from ex e left join vocab v on e.token = v.token where e.pos < 298 group by e.row_id)
select t.row_id, '2' || coalesce(' ' || ids.s, '') || ' 3' || repeat(' 0', cast(298 - coalesce(ids.n, 0) as int)) as input_ids,
       cast(coalesce(ids.n, 0) + 2 as int) as attention_len, 300 as type_len, cast(len(t.toks) as int) as n_tokens
from tk t left join ids on t.row_id = ids.row_id"""

_PIECES = _VOCAB + """,
ch as (select token, count, unnest(range(1, length(token) + 1)) as i from vocab),
cand as (select substr(token, cast(i as int), 1) as piece, i > 1 as inside, cast(sum(count) as bigint) as count, 0 as word from ch group by all
         union all select token, inside, count, 1 from vocab, (select unnest([false, true]) as inside) where length(token) > 1),
pieces as (select piece, inside, cast(row_number() over (order by word, count desc, piece, inside) + 3 as int) as piece_id from cand
           qualify row_number() over (order by word, count desc, piece, inside) <= 2000)"""
SQL["build_pieces"] = W("req") + _PIECES + "\nselect piece, inside, piece_id from pieces"
SQL["encode_subwords"] = W("req").replace("with", "with recursive", 1) + _PIECES + """,
sizes as (select distinct length(piece) as n from pieces),
hits as (select token, i, arg_max(piece_id, length(piece)) as id, max(length(piece)) as n
         from (select token, i, n, substr(token, cast(i as int), cast(n as int)) as part from ch, sizes where i + n <= length(token) + 1) c
         join pieces p on p.piece = c.part and p.inside = (c.i > 1) group by 1, 2),
walk as (select token, cast(1 as bigint) as i, cast([] as int[]) as ids from vocab where length(token) <= 100
         union all select walk.token, cast(walk.i + hits.n as bigint), list_append(walk.ids, hits.id) from walk join hits on hits.token = walk.token and hits.i = walk.i),
cut as (select token, max(ids) filter (where i = length(token) + 1) as ids from walk group by 1),
ex as (select row_id, unnest(toks) as token, unnest(generate_series(0, len(toks) - 1)) as pos from tk),
sub as (select row_id, flatten(list(coalesce(ids, [1]) order by pos))[1:298] as ids from ex left join cut using (token) group by 1)
select t.row_id, '2' || coalesce(' ' || array_to_string(ids, ' '), '') || ' 3' || repeat(' 0', cast(298 - coalesce(len(ids), 0) as int)) as input_ids,
       cast(coalesce(len(ids), 0) + 2 as int) as attention_len, 300 as type_len, cast(len(t.toks) as int) as n_tokens
from tk t left join sub using (row_id)"""

# ---------------------------------------------------------------- sources / experiments
from .fixtures_sql import _p_expr  # noqa: E402

NA = NA_TOKENS
_NA_LIST = ", ".join("'" + t + "'" for t in NA)


def na(x: str) -> str:
    return f"case when {x} in ({_NA_LIST}) then null else {x} end"


SQL["scan_csv_typed"] = W("req") + f"""
select row_id, {na('description')} as description, {na('source')} as source, cast(ambuiguity as double) as ambuiguity,
       cast(ambiguity_type as double) as ambiguity_type, {na('comments')} as comments, {LABEL_COLS}, {na('goal')} as goal from req"""
SQL["scan_csv_splits"] = SQL["scan_csv_typed"]
SQL["scan_csv_header"] = W("req") + f"""
select row_number() over (order by row_id) - 1 as row_id, {na('goal')} as goal, {LABEL_COLS}, {na('description')} as description,
       {na('comments')} as comments, cast(ambiguity_type as double) as ambiguity_type, cast(ambuiguity as double) as ambuiguity,
       {na('source')} as source from req"""
SQL["scan_csv_annotations"] = W("req") + """
select row_id, row_id % 7 in (0, 2) as malformed,
       case row_id % 7 when 4 then 10000000000 when 5 then row_id % 2 when 6 then row_id % 2 else 0 end as as_int,
       row_id % 7 in (5, 6) and row_id % 2 = 0 as not_ambiguous
from req where row_id % 7 <> 3"""

_EXP = _SPLIT + ",\nvpred as (\n" + "\n  union all\n".join(
    f"  select experiment, row_id, '{l}' as label, {l} as y, {_p_expr('row_id', l, l)} as p, {i} as pos "
    f"from split where split = 'valid'" for i, l in enumerate(LABELS)) + f"\n),\n" + f"""vcells as (select *, case when p >= {T} then 1 else 0 end as yhat from vpred),
vrows as (select experiment, row_id, count(*) filter (where (y > 0) <> (yhat > 0)) as n_wrong from vcells group by 1, 2),
vconf as (select experiment, label, count(*) filter (where y > 0 and yhat > 0) as tp, count(*) filter (where y = 0 and yhat > 0) as fp,
                 count(*) filter (where y > 0 and yhat = 0) as fn from vcells group by 1, 2),
vlists as (select experiment, row_id,
                  coalesce(string_agg(label, '|' order by pos) filter (where y = 1), '') as t_raw,
                  coalesce(string_agg(label, '|' order by pos) filter (where p > {T}), '') as p_raw
           from vcells group by 1, 2),
vsc as (select experiment, row_id, cast(p_raw <> '' as int) as predicted, cast(t_raw <> '' as int) as true_label,
               cast(p_raw <> '' and t_raw <> '' as int) as TP, cast(p_raw = '' and t_raw = '' as int) as TN,
               cast(p_raw <> '' and t_raw = '' as int) as FP, cast(p_raw = '' and t_raw <> '' as int) as FN,
               t_raw = p_raw as correctness from vlists),
vpr as (select experiment, sum(TP) as tp, sum(TN) as tn, sum(FP) as fp, sum(FN) as fn,
               count(*) as n, count(*) filter (where correctness) as correct from vsc group by 1),
vpr2 as (select *, {sdiv('tp', 'tp + fp')} as precision, {sdiv('tp', 'tp + fn')} as recall from vpr),
arte as (select experiment as experiment_key, {display('experiment')} as experiment, cast(n as bigint) as validation_sentences,
                cast(correct as bigint) as correct_sentences, round({sdiv('correct', 'n')}, 6) as exact_match_accuracy,
                round(precision, 6) as precision, round(recall, 6) as recall,
                round({sdiv('2 * precision * recall', 'precision + recall')}, 6) as f1_score,
                cast(tp as bigint) as tp, cast(tn as bigint) as tn, cast(fp as bigint) as fp, cast(fn as bigint) as fn
         from vpr2)"""
E = W("req") + _EXP

SQL["results_roundtrip"] = E + "\nselect experiment, row_id, predicted, true_label, TP, TN, FP, FN, correctness from vsc"
SQL["experiment_summary"] = E + f""",
sizes as (select experiment, cast(count(*) filter (where split = 'train') as bigint) as train_size,
                 cast(count(*) filter (where split = 'valid') as bigint) as val_size from split group by 1),
em as (select experiment, {sdiv('count(*) filter (where n_wrong = 0)', 'count(*)')} as exact_match_accuracy from vrows group by 1),
hl as (select experiment, {sdiv('count(*) filter (where (y > 0) <> (yhat > 0))', 'count(*)')} as hamming_loss from vcells group by 1),
jc as (select experiment, avg({sdiv('tp', 'tp + fp + fn')}) as jaccard_score from vconf group by 1)
select s.experiment, s.train_size, s.val_size, round(em.exact_match_accuracy, 6) as exact_match_accuracy,
       round(hl.hamming_loss, 6) as hamming_loss, round(jc.jaccard_score, 6) as jaccard_score,
       round(p.precision, 6) as precision, round(p.recall, 6) as recall,
       cast(null as varchar) as best_model_path, cast(null as varchar) as validation_results_path
from sizes s left join em using (experiment) left join hl using (experiment) left join jc using (experiment)
left join vpr2 p using (experiment)"""
SQL["artifact_summary"] = E + "\nselect * from arte"
SQL["metrics_long"] = E + """
select experiment, 'precision' as metric, precision as score from arte
union all select experiment, 'recall', recall from arte
union all select experiment, 'f1_score', f1_score from arte"""
SQL["confusion_rates"] = E + ",\nct as (select *, tp + tn + fp + fn as tot from arte)\nselect experiment, " + ", ".join(
    f"round(cast({c} as double) / nullif(tot, 0), 6) as {c}" for c in ("tp", "tn", "fp", "fn")) + " from ct"


# areas as the share of (positive, negative) pairs in the right order, ties counting half
def _auc(cells: str, by: str) -> str:
    return (f"select {by}, sum(case when y > 0 then below + same / cast(2 as double) end) / nullif(sum(y) * sum(1 - y), 0) as auc from ("
            f"select *, coalesce(sum(1 - y) over (partition by {by} order by p range between unbounded preceding and current row), 0) "
            f"- sum(1 - y) over (partition by {by}, p) as below, sum(1 - y) over (partition by {by}, p) as same from {cells}) group by {by}")


SQL["evaluate_bundle"] = E + f""",
em as (select experiment, {sdiv('count(*) filter (where n_wrong = 0)', 'count(*)')} as em from vrows group by 1),
hl as (select experiment, {sdiv('count(*) filter (where (y > 0) <> (yhat > 0))', 'count(*)')} as hl from vcells group by 1),
jc as (select experiment, avg({sdiv('tp', 'tp + fp + fn')}) as jc from vconf group by 1),
la as ({_auc('vpred', 'experiment, label')}),
ma as ({_auc('vpred', 'experiment')}),
rq as (select experiment, count(*) filter (where t and h) as n from (select experiment, row_id, bool_or(y > 0) as t, bool_or(yhat > 0) as h from vcells group by 1, 2) group by 1)
select em.experiment, round(em, 6) as exact_match_accuracy, round(hl, 6) as hamming_loss, round(jc, 6) as jaccard_score,
       round(ma.auc, 6) as auc_micro, round((select avg(auc) from la where la.experiment = em.experiment), 6) as auc_mean, n as both_req
from em join hl using (experiment) join jc using (experiment) join ma using (experiment) join rq using (experiment)"""

SQL["suite_with_rewrites"] = W("rewrites") + _EXP + """
select 'baseline' as experiment, v.row_id, p.description as sentence, v.correctness
from vsc v join prep p on p.row_id = v.row_id where v.experiment = 'baseline'
union all
select 'rewritten', v.row_id, case when p.ambuiguity = 1 and w.rewritten is not null then w.rewritten else p.description end, v.correctness
from vsc v join prep p on p.row_id = v.row_id left join rewrites w on w.row_id = v.row_id where v.experiment = 'baseline'"""

_SIZES = """select experiment, cast(count(*) filter (where split = 'train') as bigint) as train_size,
       cast(count(*) filter (where split = 'valid') as bigint) as val_size"""
SQL["train_multilabel_facts"] = W("req") + _SPLIT + f"""
{_SIZES}, true as from_one, true as never_rises, true as valid_loss_positive from split where experiment = 'baseline' group by 1"""
SQL["score_multilabel_facts"] = W("req") + _SPLIT + "\n" + "\nunion all\n".join(
    f"select experiment, row_id, '{l}' as label, {l} as y, true as p_is_probability from split where split = 'valid' and experiment = 'baseline'" for l in LABELS)
SQL["score_text_facts"] = W("req") + f"""
select row_id, {len(LABELS)} as n_probabilities, true as in_range, true as above_threshold from req where ambuiguity is null"""
SQL["run_suite_facts"] = W("req") + _SPLIT + f"""
{_SIZES}, true as has_models, true as has_results from split group by 1"""

_PRIMES = [65_537, 131_101, 262_147, 524_309, 786_433, 917_519, 1_048_573]  # fixed values


def _epoch(e: int, seed: int = 42) -> str:
    a, b, c, d = (_PRIMES[(seed + e + k) % 7] for k in range(4))
    return (f"select experiment, row_id, {e} as epoch, ((split_rank - 1) * case when n % {a} <> 0 then {a} when n % {b} <> 0 then {b} "
            f"when n % {c} <> 0 then {c} else {d} end + {(seed * 7_919 + e * 104_729) % 2**31}) % n as k "
            "from (select *, count(*) over (partition by experiment) as n from split where split = 'train')")


SQL["epoch_batches"] = W("req") + _SPLIT + f"""
select experiment, row_id, epoch, cast(k // 16 as bigint) as batch, cast(k % 16 as bigint) as place
from ({" union all ".join(_epoch(e) for e in (1, 2, 3))})"""
SQL["train_joint_facts"] = W("req") + _SPLIT + """
select experiment, cast(count(*) filter (where split = 'train') as bigint) as train_size, cast(count(*) filter (where split = 'valid') as bigint) as val_size,
       cast(ceil(count(*) filter (where split = 'train') / 4096.0) as bigint) as steps, true as no_gaps, true as learns from split group by 1"""
SQL["score_joint_facts"] = W("req") + _SPLIT + "\n" + "\nunion all\n".join(
    f"select experiment, row_id, '{l}' as label, {l} as y, true as p_is_probability from split where split = 'valid'" for l in LABELS)
