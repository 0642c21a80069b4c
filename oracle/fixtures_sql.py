"""FIXTURES.md F1-F6 as DuckDB common table expressions for the oracle queries."""

from __future__ import annotations

from labelbench.constants import LABELS
from labelbench.sources.fixtures import LABEL_CUTOFFS

CUTOFFS = [LABEL_CUTOFFS[lab] for lab in LABELS]


def hex8(x: str, a: int) -> str:
    return f"cast('0x' || substr(md5({x}), {a}, 8) as bigint)"


def _label_expr(rid: str, lab: str, t: int) -> str:
    return f"case when {hex8(f'concat(cast({rid} as varchar), {chr(39)}:{lab}{chr(39)})', 1)} % 10 < {t} then 1 else 0 end"


def _p_expr(rid: str, lab: str, y: str) -> str:
    return (f"cast(({hex8(f'concat(cast({rid} as varchar), {chr(39)}:{lab}{chr(39)})', 9)} % 700) "
            f"+ 300 * {y} as double) / 1000")


REQ = f"""
req_raw as (
  select doc_id as row_id, doc_id as base_id, text, source from documents
  union all
  select doc_id + 1000000, doc_id, concat(chr(9), '  ', replace(text, 'the', 'THE'), '..', chr(10)), source
    from documents where doc_id % 10 = 0
  union all
  select doc_id + 2000000, doc_id, concat(text, ' ..'), source
    from documents where doc_id % 10 = 1
), req_y as (
  select r.row_id, r.text as description, r.source, cast(b.toxic as int) as ambuiguity,
         case when b.toxic = 1 then cast(1 + r.base_id % 5 as int) end as ambiguity_type,
         cast(null as varchar) as comments,
         {', '.join(_label_expr('r.row_id', l, t) + ' as ' + l for l, t in zip(LABELS, CUTOFFS))}
  from req_raw r left join labels b on r.base_id = b.doc_id
), req as (
  select *, case when row_id % 37 = 0 then 'n/a' when row_id % 41 = 0 then null
                 when {' + '.join(LABELS)} > 0 then '1' else '0' end as goal
  from req_y
)"""

PRED = "pred as (\n" + "\n  union all\n".join(
    f"  select row_id, '{l}' as label, {l} as y, {_p_expr('row_id', l, l)} as p from req where ambuiguity is not null"
    for l in LABELS) + "\n)"

LOGITS = "logits as (select row_id, label, y, (p - cast(0.2 as double)) * 10 as x from pred)"

PRED_BIG = "pred_big_wide as (select o_orderkey as row_id, " + ", ".join(
    _label_expr("o_orderkey", l, t) + " as " + l for l, t in zip(LABELS, CUTOFFS)) + " from orders),\n" + \
    "pred_big as (\n" + "\n  union all\n".join(
        f"  select row_id, '{l}' as label, {l} as y, {_p_expr('row_id', l, l)} as p from pred_big_wide"
        for l in LABELS) + "\n)"

HISTORY = """history as (
  select concat('order_', cast(l_orderkey as varchar)) as experiment, cast(l_linenumber as int) as epoch,
         min(l_tax) as train_loss, min(l_discount) as valid_loss
  from lineitem group by l_orderkey, l_linenumber
)"""

REWRITES = """rewrites as (
  select row_id, concat('rewritten ', cast(row_id as varchar)) as rewritten
  from req where ambuiguity = 1 and row_id % 2 = 0
)"""

_DEPS = {
    "req": [REQ],
    "pred": [REQ, PRED],
    "logits": [REQ, PRED, LOGITS],
    "pred_big": [PRED_BIG],
    "history": [HISTORY],
    "rewrites": [REQ, REWRITES],
}


def with_fixtures(*names: str) -> str:
    """A WITH prefix defining the named fixtures (and what they depend on)."""
    parts: list[str] = []
    for n in names:
        for p in _DEPS[n]:
            if p not in parts:
                parts.append(p)
    return "with " + ",\n".join(p.strip() for p in parts)
