"""DuckDB oracle SQL for the SQL-expressible model jobs."""

from __future__ import annotations

from shiprisk.operators import sqlguard
from shiprisk.sources.testbed import duckdb_ctes

FEATURES = """
select order_item_id, shipping_mode, order_region, market, category_name,
       cast(order_item_discount_rate as double) as discount_rate, order_item_quantity as quantity,
       cast(month(order_date) as int) as order_month, cast(isodow(order_date) - 1 as int) as order_weekday,
       late_delivery_risk as label
from flat"""

SPLIT = """
select *, case when row_number() over (partition by label order by
                        cast(('0x' || substr(md5('42' || order_item_id), 1, 12)) as bigint), order_item_id)
                    <= (count(*) over (partition by label) * 20 + 50) // 100
               then 'test' else 'train' end as split
from features"""

RULE = """
select t.order_item_id, t.label, case when r.score >= 0.5 then 1 else 0 end as prediction, r.score
from split t join (select shipping_mode, cast(sum(label) as double) / count(*) as score
                   from split where split = 'train' group by 1) r on t.shipping_mode = r.shipping_mode
where t.split = 'test'"""


def W(body: str) -> str:
    return (f"with {duckdb_ctes()},\nfeatures as ({FEATURES}),\nsplit as ({SPLIT}),\n"
            f"rule as ({RULE}),\nq as ({body})\nselect * from q")


def ml() -> dict[str, str]:
    out = {}
    out["delivery_features"] = W("select * from features")
    cats = ["shipping_mode", "order_region", "market", "category_name"]
    out["one_hot_drop_first"] = W(" union all ".join(
        f"select order_item_id, '{c}_' || {c} as feature from features "
        f"where {c} <> (select min({c}) from features)" for c in cats))
    out["stratified_split"] = W("select order_item_id, label, split from split")
    out["split_balance"] = W("""select split, label, count(*) as n_rows,
        cast(round(count(*) * 100.0 / sum(count(*)) over (partition by split), 2) as double) as share_pct
        from split group by 1, 2""")
    out["class_weights"] = W("""select label, count(*) as n_rows,
        cast(sum(count(*)) over () as double) / cast(count(*) over () * count(*) as double) as weight
        from split where split = 'train' group by 1""")
    c = "(select count(case when label = 1 and prediction = 1 then 1 end) as tp, " \
        "count(case when label = 0 and prediction = 1 then 1 end) as fp, " \
        "count(case when label = 1 and prediction = 0 then 1 end) as fn, " \
        "count(case when label = 0 and prediction = 0 then 1 end) as tn from rule)"

    def div(a, b):
        return f"(case when ({b}) = 0 then 0.0 else cast({a} as double) / cast({b} as double) end)"

    def f1(p, r):
        return f"(case when {p} + {r} = 0 then 0.0 else 2 * {p} * {r} / ({p} + {r}) end)"

    m = (f"(select {div('tn', 'tn + fn')} as p0, {div('tn', 'tn + fp')} as r0, tn + fp as s0, "
         f"{div('tp', 'tp + fp')} as p1, {div('tp', 'tp + fn')} as r1, tp + fn as s1, "
         f"{div('tp + tn', 'tp + tn + fp + fn')} as acc from {c})")
    m2 = f"(select *, {f1('p0', 'r0')} as f0, {f1('p1', 'r1')} as f1 from {m})"
    n = "(s0 + s1)"
    wa = lambda a, b: f"(({a} * s0 + {b} * s1) / cast({n} as double))"
    out["classification_report"] = W(f"""
select '0' as class, round(p0, 4) as precision, round(r0, 4) as recall, round(f0, 4) as f1_score, s0 as support from {m2}
union all select '1', round(p1, 4), round(r1, 4), round(f1, 4), s1 from {m2}
union all select 'accuracy', null, null, round(acc, 4), {n} from {m2}
union all select 'macro avg', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4), {n} from {m2}
union all select 'weighted avg', round({wa('p0', 'p1')}, 4), round({wa('r0', 'r1')}, 4), round({wa('f0', 'f1')}, 4), {n} from {m2}""")
    out["roc_auc"] = W("""
select case when sum(pos) = 0 or sum(neg) = 0 then null
            else cast(sum(pos * (2 * neg_below + neg)) as double) / cast(2 * sum(pos) * sum(neg) as double) end as roc_auc,
       cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives
from (select s, pos, neg, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as neg_below
      from (select score as s, count(case when label = 1 then 1 end) as pos,
                   count(case when label = 0 then 1 end) as neg from rule group by 1))""")
    out["scored_rows"] = W("select order_item_id, label, true as consistent from split where split = 'test'")
    out["forest_rescored"] = W("select order_item_id, label, true as agrees from split where split = 'test'")
    levels = " + ".join(f"(select count(distinct {c}) - 1 from features)" for c in cats)
    out["importance_total"] = W(f"select 4 + {levels} as n_features, cast(1.0 as double) as total")
    out["logreg_gradient"] = W(f"""select (select count(*) from split where split = 'train') as n_rows,
        cast(4 + {levels} as int) as n_features, true as gradient_vanishes, true as step_vanishes""")
    numeric = ["discount_rate", "quantity", "order_month", "order_weekday"]
    out["importance_from_gains"] = W(" union all ".join(
        [f"select '{c}' as feature, true as agrees" for c in numeric]
        + [f"select distinct '{c}_' || {c}, true from features where {c} <> (select min({c}) from features)"
           for c in cats]))
    return out


STATEMENTS = r"""
select event_id, event_type,
  case when event_type = 'view' then 'SELECT shipping_mode, count(*) FROM shipments WHERE late_delivery_risk = '
                                     || cast(user_id % 2 as varchar) || ' GROUP BY shipping_mode'
       when event_type = 'click' then '```sql' || chr(10) || '  select * from order_items where order_id = '
                                     || cast(user_id as varchar) || chr(10) || '```'
       when event_type = 'purchase' then '  select sales from order_items where order_id = ' || cast(event_id as varchar) || ';;  '
       when event_type = 'error' then 'select 1; drop table shipments -- ' || cast(event_id as varchar)
       when event_type = 'signup' and user_id % 7 = 0 then 'select `reflect`(''java.lang.System'', ''getenv'', ''X'') from orders where order_id = '
                                     || cast(user_id as varchar)
       when event_type = 'signup' then 'with c as (select * from customers) select * from c where customer_id = ' || cast(user_id as varchar)
       else 'SELECT ''please delete '' || order_status FROM orders LIMIT ' || cast(user_id as varchar) end as raw_text
from events"""

EXTRACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  raw_text, '^\s+|\s+$', '', 'g'), '(?i)^```(sql)?', ''), '^\s+|\s+$', '', 'g'), '```$', ''), '^\s+|\s+$', '', 'g')"""

# FIXED VALUES: the words refused anywhere in a statement.
FORBIDDEN = ("(?i)\\b(insert|update|delete|drop|alter|truncate|attach|detach|pragma|create|replace"
             "|grant|revoke)\\b")


def guard() -> dict[str, str]:
    verdict = (f"case when not starts_with(lower(regexp_replace(sql_text, '^\\s+', '')), 'select') "
               f"then 'not_select' "
               f"when contains(regexp_replace(regexp_replace(sql_text, '^\\s+|\\s+$', '', 'g'), ';+$', ''), ';') "
               f"then 'multiple_statements' "
               f"when regexp_matches(sql_text, '{FORBIDDEN}') then 'forbidden_keyword' else 'ok' end")
    base = f"with st as ({STATEMENTS}), ex as (select event_id, {EXTRACT} as sql_text from st)"
    guarded = f"""with {duckdb_ctes()}
select p.product_name, s.shipping_mode, count(*) as total_shipments,
       cast(sum(s.late_delivery_risk) as bigint) as late_shipments
from t_order_items oi join t_products p on oi.product_card_id = p.product_card_id
join t_shipments s on oi.order_item_id = s.order_item_id
group by p.product_name, s.shipping_mode"""
    names = ", ".join(f"'{n}'" for n in [*sqlguard.ALLOWED_FUNCTIONS, *sqlguard.BEFORE_BRACKET])
    called = r"regexp_extract_all(sql_text, '([\p{L}_][\p{L}\p{N}_]*)`?\s*\(', 1)"
    strange = f"len([x for x in {called} if lower(x) not in ({names})]) > 0"
    check = f"case when {verdict} = 'ok' and {strange} then 'forbidden_function' else {verdict} end"
    return {
        "statement_check": f"{base} select event_id, {check} as verdict from ex",
        "extract_sql": f"{base} select * from ex",
        "guard_verdict": f"{base} select event_id, {verdict} as verdict from ex",
        "guarded_sql": guarded,
        "preview": f"select * from ({guarded}) order by product_name nulls first, "
                   f"shipping_mode nulls first, total_shipments nulls first, late_shipments nulls first limit 30",
    }
