"""DuckDB oracle SQL for the source, cleaning, audit and join jobs."""

from __future__ import annotations

from shiprisk.checks.oracle import CUTOFF

from shiprisk.schemas import (
    INT_COLUMNS, JUNK_COLUMNS, KEY_COLUMNS, NULL_FILLS, NUMERIC_COLUMNS, PII_COLUMNS, PRIMARY_KEYS,
    TABLE_COLUMNS, FOREIGN_KEYS, DEDUPED_TABLES,
)
from shiprisk.sources.testbed import FLAT_ORDER, RAW_ORDER, duckdb_ctes

# Decimal columns (raw and star names); the jobs hand them out as DOUBLE.
DECIMAL_NAMES = set(NUMERIC_COLUMNS) | {
    "product_price", "discount", "discount_rate", "profit_ratio", "sales", "order_item_total",
    "profit_per_order", "benefit_per_order", "sales_per_customer", "latitude", "longitude",
    "catalog_price",
}

DUCK_TYPES = {"int": "INTEGER", "decimal(10,2)": "DECIMAL(10,2)", "decimal(6,4)": "DECIMAL(6,4)",
              "decimal(10,4)": "DECIMAL(10,4)", "decimal(10,6)": "DECIMAL(10,6)",
              "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "bigint": "BIGINT"}


def edge(cols: list[str], alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(f"cast({p}{c} as double) as {c}" if c in DECIMAL_NAMES else f"{p}{c}"
                     for c in cols)


def fill(c: str) -> str:
    if c in NULL_FILLS:
        v = NULL_FILLS[c]
        return f"coalesce({c}, {repr(v) if isinstance(v, str) else v}) as {c}"
    return c


CLEAN_COLS = [c for c in RAW_ORDER if c not in JUNK_COLUMNS]


def W(body: str) -> str:
    clean_sel = ", ".join(fill(c) for c in CLEAN_COLS)
    return f"""with {duckdb_ctes()},
raw_dups as (select * from typed union all select * from typed where order_status = 'P'),
cleaned as (select *, days_for_shipping_real - days_for_shipment_scheduled as delay_days
            from (select distinct {clean_sel} from raw_dups)),
q as ({body})
select * from q"""


def _bronze_names() -> list[str]:
    return [{"order_date": "order_date_dateorders",
             "shipping_date": "shipping_date_dateorders"}.get(c, c) for c in RAW_ORDER]


def _first_per_key(table: str) -> str:
    pairs = TABLE_COLUMNS[table]
    key = PRIMARY_KEYS[table]
    cols = ", ".join(f"{s} as {o}" for o, s in pairs)
    return (f"select {', '.join(o for o, _ in pairs)} from (select {cols}, row_number() over "
            f"(partition by {dict(pairs)[key]} order by order_item_id) as rn from cleaned) where rn = 1")


def _projection(table: str, source: str) -> str:
    return f"select {', '.join(f'{s} as {o}' for o, s in TABLE_COLUMNS[table])} from {source}"


def jobs(flat_types: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    flat_edge = edge(FLAT_ORDER)
    out["csv_bronze_roundtrip"] = W(f"select {flat_edge} from flat")
    out["silver_flat"] = W(f"select {edge(FLAT_ORDER)} from (select * exclude ({', '.join(PII_COLUMNS)}) from cleaned)")
    bronze = _bronze_names()
    out["snake_case_columns"] = W("select " + ", ".join(
        (f"cast({r} as double) as {b}" if r in DECIMAL_NAMES else f"{r} as {b}")
        for r, b in zip(RAW_ORDER, bronze)) + " from typed")
    out["drop_columns"] = W(f"select {edge([c for c in RAW_ORDER if c not in JUNK_COLUMNS])} from typed")
    out["cast_columns"] = W(f"select {edge(RAW_ORDER)} from typed")
    tc = []
    for c in INT_COLUMNS + NUMERIC_COLUMNS:
        if c in INT_COLUMNS:
            whole = "BIGINT" if c in KEY_COLUMNS else "INTEGER"
            tc.append(f"try_cast(cast({c} as varchar) as {whole}) as {c}")
        else:
            tc.append(f"cast(try_cast(cast({c} as varchar) as {DUCK_TYPES[_NUM_TYPES[c]]}) as double) as {c}")
    out["try_cast_columns"] = W("select " + ", ".join(tc) + " from typed")
    out["parse_timestamps"] = W("select order_item_id, order_date, shipping_date from typed")
    out["fill_nulls"] = W("select order_item_id, " + ", ".join(fill(c) for c in NULL_FILLS) + " from typed")
    out["drop_exact_duplicates"] = W(f"select distinct {edge(RAW_ORDER)} from raw_dups")
    out["dedupe_counts"] = W("""select (select count(*) from raw_dups) as rows_before,
        (select count(*) from (select distinct * from raw_dups)) as rows_after,
        (select count(*) from raw_dups) - (select count(*) from (select distinct * from raw_dups)) as duplicates_removed""")
    out["delay_days"] = W("select order_item_id, days_for_shipping_real, days_for_shipment_scheduled, delay_days from flat")
    out["dedupe_by_key"] = W("""select order_id, order_item_id, order_status, market from (
        select order_id, order_item_id, order_status, market,
               row_number() over (partition by order_id order by order_item_id) as rn from raw_dups) where rn = 1""")
    for table, key in [("categories", "dim_categories"), ("products", "dim_products"),
                       ("customers", "dim_customers"), ("orders", "fact_orders"),
                       ("order_items", "fact_order_items"), ("shipments", "fact_shipments")]:
        cols = [o for o, _ in TABLE_COLUMNS[table]]
        body = _first_per_key(table) if table in DEDUPED_TABLES else _projection(table, "cleaned")
        out[key] = W(f"select {edge(cols)} from ({body})")
    # audits
    out["profile_columns"] = W(" union all ".join(
        f"select '{c}' as column_name, '{flat_types[c]}' as data_type, count({c}) as non_null_count, "
        f"count(*) as row_count from flat" for c in FLAT_ORDER))
    out["null_counts"] = W("select * from (" + " union all ".join(
        f"select '{c}' as column_name, count(*) - count({c}) as null_count from typed"
        for c in RAW_ORDER) + ") where null_count > 0")
    out["null_total"] = W("select cast(" + " + ".join(f"(count(*) - count({c}))" for c in RAW_ORDER)
                          + " as bigint) as null_cells from typed")
    out["duplicate_row_count"] = W("""select count(*) as n_rows,
        (select count(*) from (select distinct * from raw_dups)) as n_distinct,
        count(*) - (select count(*) from (select distinct * from raw_dups)) as duplicate_rows from raw_dups""")
    out["table_row_counts"] = W(" union all ".join(
        f"select '{t}' as table_name, count(*) as n_rows from t_{t}" for t in TABLE_COLUMNS))
    pk_parts, own_parts = [], []
    for t, k in PRIMARY_KEYS.items():
        src = dict(TABLE_COLUMNS[t])[k]
        filled = "(select " + ", ".join(fill(c) for c in RAW_ORDER) + " from raw_dups)"
        own_parts.append(f"""select '{t}' as table_name, '{k}' as key_column, cast(sum(n) as bigint) as n_rows,
            count(k) as n_keys, cast(coalesce(sum(case when k is null then n end), 0) as bigint) as null_key_rows,
            count(case when k is not null and n > 1 then 1 end) as duplicated_keys,
            cast(coalesce(sum(case when k is not null and n > 1 then n - 1 end), 0) as bigint) as excess_rows
            from (select {k} as k, count(*) as n from t_{t} group by 1)""")
        pk_parts.append(f"""select '{t}' as table_name, '{k}' as key_column, cast(sum(n) as bigint) as n_rows,
            count(k) as n_keys, cast(coalesce(sum(case when k is null then n end), 0) as bigint) as null_key_rows,
            count(case when k is not null and n > 1 then 1 end) as duplicated_keys,
            cast(coalesce(sum(case when k is not null and n > 1 then n - 1 end), 0) as bigint) as excess_rows
            from (select {src} as k, count(*) as n from {filled} group by 1)""")
    out["pk_violations"] = W(" union all ".join(own_parts))
    out["raw_key_repeats"] = W(" union all ".join(pk_parts))
    fk_parts = []
    for ct, cc, pt, pc in FOREIGN_KEYS:
        fk_parts.append(f"""select '{ct}.{cc} -> {pt}.{pc}' as relation,
            (select count(*) from t_{ct} c where c.{cc} is not null and not exists
               (select 1 from t_{pt} p where p.{pc} = c.{cc})) as orphan_rows,
            (select count(*) from t_{pt} p where p.{pc} is not null and not exists
               (select 1 from t_{ct} c where c.{cc} = p.{pc})) as childless_parents""")
    out["fk_orphans"] = W(" union all ".join(fk_parts))
    kc = []
    for t in DEDUPED_TABLES:
        pairs = TABLE_COLUMNS[t]
        key = dict(pairs)[PRIMARY_KEYS[t]]
        payload = [src for _, src in pairs if src != key]
        kc.append(f"""select '{t}' as table_name, '{key}' as key_column, count(*) as n_keys,
            count(case when v > 1 then 1 end) as conflicting_keys
            from (select {key}, count(distinct ({', '.join(payload)})) as v from cleaned group by {key})""")
    out["key_conflicts"] = W(" union all ".join(kc))
    out["reconcile_flat_vs_relational"] = W("""
select coalesce(f.shipping_mode, r.shipping_mode) as shipping_mode, coalesce(f.market, r.market) as market,
       f.n as flat_total_shipments, r.n as rel_total_shipments,
       f.late as flat_late_shipments, r.late as rel_late_shipments,
       (f.n is not distinct from r.n) and (f.late is not distinct from r.late) as matches
from (select shipping_mode, market, count(*) as n, cast(sum(late_delivery_risk) as bigint) as late
      from flat group by 1, 2) f
full outer join (select s.shipping_mode, o.market, count(*) as n, cast(sum(s.late_delivery_risk) as bigint) as late
      from t_order_items oi join t_shipments s on oi.order_item_id = s.order_item_id
      join t_orders o on oi.order_id = o.order_id group by 1, 2) r
  on f.shipping_mode = r.shipping_mode and f.market = r.market""")
    # joins
    out["join_items_orders"] = W(f"""select oi.order_item_id, oi.order_id, o.customer_id, o.order_date,
        o.market, o.order_region, cast(oi.sales as double) as sales
        from t_order_items oi join t_orders o on oi.order_id = o.order_id""")
    out["join_items_shipments"] = W("""select oi.order_item_id, oi.order_id, s.shipping_mode,
        s.late_delivery_risk, oi.quantity, cast(oi.sales as double) as sales
        from t_order_items oi join t_shipments s on oi.order_item_id = s.order_item_id""")
    out["join_items_products"] = W("""select oi.order_item_id, oi.product_card_id, p.product_name,
        p.category_id, cast(oi.sales as double) as sales
        from t_order_items oi join t_products p on oi.product_card_id = p.product_card_id""")
    out["join_products_categories"] = W("""select p.product_card_id, p.product_name, p.category_id,
        c.category_name, c.department_name
        from t_products p join t_categories c on p.category_id = c.category_id""")
    out["join_orders_customers"] = W("""select o.order_id, o.customer_id, cu.segment, cu.country,
        o.order_country, o.market
        from t_orders o join t_customers cu on o.customer_id = cu.customer_id""")
    out["star_join"] = W("""select oi.order_item_id, oi.order_id, o.customer_id, oi.product_card_id,
        p.category_id, c.category_name, c.department_name, cu.segment, s.shipping_mode, o.market,
        o.order_region, cast(oi.sales as double) as sales, cast(oi.profit_per_order as double) as profit_per_order,
        s.late_delivery_risk
        from t_order_items oi join t_shipments s on oi.order_item_id = s.order_item_id
        join t_orders o on oi.order_id = o.order_id
        join t_customers cu on o.customer_id = cu.customer_id
        join t_products p on oi.product_card_id = p.product_card_id
        join t_categories c on p.category_id = c.category_id""")
    # snapshots and table round trips
    from shiprisk.checks.oracle import reports as _reports
    rep = _reports()
    out["save_table_roundtrip"] = rep["gold_shipping_risk"]
    out["read_version"] = rep["gold_monthly_revenue_by_market"]
    gt1_count = rep["gold_shipping_risk"].replace("select * from q", "select count(*) from q")
    out["table_history"] = (f"select cast(0 as bigint) as version, 'WRITE' as operation, "
                            f"({gt1_count}) as n_rows union all select cast(1 as bigint), 'WRITE', ({gt1_count})")
    out["normalized_csv_export"] = W(" union all ".join(
        f"select '{t}' as table_name, count(*) as n_rows, {len(TABLE_COLUMNS[t])} as n_cols from t_{t}"
        for t in TABLE_COLUMNS))
    out["typed_csv_load"] = W(f"select {edge([o for o, _ in TABLE_COLUMNS['order_items']])} from t_order_items")
    cols = [o for o, _ in TABLE_COLUMNS["order_items"]]
    key = PRIMARY_KEYS["order_items"]
    texts = {c: f"coalesce(cast({c} as varchar), '')" for c in cols}
    texts["quantity"] = f"case when order_id % 97 = 0 then 'x' || {texts['quantity']} else {texts['quantity']} end"
    texts[key] = f"case when order_id % 89 = 1 then '' else {texts[key]} end"
    line = " || ',' || ".join(texts[c] for c in cols[:-1])
    line = f"{line} || case when order_id % 83 = 2 then '' else ',' || {texts[cols[-1]]} end"
    short, number, empty = "order_id % 83 = 2", "order_id % 97 = 0 and quantity is not null", "order_id % 89 = 1"
    bad = lambda column, why, when: (
        f"select {line} as line, 'order_items' as table_name, {column} as column_name, '{why}' as reason "
        f"from t_order_items where {when}")
    out["quarantined_rows"] = W(" union all ".join([
        bad("cast(null as varchar)", "malformed", short),
        bad("'quantity'", "bad_cast", f"{number} and not ({short})"),
        bad(f"'{key}'", "null_in_not_null", f"{empty} and not ({short})")]))
    out["quarantine_passed"] = W(f"select {edge(cols)} from t_order_items where not ({short}) "
                                 f"and not ({number}) and not ({empty})")
    contract_parts = []
    for t, pairs in TABLE_COLUMNS.items():
        from shiprisk.schemas import TABLE_TYPES
        for o, s in pairs:
            dtype = TABLE_TYPES[t][o].simpleString()
            duck_t = DUCK_TYPES[dtype]
            contract_parts.append(
                f"select '{t}' as table_name, '{o}' as column_name, 'bad_cast' as reason, "
                f"count(case when {s}_s is not null and try_cast({s}_s as {duck_t}) is null then 1 end) as n_rows from bronze")
            if o == PRIMARY_KEYS[t]:
                contract_parts.append(
                    f"select '{t}' as table_name, '{o}' as column_name, 'null_in_not_null' as reason, "
                    f"count(case when {s}_s is null then 1 end) as n_rows from bronze")
    bronze_sel = ", ".join(f"cast({c} as varchar) as {c}_s" for c in RAW_ORDER)
    out["contract_violations"] = W(f"with bronze as (select {bronze_sel} from raw_dups) "
                                   + " union all ".join(contract_parts))
    gold_counts = {
        "gold_shipping_risk": "select count(*) from (select distinct shipping_mode, market, order_region from flat)",
        "gold_monthly_revenue_by_market": "select count(*) from (select distinct market, strftime(order_date, '%Y-%m') "
                                          f"from flat where order_date < timestamp '{CUTOFF}')",
        "gold_category_profitability": "select count(*) from (select distinct category_name, department_name "
                                       f"from flat where order_date < timestamp '{CUTOFF}')",
    }
    rows = [("bronze_supply_chain", "select count(*) from raw_dups"),
            ("silver_cleaned", "select count(*) from cleaned"),
            ("silver_orders", "select count(*) from cleaned"),
            ("silver_categories", "select count(distinct category_id) from cleaned"),
            ("silver_products", "select count(distinct product_card_id) from cleaned"),
            ("silver_customers", "select count(distinct customer_id) from cleaned"),
            ("silver_order_headers", "select count(distinct order_id) from cleaned"),
            ("silver_order_items", "select count(*) from cleaned"),
            ("silver_shipments", "select count(*) from cleaned")]
    rows += list(gold_counts.items())
    out["medallion_refresh"] = W(" union all ".join(
        f"select '{n}' as table_name, cast(0 as bigint) as version, ({q}) as n_rows" for n, q in rows))
    return out


from shiprisk.schemas import NUMERIC_TYPES as _NT  # noqa: E402

_NUM_TYPES = {c: t.simpleString() for c, t in _NT.items()}
