"""The logical tables as SQL, for the oracles."""

import re

from ..functions.columns import half_even_sql

VIEWS = {
    "items": """SELECT p_partkey + 1 AS item_id, p_partkey::VARCHAR AS sku, p_name AS description, p_brand AS brand, p_type AS category_top_level,
  p_type || '/' || p_brand AS category_level_2, p_type || '/' || p_brand || '/' || p_size AS category_path, p_size::BIGINT AS reorder_point, (p_size * 2)::BIGINT AS reorder_level FROM part""",
    "sales": """SELECT o_orderkey AS sale_id, o_custkey AS customer_id, c_name AS customer_name, n_regionkey::BIGINT AS shop_id, o_orderstatus AS status, o_orderstatus <> 'O' AS completed,
  o_orderpriority = '5-LOW' AS voided, o_orderdate AS complete_time, o_orderstatus = 'F' AS received FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "sale_lines": """SELECT l_orderkey AS sale_id, l_linenumber::BIGINT AS line_no, l_partkey + 1 AS item_id, l_suppkey AS vendor_id, l_quantity AS quantity, l_extendedprice AS price,
  least(l_quantity, l_linenumber::DOUBLE) AS num_received, l_returnflag = 'R' AS is_warranty, l_shipdate AS updated_time FROM lineitem""",
    "latest_lines": """SELECT * FROM sale_lines QUALIFY row_number() OVER (PARTITION BY sale_id, line_no ORDER BY updated_time DESC, item_id DESC, vendor_id DESC, quantity DESC, price DESC) = 1""",
    "vendors": "SELECT s_suppkey AS vendor_id, s_name AS vendor_name FROM supplier",
    "stock_log": """SELECT event_id, user_id + 1 AS item_id, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::BIGINT AS shop_id, (floor(value) - 10)::BIGINT AS qoh,
  ts - INTERVAL 8217 DAY AS updated_time FROM events""",
    "report": """SELECT l.sale_id AS order_id, l.item_id, l.vendor_id, l.updated_time AS first_received_at, s.shop_id, s.complete_time AS po_ordered_at FROM sale_lines l JOIN sales s USING (sale_id)""",
    "rules": """SELECT brand AS brand_name, number::VARCHAR AS preferred_vendor_id, 'Preferred ' || number AS preferred_vendor_name, number % 2 = 0 AS active
  FROM (SELECT DISTINCT brand, regexp_extract(brand, '(\\d+)$', 1)::BIGINT AS number FROM items) WHERE number % 3 = 0""",
    "overrides": """SELECT sku, shop AS location_id, CASE WHEN item_id % 2 = 0 THEN item_id % 40 END AS manual_reorder_point, item_id % 90 AS manual_desired_level, item_id % 3 = 0 AS locked
  FROM items, (SELECT unnest([0, 1, 2])::BIGINT AS shop) WHERE item_id % 5 = 0""",
    "special_orders": """SELECT l.sale_id * 10 + l.line_no AS special_order_id, l.sale_id, lower(s.customer_name) AS customer_email, (l.item_id - 1)::VARCHAR AS system_sku, l.item_id, s.shop_id, l.vendor_id, l.quantity,
  CASE WHEN status IN ('P', 'F') THEN l.sale_id END AS po_id, CASE WHEN status IN ('P', 'F') AND line_no % 3 <> 0 THEN complete_time::DATE END AS po_ordered_date,
  CASE WHEN status IN ('P', 'F') THEN updated_time::DATE END AS po_arrival_date, complete_time::DATE AS created_date,
  CASE status WHEN 'F' THEN 'Received' WHEN 'P' THEN 'Ordered' ELSE 'Not ordered' END AS status_text, line_no % 5 = 0 AS contacted, voided AS done FROM latest_lines l JOIN sales s USING (sale_id)""",
    "shop_orders": """SELECT s.sale_id AS order_id, '#' || s.sale_id AS order_name, lower(customer_name) AS email, CASE WHEN received THEN 'FULFILLED' WHEN status = 'P' THEN 'PARTIAL' END AS fulfillment_status,
  CASE WHEN s.sale_id % 11 = 0 THEN 'REFUNDED' ELSE 'PAID' END AS financial_status, complete_time AS created_at, CASE WHEN s.sale_id % 2 = 0 THEN complete_time::DATE + 21 END AS eta, sku, voided
  FROM sales s LEFT JOIN (SELECT DISTINCT sale_id, (item_id - 1)::VARCHAR AS sku FROM sale_lines) l USING (sale_id) WHERE s.sale_id % 7 = 0""",
    "sold": "SELECT l.*, s.shop_id, s.complete_time FROM latest_lines l JOIN sales s USING (sale_id) WHERE s.completed AND NOT s.voided",
    "qualified": "SELECT DISTINCT item_id FROM stock_log",
    "sold_tagged": """SELECT l.*, s.shop_id, s.complete_time FROM (
    SELECT x.* FROM sale_lines x JOIN sales y USING (sale_id) WHERE x.item_id IN (SELECT item_id FROM qualified) AND y.shop_id IN (0, 1, 2)
    QUALIFY row_number() OVER (PARTITION BY x.sale_id, x.line_no ORDER BY x.updated_time DESC, x.item_id DESC, x.vendor_id DESC, x.quantity DESC, x.price DESC) = 1
  ) l JOIN sales s USING (sale_id) WHERE s.completed AND NOT s.voided""",
    "spine": "SELECT unnest(range(DATE '2001-06-03', DATE '2001-08-02', INTERVAL 1 DAY))::DATE AS day",
    "day_changes": """SELECT item_id, shop_id, updated_time::DATE AS day, qoh FROM stock_log WHERE updated_time::DATE BETWEEN DATE '2001-06-03' AND DATE '2001-08-01'
  QUALIFY row_number() OVER (PARTITION BY item_id, shop_id, updated_time::DATE ORDER BY updated_time DESC, event_id DESC) = 1""",
    "levels": """SELECT day, item_id, shop_id, last_value(qoh IGNORE NULLS) OVER (PARTITION BY item_id, shop_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qoh
  FROM (SELECT DISTINCT item_id, shop_id FROM day_changes) CROSS JOIN spine LEFT JOIN day_changes USING (item_id, shop_id, day)""",
    "stockouts": """SELECT item_id, shop_id, count(*) FILTER (qoh <= 0 AND day >= DATE '2001-07-19') AS days_out_of_stock_14, count(*) FILTER (qoh <= 0 AND day >= DATE '2001-07-03') AS days_out_of_stock_30,
  count(*) FILTER (qoh <= 0) AS days_out_of_stock_60 FROM levels GROUP BY ALL""",
    "windowed": """SELECT item_id, shop_id, sum(CASE WHEN d >= DATE '2001-07-19' THEN quantity ELSE 0 END) AS units_14, sum(CASE WHEN d >= DATE '2001-07-03' THEN quantity ELSE 0 END) AS units_30, sum(quantity) AS units_60,
  count(DISTINCT CASE WHEN d >= DATE '2001-07-19' THEN d END) AS sale_days_14, count(DISTINCT CASE WHEN d >= DATE '2001-07-03' THEN d END) AS sale_days_30, count(DISTINCT d) AS sale_days_60
  FROM (SELECT *, complete_time::DATE AS d FROM sold_tagged) WHERE d >= DATE '2001-06-03' GROUP BY ALL""",
    "current_levels": "SELECT item_id, shop_id, qoh FROM stock_log QUALIFY row_number() OVER (PARTITION BY item_id, shop_id ORDER BY updated_time DESC, event_id DESC) = 1",
    "po_units": """SELECT item_id, shop_id, sum(quantity - num_received) AS po_units FROM latest_lines JOIN sales USING (sale_id) WHERE NOT received AND NOT voided GROUP BY ALL""",
    "lead_rows": "SELECT *, date_sub('day', po_ordered_at, first_received_at) AS lead FROM report",
    "lead_times": """SELECT vendor_id, shop_id, ceil(quantile_cont(lead, 0.5))::DOUBLE AS lead_time_days, count(*) AS po_count FROM lead_rows
  WHERE po_ordered_at >= DATE '1998-08-01' AND lead BETWEEN 0 AND 40 GROUP BY ALL""",
    "metrics": """SELECT c.item_id, c.shop_id, i.sku, i.description, i.brand, i.category_top_level, i.category_path, v.vendor_id, c.qoh AS on_hand, coalesce(p.po_units, 0) AS on_order,
  i.reorder_point AS current_reorder_point, i.reorder_level AS current_desired_level, coalesce(w.units_14, 0) AS units_14, coalesce(w.units_30, 0) AS units_30, coalesce(w.units_60, 0) AS units_60,
  coalesce(w.sale_days_14, 0) AS sale_days_14, coalesce(w.sale_days_30, 0) AS sale_days_30, coalesce(w.sale_days_60, 0) AS sale_days_60,
  coalesce(o.days_out_of_stock_14, 0) AS days_out_of_stock_14, coalesce(o.days_out_of_stock_30, 0) AS days_out_of_stock_30, coalesce(o.days_out_of_stock_60, 0) AS days_out_of_stock_60
  FROM current_levels c JOIN items i USING (item_id) LEFT JOIN (SELECT item_id, min(vendor_id) AS vendor_id FROM sale_lines GROUP BY 1) v USING (item_id)
  LEFT JOIN po_units p USING (item_id, shop_id) LEFT JOIN windowed w USING (item_id, shop_id) LEFT JOIN stockouts o USING (item_id, shop_id) WHERE c.shop_id IN (0, 1, 2)""",
    "routed": """SELECT m.*, coalesce(pl.lead_time_days, ol.lead_time_days, 14.0) AS lead_time_days,
  CASE WHEN pl.lead_time_days IS NOT NULL THEN 'preferred_vendor' WHEN ol.lead_time_days IS NOT NULL THEN 'item_vendor' ELSE 'default' END AS lead_time_source,
  CASE WHEN pl.lead_time_days IS NOT NULL THEN r.preferred_vendor_id::BIGINT WHEN ol.lead_time_days IS NOT NULL THEN m.vendor_id END AS lead_time_vendor_id,
  CASE WHEN pl.lead_time_days IS NOT NULL THEN pl.po_count WHEN ol.lead_time_days IS NOT NULL THEN ol.po_count ELSE 0 END AS lead_time_po_count
  FROM metrics m LEFT JOIN rules r ON r.active AND lower(trim(r.brand_name)) = lower(trim(m.brand)) LEFT JOIN lead_times pl ON pl.vendor_id = r.preferred_vendor_id::BIGINT AND pl.shop_id = m.shop_id
  LEFT JOIN lead_times ol ON ol.vendor_id = m.vendor_id AND ol.shop_id = m.shop_id""",
    "split": """SELECT *, greatest(0, units_30 - units_14) AS u_b, greatest(0, units_60 - units_30) AS u_c,
  least(16, greatest(0, days_out_of_stock_30 - days_out_of_stock_14)) AS o_b, least(30, greatest(0, days_out_of_stock_60 - days_out_of_stock_30)) AS o_c,
  least(16, greatest(0, sale_days_30 - sale_days_14)) AS s_b, least(30, greatest(0, sale_days_60 - sale_days_30)) AS s_c FROM routed""",
    "active": """SELECT *, greatest(1, least(14, greatest(14 - days_out_of_stock_14, sale_days_14, 3)))::DOUBLE AS act_a, greatest(1, least(16, greatest(16 - o_b, s_b, 3)))::DOUBLE AS act_b,
  greatest(1, least(30, greatest(30 - o_c, s_c, 3)))::DOUBLE AS act_c FROM split""",
    "velocity": """SELECT *, units_14 / 14.0 + (units_14 / act_a - units_14 / 14.0) * least(1.0, act_a / 10.0) AS v_a, u_b / 16.0 + (u_b / act_b - u_b / 16.0) * least(1.0, act_b / 10.0) AS v_b,
  u_c / 30.0 + (u_c / act_c - u_c / 30.0) * least(1.0, act_c / 10.0) AS v_c FROM active""",
    "planned": """SELECT *, ceil(v * lead_time_days + safety_stock - 1e-9)::BIGINT AS reorder_point, ceil(v * 60.0 - 1e-9)::BIGINT AS desired_level FROM (
    SELECT *, ceil(v * 7.0 - 1e-9)::BIGINT AS safety_stock FROM (SELECT *, v_a * 0.4::DOUBLE + v_b * 0.4::DOUBLE + v_c * 0.2::DOUBLE AS v FROM velocity))""",
}

#: The status of a row with on_hand, on_order, reorder_point and desired_level.
STATUS = """CASE WHEN reorder_point <= 0 AND desired_level <= 0 THEN 'no_demand'
  WHEN desired_level > 0 AND greatest(on_hand, 0) + on_order >= desired_level * 1.5 THEN 'overstock' WHEN desired_level > 0 AND greatest(on_hand, 0) + on_order >= desired_level * 1.2 THEN 'high'
  WHEN desired_level > 0 AND greatest(on_hand, 0) + on_order >= desired_level * 0.8 AND reorder_point > 0 AND greatest(on_hand, 0) <= reorder_point THEN 'incoming'
  WHEN desired_level > 0 AND greatest(on_hand, 0) + on_order >= desired_level * 0.8 THEN 'on_target' WHEN reorder_point > 0 AND greatest(on_hand, 0) + on_order > reorder_point * 1.15 THEN 'healthy'
  WHEN reorder_point > 0 AND greatest(on_hand, 0) + on_order > reorder_point THEN 'warning' WHEN reorder_point > 0 AND greatest(on_hand, 0) + on_order > reorder_point * 0.5 THEN 'low' ELSE 'critical' END"""


def over(sql: str, **more: str) -> str:
    """sql with the views that it names, and those that they name, before it; `more` are views of its own."""
    views, ordered = VIEWS | more, []

    def add(text: str, within: tuple[str, ...]) -> None:
        words = set(re.findall(r"\w+", text))
        for name in views:
            if name in words and name not in ordered and name not in within:
                add(views[name], (*within, name))
                ordered.append(name)

    add(sql, ())
    return with_rounding("WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in ordered) + "\n" + sql)


def with_rounding(sql: str) -> str:
    """sql with half_even(x, digits) written out: DuckDB's own round_even rounds a product that has been rounded itself."""
    while (start := sql.find("half_even(")) >= 0:
        inner, depth, end = start + len("half_even("), 1, start + len("half_even(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x, digits = sql[inner : end - 1].rsplit(",", 1)
        sql = sql[:start] + half_even_sql(x, int(digits)) + sql[end:]
    return sql
