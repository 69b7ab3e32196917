"""DuckDB SQL per query, written step by step rather than in the form of the Spark plans."""

from __future__ import annotations

from tessera.plans.catalogue import (
    ARTICLE_CONFIDENCE,
    ARTICLE_SUPPORT,
    CHURN_END,
    CHURN_START,
    RFM_END,
    FREQUENT_ARTICLE,
    RULE_CONFIDENCE,
    RULE_SEGMENTS,
    RULE_SUPPORT,
    TRIPLE_CONFIDENCE,
    TRIPLE_SUPPORT,
)

FIDELITY = """fidelity AS (
  SELECT o_custkey AS ID_CLI, o_orderkey AS ID_FID,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS COD_FID,
    CASE WHEN o_totalprice > 150000 THEN '1' ELSE '0' END AS TYP_CLI_FID,
    o_orderstatus AS STATUS_FID, o_orderkey % 50 AS ID_NEG,
    CAST(o_orderdate AS DATE) AS DT_ACTIVE
  FROM orders)"""

ACCOUNT = """account AS (
  SELECT c_custkey AS ID_CLI, CAST(c_nationkey AS BIGINT) AS ID_ADDRESS,
    CASE WHEN c_custkey % 17 = 0 THEN NULL
      ELSE concat('prov', CAST(c_custkey % (1 + c_custkey % 40) AS VARCHAR)) END AS EMAIL_PROVIDER,
    CASE WHEN c_acctbal > 5000 THEN '1' END AS W_PHONE,
    c_nationkey % 3 AS TYP_CLI_ACCOUNT,
    CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'HOUSEHOLD' THEN 'Non Dichiara'
      ELSE c_mktsegment END AS TYP_JOB
  FROM customer WHERE c_custkey % 23 <> 4)"""

ADDRESS = """address AS (
  SELECT CAST(n_nationkey AS BIGINT) AS ID_ADDRESS,
    lpad(CAST(n_nationkey * 137 AS VARCHAR), 5, '0') AS CAP,
    CASE WHEN n_nationkey = 7 THEN 'NA' WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_name END AS PRV,
    r_name AS REGION
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT n_nationkey, lpad(CAST(n_nationkey * 137 AS VARCHAR), 5, '0'), n_name, r_name
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 5),
clean_address AS (
  SELECT DISTINCT * FROM address
  WHERE CAP IS NOT NULL AND PRV IS NOT NULL AND REGION IS NOT NULL)"""

PRIVACY = """privacy AS (
  SELECT c_custkey AS ID_CLI, c_custkey % 2 AS FLAG_PRIVACY_1,
    CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS FLAG_PRIVACY_2,
    CASE WHEN c_acctbal > 2500 THEN 1 ELSE 0 END AS FLAG_DIRECT_MKT
  FROM customer WHERE c_custkey % 29 <> 6)"""

CAMPAIGN = """campaign AS (
  SELECT CAST(n_nationkey AS BIGINT) AS ID_CAMP, r_name AS TYP_CAMP, 'EMAIL' AS CHANNEL_CAMP
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

EVENT = """event AS (
  SELECT event_id AS ID_EVENT, user_id AS ID_CLI,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS ID_CAMP,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS ID_DELIVERY,
    CASE event_type WHEN 'signup' THEN 'S' WHEN 'view' THEN 'V' WHEN 'click' THEN 'C'
      WHEN 'error' THEN 'E' ELSE 'B' END AS TYP_EVENT,
    CAST(ts AS TIMESTAMP) AS EVENT_DATETIME, CAST(ts AS DATE) AS EVENT_DATE
  FROM events)"""

TICKET = """ticket AS (
  SELECT l_orderkey AS ID_SCONTRINO, CASE WHEN o_custkey % 50 <> 7 THEN o_custkey END AS ID_CLI,
    l_partkey AS ID_ARTICOLO, p_brand AS COD_REPARTO, p_type AS ITEM_GROUP,
    CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DIREZIONE,
    CASE WHEN l_orderkey % 89 = 3 THEN NULL WHEN l_returnflag = 'R' THEN -(l_extendedprice / 100)
      ELSE l_extendedprice / 100 END AS IMPORTO_LORDO,
    l_extendedprice / 100 * l_discount AS SCONTO,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS TIC_DATETIME,
    CAST(o_orderdate AS DATE) AS TIC_DATE, CAST(o_orderkey % 24 AS BIGINT) AS TIC_HOUR
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

SNAPSHOT = f"""{FIDELITY},
last_sub AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY ID_CLI ORDER BY DT_ACTIVE DESC, ID_FID DESC) AS rn FROM fidelity) WHERE rn = 1),
first_sub AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY ID_CLI ORDER BY DT_ACTIVE, ID_FID) AS rn FROM fidelity) WHERE rn = 1),
snapshot AS (
  SELECT l.ID_CLI, l.ID_FID, l.COD_FID AS LAST_COD_FID, l.TYP_CLI_FID AS LAST_TYP_CLI_FID,
    l.STATUS_FID AS LAST_STATUS_FID, l.DT_ACTIVE AS LAST_DT_ACTIVE,
    f.ID_NEG AS FIRST_ID_NEG, f.DT_ACTIVE AS FIRST_DT_ACTIVE, n.NUM_FIDs
  FROM last_sub l JOIN first_sub f ON l.ID_CLI = f.ID_CLI
  JOIN (SELECT ID_CLI, count(DISTINCT ID_FID) AS NUM_FIDs FROM fidelity GROUP BY 1) n
    ON l.ID_CLI = n.ID_CLI)"""


def _first_of(code: str, name: str) -> str:
    return f"""first_{name} AS (
  SELECT * FROM (SELECT ID_CLI, ID_CAMP, ID_DELIVERY, D AS {name}_DATE,
      count(*) OVER (PARTITION BY ID_CLI, ID_CAMP, ID_DELIVERY) AS N_{name},
      row_number() OVER (PARTITION BY ID_CLI, ID_CAMP, ID_DELIVERY
        ORDER BY EVENT_DATETIME, ID_EVENT) AS rn
    FROM typed WHERE T = '{code}') WHERE rn = 1)"""


FUNNEL = f"""{CAMPAIGN}, {EVENT},
typed AS (
  SELECT e.*, EVENT_DATE AS D, TYP_CAMP,
    CASE WHEN TYP_EVENT IN ('E', 'B') THEN 'F' ELSE TYP_EVENT END AS T
  FROM event e LEFT JOIN campaign c ON e.ID_CAMP = c.ID_CAMP),
{_first_of('V', 'OPEN')},
{_first_of('C', 'CLICK')},
{_first_of('F', 'FAIL')},
funnel AS (
  SELECT s.ID_EVENT AS ID_EVENT_S, s.ID_CLI, s.ID_CAMP, s.TYP_CAMP, s.ID_DELIVERY,
    s.D AS SEND_DATE, OPEN_DATE IS NOT NULL AS OPENED, OPEN_DATE,
    OPEN_DATE - s.D AS DAYS_TO_OPEN, N_OPEN AS NUM_OPENs,
    CLICK_DATE IS NOT NULL AS CLICKED, CLICK_DATE, N_CLICK AS NUM_CLICKs,
    FAIL_DATE IS NOT NULL AS FAILED
  FROM (SELECT * FROM typed WHERE T = 'S') s
  LEFT JOIN first_OPEN o ON s.ID_CLI = o.ID_CLI AND s.ID_CAMP = o.ID_CAMP
    AND s.ID_DELIVERY = o.ID_DELIVERY
  LEFT JOIN first_CLICK c ON s.ID_CLI = c.ID_CLI AND s.ID_CAMP = c.ID_CAMP
    AND s.ID_DELIVERY = c.ID_DELIVERY
  LEFT JOIN first_FAIL f ON s.ID_CLI = f.ID_CLI AND s.ID_CAMP = f.ID_CAMP
    AND s.ID_DELIVERY = f.ID_DELIVERY
  WHERE (OPEN_DATE IS NULL OR s.D <= OPEN_DATE)
    AND (CLICK_DATE IS NULL OR OPEN_DATE <= CLICK_DATE)
    AND (FAIL_DATE IS NULL OR s.D <= FAIL_DATE))"""

# Public holidays of the years of the test tickets, Easter Mondays spelled out.
HOLIDAYS = """holidays AS (
  SELECT make_date(y, m, d) AS H
  FROM range(1990, 2031) t(y), (VALUES (1, 1), (1, 6), (4, 25), (5, 1), (8, 15), (11, 1),
    (12, 8), (12, 25), (12, 26)) v(m, d)
  UNION SELECT make_date(y, 6, 2) FROM range(2000, 2031) t(y)
  UNION SELECT DATE '1999-12-31'
  UNION SELECT CAST(d AS DATE) FROM (VALUES ('1990-04-16'), ('1991-04-01'), ('1992-04-20'),
    ('1993-04-12'), ('1994-04-04'), ('1995-04-17'), ('1996-04-08'), ('1997-03-31'),
    ('1998-04-13'), ('1999-04-05'), ('2000-04-24'), ('2001-04-16'), ('2002-04-01'),
    ('2003-04-21'), ('2004-04-12'), ('2005-03-28')) e(d))"""

TYPED_TICKET = f"""{TICKET}, {HOLIDAYS},
flagged AS (
  SELECT t.*, CAST(dayofweek(TIC_DATE) + 1 AS BIGINT) AS WD, H IS NOT NULL AS IS_H
  FROM ticket t LEFT JOIN holidays ON TIC_DATE = H),
typed_ticket AS (
  SELECT *, CASE WHEN WD IN (6, 7) THEN 'weekend' WHEN IS_H OR WD IN (1, 7) THEN 'holiday'
      WHEN WD < 7 THEN 'weekday' ELSE 'other' END AS TIC_DATE_TYP,
    CASE WHEN IS_H OR WD IN (1, 7) THEN 1 ELSE 0 END AS TIC_DATE_HOLIDAY
  FROM flagged)"""

RFM = f"""{TICKET},
n_orders AS (SELECT ID_CLI, count(*) AS number_of_orders FROM ticket GROUP BY 1),
last_dates AS (SELECT ID_CLI, max(TIC_DATE) AS last_buy FROM ticket GROUP BY 1),
revenues AS (
  SELECT ID_CLI, sum(IMPORTO_LORDO) AS revenue FROM ticket GROUP BY 1
  HAVING sum(IMPORTO_LORDO) > 0),
rfm AS (
  SELECT n.ID_CLI AS customer_id, number_of_orders, revenue,
    CAST(DATE '{RFM_END}' - last_buy AS BIGINT) AS recency_days, last_buy
  FROM n_orders n JOIN revenues r ON n.ID_CLI IS NOT DISTINCT FROM r.ID_CLI
  JOIN last_dates d ON n.ID_CLI IS NOT DISTINCT FROM d.ID_CLI)"""


def _edges(column: str, name: str, bins: int = 5) -> str:
    return ", ".join(
        f"round(quantile_cont(CAST({column} AS DOUBLE), {i / bins}), 6) AS {name}{i}"
        for i in range(1, bins)
    )


def _steps(value: str, name: str, bins: int = 5) -> str:
    return " + ".join(
        f"CASE WHEN round(CAST({value} AS DOUBLE), 6) >= {name}{i} THEN 1 ELSE 0 END"
        for i in range(1, bins)
    )


SCORES = f"""{RFM},
edges AS (
  SELECT {_edges('recency_days', 'r')}, {_edges('number_of_orders', 'f')},
    {_edges('revenue', 'm')} FROM rfm),
scores AS (
  SELECT customer_id, recency_days, number_of_orders AS transaction_count, revenue AS amount,
    5 - ({_steps('recency_days', 'r')}) AS recency_score,
    1 + ({_steps('number_of_orders', 'f')}) AS frequency_score,
    1 + ({_steps('revenue', 'm')}) AS monetary_score
  FROM rfm, edges),
rules AS (
  SELECT * FROM (VALUES
    (1, 'Champions', 4, 5, 4, 5), (2, 'Loyal Customers', 2, 5, 3, 5),
    (3, 'Potential Loyalist', 3, 5, 1, 3), (4, 'New Customers', 4, 5, 1, 1),
    (5, 'Promising', 3, 4, 1, 1), (6, 'Need Attention', 2, 3, 2, 3),
    (7, 'About To Sleep', 2, 3, 1, 2), (8, 'At Risk', 1, 2, 2, 5),
    (9, 'Can''t Lose Them', 1, 1, 4, 5), (10, 'Lost', 1, 2, 1, 2)
  ) v(priority, segment, rl, ru, fl, fu)),
matches AS (
  SELECT customer_id, min(priority) AS first_rule, max(priority) AS last_rule
  FROM scores JOIN rules ON recency_score BETWEEN rl AND ru
    AND frequency_score BETWEEN fl AND fu AND monetary_score BETWEEN fl AND fu
  GROUP BY 1),
segments AS (
  SELECT s.*, coalesce(segment, 'Others') AS segment
  FROM scores s LEFT JOIN matches m ON s.customer_id IS NOT DISTINCT FROM m.customer_id
  LEFT JOIN rules ON priority = first_rule)"""

CHURN = f"""{SCORES},
stayers AS (
  SELECT DISTINCT ID_CLI, 1 AS STAYS FROM ticket WHERE IMPORTO_LORDO > 0
    AND TIC_DATE > DATE '{CHURN_START}' AND TIC_DATE < DATE '{CHURN_END}'),
churn_set AS (
  SELECT customer_id AS ID_CLI, segment, transaction_count, recency_days, amount,
    CASE WHEN STAYS IS NULL THEN 1 ELSE 0 END AS CHURN
  FROM segments LEFT JOIN stayers ON customer_id IS NOT DISTINCT FROM ID_CLI)"""

# The same with features up to the begin of the window.
PRIOR_CHURN = CHURN.replace(
    "FROM ticket GROUP BY 1", f"FROM ticket WHERE TIC_DATE <= DATE '{CHURN_START}' GROUP BY 1"
).replace(RFM_END, CHURN_START)

PREDICTED = f"""{CHURN},
predicted AS (
  SELECT CHURN, transaction_count, round(amount, 2) AS amount,
    CASE WHEN transaction_count < 40 THEN 1 ELSE 0 END AS BY_FREQUENCY,
    CASE WHEN round(amount, 2) < 5000 THEN 1 ELSE 0 END AS BY_AMOUNT
  FROM churn_set)"""

BASKETS = f"""{TICKET},
pairs AS (
  SELECT DISTINCT concat(coalesce(CAST(ID_CLI AS VARCHAR), 'NA'), '-',
    strftime(TIC_DATETIME, '%Y-%m-%d %H:%M:%S')) AS basket_id, CAST(ID_ARTICOLO AS VARCHAR) AS item
  FROM ticket WHERE IMPORTO_LORDO > 0)"""

# Item groups are few, so each set of groups is a bit mask and its support a sum over baskets.
RULES = f"""{TICKET},
pairs AS (
  SELECT DISTINCT ID_CLI, TIC_DATETIME, ITEM_GROUP AS item FROM ticket WHERE IMPORTO_LORDO > 0),
item_bits AS (
  SELECT item, CAST(1 AS BIGINT) << CAST(row_number() OVER (ORDER BY item) - 1 AS BIGINT) AS bit
  FROM (SELECT DISTINCT item FROM pairs)),
basket_masks AS (
  SELECT mask, count(*) AS n FROM (
    SELECT ID_CLI, TIC_DATETIME, CAST(sum(bit) AS BIGINT) AS mask
    FROM pairs JOIN item_bits USING (item) GROUP BY 1, 2) GROUP BY 1),
total AS (SELECT CAST(sum(n) AS BIGINT) AS n_baskets FROM basket_masks),
item_sets AS (
  SELECT s.m AS item_set, CAST(sum(n) AS BIGINT) AS freq
  FROM range(0, (SELECT CAST(sum(bit) AS BIGINT) + 1 FROM item_bits)) s(m)
  JOIN basket_masks ON (mask & s.m) = s.m GROUP BY 1),
frequent AS (
  SELECT * FROM item_sets, total WHERE freq >= CAST({RULE_SUPPORT} AS DOUBLE) * n_baskets),
set_names AS (
  SELECT item_set, coalesce(string_agg(item, ',' ORDER BY item), '') AS names
  FROM frequent LEFT JOIN item_bits ON (item_set & bit) = bit GROUP BY 1),
found AS (
  SELECT a.names AS antecedent, i.item AS consequent,
    whole.freq / whole.n_baskets AS support, whole.freq / part.freq AS confidence,
    part.freq / whole.n_baskets AS coverage,
    (whole.freq / part.freq) / (single.freq / whole.n_baskets) AS lift, whole.freq AS "count"
  FROM frequent whole JOIN item_bits i ON (whole.item_set & i.bit) = i.bit
  JOIN frequent part ON part.item_set = whole.item_set - i.bit
  JOIN frequent single ON single.item_set = i.bit
  JOIN set_names a ON a.item_set = part.item_set
  WHERE whole.freq / part.freq >= {RULE_CONFIDENCE}),
rules AS (
  SELECT antecedent, consequent, round(support, 8) AS support, round(confidence, 8) AS confidence,
    round(coverage, 8) AS coverage, round(lift, 8) AS lift, "count" FROM found)"""


# However a training set is drawn, a fitted model's probabilities add up to its class sizes.
TRAINED_STAYERS = f"""WITH {CHURN}
SELECT CAST(ceil(CAST(0.7 AS DOUBLE) * count(*)) AS DOUBLE) AS EXPECTED_STAYERS
FROM churn_set WHERE CHURN = 0"""

# Pairs of articles, each way round.
ARTICLE_RULES = f"""{BASKETS},
total AS (SELECT count(DISTINCT basket_id) AS n FROM pairs),
single AS (SELECT item, count(*) AS c FROM pairs GROUP BY 1),
both_ways AS (
  SELECT a.item AS antecedent, b.item AS consequent, count(*) AS c
  FROM pairs a JOIN pairs b ON a.basket_id = b.basket_id AND a.item <> b.item GROUP BY 1, 2),
article_rules AS (
  SELECT antecedent, consequent, round(p.c / n, 8) AS support, round(p.c / x.c, 8) AS confidence,
    round(x.c / n, 8) AS coverage, round((p.c / x.c) / (y.c / n), 8) AS lift, p.c AS "count"
  FROM both_ways p JOIN single x ON x.item = antecedent JOIN single y ON y.item = consequent, total
  WHERE p.c >= CAST({ARTICLE_SUPPORT} AS DOUBLE) * n
    AND p.c / x.c >= CAST({ARTICLE_CONFIDENCE} AS DOUBLE))"""

# Sets of up to three articles; a part of a frequent set is frequent, too.
TRIPLE_RULES = f"""{BASKETS},
total AS (SELECT CAST(count(DISTINCT basket_id) AS DOUBLE) AS n FROM pairs),
single AS (SELECT item AS items, count(*) AS c FROM pairs GROUP BY 1),
double AS (
  SELECT a.item || ',' || b.item AS items, a.item AS x, b.item AS y, count(*) AS c
  FROM pairs a JOIN pairs b ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY 2, 3),
triple AS (
  SELECT a.item AS x, b.item AS y, c.item AS z, count(*) AS c
  FROM pairs a JOIN pairs b ON a.basket_id = b.basket_id AND a.item < b.item
    JOIN pairs c ON b.basket_id = c.basket_id AND b.item < c.item GROUP BY 1, 2, 3),
parts AS (
  SELECT '' AS antecedent, items AS consequent, c FROM single UNION ALL
  SELECT x, y, c FROM double UNION ALL SELECT y, x, c FROM double UNION ALL
  SELECT x || ',' || y, z, c FROM triple UNION ALL SELECT x || ',' || z, y, c FROM triple UNION ALL
  SELECT y || ',' || z, x, c FROM triple),
known AS (
  SELECT '' AS items, n AS c FROM total UNION ALL SELECT items, c FROM single UNION ALL
  SELECT items, c FROM double),
triple_rules AS (
  SELECT antecedent, consequent, round(p.c / n, 8) AS support, round(p.c / x.c, 8) AS confidence,
    round(x.c / n, 8) AS coverage, round((p.c / x.c) / (y.c / n), 8) AS lift, p.c AS "count"
  FROM parts p JOIN known x ON x.items = antecedent JOIN single y ON y.items = consequent, total
  WHERE p.c >= CAST({TRIPLE_SUPPORT} AS DOUBLE) * n AND p.c / x.c >= CAST({TRIPLE_CONFIDENCE} AS DOUBLE))"""

RULED = f"""{CHURN},
ruled AS (
  SELECT ID_CLI, segment, CASE WHEN segment IN ({', '.join(f"'{x}'" for x in RULE_SEGMENTS)}) THEN 1 ELSE 0
    END AS CHURN FROM churn_set),
sides AS (
  SELECT CAST(count(*) FILTER (WHERE CHURN = 0) AS DOUBLE) AS n0,
    CAST(count(*) FILTER (WHERE CHURN = 1) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n,
    string_agg(DISTINCT segment, ',' ORDER BY segment) FILTER (WHERE CHURN = 0) AS stays FROM ruled)"""


def _separated(churn_set: str) -> str:
    parts = [
        """SELECT 'segment=' || segment AS TERM, CAST(min(CHURN) AS BIGINT) AS CLASS, 'level' AS KIND,
  count(*) AS N_ROWS FROM churn_set WHERE segment IS NOT NULL GROUP BY segment
HAVING count(DISTINCT CHURN) = 1 AND (SELECT count(DISTINCT CHURN) FROM churn_set) = 2"""
    ]
    for measure in ("transaction_count", "recency_days", "amount"):
        for above in (0, 1):
            low, high = f"min({measure}) FILTER (WHERE CHURN = {above})", f"max({measure}) FILTER (WHERE CHURN = {1 - above})"
            parts.append(
                f"""SELECT '{measure}', {above}, CASE WHEN {low} > {high} THEN 'complete' ELSE 'quasi' END, count(*)
FROM churn_set HAVING {low} >= {high} AND max({measure}) > min({measure})"""
            )
    return f"WITH {churn_set} " + " UNION ALL ".join(f"({p})" for p in parts)


def _distribution(
    views: str, source: str, level: str, name: str, count: str = "TOT_CLIs", key: str = "ID_CLI"
) -> str:
    return f"""WITH {views},
counts AS (SELECT {level} AS {name}, count(DISTINCT {key}) AS {count} FROM {source} GROUP BY 1)
SELECT *, {count} / (SELECT sum({count}) FROM counts) AS PERCENT FROM counts"""


def _overlap(views: str, left: str, right: str, key: str, names: tuple[str, str]) -> str:
    return f"""WITH {views}
SELECT coalesce(l.m, 0) AS {names[0]}, coalesce(r.m, 0) AS {names[1]}, count(*) AS TOT_KEYS
FROM (SELECT DISTINCT {key} AS k, 1 AS m FROM {left}) l
FULL JOIN (SELECT DISTINCT {key} AS k, 1 AS m FROM {right}) r ON l.k IS NOT DISTINCT FROM r.k
GROUP BY 1, 2"""


def _key_check(views: str, source: str, keys: list[list[str]]) -> str:
    parts = []
    for key in keys:
        columns = ", ".join(key)
        parts.append(
            f"SELECT '{'-'.join(key)}' AS KEY_COLUMNS,"
            f" (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {source})) AS TOT_KEYS,"
            f" (SELECT count(*) FROM {source}) AS TOT_ROWS"
        )
    return f"""WITH {views}
SELECT *, TOT_KEYS = TOT_ROWS AS IS_UNIQUE FROM ({' UNION ALL '.join(parts)})"""


def _structure(views: str, source: str, columns: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS COLUMN_NAME, (SELECT count(*) FROM {source}) AS N_ROWS,"
        f" (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {source})) AS N_DISTINCT"
        for c in columns
    ]
    return f"WITH {views} {' UNION ALL '.join(parts)}"


def _numeric_summary(views: str, source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS COLUMN_NAME, count(*) AS N_ROWS,
  count(*) - count({c}) AS N_MISSING,
  round(min({x}), 4) AS MIN_VALUE, round(quantile_cont({x}, 0.25), 6) AS Q1,
  round(quantile_cont({x}, 0.5), 6) AS MEDIAN, round(avg({x}), 4) AS MEAN_VALUE,
  round(quantile_cont({x}, 0.75), 6) AS Q3, round(max({x}), 4) AS MAX_VALUE FROM {source}""")
    return f"WITH {views} {' UNION ALL '.join(parts)}"


def _top_levels(views: str, source: str, columns: list[str], k: int = 6) -> str:
    parts = [
        f"""SELECT '{c}' AS COLUMN_NAME, CAST({c} AS VARCHAR) AS LEVEL, count(*) AS N_ROWS,
  row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) NULLS LAST) AS POSITION
FROM {source} GROUP BY {c}"""
        for c in columns
    ]
    return f"WITH {views} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE POSITION <= {k}"


def _rate_by_type(flag: str) -> str:
    return f"""WITH {FUNNEL},
by_type AS (
  SELECT TYP_CAMP, count(DISTINCT ID_EVENT_S) AS E, count(DISTINCT ID_CLI) AS C
  FROM funnel GROUP BY 1),
by_flag AS (
  SELECT TYP_CAMP, CAST({flag} AS BIGINT) AS {flag}, count(DISTINCT ID_EVENT_S) AS TOT_EVENTs,
    count(DISTINCT ID_CLI) AS TOT_CLIs FROM funnel GROUP BY 1, 2)
SELECT f.*, TOT_EVENTs / E AS PERCENT_EVENTs, TOT_CLIs / C AS PERCENT_CLIs
FROM by_flag f JOIN by_type t ON f.TYP_CAMP = t.TYP_CAMP"""


def _per_customer(flag: str, measure: str, name: str) -> str:
    return f"""WITH {FUNNEL},
per_customer AS (
  SELECT ID_CLI, CAST(floor({measure}) AS BIGINT) AS {name} FROM funnel WHERE {flag} GROUP BY 1)
SELECT {name}, count(DISTINCT ID_CLI) AS TOT_CLIs FROM per_customer GROUP BY 1"""


def _share_by_direction(views: str, source: str, by: str) -> str:
    return f"""WITH {views},
parents AS (
  SELECT DIREZIONE, count(DISTINCT ID_SCONTRINO) AS T, count(DISTINCT coalesce(ID_CLI, -1)) AS C
  FROM {source} GROUP BY 1),
children AS (
  SELECT DIREZIONE, {by}, count(DISTINCT ID_SCONTRINO) AS TOT_TICs,
    count(DISTINCT coalesce(ID_CLI, -1)) AS TOT_CLIs FROM {source} GROUP BY 1, 2)
SELECT CAST(c.DIREZIONE AS BIGINT) AS DIREZIONE, {by}, TOT_TICs, TOT_CLIs,
  TOT_TICs / T AS PERCENT_TICs, TOT_CLIs / C AS PERCENT_CLIs
FROM children c JOIN parents p ON c.DIREZIONE = p.DIREZIONE"""


def _amount_totals(entity: str) -> str:
    return f"""{TICKET},
totals AS (
  SELECT {entity}, DIREZIONE, sum(IMPORTO_LORDO) AS G, sum(SCONTO) AS S
  FROM ticket GROUP BY 1, 2)"""


def _average_amounts(entity: str) -> str:
    return f"""WITH {_amount_totals(entity)}
SELECT CAST(DIREZIONE AS BIGINT) AS DIREZIONE, round(avg(G), 4) AS AVG_IMPORTO_LORDO,
  round(avg(S), 4) AS AVG_SCONTO FROM totals GROUP BY 1"""


POPULARITY = f"""{TICKET},
per_article AS (
  SELECT ID_ARTICOLO, count(DISTINCT ID_SCONTRINO) AS NUM_TICs FROM ticket GROUP BY 1)"""


def _histogram(value: str, condition: str) -> str:
    return f"""WITH {_amount_totals('ID_SCONTRINO')},
shown AS (
  SELECT DIREZIONE, round({value}, 4) AS x FROM totals
  WHERE {condition.format(g='round(G, 4)', s='round(S, 4)')})
SELECT CAST(DIREZIONE AS BIGINT) AS DIREZIONE, CAST(ceil((x - 5) / 10) AS BIGINT) AS BIN,
  count(*) AS N, CAST(ceil((x - 5) / 10) AS BIGINT) * 10.0::DOUBLE AS BIN_CENTER
FROM shown GROUP BY DIREZIONE, ceil((x - 5) / 10)"""


def _bins(entity: str, value: str) -> str:
    return f"""WITH {_amount_totals(entity)},
shown AS (SELECT DIREZIONE, round({value}, 4) AS x FROM totals),
extent AS (SELECT min(x) AS low, (max(x) - min(x)) / 29 AS width FROM shown),
placed AS (
  SELECT DIREZIONE, CAST(greatest(ceil(round((x - low) / width - 0.5, 9)), 0) AS BIGINT) AS BIN,
    low, width FROM shown, extent)
SELECT CAST(DIREZIONE AS BIGINT) AS DIREZIONE, BIN, count(*) AS N,
  round(low + BIN * width, 3) AS BIN_CENTER FROM placed GROUP BY DIREZIONE, BIN, low, width"""


def _next_purchase(source: str, order: str) -> str:
    return f"""WITH {TICKET},
buys AS ({source}),
gaps AS (
  SELECT TIC_DATE - lag(TIC_DATE) OVER (PARTITION BY ID_CLI ORDER BY {order}) AS g FROM buys),
curve AS (
  SELECT CAST(g AS BIGINT) AS DAYS_DIFF, count(*) AS FREQ FROM gaps WHERE g IS NOT NULL GROUP BY 1),
kept AS (SELECT * FROM curve WHERE DAYS_DIFF > (SELECT min(DAYS_DIFF) FROM curve))
SELECT *, FREQ / (SELECT sum(FREQ) FROM kept) AS PERC FROM kept"""


PROVIDERS = f"""{ACCOUNT},
counts AS (
  SELECT coalesce(EMAIL_PROVIDER, '(missing)') AS EMAIL_PROVIDER,
    count(DISTINCT ID_CLI) AS TOT_CLIs FROM account GROUP BY 1),
covered AS (
  SELECT *, sum(TOT_CLIs) OVER (ORDER BY TOT_CLIs DESC, EMAIL_PROVIDER
      ROWS UNBOUNDED PRECEDING) / (SELECT sum(TOT_CLIs) FROM counts) AS PERCENT_COVERED,
    TOT_CLIs / (SELECT sum(TOT_CLIs) FROM counts) AS PERCENT FROM counts),
bucketed AS (
  SELECT EMAIL_PROVIDER, CASE WHEN EMAIL_PROVIDER = '(missing)' OR before IS NULL OR before < 0.85
    THEN EMAIL_PROVIDER ELSE 'others' END AS EMAIL_PROVIDER_CLEAN
  FROM (SELECT *, lag(PERCENT_COVERED) OVER (ORDER BY TOT_CLIs DESC, EMAIL_PROVIDER) AS before
    FROM covered))"""

JOBS = f"""{ACCOUNT},
jobs AS (
  SELECT ID_CLI, CASE WHEN TYP_JOB IS NULL THEN 'Non Dichiara' ELSE TYP_JOB END AS TYP_JOB
  FROM account),
declared AS (SELECT * FROM jobs WHERE TYP_JOB <> 'Non Dichiara')"""


def _gain_lift(score: str) -> str:
    # every customer gets the share of stayers of his score, then ranks are cut
    return f"""WITH {PREDICTED},
ranked AS (
  SELECT {score} AS s, avg(1 - CHURN) OVER (PARTITION BY {score}) AS hit,
    row_number() OVER (ORDER BY {score} DESC) AS rk FROM predicted),
totals AS (SELECT count(*) AS n, sum(hit) AS hits FROM ranked),
cuts AS (
  SELECT k * 10.0::DOUBLE AS POPULATION, CAST(ceil(k * n / 10) AS BIGINT) AS cut, n, hits
  FROM range(1, 11) t(k), totals)
SELECT POPULATION, round(100 * sum(hit) / hits, 9) AS GAIN,
  round((sum(hit) / hits) / (cut / n), 9) AS LIFT,
  round(CAST(min(s) AS DOUBLE), 9) AS SCORE_POINT
FROM cuts JOIN ranked ON rk <= cut GROUP BY POPULATION, hits, cut, n"""


def _accuracy(name: str, column: str) -> str:
    return (
        f"SELECT '{name}' AS MODELS, avg(CASE WHEN {column} = CHURN THEN 1 ELSE 0 END)"
        " AS ACCURACY FROM predicted"
    )


ORACLES: dict[str, str] = {
    "q01_structure": _structure(
        ACCOUNT,
        "account",
        ["ID_CLI", "ID_ADDRESS", "EMAIL_PROVIDER", "W_PHONE", "TYP_CLI_ACCOUNT", "TYP_JOB"],
    ),
    "q01_numeric_summary": _numeric_summary(
        TICKET,
        "ticket",
        ["ID_SCONTRINO", "ID_CLI", "ID_ARTICOLO", "DIREZIONE", "IMPORTO_LORDO", "SCONTO"],
    ),
    "q01_date_summary": f"""WITH {FIDELITY},
days AS (SELECT DT_ACTIVE - DATE '1970-01-01' AS d, DT_ACTIVE FROM fidelity),
s AS (
  SELECT count(*) AS N_ROWS, count(*) - count(d) AS N_MISSING,
    min(d) AS a, quantile_cont(d, 0.25) AS b, quantile_cont(d, 0.5) AS c, avg(d) AS e,
    quantile_cont(d, 0.75) AS f, max(d) AS g FROM days)
SELECT 'DT_ACTIVE' AS COLUMN_NAME, N_ROWS, N_MISSING,
  {", ".join(
      f"CAST(DATE '1970-01-01' + CAST(floor({x}) AS INTEGER) AS VARCHAR) AS {n}"
      for x, n in zip("abcefg", ["MIN_VALUE", "Q1", "MEDIAN", "MEAN_VALUE", "Q3", "MAX_VALUE"])
  )} FROM s""",
    "q02_top_levels": _top_levels(
        ACCOUNT, "account", ["EMAIL_PROVIDER", "W_PHONE", "TYP_CLI_ACCOUNT", "TYP_JOB"]
    ),
    "q03_key_check_subscriptions": _key_check(
        FIDELITY,
        "fidelity",
        [["ID_CLI"], ["ID_FID"], ["ID_CLI", "ID_FID"], ["ID_CLI", "DT_ACTIVE"], ["COD_FID"]],
    ),
    "q03_key_check_addresses": _key_check(ADDRESS, "address", [["ID_ADDRESS"], ["PRV"]]),
    "q03_key_check_events": _key_check(
        EVENT, "event", [["ID_EVENT"], ["ID_CLI", "ID_CAMP", "ID_DELIVERY"]]
    ),
    "q04_multiplicity": f"""WITH {FIDELITY},
per_client AS (
  SELECT ID_CLI, count(DISTINCT ID_FID) AS NUM_FIDs, count(DISTINCT DT_ACTIVE) AS NUM_DATEs
  FROM fidelity GROUP BY 1)
SELECT NUM_FIDs, NUM_DATEs, count(*) AS TOT_CLIs,
  count(*) / (SELECT count(*) FROM per_client) AS PERCENT_CLIs FROM per_client GROUP BY 1, 2""",
    "q04_same_day_subscribers": f"""WITH {FIDELITY}
SELECT ID_CLI, count(DISTINCT ID_FID) AS NUM_FIDs, count(DISTINCT DT_ACTIVE) AS NUM_DATEs
FROM fidelity GROUP BY 1 HAVING count(DISTINCT DT_ACTIVE) < count(DISTINCT ID_FID)""",
    "q05_missing_pattern": f"""WITH {ADDRESS}
SELECT CAST(CAP IS NOT NULL AS BIGINT) AS W_CAP, CAST(PRV IS NOT NULL AS BIGINT) AS W_PRV,
  CAST(REGION IS NOT NULL AS BIGINT) AS W_REGION, count(DISTINCT ID_ADDRESS) AS TOT_ID_ADDRESSs
FROM address GROUP BY 1, 2, 3""",
    "q05_complete_cases": f"""WITH {ACCOUNT}
SELECT * FROM account WHERE EMAIL_PROVIDER IS NOT NULL AND TYP_JOB IS NOT NULL""",
    "q06_subscriber_account_overlap": _overlap(
        f"{FIDELITY}, {ACCOUNT}",
        "fidelity",
        "account",
        "ID_CLI",
        ("IS_IN_FIDELITY", "IS_IN_ACCOUNT"),
    ),
    "q06_subscriber_privacy_overlap": _overlap(
        f"{FIDELITY}, {PRIVACY}",
        "fidelity",
        "privacy",
        "ID_CLI",
        ("IS_IN_FIDELITY", "IS_IN_PRIVACY"),
    ),
    "q06_subscriber_event_overlap": _overlap(
        f"{FIDELITY}, {EVENT}", "fidelity", "event", "ID_CLI", ("IS_IN_FIDELITY", "IS_IN_EVENT")
    ),
    "q06_subscriber_ticket_overlap": _overlap(
        f"{FIDELITY}, {TICKET}", "fidelity", "ticket", "ID_CLI", ("IS_IN_FIDELITY", "IS_IN_TICKET")
    ),
    "q07_campaign_event_overlap": _overlap(
        f"{CAMPAIGN}, {EVENT}", "campaign", "event", "ID_CAMP", ("IS_IN_CAMPAIGN", "IS_IN_EVENT")
    ),
    "q07_account_address_overlap": _overlap(
        f"{ACCOUNT}, {ADDRESS}",
        "account",
        "clean_address",
        "ID_ADDRESS",
        ("IS_IN_ACCOUNT", "IS_IN_ADDRESS"),
    ),
    "q08_clean_addresses": f"WITH {ADDRESS} SELECT * FROM clean_address",
    "q07_key_presence": f"""WITH {FIDELITY}, {ACCOUNT}, {ADDRESS}, {PRIVACY}, {CAMPAIGN}, {EVENT}, {TICKET},
held AS (
  SELECT 'ID_CLI' AS KEY, ID_CLI AS k, 1 AS place, 'fidelity' AS name FROM fidelity
  UNION SELECT 'ID_CLI', ID_CLI, 2, 'account' FROM account
  UNION SELECT 'ID_CLI', ID_CLI, 3, 'privacy' FROM privacy
  UNION SELECT 'ID_CLI', ID_CLI, 4, 'event' FROM event
  UNION SELECT 'ID_CLI', ID_CLI, 5, 'ticket' FROM ticket
  UNION SELECT 'ID_CAMP', ID_CAMP, 1, 'campaign' FROM campaign
  UNION SELECT 'ID_CAMP', ID_CAMP, 2, 'event' FROM event
  UNION SELECT 'ID_ADDRESS', ID_ADDRESS, 1, 'account' FROM account
  UNION SELECT 'ID_ADDRESS', ID_ADDRESS, 2, 'address' FROM address)
SELECT KEY, TABLES, count(*) AS TOT_KEYS
FROM (SELECT KEY, k, string_agg(name, ',' ORDER BY place) AS TABLES FROM held GROUP BY 1, 2) GROUP BY 1, 2""",
    "q09_level_dominance": f"""WITH {ACCOUNT},
levels AS (
  SELECT 'EMAIL_PROVIDER' AS "COLUMN", CAST(EMAIL_PROVIDER AS VARCHAR) AS LEVEL, count(*) AS n FROM account GROUP BY 2
  UNION ALL SELECT 'W_PHONE', CAST(W_PHONE AS VARCHAR), count(*) FROM account GROUP BY 2
  UNION ALL SELECT 'TYP_CLI_ACCOUNT', CAST(TYP_CLI_ACCOUNT AS VARCHAR), count(*) FROM account GROUP BY 2
  UNION ALL SELECT 'TYP_JOB', CAST(TYP_JOB AS VARCHAR), count(*) FROM account GROUP BY 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "COLUMN" ORDER BY n DESC, LEVEL NULLS LAST) AS place FROM levels)
SELECT "COLUMN", count(*) AS N_LEVELS, max(LEVEL) FILTER (WHERE place = 1) AS TOP_LEVEL,
  max(n) FILTER (WHERE place = 1) AS TOP_COUNT, max(n) FILTER (WHERE place = 2) AS SECOND_COUNT,
  max(n) FILTER (WHERE place = 1) / CAST(sum(n) AS DOUBLE) AS SHARE,
  max(n) FILTER (WHERE place = 1) / CAST(max(n) FILTER (WHERE place = 2) AS DOUBLE) AS RATIO
FROM ranked GROUP BY 1""",
    "q09_drop_constant_columns": f"WITH {CAMPAIGN} SELECT ID_CAMP, TYP_CAMP FROM campaign",
    "q10_customer_snapshot": f"""WITH {SNAPSHOT}
SELECT * REPLACE (CAST(LAST_DT_ACTIVE AS VARCHAR) AS LAST_DT_ACTIVE,
  CAST(FIRST_DT_ACTIVE AS VARCHAR) AS FIRST_DT_ACTIVE) FROM snapshot""",
    "q11_clean_accounts": f"""WITH {ACCOUNT}
SELECT ID_CLI, ID_ADDRESS, coalesce(EMAIL_PROVIDER, '(missing)') AS EMAIL_PROVIDER,
  coalesce(W_PHONE, '0') AS W_PHONE, CAST(TYP_CLI_ACCOUNT AS BIGINT) AS TYP_CLI_ACCOUNT,
  coalesce(TYP_JOB, '(missing)') AS TYP_JOB FROM account""",
    "q12_last_code_distribution": _distribution(
        SNAPSHOT, "snapshot", "LAST_COD_FID", "LAST_COD_FID"
    ),
    "q12_last_status_distribution": _distribution(
        SNAPSHOT, "snapshot", "LAST_STATUS_FID", "LAST_STATUS_FID"
    ),
    "q12_subscription_count_distribution": _distribution(
        SNAPSHOT, "snapshot", "NUM_FIDs", "NUM_FIDs"
    ),
    "q13_last_year_distribution": _distribution(
        SNAPSHOT, "snapshot", "CAST(year(LAST_DT_ACTIVE) AS VARCHAR)", "YEAR"
    ),
    "q13_first_year_distribution": _distribution(
        SNAPSHOT, "snapshot", "CAST(year(FIRST_DT_ACTIVE) AS VARCHAR)", "YEAR"
    ),
    "q14_region_distribution": _distribution(
        ADDRESS, "clean_address", "REGION", "REGION", "TOT_ADDs", "ID_ADDRESS"
    ),
    "q14_province_distribution": _distribution(
        ADDRESS, "clean_address", "PRV", "PRV", "TOT_ADDs", "ID_ADDRESS"
    ),
    "q14_postal_code_distribution": _distribution(
        ADDRESS, "clean_address", "CAP", "CAP", "TOT_ADDs", "ID_ADDRESS"
    ),
    "q15_privacy_1_distribution": _distribution(
        PRIVACY, "privacy", "CAST(FLAG_PRIVACY_1 AS BIGINT)", "FLAG_PRIVACY_1"
    ),
    "q15_privacy_2_distribution": _distribution(
        PRIVACY, "privacy", "CAST(FLAG_PRIVACY_2 AS BIGINT)", "FLAG_PRIVACY_2"
    ),
    "q15_direct_marketing_distribution": _distribution(
        PRIVACY, "privacy", "CAST(FLAG_DIRECT_MKT AS BIGINT)", "FLAG_DIRECT_MKT"
    ),
    "q16_provider_distribution": _distribution(
        ACCOUNT, "account", "coalesce(EMAIL_PROVIDER, '(missing)')", "EMAIL_PROVIDER"
    ),
    "q16_top_providers": f"""WITH {PROVIDERS}
SELECT * FROM covered ORDER BY TOT_CLIs DESC, EMAIL_PROVIDER LIMIT 20""",
    "q16_bucketed_providers": f"WITH {PROVIDERS} SELECT * FROM bucketed",
    "q16_clean_provider_distribution": _distribution(
        f"""{PROVIDERS},
clean AS (
  SELECT ID_CLI, EMAIL_PROVIDER_CLEAN FROM account a JOIN bucketed b
  ON coalesce(a.EMAIL_PROVIDER, '(missing)') = b.EMAIL_PROVIDER)""".replace(
            "counts AS", "level_counts AS"
        ).replace("FROM counts", "FROM level_counts"),
        "clean",
        "EMAIL_PROVIDER_CLEAN",
        "EMAIL_PROVIDER_CLEAN",
    ),
    "q17_job_distribution": _distribution(JOBS, "jobs", "TYP_JOB", "TYP_JOB"),
    "q17_declared_job_distribution": _distribution(JOBS, "declared", "TYP_JOB", "TYP_JOB"),
    "q20_day_types": f"""WITH {TYPED_TICKET}
SELECT CAST(TIC_DATE AS VARCHAR) AS TIC_DATE, WD AS TIC_DATE_WEEKDAY,
  CAST(TIC_DATE_HOLIDAY AS BIGINT) AS TIC_DATE_HOLIDAY, TIC_DATE_TYP, count(*) AS N_LINES
FROM typed_ticket GROUP BY 1, 2, 3, 4""",
    "q20_calendar_day_types": f"""WITH {TYPED_TICKET}
SELECT CASE WHEN WD IN (1, 7) THEN 'weekend' WHEN IS_H THEN 'holiday' ELSE 'weekday' END
  AS TIC_DATE_TYP, count(*) AS N_LINES FROM flagged GROUP BY 1""",
    "q21_email_funnel": f"""WITH {FUNNEL}
SELECT ID_EVENT_S, ID_CLI, ID_CAMP, TYP_CAMP, ID_DELIVERY, CAST(SEND_DATE AS VARCHAR) AS SEND_DATE,
  CAST(OPENED AS BIGINT) AS OPENED, CAST(OPEN_DATE AS VARCHAR) AS OPEN_DATE,
  CAST(DAYS_TO_OPEN AS BIGINT) AS DAYS_TO_OPEN, NUM_OPENs,
  CAST(CLICKED AS BIGINT) AS CLICKED, CAST(CLICK_DATE AS VARCHAR) AS CLICK_DATE, NUM_CLICKs,
  CAST(FAILED AS BIGINT) AS FAILED FROM funnel""",
    "q22_campaign_overview": f"""WITH {FUNNEL}
SELECT 'ALL' AS TYP_CAMP, CAST(min(SEND_DATE) AS VARCHAR) AS MIN_DATE,
  CAST(max(SEND_DATE) AS VARCHAR) AS MAX_DATE, count(DISTINCT ID_EVENT_S) AS TOT_EVENTs,
  count(DISTINCT ID_CLI) AS TOT_CLIs FROM funnel
UNION ALL
SELECT TYP_CAMP, CAST(min(SEND_DATE) AS VARCHAR), CAST(max(SEND_DATE) AS VARCHAR),
  count(DISTINCT ID_EVENT_S), count(DISTINCT ID_CLI) FROM funnel GROUP BY 1""",
    "q23_open_rate": f"""WITH {FUNNEL},
overview AS (
  SELECT count(DISTINCT ID_EVENT_S) AS E, count(DISTINCT ID_CLI) AS C FROM funnel),
by_flag AS (
  SELECT CAST(OPENED AS BIGINT) AS OPENED, count(DISTINCT ID_EVENT_S) AS TOT_EVENTs,
    count(DISTINCT ID_CLI) AS TOT_CLIs FROM funnel GROUP BY 1)
SELECT 'ALL' AS TYP_CAMP, OPENED, TOT_EVENTs, TOT_CLIs, TOT_EVENTs / E AS PERCENT_EVENTs,
  TOT_CLIs / C AS PERCENT_CLIs FROM by_flag, overview""",
    "q24_open_rate_by_type": _rate_by_type("OPENED"),
    "q24_click_rate_by_type": _rate_by_type("CLICKED"),
    "q24_fail_rate_by_type": _rate_by_type("FAILED"),
    "q25_stacked_open_share": f"""WITH {FUNNEL},
n AS (
  SELECT TYP_CAMP, CAST(OPENED AS BIGINT) AS OPENED, count(DISTINCT ID_EVENT_S) AS TOT_EVENTs
  FROM funnel GROUP BY 1, 2)
SELECT n.*, TOT_EVENTs / t.total AS SHARE FROM n
JOIN (SELECT TYP_CAMP, sum(TOT_EVENTs) AS total FROM n GROUP BY 1) t ON n.TYP_CAMP = t.TYP_CAMP""",
    "q26_days_to_open": _per_customer("OPENED", "avg(DAYS_TO_OPEN)", "AVG_DAYS_TO_OPEN"),
    "q27_days_to_open_curve": f"""WITH dist AS (
  {_per_customer("OPENED", "avg(DAYS_TO_OPEN)", "AVG_DAYS_TO_OPEN")})
SELECT * FROM (
  SELECT *, sum(TOT_CLIs) OVER (ORDER BY AVG_DAYS_TO_OPEN)
    / (SELECT sum(TOT_CLIs) FROM dist) AS PERCENT_COVERED FROM dist)
WHERE AVG_DAYS_TO_OPEN < 14""",
    "q28_opens_per_customer": _per_customer("OPENED", "avg(NUM_OPENs)", "AVG_OPENs"),
    "q28_clicks_per_customer": _per_customer("CLICKED", "sum(NUM_CLICKs)", "AVG_CLICKs"),
    "q29_ticket_overview": f"""WITH {TICKET}
SELECT CAST(min(TIC_DATE) AS VARCHAR) AS MIN_DATE, CAST(max(TIC_DATE) AS VARCHAR) AS MAX_DATE,
  count(DISTINCT ID_SCONTRINO) AS TOT_TICs, count(DISTINCT coalesce(ID_CLI, -1)) AS TOT_CLIs FROM ticket""",
    "q29_direction_shares": f"""WITH {TICKET},
overall AS (SELECT count(DISTINCT ID_SCONTRINO) AS T, count(DISTINCT coalesce(ID_CLI, -1)) AS C FROM ticket),
n AS (
  SELECT CAST(DIREZIONE AS BIGINT) AS DIREZIONE, count(DISTINCT ID_SCONTRINO) AS TOT_TICs,
    count(DISTINCT coalesce(ID_CLI, -1)) AS TOT_CLIs FROM ticket GROUP BY 1)
SELECT n.*, TOT_TICs / T AS PERCENT_TICs, TOT_CLIs / C AS PERCENT_CLIs FROM n, overall""",
    "q30_hour_share_by_event_type": f"""WITH {EVENT},
hours AS (SELECT *, hour(EVENT_DATETIME) AS EVENT_HOUR FROM event),
parents AS (
  SELECT TYP_EVENT, count(DISTINCT ID_EVENT) AS E, count(DISTINCT ID_CLI) AS C
  FROM hours GROUP BY 1),
children AS (
  SELECT TYP_EVENT, EVENT_HOUR, count(DISTINCT ID_EVENT) AS TOT_EVENTs,
    count(DISTINCT ID_CLI) AS TOT_CLIs FROM hours GROUP BY 1, 2)
SELECT c.*, TOT_EVENTs / E AS PERCENT_EVENTs, TOT_CLIs / C AS PERCENT_CLIs
FROM children c JOIN parents p ON c.TYP_EVENT = p.TYP_EVENT""",
    "q29_direction_counts_from_daily_states": f"""WITH {TICKET}
SELECT CAST(DIREZIONE AS BIGINT) AS DIREZIONE, count(DISTINCT ID_SCONTRINO) AS TOT_TICs,
  count(DISTINCT ID_CLI) + max(CASE WHEN ID_CLI IS NULL THEN 1 ELSE 0 END) AS TOT_CLIs,
  TRUE AS TICs_WITHIN, TRUE AS CLIs_WITHIN FROM ticket GROUP BY 1""",
    "q29_amount_edges_from_daily_states": f"""WITH {TICKET}
SELECT CAST(DIREZIONE AS BIGINT) AS DIREZIONE, count(*) AS N_VALUES, count(*) AS N, TRUE AS P20_WITHIN,
  TRUE AS P40_WITHIN, TRUE AS P50_WITHIN, TRUE AS P60_WITHIN, TRUE AS P80_WITHIN
FROM ticket WHERE IMPORTO_LORDO IS NOT NULL GROUP BY 1""",
    "q30_hour_share_by_direction": _share_by_direction(TICKET, "ticket", "TIC_HOUR"),
    "q31_department_share": _share_by_direction(TICKET, "ticket", "COD_REPARTO"),
    "q32_day_type_share": _share_by_direction(TYPED_TICKET, "typed_ticket", "TIC_DATE_TYP"),
    "q33_purchases_per_customer": f"""WITH {TICKET}
SELECT ID_CLI, count(DISTINCT ID_SCONTRINO) AS TOT_PURCHASE FROM ticket
WHERE DIREZIONE = 1 GROUP BY 1""",
    "q34_amounts_per_ticket": _average_amounts("ID_SCONTRINO"),
    "q35_amounts_per_department": _average_amounts("COD_REPARTO"),
    "q35_amounts_per_customer": _average_amounts("ID_CLI"),
    "q36_article_popularity": f"""WITH {POPULARITY}
SELECT NUM_TICs, count(DISTINCT ID_ARTICOLO) AS COUNT_ART FROM per_article GROUP BY 1""",
    "q36_article_popularity_view": f"""WITH {POPULARITY}
SELECT NUM_TICs, count(DISTINCT ID_ARTICOLO) AS COUNT_ART FROM per_article
WHERE NUM_TICs < 50 GROUP BY 1""",
    "q37_gross_histogram": _histogram("G", "{g} > -1000 AND {g} < 1000"),
    "q37_discount_histogram": _histogram("S", "{s} > -250 AND {g} < 250"),
    "q37_customer_gross_bins": _bins("ID_CLI", "G"),
    "q37_department_discount_bins": _bins("COD_REPARTO", "S"),
    "q38_next_purchase_curve": _next_purchase(
        "SELECT * FROM ticket WHERE DIREZIONE = 1", "TIC_DATE, ID_SCONTRINO, ID_ARTICOLO"
    ),
    "q38_next_ticket_curve": _next_purchase(
        "SELECT DISTINCT ID_CLI, TIC_DATE, ID_SCONTRINO FROM ticket WHERE DIREZIONE = 1",
        "TIC_DATE, ID_SCONTRINO",
    ),
    "q39_rfm_table": f"""WITH {RFM}
SELECT customer_id, number_of_orders, round(revenue, 2) AS revenue, recency_days,
  CAST(last_buy AS VARCHAR) AS last_buy FROM rfm""",
    "q39_last_line_per_customer": f"""WITH {TICKET}
SELECT ID_CLI, CAST(TIC_DATE AS VARCHAR) AS TIC_DATE, ID_SCONTRINO, ID_ARTICOLO, IMPORTO_LORDO
FROM (SELECT *, row_number() OVER (PARTITION BY ID_CLI
  ORDER BY TIC_DATE DESC, ID_SCONTRINO DESC, ID_ARTICOLO DESC, IMPORTO_LORDO DESC) AS rn
  FROM ticket) WHERE rn = 1""",
    "q40_rfm_segments": f"""WITH {SCORES}
SELECT customer_id, recency_days, transaction_count, round(amount, 2) AS amount,
  CAST(recency_score AS BIGINT) AS recency_score,
  CAST(frequency_score AS BIGINT) AS frequency_score,
  CAST(monetary_score AS BIGINT) AS monetary_score,
  CAST(100 * recency_score + 10 * frequency_score + monetary_score AS BIGINT) AS rfm_score, segment
FROM segments""",
    "q40_rfm_segments_last_match": f"""WITH {SCORES}
SELECT s.customer_id, coalesce(segment, 'Others') AS segment
FROM scores s LEFT JOIN matches m ON s.customer_id IS NOT DISTINCT FROM m.customer_id
LEFT JOIN rules ON priority = last_rule""",
    "q40_segments_by_rule_table": f"""WITH {SCORES} SELECT customer_id, segment FROM segments""",
    "q40_segments_by_many_rules": f"""WITH {RFM},
tenths AS (
  SELECT {_edges('recency_days', 'r', 10)}, {_edges('number_of_orders', 'f', 10)}, {_edges('revenue', 'm', 10)}
  FROM rfm),
cells AS (
  SELECT customer_id, CAST(10 - ({_steps('recency_days', 'r', 10)}) AS BIGINT) AS recency_score,
    CAST(1 + ({_steps('number_of_orders', 'f', 10)}) AS BIGINT) AS frequency_score,
    CAST(1 + ({_steps('revenue', 'm', 10)}) AS BIGINT) AS monetary_score FROM rfm, tenths),
boxes AS (
  SELECT p_partkey AS priority, p_brand AS segment, 1 + p_size % 10 AS rl, 1 + p_size % 10 + p_partkey % 3 AS ru,
    1 + p_partkey % 10 AS fl,
    CASE WHEN p_partkey % 7 <> 0 THEN 1 + p_partkey % 10 + p_size % 2 END AS fu,
    CASE WHEN p_partkey % 11 <> 0 THEN 1 + p_partkey // 10 % 10 END AS ml, 1 + p_partkey // 10 % 10 AS mu FROM part),
found AS (
  SELECT recency_score, frequency_score, monetary_score, arg_max(segment, priority) AS segment
  FROM (SELECT DISTINCT recency_score, frequency_score, monetary_score FROM cells)
  JOIN boxes ON recency_score BETWEEN rl AND ru AND frequency_score BETWEEN fl AND coalesce(fu, 10)
    AND monetary_score BETWEEN coalesce(ml, 1) AND mu GROUP BY 1, 2, 3)
SELECT customer_id, recency_score, frequency_score, monetary_score, coalesce(segment, 'Others') AS segment
FROM cells LEFT JOIN found USING (recency_score, frequency_score, monetary_score)""",
    "q41_segment_counts": f"""WITH {SCORES}
SELECT segment AS "Segment", count(*) AS "Count" FROM segments GROUP BY 1""",
    "q42_segment_medians": f"""WITH {SCORES}
SELECT segment, round(median(amount), 2) AS median_monetary,
  round(median(CAST(transaction_count AS DOUBLE)), 2) AS median_frequency,
  round(median(CAST(recency_days AS DOUBLE)), 2) AS median_recency FROM segments GROUP BY 1""",
    "q43_monetary_heatmap": f"""WITH {SCORES}
SELECT CAST(frequency_score AS BIGINT) AS frequency_score,
  CAST(recency_score AS BIGINT) AS recency_score, round(avg(amount), 9) AS monetary
FROM scores GROUP BY 1, 2""",
    "q43_score_counts": f"""WITH {SCORES}
SELECT CAST(frequency_score AS BIGINT) AS frequency_score,
  CAST(recency_score AS BIGINT) AS recency_score,
  CAST(monetary_score AS BIGINT) AS monetary_score, count(*) AS n FROM scores GROUP BY 1, 2, 3""",
    "q43_order_distribution": f"""WITH {SCORES}
SELECT transaction_count, count(*) AS n FROM scores GROUP BY 1""",
    "q44_churn_labels": f"""WITH {CHURN}
SELECT ID_CLI, segment, transaction_count, recency_days, round(amount, 2) AS amount,
  CAST(CHURN AS BIGINT) AS CHURN FROM churn_set""",
    "q44_prior_churn_labels": f"""WITH {PRIOR_CHURN}
SELECT ID_CLI, segment, transaction_count, recency_days, round(amount, 2) AS amount,
  CAST(CHURN AS BIGINT) AS CHURN FROM churn_set""",
    "q45_split_sizes": f"""WITH {CHURN},
n AS (SELECT CHURN, count(*) AS n, CAST(ceil(CAST(0.7 AS DOUBLE) * count(*)) AS BIGINT) AS k
  FROM churn_set GROUP BY 1)
SELECT CAST(CHURN AS BIGINT) AS CHURN, CAST(1 AS BIGINT) AS IS_TRAIN, k AS N_ROWS FROM n
UNION ALL SELECT CAST(CHURN AS BIGINT), CAST(0 AS BIGINT), n - k FROM n WHERE n > k""",
    "q46_tree_balance": TRAINED_STAYERS,
    "q46_logistic_balance": TRAINED_STAYERS,
    "q46_score_table": f"""WITH {CHURN},
ruled AS (
  SELECT ID_CLI, CASE WHEN segment IN ({', '.join(f"'{x}'" for x in RULE_SEGMENTS)}) THEN 1 ELSE 0
    END AS CHURN FROM churn_set)
SELECT ID_CLI, CHURN, CHURN AS tree, CHURN AS forest, CHURN AS logistic FROM ruled""",
    "q46_rule_complexity_table": f"""WITH {RULED}
SELECT CAST(1 AS DOUBLE) AS CP, 0 AS NSPLIT, CAST(1 AS DOUBLE) AS REL_ERROR, CAST(1 AS DOUBLE) AS XERROR,
  round(sqrt(least(n0, n1) * (1 - least(n0, n1) / n)) / least(n0, n1), 9) AS XSTD FROM sides
UNION ALL SELECT CAST(0.01 AS DOUBLE), 1, 0, 0, 0""",
    "q46_rule_tree_nodes": f"""WITH {RULED}
SELECT 0 AS NODE, -1 AS PARENT, 0 AS DEPTH, n0 AS N_0, n1 AS N_1, CASE WHEN n1 > n0 THEN 1 ELSE 0 END AS PREDICTED,
  stays AS LEVELS, '' AS RULE FROM sides
UNION ALL SELECT 1, 0, 1, n0, 0, 0, NULL, 'segment in (' || replace(stays, ',', ', ') || ')' FROM sides
UNION ALL SELECT 2, 0, 1, 0, n1, 1, NULL, 'segment not in (' || replace(stays, ',', ', ') || ')' FROM sides""",
    "q46_rule_left_out_error": f"""WITH {RULED}
SELECT CAST(CHURN AS BIGINT) AS CHURN, count(*) AS N_ROWS, count(*) FILTER (WHERE CHURN = 0) AS SAID_0,
  count(*) FILTER (WHERE CHURN = 1) AS SAID_1, CAST(0 AS DOUBLE) AS ERROR
FROM ruled GROUP BY ROLLUP (CHURN)""",
    "q46_separated_terms": _separated(CHURN),
    "q46_prior_separated_terms": _separated(PRIOR_CHURN),
    "q47_confusion_matrix": f"""WITH {PREDICTED},
c AS (
  SELECT count(*) FILTER (WHERE BY_FREQUENCY = 0 AND CHURN = 0) AS TP,
    count(*) FILTER (WHERE BY_FREQUENCY = 0 AND CHURN = 1) AS FP,
    count(*) FILTER (WHERE BY_FREQUENCY = 1 AND CHURN = 0) AS FN,
    count(*) FILTER (WHERE BY_FREQUENCY = 1 AND CHURN = 1) AS TN, count(*) AS N FROM predicted)
SELECT *, (TP + TN) / N AS ACCURACY,
  round(((TP + TN) / N - ((TP + FP) / N * (TP + FN) / N + (FN + TN) / N * (FP + TN) / N))
    / (1 - ((TP + FP) / N * (TP + FN) / N + (FN + TN) / N * (FP + TN) / N)), 10) AS KAPPA,
  TP / nullif(TP + FN, 0) AS SENSITIVITY, TN / nullif(TN + FP, 0) AS SPECIFICITY,
  TP / nullif(TP + FP, 0) AS PPV, TN / nullif(TN + FN, 0) AS NPV,
  (TP + FN) / N AS PREVALENCE FROM c""",
    "q47_accuracy_table": f"""WITH {PREDICTED}
{_accuracy('frequency', 'BY_FREQUENCY')} UNION ALL {_accuracy('amount', 'BY_AMOUNT')}""",
    "q48_gain_lift_by_frequency": _gain_lift("transaction_count"),
    "q48_gain_lift_by_amount": _gain_lift("amount"),
    "q49_roc_points": f"""WITH {PREDICTED},
thresholds AS (SELECT DISTINCT transaction_count AS SCORE FROM predicted)
SELECT SCORE, count(*) FILTER (WHERE CHURN = 0) / (SELECT count(*) FROM predicted WHERE CHURN = 0)
    AS TPR,
  count(*) FILTER (WHERE CHURN = 1) / (SELECT count(*) FROM predicted WHERE CHURN = 1) AS FPR
FROM thresholds JOIN predicted ON transaction_count >= SCORE GROUP BY 1""",
    "q49_auc": f"""WITH {PREDICTED}
SELECT round(avg(CASE WHEN s.transaction_count > c.transaction_count THEN 1
  WHEN s.transaction_count = c.transaction_count THEN 0.5 ELSE 0 END), 10) AS AUC
FROM (SELECT * FROM predicted WHERE CHURN = 0) s, (SELECT * FROM predicted WHERE CHURN = 1) c""",
    "q49_auc_of_classes": f"""WITH {PREDICTED}
SELECT round((count(*) FILTER (WHERE BY_FREQUENCY = 1 AND CHURN = 1)
    / count(*) FILTER (WHERE CHURN = 1)
  + count(*) FILTER (WHERE BY_FREQUENCY = 0 AND CHURN = 0)
    / count(*) FILTER (WHERE CHURN = 0)) / 2, 10) AS AUC FROM predicted""",
    "q50_baskets": f"""WITH {BASKETS}
SELECT basket_id, string_agg(item, ',' ORDER BY item) AS items FROM pairs GROUP BY 1""",
    "q50_basket_sizes": f"""WITH {BASKETS}
SELECT n_items, count(*) AS n_baskets
FROM (SELECT basket_id, count(*) AS n_items FROM pairs GROUP BY 1) GROUP BY 1""",
    "q51_association_rules": f"WITH {RULES} SELECT * FROM rules",
    "q51_article_rules": f"WITH {ARTICLE_RULES} SELECT * FROM article_rules",
    "q51_triple_rules": f"WITH {TRIPLE_RULES} SELECT * FROM triple_rules",
    "q51_minable_baskets": f"""WITH {BASKETS},
total AS (SELECT count(DISTINCT basket_id) AS n FROM pairs),
often AS (
  SELECT item FROM pairs, total GROUP BY item, n
  HAVING count(*) >= CAST({FREQUENT_ARTICLE} AS DOUBLE) * n)
SELECT basket_id, coalesce(string_agg(item, ',' ORDER BY item) FILTER (item IN (FROM often)), '') AS items
FROM pairs GROUP BY 1""",
    "q52_rule_count": f"WITH {RULES} SELECT count(*) AS n_rules FROM rules",
    "q52_top_rules": f"""WITH {RULES}
SELECT * FROM rules ORDER BY lift DESC, support DESC, antecedent, consequent LIMIT 10""",
    "q53_item_frequency": f"""WITH {BASKETS},
total AS (SELECT count(DISTINCT basket_id) AS n FROM pairs)
SELECT item, count(*) AS "count", count(*) / n AS support FROM pairs, total
GROUP BY item, n HAVING count(*) / n >= 0.001""",
}
