"""SQL text of the adapter views, for the oracle side."""

VIEWS = {
    "secdim": """
SELECT s.s_suppkey AS sec,
       concat(CAST(10 + 5 * n.n_regionkey AS VARCHAR), lpad(CAST(n.n_nationkey AS VARCHAR), 4, '0')) AS gics
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "panel": """
SELECT l.sec, l.dt, l.prc, l.vol, d.gics
FROM (SELECT l_suppkey AS sec, CAST(l_shipdate AS DATE) AS dt,
             sum(l_extendedprice) / sum(l_quantity) AS prc, sum(l_quantity) AS vol
      FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) l
JOIN secdim d ON l.sec = d.sec""",
    "panel_ret": """
SELECT sec, dt, gics, vol,
       CASE WHEN (sec * 7 + day(dt)) % 23 = 0 THEN NULL ELSE prc END AS prc,
       prc / lag(prc) OVER (PARTITION BY sec ORDER BY dt) - 1 AS ret
FROM panel""",
    "factors": """
SELECT sec, dt, gics, prc, ret AS ret_1_0, vol AS turnover_126d, vol / prc AS be_me,
       vol - lag(vol) OVER (PARTITION BY sec ORDER BY dt) AS sale_gr1, ret * ret AS beta_60m
FROM panel_ret""",
    "ohlc": """
SELECT sec, year(dt) * 100 + month(dt) AS ym,
       min_by(prc, dt) AS open, max(prc) AS high, min(prc) AS low,
       max_by(prc, dt) AS close, sum(vol) AS volume, count(*) AS n_days
FROM panel GROUP BY sec, year(dt) * 100 + month(dt)""",
    "bars": """
SELECT o.*, d.date_idx FROM ohlc o
JOIN (SELECT ym, row_number() OVER (ORDER BY ym) - 1 AS date_idx FROM (SELECT DISTINCT ym FROM ohlc) y) d
ON o.ym = d.ym""",
    "positions": """
SELECT yr, mo, sector, side, company_id, score,
       CASE WHEN side = 'long' THEN 1 ELSE -1 END * score
         / sum(score) OVER (PARTITION BY yr, mo, sector, side) AS weight
FROM (SELECT year(o.o_orderdate) AS yr, month(o.o_orderdate) AS mo, c.c_mktsegment AS sector,
             CASE WHEN o.o_orderkey % 5 < 3 THEN 'long' ELSE 'short' END AS side,
             concat('comp_', lpad(CAST(o.o_custkey % 40 AS VARCHAR), 6, '0'), '_01') AS company_id,
             max(o.o_totalprice) / 500000 AS score
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      GROUP BY 1, 2, 3, 4, 5) x""",
    "monthly": """
SELECT ym, avg(CASE WHEN sec % 2 = 0 THEN r END) AS portfolio_return, avg(r) AS bench_return,
       count(*) AS positions_count
FROM (SELECT sec, ym, (close - open) / (close + open) AS r FROM ohlc) t
GROUP BY ym""",
    "filings": """
SELECT doc_id, source AS gvkey, 2023 + doc_id % 3 AS yr,
       (2023 + doc_id % 3) * 10000 + 101 + doc_id % 28 AS date,
       CASE WHEN doc_id % 2 = 0 THEN '10K' ELSE '10Q' END AS file_type,
       CASE doc_id % 3 WHEN 0 THEN substring(text, 1, 1500) WHEN 2 THEN text END AS rf,
       CASE WHEN doc_id % 3 = 0 THEN substring(text, 1501) END AS mgmt,
       CASE WHEN doc_id % 3 = 1 THEN text END AS text
FROM documents""",
    "sentiment_results": """
SELECT d.doc_id AS text_id, d.source AS stock_identifier, d.lang AS text_type, 2023 + d.doc_id % 3 AS yr,
       d.source AS gvkey, '0' || CAST(d.doc_id % 3 + 1 AS VARCHAR) AS iid,
       CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment_label,
       0.5E0 + (d.doc_id % 50) / 100E0 AS confidence_score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "scored": """
SELECT o.sec, o.ym, CAST(o.ym // 100 AS BIGINT) * 12 + o.ym % 100 - 1 AS m, left(d.gics, 2) AS prefix,
       o.close / o.open - 1 AS algo_score, (o.high - o.low) / (o.high + o.low) AS ml_score
FROM ohlc o JOIN secdim d ON o.sec = d.sec WHERE o.n_days >= 2""",
}
