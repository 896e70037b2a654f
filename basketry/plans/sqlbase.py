"""SQL building blocks for the DuckDB oracle: the same mapping and the same
master / score definitions as the Spark operators, written as WITH-lists."""

from __future__ import annotations

from basketry.sources.fixtures import DELIVERED_STATUS, SQL_VIEWS

EA_PAY = "CAST(AVG(CAST(ROUND(payment_value, 9) AS DECIMAL(30,9))) AS DOUBLE)"
EA_PRICE = "CAST(AVG(CAST(ROUND(price, 9) AS DECIMAL(30,9))) AS DOUBLE)"
EA_REVIEW = "CAST(AVG(CAST(ROUND(review_score, 9) AS DECIMAL(30,9))) AS DOUBLE)"

MASTER = f"""
orders_f AS (
  SELECT order_id, customer_id, order_purchase_timestamp AS order_time
  FROM orders_m WHERE order_status = '{DELIVERED_STATUS}'),
pay AS (SELECT order_id,
               CAST(SUM(CAST(ROUND(payment_value, 9) AS DECIMAL(30,9))) AS DOUBLE) AS payment_value
        FROM payments_m WHERE order_id IS NOT NULL GROUP BY order_id),
rev AS (SELECT order_id, AVG(review_score) AS review_score FROM reviews_m
        WHERE order_id IS NOT NULL GROUP BY order_id),
prod AS (
  SELECT p.product_id, COALESCE(t.product_category_name_english, 'other') AS category
  FROM products_m p LEFT JOIN translation_m t
    ON p.product_category_name = t.product_category_name),
master AS (
  SELECT i.order_id, i.order_item_id, c.customer_unique_id AS user_id, i.product_id,
         c.customer_state, o.order_time, i.price, pr.category,
         COALESCE(pay.payment_value, CAST(0 AS DOUBLE)) AS payment_value,
         COALESCE(rev.review_score, CAST(3 AS DOUBLE)) AS review_score
  FROM orders_f o
  JOIN customers_m c ON o.customer_id = c.customer_id
  JOIN items_m i ON i.order_id = o.order_id
  JOIN prod pr ON pr.product_id = i.product_id
  LEFT JOIN pay ON pay.order_id = o.order_id
  LEFT JOIN rev ON rev.order_id = o.order_id)
"""

SCORED = f"""
weighted AS (
  SELECT m.*, 5 AS purchase_weight,
         CASE WHEN review_score >= 4.0 THEN 2 ELSE 0 END AS review_weight,
         CASE WHEN payment_value > (SELECT {EA_PAY} FROM master) THEN 1 ELSE 0 END
           AS value_weight,
         CASE WHEN COUNT(*) OVER (PARTITION BY user_id, product_id) > 1 THEN 3 ELSE 0 END
           AS repeat_weight
  FROM master m),
scored AS (
  SELECT *, CAST(purchase_weight + review_weight + value_weight + repeat_weight AS INTEGER)
           AS interaction_score
  FROM weighted),
interactions AS (
  SELECT user_id, product_id, CAST(MAX(interaction_score) AS INTEGER) AS interaction_score
  FROM scored GROUP BY user_id, product_id)
"""

POPULARITY = """
g_scores AS (SELECT product_id, CAST(SUM(interaction_score) AS BIGINT) AS score
             FROM scored GROUP BY product_id),
s_scores AS (SELECT customer_state AS state, product_id,
                    CAST(SUM(interaction_score) AS BIGINT) AS score
             FROM scored WHERE customer_state IS NOT NULL GROUP BY customer_state, product_id),
g_rank AS (SELECT product_id, score,
                  CAST(ROW_NUMBER() OVER (ORDER BY score DESC, product_id) AS INTEGER) AS rank
           FROM g_scores),
s_rank AS (SELECT state, product_id, score,
                  CAST(ROW_NUMBER() OVER (PARTITION BY state ORDER BY score DESC, product_id)
                       AS INTEGER) AS rank
           FROM s_scores)
"""

PROFILES = f"""
user_prof AS (
  SELECT u.user_id, u.total_purchases, u.avg_order_value, f.favorite_category,
         u.active_days
  FROM (SELECT user_id, COUNT(*) AS total_purchases, {EA_PAY} AS avg_order_value,
               CAST(date_sub('day', MIN(order_time), MAX(order_time)) + 1 AS INTEGER)
                 AS active_days
        FROM master GROUP BY user_id) u
  LEFT JOIN (
    SELECT user_id, category AS favorite_category FROM (
      SELECT user_id, category, ROW_NUMBER() OVER (
               PARTITION BY user_id ORDER BY COUNT(*) DESC, category) AS rn
      FROM master GROUP BY user_id, category) WHERE rn = 1) f
  ON u.user_id = f.user_id),
prod_prof AS (
  SELECT product_id, COUNT(*) AS total_purchases, {EA_PRICE} AS avg_price,
         {EA_REVIEW} AS avg_review_score,
         MIN(category) AS category
  FROM master GROUP BY product_id)
"""


def exact_avg(col: str, scale: int = 9) -> str:
    """DuckDB twin of ``columns.exact_avg``."""
    return f"CAST(AVG(CAST(ROUND({col}, {scale}) AS DECIMAL(30,{scale}))) AS DOUBLE)"


def with_(*blocks: str) -> str:
    """WITH-list of the mapping views plus the given blocks."""
    parts = [SQL_VIEWS.strip()] + [b.strip() for b in blocks]
    return "WITH " + ",\n".join(parts) + "\n"

GLOBAL_KEY = "~global~"

REQUESTS = """
known AS (SELECT DISTINCT user_id FROM master),
req AS (SELECT customer_unique_id AS user_id, customer_state AS state, 10 AS n FROM customers_m),
seg AS (SELECT r.user_id, r.state, r.n,
               CASE WHEN k.user_id IS NOT NULL THEN 'warm' ELSE 'cold' END AS segment
        FROM req r LEFT JOIN known k ON r.user_id = k.user_id)
"""

def pop_lists(n: int) -> str:
    """T3 lists of ``n`` products per state and globally."""
    return f"""
s_top AS (SELECT state, product_id, rank FROM s_rank WHERE rank <= {n}),
s_len AS (SELECT state, COUNT(*) AS s_len FROM s_top GROUP BY state),
g_top AS (SELECT product_id, rank FROM g_rank WHERE rank <= {2 * n}),
fill AS (
  SELECT l.state, g.product_id,
         l.s_len + ROW_NUMBER() OVER (PARTITION BY l.state ORDER BY g.rank) AS pos
  FROM s_len l CROSS JOIN g_top g
  WHERE NOT EXISTS (SELECT 1 FROM s_top s WHERE s.state = l.state AND s.product_id = g.product_id)),
lists AS (
  SELECT state AS list_key, product_id, rank AS pos FROM s_top
  UNION ALL SELECT state, product_id, pos FROM fill
  UNION ALL SELECT '{GLOBAL_KEY}', product_id, rank FROM g_top),
pop_recs AS (
  SELECT r.user_id, CAST(x.pos AS INTEGER) AS rank, x.product_id, r.segment
  FROM seg r JOIN lists x ON x.list_key = CASE
      WHEN r.state IS NOT NULL AND r.state <> '' AND r.state IN (SELECT state FROM s_len)
      THEN r.state ELSE '{GLOBAL_KEY}' END
  WHERE x.pos <= r.n)
"""


POP_LISTS = pop_lists(50)


def enriched(src: str, extra: str = "") -> str:
    """J11 over a (user_id, rank, product_id, ...) relation."""
    return f"""SELECT c.user_id, c.rank, c.product_id,
  COALESCE(p.category, 'unknown') AS category,
  COALESCE(p.avg_price, CAST(0 AS DOUBLE)) AS price,
  COALESCE(p.avg_review_score, CAST(0 AS DOUBLE)) AS review_score,
  COALESCE(p.total_purchases, 0) AS popularity_sales{extra}
FROM {src} c LEFT JOIN prod_prof p ON c.product_id = p.product_id"""


def content_blocks(thresholds=(3000.0, 5000.0), labels=("Low", "Mid", "High"),
                   low_inclusive=False, with_score=True, stop_list="[]",
                   price_col="avg_price", profile="prod_prof") -> str:
    low, high = thresholds
    op = "<=" if low_inclusive else "<"
    score = (", printf('%.1f', round_even(avg_review_score, 1))" if with_score else "")
    return f"""
texts AS (
  SELECT product_id, price_bucket,
         concat_ws(' ', COALESCE(category, ''), price_bucket{score}) AS text
  FROM (SELECT *, CASE WHEN {price_col} {op} {low} THEN '{labels[0]}'
                       WHEN {price_col} <= {high} THEN '{labels[1]}'
                       ELSE '{labels[2]}' END AS price_bucket FROM {profile})),
toks AS (SELECT product_id, unnest(regexp_extract_all(lower(text), '\\b\\w\\w+\\b')) AS token
         FROM texts),
tf AS (SELECT product_id, token, COUNT(*) AS tf FROM toks
       WHERE NOT list_contains({stop_list}, token) GROUP BY product_id, token),
ndocs AS (SELECT COUNT(*) AS n FROM texts),
dfreq AS (SELECT token, COUNT(*) AS df FROM tf GROUP BY token),
w0 AS (SELECT tf.product_id, tf.token, tf.tf,
              tf.tf * (ln((1 + ndocs.n) / (1 + dfreq.df)) + 1) AS w
       FROM tf JOIN dfreq ON tf.token = dfreq.token CROSS JOIN ndocs),
tfidf AS (SELECT product_id, token, tf,
                 w / sqrt(SUM(w * w) OVER (PARTITION BY product_id)) AS weight FROM w0),
sims AS (SELECT a.product_id, b.product_id AS similar_id,
                round(SUM(a.weight * b.weight), 9) AS similarity
         FROM tfidf a JOIN tfidf b ON a.token = b.token
         WHERE a.product_id <> b.product_id GROUP BY a.product_id, b.product_id),
sim_rank AS (SELECT product_id, similar_id, similarity,
                    CAST(ROW_NUMBER() OVER (PARTITION BY product_id
                         ORDER BY similarity DESC, similar_id) AS INTEGER) AS rank
             FROM sims WHERE similarity > 0)
"""

EVAL = """
ev AS (
  SELECT order_id, order_item_id, user_id, product_id, interaction_score,
         CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', '42', order_id, order_item_id,
                   product_id)), 1, 8)) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS part
  FROM scored),
train AS (SELECT * FROM ev WHERE part = 'train'),
test AS (SELECT * FROM ev WHERE part = 'test'),
eval_users AS (SELECT DISTINCT user_id FROM test WHERE user_id IN (SELECT user_id FROM train)),
truth AS (SELECT DISTINCT user_id, product_id FROM test
          WHERE user_id IN (SELECT user_id FROM eval_users)),
pscore AS (SELECT product_id, SUM(interaction_score) AS score FROM train GROUP BY product_id),
pglobal AS (SELECT product_id, ROW_NUMBER() OVER (ORDER BY score DESC, product_id) AS g_rank
            FROM pscore),
pcand AS (SELECT u.user_id, g.product_id, g.g_rank FROM eval_users u CROSS JOIN pglobal g
          WHERE NOT EXISTS (SELECT 1 FROM train t
                            WHERE t.user_id = u.user_id AND t.product_id = g.product_id)),
pop_eval AS (
  SELECT user_id, CAST(rank AS INTEGER) AS rank, product_id FROM (
    SELECT user_id, product_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY g_rank) AS rank
    FROM pcand) WHERE rank <= 10),
hits AS (SELECT r.user_id, r.rank,
                ROW_NUMBER() OVER (PARTITION BY r.user_id ORDER BY r.rank) AS nth
         FROM pop_eval r JOIN truth t ON r.user_id = t.user_id AND r.product_id = t.product_id),
per AS (SELECT user_id, COUNT(*) AS h, SUM(nth / rank) AS ap,
               SUM(CAST(1 AS DOUBLE) / log2(rank + 1)) AS dcg
        FROM hits GROUP BY user_id),
tsize AS (SELECT user_id, COUNT(*) AS n FROM truth GROUP BY user_id),
pop_metrics AS (
  SELECT u.user_id,
         COALESCE(per.h, 0) / CAST(10 AS DOUBLE) AS precision,
         COALESCE(per.h, 0) / CAST(tsize.n AS DOUBLE) AS recall,
         COALESCE(per.ap, 0) / CAST(LEAST(tsize.n, 10) AS DOUBLE) AS average_precision,
         COALESCE(per.dcg, 0) / list_sum(list_transform(range(1, LEAST(tsize.n, 10) + 1),
                                                     lambda i: 1 / log2(i + 1))) AS ndcg
  FROM eval_users u JOIN tsize ON u.user_id = tsize.user_id
  LEFT JOIN per ON u.user_id = per.user_id)
"""

ITEMCF = """
cf_r AS (SELECT user_id, product_id, CAST(SUM(interaction_score) AS DOUBLE) AS r
         FROM scored GROUP BY user_id, product_id),
cf_n AS (SELECT product_id, sqrt(SUM(r * r)) AS n FROM cf_r GROUP BY product_id),
cf_dot AS (SELECT a.product_id, b.product_id AS similar_id, SUM(a.r * b.r) AS d
           FROM cf_r a JOIN cf_r b ON a.user_id = b.user_id AND a.product_id <> b.product_id
           GROUP BY a.product_id, b.product_id),
cf_sim AS (SELECT d.product_id, d.similar_id, d.d / (x.n * y.n) AS sim,
                  round(d.d / (x.n * y.n), 9) AS similarity
           FROM cf_dot d JOIN cf_n x ON d.product_id = x.product_id
           JOIN cf_n y ON d.similar_id = y.product_id),
cf_rank AS (SELECT product_id, similar_id, similarity,
                   CAST(ROW_NUMBER() OVER (PARTITION BY product_id
                        ORDER BY similarity DESC, similar_id) AS INTEGER) AS rank
            FROM cf_sim WHERE similarity > 0)
"""

HYBRID = """
hlatest AS (SELECT user_id, customer_state AS user_state FROM (
  SELECT user_id, customer_state, ROW_NUMBER() OVER (
           PARTITION BY user_id ORDER BY order_time DESC, order_id DESC) AS rn
  FROM master) WHERE rn = 1),
hstats AS (SELECT user_id, COUNT(*) AS cnt, MAX(order_time) AS last_t FROM master GROUP BY user_id),
hctx AS (
  SELECT r.user_id, r.state, r.n, s.user_id IS NULL AS is_new,
         COALESCE(s.cnt, 0) AS interaction_count,
         date_sub('day', s.last_t, (SELECT MAX(order_time) FROM master)) AS last_purchase_days,
         l.user_state
  FROM req r LEFT JOIN hstats s ON r.user_id = s.user_id
  LEFT JOIN hlatest l ON r.user_id = l.user_id),
hroute AS (SELECT *, CASE WHEN is_new THEN 'geo_popular' WHEN interaction_count < 5 THEN 'content'
                          ELSE 'hybrid' END AS route FROM hctx),
hhist AS (SELECT user_id, product_id, CAST(interaction_score AS DOUBLE) AS r FROM interactions),
hitem0 AS (SELECT h.user_id, c.similar_id AS product_id, SUM(c.sim * h.r) AS s
           FROM hhist h JOIN cf_sim c ON c.product_id = h.product_id
           WHERE h.user_id IN (SELECT user_id FROM hroute WHERE route = 'hybrid')
           GROUP BY h.user_id, c.similar_id),
hitem1 AS (SELECT user_id, product_id,
                  round(s / MAX(s) OVER (PARTITION BY user_id), 9) AS item_score FROM hitem0),
hitem AS (SELECT user_id, product_id, item_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY item_score DESC, product_id) AS rn
  FROM hitem1) WHERE rn <= 50),
hcont0 AS (SELECT h.user_id, c.similar_id AS product_id, MAX(c.similarity) AS content_score
           FROM hhist h JOIN sim_rank c ON c.product_id = h.product_id
           WHERE h.user_id IN (SELECT user_id FROM hroute WHERE route IN ('hybrid', 'content'))
           GROUP BY h.user_id, c.similar_id),
hcont AS (SELECT user_id, product_id, content_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY content_score DESC, product_id) AS rn
  FROM hcont0) WHERE rn <= 50),
hmerged AS (
  SELECT user_id, product_id, CAST(0 AS DOUBLE) AS als_score,
         COALESCE(MAX(item_score), 0) AS item_score,
         COALESCE(MAX(content_score), 0) AS content_score
  FROM (SELECT user_id, product_id, item_score, CAST(NULL AS DOUBLE) AS content_score FROM hitem
        UNION ALL
        SELECT user_id, product_id, CAST(NULL AS DOUBLE), content_score FROM hcont)
  GROUP BY user_id, product_id),
hscored AS (SELECT *, round(CAST(0.5 AS DOUBLE) * als_score + CAST(0.3 AS DOUBLE) * item_score
                            + CAST(0.2 AS DOUBLE) * content_score, 9) AS final_score
            FROM hmerged),
hrules AS (SELECT s.*, p.category FROM hscored s JOIN prod_prof p ON s.product_id = p.product_id
           WHERE p.avg_review_score >= 3.5
             AND NOT EXISTS (SELECT 1 FROM interactions i
                             WHERE i.user_id = s.user_id AND i.product_id = s.product_id)),
hdiv AS (SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, category
                               ORDER BY final_score DESC, product_id) AS c
  FROM hrules) WHERE c <= 2),
hfinal AS (SELECT * FROM (
  SELECT user_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id
                       ORDER BY final_score DESC, product_id) AS INTEGER) AS rank,
         product_id, final_score FROM hdiv) WHERE rank <= 10),
hybrid_out AS (
  SELECT f.user_id, f.rank, f.product_id, f.final_score, r.route
  FROM hfinal f JOIN hroute r ON f.user_id = r.user_id
  UNION ALL
  SELECT p.user_id, p.rank, p.product_id, CAST(NULL AS DOUBLE), 'geo_popular'
  FROM pop_recs p JOIN hroute r ON p.user_id = r.user_id
  WHERE r.route = 'geo_popular' AND p.rank <= 10)
"""

PROTOTYPE = f"""
proto_prod AS (SELECT p.*, t.product_category_name_english FROM products_m p
               LEFT JOIN translation_m t ON p.product_category_name = t.product_category_name),
proto_join AS (
  SELECT o.order_id, i.product_id, o.customer_id, o.order_status,
         o.order_purchase_timestamp AS order_time, i.order_item_id, i.seller_id, i.price,
         i.shipping_limit_date, pp.product_category_name, pp.product_weight_g,
         pp.product_category_name_english AS category, c.customer_unique_id AS user_id,
         c.customer_state, c.customer_zip_code_prefix, r.review_score, pay.payment_value
  FROM orders_m o JOIN items_m i ON i.order_id = o.order_id
  JOIN proto_prod pp ON pp.product_id = i.product_id
  JOIN customers_m c ON c.customer_id = o.customer_id
  LEFT JOIN reviews_m r ON r.order_id = o.order_id
  JOIN pay ON pay.order_id = o.order_id
  WHERE o.order_status = '{DELIVERED_STATUS}'),
proto_master AS (
  SELECT DISTINCT order_id, product_id, order_time, order_item_id,
         COALESCE(category, 'Unknown') AS category, user_id, customer_state,
         COALESCE(review_score, CAST(3 AS DOUBLE)) AS review_score, payment_value
  FROM proto_join),
proto_prof AS (
  SELECT product_id, COUNT(*) AS total_purchases, {EA_PAY} AS avg_price,
         {EA_REVIEW} AS avg_review_score,
         MIN(category) AS category
  FROM proto_master GROUP BY product_id)
"""

# H3-H6 with given scores in the place of ALS (queries.given_als)
HYBRID_ALS = HYBRID.replace("""hmerged AS (
  SELECT user_id, product_id, CAST(0 AS DOUBLE) AS als_score,""", """gals0 AS (
  SELECT c.customer_unique_id AS user_id, p.product_id,
         ((c.customer_unique_id * 31 + p.product_id * 17) % 1009 + 1) / CAST(1010 AS DOUBLE) AS als_score
  FROM customers_m c JOIN products_m p ON c.customer_unique_id % 7 = p.product_id % 7
  WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = c.customer_unique_id
                    AND i.product_id = p.product_id)),
gals1 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
            ORDER BY als_score DESC, product_id) AS rn FROM gals0) WHERE rn <= 50),
gals AS (SELECT user_id, product_id, round(als_score / MAX(als_score) OVER (PARTITION BY user_id), 9) AS als_score
         FROM gals1 WHERE user_id IN (SELECT user_id FROM hroute WHERE route = 'hybrid')),
hmerged AS (
  SELECT user_id, product_id, COALESCE(MAX(als_score), 0) AS als_score,""").replace(
    """  FROM (SELECT user_id, product_id, item_score, CAST(NULL AS DOUBLE) AS content_score FROM hitem
        UNION ALL
        SELECT user_id, product_id, CAST(NULL AS DOUBLE), content_score FROM hcont)""",
    """  FROM (SELECT user_id, product_id, item_score, CAST(NULL AS DOUBLE) AS content_score,
               CAST(NULL AS DOUBLE) AS als_score FROM hitem
        UNION ALL
        SELECT user_id, product_id, CAST(NULL AS DOUBLE), content_score, CAST(NULL AS DOUBLE) FROM hcont
        UNION ALL
        SELECT user_id, product_id, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), als_score FROM gals)""")

EVAL_SAMPLE = """
sample_users AS (SELECT user_id FROM eval_users
                 ORDER BY md5(concat_ws('|', '42', user_id)) LIMIT 1000),
sample_metrics AS (SELECT * FROM pop_metrics WHERE user_id IN (SELECT user_id FROM sample_users))
"""

WARM_FILL = """
t4_item0 AS (SELECT h.user_id, c.similar_id AS product_id, SUM(c.sim * h.r) AS s
             FROM hhist h JOIN cf_sim c ON c.product_id = h.product_id
             GROUP BY h.user_id, c.similar_id),
t4_item1 AS (SELECT user_id, product_id,
                    round(s / MAX(s) OVER (PARTITION BY user_id), 9) AS item_score FROM t4_item0),
t4_item AS (SELECT user_id, product_id, item_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY item_score DESC, product_id) AS rn
  FROM t4_item1) WHERE rn <= 50),
t4_cand AS (SELECT user_id, product_id, rank FROM (
  SELECT user_id, product_id,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY item_score DESC, product_id) AS rank
  FROM t4_item c WHERE NOT EXISTS (SELECT 1 FROM interactions i
                                   WHERE i.user_id = c.user_id AND i.product_id = c.product_id))
  WHERE rank <= 20),
t4_pop AS (SELECT p.user_id, p.rank, p.product_id FROM pop_recs p
           WHERE p.segment = 'warm'
             AND NOT EXISTS (SELECT 1 FROM interactions i
                             WHERE i.user_id = p.user_id AND i.product_id = p.product_id)),
t4_union AS (SELECT user_id, product_id, 0 AS prio, rank FROM t4_cand
             UNION ALL SELECT user_id, product_id, 1, rank FROM t4_pop),
t4_dedup AS (SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, product_id ORDER BY prio, rank) AS k
  FROM t4_union) WHERE k = 1),
t4_out AS (SELECT * FROM (
  SELECT user_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY prio, rank) AS INTEGER)
           AS rank, product_id,
         CASE WHEN prio = 0 THEN 'given' ELSE 'popularity_fill' END AS source
  FROM t4_dedup) WHERE rank <= 10)
"""
