"""Queries of splits, sampling and batch plans over lineitem's suppliers and the events' users, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwave.operators import splits as D

from .tables import SAMPLES_SQL, pred_sql, predictions, r6, samples, table


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return D.class_matrix(predictions(spark, d), "patient", "truth")


def patient_class_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.split_rows(table(spark, d, "events").select("event_id"), "event_id")


def balanced_split(spark: SparkSession, d: str) -> DataFrame:
    return D.balanced_split(_matrix(spark, d), "patient")


def kfold_search(spark: SparkSession, d: str) -> DataFrame:
    return D.kfold_search(_matrix(spark, d), "patient", 5)


def inner_search(spark: SparkSession, d: str) -> DataFrame:
    return D.inner_search(_matrix(spark, d).withColumn("outer_fold", F.col("patient") % 5), "patient", "outer_fold")


# The same searches by the names that they had while the others tried fewer candidates.
balanced_split_full, kfold_search_full, inner_search_full = balanced_split, kfold_search, inner_search


def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' folds by hash; suppliers that divide by 7 are held out twice, those that divide by 11 never."""
    cohort = table(spark, d, "supplier").select(F.col("s_suppkey").alias("patient"))
    once = cohort.where("patient % 11 <> 0").withColumn("fold", F.col("patient") % 5)
    return D.leakage(once.unionByName(once.where("patient % 7 = 0").withColumn("fold", (F.col("fold") + 1) % 5)), "patient", "fold", cohort)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type")


def strat_cap(spark: SparkSession, d: str) -> DataFrame:
    return D.capped(_events(spark, d), ["user_id", "event_type"], "event_id", 5)


def calibration_sample(spark: SparkSession, d: str) -> DataFrame:
    return D.calibration_sample(_events(spark, d), "user_id", "event_type", "event_id", 12)


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return D.even_sample(samples(spark, d), "user_id", "idx", 20).select("user_id", "idx", "event_id")


def block_batches(spark: SparkSession, d: str) -> DataFrame:
    return D.block_batches(_events(spark, d).select("event_id", "user_id"), "user_id", "event_id", 16, epoch=3, drop_last=True)


def round_robin_batches(spark: SparkSession, d: str) -> DataFrame:
    return D.round_robin(_events(spark, d).select("event_id", "user_id"), "user_id", "event_id", 4, turns=8, epoch=3)


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return D.class_weights(predictions(spark, d), "truth").withColumn("weight", r6(F.col("weight")))


def cohort_table(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("side", F.when(F.col("patient") % 5 == 0, "test").when(F.col("patient") % 5 == 1, "validation").otherwise("train"))
    return D.cohort_table(p, "side", "patient", "truth").withColumns({f"pct_{c}": r6(F.col(f"pct_{c}")) for c in range(3)})


QUERIES = {f.__name__: f for f in (patient_class_matrix, split_rows, balanced_split, kfold_search, inner_search, leakage_check, strat_cap, calibration_sample, even_sample, block_batches, round_robin_batches, class_weights, cohort_table)}
QUERIES |= {"balanced_split_full": balanced_split_full, "kfold_search_full": kfold_search_full, "inner_search_full": inner_search_full}

P = pred_sql()
_MATRIX = f"WITH {P}, m AS (SELECT patient, count(*) AS n, count(*) FILTER (truth=0) AS n0, count(*) FILTER (truth=1) AS n1, count(*) FILTER (truth=2) AS n2 FROM pred GROUP BY patient), tot AS (SELECT count(*) AS p, sum(n)::DOUBLE AS n, sum(n0)::DOUBLE AS n0, sum(n1)::DOUBLE AS n1, sum(n2)::DOUBLE AS n2 FROM m)"
_ORDER = "o AS (SELECT m.*, trial, row_number() OVER (PARTITION BY trial ORDER BY md5(concat_ws('|',42,trial,patient)), patient) AS rn FROM m, range({}) g(trial))"

ORACLES = {
    "patient_class_matrix": f"{_MATRIX} SELECT * FROM m",
    "split_rows": """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat_ws('|',42,event_id)), event_id)-1 AS k FROM events), n AS (SELECT count(*) AS n, least(greatest(1,floor(0.7::DOUBLE*count(*))),count(*)-2) AS a, floor(0.15::DOUBLE*count(*)) AS b FROM events)
      SELECT event_id, CASE WHEN k<a THEN 'train' WHEN k<a+least(greatest(1,b),n-a-1) THEN 'validation' ELSE 'test' END AS side FROM o, n""",
    "balanced_split": f"""{_MATRIX}, {_ORDER.format(10_000)}, z AS (SELECT p, greatest(CASE WHEN p>=6 THEN 2 ELSE 1 END, floor(0.15::DOUBLE*p))::BIGINT AS b, greatest(CASE WHEN p>=6 THEN 2 ELSE 1 END, floor((1-0.7::DOUBLE-0.15::DOUBLE)*p+1e-9))::BIGINT AS c FROM tot),
      s AS (SELECT o.*, CASE WHEN rn<=p-b-c THEN 'train' WHEN rn<=p-c THEN 'validation' ELSE 'test' END AS side, CASE WHEN rn<=p-b-c THEN (p-b-c)::DOUBLE/p WHEN rn<=p-c THEN b::DOUBLE/p ELSE c::DOUBLE/p END AS target FROM o, z),
      g AS (SELECT trial, side, max(target) AS target, sum(n)::DOUBLE AS n, sum(n0)::DOUBLE AS n0, sum(n1)::DOUBLE AS n1, sum(n2)::DOUBLE AS n2 FROM s GROUP BY trial, side),
      sc AS (SELECT trial, round(sum(1.5*pow(g.n/tot.n-target,2)+{'+'.join(f'pow(g.{k}/g.n-tot.{k}/tot.n,2)+CASE WHEN g.{k}=0 THEN 100 ELSE 0 END+0.02::DOUBLE*greatest(0,10-g.{k})' for k in ('n0', 'n1', 'n2'))}),9) AS score FROM g, tot GROUP BY trial),
      b AS (SELECT * FROM sc ORDER BY score, trial LIMIT 1) SELECT trial, score, patient, side FROM s JOIN b USING (trial)""",
    "kfold_search": f"""{_MATRIX}, {_ORDER.format(200_000)}, s AS (SELECT o.*, floor((rn-1)*5/p)::INT AS fold FROM o, tot), g AS (SELECT trial, fold, sum(n)::DOUBLE AS n, sum(n0)::DOUBLE AS n0, sum(n1)::DOUBLE AS n1, sum(n2)::DOUBLE AS n2, count(*) FILTER (n1>0) AS w1, count(*) FILTER (n2>0) AS w2 FROM s GROUP BY trial, fold),
      sc AS (SELECT trial, round(avg({'+'.join(f'{w}*pow((g.{k}-tot.{k}/5)/(tot.{k}/5),2)' for k, w in (('n0', '0.25'), ('n1', '1'), ('n2', '1')))})+0.05*(var_pop(w1)+var_pop(w2))+0.05*avg(ln(1+pow((g.n-tot.n/5)/(tot.n/5),2))),9) AS score FROM g, tot GROUP BY trial HAVING min(least(g.n1,g.n2))>0 AND count(*)=5),
      b AS (SELECT * FROM sc ORDER BY score, trial LIMIT 1) SELECT trial, score, patient, fold FROM s JOIN b USING (trial)""",
    "inner_search": f"""{_MATRIX}, f AS (SELECT x AS outer_fold, m.* FROM (SELECT DISTINCT patient%5 AS x FROM m), m WHERE patient%5<>x), z AS (SELECT outer_fold, greatest(4,count(*)//4) AS k, sum(n)::DOUBLE AS an, sum(n0)::DOUBLE AS a0, sum(n1)::DOUBLE AS a1, sum(n2)::DOUBLE AS a2 FROM f GROUP BY outer_fold),
      v AS (SELECT * FROM (SELECT f.*, trial, row_number() OVER (PARTITION BY outer_fold, trial ORDER BY md5(concat_ws('|',42,outer_fold,trial,patient)), patient) AS rn FROM f, range(100000) g(trial)) JOIN z USING (outer_fold) WHERE rn<=k),
      c AS (SELECT outer_fold, trial, k, an, a0, a1, a2, sum(n)::DOUBLE AS n, sum(n0)::DOUBLE AS n0, sum(n1)::DOUBLE AS n1, sum(n2)::DOUBLE AS n2, count(*) FILTER (n1>0) AS w1, count(*) FILTER (n2>0) AS w2 FROM v GROUP BY ALL),
      q AS (SELECT outer_fold, trial, round(0.15*pow((n/an-0.25)/0.25,2)+0.01*abs(8-k)+0.25*pow(n0/(a0*(n/an))-1,2)+pow(n1/(a1*(n/an))-1,2)+pow(n2/(a2*(n/an))-1,2),9) AS score FROM c WHERE n/an BETWEEN 0.10 AND 0.40 AND w1>=4 AND w2>=4 AND n0>0 AND n1>0 AND n2>0 AND n0<a0 AND n1<a1 AND n2<a2),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY score, trial) AS r FROM q) WHERE r=1) SELECT outer_fold, trial, score, patient FROM v JOIN b USING (outer_fold, trial)""",
    "leakage_check": """SELECT 'held out more than once' AS rule, count(*) FILTER (s_suppkey%7=0 AND s_suppkey%11<>0) AS violations FROM supplier UNION ALL SELECT 'never held out', count(*) FILTER (s_suppkey%11=0) FROM supplier UNION ALL SELECT 'not in the cohort', 0::BIGINT""",
    "strat_cap": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5(concat_ws('|',42,event_id)), event_id) AS rn FROM events) WHERE rn<=5",
    "calibration_sample": """WITH k AS (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY user_id), r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5(concat_ws('|',42,event_id)), event_id)<=greatest(1,12//k) AS first FROM events JOIN k USING (user_id))
      SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first DESC, md5(concat_ws('|',42,event_id)), event_id) AS rn FROM r) WHERE rn<=12""",
    "even_sample": f"""WITH {SAMPLES_SQL}, n AS (SELECT user_id, count(*) AS n FROM samples GROUP BY user_id), c AS (SELECT DISTINCT user_id, CASE WHEN n<=20 THEN i ELSE floor(i*(n-1)/19.0::DOUBLE)::BIGINT END AS idx FROM n, range(20) g(i) WHERE n>20 OR i<n)
      SELECT s.user_id, s.idx, event_id FROM samples s JOIN c ON s.user_id=c.user_id AND s.idx=c.idx""",
    "block_batches": """WITH b AS (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|',42,3,user_id,event_id)), event_id)-1)//16 AS batch, count(*) OVER (PARTITION BY user_id)//16 AS whole FROM events), u AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat_ws('|',42,3,user_id)), user_id)-1 AS patient_no FROM (SELECT DISTINCT user_id FROM events))
      SELECT event_id, user_id, batch, patient_no FROM b JOIN u USING (user_id) WHERE batch<whole""",
    "round_robin_batches": """WITH b AS (SELECT DISTINCT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|',42,3,user_id,event_id)), event_id)-1)//4 AS batch FROM events)
      SELECT user_id, batch, batch//8 AS round, row_number() OVER (ORDER BY batch//8, md5(concat_ws('|',42,3,batch//8,user_id)), user_id, batch)-1 AS position FROM b""",
    "class_weights": f"WITH {P}, n AS (SELECT c AS label, count(*) FILTER (truth=c) AS n FROM pred, (VALUES (0),(1),(2)) v(c) GROUP BY c) SELECT label::INT AS label, n, round(CASE WHEN n>0 THEN (SELECT sum(n) FROM n)/((SELECT count(*) FROM n WHERE n>0)*n)::DOUBLE ELSE 0 END,6) AS weight FROM n",
    "cohort_table": f"""WITH {P}, s AS (SELECT *, CASE patient%5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS side FROM pred) SELECT side, count(DISTINCT patient) AS patients, count(*) AS n_windows, {', '.join(f'round(100.0::DOUBLE*count(*) FILTER (truth={c})/count(*),6) AS pct_{c}' for c in range(3))},
      (SELECT string_agg(p::VARCHAR, ';' ORDER BY p) FROM (SELECT DISTINCT patient AS p FROM s x WHERE x.side=s.side)) AS members FROM s GROUP BY side""",
}
ORACLES |= {f"{k}_full": ORACLES[k] for k in ("balanced_split", "kfold_search", "inner_search")}
