"""Readers, filters, de-duplication, time windows and data-quality profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.checks import sql as q
from topicloom.checks.registry import check, table
from topicloom.functions import text as tx
from topicloom.functions import timefn as tm
from topicloom.functions.wordlists import PLACEHOLDERS_LOOSE, PLACEHOLDERS_STRICT
from topicloom.operators import dedupe as dd
from topicloom.operators import profile as pf
from topicloom.operators.features import dense_ids
from topicloom.operators.ranking import examples_per_category
from topicloom.plans.pipeline import clean_corpus, drop_blank_both
from topicloom.plans.reports import trend_by_month
from topicloom.session import cut_lineage, shared_folder
from topicloom.sources.readers import cleaned_table, corpus_for, raw_columns, read_landed_json, read_raw_csv
from topicloom.sources.timebins import adaptive_time_bins, plan_year_windows
from topicloom.streaming.latest import LatestTable


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("service_request_id"), F.col("source").alias("service_name"), F.col("text").alias("description")
    )


@check("scan_raw", "SELECT doc_id AS service_request_id, coalesce(text, '') AS description FROM documents")
def scan_raw(spark, sf):
    return raw_columns(raw(spark, sf))


LANDED_SQL = "SELECT doc_id::VARCHAR AS service_request_id, source AS service_name, text AS description FROM documents"


def landed(spark: SparkSession, sf: str) -> DataFrame:
    """The documents under the names of raw records."""
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("service_request_id"), F.col("source").alias("service_name"), F.col("text").alias("description"))


@check("scan_csv", LANDED_SQL)
def scan_csv(spark, sf):
    """The documents written as CSV files and read back, line breaks and quotes included."""
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    writer = landed(spark, sf).write.option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_raw_csv(spark, path)


@check("scan_landed_json", LANDED_SQL)
def scan_landed_json(spark, sf):
    """The documents written as JSON lists, a hundred ids to a response, and read back."""
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    responses = landed(spark, sf).groupBy(F.expr("cast(service_request_id as long) div 100").alias("response"))
    bodies = responses.agg(F.to_json(F.collect_list(F.struct("service_request_id", "service_name", "description"))).alias("value"))
    bodies.write.partitionBy("response").text(path)
    return read_landed_json(spark, path).select("service_request_id", "service_name", "description")


@check(
    "scan_cleaned",
    f"""SELECT page_id, html AS description, {q.strong('html')} AS strong_text, {q.light('html')} AS light_text
    FROM pages WHERE {q.strong('html')} <> '' AND {q.light('html')} <> ''""",
)
def scan_cleaned(spark, sf):
    return cleaned_table(clean_corpus(table(spark, sf, "pages"), "page_id", "html"))


@check(
    "corpus_for_light",
    f"""SELECT conv_id || ':' || turn AS turn_id, {q.light('text')} AS light_text FROM conversations
    WHERE {q.light('text')} <> ''""",
)
def corpus_for_light(spark, sf):
    turns = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")
    light = turns.select("turn_id", tx.clean_light(F.col("text")).alias("light_text"))
    return corpus_for(light, "light", "turn_id")


@check(
    "clean_corpus",
    f"""SELECT doc_id, text AS description, {q.strong('text')} AS strong_text, {q.light('text')} AS light_text
    FROM documents WHERE {q.strong('text')} <> '' AND {q.light('text')} <> ''""",
)
def clean_corpus_query(spark, sf):
    return clean_corpus(table(spark, sf, "documents"), "doc_id", "text")


# Texts with nulls, blanks and placeholders: documents by their labels.
MESSY_SQL = """
messy AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.text WHEN l.toxic = 1 THEN ' NULL' || chr(160)
    WHEN l.quality = 0 THEN ' None ' WHEN d.lang = 'de' THEN ' a B 1 ' WHEN d.lang = 'fr' THEN chr(9) || ' ' ELSE NULL END AS t
  FROM documents d LEFT JOIN labels l USING (doc_id)
)
"""


def messy(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumn("known", F.lit(True))
    joined = table(spark, sf, "documents").join(labels, "doc_id", "left")
    text = (
        F.when(F.col("known").isNull(), F.col("text"))
        .when(F.col("toxic") == 1, F.lit(" NULL "))
        .when(F.col("quality") == 0, F.lit(" None "))
        .when(F.col("lang") == "de", F.lit(" a B 1 "))
        .when(F.col("lang") == "fr", F.lit("\t "))
    )
    return joined.select("doc_id", text.alias("t"))


@check("null_text_to_empty", f"WITH {MESSY_SQL} SELECT doc_id, coalesce(t, '') AS text FROM messy")
def null_text_to_empty(spark, sf):
    return messy(spark, sf).select("doc_id", tx.text_or_empty(F.col("t")).alias("text"))


@check(
    "drop_blank_both",
    f"""WITH {MESSY_SQL}, c AS (SELECT doc_id, {q.strong('t')} AS strong_text, {q.light('t')} AS light_text FROM messy)
    SELECT * FROM c WHERE trim(strong_text) <> '' AND trim(light_text) <> ''""",
)
def drop_blank_both_query(spark, sf):
    from topicloom.functions.wordlists import strong_stopwords

    both = messy(spark, sf).select(
        "doc_id", tx.clean_strong(F.col("t"), strong_stopwords()).alias("strong_text"), tx.clean_light(F.col("t")).alias("light_text")
    )
    return both.where(drop_blank_both())


@check(
    "drop_placeholder_text",
    rf"""WITH {MESSY_SQL}, c AS (SELECT *, trim(regexp_replace(replace(t, chr(160), ' '), '\s+', ' ', 'g')) AS s FROM messy)
    SELECT doc_id, t AS text FROM c WHERE t IS NOT NULL AND s <> '' AND lower(s) NOT IN ('nan', 'none', 'null')""",
)
def drop_placeholder_text(spark, sf):
    kept = messy(spark, sf).where(tx.is_real_text_strict(F.col("t"), PLACEHOLDERS_STRICT))
    return kept.select("doc_id", F.col("t").alias("text"))


@check(
    "drop_placeholder_loose",
    rf"""WITH {MESSY_SQL}, c AS (SELECT *, regexp_replace(coalesce(t, 'nan'), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') AS s FROM messy)
    SELECT doc_id, t AS text FROM c WHERE s <> '' AND lower(s) NOT IN ('nan', 'none')""",
)
def drop_placeholder_loose(spark, sf):
    kept = messy(spark, sf).where(tx.is_real_text_loose(F.col("t"), PLACEHOLDERS_LOOSE))
    return kept.select("doc_id", F.col("t").alias("text"))


ORDERS_SQL = """
o AS (
  SELECT o_custkey AS id, o_orderkey AS seq,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS ts,
    CASE o_orderstatus WHEN 'O' THEN ' Open ' WHEN 'F' THEN 'CLOSED' ELSE 'pending' END AS status
  FROM orders
)
"""
LATEST_SQL = "SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS FIRST, seq DESC) = 1"
SLICES_SQL = f"""{ORDERS_SQL},
dated AS (SELECT id, seq, o_orderdate AS ts, status FROM o JOIN orders ON o_orderkey = seq),
op AS (SELECT * FROM ({LATEST_SQL.format("(SELECT * FROM dated WHERE status <> 'CLOSED')")}) WHERE lower(trim(status)) = 'open'),
cl AS (SELECT * FROM ({LATEST_SQL.format("(SELECT * FROM dated WHERE status = 'CLOSED')")}) WHERE lower(trim(status)) = 'closed'),
merged AS (
  SELECT id, seq, ts, status FROM (SELECT *, 0 AS part FROM op UNION ALL SELECT *, 1 AS part FROM cl)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS FIRST, part DESC, seq DESC) = 1
)
"""


def dated(spark: SparkSession, sf: str, null_pending: bool = True) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
        F.when((F.col("o_orderstatus") != "P") | F.lit(not null_pending), F.col("o_orderdate")).alias("ts"),
        F.when(F.col("o_orderstatus") == "O", " Open ").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("pending").alias("status"),
    )


def slices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The records as two requests return them: one for open ones (pending rows slip in), one for closed ones."""
    rows = dated(spark, sf, null_pending=False)
    latest = lambda df, s: dd.latest_with_status(df, "id", "ts", "seq", "status", s)
    return latest(rows.where("status <> 'CLOSED'"), "open"), latest(rows.where("status = 'CLOSED'"), "closed")


@check("keep_latest", f"WITH {ORDERS_SQL} {LATEST_SQL.format('o')}")
def keep_latest(spark, sf):
    return dd.keep_latest(dated(spark, sf), "id", "ts", "seq")


@check("filter_status_latest", f"WITH {ORDERS_SQL} SELECT * FROM ({LATEST_SQL.format('o')}) WHERE lower(trim(status)) = 'closed'")
def filter_status_latest(spark, sf):
    return dd.latest_with_status(dated(spark, sf), "id", "ts", "seq", "status", "closed")


@check("merge_open_closed", f"WITH {SLICES_SQL} SELECT * FROM merged")
def merge_open_closed(spark, sf):
    return dd.merge_by_status(*slices(spark, sf), "id", "ts", "seq")


@check("merge_by_batches", f"WITH {SLICES_SQL} SELECT * FROM merged")
def merge_by_batches(spark, sf):
    """The same merge by three batches into a keep-latest table, the second of which runs twice."""
    opened, closed = slices(spark, sf)
    rows = cut_lineage(opened.withColumn("part", F.lit(0)).unionByName(closed.withColumn("part", F.lit(1))))
    latest = LatestTable(spark, f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}", rows.schema, "id", "ts", ("part", "seq"), 16)
    for batch in (0, 1, 1, 2):
        latest.upsert(rows.where(F.pmod(F.xxhash64("id", "seq"), F.lit(3)) == batch), batch)
    return latest.read().drop("part")


@check(
    "merge_counts",
    f"""WITH {SLICES_SQL} SELECT (SELECT count(*) FROM op) + (SELECT count(*) FROM cl) AS before, count(*) AS after,
    (SELECT count(*) FROM op) AS open_rows, (SELECT count(*) FROM cl) AS closed_rows FROM merged""",
)
def merge_counts(spark, sf):
    opened, closed = slices(spark, sf)
    return dd.merge_counts(opened, closed, dd.merge_by_status(opened, closed, "id", "ts", "seq"))


@check(
    "examples_per_category",
    """SELECT service_name, description, rank FROM (SELECT source AS service_name, text AS description,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE source IS NOT NULL) WHERE rank <= 2""",
)
def examples(spark, sf):
    found = examples_per_category(raw(spark, sf), "service_name", "service_request_id", 2)
    return found.select("service_name", "description", F.col("rank").cast("long").alias("rank"))


@check(
    "distinct_categories",
    """SELECT source AS service_name, (SELECT count(DISTINCT source) FROM documents) AS n_categories
    FROM documents WHERE source IS NOT NULL GROUP BY source""",
)
def distinct_categories(spark, sf):
    return pf.distinct_categories(raw(spark, sf), "service_name")


@check(
    "duplicate_id_rows",
    """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, count(*) FILTER (n > 1) AS duplicated_ids FROM g""",
)
def duplicate_id_rows(spark, sf):
    return pf.duplicate_id_rows(table(spark, sf, "orders"), "o_custkey")


BLANK_SQL = r"(t IS NULL OR regexp_full_match(t, '[\s\x{a0}]*'))"


@check(
    "empty_text_report",
    f"""WITH {MESSY_SQL} SELECT count(*) AS total_rows, count(*) FILTER ({BLANK_SQL}) AS empty_rows,
    round(100.0::DOUBLE * count(*) FILTER ({BLANK_SQL}) / count(*), 6) AS empty_percent FROM messy""",
)
def empty_text_report(spark, sf):
    return pf.empty_text_report(messy(spark, sf), "t").withColumn("empty_percent", F.round("empty_percent", 6))


@check(
    "quality_counts",
    f"""WITH {MESSY_SQL} SELECT count(*) AS n_rows, count(*) FILTER (t IS NULL) AS strong_nulls,
    count(*) FILTER (t IS NULL) AS light_nulls, count(*) FILTER ({BLANK_SQL}) AS strong_blank,
    count(*) FILTER ({BLANK_SQL} OR u = '') AS light_blank, count(*) FILTER ({BLANK_SQL} AND ({BLANK_SQL} OR u = '')) AS both_blank,
    count(*) FILTER (coalesce(lower(t), 'nan') = 'nan') AS strong_nan, count(*) FILTER (coalesce(lower(u), 'nan') = 'nan') AS light_nan
    FROM (SELECT t, CASE WHEN t IS NULL THEN NULL ELSE replace(t, ' None ', 'NaN') END AS u FROM messy)""",
)
def quality_counts(spark, sf):
    texts = messy(spark, sf).select(F.col("t").alias("strong_text"), F.replace("t", F.lit(" None "), F.lit("NaN")).alias("light_text"))
    return pf.quality_counts(texts)


def _profile_sql(name: str, expr: str) -> str:
    return f"""SELECT '{name}' AS measure, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v)::BIGINT AS min,
    quantile_cont(v, 0.25)::DOUBLE AS p25, quantile_cont(v, 0.5)::DOUBLE AS p50, quantile_cont(v, 0.75)::DOUBLE AS p75, max(v)::BIGINT AS max
    FROM (SELECT ({expr})::DOUBLE AS v FROM documents WHERE {q.strong('text')} <> '' AND {q.light('text')} <> '')"""


@check(
    "length_profile",
    _profile_sql("strong_tokens", f"len({q.strong_list('text')})") + " UNION ALL " + _profile_sql("light_chars", f"length({q.light('text')})"),
)
def length_profile(spark, sf):
    found = pf.length_profile(clean_corpus(table(spark, sf, "documents"), "doc_id", "text"))
    return found.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@check("doc_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM documents")
def doc_index(spark, sf):
    return dense_ids(table(spark, sf, "documents").select("doc_id"), ["doc_id"], "doc_index")


@check(
    "iso_utc",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', ts)::TIMESTAMP AS whole FROM events""",
)
def iso_utc(spark, sf):
    iso = table(spark, sf, "events").select("event_id", tm.to_iso(F.col("ts")).alias("iso"))
    return iso.withColumn("whole", tm.from_iso(F.col("iso")))


@check(
    "plan_year_windows",
    """WITH b AS (SELECT min(o_orderdate) + INTERVAL 40 DAY AS s, max(o_orderdate) + INTERVAL 1 DAY AS e FROM orders),
    y AS (SELECT s, e, unnest(range(year(s), year(e) + 1)) AS y FROM b),
    w AS (SELECT greatest(s, make_timestamp(y, 1, 1, 0, 0, 0)) AS win_start, least(e, make_timestamp(y + 1, 1, 1, 0, 0, 0)) AS win_end FROM y)
    SELECT win_start, win_end, count(o_orderkey) AS n FROM w LEFT JOIN orders ON o_orderdate >= win_start AND o_orderdate < win_end
    WHERE win_start < win_end GROUP BY ALL""",
)
def year_windows(spark, sf):
    orders = table(spark, sf, "orders")
    bounds = orders.agg(
        (F.min("o_orderdate") + F.expr("interval 40 day")).alias("start"), (F.max("o_orderdate") + F.expr("interval 1 day")).alias("end")
    )
    windows = plan_year_windows(bounds).withColumn("y", F.year("win_start"))
    per_day = orders.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("k")).withColumn("y", F.year("o_orderdate"))
    inside = (F.col("o_orderdate") >= F.col("win_start")) & (F.col("o_orderdate") < F.col("win_end"))
    return (
        windows.join(per_day, "y", "left").groupBy("win_start", "win_end")
        .agg(F.coalesce(F.sum(F.when(inside, F.col("k"))), F.lit(0)).alias("n"))
    )


@check(
    "adaptive_time_bins",
    """WITH RECURSIVE b AS (SELECT min(o_orderdate) AS s, max(o_orderdate) + INTERVAL 1 DAY AS e FROM orders),
    y AS (SELECT s, e, unnest(range(year(s), year(e) + 1)) AS y FROM b),
    w AS (SELECT epoch_us(greatest(s, make_timestamp(y, 1, 1, 0, 0, 0))) AS lo, epoch_us(least(e, make_timestamp(y + 1, 1, 1, 0, 0, 0))) AS hi FROM y),
    pieces AS (
      SELECT lo, hi FROM w WHERE lo < hi
      UNION ALL
      SELECT unnest([lo, lo + 90 * 86400000000]), unnest([lo + 90 * 86400000000, hi]) FROM pieces WHERE (hi - lo) // 86400000000 > 90
    ),
    bins AS (
      SELECT lo, hi, (SELECT count(*) FROM orders WHERE epoch_us(o_orderdate) >= lo AND epoch_us(o_orderdate) < hi) AS n
      FROM pieces WHERE (hi - lo) // 86400000000 <= 90
      UNION ALL
      SELECT h.lo, h.hi, (SELECT count(*) FROM orders WHERE epoch_us(o_orderdate) >= h.lo AND epoch_us(o_orderdate) < h.hi) AS n
      FROM (SELECT unnest([lo, lo + (hi - lo) // 2]) AS lo, unnest([lo + (hi - lo) // 2, hi]) AS hi FROM bins
        WHERE n >= 100 AND (hi - lo) // 86400000000 > 7) h
    )
    SELECT make_timestamp(lo) AS bin_start, make_timestamp(hi) AS bin_end, ((hi - lo) // 86400000000)::BIGINT AS span_days, n AS n_records
    FROM bins WHERE n < 100 OR (hi - lo) // 86400000000 <= 7""",
)
def time_bins(spark, sf):
    orders = table(spark, sf, "orders")
    bounds = orders.agg(F.min("o_orderdate").alias("start"), (F.max("o_orderdate") + F.expr("interval 1 day")).alias("end"))
    return adaptive_time_bins(orders, "o_orderdate", plan_year_windows(bounds))


@check(
    "trend_by_month",
    "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
)
def trend(spark, sf):
    return trend_by_month(table(spark, sf, "orders"), "o_orderdate", "o_orderpriority")


@check("sample_texts")
def sample_texts(spark, sf):
    cleaned = clean_corpus(table(spark, sf, "documents"), "doc_id", "text")
    return pf.sample_texts(cleaned, "doc_id", ["description", "light_text"], 10)
