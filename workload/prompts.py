"""Prompt routing, periods and answers."""

from __future__ import annotations

import uuid

from salesmart.operators import prompts as pr
from salesmart.session import shared_folder
from workload.catalog import HDR, plain, query, with_tables
from workload.extraction import REVENUE_SQL, revenue
from workload.tables import prompts, table

PROMPTS_SQL = """prompts AS (
  SELECT companyfn, okey AS prompt_id, date_trans AS asked_at,
    CASE okey % 9
      WHEN 0 THEN 'Show me revenue for ' || monthname(date_trans) || ' ' || year(date_trans)
      WHEN 1 THEN 'revenue ' || strftime(date_trans, '%m') || '/' || year(date_trans)
      WHEN 2 THEN 'revenue report ' || month(date_trans) || '.' || year(date_trans)
      WHEN 3 THEN 'revenue ' || year(date_trans)
      WHEN 4 THEN 'top customers ' || month(date_trans) || '/' || year(date_trans)
      WHEN 5 THEN 'bestseller by category' WHEN 6 THEN 'monthly growth'
      WHEN 7 THEN 'sales trend' WHEN 8 THEN 'hello there'
        || CASE WHEN okey % 2 = 1 THEN chr(10) || 'revenue ' || year(date_trans) ELSE '' END END AS prompt
  FROM hdr)"""


# fixed values: the words that route a prompt, stated here again so that the SQL does not lean on the code it checks
WORDS = {
    "shortcut": "triển vọng; xu hướng; tương lai; sắp tới; tiềm năng; top 10; trend; potential; forecast; "
                "potential products; top products; top 10 products",
    "customer": "customer; purchase; repurchase; churn; retention; active customers; average order; repeat customer; "
                "order value",
    "product": "product; item; goods; bestseller; potential products; top products; best selling",
    "trend": "trend; over time; monthly; yearly; growth; sales trends; monthly sales",
    "forecast": "forecast; predict; future; projection; plan; next 30 days; sales forecast",
    "revenue": "revenue report; revenue by date; revenue date; revenue by month; show me revenue; revenue for",
    "data": "customer; product; sales; trend; forecast; churn; analysis; top; bestseller; revenue; order; month; year; "
            "date; daily; monthly; yearly; period; january; february; march; april; may; june; july; august; september; "
            "october; november; december; triển vọng; xu hướng; phổ biến; nổi bật; tương lai; sắp tới; hot trend; tiềm năng",
}


def any_word(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


# fixed values: how months and periods are written
MONTH_RE = ("(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
            "sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
DATED_RE = (r"(\d{1,2}/\d{4})|(\d{1,2}\.\d{4})|(\d{1,2}-\d{4})|" + MONTH_RE
            + r"\s*\d{4}|year\s*\d{4}|\d{4}\s+year|revenue\s+\d{4}")


def tags_sql(source: str) -> str:
    """Routing of ``source`` (columns key..., prompt), words matched one by one."""
    return f"""low AS (SELECT *, lower(prompt) AS low FROM {source}),
hits AS (SELECT *, list_filter([
    CASE WHEN regexp_matches(low, '{DATED_RE}') OR {any_word(WORDS['revenue'].split('; '))}
      OR regexp_matches(low, '(^|\\s)\\d{{4}}(\\s|$)') THEN 'revenue_report_by_date' END,
    CASE WHEN {any_word(WORDS['customer'].split('; '))} THEN 'customer_analysis' END,
    CASE WHEN {any_word(WORDS['product'].split('; '))} THEN 'product_analysis' END,
    CASE WHEN {any_word(WORDS['trend'].split('; '))} THEN 'sales_trend' END,
    CASE WHEN {any_word(WORDS['forecast'].split('; '))} THEN 'sales_forecast' END], lambda x: x IS NOT NULL) AS found FROM low),
tagged AS (SELECT * EXCLUDE (low, found),
    CASE WHEN {any_word(WORDS['shortcut'].split('; '))} THEN 'product_trend_analysis' ELSE 'insights' END AS route,
    CASE WHEN len(found) = 0 THEN 'general' ELSE array_to_string(found, ',') END AS targets,
    CASE WHEN NOT list_contains(found, 'customer_analysis') THEN NULL WHEN {any_word(['top', 'most', 'best'])} THEN 'top'
      WHEN {any_word(['repeat', 'return'])} THEN 'repeat' WHEN {any_word(['segment'])} THEN 'segment'
      ELSE 'overview' END AS customer_view,
    CASE WHEN NOT list_contains(found, 'product_analysis') THEN NULL WHEN {any_word(['bestseller', 'top'])} THEN 'top'
      WHEN {any_word(['category'])} THEN 'category' WHEN {any_word(['brand'])} THEN 'brand'
      ELSE 'overview' END AS product_view,
    CASE WHEN NOT list_contains(found, 'sales_trend') THEN NULL WHEN {any_word(['monthly'])} THEN 'monthly'
      WHEN {any_word(['quarter'])} THEN 'quarterly' WHEN {any_word(['day'])} THEN 'weekday'
      ELSE 'overview' END AS trend_view,
    CASE WHEN {any_word(WORDS['data'].split('; '))} THEN 1 ELSE 0 END AS is_data_question
  FROM hits)"""


def periods_sql(source: str) -> str:
    """Periods of ``source``; two negated matches stand for the look-aheads."""
    short = "'jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'"
    numeric, named = r"(\d{1,2})[./-](\d{4})", MONTH_RE + r"\s*(\d{4})"
    return f"""kinds AS (
  SELECT *, lower(prompt) AS low, regexp_matches(lower(prompt), '{numeric}') AS is_num,
    regexp_matches(lower(prompt), '{named}') AS is_name,
    NOT regexp_matches(lower(prompt), '{numeric}')
      AND NOT regexp_matches(lower(prompt), '(?s)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec).*\\d{{4}}')
      AND regexp_matches(lower(prompt), '\\b20\\d{{2}}\\b') AS is_year FROM {source}),
periods AS (
  SELECT * EXCLUDE (low, is_num, is_name, is_year),
    CASE WHEN is_year THEN 'year' WHEN is_num OR is_name THEN 'month' END AS period_kind,
    CAST(CASE WHEN is_year THEN regexp_extract(low, '(?s).*\\b(20\\d{{2}})\\b', 1)
      WHEN is_num THEN regexp_extract(low, '{numeric}', 2)
      WHEN is_name THEN regexp_extract(low, '{named}', 2) END AS INTEGER) AS period_year,
    CASE WHEN is_year THEN NULL WHEN is_num THEN CAST(regexp_extract(low, '{numeric}', 1) AS INTEGER)
      WHEN is_name THEN list_position([{short}], left(regexp_extract(low, '{named}', 1), 3)) END AS period_month
  FROM kinds)"""


@query("prompt_routes", with_tables(HDR, PROMPTS_SQL, tags_sql("prompts")) + "SELECT * FROM tagged")
def _(spark, sf_dir):
    return plain(pr.tag_prompts(prompts(spark, sf_dir)))


@query("prompt_routes_conversations", "WITH talk AS (SELECT conv_id, turn, text AS prompt FROM conversations),\n"
       + tags_sql("talk") + "SELECT * FROM tagged")
def _(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text AS prompt")
    return plain(pr.tag_prompts(talk))


@query("prompt_routes_documents", "WITH texts AS (SELECT doc_id, text AS prompt FROM documents),\n"
       + tags_sql("texts") + "SELECT * EXCLUDE (prompt) FROM tagged")
def _(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").selectExpr("doc_id", "text AS prompt")
    return plain(pr.tag_prompts(texts).drop("prompt"))


@query("prompt_periods", with_tables(HDR, PROMPTS_SQL, periods_sql("prompts")) + "SELECT * FROM periods")
def _(spark, sf_dir):
    return plain(pr.extract_periods(prompts(spark, sf_dir)))


@query("prompt_revenue", with_tables(HDR, PROMPTS_SQL, periods_sql("prompts"), REVENUE_SQL) + """
SELECT p.*, COALESCE(m.amt_local, y.amt) AS total_revenue,
  COALESCE(m.num_transactions, y.n) AS transaction_count, y.months AS month_count,
  CASE WHEN m.amt_local IS NULL THEN NULL WHEN b.amt_local > 0
    THEN (m.amt_local - b.amt_local) / b.amt_local * 100 ELSE 0 END AS growth_pct
FROM periods p
LEFT JOIN revenue m ON p.companyfn = m.companyfn AND p.period_year = m.year AND p.period_month = m.month
LEFT JOIN revenue b ON m.companyfn = b.companyfn AND b.year * 12 + b.month = m.year * 12 + m.month - 1
LEFT JOIN (SELECT companyfn, year, CAST(SUM(CAST(amt_local AS DECIMAL(28,4))) AS DOUBLE) AS amt,
    CAST(SUM(num_transactions) AS BIGINT) AS n, COUNT(*) AS months FROM revenue GROUP BY ALL) y
  ON p.period_kind = 'year' AND p.companyfn = y.companyfn AND p.period_year = y.year""")
def _(spark, sf_dir):
    return plain(pr.answer_revenue(prompts(spark, sf_dir), revenue(spark, sf_dir)))


STATISTICS_SQL = with_tables(HDR, PROMPTS_SQL, tags_sql("prompts")) + """
SELECT companyfn, target, COUNT(*) AS prompts, MAX(asked_at) AS last_asked
FROM (SELECT companyfn, asked_at, unnest(string_split(targets, ',')) AS target FROM tagged) GROUP BY ALL"""


@query("prompt_statistics", STATISTICS_SQL)
def _(spark, sf_dir):
    return plain(pr.prompt_statistics(pr.tag_prompts(prompts(spark, sf_dir))))


@query("logged_prompts", STATISTICS_SQL)
def _(spark, sf_dir):
    """The same statistics from the prompt log."""
    log = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    tagged = pr.tag_prompts(prompts(spark, sf_dir))
    pr.log_prompts(tagged, log)
    return plain(pr.prompt_statistics(spark.read.schema(tagged.schema).parquet(log)))
