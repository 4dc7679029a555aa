"""Composite jobs (C1-C5): the reference's four entry points as Spark jobs.

* ``cleaning_job``        – C1: raw lines -> cleaned table (+ JSON report).
* ``analysis_report``     – C2: monthly trends, RFM, products, categories,
  seasons/weekdays/hours, countries and the executive KPIs.
* ``business_report``     – C3: cohort retention, basket pairs, CLV, forecast.
* ``segmented_lines``     – C5: dashboard load step (RFM dedup scores, rule
  segments joined back to every line).
* ``dashboard_view``      – C4: filtered panels and KPI deltas.

Each returns lazy DataFrames over one input; ``cleaning_job`` and
``segmented_lines`` write their table (the boundary later jobs read).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tillroll.operators import basket, binning, clv, cohort, dimensions as dims, forecast, profile, rfm, view
from tillroll.operators.cleaning import clean_sales
from tillroll.operators.cube import SalesCube, panels
from tillroll.plans.materialize import cut
from tillroll.sources.retail import write_cleaned
from tillroll.sources.schemas import CLEANED_COLUMNS


def cleaning_job(raw: DataFrame, out_path: str, report_path: str | None = None,
                 partition_by: Sequence[str] = ("Year", "Month")) -> DataFrame:
    """Clean ``raw`` and write the cleaned table (partitioned by month so
    later date filters prune files); optionally write the one-row quality
    report as JSON.  Returns a scan of the written table."""
    spark = raw.sparkSession
    raw = cut(raw, "raw-lines")  # a text file would be parsed by every pass
    write_cleaned(clean_sales(raw).select(*CLEANED_COLUMNS, *[c for c in raw.columns if c not in CLEANED_COLUMNS]),
                  out_path, tuple(partition_by))
    cleaned = spark.read.parquet(out_path)
    if report_path:
        profile.write_report_json(profile.cleaning_report(raw, cleaned.select(*CLEANED_COLUMNS)), report_path)
    return cleaned


def analysis_report(cleaned: DataFrame) -> dict[str, DataFrame]:
    """The analysis report's tables."""
    # one row per customer, read by every score and table below: written once
    scored = cut(rfm.rfm_scores_quintile(cut(rfm.rfm_metrics(cleaned), "rfm")), "rfm-scores")
    return {
        "monthly_trends": dims.monthly_sales(cleaned),
        "monthly_insights": dims.monthly_insights(cleaned),
        "rfm_analysis": scored,
        "rfm_segment_profile": rfm.rfm_segment_profile(scored),
        "recency_histogram": binning.equal_width_histogram(scored, "Recency", 50),
        "product_metrics": dims.product_metrics(cleaned),
        "category_performance": dims.category_performance(cleaned),
        "product_insights": dims.product_insights(cleaned),
        "seasonal_data": dims.season_sales(cleaned),
        "dow_data": dims.dow_sales(cleaned),
        "hourly_data": dims.hourly_sales(cleaned),
        "period_data": dims.period_sales(cleaned),
        "temporal_peaks": dims.temporal_peaks(cleaned),
        "country_metrics": dims.country_metrics(cleaned),
        "geographic_insights": dims.home_market_share(cleaned),
        "executive_summary": view.kpis(cleaned),
    }


def business_report(cleaned: DataFrame, basket_item: str = "Description") -> dict[str, DataFrame]:
    """The business-intelligence report's tables."""
    ret = cohort.cohort_retention(cleaned)
    clv_df = cut(clv.clv(cleaned), "clv")
    return {
        "cohort_analysis": ret,
        "cohort_avg_retention": cohort.cohort_avg_retention(cleaned),
        "market_basket": basket.basket_pairs(cleaned, basket_item),
        "clv_analysis": clv_df,
        "clv_insights": clv.clv_insights(clv_df),
        "sales_forecast": forecast.forecast(cleaned),
        "trend_fit": forecast.sales_trend_fit(cleaned),
    }


def segmented_lines(cleaned: DataFrame, out_path: str | None = None) -> DataFrame:
    """Lines with RFM_Segment / Customer_Segment.  With ``out_path`` the
    table is written once and scanned (the dashboard caches it)."""
    seg = rfm.attach_segments(cleaned)
    if out_path is None:
        return seg
    seg.write.mode("overwrite").parquet(out_path)
    return cleaned.sparkSession.read.parquet(out_path)


def dashboard_view(segmented: DataFrame, date_from=None, date_to=None, countries: Sequence[str] = (),
                   categories: Sequence[str] = (), segment: str = "All",
                   basket_item: str = "Description", cube: SalesCube | None = None) -> dict[str, DataFrame]:
    """C4: every dashboard panel for one filter selection.  With ``cube``
    (``write_cube(segmented)``, once for all selections) sums and distinct counts
    come from its cells; only panels that need lines scan them."""
    pred = view.sales_predicate(date_from, date_to, countries, categories, segment, segmented.columns)
    f = segmented.where(pred)
    if cube is not None:
        lines = {
            "cohort_retention": cohort.cohort_retention(f),
            "top_products": dims.top_products_by_description(f, 15, 40),
            "association_rules": basket.association_rules(basket.frequent_itemsets(f, basket_item, 0.01), "lift", 0.5).limit(20),
            "sample_rows": view.sample_rows(f, 100),
        }
        return {**panels(cube, pred), **lines}
    rules = basket.association_rules(basket.frequent_itemsets(f, basket_item, 0.01), "lift", 0.5)
    return {
        "filter_domains": view.filter_domains(segmented),
        "kpis": view.kpis(f),
        "kpi_deltas": view.kpi_deltas(segmented, pred),
        "daily_revenue": dims.daily_revenue(f),
        "top_countries": dims.top_countries(f, 10),
        "segment_distribution": rfm.segment_distribution(f),
        "cohort_retention": cohort.cohort_retention(f),
        "top_products": dims.top_products_by_description(f, 15, 40),
        "category_revenue": dims.category_revenue(f),
        "association_rules": rules.limit(20),
        "season_summary": dims.season_summary(f),
        "hourly_sales": dims.hourly_sales(f),
        "country_summary": dims.country_summary(f),
        "home_market_share": dims.home_market_share(f),
        "temporal_peaks": dims.temporal_peaks(f),
        "kpi_summary_report": view.kpi_summary_report(f),
        "sample_rows": view.sample_rows(f, 100),
    }
