"""Catalogue of analyses: name -> (function, parameters).

One place lists every analysis so the driver contract, the SQL surface, the
marts writer and the bench all agree on names.  Every analysis reads the whole
history; a window is the caller's choice (``Roles.restrict_orders``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from emporia.operators import customers, feedback, logistics, market, retention, robust, sales, sketches
from emporia.sources.order_mart import order_mart_months
from emporia.sources.roles import Roles


@dataclass(frozen=True)
class Analysis:
    fn: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)

    def run(self, t: Roles) -> DataFrame:
        return self.fn(t, **self.params)


ANALYSES: dict[str, Analysis] = {
    # customer behaviour
    "top_customers": Analysis(customers.top_customers),
    "top_customer_geo": Analysis(customers.top_customer_geo),
    "top_customer_categories": Analysis(customers.top_customer_categories),
    "top_customer_category_profile": Analysis(customers.top_customer_category_profile),
    "top_customer_payment_aov": Analysis(customers.top_customer_payment_aov),
    "user_growth": Analysis(customers.user_growth),
    "repeat_rate": Analysis(customers.repeat_rate),
    "repurchase_gaps": Analysis(customers.repurchase_gaps),
    "repurchase_gap_summary": Analysis(customers.repurchase_gap_summary),
    "repurchase_survival": Analysis(retention.repurchase_survival),
    "repurchase_survival_summary": Analysis(retention.repurchase_survival_summary),
    "cohort_retention": Analysis(retention.cohort_retention),
    "repurchase_gaps_sketched": Analysis(sketches.repurchase_gaps_sketched),
    "first_vs_repeat_categories": Analysis(customers.first_vs_repeat_categories),
    "repeat_vs_single_score": Analysis(customers.repeat_vs_single_score),
    "repeat_vs_single_rank": Analysis(robust.repeat_vs_single_rank),
    # sales and products
    "sales_growth": Analysis(sales.sales_growth),
    "sales_seasonality": Analysis(sales.sales_seasonality),
    "sales_decomposition": Analysis(sales.sales_decomposition),
    "top_categories_share": Analysis(sales.top_categories_share),
    "fastest_growing_categories": Analysis(sales.fastest_growing_categories),
    "hot_slow_products": Analysis(sales.hot_slow_products),
    "hot_slow_bad_review_rate": Analysis(sales.hot_slow_bad_review_rate),
    "hot_slow_bad_review_clustered": Analysis(robust.hot_slow_bad_review_clustered),
    # logistics
    "top_freight_orders": Analysis(logistics.top_freight_orders),
    "freight_order_profile": Analysis(logistics.freight_order_profile),
    "freight_drivers": Analysis(logistics.freight_drivers),
    "late_vs_ontime_score": Analysis(logistics.late_vs_ontime_score),
    "late_vs_ontime_rank": Analysis(robust.late_vs_ontime_rank),
    "late_orders_by_city": Analysis(logistics.late_orders_by_city),
    # market and geography
    "city_penetration": Analysis(market.city_penetration),
    "low_penetration_high_potential": Analysis(market.low_penetration_high_potential),
    "cross_state_order_share": Analysis(market.cross_state_order_share),
    "cross_state_freight": Analysis(market.cross_state_freight),
    "cross_state_freight_clustered": Analysis(robust.cross_state_freight_clustered),
    "city_buyers_sketched": Analysis(sketches.city_buyers_sketched),
    # payments and reviews
    "completion_rate_by_payment": Analysis(feedback.completion_rate_by_payment),
    "completion_payment_chi2": Analysis(feedback.completion_payment_chi2),
    "completion_payment_rao_scott": Analysis(feedback.completion_payment_rao_scott),
    "avg_order_amount_by_payment": Analysis(feedback.avg_order_amount_by_payment),
    "installment_avg_payment": Analysis(feedback.installment_avg_payment),
    "seller_bad_review_concentration": Analysis(feedback.seller_bad_review_concentration),
    "seller_bad_review_summary": Analysis(feedback.seller_bad_review_summary),
    "seller_bad_review_dispersion": Analysis(feedback.seller_bad_review_dispersion),
    "seller_bad_review_flags": Analysis(feedback.seller_bad_review_flags),
    # the order-grain mart
    "order_mart_months": Analysis(order_mart_months),
}
