"""DataFrame -> DataFrame operators.

rollup    AIM-1 daily demand from order lines (skew-safe pre-aggregation)
features  calendar, weather and holiday features (PRJ-2, JON-1/2, FLT-3/4/6, ML-7)
split     theme ratios, veg / non-veg split, overrides (AGG-5, JON-5, PRJ-3, PRJ-11)
compare   actual vs predicted, metrics, KPIs, periods (JON-3/4/8, AGG-1...11)
upsert    keyed writes as plans (WIN-4, SNK-1/2/3/5/11)
validate  import and manual-entry validation (VAL-1...6, WIN-2, PRJ-12, JON-7)
labels    label dictionaries as a dimension (SRC-8, JON-6)
insights  rule-based insights, chart data, health (AIM-3...6)
ml        MLlib training, evaluation, scoring (ML-1...7, WIN-1, AGG-12...15)
"""
