"""Column -> Column functions built from Spark built-ins (no Python UDFs)."""

from platewise.functions.calendar import (  # noqa: F401
    business_days, date_label, day_theme, is_working_day, last_full_week, month_name,
    parse_date, previous_period, weather_mode, week_start, weekday_name,
)
from platewise.functions.formats import (  # noqa: F401
    blank_if_null, day_label, int_or_zero, one_decimal, parse_insights, pct_display,
    sign_class, signed_one_decimal, strip_code_fence, thousands, to_flag,
)
from platewise.functions.split import ceil_prediction, final_prediction, split_total  # noqa: F401
from platewise.functions.weather import (  # noqa: F401
    weather_category, weather_condition, weather_icon, weather_label,
)
