"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the behaviour being
reproduced (theme calendar, split ratios, weather-code bands, import header
aliases, display labels). They are stated plainly, in natural order, and are
turned into Spark literals / small broadcast dimensions by the code that uses
them.
"""

from __future__ import annotations

# --- fixed values: weekday -> menu theme --------------------------------------
WEEKDAY_THEMES = {
    "Monday": "Sausage",
    "Tuesday": "Vital",
    "Wednesday": "Chicken",
    "Thursday": "Schnitzel",
    "Friday": "Fish",
}

# --- fixed values: theme -> (veg ratio, non-veg ratio), fallback ratio ---------
THEME_RATIOS = {
    "Sausage": (0.50, 0.50),
    "Vital": (0.43, 0.57),
    "Chicken": (0.43, 0.57),
    "Schnitzel": (0.37, 0.63),
    "Fish": (0.50, 0.50),
}
DEFAULT_RATIO = (0.5, 0.5)

# --- fixed values: weather code bands (inclusive) -> (icon, condition) --------
# First matching band wins; any other code is "Cloudy" with the overcast icon.
WEATHER_BANDS = [
    (0, 0, "☀️", "Sunny"),
    (1, 3, "⛅", "Cloudy"),
    (51, 67, "🌧️", "Rainy"),
    (80, 84, "🌧️", "Rainy"),
    (71, 77, "❄️", "Snowy"),
    (85, 86, "❄️", "Snowy"),
    (95, 99, "⛈️", "Stormy"),
]
WEATHER_DEFAULT = ("☁️", "Cloudy")

# --- fixed values: accepted import headers (any case) per internal column -----
IMPORT_ALIASES = {
    "date": ["date", "datum"],
    "actual_meals": ["actual_meals", "total", "gesamt"],
    "actual_meals_veg": ["actual_meals_veg", "veg", "vegetarisch"],
    "actual_meals_non_veg": ["actual_meals_non_veg", "non-veg"],
    "actual_meals_salad": ["salad", "salat"],
}

# --- fixed values: German calendar names (Spark's date_format has no locale) --
GERMAN_WEEKDAYS = {
    "Monday": "Montag", "Tuesday": "Dienstag", "Wednesday": "Mittwoch",
    "Thursday": "Donnerstag", "Friday": "Freitag", "Saturday": "Samstag",
    "Sunday": "Sonntag",
}
GERMAN_WEEKDAYS_SHORT = {
    "Monday": "Mo.", "Tuesday": "Di.", "Wednesday": "Mi.", "Thursday": "Do.",
    "Friday": "Fr.", "Saturday": "Sa.", "Sunday": "So.",
}
GERMAN_MONTHS_SHORT = {
    "January": "Jan.", "February": "Feb.", "March": "März", "April": "Apr.",
    "May": "Mai", "June": "Juni", "July": "Juli", "August": "Aug.",
    "September": "Sept.", "October": "Okt.", "November": "Nov.", "December": "Dez.",
}
GERMAN_MONTHS = {
    "January": "Januar", "February": "Februar", "March": "März",
    "April": "April", "May": "Mai", "June": "Juni", "July": "Juli",
    "August": "August", "September": "September", "October": "Oktober",
    "November": "November", "December": "Dezember",
}

# --- fixed values: display labels, lang -> section -> key -> label ------------
# "common" is the shared layer; "predictions" is a page layer that overrides it.
LABELS = {
    "common": {
        "EN": {
            "weather_condition": {
                "clear": "Clear", "cloudy": "Cloudy", "rainy": "Rainy",
                "snowy": "Snowy", "stormy": "Stormy",
            },
            "day_themes": {
                "Sausage": "Sausage", "Vital": "Vital", "Chicken": "Chicken",
                "Schnitzel": "Schnitzel", "Fish": "Fish",
            },
            "holiday_descriptions": {
                "Summer Break": "Summer Break",
                "Summer Break Start": "Summer Break Start",
                "Summer Break End": "Summer Break End",
                "Autumn Break": "Autumn Break",
                "Autumn Break Start": "Autumn Break Start",
                "Autumn Break End": "Autumn Break End",
                "Christmas Break": "Christmas Break",
                "Christmas Break Start": "Christmas Break Start",
                "Christmas Break End": "Christmas Break End",
                "Easter Break": "Easter Break",
                "Easter Break Start": "Easter Break Start",
                "Easter Break End": "Easter Break End",
                "Bridge Day (Heilige 3 K)": "Bridge Day (Epiphany)",
                "Bridge Day (after Ascension)": "Bridge Day (after Ascension)",
                "Bridge Day (after Corpus Christi)": "Bridge Day (after Corpus Christi)",
            },
            "display_columns": {
                "date": "Date", "day_theme": "Theme", "final_prediction": "Total Meals",
                "predicted_meals_veg": "🥦", "predicted_meals_non_veg": "🍗",
                "temperature_max": "Temp (°C)", "weather_condition": "Weather",
                "holiday_desc": "Holiday", "is_school_break": "School Break",
                "is_bridge_day": "Bridge Day", "prediction_timestamp": "Last Updated",
            },
            "generic": {"is_school_break": "School Break", "bridge_day": "Bridge Day"},
        },
        "DE": {
            "weather_condition": {
                "clear": "klar", "cloudy": "bewölkt", "rainy": "Regen",
                "snowy": "Schneefall", "stormy": "Sturm",
            },
            "day_themes": {
                "Sausage": "Wurst", "Vital": "Vital", "Chicken": "Hühnchen",
                "Schnitzel": "Schnitzel", "Fish": "Fisch",
            },
            "holiday_descriptions": {
                "Summer Break": "Sommerferien",
                "Summer Break Start": "Sommerferien Beginn",
                "Summer Break End": "Sommerferien Ende",
                "Autumn Break": "Herbstferien",
                "Autumn Break Start": "Herbstferien Beginn",
                "Autumn Break End": "Herbstferien Ende",
                "Christmas Break": "Weihnachtsferien",
                "Christmas Break Start": "Weihnachtsferien Beginn",
                "Christmas Break End": "Weihnachtsferien Ende",
                "Easter Break": "Osterferien",
                "Easter Break Start": "Osterferien Beginn",
                "Easter Break End": "Osterferien Ende",
                "Bridge Day (Heilige 3 K)": "Brückentag (Heilige Drei Könige)",
                "Bridge Day (after Ascension)": "Brückentag (nach Christi Himmelfahrt)",
                "Bridge Day (after Corpus Christi)": "Brückentag (nach Fronleichnam)",
            },
            "display_columns": {
                "date": "Datum", "day_theme": "Thema", "final_prediction": "Gesamt",
                "predicted_meals_veg": "🥦", "predicted_meals_non_veg": "🍗",
                "temperature_max": "Temp (°C)", "weather_condition": "Wetter",
                "holiday_desc": "Feiertag", "is_school_break": "Schulferien",
                "is_bridge_day": "Brückentag", "prediction_timestamp": "Letzte Aktualisierung",
            },
            "generic": {"is_school_break": "Schulferien", "bridge_day": "Brückentag"},
        },
    },
    "predictions": {
        "EN": {
            "display_columns": {
                "date": "Date", "day_theme": "Theme", "final_prediction": "Total",
                "predicted_meals_veg": "Veg", "predicted_meals_non_veg": "Meat",
                "predicted_meals_salad": "Salad", "temperature_max": "Temp (°C)",
                "weather_condition": "Weather", "holiday_desc": "Holiday",
                "is_school_break": "School Break", "is_bridge_day": "Bridge Day",
                "prediction_timestamp": "Last Updated",
            },
        },
        "DE": {
            "display_columns": {
                "date": "Datum", "day_theme": "Thema", "final_prediction": "Gesamt",
                "predicted_meals_veg": "Veg.", "predicted_meals_non_veg": "Fleisch",
                "predicted_meals_salad": "Salat", "temperature_max": "Temp (°C)",
                "weather_condition": "Wetter", "holiday_desc": "Feiertag",
                "is_school_break": "Schulferien", "is_bridge_day": "Brückentag",
                "prediction_timestamp": "Letzte Aktualisierung",
            },
        },
    },
}

# Layer precedence for label overlays: later (higher) wins.
LABEL_LAYERS = {"common": 0, "predictions": 1}

# --- fixed values: the planning-table download ---------------------------------
# Its columns, in display order, and the columns it
# leaves out.
REPORT_DROP = [
    "weekday", "month", "is_bridge_day", "weather_condition", "temperature_max",
    "override_meal_prediction", "override_reason", "is_bank_holiday",
    "is_school_break", "holiday_desc", "predicted_meals", "prediction_timestamp",
]
