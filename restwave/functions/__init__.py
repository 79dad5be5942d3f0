from restwave.functions.columns import (
    clock_hours,
    corrected_weight,
    end_of_day,
    epoch_ms_to_utc,
    grams_to_pounds,
    month_of,
    nan_to_null,
    one_rep_max,
    seconds_to_hours,
    text_to_utc,
    zero_to_null,
)
from restwave.functions.names import parse_smooth_name, smooth_name

__all__ = [
    "clock_hours",
    "corrected_weight",
    "end_of_day",
    "epoch_ms_to_utc",
    "grams_to_pounds",
    "month_of",
    "nan_to_null",
    "one_rep_max",
    "parse_smooth_name",
    "seconds_to_hours",
    "smooth_name",
    "text_to_utc",
    "zero_to_null",
]
