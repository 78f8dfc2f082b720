from tidemark.functions.parsing import (  # noqa: F401
    hp_json, hp_standardise, list_first, parse_dict, parse_list)
from tidemark.functions.values import (  # noqa: F401
    date_coerce, finite, format_date, log_floor, model_name_case, numeric_coerce,
    percent_filled, recode, relative_error, safe_slug, target_date)
