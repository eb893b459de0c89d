"""Scalar Column expressions (all JVM-side built-ins, no Python UDFs)."""

from upkeep.functions.status import (  # noqa: F401
    as_of_date, is_blank, not_blank, has_status, lacks_status, lower_or_empty,
    trimmed_or_empty, preview, days_between, month_label, month_floor,
)
from upkeep.functions.buckets import aging_bucket, AGING_BUCKETS  # noqa: F401
from upkeep.functions.cleaners import (  # noqa: F401
    clean_string, clean_date, clean_number, long_text_flag,
)
from upkeep.functions.display import display_format  # noqa: F401
