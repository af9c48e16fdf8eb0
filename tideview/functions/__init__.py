from tideview.functions.expressions import (
    all_of,
    any_of,
    null_safe_on,
    null_when,
    row_of,
    rows_differ,
    typed_null,
)

__all__ = [
    "all_of",
    "any_of",
    "null_safe_on",
    "null_when",
    "row_of",
    "rows_differ",
    "typed_null",
]
