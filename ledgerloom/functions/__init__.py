"""Column expressions: IDs, amounts, records, bank names and text formats."""

from .banks import BANK_PATTERNS, bank_of
from .ids import (
    clean_header,
    display_id,
    expand_id,
    is_null_token,
    is_scientific_id,
    lower_header,
    normal_id,
    precision_lost,
    strip,
)
from .money import (
    Money,
    amount_or_zero,
    legacy_amount,
    number_text,
    parse_amount,
    parse_number,
    percent_text,
    strict_amount,
    timestamp_text,
)
from .records import record_json, record_map, records_to_columns

__all__ = [
    "BANK_PATTERNS",
    "Money",
    "amount_or_zero",
    "bank_of",
    "clean_header",
    "display_id",
    "expand_id",
    "is_null_token",
    "is_scientific_id",
    "legacy_amount",
    "lower_header",
    "normal_id",
    "number_text",
    "parse_amount",
    "parse_number",
    "percent_text",
    "precision_lost",
    "record_json",
    "record_map",
    "records_to_columns",
    "strict_amount",
    "strip",
    "timestamp_text",
]
