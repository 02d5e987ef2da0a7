"""Column expressions: everything here maps Columns to Columns and stays inside the JVM."""

from tidepanel.functions.normalize import alias_key, fold_marks, group_key, label_key, stripped
from tidepanel.functions.scalar import (
    as_int,
    cagr,
    clean_dash,
    contains_any,
    contains_text,
    dotnet_millis,
    dotnet_timestamp,
    equals_any,
    is_blank,
    pct_change,
    starts_with_text,
)

__all__ = [
    "alias_key", "as_int", "cagr", "clean_dash", "contains_any", "contains_text", "dotnet_millis",
    "dotnet_timestamp", "equals_any", "fold_marks", "group_key", "is_blank", "label_key",
    "pct_change", "starts_with_text", "stripped",
]
