"""Plan shapes shared by the operators: ways to lay out a query so that it survives hot groups."""

from tidepanel.plans.asof import as_of_join
from tidepanel.plans.median import ROWS, count_table, grouped_order_statistics, table_medians
from tidepanel.plans.ranks import with_rank
from tidepanel.plans.spread import spread
from tidepanel.plans.substring import GramIndex, gram_counts, posting_lists, substring_pairs
from tidepanel.plans.topk import top_per_group

__all__ = [
    "ROWS", "GramIndex", "as_of_join", "count_table", "gram_counts", "grouped_order_statistics", "posting_lists",
    "spread", "substring_pairs", "table_medians", "top_per_group", "with_rank",
]
