"""tablecare: table quality, cleaning and dashboard aggregates on Spark.

Every operator takes and returns a DataFrame; see README.md for the map of
operators.  The most used entry points are re-exported here.
"""

from .operators.analysis import Analysis, outlier_extremes
from .operators.clean import clean, drop_columns, drop_rows, unify_dates
from .operators.duplicates import duplicate_groups, duplicate_totals, extra_duplicates, keep
from .operators.profile import profile, reprofile
from .operators.rowid import with_row_id
from .operators.table import apply_filters, even_sample, hash_sample, head, page, search, sort_as_text, sort_by
from .plans.quality import column_health, preview, quality_report, quality_scores, recommendations, table_page
from .plans.recipe import Recipe, Step
from .sources.io import load_dataset, overview, read_csv, read_json, read_parquet, read_table, read_tsv, write_csv

__all__ = [
    "Analysis", "outlier_extremes", "clean", "drop_columns", "drop_rows", "unify_dates", "duplicate_groups",
    "duplicate_totals", "extra_duplicates", "keep", "profile", "reprofile", "with_row_id", "apply_filters",
    "even_sample", "hash_sample", "head", "page", "search", "sort_as_text", "sort_by", "column_health",
    "quality_report", "quality_scores", "recommendations", "preview", "table_page", "Recipe", "Step", "load_dataset", "overview",
    "read_csv", "read_json", "read_parquet", "read_table", "read_tsv", "write_csv",
]
