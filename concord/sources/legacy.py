"""The curated listing of former times, taken into a store as a run of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from concord.operators.observe import observations
from concord.operators.store import Store
from concord.session import checkpoint
from concord.sources.html import curated_rows

LEGACY_RUN = "legacy_"


def import_curated(store: Store, pages: DataFrame, stamp: str, started_at: str, id_col: str = "page_id", html_col: str = "html") -> dict[str, int | str]:
    """Rows of curated pages, normalised like any other, merged into the store under the run `legacy_<stamp>`, which is recorded.

    Returns run_id, rows_parsed, and the merge's counts. Importing the same pages again, under any stamp, adds nothing.
    """
    rows = checkpoint(curated_rows(pages, id_col, html_col))
    run_id = LEGACY_RUN + stamp
    counts = store.upsert(observations(rows.drop("venue_class", "ord", id_col)), run_id)
    store.record(run_id, started_at, sum(counts.values()))
    return {"run_id": run_id, "rows_parsed": rows.count()} | counts
