"""Incremental maintenance of join views on Spark."""

from tideview.plans.maintain import (
    Change,
    maintain,
    maintain_delete,
    maintain_insert,
    maintain_update,
    matched_orphans,
    new_orphans,
    primary_delta,
    smaller_keys,
    tables_after,
)
from tideview.plans.spec import Join, Table, UnsupportedView, View, ViewSpec, bind, full, inner, left, right
from tideview.plans.sqlview import view_from_sql
from tideview.plans.view import build_view, frames_of, visible, working_rows
from tideview.plans.workspace import Workspace
from tideview.sources.changes import BadChange
from tideview.sources.snapshots import SnapshotStore
from tideview.sources.storage import Staging

__all__ = [
    "BadChange",
    "Change",
    "Join",
    "SnapshotStore",
    "Staging",
    "Table",
    "UnsupportedView",
    "View",
    "ViewSpec",
    "Workspace",
    "bind",
    "build_view",
    "frames_of",
    "full",
    "inner",
    "left",
    "maintain",
    "maintain_delete",
    "maintain_insert",
    "maintain_update",
    "matched_orphans",
    "new_orphans",
    "primary_delta",
    "right",
    "smaller_keys",
    "tables_after",
    "view_from_sql",
    "visible",
    "working_rows",
]
