"""What several tests share: reading physical plans, and tables that are built once."""

import re

from courtline.sources import tables
from courtline.storage import kept_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", text)


def stored_cells(spark, folder):
    """The scraped cells as a table: comparing two plans that both build them takes the optimizer minutes."""
    return kept_table(spark, folder, "cells", lambda: tables.box_cells(spark, folder))
