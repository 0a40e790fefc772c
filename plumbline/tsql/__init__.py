"""From T-SQL scripts to column lineage: a thin front end before Catalyst, and a walk over the plans it resolves."""
