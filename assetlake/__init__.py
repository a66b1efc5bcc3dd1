"""Asset-corpus analytics on Spark DataFrames.

Containers hold assets; bindings say which owner, material and property use which asset.
Every public function takes and returns DataFrames (or Columns) and never runs an action,
except the sinks, the streaming helpers and ``session.cut_lineage``.
"""
