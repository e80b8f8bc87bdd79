"""The list of tools."""

from __future__ import annotations

from .. import tools
from ..registry import query


@query(
    "tool_annotations",
    """SELECT name, name NOT IN ('project.scan', 'project.watch_start', 'project.watch_stop', 'project.snapshot', 'artifact.put', 'artifact.pin', 'artifact.delete', 'artifact.gc', 'context.create', 'context.expand', 'patch.propose',
        'patch.validate', 'patch.apply') AS read_only, name IN ('artifact.delete', 'artifact.gc', 'patch.apply') AS destructive
      FROM (SELECT unnest(['project.scan', 'project.map', 'file.contracts', 'symbol.source', 'symbol.context', 'project.watch_start', 'project.watch_stop', 'project.watch_status', 'project.snapshot', 'artifact.put', 'artifact.get',
        'artifact.get_chunk', 'artifact.copy_text', 'artifact.pin', 'artifact.delete', 'artifact.list', 'artifact.stats', 'artifact.gc', 'project.changed_symbols', 'context.create', 'context.expand', 'context.inspect', 'patch.propose',
        'patch.validate', 'patch.apply']) AS name)""",
)
def tool_annotations(spark, sf_dir):
    return tools.listed(spark).select("name", "read_only", "destructive")
