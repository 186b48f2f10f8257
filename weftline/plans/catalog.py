"""All queries of the engine proper (the training-data subpackage has its own registry)."""

from __future__ import annotations

from weftline.plans import aggregates, definitions, exports, filters, graphs, joins, mainframe, matching, ordering, reports, rules, scalars, sequences, source_code, source_files, streams, taint, usage, windows
from weftline.plans.registry import Registry

registry = Registry().merge(usage.registry, filters.registry, joins.registry, aggregates.registry, windows.registry, ordering.registry, scalars.registry, graphs.registry, reports.registry, sequences.registry, rules.registry, streams.registry, exports.registry, matching.registry, source_code.registry, source_files.registry, definitions.registry, taint.registry, mainframe.registry)
