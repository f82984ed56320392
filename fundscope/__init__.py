"""fundscope: cleaning and analysis of a crowdfunding project dataset on Spark.

Three input tables (``project_info``, ``pledge``, ``country``) are loaded,
checked, cleaned and analysed with DataFrame-to-DataFrame functions built
only from Spark's built-in expressions.

Layout
------
``sources``    readers (delimited files, country lookup, test-table adapter) and sinks
``functions``  column expressions (date parsing, state merge, exact rounding)
``operators``  integrity checks, cleaning, profiling, analysis, views
``plans``      shared plan pieces: size-checked lookup join, distributed row
               numbering, the load -> clean -> enrich workload and its store
``streaming``  incremental load of newly arriving delimited files
"""

__version__ = "0.1.0"

_EXPORTS = {
    "load_files": "fundscope.plans.workload",
    "materialize": "fundscope.plans.workload",
    "register_workload": "fundscope.plans.workload",
    "use_database": "fundscope.plans.workload",
    "driver_tables": "fundscope.plans.workload",
    "read_delimited": "fundscope.sources.delimited",
    "country_dim": "fundscope.sources.country",
    "write_extract": "fundscope.sources.extract",
    "lookup_join": "fundscope.plans.joins",
    "global_row_number": "fundscope.plans.joins",
}


def __getattr__(name):
    """Main entry points, imported on first use (``fundscope.load_files`` ...)."""
    if name in _EXPORTS:
        import importlib
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'fundscope' has no attribute {name!r}")
