"""Sources and sinks: typed file ingest, test-data adapters, view publishing."""

from ledgerlens.sources.tables import (
    TABLE_NAMES,
    Tables,
    canonical_case,
    enforce_types,
    fold_time,
    ingest,
    load_table,
    load_tables,
    namespace_path,
    use_database,
    write_tables,
)

__all__ = ["TABLE_NAMES", "Tables", "canonical_case", "enforce_types", "fold_time", "ingest", "load_table",
           "load_tables", "namespace_path", "use_database", "write_tables"]
