from propspark.sources.tables import (  # noqa: F401
    is_empty,
    nan_to_null,
    read_table,
    require_columns,
    spread_scan,
    write_artifacts,
    write_buckets,
    write_lookup,
    write_split,
    write_table,
)
