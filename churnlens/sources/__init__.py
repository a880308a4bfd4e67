from churnlens.sources.tables import read_table  # noqa: F401
from churnlens.sources.fixtures import churn_base, churn_raw, branches  # noqa: F401
from churnlens.sources.io import (  # noqa: F401
    scan_csv, write_csv, save_model, load_model, describe_schema, tag_and_append, RAW_SCHEMA)
