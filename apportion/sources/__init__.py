from apportion.sources.results import (
    append_experiments,
    read_csv,
    read_experiments,
    read_json,
    read_text,
    stored_experiments,
    write_csv,
    write_json,
    write_text,
)
from apportion.sources.tables import (
    cyclic_replay,
    event_samples,
    first_n,
    image_samples,
    mini_batches,
    read_table,
    table_path,
    to_event_samples,
    vector_samples,
)

__all__ = [
    "append_experiments",
    "cyclic_replay",
    "event_samples",
    "first_n",
    "image_samples",
    "mini_batches",
    "read_csv",
    "read_experiments",
    "read_json",
    "read_table",
    "read_text",
    "stored_experiments",
    "table_path",
    "to_event_samples",
    "vector_samples",
    "write_csv",
    "write_json",
    "write_text",
]
