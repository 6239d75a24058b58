"""Comparison of two versions of a record dataset, as Spark jobs."""

from .columns import Columns
from .operators.browse import (
    browse, browse_counts, record_filter, record_payloads, record_summaries, record_summary,
)
from .operators.checks import DatasetCheckError, check_counts, validate
from .operators.collate import (
    collate, join_versions, keep_present, latest_state, row_key, union_versions,
)
from .operators.diff import (
    change_table, diff_records, flat_changed_fields, key_differences, record_changes,
)
from .operators.isolation import Isolated
from .operators.manifest import (
    extracted_files, input_manifest, parse_filenames, requested_sources, since_last_full,
)
from .operators.matrix import (
    changed_fields, distinct_sources, field_cells, field_matrix, field_names, name_list,
    record_flags,
)
from .operators.metrics import (
    count_cells, field_counts, global_counts, metrics_document, metrics_rows, source_counts,
    source_field_counts,
)
from .operators.ranks import jump, write_rank_index
from .operators.records import final_records, join_matrix
from .operators.search_index import narrowed, read_search_index, write_search_index
from .operators.versions import (
    VersionFailed, VersionRun, read_failures, read_labelled_versions, run_versions,
    write_versions,
)
from .plans.run_diff import RunResult, compare_transforms, load_run, run_diff
from .sources.datasets import (
    dataset_files, query_matrix, read_dataset, read_version, register_records, write_bucketed,
    write_dataset,
)
from .sources.manifests import list_files, listed_files, read_manifest, write_manifest
from .sources.runs import (
    publish_run, published_runs, read_history, read_run_documents, read_run_inputs, save_run,
)
