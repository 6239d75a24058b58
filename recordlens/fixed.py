"""Fixed values that decide results. They are formats, not tuning knobs."""

# --- fixed values: file name and path patterns -------------------------------
# (?U) makes \w and \d match Unicode letters and digits.
EXTRACT_FILENAME_PATTERN = (
    r"(?U)^([\w\-]+?)-(\d{4}-\d{2}-\d{2})-(\w+)-(\w+)-records-to-(.+?)(?:_(\d+))?\.(\w+)$"
)
EXTRACT_FILENAME_PARTS = [
    "source", "run_date", "run_type", "stage", "action", "index", "file_type",
]
EXTRACT_DATE_PATTERN = r"(?U).+?(\d{4}-\d{2}-\d{2})"
VERSION_PATH_PATTERN = r".*transformed\/(.*)\/.*"
FULL_MARK = "-full-"
DAILY_MARK = "-daily-"
EXTRACTED_MARK = "extracted"

# --- fixed values: date and time formats -------------------------------------
DATE_FORMAT = "yyyy-MM-dd"
RUN_TIMESTAMP_FORMAT = "yyyy-MM-dd_HH-mm-ss"

# --- fixed values: sources used when a manifest request names none -----------
DEFAULT_SOURCES = [
    "alma", "aspace", "dspace", "gismit", "gisogm", "libguides", "researchdatabases",
]

# --- fixed values: action that suppresses a record ---------------------------
DELETE_ACTION = "delete"

# --- fixed values: categories of the change document, by change kind ---------
CHANGE_CATEGORIES = {
    "changed": "values_changed",
    "type_changed": "type_changes",
    "added": "dictionary_item_added",
    "removed": "dictionary_item_removed",
    "item_added": "iterable_item_added",
    "item_removed": "iterable_item_removed",
    "repetition_changed": "repetition_change",
}

# --- fixed values: messages of the dataset checks ----------------------------
EMPTY_DATASET_MESSAGE = "The collated dataset does not contain any records."
EMPTY_RECORDS_MESSAGE = (
    "At least one or both record column(s) ['{record_a}', '{record_b}'] "
    "in the collated dataset are empty."
)
DUPLICATE_IDS_MESSAGE = "The collated dataset contains duplicate '{id}' records."

# --- fixed values: messages about names and records -----------------------------
INVALID_FILENAME = "Provided S3 URI and filename is invalid: "
INVALID_VERSION_PATH = "Transformed filepath is invalid: "
UNKNOWN_RECORD = "Could not find record in diff matrix for {id}: {value}"

# --- fixed values: message of a failed version --------------------------------
VERSION_FAILED = "Version {} failed to complete successfully on record {}"
PARTS_FAILED = "{} / {} parts failed to complete successfully."
