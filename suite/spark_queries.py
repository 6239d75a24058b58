"""One Spark query per operator, over the whole test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import recordlens as rl
from recordlens.functions.filenames import run_time, version_label
from recordlens.session import scratch_dir

from . import versions as v

MANIFEST_SOURCES = ["view", "purchase", "click", "signup", "unknown"]


def text(name: str):
    return F.col(name).cast("string").alias(name)


def joined(column: str, alias: str | None = None):
    return F.array_join(column, ",").alias(alias or column)


# --- collation -----------------------------------------------------------------

def collated_orders(spark, sf_dir) -> DataFrame:
    return rl.collate(*v.order_versions(spark, sf_dir))


def order_diffs(spark, sf_dir) -> DataFrame:
    return rl.diff_records(collated_orders(spark, sf_dir), keep_missing_flag=True)


def collated_documents(spark, sf_dir) -> DataFrame:
    return rl.collate(*v.document_versions(spark, sf_dir))


def document_diffs(spark, sf_dir) -> DataFrame:
    return rl.diff_records(collated_documents(spark, sf_dir), keep_missing_flag=True)


def collated_events(spark, sf_dir) -> DataFrame:
    return rl.collate(*v.event_versions(spark, sf_dir), tie_break=[F.col("event_id").asc()])


def collate_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.join_versions(*v.order_versions(spark, sf_dir)).select(
        "record_id", "source", text("run_date"), "run_type", "action",
        text("record_a"), text("record_b"))


def latest_state(spark, sf_dir):
    events = v.event_rows(v.table(spark, sf_dir, "events"))
    return rl.latest_state(events, tie_break=[F.col("event_id").asc()]).select(
        "record_id", "source", text("run_date"), "run_type", "action", "event_id")


def latest_collated(spark, sf_dir):
    def event(side):
        return F.get_json_object(F.col(side).cast("string"), "$.event")
    return collated_events(spark, sf_dir).select(
        "record_id", "source", text("run_date"), "run_type", "action",
        event("record_a").alias("event_a"), event("record_b").alias("event_b"))


def row_key(spark, sf_dir):
    return collated_orders(spark, sf_dir).select("record_id", "row_key")


def checks(spark, sf_dir):
    events = v.event_rows(v.table(spark, sf_dir, "events"))
    repeated = rl.join_versions(
        rl.latest_state(events, tie_break=[F.col("event_id").asc()], drop_deleted=False),
        events)
    return (
        rl.check_counts(collated_orders(spark, sf_dir)).withColumn("dataset", F.lit("orders"))
        .unionByName(rl.check_counts(repeated).withColumn("dataset", F.lit("events"))))


# --- structural diff -------------------------------------------------------------

def diff_status(spark, sf_dir):
    changed = rl.record_changes(collated_orders(spark, sf_dir))
    return changed.select("record_id", "source", "has_diff", "a_or_b_missing")


def modified_fields(spark, sf_dir):
    return order_diffs(spark, sf_dir).select("record_id", "has_diff", joined("modified_fields"))


def modified_fields_typed(spark, sf_dir):
    sides = rl.join_versions(*v.typed_order_versions(spark, sf_dir))
    return rl.keep_present(sides).select("record_id", F.coalesce(F.array_join(
        rl.flat_changed_fields("record_a", "record_b", v.ORDER_FIELDS), ","), F.lit(""))
        .alias("modified_fields"))


def ordered_vs_unordered(spark, sf_dir):
    pairs = collated_documents(spark, sf_dir)
    unordered = rl.record_changes(pairs).select(
        "record_id", "record_a", "record_b", F.col("modified_fields").alias("unordered"))
    return rl.record_changes(unordered, ignore_order=False).select(
        "record_id", joined("unordered", "fields_unordered"),
        joined("modified_fields", "fields_ordered"))


def change_table(spark, sf_dir):
    changes = rl.change_table(rl.record_changes(collated_orders(spark, sf_dir)))
    return changes.select("record_id", "source", "field", "path", "kind", "old", "new")


def change_table_nested(spark, sf_dir):
    changes = rl.change_table(rl.record_changes(collated_events(spark, sf_dir)))
    return changes.select("record_id", "field", "path", "kind", "old", "new")


def change_table_repetition(spark, sf_dir):
    changes = rl.change_table(rl.record_changes(collated_documents(spark, sf_dir)))
    return changes.select(
        "record_id", "field", "path", "kind",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("old_repeat", "new_repeat")])


def change_table_items(spark, sf_dir):
    """Edited items of arrays with their own changes, the others as removed."""
    changes = rl.change_table(rl.record_changes(
        rl.collate(*v.item_versions(spark, sf_dir)), pair_limit=0.5))
    return changes.select("record_id", "field", "path", "kind", "old", "new")


def change_document(spark, sf_dir):
    return order_diffs(spark, sf_dir).select("record_id", "ab_diff")


def keys_only_one_side(spark, sf_dir):
    return rl.key_differences(collated_orders(spark, sf_dir)).select(
        "record_id", joined("fields_only_in_a"), joined("fields_only_in_b"))


# --- matrix and counts -------------------------------------------------------------

def record_flags(spark, sf_dir):
    return rl.record_flags(order_diffs(spark, sf_dir))


def field_long(spark, sf_dir):
    return rl.field_cells(order_diffs(spark, sf_dir))


def changed_fields(spark, sf_dir):
    return rl.changed_fields(order_diffs(spark, sf_dir))


def distinct_sources(spark, sf_dir):
    return rl.distinct_sources(order_diffs(spark, sf_dir))


def field_matrix(spark, sf_dir):
    return rl.field_matrix(stored_diffs(spark, order_diffs(spark, sf_dir)))


def stored_diffs(spark, diffs) -> DataFrame:
    """Diffs, or a matrix, written to shared storage, so that each is computed once."""
    folder = scratch_dir(spark, "stored")
    diffs.write.parquet(folder)
    return spark.read.schema(diffs.schema).parquet(folder)


def order_cells(spark, sf_dir):
    return rl.count_cells(order_diffs(spark, sf_dir))


def global_counts(spark, sf_dir):
    return rl.global_counts(order_cells(spark, sf_dir))


def source_counts(spark, sf_dir):
    return rl.source_counts(order_cells(spark, sf_dir))


def stored_cells(spark, diffs) -> DataFrame:
    """Cells written to shared storage, for counts that use them more than once."""
    return rl.count_cells(diffs, path=scratch_dir(spark, "cells"))


def source_field_counts(spark, sf_dir):
    return rl.source_field_counts(stored_cells(spark, order_diffs(spark, sf_dir)),
                                  zeros=v.ORDER_FIELDS)


def field_counts(spark, sf_dir):
    return rl.field_counts(order_cells(spark, sf_dir))


def field_source_counts(spark, sf_dir):
    cells = stored_cells(spark, document_diffs(spark, sf_dir))
    return rl.source_field_counts(cells, zeros=["lines", "stats"]).select("field", "source", "n")


def metrics_rows(spark, sf_dir):
    return rl.metrics_rows(stored_cells(spark, order_diffs(spark, sf_dir)))


def metrics_document(spark, sf_dir):
    """Over orders of which some have no source and some an empty one."""
    source = F.when(F.col("source") == "2-HIGH", "").when(
        F.col("source") != "5-LOW", F.col("source"))
    diffs = order_diffs(spark, sf_dir).withColumn("source", source)
    return rl.metrics_document(stored_cells(spark, diffs))


# --- final records and queries over them ---------------------------------------------

def order_records(spark, sf_dir) -> DataFrame:
    """Final records with the fields that changed, found in the stored diffs."""
    return rl.final_records(stored_diffs(spark, order_diffs(spark, sf_dir)))


def _record_columns(records):
    return records.select(
        "record_id", "source", "has_diff", "a_or_b_missing", joined("modified_fields"),
        "ab_diff", text("record_a"), text("record_b"), *v.ORDER_FIELDS)


def final_records(spark, sf_dir):
    return _record_columns(order_records(spark, sf_dir))


def final_records_join(spark, sf_dir):
    diffs = stored_diffs(spark, order_diffs(spark, sf_dir))
    matrix = stored_diffs(spark, rl.field_matrix(diffs))
    return _record_columns(rl.join_matrix(diffs, matrix))


MATRIX_SQL = """
    SELECT source, count(*) AS n, sum(status) AS status_changes, sum(total) AS total_changes
    FROM record_diff_matrix WHERE a_or_b_missing = :missing GROUP BY source
"""


def matrix_sql(spark, sf_dir):
    return rl.query_matrix(order_records(spark, sf_dir), MATRIX_SQL, {"missing": 0})


def records_view(spark, sf_dir):
    rl.register_records(order_records(spark, sf_dir))
    return spark.sql("""
        SELECT has_diff, source, count(*) AS n, min(record_id) AS first_id, sum(status) AS status
        FROM records GROUP BY has_diff, source""")


def lookup_record(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders")
    dearest = orders.filter(F.col("o_totalprice") < 490000).agg(
        F.max_by(F.col("o_orderkey").cast("string"), F.struct("o_totalprice", "o_orderkey")))
    return rl.record_payloads(stored_diffs(spark, order_diffs(spark, sf_dir)), dearest.scalar())


def record_summary(spark, sf_dir):
    return rl.record_summaries(order_diffs(spark, sf_dir)).select(
        "record_id", "fields_changed", joined("modified_fields"),
        joined("fields_only_in_a"), joined("fields_only_in_b"))


def browse_page(spark, sf_dir):
    return rl.browse(
        stored_diffs(spark, document_diffs(spark, sf_dir)), search="the",
        sources=["src0", "src1", "src2", "src3", "src5", "src6", "src7", "src8"],
        fields=["stats", "lang"], order_column=1, direction="desc", start=1, length=20)


def browse_by_fields(spark, sf_dir):
    return rl.browse(stored_diffs(spark, order_diffs(spark, sf_dir)), order_column=3, direction="asc",
                     start=100, length=25)


def browse_after(spark, sf_dir):
    """The page of ``browse_by_fields``, found from the row before it instead of an offset."""
    records = stored_diffs(spark, order_diffs(spark, sf_dir))
    last = rl.browse(records, order_column=3, start=99, length=1).first()
    after = (last.modified_fields, last.record_id) if last else None
    return rl.browse(records, order_column=3, length=25, after=after)


def browse_by_id(spark, sf_dir):
    return rl.browse(stored_diffs(spark, order_diffs(spark, sf_dir)), order_column=0,
                     direction="desc", length=30)


def browse_by_flag(spark, sf_dir):
    return rl.browse(stored_diffs(spark, order_diffs(spark, sf_dir)), order_column=2,
                     direction="desc", start=10, length=30)


def browse_jump(spark, sf_dir):
    """Pages far behind the first, found by the sizes of sorted ranges: one of all orders, one
    of those with changes in the status or the total."""
    diffs, folder = stored_diffs(spark, order_diffs(spark, sf_dir)), scratch_dir(spark, "ranks")
    rl.write_rank_index(diffs, folder, 1, "desc", rows_per_range=5000)
    pages = (rl.jump(spark, folder, 1, "desc", start=700, length=40),
             rl.jump(spark, folder, 1, "desc", fields=["status", "total"], start=150, length=30))
    return pages[0].withColumn("page", F.lit("all")).unionByName(
        pages[1].withColumn("page", F.lit("changed")))


SEARCHES = ["é", "100%_x", "the", "qu", "nowhere to be found"]


def search_stored(spark, sf_dir):
    """Stored documents that hold a term, read from the files whose signatures know it."""
    folder = scratch_dir(spark, "search") + "/diffs"
    rl.write_dataset(document_diffs(spark, sf_dir), folder, ["has_diff"], cluster_by="record_id")
    index = rl.write_search_index(spark, folder, scratch_dir(spark, "signatures"),
                                  rows_per_block=512)
    records = rl.read_dataset(spark, folder)
    return reduce(DataFrame.unionByName, [
        rl.narrowed(records, index, folder, term).filter(rl.record_filter(term))
        .select(F.lit(term).alias("term"), "record_id") for term in SEARCHES])


def record_summary_strict(spark, sf_dir):
    """Summary of the cheapest order that isn't deleted."""
    least = v.table(spark, sf_dir, "orders").agg(
        F.min_by(F.col("o_orderkey").cast("string"), F.struct("o_totalprice", "o_orderkey")))
    records = stored_diffs(spark, order_diffs(spark, sf_dir))
    return rl.record_summary(records, least.first()[0], strict=True).select(
        "record_id", "fields_changed", joined("modified_fields"),
        joined("fields_only_in_a"), joined("fields_only_in_b"))


def manifest_list(spark, sf_dir):
    """The event types as a comma-separated list, read as a manifest in order."""
    kinds = v.table(spark, sf_dir, "events").select("event_type").distinct()
    value = kinds.agg(F.array_join(F.sort_array(F.collect_set("event_type")), " , ")).first()[0]
    return rl.read_manifest(spark, value).select(
        "path", F.col("position.line").cast("bigint").alias("line"))


def browse_filtered(spark, sf_dir):
    from recordlens.operators.browse import filtered_records
    condition = rl.record_filter("PENDING", ["1-URGENT", "5-LOW"], ["status", "total"])
    return filtered_records(stored_diffs(spark, order_diffs(spark, sf_dir)), condition)


def browse_counts(spark, sf_dir):
    diffs = stored_diffs(spark, document_diffs(spark, sf_dir))
    searches = [
        rl.browse_counts(diffs, search="100%_x").withColumn("filter", F.lit("wildcards")),
        rl.browse_counts(diffs, search="é", fields=["lines"]).withColumn("filter", F.lit("accent")),
        rl.browse_counts(diffs, sources=["src0", "src7"]).withColumn("filter", F.lit("source")),
        rl.browse_counts(diffs).withColumn("filter", F.lit("none")),
    ]
    out = searches[0]
    for more in searches[1:]:
        out = out.unionByName(more)
    return out


# --- manifests, versions, storage ------------------------------------------------------

def event_paths(spark, sf_dir) -> DataFrame:
    """One extract file path per event, some with a part number, some no extracts."""
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "full").otherwise("daily")
    stage = F.when(F.col("value") < 5, "transformed").otherwise("extracted")
    action = F.when(F.col("event_type") == "error", "delete").otherwise("index")
    part = F.when(F.col("value") >= 20, F.format_string("_%02d", F.col("event_id")))
    full = F.when(F.col("value") >= 60, "full").otherwise(kind)
    return v.table(spark, sf_dir, "events").select(F.concat(
        F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"), F.lit("/"),
        F.col("event_type"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), full,
        F.lit("-"), stage, F.lit("-records-to-"), action, F.coalesce(part, F.lit("")),
        F.lit(".xml")).alias("path"))


def manifest_parse(spark, sf_dir):
    return rl.parse_filenames(event_paths(spark, sf_dir))


def manifest_since_full(spark, sf_dir):
    chosen = rl.input_manifest(event_paths(spark, sf_dir), MANIFEST_SOURCES)
    return chosen.select("ordinal", "source", "daily", "path", text("extract_date"))


def manifest_csv(spark, sf_dir):
    folder = scratch_dir(spark, "manifest") + ".csv"
    chosen = rl.input_manifest(event_paths(spark, sf_dir), MANIFEST_SOURCES)
    rl.write_manifest(chosen, folder, ["ordinal", "daily", "path"])
    return rl.read_manifest(spark, folder).select("path")


def extracted_listing(spark, sf_dir):
    return rl.extracted_files(event_paths(spark, sf_dir)).groupBy(
        F.substring_index("path", "/", 1).alias("source")).agg(F.count("*").alias("files"))


def version_labels(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    path = F.concat(
        F.lit("/runs/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/transformed/"),
        F.when(F.col("event_type") == "view", "a").otherwise("b"), F.lit("/"),
        F.col("event_type"), F.lit(".parquet"))
    return events.select("event_id", version_label(path).alias("version"))


def versions_applied(spark, sf_dir):
    run = rl.run_versions(
        v.table(spark, sf_dir, "orders"), v.transform_orders_a, v.transform_orders_b)
    return rl.union_versions({"a": run.a, "b": run.b}).select(
        "version", "record_id", text("transformed_record"))


def _page_row(payload):
    def transform(pages):
        return pages.select(
            F.col("page_id").cast("string").alias("record_id"), F.lit("pages").alias("source"),
            F.lit("2024-01-01").cast("date").alias("run_date"), F.lit("full").alias("run_type"),
            F.lit("index").alias("action"), payload.cast("binary").alias("transformed_record"))
    return transform


def _page_run(spark, sf_dir):
    """Version B of the page transform cannot handle addresses without https."""
    secure = F.to_json(F.struct(
        F.nullif(F.regexp_extract("url", "^https://([^/]+)", 1), F.lit("")).alias("host")))
    return rl.run_versions(
        v.table(spark, sf_dir, "pages"),
        _page_row(F.to_json(F.struct(F.length("html").alias("size")))),
        _page_row(F.nullif(secure, F.lit("{}"))), strict=False)


def versions_lenient(spark, sf_dir):
    run = _page_run(spark, sf_dir)
    kept = rl.union_versions({"a": run.a, "b": run.b}).select("version", "record_id")
    rejected = run.rejects.select("version", "record_id")
    return kept.withColumn("outcome", F.lit("kept")).unionByName(
        rejected.withColumn("outcome", F.lit("rejected")))


def write_read_back(spark, sf_dir):
    folder = scratch_dir(spark, "diffs")
    rl.write_dataset(order_diffs(spark, sf_dir), folder, ["source", "has_diff"])
    back = rl.read_dataset(spark, folder)
    return back.groupBy("source", "has_diff").agg(
        F.count("*").alias("n"), F.count("record_a").alias("with_a"),
        F.count("record_b").alias("with_b"))


def version_scan(spark, sf_dir):
    """Dataset of version B with hive keys, read back as its six columns."""
    folder = scratch_dir(spark, "version")
    version = v.order_versions(spark, sf_dir)[1]
    rl.write_dataset(version, folder, ["source", "run_type", "action"])
    return rl.read_version(spark, folder).select(
        "record_id", "source", text("run_date"), "run_type", "action",
        text("transformed_record"))


def lookup_stored(spark, sf_dir):
    """One record of a stored run, by its id: files are sorted by id, with Bloom filters."""
    folder = scratch_dir(spark, "lookup")
    rl.run_diff(*v.order_versions(spark, sf_dir), folder)
    records = rl.load_run(spark, folder).records
    wanted = records.where("has_diff = 'true' AND a_or_b_missing = 0") \
        .agg(F.min("record_id")).first()[0]
    found = rl.record_payloads(records, wanted) \
        .join(rl.record_summary(records, wanted), "record_id")
    return found.select("record_id", text("record_a"), text("record_b"), "fields_changed",
                        joined("modified_fields"))


def run_diff(spark, sf_dir):
    result = rl.run_diff(*v.order_versions(spark, sf_dir), scratch_dir(spark, "run"), wide=True)
    return _record_columns(result.records)


def run_commits(spark, sf_dir):
    """Two runs into one output, in the order of their commits, each read by its name."""
    folder, (a, b) = scratch_dir(spark, "commits"), v.order_versions(spark, sf_dir)
    for sides in ((a, b), (b, a)):
        rl.run_diff(*sides, folder)
    commits = rl.published_runs(spark, folder).orderBy("number", "run").collect()
    counts = [
        rl.load_run(spark, folder, run=c.run).records.agg(
            F.count("*").alias("records"),
            F.count_if(F.col("has_diff") == "true").alias("changed"))
        .select(F.lit(c.number).cast("long").alias("number"), "records", "changed")
        for c in commits]
    return reduce(DataFrame.unionByName, counts)


def compare_transforms(spark, sf_dir):
    """Both order transforms over all orders, stored, collated, compared and counted."""
    result = rl.compare_transforms(
        v.table(spark, sf_dir, "orders"), v.transform_orders_a, v.transform_orders_b,
        scratch_dir(spark, "compare"), wide=True)
    return _record_columns(result.records)


def labelled_versions(spark, sf_dir):
    """Stored versions of the page transform, labelled by file path, with their rejects."""
    folder = scratch_dir(spark, "labelled")
    rl.write_versions(_page_run(spark, sf_dir), folder)
    stored = rl.read_labelled_versions(spark, folder).withColumn("outcome", F.lit("kept"))
    rejects = rl.read_dataset(spark, f"{folder}/rejects").withColumn("outcome", F.lit("rejected"))
    columns = ["version", "outcome"]
    return stored.select(columns).unionByName(rejects.select(columns)).groupBy(columns).agg(
        F.count("*").alias("n"))


def _page_records(rows, payloads):
    import pyarrow as pa

    n = rows.num_rows
    return pa.table({
        "record_id": rows["page_id"].cast(pa.string()), "source": ["pages"] * n,
        "run_date": pa.array(["2024-01-01"] * n).cast(pa.date32()), "run_type": ["full"] * n,
        "action": ["index"] * n, "transformed_record": pa.array(payloads, pa.binary())})


def _isolated_pages(raising: bool):
    """A page transform by Arrow tables; version B raises at the first address without https."""
    record = _page_records

    def work(rows):
        hosts = []
        for url in rows["url"].to_pylist():
            scheme, _, rest = (url or "").partition("://")
            if raising and scheme != "https":
                raise ValueError(f"not secure: {url}")
            hosts.append(f'{{"host":"{rest.partition("/")[0]}"}}'.encode())
        return record(rows, hosts)

    return rl.Isolated(work, part=F.expr("page_id div 100"), row=F.col("page_id"),
                       rows_per_call=64)


def versions_isolated(spark, sf_dir):
    """Rows of both versions, and the rows that version B raised on, with part and message."""
    run = rl.run_versions(v.table(spark, sf_dir, "pages"), _isolated_pages(False),
                          _isolated_pages(True), strict=False)
    none = F.lit(None).cast("string")
    kept = rl.union_versions({"a": run.a, "b": run.b}).select(
        "version", "record_id", none.alias("part"), none.alias("message"))
    return kept.unionByName(run.failures.select(
        "version", F.col("row").alias("record_id"), "part", "message"))


def compare_isolated(spark, sf_dir):
    """A comparison that goes on without the pages that version B raised on."""
    result = rl.compare_transforms(
        v.table(spark, sf_dir, "pages"), _isolated_pages(False), _isolated_pages(True),
        scratch_dir(spark, "isolated"), strict=False)
    return result.records.select("record_id", "has_diff", "a_or_b_missing", text("record_a"),
                                 text("record_b"))


RUN_STAMPS = ["2024-11-07_03-56-22", "2024-10-17_14-01-18"]


def _saved_runs(spark, sf_dir) -> str:
    history = scratch_dir(spark, "history")
    paths = event_paths(spark, sf_dir)
    for stamp, diffs in zip(RUN_STAMPS, (order_diffs, document_diffs)):
        metrics = rl.metrics_document(stored_cells(spark, diffs(spark, sf_dir)))
        rl.save_run(history, metrics, stamp, f"run of {stamp[:10]}", paths, {"run": history})
    return history


def run_history(spark, sf_dir):
    history = _saved_runs(spark, sf_dir)
    inputs = rl.read_run_inputs(spark, history).groupBy("run_timestamp").agg(
        F.count("*").alias("input_files"))
    total = F.get_json_object("metrics", "$.total_records").cast("bigint")
    runs = rl.read_history(spark, history).where("part = 'summary'")
    return runs.join(inputs, "run_timestamp").select(
        "run_timestamp", "run_message", total.alias("total_records"), "input_files")


def run_documents(spark, sf_dir):
    """Run documents written as JSON files, read back oldest first."""
    history = _saved_runs(spark, sf_dir)
    runs = rl.read_history(spark, history).where("part = 'summary'")
    folder = scratch_dir(spark, "documents")
    summary = "total_records_with_diff bigint, sources bigint"
    runs.select("run_timestamp", F.from_json("metrics", summary).alias("metrics")).write.option(
        "maxRecordsPerFile", 1).json(folder)
    found = rl.read_run_documents(spark, f"{folder}/*.json")
    return found.select(
        run_time(F.col("run_timestamp")).cast("string").alias("run_time"),
        F.col("metrics.total_records_with_diff").alias("with_diff"),
        F.col("metrics.sources").alias("sources"))


def listed_manifest(spark, sf_dir):
    """Empty files named like the extracts, listed and put in order."""
    folder = scratch_dir(spark, "extracts")
    paths = event_paths(spark, sf_dir).distinct()

    def touch(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(f"{folder}/{path}")
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                system.open_output_stream(place).close()
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    paths.mapInArrow(touch, "n long").agg(F.sum("n")).collect()
    chosen = rl.input_manifest(rl.list_files(spark, folder), MANIFEST_SOURCES)
    return chosen.select("ordinal", "source", "daily", "key", text("extract_date"))


def inventory_manifest(spark, sf_dir):
    """The extracts' paths as a store's inventory table, some twice and some elsewhere."""
    here = event_paths(spark, sf_dir).select(
        F.concat(F.lit("s3a://extracts/2024/"), "path").alias("object"),
        F.length("path").alias("size"))
    elsewhere = here.withColumn("object", F.replace("object", F.lit("/2024/"), F.lit("/20240/")))
    files = rl.listed_files(here.unionByName(here).unionByName(elsewhere),
                            "s3a://extracts/2024", "object")
    return rl.input_manifest(files, MANIFEST_SOURCES).select(
        "ordinal", "source", "daily", "key", text("extract_date"))


QUERIES = {
    fn.__name__: fn for fn in (
        collate_full_outer, latest_state, latest_collated, row_key, checks,
        diff_status, modified_fields, modified_fields_typed, ordered_vs_unordered,
        change_table, change_table_nested, change_table_repetition, change_table_items,
        change_document,
        keys_only_one_side, record_flags, field_long, changed_fields, distinct_sources,
        field_matrix, global_counts, source_counts, source_field_counts, field_counts,
        field_source_counts, metrics_rows, metrics_document, final_records,
        final_records_join, matrix_sql, records_view, lookup_record, record_summary,
        browse_page,
        browse_by_fields, browse_filtered, browse_counts, manifest_parse,
        manifest_since_full, manifest_csv, extracted_listing, version_labels,
        versions_applied, versions_lenient, write_read_back, version_scan, run_diff, run_commits,
        lookup_stored,
        compare_transforms, labelled_versions, versions_isolated, compare_isolated,
        run_history, run_documents, listed_manifest, inventory_manifest, browse_after,
        browse_by_id, browse_by_flag, browse_jump, search_stored, record_summary_strict, manifest_list)
}
