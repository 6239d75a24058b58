"""An index of the texts in stored payloads: which blocks of which files may hold a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import DEFAULT, Columns
from ..sources.datasets import read_dataset, write_dataset

#: Bytes of one bitmap, as ``bitmap_or_agg`` takes them, and bitmaps of a signature.
BITMAP_BYTES = 4096
BITMAPS = 4
#: Candidate blocks up to which their id ranges go into the scan's filter.
MOST_RANGES = 200

_BITS = BITMAPS * BITMAP_BYTES * 8
_SIGNATURE = "file string, block long, first string, last string, no_id boolean, part int, bits binary"


def _slots(codes):
    """Bit of a signature for each gram, by Fibonacci hashing of its code."""
    import numpy as np

    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - _BITS.bit_length() + 1)).astype(np.int64)


def _codes(data, n: int):
    """Numbers of the grams of ``n`` bytes (1 to 3) of a byte array, unlike for each length."""
    import numpy as np

    data = data.astype(np.uint32)
    code = np.full(max(len(data) - n + 1, 0), n, np.uint32)
    for i in range(n):
        code[:] = code << 8 | data[i:i + len(code)]
    return code


def term_slots(term: str) -> list[int]:
    """The bits that a block with the term has: those of its three-byte grams, or of the whole
    term where it is shorter."""
    import numpy as np

    data = np.frombuffer(term.encode(), np.uint8)
    return sorted(set(_slots(_codes(data, min(3, len(data)))).tolist())) if term else []


def _relative(folder: str) -> Column:
    """A stored file's path below the dataset's folder, so that a moved dataset keeps its index."""
    name = folder.rstrip("/").rpartition("/")[2]
    return F.substring_index(F.col("_metadata.file_path"), f"/{name}/", -1)


def write_search_index(
    spark: SparkSession, folder: str, index: str, rows_per_block: int = 4096,
    cols: Columns = DEFAULT,
) -> DataFrame:
    """Index the payloads of the dataset stored in ``folder``, and return the index.

    A block is a run of ``rows_per_block`` rows of a file. Its signature has a bit for every
    gram of one, two and three bytes in the block's payloads, in 16 kB; blocks of longer texts
    fill it more and are ruled out less often, never wrongly. The index holds the block's least
    and greatest id. One pass over the payloads; what is shuffled is a signature per block and
    task. Null payloads have no grams; an empty dataset gives an empty index.
    """
    import pyarrow as pa

    stored = read_dataset(spark, folder)
    rows = stored.select(
        _relative(folder).alias("file"),
        F.floor(F.col("_metadata.row_index") / rows_per_block).alias("block"),
        F.col(cols.id).cast("string").alias("id"),
        *[F.col(c).cast("binary") for c in (cols.record_a, cols.record_b)])

    def sign(batches):
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key in table.group_by(["file", "block"]).aggregate([]).to_pylist():
                mine = table.filter(pc.and_(pc.equal(table["file"], key["file"]),
                                            pc.equal(table["block"], key["block"])))
                bits = np.zeros(_BITS, bool)
                for name in mine.column_names[3:]:
                    # all payloads end to end: the grams across two of them only add bits
                    values = mine[name].cast(pa.large_binary()).combine_chunks()
                    if len(values) == values.null_count:
                        continue
                    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset:]
                    data = np.frombuffer(values.buffers()[2], np.uint8)
                    data = data[ends[0]:ends[len(values)]]
                    for n in (1, 2, 3):
                        bits[_slots(_codes(data, n))] = True
                packed = np.packbits(bits, bitorder="little").reshape(BITMAPS, BITMAP_BYTES)
                bounds = pc.min_max(mine["id"]).as_py()
                yield pa.RecordBatch.from_pylist([
                    {**key, "first": bounds["min"], "last": bounds["max"],
                     "no_id": mine["id"].null_count > 0, "part": part, "bits": row.tobytes()}
                    for part, row in enumerate(packed)], pa.schema([
                        ("file", pa.string()), ("block", pa.int64()), ("first", pa.string()),
                        ("last", pa.string()), ("no_id", pa.bool_()), ("part", pa.int32()),
                        ("bits", pa.binary())]))

    blocks = rows.mapInArrow(sign, _SIGNATURE).groupBy("file", "block", "part").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.bool_or("no_id").alias("no_id"), F.bitmap_or_agg("bits").alias("bits"))
    write_dataset(blocks, index)
    return read_search_index(spark, index)


def read_search_index(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(_SIGNATURE).parquet(index)


def candidate_blocks(index: DataFrame, term: str) -> DataFrame:
    """Blocks whose signature has all bits of the term: file, block, first, last, no_id."""
    wanted: dict[int, list[int]] = {}
    for slot in term_slots(term):
        wanted.setdefault(slot // (8 * BITMAP_BYTES), []).append(slot % (8 * BITMAP_BYTES))
    found = F.lit(True)
    for part, slots in wanted.items():
        own = F.lit(True)
        for slot in slots:
            byte = F.conv(F.hex(F.substring("bits", slot // 8 + 1, 1)), 16, 10).cast("int")
            own = own & (byte.bitwiseAND(1 << slot % 8) != 0)
        found = found & ((F.col("part") != part) | own)
    return index.groupBy("file", "block").agg(
        F.bool_and(found).alias("found"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.bool_or("no_id").alias("no_id")
    ).where("found").drop("found")


def narrowed(
    records: DataFrame, index: DataFrame, folder: str, term: str, cols: Columns = DEFAULT
) -> DataFrame:
    """The records in files that may hold the term: a superset of those that do.

    ``records`` read the dataset in ``folder`` as it was indexed. Other files are dropped when
    the scan is planned, so they are not opened. Up to 200 candidate blocks also give the scan
    their id ranges, by which it skips row groups and pages of a dataset sorted by id. The names
    of candidate files come to the driver, which lists all files for the scan in any case. An
    empty term leaves the records as they are; its files need no look.
    """
    if not term:
        return records
    blocks = candidate_blocks(index, term)
    files = [r.file for r in blocks.select("file").distinct().collect()]
    kept = records.filter(_relative(folder).isin(files) if files else F.lit(False))
    ranges = blocks.limit(MOST_RANGES + 1).collect()
    if not 0 < len(ranges) <= MOST_RANGES:
        return kept
    record_id, inside = F.col(cols.id).cast("string"), F.lit(False)  # as it was indexed
    if any(r.no_id for r in ranges):
        inside = record_id.isNull()
    for r in ranges:
        if r.first is not None:
            inside = inside | record_id.between(r.first, r.last)
    return kept.filter(inside)
