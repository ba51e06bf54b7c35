"""FASTA, CSV/TSV and taxonomy tables, read and written by Spark."""

from __future__ import annotations

import zlib
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace  # noqa: F401  (its import lets functions travel by value)

#: What separates the fields of a header (fixed value).
FIELDS = "\\t|\\s{2,}"


def taxa_string(header: Column) -> Column:
    """First field that names a domain, with the suborder removed; null if none does."""
    line = F.regexp_replace(F.rtrim(F.replace(header, F.lit(">"), F.lit(""))), ";+$", "")
    found = F.get(F.filter(F.split(line, FIELDS), lambda x: x.rlike("Bacteria|Archaea|Eukar")), F.lit(0))
    return F.regexp_replace(found, " suborder\\w+;", "")


def clean_id(header: Column) -> Column:
    """First field of a header."""
    return F.get(F.split(F.rtrim(F.replace(header, F.lit(">"), F.lit(""))), FIELDS), F.lit(0))


def parse_records(records: DataFrame, value: str = "value", u_to_t: bool = True) -> DataFrame:
    """``records`` (one FASTA record each, with or without ``>``) with ``id, sequence``.

    The id is the lineage if the header has one, else the first field. Lines are right-trimmed and joined, case is kept.
    ``u_to_t`` turns U into T in every record.
    """
    text = F.regexp_replace(F.replace(F.regexp_replace(value, "^>", ""), F.lit("\r"), F.lit("")), "\\s+$", "")
    lines = F.split(text, "\n")
    header = F.get(lines, F.lit(0))
    sequence = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.regexp_replace(x, "\\s+$", "")), "")
    sequence = F.translate(sequence, "Uu", "Tt") if u_to_t else sequence
    return records.withColumn("id", F.coalesce(taxa_string(header), clean_id(header))).withColumn("sequence", sequence)


def _first_bytes(spark: SparkSession, where, unzip: bool = False) -> bytes:
    """The first two bytes of a file, of its content if ``unzip``; fewer if it has no more."""
    jvm = spark.sparkContext._jvm
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        stream = jvm.java.util.zip.GZIPInputStream(stream) if unzip else stream
        return bytes(x for x in (stream.read(), stream.read()) if x >= 0)
    finally:
        stream.close()


def is_gzip(spark: SparkSession, path: str) -> bool:
    """Whether a file begins with the gzip magic, whatever its name. Missing files raise."""
    return _first_bytes(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)) == b"\x1f\x8b"


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, a folder or a glob, without those whose names begin with ``_`` or ``.``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for x in system.globStatus(where) or []:
        found += list(system.listStatus(x.getPath())) if x.isDirectory() else [x]
    return [x.getPath().toString() for x in found if not x.isDirectory() and x.getPath().getName()[0] not in "_."]


def _records_of_gzip(batches):
    """Records of files that come whole and compressed, one after another."""
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            source, left, n, rows = memoryview(data.as_buffer()), b"", 0, []
            inflate = zlib.decompressobj(31)
            while len(source):
                left += inflate.decompress(source, 1 << 20)
                source = inflate.unconsumed_tail or inflate.unused_data
                inflate = zlib.decompressobj(31) if inflate.eof else inflate  # members may follow one another
                *whole, left = left.split(b"\n>")
                rows += whole
                if len(rows) > 1000:
                    yield _record_batch(path, n, rows)
                    n, rows = n + len(rows), []
            yield _record_batch(path, n, [*rows, left])


def _record_batch(path: str, n: int, rows: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch({"value": [x.decode(errors="replace") for x in rows], "file": [path] * len(rows), "at": pa.array(range(n, n + len(rows)), pa.int64())})


def read_taxa_fasta(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """``seq_no, id, sequence`` of a FASTA file, a folder or a glob. Plain files are split between tasks; gzip is known by its
    first bytes, and by its name too it is read as a stream.

    The driver reads the first bytes of every file: one that doesn't begin with ``>``, an empty or a missing one raises ValueError.
    ``compat`` turns U into T in the last record only. ``seq_no`` grows along each file; it depends on how files are split and
    names rows within one reading only.
    """
    files = list_files(spark, path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def kind(name: str) -> str:
        where = jvm_path(name)
        zipped = _first_bytes(spark, where) == b"\x1f\x8b"
        if _first_bytes(spark, where, zipped)[:1] != b">":
            raise ValueError(f"{name} does not begin with a FASTA header")
        return "hidden" if zipped and not name.endswith(".gz") else "plain"

    with ThreadPoolExecutor(16) as pool:
        kinds = dict(zip(files, pool.map(kind, files), strict=True))
    if not kinds:
        raise ValueError(f"{path} does not begin with a FASTA header: it is missing or empty")
    parts = []
    if plain := [f for f in files if kinds[f] == "plain"]:
        lines = spark.read.option("lineSep", "\n>").text(plain).where(F.length(F.trim("value")) > 0)
        parts.append(lines.select("value"))
    if hidden := [f for f in files if kinds[f] == "hidden"]:
        whole = spark.read.format("binaryFile").load(hidden).select("path", "content")
        parts.append(whole.mapInArrow(_records_of_gzip, "value string, file string, at long").where(F.length(F.trim("value")) > 0).select("value"))
    lines = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    parsed = parse_records(lines.withColumn("seq_no", F.monotonically_increasing_id()), u_to_t=not compat)
    if compat:
        last = lines.withColumn("seq_no", F.monotonically_increasing_id()).agg(F.max("seq_no").alias("last"))
        parsed = parsed.crossJoin(F.broadcast(last)).withColumn("sequence", F.when(F.col("seq_no") == F.col("last"), F.translate("sequence", "Uu", "Tt")).otherwise(F.col("sequence")))  # one row
    return parsed.select("seq_no", "id", "sequence")


def fasta_text(df: DataFrame) -> DataFrame:
    return df.select("seq_no", F.concat(F.lit(">"), F.coalesce("id", F.lit("")), F.lit("\n"), F.coalesce("sequence", F.lit(""))).alias("value"))


def write_fasta(df: DataFrame, path: str, single_file: bool = False) -> None:
    """``>id`` and sequence lines. ``single_file`` makes one file in ``seq_no`` order, for small tables."""
    text = fasta_text(df)
    text = text.orderBy("seq_no").coalesce(1) if single_file else text
    text.select("value").write.text(path)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Comma, tab, semicolon or bar: the commonest in the first line."""
    first = spark.read.text(path).limit(1).first()
    line = first.value if first else ""
    return max(",\t;|", key=line.count)


def read_table(spark: SparkSession, path: str, schema: str = "id string, sequence string") -> DataFrame:
    """CSV or TSV with a header; the separator by suffix, else by the first line."""
    sep = "," if path.endswith(".csv") else "\t" if path.endswith(".tsv") else sniff_separator(spark, path)
    df = spark.read.csv(path, header=True, sep=sep, schema=schema, enforceSchema=False)
    return df.withColumn("seq_no", F.monotonically_increasing_id())


def taxa_columns(df: DataFrame, lineage: str = "taxonomy", ranks: tuple[str, ...] = ("Kingdom", "Phylum", "Class", "Order", "Family", "Genus")) -> DataFrame:
    """A taxonomy table with trailing ``;`` stripped and a column for each rank."""
    df = df.withColumn(lineage, F.regexp_replace(lineage, ";+$", ""))
    return df.select("*", *[F.get(F.split(lineage, ";"), F.lit(i)).alias(r) for i, r in enumerate(ranks)])


def read_tax(spark: SparkSession, path: str) -> DataFrame:
    """A ``.tax`` file: id and lineage by tab, no header."""
    return taxa_columns(spark.read.csv(path, sep="\t", schema="id string, taxonomy string"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_training_set(spark: SparkSession, fasta: str, path: str, kind: str = "csv") -> DataFrame:
    """A FASTA reference set as a table of ``id, sequence`` for training, written as CSV or Parquet (snappy) and read back."""
    rows = read_taxa_fasta(spark, fasta).select("id", "sequence")
    if kind == "csv":
        write_csv(rows, path)
        return spark.read.csv(path, header=True, schema="id string, sequence string", emptyValue="").withColumn("sequence", F.coalesce("sequence", F.lit("")))
    write_parquet(rows, path)
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.parquet(path, compression=compression)
