"""FASTA and tables, models on disk, curation, outside records."""

import gzip
import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from ribospark.operators import curate
from ribospark.operators.train import train
from ribospark.sources import external, fasta, model_store

RECORDS = """>acc1\tsome name\tBacteria;Firmicutes;Bacilli;
ACGU
acgt  

TT
>acc2  Archaea;x; suborderFoo;y
AC GT
>seq3     uncultured Bacteria  Bacteria;z
>plain id
UUNN
"""


def rows(df):
    return [(r.id, r.sequence) for r in df.orderBy("seq_no").collect()]


WANT = [("Bacteria;Firmicutes;Bacilli", "ACGTacgtTT"), ("Archaea;x;y", "AC GT"), ("uncultured Bacteria", ""), ("plain id", "TTNN")]


@pytest.mark.parametrize("kind", ["plain", "gz", "crlf", "hidden gz"])
def test_read_fasta(spark, tmp_path, kind):
    path = tmp_path / ("x.fa.gz" if kind == "gz" else "x.fa")
    text = RECORDS.replace("\n", "\r\n") if kind == "crlf" else RECORDS
    path.write_bytes(gzip.compress(text.encode()) if "gz" in kind else text.encode())
    got = rows(fasta.read_taxa_fasta(spark, str(path)))
    assert got == WANT
    assert fasta.is_gzip(spark, str(path)) == ("gz" in kind)


def test_compat_turns_u_into_t_in_the_last_record_only(spark, tmp_path):
    (tmp_path / "x.fa").write_text(RECORDS)
    assert [s for _, s in rows(fasta.read_taxa_fasta(spark, str(tmp_path / "x.fa"), compat=True))] == ["ACGUacgtTT", "AC GT", "", "TTNN"]


def test_a_file_without_header_raises(spark, tmp_path):
    for i, text in enumerate(("ACGT\n>x\nAC\n", "", "\n>x\nAC\n")):
        (tmp_path / f"{i}.fa").write_text(text)
        with pytest.raises(ValueError, match="FASTA header"):
            fasta.read_taxa_fasta(spark, str(tmp_path / f"{i}.fa"))
    (tmp_path / "good.fa").write_text(RECORDS)
    (tmp_path / "3.fa").write_bytes(gzip.compress(b"junk line\n>x\nAC\n"))
    for path in ("", "/*.fa", "/3.fa", "/no.fa"):
        with pytest.raises(ValueError, match="FASTA header"):
            fasta.read_taxa_fasta(spark, f"{tmp_path}{path}")


def test_compressed_members_and_records_across_chunks(spark, tmp_path):
    texts = ["".join(f">id{i}\n{'ACGT' * (i % 90)}\n" for i in range(a, a + 9000)) for a in (0, 9000)]
    (tmp_path / "x.fa").write_bytes(b"".join(gzip.compress(t.encode()) for t in texts))
    assert rows(fasta.read_taxa_fasta(spark, str(tmp_path))) == [(f"id{i}", "ACGT" * (i % 90)) for i in range(9000)] + [(f"id{i}", "ACGT" * (i % 90)) for i in range(9000, 18000)]


def test_many_records_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "x.fa").write_text("".join(f">id{i}\nACGT\n{'ACGT' * (i % 7)}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = fasta.read_taxa_fasta(spark, str(tmp_path / "x.fa"))
        assert df.rdd.getNumPartitions() > 5
        assert rows(df) == [(f"id{i}", "ACGT" + "ACGT" * (i % 7)) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "Bacteria;a", "ACGT"), (1, "idb", "GG")], "seq_no long, id string, sequence string")
    fasta.write_fasta(df, str(tmp_path / "out"), single_file=True)
    assert rows(fasta.read_taxa_fasta(spark, str(tmp_path / "out"))) == [("Bacteria;a", "ACGT"), ("idb", "GG")]


@pytest.mark.parametrize(("name", "sep"), [("a.csv", ","), ("a.tsv", "\t"), ("a.txt", ";")])
def test_tables(spark, tmp_path, name, sep):
    (tmp_path / name).write_text(f"id{sep}sequence\nx{sep}ACGT\n")
    assert [(r.id, r.sequence) for r in fasta.read_table(spark, str(tmp_path / name)).collect()] == [("x", "ACGT")]


def test_tax_file_and_sinks(spark, tmp_path):
    (tmp_path / "a.tax").write_text("s1\tB;p;c;o;f;g;\ns2\tB;p;\n")
    got = {r.id: (r.taxonomy, r.Genus) for r in fasta.read_tax(spark, str(tmp_path / "a.tax")).collect()}
    assert got == {"s1": ("B;p;c;o;f;g", "g"), "s2": ("B;p", None)}
    df = spark.createDataFrame([("x", 1)], "id string, n int")
    fasta.write_csv(df, str(tmp_path / "csv"))
    fasta.write_parquet(df, str(tmp_path / "pq"), "gzip")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == spark.read.parquet(str(tmp_path / "pq")).count() == 1


def test_model_round_trip(spark, tmp_path):
    m = train(spark.createDataFrame([("A;b", "ACGTACGT"), ("A;c", "GGGGACGT")], "id string, sequence string"), 3)
    model_store.save_model(m, str(tmp_path / "m"), "gzip")
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "model_dir": str(tmp_path)}))
    for back in (model_store.load_model(spark, str(tmp_path / "m")), model_store.load_db(spark, {"model": "m", "model_dir": str(tmp_path)}), model_store.load_db(spark, str(tmp_path / "c.json"))):
        assert (back.kmer_size, back.n_seqs) == (3, 2)
        assert sorted(map(tuple, back.cells.collect())) == sorted(map(tuple, m.cells.collect()))
    for missing in (lambda: model_store.load_model(spark, str(tmp_path / "no")), lambda: model_store.load_db(spark, str(tmp_path / "no.json"))):
        with pytest.raises(FileNotFoundError):
            missing()


def test_configurations_are_checked(spark, tmp_path):
    import numpy as np

    m = train(spark.createDataFrame([("A;b", "ACGTACGT"), ("A;c", "GGGGACGT")], "id string, sequence string"), 3)
    model_store.save_model(m, str(tmp_path / "m"))
    for bad in ({"model": "m"}, {"model_dir": str(tmp_path)}, {"model": "x", "genera": "y", "model_dir": str(tmp_path)}):
        with pytest.raises(ValueError, match="lacks"):
            model_store.load_db(spark, bad)
    assert model_store.load_db(spark, {"model": "m"}, model_dir=str(tmp_path)).n_seqs == 2
    (tmp_path / "raw").write_bytes(np.zeros((16, 2), "<f2").tobytes())
    np.save(tmp_path / "names.npy", np.array(["a", "b"]))
    np.save(tmp_path / "objects.npy", np.array(["a", None], dtype=object))
    config = {"model": "raw", "genera": "names.npy", "model_dir": str(tmp_path), "model_shape": [16, 2]}
    dense = model_store.load_db(spark, config)
    assert dense.kmer_size == 2 and dense.cells.count() == 32
    model_store.save_model(dense, str(tmp_path / "d"))
    assert model_store.load_model(spark, str(tmp_path / "d")).all_cells
    for change in ({"model_shape": [16, 3]}, {"model_shape": [15, 2]}, {"genera": "objects.npy"}):
        with pytest.raises(ValueError):
            model_store.load_db(spark, config | change)
    with pytest.raises(FileNotFoundError):
        model_store.load_db(spark, config | {"genera": "no.npy"})


def test_curation(spark):
    ids = ["Bacteria;Incertae Sedis", "Bacteria;Candidatus", "Eukaryota;worm", "Prokaryota;Shewanella", "A;b", "A;b;c", None]
    got = curate.filter_train_set(spark.createDataFrame([(i,) for i in ids], "id string"))
    assert {(r.id, r.levels) for r in got.collect()} == {("Prokaryota;Shewanella", 1), ("A;b", 1)}
    df = spark.createDataFrame([("domain__Bacteria; phylum__Two words; family__F",)], "t string")
    assert curate.lineages_from_fields(df, "t").first().lineage == "Bacteria;Two_words;Two_words_incertae_sedis;Two_words_incertae_sedis;F;F_incertae_sedis"
    assert curate.union_reference_sets(df, df).count() == 2


def test_json_records(spark):
    body = {"result": {"uids": ["1", "2"], "1": {"uid": "1", "rank": "genus", "taxid": 5}, "2": {"uid": "2"}}}
    df = spark.createDataFrame([(json.dumps(body),), ("no json",), (None,)], "value string")
    assert {(r.key, r.uid, r.rank, r.taxid) for r in external.summarize_taxa_ids(df).collect()} == {("1", "1", "genus", 5), ("2", "2", None, None)}


def test_requests_are_tried_again():
    waits, answers = [], [429, 429, b'{"a": 1}']

    def opener(url):
        x = answers.pop(0)
        if isinstance(x, int):
            raise urllib.error.HTTPError(url, x, "", {"Retry-After": "3"} if len(answers) == 2 else {}, io.BytesIO(b"gone"))
        return io.BytesIO(x)

    assert external.fetch_json("http://x", {"q": "a b"}, opener=opener, sleep=waits.append) == {"a": 1} and waits == [3.0, 4.0]
    answers[:] = [429] * 5
    assert external.fetch_text("http://x", opener=opener, sleep=waits.append) is None
    answers[:] = [404]
    assert external.fetch_json("http://x", opener=opener) == "gone"


def test_download_once(tmp_path):
    calls = []

    def opener(url):
        calls.append(url)
        return io.BytesIO(b"data")

    for _ in range(2):
        assert open(external.download("http://x/a.fa?download", str(tmp_path), opener=opener), "rb").read() == b"data"
    assert len(calls) == 1


def test_taxa_string_of_a_header(spark):
    df = spark.createDataFrame([(">id\t\tname  Eukaryota;a;;",), (">only id;",)], "h string")
    got = df.select(fasta.taxa_string(F.col("h")).alias("t"), fasta.clean_id(F.col("h")).alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [("Eukaryota;a", "id"), (None, "only id;")]
