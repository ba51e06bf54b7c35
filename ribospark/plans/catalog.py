"""Registered queries over the driver's tables, with the SQL that gives the same rows.

The tables hold no DNA: letters of a document stand for bases (some for none), and language
and source for a six-rank lineage. Every query takes whole tables and whole texts. Each
uses the sane defaults (case folded in training and queries, draws from a sequence's own
k-mers) unless its name says otherwise.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kmers as K
from ..functions import taxonomy as T
from ..operators import curate, sample, score, summary, vote
from ..operators import train as tr
from ..operators.encode import encode_labels, label_dictionary
from ..sources import external, fasta, model_store
from ..workspace import fresh_path, materialize
from .classify import classify_sequences, make_classifier

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A base for each letter; q, x and z stand for none.
STAND_FOR = "".join("N" if c in "qxz" else "ACGT"[i % 4] for i, c in enumerate(LETTERS))
#: Word size and bootstraps of the queries that SQL checks.
SIZE, BOOTS, SEED = 4, 10, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineage() -> Column:
    source = F.coalesce("source", F.lit("none"))
    return F.concat_ws(";", F.lit("Bacteria"), "lang", F.concat("lang", F.lit("_"), F.length(source).cast("string")), F.concat("lang", F.lit("_"), F.left(source, F.lit(4))), F.concat("lang", F.lit("_f_"), source), F.concat("lang", F.lit("_"), source))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_no, id, sequence`` of ``documents``."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_no"), lineage().alias("id"), F.translate(letters, LETTERS, STAND_FOR).alias("sequence"))


def tokens(spark: SparkSession, sf_dir: str, k: int = SIZE) -> DataFrame:
    return tr.tokenise(sequences(spark, sf_dir), k).drop("sequence")


def model(spark: SparkSession, sf_dir: str, k: int = SIZE) -> tr.KmerModel:
    return make_classifier(sequences(spark, sf_dir), k)


def md5_list(array: Column) -> Column:
    return F.md5(F.array_join(F.transform(array, lambda x: x.cast("string")), ","))


def fasta_roundtrip(spark, sf):
    wrapped = F.regexp_replace("sequence", "(.{70})", "$1\n")
    header = F.concat(F.lit(">acc"), F.col("seq_no").cast("string"), F.lit("\tsome name  x\t"), "id", F.lit(";"))
    records = sequences(spark, sf).select("seq_no", F.concat(header, F.lit("\n"), wrapped).alias("value"))
    return fasta.parse_records(records).select("seq_no", "id", F.md5("sequence").alias("sequence_md5"))


def header_ids(spark, sf):
    named = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  x\t"), "source")).otherwise(F.concat(F.lit("  Bacteria;a suborderXyz;"), "lang", F.lit(";;")))
    header = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(">id"), F.col("doc_id").cast("string"), named).alias("h"))
    return header.select("doc_id", F.coalesce(fasta.taxa_string(F.col("h")), fasta.clean_id(F.col("h"))).alias("id"))


def base4_encode(spark, sf):
    return sequences(spark, sf).select("seq_no", F.length("sequence").cast("long").alias("n"), F.md5(K.base4(F.col("sequence"))).alias("digits_md5"))


def kmer_positions(spark, sf):
    digits = sequences(spark, sf).select(K.base4(F.col("sequence")).alias("d"))
    return digits.select(F.explode(K.kmer_indices(F.col("d"), SIZE)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_strings(spark, sf):
    return sequences(spark, sf).select(F.explode(K.all_kmers(F.col("sequence"), 3)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def kmer_distinct(spark, sf):
    rows = tokens(spark, sf)
    return rows.select("seq_no", F.size("kmers").cast("long").alias("n"), md5_list(F.col("kmers")).alias("kmers_md5"))


def _mixed_case(spark, sf):
    mixed = F.translate(F.regexp_replace("text", "[^a-zA-Z]", ""), LETTERS + LETTERS.upper(), STAND_FOR + STAND_FOR.lower())
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq_no"), lineage().alias("id"), mixed.alias("sequence"))


def kmer_case_sensitive(spark, sf):
    rows = tr.tokenise(_mixed_case(spark, sf), SIZE, fold_case=False)
    return rows.select("seq_no", F.size("kmers").cast("long").alias("n"), md5_list(F.col("kmers")).alias("kmers_md5"))


def padded_tokens(spark, sf):
    rows = tokens(spark, sf).select("seq_no", K.pad_kmers(F.col("kmers"), 4**SIZE).alias("p"))
    return rows.select("seq_no", F.size("p").cast("long").alias("n"), F.size(F.filter("p", lambda x: x == -1)).cast("long").alias("n_pad"))


def base10_base4_nucleotide(spark, sf):
    words = tokens(spark, sf).select(F.explode("kmers").alias("kmer")).distinct()
    return words.select("kmer", K.index_to_base4(F.col("kmer"), SIZE).alias("digits")).withColumn("bases", K.base4_to_nucleotide(F.col("digits")))


def genus_dictionary(spark, sf):
    s = sequences(spark, sf)
    return encode_labels(s, label_dictionary(s)).select("seq_no", "genus_idx", "id")


def genus_sizes(spark, sf):
    return label_dictionary(sequences(spark, sf))


def genus_kmer_counts(spark, sf):
    return model(spark, sf).cells.select("kmer", "genus_idx", "cnt")


def word_priors(spark, sf):
    return model(spark, sf).priors.select("kmer", "cnt", F.round("prior", 9).alias("prior"))


def word_priors_dense(spark, sf):
    m = model(spark, sf, 5)
    return tr.dense_priors(m.priors, 5, m.n_seqs).select("kmer", "cnt", F.round("prior", 9).alias("prior"))


def conditional_log_prob(spark, sf):
    return model(spark, sf).cells.select("kmer", "genus_idx", "cnt", F.round(F.col("log_p").cast("double"), 4).alias("log_p"))


def classify_all_tokens(spark, sf):
    return score.classify_tokens(tokens(spark, sf), model(spark, sf))


def _draws(spark, sf, batch):
    drawn = sample.bootstraps(tokens(spark, sf), BOOTS, 8, SEED, batch)
    return drawn.groupBy("seq_no", "bs").agg(F.count("*").alias("n"), F.sum("kmer").alias("total"), F.sum(F.col("kmer") * F.col("draw")).alias("weighted"))


def bootstrap_draws(spark, sf):
    return _draws(spark, sf, False)


def bootstrap_draws_batch(spark, sf):
    return _draws(spark, sf, True)


def _votes(spark, sf, most_cells=score.MOST_CELLS):
    m = model(spark, sf)
    return score.classify_bootstraps(tokens(spark, sf), m, BOOTS, 8, SEED, most_cells=most_cells), m


def classify_bootstrap_votes(spark, sf):
    return _votes(spark, sf)[0]


def classify_votes_blocks(spark, sf):
    """The same with the model in several blocks of genera."""
    return _votes(spark, sf, 5000)[0]


def _shown(taxonomy: Column) -> Column:
    return F.array_join(F.transform(taxonomy, lambda x: F.concat(x["taxon"], F.lit(":"), x["confidence"].cast("string"))), "|")


def consensus_by_rank(spark, sf):
    votes, m = _votes(spark, sf)
    return vote.consensus_by_rank(votes, m.genera).select("seq_no", _shown(F.col("taxonomy")).alias("consensus"))


def consensus_cumulative(spark, sf):
    votes, m = _votes(spark, sf)
    return vote.consensus_cumulative(votes, m.genera).select("seq_no", _shown(F.col("taxonomy")).alias("consensus"))


def filter_pad_format(spark, sf):
    votes, m = _votes(spark, sf)
    agreed = vote.consensus_by_rank(votes, m.genera)
    return agreed.select("seq_no", T.format_taxonomy(T.filter_confidence(F.col("taxonomy"), 8), 6).alias("classification"))


def classification_summary(spark, sf):
    done = classify_sequences(sequences(spark, sf), model(spark, sf), min_confidence=8, num_bs=BOOTS, seed=SEED)
    return summary.summarize_predictions(done)


def train_k8(spark, sf):
    """Training alone, words of 8: every stored cell of the model."""
    return model(spark, sf, 8).cells.select("kmer", "genus_idx", "cnt")


def classify_k8(spark, sf):
    """The defaults of the public calls: words of 8, 100 bootstraps, threshold 80."""
    s = sequences(spark, sf)
    return summary.summarize_predictions(classify_sequences(s, make_classifier(s)))


def _classified(rows, m):
    return classify_sequences(rows, m, min_confidence=8, num_bs=BOOTS, seed=SEED, keep_sequence=True)


def classify_without_seq_no(spark, sf):
    """Rows that were shuffled and have no number of their own."""
    rows = sequences(spark, sf).select("id", "sequence").repartition(16).dropDuplicates(["id", "sequence"])
    return _classified(rows, model(spark, sf)).select("id", F.md5("sequence").alias("sequence_md5"), "classification")


def fasta_file_classify(spark, sf):
    """A FASTA file written, and read in small and in large splits."""
    path, conf, out = fresh_path(spark, "fasta"), "spark.sql.files.maxPartitionBytes", []
    fasta.write_fasta(sequences(spark, sf), path)
    m, was = model(spark, sf), spark.conf.get(conf)
    for reading, split in (("small", "20000"), ("large", "128m")):
        spark.conf.set(conf, split)
        try:
            out.append(materialize(_classified(fasta.read_taxa_fasta(spark, path), m).select(F.lit(reading).alias("reading"), "id", F.md5("sequence").alias("sequence_md5"), "classification"), "classified"))
        finally:
            spark.conf.set(conf, was)
    return out[0].union(out[1])


def _put(spark, path, data):
    """Bytes as a file where Hadoop finds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    stream.write(bytearray(data))
    stream.close()


def fasta_gzip_by_content(spark, sf):
    """Files of both kinds, the compressed ones known by their first bytes; the text is made of the 25 nations."""
    folder = fresh_path(spark, "fasta")
    for r in table(spark, sf, "nation").collect():
        text = f">x\tEukaryota;{r.n_name}\r\nACGU\n{'ac' * r.n_nationkey}\n>second {r.n_name}\nGG\n".encode()
        _put(spark, f"{folder}/{r.n_nationkey}.fa", text if r.n_nationkey % 3 else gzip.compress(text))
    kinds = spark.createDataFrame([(f.rpartition("/")[2], fasta.is_gzip(spark, f)) for f in fasta.list_files(spark, folder)], "file string, zipped boolean")
    counted = kinds.groupBy().agg(F.count_if("zipped").alias("zipped"))
    return fasta.read_taxa_fasta(spark, folder).select("id", "sequence").crossJoin(F.broadcast(counted))  # one row


def fasta_sink(spark, sf):
    path = fresh_path(spark, "fasta")
    fasta.write_fasta(sequences(spark, sf), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n")).select(F.md5("value").alias("line_md5"), "n")


def table_files(spark, sf):
    """Sequences written as CSV and read by name, by sniffing, and as a training set made of a FASTA file."""
    s = sequences(spark, sf).select("id", "sequence").where("sequence <> ''")
    folder = fresh_path(spark, "tables")
    fasta.write_csv(s, f"{folder}/a.csv")
    s.write.csv(f"{folder}/b", header=True, sep="\t")
    fasta.write_fasta(s.withColumn("seq_no", F.lit(0)), f"{folder}/c")
    reads = [fasta.read_table(spark, f"{folder}/a.csv"), fasta.read_table(spark, f"{folder}/b"), fasta.write_training_set(spark, f"{folder}/c", f"{folder}/d"), fasta.write_training_set(spark, f"{folder}/c", f"{folder}/e", "parquet")]
    rows = [x.select(F.lit(i).alias("reading"), "id", F.md5("sequence").alias("sequence_md5")) for i, x in enumerate(reads)]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def tax_file(spark, sf):
    path = fresh_path(spark, "tax")
    _places(spark, sf).select(F.concat("n_name", F.lit("\tBacteria;"), "r_name", F.lit(";c;o;f;"), "n_name", F.lit(";"))).write.text(path)
    return fasta.read_tax(spark, path).select("id", "taxonomy", "Kingdom", "Phylum", "Genus")


def model_from_config(spark, sf):
    """A model saved, and loaded by the name that a JSON configuration gives."""
    folder = fresh_path(spark, "models")
    model_store.save_model(model(spark, sf), f"{folder}/m", "gzip")
    _put(spark, f"{folder}/config.json", json.dumps({"db_name": "x", "model_dir": folder, "model": "m"}).encode())
    return score.classify_tokens(tokens(spark, sf), model_store.load_db(spark, f"{folder}/config.json"))


def model_dense_import(spark, sf):
    """A float16 matrix of words of 3 and 5 genera, with values that float16 holds exactly."""
    folder = fresh_path(spark, "models")
    words, genera = np.arange(64)[:, None], np.arange(5)[None, :]
    _put(spark, f"{folder}/matrix", (-(words * (genera + 3) % 13) / 4).astype("<f2").tobytes())
    names = io.BytesIO()
    np.save(names, np.array([f"g{i}" for i in range(5)]))
    _put(spark, f"{folder}/names.npy", names.getvalue())
    m = model_store.load_db(spark, {"model": "matrix", "genera": "names.npy", "model_dir": folder, "model_shape": [64, 5]})
    return score.classify_tokens(tokens(spark, sf, 3), m, most_cells=128).join(m.genera.select("genus_idx", "genus"), "genus_idx")


def train_case_sensitive(spark, sf):
    return make_classifier(_mixed_case(spark, sf), SIZE, fold_case=False).cells.select("kmer", "genus_idx", "cnt")


def base4_index(spark, sf):
    """Words as strings turned into indices, those with other letters dropped."""
    words = K.base4_list(K.all_kmers(F.substring("sequence", 1, 200), 4))
    return sequences(spark, sf).select("seq_no", md5_list(K.base4_to_index(words)).alias("indices_md5"))


def mode_percent(spark, sf):
    return vote.mode_percent(sequences(spark, sf).withColumn("phylum", F.get(F.split("id", ";"), F.lit(1))), ["phylum"], "id")


def _places(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey)


def fix_taxonomy(spark, sf):
    return _places(spark, sf).select("n_nationkey", T.fix_taxonomy(F.concat("r_name", F.lit(";"), "n_name", F.lit(";;"))).alias("lineage"), T.format_unsplit(F.concat("r_name", F.lit(";"), "n_name"), 4).alias("unsplit"))


def fix_qiime_taxa(spark, sf):
    return _places(spark, sf).select("n_nationkey", T.fix_qiime_taxa(F.concat(F.lit("k__"), "r_name", F.lit("; g__x__"), "n_name")).alias("lineage"))


def tax_table(spark, sf):
    rows = _places(spark, sf).select(F.col("n_nationkey").cast("string").alias("id"), F.concat_ws(";", F.lit("Bacteria"), "r_name", "n_name", F.lit("o"), F.lit("f"), F.lit("g;")).alias("taxonomy"))
    return fasta.taxa_columns(rows)


def filter_train_set(spark, sf):
    customer, places = table(spark, sf, "customer"), _places(spark, sf)
    marked = F.when(F.col("c_custkey") % 7 == 0, F.lit(";Candidatus")).when(F.col("c_custkey") % 5 == 0, F.lit(";more;ranks")).otherwise(F.lit(";g"))
    ids = customer.join(places, customer.c_nationkey == places.n_nationkey).select("c_custkey", F.concat("r_name", F.lit(";"), "n_name", F.lit(";"), "c_mktsegment", marked).alias("id"))
    return curate.filter_train_set(ids)


def down_sample(spark, sf):
    return sample.down_sample(table(spark, sf, "customer"), "c_nationkey", 20, SEED, "c_custkey").select("c_custkey", "c_nationkey")


def holdout_accuracy(spark, sf):
    rest, test = sample.hold_out(sequences(spark, sf), 50, SEED)
    m = make_classifier(rest, SIZE)
    best = score.classify_tokens(tr.tokenise(test, SIZE), m).join(m.genera, "genus_idx")
    return summary.accuracy(test.join(best, "seq_no").select("id", F.col("genus").alias("observed"))).select(F.round("accuracy", 6).alias("accuracy"), "n")


def prevalence(spark, sf):
    return summary.prevalence(table(spark, sf, "events"), "value", 10, ["event_type"])


def union_reference_sets(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("id"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("id"), F.col("s_suppkey").alias("key"))
    return curate.union_reference_sets(a, b, b)


def json_records(spark, sf):
    e = table(spark, sf, "events")
    record = F.concat(F.lit('{"result": {"uids": ["1"], "'), F.col("event_id").cast("string"), F.lit('": {"uid": "'), F.col("event_id").cast("string"), F.lit('", "rank": "'), "event_type", F.lit('", "taxid": '), F.get_json_object("props", "$.k"), F.lit("}}}"))
    return external.summarize_taxa_ids(e.select(record.alias("value"))).select("key", "uid", "rank", "taxid")


def map_keys_int(spark, sf):
    e = table(spark, sf, "events").select("event_id", T.keys_to_int(F.create_map(F.col("user_id").cast("string"), "event_type")).alias("m"))
    return e.select("event_id", F.explode("m").alias("user_key", "kind"))


def sort_by_indices(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus").alias("v"), F.array(F.col("l_suppkey"), F.col("l_partkey")).alias("o"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(T.sort_by(F.col("v"), F.col("o")), ",").alias("sorted"))


def incertae_fill(spark, sf):
    region = F.when(F.col("r_regionkey") != 2, F.concat(F.lit("phylum__"), "r_name", F.lit(";")))
    text = F.concat(F.lit("domain__Bacteria; "), F.coalesce(region, F.lit("")), F.lit("order__"), "n_name")
    return curate.lineages_from_fields(_places(spark, sf).select("n_nationkey", text.alias("fields")), "fields").select("n_nationkey", "lineage")


_NAMES = (
    fasta_roundtrip, header_ids, base4_encode, kmer_positions, kmer_strings, kmer_distinct, kmer_case_sensitive, padded_tokens, base10_base4_nucleotide,
    genus_dictionary, genus_sizes, genus_kmer_counts, word_priors, word_priors_dense, conditional_log_prob, classify_all_tokens, bootstrap_draws,
    bootstrap_draws_batch, classify_bootstrap_votes, classify_votes_blocks, classify_without_seq_no, fasta_file_classify, fasta_gzip_by_content, fasta_sink, table_files, tax_file,
    model_from_config, model_dense_import, train_case_sensitive, base4_index, consensus_by_rank, consensus_cumulative, filter_pad_format, classification_summary,
    train_k8, classify_k8, mode_percent, fix_taxonomy, fix_qiime_taxa, tax_table, filter_train_set, down_sample, holdout_accuracy, prevalence, union_reference_sets,
    json_records, map_keys_int, sort_by_indices, incertae_fill,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


# The same in SQL: blocks of common table expressions, each after those it needs.

SEQUENCES = f"""seqs AS (SELECT doc_id AS seq_no, concat_ws(';', 'Bacteria', lang, lang || '_' || length(coalesce(source, 'none')), lang || '_' || left(coalesce(source, 'none'), 4), lang || '_f_' || coalesce(source, 'none'), lang || '_' || coalesce(source, 'none')) AS id,
  translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{STAND_FOR}') AS sequence FROM documents)"""


def _windows(k: int, source: str = "seqs", digits: str = "translate(regexp_replace(upper(sequence), '[^ACGT]', 'N', 'g'), 'ACGT', '0123')", name: str = "windows") -> str:
    value = " + ".join(f"CAST(substr(word, {j + 1}, 1) AS INTEGER) * {4 ** (k - 1 - j)}" for j in range(k))
    return f"""{name} AS (SELECT seq_no, {value} AS kmer FROM (SELECT seq_no, substr(d, i, {k}) AS word FROM (SELECT seq_no, d, CAST(unnest(range(1, length(d) - {k - 2})) AS INTEGER) AS i FROM (SELECT seq_no, {digits} AS d FROM {source})) WHERE NOT contains(substr(d, i, {k}), 'N')))"""


_CASE_SENSITIVE = "translate(regexp_replace(sequence, '[^ACGT]', 'N', 'g'), 'ACGT', '0123')"


def _model(k: int, trained: str = "seqs", windows: str = "") -> str:
    return f"""{windows or _windows(k)}, toks AS (SELECT DISTINCT seq_no, kmer FROM windows),
genera AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS genus_idx, id AS genus, count(*) AS n_seqs FROM {trained} GROUP BY id),
counts AS (SELECT kmer, genus_idx, count(*) AS cnt FROM toks JOIN {trained} USING (seq_no) JOIN genera ON genus = id GROUP BY kmer, genus_idx),
priors AS (SELECT kmer, CAST(sum(cnt) AS BIGINT) AS cnt, (sum(cnt) + 0.5::DOUBLE) / ((SELECT count(*) FROM {trained}) + 1) AS prior FROM counts GROUP BY kmer),
dense AS (SELECT p.kmer, g.genus_idx, ln((coalesce(c.cnt, 0) + prior) / (n_seqs + 1)) AS log_p FROM priors p CROSS JOIN genera g LEFT JOIN counts c ON c.kmer = p.kmer AND c.genus_idx = g.genus_idx)"""


_LISTS = "lists AS (SELECT seq_no, list_sort(list(kmer)) AS kmers FROM toks GROUP BY seq_no)"


def _mixed_sql(source: str, c: str) -> str:
    """``source`` with column ``c`` scrambled as ``operators.sample`` does."""
    for factor, shift in zip(sample.FACTORS, sample.SHIFTS, strict=True):
        source = f"(SELECT * REPLACE (xor(a, a >> {shift}) AS a) FROM (SELECT * EXCLUDE ({c}), ({c} * {factor} + {sample.ADD}) % {sample.PRIME} AS a FROM {source}))"
        source = f"(SELECT * EXCLUDE (a), a AS {c} FROM {source})"
    return source


def _drawn(size: str, key: str = "seq_no", boots: int = BOOTS, seed: int = SEED) -> str:
    """Draws of ``lists``: ``drawn(seq_no, bs, draw, kmer)``. ``key`` seeds them."""
    digests = f"(SELECT seq_no, kmers, md5('{seed}:' || {key}) AS d FROM lists JOIN seqs USING (seq_no))"
    words = f"(SELECT seq_no, kmers, CAST('0x' || substr(d, 1, 7) AS BIGINT) AS s, CAST('0x' || substr(d, 8, 7) AS BIGINT) AS second, unnest(range({boots})) AS bs FROM {digests})"
    start = _mixed_sql(f"(SELECT * REPLACE ((s + bs * {sample.BS_STEP}) % {sample.PRIME} AS s) FROM {words})", "s")
    start = _mixed_sql(f"(SELECT * REPLACE ((s + second) % {sample.PRIME} AS s) FROM {start})", "s")
    each = _mixed_sql(f"(SELECT * REPLACE ((s + draw * {sample.DRAW_STEP}) % {sample.PRIME} AS s) FROM (SELECT *, unnest(range({size} // 8)) AS draw FROM {start}))", "s")
    return f"{_LISTS}, drawn AS (SELECT seq_no, bs, draw, kmers[1 + s % len(kmers)] AS kmer FROM {each})"


_BEST = "row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, genus_idx) = 1"


def _votes_sql(k: int = SIZE, key: str = "seq_no", boots: int = BOOTS, seed: int = SEED) -> str:
    """Votes over stored cells: where a genus lacks a word only its size and the word's prior count, and the prior is the same for all."""
    return f"""{SEQUENCES}, {_model(k)}, {_drawn("len(kmers)", key, boots, seed)},
times AS (SELECT seq_no, bs, kmer, count(*) AS t FROM drawn GROUP BY ALL),
hits AS (SELECT seq_no, bs, genus_idx, sum(t * (ln(c.cnt + prior) - ln(prior))) AS gain FROM times JOIN counts c USING (kmer) JOIN priors USING (kmer) GROUP BY seq_no, bs, genus_idx),
sizes AS (SELECT seq_no, bs, sum(t) AS n FROM times GROUP BY ALL),
scores AS (SELECT s.seq_no, s.bs, g.genus_idx, round(coalesce(gain, 0) - n * ln(n_seqs + 1.0), 9) AS score FROM sizes s CROSS JOIN genera g LEFT JOIN hits h ON h.seq_no = s.seq_no AND h.bs = s.bs AND h.genus_idx = g.genus_idx),
votes AS (SELECT seq_no, CAST(bs AS INTEGER) AS bs, genus_idx FROM scores QUALIFY {_BEST.format(keys="seq_no, bs")})"""


VOTES = _votes_sql()


def _ranks_sql(votes: str) -> str:
    return f"""{votes}, named AS (SELECT seq_no, bs, string_split(genus, ';') AS parts FROM votes JOIN genera USING (genus_idx)),
ranks AS (SELECT seq_no, bs, r, parts[r] AS taxon FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS r FROM named)),
agreed AS (SELECT seq_no, r, taxon, count(*) AS conf FROM ranks GROUP BY seq_no, r, taxon QUALIFY row_number() OVER (PARTITION BY seq_no, r ORDER BY count(*) DESC, min(bs)) = 1)"""


def _formatted_sql(votes: str, least: int = 8) -> str:
    return f"""{_ranks_sql(votes)}, kept AS (SELECT * FROM agreed WHERE conf >= {least} OR (r = 1 AND seq_no NOT IN (SELECT seq_no FROM agreed WHERE conf >= {least}))),
lists6 AS (SELECT seq_no, list(taxon ORDER BY r) AS taxa, list(conf ORDER BY r) AS confs FROM kept GROUP BY seq_no),
padded AS (SELECT seq_no, list_concat(list_transform(range(len(taxa)), lambda i: taxa[i + 1] || '(' || confs[i + 1] || ')'), list_transform(range(greatest(6 - len(taxa), 0)), lambda i: taxa[-1] || '_unclassified(' || confs[-1] || ')')) AS shown FROM lists6),
formatted AS (SELECT seq_no, array_to_string(shown, ';') AS classification FROM padded)"""


def _classified_sql(k: int = SIZE, boots: int = BOOTS, seed: int = SEED, least: int = 8) -> str:
    """``whole(seq_no, id, sequence, classification)``: draws seeded by the sequences themselves."""
    return f"""{_formatted_sql(_votes_sql(k, "md5(sequence)", boots, seed), least)},
whole AS (SELECT s.seq_no, s.id, s.sequence, coalesce(classification, 'Unclassified(0)' || repeat(';Unclassified_unclassified(0)', 5)) AS classification FROM seqs s LEFT JOIN formatted USING (seq_no))"""


def _summary_sql(classified: str) -> str:
    return f"""WITH {classified}, ranked AS (SELECT seq_no, id, classification, {_RANK_COLUMNS} FROM (SELECT *, string_split(classification, ';') AS p FROM whole))
SELECT *, concat_ws(';', Kingdom, Phylum, "Class", "Order", Family, Genus) AS observed, concat_ws(';', 'k__' || Kingdom, 'p__' || Phylum, 'c__' || "Class", 'o__' || "Order", 'f__' || Family, 'g__' || Genus) AS lineage FROM ranked""".replace("AS Order", 'AS "Order"').replace("AS Class", 'AS "Class"')


_PLACES = "FROM nation JOIN region ON n_regionkey = r_regionkey"
_RANK_COLUMNS = ", ".join(f"regexp_replace(p[{i + 1}], '\\(\\d+\\)', '', 'g') AS {r}" for i, r in enumerate(T.RANKS[:6]))
_MIXED = f"translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{LETTERS + LETTERS.upper()}', '{STAND_FOR + STAND_FOR.lower()}')"


@lru_cache
def oracle_sql() -> dict[str, str]:
    base = f"WITH {SEQUENCES}"
    trained = f"{base}, {_model(SIZE)}"
    per_list = "SELECT s.seq_no, coalesce(len(kmers), 0) AS n, md5(coalesce(array_to_string(kmers, ','), '')) AS kmers_md5 FROM {of} s LEFT JOIN lists USING (seq_no)"
    draws = "SELECT seq_no, CAST(bs AS INTEGER) AS bs, count(*) AS n, CAST(sum(kmer) AS BIGINT) AS total, CAST(sum(kmer * draw) AS BIGINT) AS weighted FROM drawn GROUP BY seq_no, bs"
    votes = f"WITH {VOTES} SELECT * FROM votes"
    held = f"held AS (SELECT * FROM seqs ORDER BY md5('{SEED}:' || seq_no), seq_no LIMIT 50), rest AS (SELECT * FROM seqs WHERE seq_no NOT IN (SELECT seq_no FROM held))"
    return {
        "fasta_roundtrip": f"{base} SELECT seq_no, id, md5(sequence) AS sequence_md5 FROM seqs",
        "header_ids": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'id' || doc_id ELSE 'Bacteria;a' || lang END AS id FROM documents",
        "base4_encode": f"{base} SELECT seq_no, length(sequence) AS n, md5(translate(sequence, 'ACGT', '0123')) AS digits_md5 FROM seqs",
        "kmer_positions": f"{base}, {_windows(SIZE)} SELECT kmer, count(*) AS n FROM windows GROUP BY kmer",
        "kmer_strings": f"{base} SELECT word, count(*) AS n FROM (SELECT substr(sequence, CAST(i AS INTEGER), 3) AS word FROM (SELECT sequence, unnest(range(1, length(sequence) - 1)) AS i FROM seqs)) GROUP BY word",
        "kmer_distinct": f"{base}, {_windows(SIZE)}, toks AS (SELECT DISTINCT seq_no, kmer FROM windows), {_LISTS} {per_list.format(of='seqs')}",
        "kmer_case_sensitive": f"WITH mixed AS (SELECT doc_id AS seq_no, {_MIXED} AS sequence FROM documents), {_windows(SIZE, 'mixed', _CASE_SENSITIVE)}, toks AS (SELECT DISTINCT seq_no, kmer FROM windows), {_LISTS} {per_list.format(of='mixed')}",
        "padded_tokens": f"{base}, {_windows(SIZE)} SELECT s.seq_no, {4**SIZE}::BIGINT AS n, {4**SIZE} - count(DISTINCT kmer) AS n_pad FROM seqs s LEFT JOIN windows USING (seq_no) GROUP BY s.seq_no",
        "base10_base4_nucleotide": f"{base}, {_windows(SIZE)} SELECT kmer, digits, translate(digits, '0123', 'ACGT') AS bases FROM (SELECT DISTINCT kmer, CAST(kmer // 64 AS VARCHAR) || (kmer // 16 % 4) || (kmer // 4 % 4) || (kmer % 4) AS digits FROM windows)",
        "genus_dictionary": f"{base} SELECT seq_no, CAST(dense_rank() OVER (ORDER BY id) - 1 AS INTEGER) AS genus_idx, id FROM seqs",
        "genus_sizes": f"{trained} SELECT * FROM genera",
        "genus_kmer_counts": f"{trained} SELECT * FROM counts",
        "word_priors": f"{trained} SELECT kmer, cnt, round(prior, 9) AS prior FROM priors",
        "word_priors_dense": f"{base}, {_model(5)} SELECT CAST(i AS INTEGER) AS kmer, coalesce(cnt, 0) AS cnt, round(coalesce(prior, 0.5::DOUBLE / ((SELECT count(*) FROM seqs) + 1)), 9) AS prior FROM range(1024) t(i) LEFT JOIN priors ON kmer = i",
        "conditional_log_prob": f"{trained} SELECT kmer, genus_idx, cnt, round(CAST(CAST(log_p AS FLOAT) AS DOUBLE), 4) AS log_p FROM dense JOIN counts USING (kmer, genus_idx)",
        "classify_all_tokens": f"{trained} SELECT seq_no, genus_idx FROM (SELECT seq_no, genus_idx, round(sum(log_p), 9) AS score FROM toks JOIN dense USING (kmer) GROUP BY seq_no, genus_idx) QUALIFY {_BEST.format(keys='seq_no')}",
        "bootstrap_draws": f"{trained}, {_drawn('len(kmers)')} {draws}",
        "bootstrap_draws_batch": f"{trained}, {_drawn('(SELECT max(len(kmers)) FROM lists)')} {draws}",
        "classify_bootstrap_votes": votes,
        "classify_votes_blocks": votes,
        "classify_without_seq_no": f"WITH {_classified_sql()} SELECT DISTINCT id, md5(sequence) AS sequence_md5, classification FROM whole",
        "fasta_file_classify": f"WITH {_classified_sql()} SELECT unnest(['small', 'large']) AS reading, id, md5(sequence) AS sequence_md5, classification FROM whole",
        "fasta_gzip_by_content": "WITH n AS (SELECT *, (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 0) AS zipped FROM nation) SELECT 'Eukaryota;' || n_name AS id, 'ACGT' || repeat('ac', n_nationkey) AS sequence, zipped FROM n UNION ALL SELECT 'second ' || n_name, 'GG', zipped FROM n",
        "fasta_sink": f"{base} SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT '>' || id AS line FROM seqs UNION ALL SELECT sequence FROM seqs) GROUP BY line",
        "table_files": f"{base} SELECT CAST(reading AS INTEGER) AS reading, id, md5(sequence) AS sequence_md5 FROM seqs, range(4) t(reading) WHERE sequence <> ''",
        "tax_file": f"SELECT n_name AS id, 'Bacteria;' || r_name || ';c;o;f;' || n_name AS taxonomy, 'Bacteria' AS Kingdom, r_name AS Phylum, n_name AS Genus {_PLACES}",
        "model_from_config": f"{trained} SELECT seq_no, genus_idx FROM (SELECT seq_no, genus_idx, round(sum(log_p), 9) AS score FROM toks JOIN dense USING (kmer) GROUP BY seq_no, genus_idx) QUALIFY {_BEST.format(keys='seq_no')}",
        "model_dense_import": f"{base}, {_windows(3)}, toks AS (SELECT DISTINCT seq_no, kmer FROM windows) SELECT seq_no, CAST(g AS INTEGER) AS genus_idx, 'g' || g AS genus FROM (SELECT seq_no, g, sum(-(kmer * (g + 3) % 13) / 4.0) AS score FROM toks, range(5) t(g) GROUP BY seq_no, g) QUALIFY row_number() OVER (PARTITION BY seq_no ORDER BY score DESC, g) = 1",
        "train_case_sensitive": f"WITH seqs AS (SELECT doc_id AS seq_no, s.id, {_MIXED} AS sequence FROM documents JOIN (WITH {SEQUENCES} SELECT seq_no AS doc_id, id FROM seqs) s USING (doc_id)), {_model(SIZE, windows=_windows(SIZE, 'seqs', _CASE_SENSITIVE))} SELECT * FROM counts",
        "base4_index": f"{base}, cut AS (SELECT seq_no, substr(sequence, 1, 200) AS s FROM seqs), w AS (SELECT seq_no, i, substr(s, i, 4) AS word FROM (SELECT *, CAST(unnest(range(1, length(s) - 2)) AS INTEGER) AS i FROM cut)), x AS (SELECT seq_no, string_agg(CAST({' + '.join(f"(strpos('ACGT', substr(word, {j + 1}, 1)) - 1) * {4 ** (3 - j)}" for j in range(4))} AS VARCHAR), ',' ORDER BY i) AS l FROM w WHERE NOT contains(word, 'N') GROUP BY seq_no) SELECT seq_no, md5(coalesce(l, '')) AS indices_md5 FROM seqs LEFT JOIN x USING (seq_no)",
        "consensus_by_rank": f"WITH {_ranks_sql(VOTES)} SELECT seq_no, string_agg(taxon || ':' || conf, '|' ORDER BY r) AS consensus FROM agreed GROUP BY seq_no",
        "consensus_cumulative": f"""WITH {VOTES}, named AS (SELECT seq_no, string_split(genus, ';') AS parts FROM votes JOIN genera USING (genus_idx)),
            paths AS (SELECT seq_no, r, array_to_string(parts[1:r], ';') AS path FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS r FROM named)),
            best AS (SELECT seq_no, r, path, count(*) AS n FROM paths GROUP BY seq_no, r, path QUALIFY row_number() OVER (PARTITION BY seq_no, r ORDER BY count(*) DESC, path) = 1),
            deep AS (SELECT seq_no, string_split(max_by(path, r), ';') AS parts FROM best GROUP BY seq_no)
            SELECT seq_no, string_agg(parts[r] || ':' || CAST(trunc(n / {BOOTS}::DOUBLE * 100) AS INTEGER), '|' ORDER BY r) AS consensus FROM best JOIN deep USING (seq_no) GROUP BY seq_no""",
        "filter_pad_format": f"WITH {_formatted_sql(VOTES)} SELECT * FROM formatted",
        "classification_summary": _summary_sql(_classified_sql()),
        "classify_k8": _summary_sql(_classified_sql(8, 100, 0, 80)),
        "train_k8": f"{base}, {_model(8)} SELECT * FROM counts",
        "mode_percent": f"{base}, n AS (SELECT string_split(id, ';')[2] AS phylum, id AS label, count(*) AS n FROM seqs GROUP BY ALL) SELECT phylum, label, CAST(trunc(n / (sum(n) OVER (PARTITION BY phylum))::DOUBLE * 100) AS INTEGER) AS percent FROM n QUALIFY row_number() OVER (PARTITION BY phylum ORDER BY n DESC, label) = 1",
        "fix_taxonomy": f"SELECT n_nationkey, r_name || ';' || n_name || repeat(';' || n_name || '_unclassified', 4) AS lineage, r_name || ';' || n_name || repeat(';' || n_name || '_unclassified', 2) AS unsplit {_PLACES}",
        "fix_qiime_taxa": f"SELECT n_nationkey, r_name || ';' || n_name AS lineage {_PLACES}",
        "tax_table": f"SELECT CAST(n_nationkey AS VARCHAR) AS id, 'Bacteria;' || r_name || ';' || n_name || ';o;f;g' AS taxonomy, 'Bacteria' AS Kingdom, r_name AS Phylum, n_name AS \"Class\", 'o' AS \"Order\", 'f' AS Family, 'g' AS Genus {_PLACES}",
        "filter_train_set": f"""WITH ids AS (SELECT c_custkey, r_name || ';' || n_name || ';' || c_mktsegment || CASE WHEN c_custkey % 7 = 0 THEN ';Candidatus' WHEN c_custkey % 5 = 0 THEN ';more;ranks' ELSE ';g' END AS id FROM customer JOIN (SELECT * {_PLACES}) ON c_nationkey = n_nationkey),
            kept AS (SELECT *, CAST(length(id) - length(replace(id, ';', '')) AS INTEGER) AS levels FROM ids WHERE NOT regexp_matches(id, '{"|".join(curate.REMOVE)}'))
            SELECT * FROM kept WHERE levels = (SELECT CAST(trunc(avg(levels)) AS INTEGER) FROM kept)""",
        "down_sample": f"SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('{SEED}:' || c_custkey), c_custkey) <= 20",
        "holdout_accuracy": f"{base}, {held}, {_model(SIZE, 'rest')}, best AS (SELECT seq_no, genus_idx FROM (SELECT seq_no, genus_idx, round(sum(log_p), 9) AS score FROM toks SEMI JOIN held USING (seq_no) JOIN dense USING (kmer) GROUP BY seq_no, genus_idx) QUALIFY {_BEST.format(keys='seq_no')}) SELECT round(avg(CAST(id = genus AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM held JOIN best USING (seq_no) JOIN genera USING (genus_idx)",
        "prevalence": "SELECT event_type, CAST(trunc(count(*) FILTER (WHERE value > 10 AND NOT isnan(value)) / count(*)::DOUBLE * 100) AS INTEGER) AS prevalence FROM events GROUP BY event_type",
        "union_reference_sets": "SELECT c_custkey AS key, c_name AS id FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier",
        "json_records": "SELECT CAST(event_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS uid, event_type AS rank, CAST(json_extract(props, '$.k') AS BIGINT) AS taxid FROM events",
        "map_keys_int": "SELECT event_id, CAST(user_id AS INTEGER) AS user_key, event_type AS kind FROM events",
        "sort_by_indices": "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey <= l_partkey THEN l_returnflag || ',' || l_linestatus ELSE l_linestatus || ',' || l_returnflag END AS sorted FROM lineitem",
        "incertae_fill": f"SELECT n_nationkey, concat_ws(';', 'Bacteria', p, regexp_replace(p, '_incertae_sedis$', '') || '_incertae_sedis', o, o || '_incertae_sedis', o || '_incertae_sedis') AS lineage FROM (SELECT n_nationkey, CASE WHEN r_regionkey = 2 THEN 'Bacteria_incertae_sedis' ELSE replace(r_name, ' ', '_') END AS p, replace(n_name, ' ', '_') AS o {_PLACES})",
    }
