"""Training, sampling, scoring, votes and the public calls: known values, traps and invariants."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ribospark.functions import taxonomy as T
from ribospark.operators import sample, score, summary, vote
from ribospark.operators.train import dense_priors, tokenise, train
from ribospark.plans.classify import classify_sequences, make_classifier

TRIO = [(0, "A", "ATGCGCTA"), (1, "B", "ATGCGCTC"), (2, "B", "ATGCGCTC")]
LINEAGES = ["A;a;A", "A;a;B", "A;a;C", "A;b;C"]


def table(spark, rows):
    return spark.createDataFrame(rows, "seq_no long, id string, sequence string")


def votes_of(spark, genera, cast):
    g = spark.createDataFrame([(i, x, 1) for i, x in enumerate(genera)], "genus_idx int, genus string, n_seqs long")
    return spark.createDataFrame([(1, b, x) for b, x in enumerate(cast)], "seq_no long, bs int, genus_idx int"), g


def taxa(df):
    return [(x.taxon, x.confidence) for x in df.first().taxonomy]


def test_priors_and_conditional_probabilities(spark):
    m = train(table(spark, TRIO), 3)
    priors = {r.kmer: (r.cnt, r.prior) for r in dense_priors(m.priors, 3, m.n_seqs).collect()}
    assert len(priors) == 64 and [priors[k][1] for k in (25, 28, 29, 62)] == [0.875, 0.375, 0.625, 0.125]
    cells = {(r.kmer, r.genus_idx): r.log_p for r in m.cells.collect()}
    want = {(25, 0): 1.875 / 2, (25, 1): 2.875 / 3, (28, 0): 1.375 / 2, (29, 1): 2.625 / 3}
    assert all(abs(cells[k] - math.log(v)) < 1e-6 for k, v in want.items()) and (28, 1) not in cells
    assert [(r.genus_idx, r.genus, r.n_seqs) for r in m.genera.orderBy("genus_idx").collect()] == [(0, "A", 1), (1, "B", 2)]


def dense_vote(tokens, rows, k):
    """Argmax over every genus of the plain formula."""
    from ribospark.functions.kmer_arrays import kmer_array

    genera = sorted({i for _, i, _ in rows})
    sets = [(i, set(kmer_array(s, k, True).tolist())) for _, i, s in rows]
    total = []
    for g in genera:
        own = [s for i, s in sets if i == g]
        p = lambda w: (sum(w in s for _, s in sets) + 0.5) / (len(sets) + 1)
        total.append(round(sum(math.log((sum(w in s for s in own) + p(w)) / (len(own) + 1)) for w in tokens), 9))
    return total.index(max(total))


@pytest.mark.parametrize(("k", "query", "genus"), [(3, "ATGCGCTC", 1), (2, "CTGCGCTA", 0)])
def test_votes_of_all_tokens(spark, k, query, genus):
    rows = TRIO if k == 3 else [(0, "A", "CTGCGCTA"), (1, "B", "ATGCGCTC"), (2, "B", "ATGCGCTC")]
    q = tokenise(table(spark, [(9, "q", query)]), k)
    assert score.classify_tokens(q, train(table(spark, rows), k)).first().genus_idx == genus


def random_rows(n=60, seed=1):
    import random

    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(9)]
    rows = []
    for i in range(n):
        s = list(base[i % 9])
        for _ in range(8):
            s[rng.randrange(120)] = rng.choice("ACGTN")
        rows.append((i, f"Bacteria;p{i % 3};g{i % 9}", "".join(s)))
    return rows


def test_blocks_and_plain_scores_agree(spark):
    rows = random_rows()
    m, tokens = train(table(spark, rows), 4), tokenise(table(spark, [*rows, (99, "q", "TTTTTTTTTTTTTTTTTTTTTTTT")]), 4)
    most = -(-m.cells.count() // 3)
    assert len([*score.blocks(m, most)]) >= 3 and len([*score.blocks(m)]) == 1
    for batch in (False, True):
        a, b = ({(r.seq_no, r.bs): r.genus_idx for r in score.classify_bootstraps(tokens, m, 6, 8, 3, batch, most_cells=n).collect()} for n in (most, score.MOST_CELLS))
        assert a == b and len(a) == (61 if batch else 60) * 6
    drawn = sample.bootstraps(tokens, 6, 8, 3).where("seq_no < 4").groupBy("seq_no", "bs").agg(F.collect_list("kmer").alias("w")).collect()
    votes = {(r.seq_no, r.bs): r.genus_idx for r in score.classify_bootstraps(tokens, m, 6, 8, 3, most_cells=most).collect()}
    assert {(r.seq_no, r.bs): dense_vote(r.w, rows, 4) for r in drawn}.items() <= votes.items()


def test_narrow_matrices_give_the_same_votes(spark, monkeypatch):
    m = train(table(spark, random_rows()), 4)
    block = next(score.blocks(m))
    kmers = block.words[::2]
    drawn = sample.draw_positions(1, "x", 50, 30, len(kmers))
    whole = block.best(kmers, drawn)
    monkeypatch.setattr(score, "MATRIX", 1)
    assert all((a == b).all() for a, b in zip(whole, block.best(kmers, drawn), strict=True))


def test_draws_are_uniform():
    import numpy as np

    drawn = sample.draw_positions(0, "a key", 4000, 50, 100)
    counts = np.bincount(drawn.ravel(), minlength=100)
    assert ((counts - 2000) ** 2 / 2000).sum() < 150  # 99 degrees of freedom
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(drawn[:-1, 0], drawn[1:, 0])[0, 1]) < 0.06


def test_folded_and_native_training_agree(spark, monkeypatch):
    from ribospark.operators import train as tr

    monkeypatch.setattr(tr, "FOLD", 50)
    rows = table(spark, [*random_rows(), (100, "x", None), (101, "x", "acgtnacgtA")])
    for fold in (True, False):
        a, b = (sorted(map(tuple, train(rows, 4, fold, native=n).cells.collect())) for n in (False, True))
        assert a == b and a


@pytest.mark.parametrize("shuffled", [lambda df: df.repartition(16), lambda df: df.dropDuplicates(["id"])])
def test_rows_without_numbers_keep_their_classification(spark, shuffled):
    rows = [(f"Bacteria;p{i};g{i}", s) for i, (_, _, s) in enumerate(random_rows(48))]
    df = spark.createDataFrame(rows, "id string, sequence string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = classify_sequences(shuffled(df), make_classifier(df), n_levels=3, num_bs=20, min_confidence=16, keep_sequence=True)
        assert got.columns == ["id", "sequence", "classification"]
        plain = {r.sequence: r.classification for r in classify_sequences(df, make_classifier(df), n_levels=3, num_bs=20, min_confidence=16, keep_sequence=True).collect()}
        seen = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(seen) == 48 and all(r.classification == plain[r.sequence] for r in seen)
    assert sum(r.classification.startswith(f"{r.id.rpartition(';')[0]}(") or r.id.split(";")[2] in r.classification for r in seen) >= 40


def test_bootstraps_do_not_depend_on_partitions(spark):
    tokens = tokenise(table(spark, random_rows(20)), 4)
    draws = lambda df: sorted(map(tuple, sample.bootstraps(df, 5, 8, 1).collect()))
    assert draws(tokens) == draws(tokens.repartition(7))
    sizes = {r.seq_no: (len(r.kmers), set(r.kmers)) for r in tokens.collect()}
    seen = Counter((s, b) for s, b, _, _ in draws(tokens))
    assert all(n == sizes[s][0] // 8 for (s, _), n in seen.items()) and all(k in sizes[s][1] for s, _, _, k in draws(tokens))


def test_batch_draws_follow_the_longest_sequence(spark):
    tokens = tokenise(table(spark, [(1, "x", "ACGTACGGTTAACC" * 9), (2, "y", "ACGGTCA")]), 4)
    longest = max(len(r.kmers) for r in tokens.collect())
    assert {(r.seq_no, r["count"]) for r in sample.bootstraps(tokens, 1, 8, 0, True).groupBy("seq_no").count().collect()} == {(1, longest // 8), (2, longest // 8)}


def test_live_vote_counts_ranks_apart_and_takes_the_first_seen(spark):
    assert taxa(vote.consensus_by_rank(*votes_of(spark, LINEAGES, [3, 0, 0, 3, 1]))) == [("A", 5), ("a", 3), ("C", 2)]
    assert taxa(vote.consensus_by_rank(*votes_of(spark, ["B;x", "A;y"], [0, 1]))) == [("B", 1), ("x", 1)]


def test_cumulative_vote_truncates_and_takes_the_smallest_label(spark):
    assert taxa(vote.consensus_cumulative(*votes_of(spark, LINEAGES, [0, 0, 0, 0, 3]))) == [("A", 100), ("a", 80), ("A", 80)]
    assert taxa(vote.consensus_cumulative(*votes_of(spark, ["B;x", "A;y"], [0, 1]))) == [("A", 50), ("y", 50)]
    assert taxa(vote.consensus_cumulative(*votes_of(spark, ["A", "B"], [0] * 29 + [1] * 71)))[0] == ("B", 71)


def test_truncated_percentages(spark):
    df = spark.createDataFrame([("g", "A;a;A")] * 3 + [("g", "A;a;B")], "k string, v string")
    assert tuple(vote.mode_percent(df, ["k"], "v").first())[1:] == ("A;a;A", 75)
    df = spark.createDataFrame([("g", "x")] * 58 + [("g", f"y{i}") for i in range(42)], "k string, v string")
    assert vote.mode_percent(df, ["k"], "v").first().percent == int(100 * (58 / 100)) or vote.mode_percent(df, ["k"], "v").first().percent == 57


def confident(spark, pairs):
    return spark.createDataFrame([(pairs,)], "taxonomy array<struct<taxon:string,confidence:int>>")


def shown(spark, pairs, n=6, least=80):
    df = confident(spark, pairs)
    return df.select(T.format_taxonomy(T.filter_confidence(F.col("taxonomy"), least), n).alias("x")).first().x


def test_filter_pad_and_format(spark):
    assert shown(spark, [("A", 100), ("a", 80), ("B", 60)], 3) == "A(100);a(80);a_unclassified(80)"
    assert shown(spark, [("A", 90), ("b", 10), ("c", 85)], 3) == "A(90);c(85);c_unclassified(85)"
    assert shown(spark, [("A", 10), ("b", 5)], 3) == "A(10);A_unclassified(10);A_unclassified(10)"
    assert shown(spark, [(str(i), 90) for i in range(4)], 2).count(";") == 3


def test_lineage_strings(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(T.fix_taxonomy(F.lit("Bacteria;Firmicutes;"), 4)) == "Bacteria;Firmicutes;Firmicutes_unclassified;Firmicutes_unclassified"
    assert value(T.fix_qiime_taxa(F.lit("k__Bacteria; g__Foo__bar"))) == "Bacteria;bar"
    assert value(T.format_unsplit(F.lit("A;bc"), 4)) == "A;bc;bc_unclassified;bc_unclassified"
    assert value(T.format_unsplit(F.lit("A;bc"), 3, compat=True)) == "A;bc;c_unclassified"
    assert value(T.lineage_prefixes(F.lit("a;b;c"))) == ["a", "a;b", "a;b;c"]
    assert value(T.sort_by(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit(3), F.lit(1), F.lit(1)))) == ["y", "z", "x"]
    assert value(T.keys_to_int(F.create_map(F.lit("7"), F.lit("v")))) == {7: "v"}


FULL = "Bacteria;Actinomycetota;Actinobacteria;Mycobacteriales;Mycobacteriaceae;Mycobacterium"


def flow(spark):
    import random

    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(1400)) for _ in range(3)]
    ids = [FULL, "Bacteria;Pseudomonadota;Gammaproteobacteria;Vibrionales;Vibrionaceae;Vibrio", FULL.replace("Mycobacterium", "Nocardia")]
    return table(spark, [(i, ids[i], s) for i, s in enumerate(seqs)])


@pytest.mark.parametrize("how", [{}, {"compat": True}, {"most_cells": 1000, "num_bs": 20, "min_confidence": 16}, {"cumulative": True}, {"native": True}])
def test_self_classification(spark, how):
    df = flow(spark)
    got = summary.summarize_predictions(classify_sequences(df, make_classifier(df), **how)).orderBy("seq_no").collect()
    n = how.get("num_bs", 100)
    assert got[0].classification == ";".join(f"{x}({n})" for x in FULL.split(";"))
    assert [r.observed == r.id for r in got] == [True] * 3 and got[0].lineage.startswith("k__Bacteria;p__Actinomycetota;")


def test_lower_case_queries_have_words_unless_compat(spark):
    df = flow(spark)
    m, low = make_classifier(df), df.withColumn("sequence", F.lower("sequence"))
    assert classify_sequences(low, m).where("classification LIKE 'Unclassified(0)%'").count() == 0
    assert classify_sequences(low, m, compat=True).where("classification LIKE 'Unclassified(0)%'").count() == 3


def test_sequences_without_words_stay_and_equal_ids_are_not_merged(spark):
    df = flow(spark)
    q = table(spark, [(1, "x", ""), (2, "x", "NNNNNNNNNNNNNNN"), (3, "x", None)])
    got = classify_sequences(q, make_classifier(df), n_levels=2, keep_sequence=True)
    assert got.columns == ["seq_no", "id", "sequence", "classification"]
    assert [r.classification for r in got.collect()] == ["Unclassified(0);Unclassified_unclassified(0)"] * 3


def test_missing_columns_raise(spark):
    for bad in ("id", "sequence"):
        df = flow(spark).withColumnRenamed(bad, "other")
        with pytest.raises(ValueError, match=bad):
            make_classifier(df)


def test_summary_is_strict_about_ranks(spark):
    df = spark.createDataFrame([("x", "A(1);b(2)")], "id string, classification string")
    with pytest.raises(Exception, match="expected 6 ranks"):
        summary.summarize_predictions(df).collect()
    assert summary.summarize_predictions(df, strict=False).first().Class is None


def test_prevalence(spark):
    df = spark.createDataFrame([(11.0,), (10.0,), (None,), (float("nan"),), (50.0,), (1.0,), (2.0,)], "v double")
    assert summary.prevalence(df, "v").first().prevalence == 28
    assert summary.prevalence(df.limit(0), "v").first().prevalence is None


def test_down_sample_and_hold_out(spark):
    df = spark.range(1000).select(F.col("id").alias("seq_no"), F.when(F.col("id") % 10 < 9, F.lit("hot")).when(F.col("id") % 100 == 9, F.lit("few")).alias("id"))
    got = sample.down_sample(df, n=50, seed=2)
    assert {(r.id, r["count"]) for r in got.groupBy("id").count().collect()} == {("hot", 50), ("few", 10)}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sample.down_sample(df.repartition(5), n=50, seed=2).collect()))
    rest, test = sample.hold_out(df, 50, 1)
    assert (rest.count(), test.count()) == (950, 50) and rest.join(test, "seq_no").count() == 0
