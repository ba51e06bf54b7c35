"""Scoring of bootstraps and the choice of the best genus.

With ``log((m+P)/(M+1)) = [log(m+P) - log P] + log P - log(M+1)`` a genus without the word
(m = 0) has no bracket, and ``log P`` is the same for every genus. So a bootstrap's ranking
needs the stored cells only, plus ``-draws * log(M+1)`` for each genus.

numpy scores Arrow batches against a block of genera whose cells are sent to every task. A
model within ``MOST_CELLS`` is one block. A larger one is cut into blocks of that size, each
scores all sequences, and the best over the blocks wins: the sequences are read once a block
and never shuffled, and only one best score a bootstrap and block is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import workspace  # noqa: F401  (its import lets functions travel by value)
from ..functions.kmer_arrays import kmer_array
from .sample import draw_positions
from .train import KmerModel

#: Stored cells of a block: 12 bytes each, so 240 MB sent to every task.
MOST_CELLS = 20_000_000
#: Entries of the words x genera matrix that is multiplied at a time.
MATRIX = 4_000_000


class Block:
    """Cells of the genera ``first, first + 1, ...`` by word, with the terms of those genera."""

    def __init__(self, table: pa.Table, first: int, cost: np.ndarray):
        kmer = table["kmer"].to_numpy()
        order = np.argsort(kmer, kind="stable")
        self.genus, self.gain = table["genus_idx"].to_numpy()[order] - first, table["gain"].to_numpy()[order]
        self.words, starts = np.unique(kmer[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.first, self.cost = first, cost

    def best(self, kmers: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score, to 9 digits, and genus of each row of ``drawn`` (positions in ``kmers``); the lowest genus on ties."""
        n_rows, n_draws = drawn.shape
        places = drawn + np.arange(n_rows)[:, None] * len(kmers)
        times = np.bincount(places.ravel(), minlength=n_rows * len(kmers)).reshape(n_rows, len(kmers))
        at = np.searchsorted(self.words, kmers)
        known = np.flatnonzero((at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == kmers)) if len(self.words) else np.zeros(0, np.int64)
        times = times[:, known].astype(float)
        a, size = self.starts[at[known]], self.starts[at[known] + 1] - self.starts[at[known]]
        row = np.repeat(np.arange(len(known)), size)
        cell = np.arange(len(row)) + np.repeat(a - (np.cumsum(size) - size), size)
        genus, gain = self.genus[cell], self.gain[cell]
        score, found = np.full(n_rows, -np.inf), np.zeros(n_rows, np.int64)
        width = max(1, MATRIX // max(len(known), 1))
        for low in range(0, len(self.cost), width):
            cost = self.cost[low : low + width]
            some = slice(None) if width >= len(self.cost) else (genus >= low) & (genus < low + width)
            matrix = np.zeros((len(known), len(cost)))
            matrix[row[some], genus[some] - low] = gain[some]
            scores = np.round(times @ matrix - n_draws * cost, 9)
            top = scores.argmax(axis=1)
            value = scores[np.arange(n_rows), top]
            better = value > score
            score, found = np.where(better, value, score), np.where(better, top + low, found)
        return score, found + self.first


def gains(model: KmerModel) -> DataFrame:
    """``kmer, genus_idx, gain``: the bracket of every stored cell; of a model of all cells, its log probability."""
    if model.all_cells:
        return model.cells.select("kmer", "genus_idx", F.col("log_p").cast("double").alias("gain"))
    cells = model.counts if model.counts is not None else model.cells
    return cells.select("kmer", "genus_idx", "cnt").join(model.priors.select("kmer", "prior"), "kmer").select("kmer", "genus_idx", (F.log(F.col("cnt") + F.col("prior")) - F.log("prior")).alias("gain"))


def blocks(model: KmerModel, most_cells: int = MOST_CELLS):
    """The model in blocks of whole genera with at most ``most_cells`` cells (one genus at least), one after another.

    The driver holds one block, and a size for each genus.
    """
    sizes = model.genera.select("genus_idx", "n_seqs").orderBy("genus_idx").toArrow()["n_seqs"].to_numpy()
    cost = np.zeros(len(sizes)) if model.all_cells else np.log(sizes + 1.0)
    held = np.zeros(len(sizes), np.int64)
    cells = gains(model)
    stored = cells if model.all_cells or model.counts is None else model.counts
    per_genus = stored.groupBy("genus_idx").agg(F.count("*").alias("n")).toArrow()
    held[per_genus["genus_idx"].to_numpy()] = per_genus["n"].to_numpy()
    low = 0
    while low < len(sizes):
        total = np.cumsum(held[low:])
        high = low + max(1, int(np.searchsorted(total, most_cells, side="right")))
        part = cells if low == 0 and high == len(sizes) else cells.where(F.col("genus_idx").between(low, high - 1))
        yield Block(part.toArrow(), low, cost[low:high])
        low = high


def _scorer(held, words, draws, fold: bool):
    """Of batches ``seq_no, what``: votes. ``words`` gives the k-mers of what, ``draws`` the drawn positions."""

    def run(batches):
        block = held.value
        for batch in batches:
            numbers, out = [], []
            for key, what in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                kmers = words(what)
                drawn = draws(key, len(kmers))
                if drawn is None:
                    continue
                score, genus = block.best(kmers, drawn)
                bs = np.arange(len(genus))
                if fold:
                    genus, bs, cnt = np.unique(genus, return_index=True, return_counts=True)
                    out.append((bs, genus, cnt))
                else:
                    out.append((bs, genus, score))
                numbers += [key] * len(genus)
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
            last = ("cnt", pa.int64()) if fold else ("score", pa.float64())
            yield pa.record_batch({"seq_no": pa.array(numbers, batch.schema.field(0).type), "first_bs" if fold else "bs": pa.array(columns[0], pa.int32()), "genus_idx": pa.array(columns[1], pa.int32()), last[0]: pa.array(columns[2], last[1])})

    return run


def _scored(rows: DataFrame, model: KmerModel, words, draws, fold: bool, most_cells: int) -> DataFrame:
    """``rows`` of ``seq_no, what`` scored against every block: votes ``seq_no, bs, genus_idx``, or folded
    ``seq_no, genus_idx, cnt, first_bs``."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["seq_no"]
    # Scoring costs far more than moving the rows: few or uneven input files must not leave cores idle.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "seq_no")
    parts, held, later = [], None, blocks(model, most_cells)
    while True:
        block = next(later, None)
        if held is not None:
            only = block is None and not parts
            schema = f"seq_no {kind}, first_bs int, genus_idx int, cnt long" if only and fold else f"seq_no {kind}, bs int, genus_idx int, score double"
            parts.append(rows.mapInArrow(_scorer(held, words, draws, only and fold), schema))
            if only:
                return parts[0] if fold else parts[0].drop("score")
        if block is None:
            break
        held = spark.sparkContext.broadcast(block)
    if not parts:  # a model without genera
        return spark.createDataFrame([], f"seq_no {kind}, first_bs int, genus_idx int, cnt long" if fold else f"seq_no {kind}, bs int, genus_idx int")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = F.max(F.struct("score", (-F.col("genus_idx")).alias("neg")))
    votes = every.groupBy("seq_no", "bs").agg(best.alias("best")).select("seq_no", "bs", (-F.col("best.neg")).cast("int").alias("genus_idx"))
    return votes.groupBy("seq_no", "genus_idx").agg(F.count("*").alias("cnt"), F.min("bs").alias("first_bs")) if fold else votes


def _given(what) -> np.ndarray:
    return what.values.to_numpy() if what.is_valid else np.zeros(0, np.int32)


def _draws(num_bs: int, divider: int, seed: int, longest: int | None):
    def draws(key, size: int):
        n = (size if longest is None else longest) // divider
        return draw_positions(seed, key, num_bs, n, size) if size and n else None

    return draws


def classify_tokens(tokens: DataFrame, model: KmerModel, most_cells: int = MOST_CELLS) -> DataFrame:
    """``seq_no, genus_idx``: one vote of all k-mers of a sequence; without k-mers none."""
    once = lambda key, size: np.arange(size)[None, :] if size else None
    return _scored(tokens.select("seq_no", "kmers"), model, _given, once, False, most_cells).select("seq_no", "genus_idx")


def classify_bootstraps(tokens: DataFrame, model: KmerModel, num_bs: int = 100, divider: int = 8, seed: int = 0, batch_draws: bool = False, most_cells: int = MOST_CELLS) -> DataFrame:
    """``seq_no, bs, genus_idx``: a vote for each bootstrap of ``tokens(seq_no, kmers)``."""
    longest = tokens.agg(F.max(F.size("kmers"))).first()[0] if batch_draws else None
    return _scored(tokens.select("seq_no", "kmers"), model, _given, _draws(num_bs, divider, seed, longest), False, most_cells)


def classify_folded(sequences: DataFrame, model: KmerModel, num_bs: int = 100, divider: int = 8, seed: int = 0, fold_case: bool = True, most_cells: int = MOST_CELLS) -> DataFrame:
    """``seq_no, genus_idx, cnt, first_bs`` of ``sequences(seq_no, sequence)``: the votes of a sequence counted where they arise."""
    k = model.kmer_size
    words = lambda x: kmer_array(x.as_py(), k, fold_case)
    return _scored(sequences.select("seq_no", "sequence"), model, words, _draws(num_bs, divider, seed, None), True, most_cells)
