"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units and names become typed placeholders, token by token, so that the canonical text
keeps the token positions of the raw one. A window of words has up to two canonical forms: with
numbers and units typed and names as lower-case words, so that copies in another case are found;
and with capitalised words typed as names too, wherever they stand, so that swapped names are.
Windows are hash-joined with those of the benchmark; along a diagonal (text position less item
position) every item value of a placeholder must stand for one value of the text, else the
diagonal is no copy. A form with fewer than ``LITERAL`` words left as they are would match
anything of its shape: such windows are compared by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

MARK, NUM, NAME, UNIT = "\u0001", "\u0002", "\u0003", "\u0004"
#: Words that count as a unit after a number (fixed values).
UNITS = "km|m|cm|mm|mi|miles|kg|g|mg|lb|lbs|pounds|l|ml|litres|liters|h|hours|hour|min|minutes|minute|s|seconds|second|days|day|weeks|years|usd|eur|dollars|euros|cents|percent|degrees"
#: Words of a window that a placeholder must not replace, at least.
LITERAL = 2
#: Words of the shortest item that is looked for inside longer texts.
SHORTEST = 3
#: Windows of items that may be sent to every task; beyond that the join shuffles, salted.
MOST_BROADCAST, SALTS = 500_000, 16
#: Bits of the table that tells which window hashes occur among the items, at most.
MOST_FLAGS = 1 << 18


def marked(text: Column) -> Column:
    """The text without punctuation, with capitalised words marked, its words apart by single blanks.

    A mark inside a word, where punctuation joined two, makes it no name.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "(?=\\p{Lu}\\p{Ll})(?<![\\p{L}\\p{N}])", MARK)
    text = F.regexp_replace(text, f"[^\\p{{L}}\\p{{N}}{MARK} \\t\\n\\x0B\\f\\r]+", "")
    # Single blanks stay as they are; only other runs are rewritten.
    text = F.regexp_replace(text, " *+[\\t\\n\\x0B\\f\\r][ \\t\\n\\x0B\\f\\r]*+| {2,}", " ")
    return F.trim(F.lower(text))


def numbered(plain: Column) -> Column:
    """Words with a digit, and units after them, as placeholders."""
    typed = F.regexp_replace(F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", NUM), f"{NUM} ({UNITS})(?![^ ])", f"{NUM} {UNIT}")
    return F.when(plain.rlike("[0-9]"), typed).otherwise(plain)


def window_rows(rows: DataFrame, key: list[str], widths: list[int], flags: tuple[Column, int] | None = None) -> DataFrame:
    """``key, pos, n, h, slots`` for each form of each window of ``text``: its hash, the values of its placeholders (null for a
    word that is none), the text's number of windows of the greatest width. A text shorter than a width is one window of it.

    With ``flags`` only windows whose hash is flagged come out. One expression, each step bound once: projections would be
    merged, and a filter pushed down, so that steps ran again.
    """

    def forms(typed: Column, plain: Column, bits: Column | None) -> Column:
        # Of each word: hash as it is typed without names, hash with names, and a count, 1 for a name and 8 for another placeholder.
        bare = lambda x: F.replace(x, F.lit(MARK), F.lit(""))
        is_name = lambda x: F.startswith(x, F.lit(MARK))
        words = F.split(typed, " ")
        has = F.contains(typed, F.lit(MARK))
        raw = F.when(has | typed.rlike(f"[{NUM}{UNIT}]"), F.split(bare(plain), " "))
        names = F.when(has, F.transform(words, lambda x: F.when(is_name(x), F.xxhash64(F.lit(NAME))).otherwise(F.xxhash64(x))))
        kinds = F.when(raw.isNotNull(), F.transform(words, lambda x: F.when(is_name(x), 1).when(x.isin(NUM, UNIT), 8).otherwise(0)))
        plain_hashes = F.transform(F.split(bare(typed), " "), lambda x: F.xxhash64(x))
        numbers = F.contains(typed, F.lit(NUM))
        return let(raw, lambda r: let(names, lambda a: let(kinds, lambda k: let(plain_hashes, lambda p: let(numbers, lambda x: of_words(p, a, k, r, x, bits))))))

    def of_words(p: Column, a: Column, k: Column, r: Column, numbers: Column, bits: Column | None) -> Column:
        n = F.greatest(F.size(p) - max(widths), F.lit(0)) + 1

        def flagged(h: Column) -> Column:
            one = lambda at: F.getbit(F.get(bits, F.shiftright(at, 6)), at.bitwiseAND(63)) == 1
            return let(h, lambda x: one(_places(x, flags[1])[0]) & one(_places(x, flags[1])[1]))

        def of_width(width: int) -> Column:
            def total(i: Column) -> Column:
                return sum((F.coalesce(F.get(k, i + j), F.lit(0)) for j in range(1, width)), F.coalesce(F.get(k, i), F.lit(0)))

            def hashed(of: Column, i: Column) -> Column:
                return F.xxhash64(*[F.get(of, i + j) for j in range(width)])

            def literal(i: Column) -> Column:
                return F.xxhash64(*[F.xxhash64(F.get(r, i + j)) for j in range(width)])

            def window(i: Column) -> Column:
                most = max(width - LITERAL, 0)
                few = lambda t: F.floor(t / 8) <= most
                first = F.when(k.isNull(), hashed(p, i)).otherwise(let(total(i), lambda t: F.when(few(t), hashed(p, i)).otherwise(literal(i))))
                second = F.when(a.isNotNull(), let(total(i), lambda t: F.when((t % 8 > 0) & (t % 8 + F.floor(t / 8) <= most), hashed(a, i))))
                return F.struct(i.alias("pos"), first.alias("first"), second.alias("second"))

            last = F.size(p) - width
            starts = F.when(last >= 0, F.sequence(F.lit(0), last)).when(F.lit(width == max(widths)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
            if flags is not None:
                # Any form the window may have; which it has is settled for the few that are left.
                plain = F.filter(starts, lambda i: flagged(hashed(p, i)))
                named = F.filter(starts, lambda i: flagged(hashed(p, i)) | flagged(hashed(a, i)) | (numbers & flagged(literal(i))))
                starts = F.when(r.isNull(), plain).otherwise(F.when(a.isNull(), F.filter(starts, lambda i: flagged(hashed(p, i)) | flagged(literal(i)))).otherwise(named))
            found = F.transform(starts, window)

            def slots(i: Column, which: str) -> Column:
                values = lambda least: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.when(F.get(k, i + j) >= least, F.get(r, i + j)))
                if which == "second":
                    return F.when(k.isNotNull(), values(1))
                return F.when(k.isNotNull(), let(total(i), lambda t: F.when((t >= 8) & (F.floor(t / 8) <= max(width - LITERAL, 0)), values(8))))

            both = lambda x: F.filter(F.array(*[F.struct(x["pos"].alias("pos"), n.alias("n"), x[f].alias("h"), slots(x["pos"], f).alias("slots")) for f in ("first", "second")]), lambda y: y["h"].isNotNull() & (flagged(y["h"]) if flags is not None else F.lit(True)))
            return F.flatten(F.transform(found, both))

        return F.concat(*[of_width(w) for w in widths])

    of_text = lambda bits: let(marked(F.col("text")), lambda plain: F.when(plain != "", let(numbered(plain), lambda typed: forms(typed, plain, bits))))
    found = let(flags[0], of_text) if flags else of_text(None)
    # A plain explode would have Spark filter by the size of the array first, and compute it twice.
    return rows.select(*key, F.explode_outer(found).alias("x")).where("x IS NOT NULL").select(*key, "x.pos", "x.n", "x.h", "x.slots")


def _places(h: Column, n: int) -> list[Column]:
    """The two bits of a hash in a table of ``n``."""
    return [F.pmod(h, F.lit(n)).cast("int"), F.pmod(F.shiftright(h, 24), F.lit(n)).cast("int")]


def _flags(items: DataFrame) -> tuple[Column, int]:
    """A Bloom filter of the items' window hashes: an array of longs, and the number of bits, 16 for each window, from 4,096 to
    ``MOST_FLAGS``. A full one only lets more windows through to the join."""
    n = min(MOST_FLAGS, max(1 << 12, 1 << (16 * items.limit(MOST_FLAGS).count()).bit_length()))
    at = items.select(F.explode(F.array(*_places(F.col("h"), n))).alias("at")).distinct()
    rows = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.collect_set((F.col("at") % 64).cast("int")).alias("bits"))
    table = [0] * (n // 64)
    for r in rows.collect():  # at most MOST_FLAGS / 64 rows
        table[r.word] = sum(1 << b for b in r.bits)
    return F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in table)), ",").cast("array<bigint>"), n


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, item_id, n_windows, matched, changed`` for texts that hold at least ``share`` of an item's windows.

    ``matched`` counts the item's windows found on diagonals whose placeholder values are consistent, ``changed`` tells whether
    any value differs from the item's (a re-parameterised copy). Windows have ``width`` words; an item of fewer is one window
    of all its words and is looked for inside texts from ``SHORTEST`` words on, a shorter one as a whole text. Null and empty
    texts and items hold nothing, very long texts are taken whole. Rows repeated under one id with one text give one row; a null
    id is kept as such. Empty tables give an empty result; other columns are ignored, whatever their names.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).dropDuplicates()
    lengths = items.select(F.size(F.split(marked(F.col("text")), " ")).alias("n")).where((F.col("n") >= SHORTEST) & (F.col("n") < width)).distinct()
    widths = sorted(r.n for r in lengths.collect())  # fewer than ``width`` rows
    items = window_rows(items, ["item_id"], [width]).select("item_id", "h", F.col("n").alias("n_windows"), F.col("pos").alias("ipos"), F.col("slots").alias("islots"))
    items = materialize(items, "windows")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = window_rows(texts, ["doc_id", "text_hash"], [*widths, width], _flags(items)).select("doc_id", "text_hash", "pos", "h", "slots")
    if items.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        hits = found.join(F.broadcast(items), "h")
    else:  # a common window, and all items that hold it, meet in several tasks
        items = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "pos"), F.lit(SALTS)).cast("int")).join(items, ["h", "salt"]).drop("salt")
    pairs = F.flatten(F.collect_set(F.when(F.col("islots").isNotNull() & F.col("slots").isNotNull(), F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d")))))
    lines = hits.groupBy("doc_id", "text_hash", "item_id", "n_windows", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(F.collect_set("ipos").alias("at"), pairs.alias("pairs"))
    held = F.array_distinct(F.filter("pairs", lambda p: p["i"].isNotNull() | p["d"].isNotNull()))
    lines = lines.withColumn("pairs", held).where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))))
    changed = F.exists("pairs", lambda p: ~p["i"].eqNullSafe(p["d"]))
    whole = lines.groupBy("doc_id", "text_hash", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("matched"), F.max(changed).alias("changed"))
    return whole.where(F.col("matched") >= F.col("n_windows") * share)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns.

    Rows without text or words, and all rows beside an empty benchmark, stay; of rows repeated under one id those go whose own
    text holds an item. An empty table gives an empty result.
    """
    bad = leaks(docs, benchmark, text_col=text_col, id_col=id_col, **how).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = materialize(bad, "leaks")
    same = docs[id_col].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text_col]) == bad["_hash"])
    return docs.join(bad, same, "left_anti")
