"""Line dedup: passages of whole lines that occur earlier are removed, found by windows of lines that their own words delimit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.spans import let
from lectern.llm.common import bit_gate, checkpoint, fresh, passes

#: Repeated lines are removed in runs of at least so many words.
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
#: So many following lines are tried first for a window's end, then ``min_words`` of them.
NEAR = 8


def windows(lines: Column, min_words: int = MIN_WORDS) -> Column:
    """array<struct<a,b,back>>: the smallest windows of ``min_words`` words, as their first and last line.

    One starts at each line that has words and goes forward; one ends there and
    goes ``back``, unless that is a forward one too. Where a window lies depends
    on its own lines alone, and every run of lines with so many words, from a
    line with words to one, is the union of the windows within it: texts that
    share a passage share all of its windows, whatever stands around it. Lines
    without words start and end no window, so a line is in ``min_words`` windows
    of a kind at most.
    """
    counted = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(WORD)).alias("w"))), lambda x: x["w"] > 0)

    def with_counts(u: Column) -> Column:
        m = F.size(u)

        def with_words(w: Column) -> Column:
            # how many lines beyond the k-th a window needs: those after which it is still short
            def more(w: Column, k: Column) -> Column:
                add = lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + F.when(acc["s"] + x < min_words, 1).otherwise(0)).alias("n"))
                short = lambda n: F.aggregate(F.slice(w, k + 1, F.lit(n)), F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")), add, lambda acc: acc["n"])
                return let(short(NEAR), lambda n: F.when(n < NEAR, n).otherwise(short(min_words)))

            each = F.sequence(F.lit(0), m - 1)
            forward = F.transform(each, lambda k: F.struct(k.alias("a"), (k + more(w, k)).alias("b")))
            backward = let(F.reverse(w), lambda r: F.transform(each, lambda k: F.struct((k - more(r, m - 1 - k)).alias("a"), k.alias("b"))))
            fits = lambda x: F.filter(x, lambda v: (v["a"] >= 0) & (v["b"] < m))

            def tell(f: Column) -> Column:
                end = lambda x: F.get(f, x["a"])["b"]
                only = F.filter(fits(backward), lambda x: F.coalesce(end(x) != x["b"], F.lit(True)))
                named = lambda v, back: F.transform(v, lambda x: F.struct(u[x["a"]]["i"].alias("a"), u[x["b"]]["i"].alias("b"), F.lit(back).alias("back")))
                return F.concat(named(f, False), named(only, True))

            return let(fits(forward), tell)

        total = F.aggregate(u["w"], F.lit(0), lambda acc, w: acc + w)
        return F.when(total >= min_words, let(u["w"], with_words)).otherwise(F.array().cast("array<struct<a:int,b:int,back:boolean>>"))

    return let(counted, with_counts)


def _covered(spans: Column) -> Column:
    """array<int>: the lines of windows of one kind, sorted; starts and ends of a kind rise together."""
    fresh_part = lambda x, i: F.struct(F.when(i == 0, x["a"]).otherwise(F.greatest(x["a"], F.get(spans, F.greatest(i - 1, F.lit(0)))["b"] + 1)).alias("a"), x["b"].alias("b"))
    parts = F.filter(F.transform(spans, fresh_part), lambda x: x["a"] <= x["b"])
    return F.flatten(F.transform(parts, lambda x: F.sequence(x["a"], x["b"])))


def repeated_lines(docs: DataFrame, id_col: str = "_id", text_col: str = "_text", min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _th, drop: for each text with repeated passages, the line numbers to remove.

    A line goes if a window that holds it occurs at an earlier place. Windows are
    counted by a hash of their lines' hashes; a bitmap of fixed size keeps most of
    those that occur once out of the second step, which is exact for whatever
    else it lets through: windows are the same if the SHA-256 of their bytes is.
    No text is shuffled. A hot window's rows are pre-aggregated or split.
    """
    keyed = docs.select(id_col, text_col, F.xxhash64(text_col).alias("_th"))
    hash_of = lambda h, x: F.xxhash64(F.slice(h, x["a"] + 1, x["b"] - x["a"] + 1))
    hashes = lambda lines: F.transform(lines, lambda x: F.xxhash64(x))
    every = let(F.split(text_col, "\n", -1), lambda lines: let(hashes(lines), lambda h: F.transform(windows(lines, min_words), lambda x: hash_of(h, x))))
    known = checkpoint(keyed.select(F.explode(every).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash"))
    gate = F.broadcast(checkpoint(bit_gate(known, "_hash")))

    def with_text(lines: Column, h: Column) -> Column:
        text = lambda x: F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"] + 1), "\n")
        return F.transform(windows(lines, min_words), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["back"].alias("back"), hash_of(h, x).alias("hash"), text(x).alias("text")))

    # the bitmap meets plain columns only: a lambda would have it copied for every row
    found = keyed.select(id_col, "_th", F.explode(let(F.split(text_col, "\n", -1), lambda lines: let(hashes(lines), lambda h: with_text(lines, h)))).alias("w")).select(id_col, "_th", "w.*")
    found = found.crossJoin(gate).filter(passes(F.col("_gate"), F.col("hash")))
    rows = checkpoint(found.select(id_col, "_th", "a", "b", "back", F.unhex(F.sha2("text", 256)).alias("_digest")))
    place = lambda: F.struct(F.col(id_col).alias("id"), F.col("_th").alias("th"), F.col("a").alias("a"))
    # rows that share id and text are one document, whose first occurrence is one
    firsts = rows.groupBy("_digest").agg(F.min(place()).alias("_at"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    firsts = checkpoint(firsts)  # a join of two plain shuffles, whose hot partitions can be split
    later = rows.join(firsts, "_digest").filter(~place().eqNullSafe(F.col("_at")))
    span = F.struct("a", "b")
    of_kind = lambda back: F.array_sort(F.collect_set(F.when(F.col("back") == back, span)))
    both = later.groupBy(id_col, "_th").agg(of_kind(F.lit(False)).alias("_f"), of_kind(F.lit(True)).alias("_b"))
    return both.select(id_col, "_th", F.array_sort(F.array_union(_covered(F.col("_f")), _covered(F.col("_b")))).alias("drop"))


def _without(lines: Column, drop: Column, min_words: int) -> Column:
    """array<string>: the lines without those of ``drop`` that stand in runs of ``min_words`` words."""

    def kept(d: Column) -> Column:
        # where runs of consecutive line numbers start, as indices into d
        starts = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: (i == 0) | (F.coalesce(F.get(d, F.greatest(i - 1, F.lit(0))), F.lit(-2)) != d[i] - 1))

        def with_starts(s: Column) -> Column:
            runs = F.transform(s, lambda i, j: F.struct(d[i].alias("from"), (d[i] + F.coalesce(F.get(s, j + 1), F.size(d)) - i).alias("to")))
            words = lambda r: F.regexp_count(F.array_join(F.slice(lines, r["from"] + 1, r["to"] - r["from"]), "\n"), F.lit(WORD))

            def with_runs(r: Column) -> Column:
                cut = F.transform(r, lambda x, j: F.struct(F.when(j == 0, F.lit(0)).otherwise(F.get(r, F.greatest(j - 1, F.lit(0)))["to"]).alias("a"), x["from"].alias("b")))
                tail = F.array(F.struct(F.coalesce(F.get(r, F.greatest(F.size(r) - 1, F.lit(0)))["to"], F.lit(0)).alias("a"), F.size(lines).alias("b")))
                return F.flatten(F.transform(F.concat(cut, tail), lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))

            return let(F.filter(runs, lambda r: words(r) >= min_words), with_runs)

        return let(starts, with_starts)

    return F.when(drop.isNull() | (F.size(drop) == 0), lines).otherwise(let(drop, kept))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """``docs`` without passages of ``min_words`` words or more that occur earlier in the table.

    A passage is a run of lines whose first and last have words. Earlier is by id, text hash and place. All rows and columns stay; of a text
    only whole lines go, and a text that keeps all its lines stays as it is, byte
    for byte. Texts may become empty. Null text stays null; empty text has one
    empty line; rows with the same id and text are treated alike; a null id is
    the earliest. ``removed`` names a column for the number of lines removed.
    """
    p = fresh(docs, "_ld_")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({f"{p}id": F.col(id_col).cast("string"), f"{p}th": F.xxhash64(text)})
    drops = checkpoint(repeated_lines(docs.select(F.col(id_col).alias("_id"), text.alias("_text")), min_words=min_words))
    drops = drops.select(F.col("_id").cast("string").alias(f"{p}id2"), F.col("_th").alias(f"{p}th2"), F.col("drop").alias(f"{p}drop"))
    # texts that lose nothing go past the join: the bitmap tells most of them
    key = F.xxhash64(f"{p}id", f"{p}th")
    gate = F.broadcast(bit_gate(drops.select(F.xxhash64(f"{p}id2", f"{p}th2").alias("_k")), "_k").withColumnRenamed("_gate", f"{p}gate"))
    gated = rows.crossJoin(gate).withColumn(f"{p}in", passes(F.col(f"{p}gate"), key)).drop(f"{p}gate")
    joined = gated.filter(f"{p}in").join(drops, F.col(f"{p}id").eqNullSafe(F.col(f"{p}id2")) & (F.col(f"{p}th") == F.col(f"{p}th2")), "left")
    both = F.when(F.col(f"{p}drop").isNotNull(), let(F.split(text, "\n", -1), lambda x: let(_without(x, F.col(f"{p}drop"), min_words), lambda k: F.struct(F.array_join(k, "\n").alias("text"), (F.size(x) - F.size(k)).alias("gone")))))
    gone = F.coalesce(F.col(f"{p}new.gone"), F.lit(0))
    changed = joined.withColumn(f"{p}new", both).withColumn(text_col, F.when(gone > 0, F.col(f"{p}new.text")).otherwise(F.col(text_col))).withColumn(f"{p}gone", gone)
    whole = gated.filter(f"not {p}in").withColumn(f"{p}gone", F.lit(0))
    out = changed.drop(f"{p}id2", f"{p}th2", f"{p}drop", f"{p}new").unionByName(whole)
    out = out.withColumn(removed, F.col(f"{p}gone")) if removed else out
    return out.drop(f"{p}id", f"{p}th", f"{p}in", f"{p}gone")
