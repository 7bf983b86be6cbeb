r"""Line dedup on content-defined chunks, in SQL functions only.

A rolling hash over the hashes of two neighbouring lines closes a chunk where it is 0
modulo ``divisor``; a line of more than ``long_line`` words closes the chunk before it
and is a chunk of its own.  Boundaries therefore depend on nearby lines alone and
come back wherever a passage is repeated.  A chunk of two or more lines, or of one
long line, that occurs more than once anywhere in the corpus is removed at every
place but its first (smallest doc_id, then position), after its bytes were compared
with those of the first place.

The first place of every chunk hash is a partial aggregate, so a passage that many
documents share leaves each task as one row.  The candidates then carry the first
place's text to their documents, where the comparison and the removal happen.

Defined results.  A null text stays null, an empty one empty; a text whose chunks all
go becomes empty.  Blank chunks stay.  Rows that repeat doc_id and text count as one
document and keep what it keeps; a null doc_id comes first.

``without_repeated_runs`` doesn't depend on where chunks end.  It removes every run of
lines of more than ``words`` words, of one or many lines, at all places but its first,
with exactly these lines.  From each line with words on, and up to each such line, it
takes the shortest run of more than ``words`` words.  Whether a run is shortest is told
by its lines alone, and these runs cover every longer one line by line, so a line lies
in a repeated run if and only if it lies in a repeated shortest run.  Runs meet by
SHA-256 of their text.  Blank lines at a run's ends stay.  Where a run overlaps its own
first place, the lines of the first place stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B


@dataclass(frozen=True)
class LineChunks:
    divisor: int = 3
    long_line: int = 50
    factor: int = 31


def with_chunks(docs: DataFrame, p: LineChunks, text_col: str) -> DataFrame:
    """Adds ``_lines`` and ``_chunks``, the latter an array of (a, n): first line and number of lines."""
    number = lambda line: F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")
    wide = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= p.long_line
    out = docs.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    out = out.withColumn("_h", F.transform("_lines", lambda x: F.struct(number(x).alias("h"), wide(x).alias("w"))))

    def closes(item: Column, k: Column) -> Column:
        before = F.when(k > 0, F.try_element_at("_h", k)["h"]).otherwise(F.lit(0))
        following = F.try_element_at("_h", (k + 2).cast("int"))
        rolled = (item["h"] + p.factor * before) % p.divisor == 0
        return rolled | item["w"] | F.coalesce(following["w"], F.lit(True))  # the last line closes

    ends = F.filter(F.transform("_h", lambda x, k: F.when(closes(x, k), k)), lambda x: x.isNotNull())
    out = out.withColumn("_ends", ends)
    start = lambda k: F.when(k > 0, F.try_element_at("_ends", k) + 1).otherwise(F.lit(0))
    return out.withColumn("_chunks", F.transform("_ends", lambda e, k: F.struct(start(k).alias("a"), (e - start(k) + 1).alias("n")))).drop("_ends")


def _text(lines: str, a: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, a + 1, n), "\n")


def deduplicated(docs: DataFrame, p: LineChunks = LineChunks(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated chunks gone from ``text_col``, and _n_lines, _n_removed, _n_chunks, which take the place of columns so named."""
    docs = docs.drop("_n_lines", "_n_removed", "_n_chunks")
    names = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))  # no column of the caller's can clash with those used here
    id_col, text_col = (f"c{names.index(x)}" for x in (id_col, text_col))
    keyed = with_chunks(docs, p, text_col).withColumn("_key", F.xxhash64(F.col(text_col)))
    place = keyed.select(F.col(id_col).alias("id"), F.col("_key").alias("key"), "_lines", F.explode(F.filter("_chunks", lambda c: (c["n"] > 1) | F.try_element_at("_h", c["a"] + 1)["w"])).alias("c"))
    chunk = place.select("id", "key", F.col("c.a").alias("a"), F.col("c.n").alias("n"), _text("_lines", F.col("c.a"), F.col("c.n")).alias("t")).where("t rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    hashed = chunk.select("id", "key", "a", "n", F.xxhash64("t").alias("h"), "t")
    first = hashed.groupBy("h").agg(F.min(F.struct("id", "a", "key", "t")).alias("f"), F.count(F.lit(1)).alias("many")).where("many > 1").select("h", "f")
    later = hashed.select("id", "key", "a", "n", "h").join(first, "h").where("not (id <=> f.id and a = f.a and key = f.key)")
    gone = later.groupBy("id", "key").agg(F.collect_set(F.struct("a", "n", F.col("f.t").alias("t"))).alias("later"))
    # Only the texts themselves move; their chunks are found again where they meet their candidates.
    gone = gone.select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key"), F.col("later").alias("_later"))
    met = docs.withColumn("_key", F.xxhash64(F.col(text_col))).join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")) & F.col("_key").eqNullSafe(F.col("_gone_key")), "left")
    met = with_chunks(met, p, text_col)
    # Byte comparison with the first place, in the document itself.
    same = F.filter(F.coalesce("_later", F.array()), lambda c: _text("_lines", c["a"], c["n"]) == c["t"])
    met = met.withColumn("_same", F.transform(same, lambda c: c["a"]))
    stay = F.filter("_chunks", lambda c: ~F.array_contains("_same", c["a"]))
    text = F.array_join(F.transform(stay, lambda c: _text("_lines", c["a"], c["n"])), "\n")
    lost = F.aggregate(F.filter("_chunks", lambda c: F.array_contains("_same", c["a"])), F.lit(0).cast("long"), lambda x, c: x + c["n"])
    out = met.select(
        *((F.when(F.size("_same") > 0, text).otherwise(F.col(c)) if c == text_col else F.col(c)).alias(c) for c in docs.columns),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long").alias("_n_lines"), lost.alias("_n_removed"), F.size("_same").cast("long").alias("_n_chunks"),
    )
    return out.toDF(*names, "_n_lines", "_n_removed", "_n_chunks")


@dataclass(frozen=True)
class Runs:
    #: Words that a run must exceed.
    words: int = 50
    #: Lines whose words are summed one by one before blocks are.
    block: int = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _running(values: Column) -> Column:
    """Sums of the values before each place, and of all."""
    return F.aggregate(values, F.array(F.lit(0)), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x))


def shortest_runs(text: Column, p: Runs) -> Column:
    """Array of (a, n, d): first line, number of lines and digest of each shortest run."""

    def coded(lines: Column, counts: Column) -> Column:
        home = F.flatten(F.transform(counts, lambda n, k: F.array_repeat(k, n)))  # the line of each word
        cuts = F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / p.block).cast("int"))
        inside = F.transform(cuts, lambda b: _running(F.slice(counts, b * p.block + 1, p.block)))

        def run(a: Column, e: Column) -> Column:
            return a.cast("long") * (1 << 32) + (e - a + 1)

        def both(home: Column, inside: Column, before: Column) -> Column:
            def of(n: Column, k: Column) -> Column:
                b = F.floor(k / p.block).cast("int")
                first = F.get(before, b) + F.get(F.get(inside, b), k % p.block)
                return _let(first, lambda w: F.when(n > 0, F.array(run(k, F.get(home, w + p.words)), run(F.get(home, w + n - 1 - p.words), k))))

            return F.array_distinct(F.filter(F.flatten(F.filter(F.transform(counts, of), lambda x: x.isNotNull())), lambda x: x.isNotNull()))

        return _let(home, lambda h: _let(inside, lambda i: _let(_running(F.transform(i, lambda x: F.element_at(x, -1))), lambda b: both(h, i, b))))

    def place(lines: Column, code: Column) -> Column:
        a, n = F.shiftright(code, 32).cast("int"), code.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return F.struct(a.alias("a"), n.alias("n"), F.unhex(F.sha2(F.array_join(F.slice(lines, a + 1, n), "\n"), 256)).alias("d"))

    count = lambda x: F.regexp_count(x, F.lit("[^\\x20\\x09-\\x0D]+"))
    return _let(_lines_of(text), lambda lines: _let(F.transform(lines, count), lambda counts: F.transform(coded(lines, counts), lambda c: place(lines, c))))


def without_repeated_runs(docs: DataFrame, p: Runs = Runs(), id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str, str] = ("_n_lines", "_n_removed", "_n_chunks")) -> DataFrame:
    """The rows of ``docs`` with repeated runs of lines gone from ``text_col``, and three counts: lines, removed lines, stretches of removed lines.

    Columns of ``docs`` with the names of the counts give way to them.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.explode(shortest_runs(F.col(text_col), p)).alias("c"))
    runs = keyed.select("id", "key", F.col("c.a").alias("a"), F.col("c.n").alias("n"), F.col("c.d").alias("d"))
    first = runs.groupBy("d").agg(F.min(F.struct("id", "a", "key")).alias("f"), F.count(F.lit(1)).alias("many")).where("many > 1").select("d", "f")
    later = runs.join(first, "d").where("not (id <=> f.id and a = f.a and key = f.key)")
    later = later.withColumn("b", F.expr("if(id <=> f.id and key = f.key, greatest(a, f.a + n), a)")).select("id", "key", "b", (F.col("a") + F.col("n") - 1).alias("e")).where("b <= e")
    docs = docs.drop(*counts)
    key, gone_id, gone_key, spans, lines = (B.free(docs.columns, x) for x in ("key", "gone_id", "gone_key", "later", "lost"))
    gone = later.groupBy(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).agg(F.collect_set(F.struct("b", "e")).alias(spans))
    met = docs.withColumn(key, F.xxhash64(F.col(text_col))).join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & F.col(key).eqNullSafe(F.col(gone_key)), "left")
    lost = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda r: F.sequence(r["b"], r["e"])))))
    some = F.col(spans).isNotNull()
    met = met.withColumn(lines, F.when(some, lost))
    stay = lambda all_: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), lines), lambda k: F.get(all_, k))
    text = _let(_lines_of(F.col(text_col)), lambda all_: F.array_join(stay(all_), "\n"))
    opens = _let(F.col(lines), lambda x: F.size(F.filter(F.transform(x, lambda k, i: F.when((i == 0) | (F.get(x, i - 1) != k - 1), k)), lambda k: k.isNotNull())))
    inner = [f"c{k}" for k in range(len(docs.columns))]
    out = met.select(
        *((F.when(some, text).otherwise(F.col(c)) if c == text_col else met[c]).alias(x) for x, c in zip(inner, docs.columns, strict=True)),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(_lines_of(F.col(text_col)))).cast("long").alias("_n_lines"),
        F.when(some, F.size(lines)).otherwise(F.lit(0)).cast("long").alias("_n_removed"), F.when(some, opens).otherwise(F.lit(0)).cast("long").alias("_n_chunks"),
    )
    return out.toDF(*docs.columns, *counts)
