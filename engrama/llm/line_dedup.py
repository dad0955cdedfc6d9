"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Lines are compared lower-cased and without white space at their ends. Equal lines meet under a 64-bit hash. The shingles of
a line are all its runs of 8 characters; a shorter line is one shingle. All shingles of every line are signed, at every
length and in every script: the line is encoded with four bytes a character, cut by position and exploded, and a shingle's
hash puts it into one of 12 classes. In each class the minima of hash ^ constant for four constants are one partial
aggregation in generated code; together they are one band. So a shingle costs four minima instead of 48, and as a class of
shingles has the similarity of the whole on average, the twelve bands find a pair of similarity 0.8 with probability 0.998
at least (bands_for: of all ways a mean of fourth powers can come about, an even one gives the fewest matches), and one of
0.85 with 0.9999. Four bits of each minimum make a sketch; candidates that differ in more than MOST_APART of the 48 minima
are given up unread: at 0.8 a pair differs in 9 on average with a deviation of about 2.7. What is left is confirmed by the
exact Jaccard similarity of all shingles. Candidates are compared by leaders and open classes (link_classes); distributed
union-find gives components, and of all lines of a component the first, by id of the document and place in it, stays.

The distinct lines are a table bucketed by their hash: signing lines, making sketches of those that share a band with another
line, and fetching their texts moves them no more. Sketches are made of these lines only.

Cases: blank lines are no lines and always stay; a null text has no lines and stays null; rows with one id and different
texts are told apart by a hash of the text, fully equal rows with one id are treated alike: a line first found in them stays
in each; null ids come last; an empty table gives an empty result; a text all of whose lines go becomes empty. Extra columns
are untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, scratch, shared_dir, shuffles_dropped, stage
from .links import link_classes

SHINGLE = 8
WIDTH = 4  # bytes of a character in UTF-32
EDGE = " \t\r\x0b\x0c"
BLOCK_LINES = 256
LAST = (1 << 63) - 1
MOST_APART = 20  # of 48 minima
#: The minima of a class: hash ^ constant. Their first two bits differ, so each looks into a quarter of its own first.
ORDERS = (0x0F1BBCDCBFA53E0B, 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15 - (1 << 64), 0xD6E8FEB86659FD93 - (1 << 64))


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands of so many rows that find a pair of the similarity with the recall."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def trimmed(line: Column) -> Column:
    """Without white space at the ends; trimming walks over the whole line, so only lines that need it are trimmed."""
    needed = F.lit(False)
    for c in EDGE:
        needed = needed | line.startswith(c) | line.endswith(c)
    return F.when(needed, F.btrim(line, F.lit(EDGE))).otherwise(line)


def normal(line: Column) -> Column:
    return F.lower(trimmed(line))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wide(line: Column) -> Column:
    return F.encode(line, "UTF-32")


def starts(coded: Column) -> Column:
    """Where the shingles of a line in UTF-32 begin, in bytes from 1."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(coded) - (SHINGLE * WIDTH - 1), F.lit(1)), F.lit(WIDTH))


def shingle_hash(coded: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(coded, start, F.lit(SHINGLE * WIDTH)))


def shingles(line: Column) -> Column:
    """The hashes of all shingles, repeats included. What is done to them is to stand outside any lambda, where the functions
    of sets work on primitive values in generated code, and in a later select, as what holds a lambda is worked out anew
    wherever it is named."""
    return let(wide(line), lambda coded: F.transform(starts(coded), lambda k: shingle_hash(coded, k)))


def least_common(total: Column, similarity: float) -> Column:
    """The fewest common members by which two sets that have so many members together reach the Jaccard similarity."""
    holds = lambda both: both >= F.lit(similarity) * (total - both)
    about = F.floor(total * F.lit(similarity / (1 + similarity))).cast("int")  # rounding may put it one off
    return F.when(holds(about - 1), about - 1).when(holds(about), about).otherwise(about + 1)


def alike(one: Column, two: Column, similarity: float) -> Column:
    """Whether two arrays without repeats have the Jaccard similarity as sets; sizes too far apart are told from the sizes."""
    n, m = F.size(one), F.size(two)
    return (F.least(n, m) >= F.lit(similarity) * F.greatest(n, m)) & (F.size(F.array_intersect(one, two)) >= least_common(n + m, similarity))


def close(one: Column, two: Column, longs: int) -> Column:
    """Whether two sketches agree in enough minima for the pair to be compared."""
    apart = F.lit(0)
    for k in range(longs):
        d = one[k].bitwiseXOR(two[k])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))  # the lowest of each four bits says whether any differs
        apart = apart + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return apart <= MOST_APART


def compared(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, same) of pairs (a, b, line_a, line_b): whether the lines have the similarity. Each line is cut once, in a select
    of its own; a filter on the outcome would be moved below it and cut them for each mention, so it is to follow a stage."""
    sides = pairs.select("a", "b", shingles(F.col("line_a")).alias("one"), shingles(F.col("line_b")).alias("two"))
    same = F.size(F.array_intersect("one", "two")) >= F.lit(similarity) * F.size(F.array_union("one", "two"))
    return sides.select("a", "b", same.alias("same"))


def _split(text_col: str) -> Column:
    return F.split(text_col, "\n", -1)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (null last), tk (hash of the text), pos, line (normal form), lid (its hash), without blank lines."""
    out = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("tk"), _split(text_col).alias("lines"))
    out = out.select("doc", "tk", F.posexplode("lines").alias("pos", "line"))
    out = out.where(trimmed(F.col("line")) != "").withColumn("line", normal(F.col("line")))
    return out.withColumn("lid", F.xxhash64("line"))


def _distinct(lines: DataFrame) -> str:
    """The name of a new table (lid, line) of the distinct lines, bucketed and sorted by lid; its files lie in the shared
    folder and outlive one scratch()."""
    spark = lines.sparkSession
    table, buckets = f"lines_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, path = lines.select("lid", "line").dropDuplicates(["lid"]), shared_dir(spark, "lines", keep=True)
    with shuffles_dropped(spark):
        rows.write.bucketBy(buckets, "lid").sortBy("lid").option("compression", "zstd").format("parquet").option("path", path).saveAsTable(table)
    return table


@contextmanager
def _wide_first_map(spark: SparkSession) -> Iterator[None]:
    """A write made inside aggregates in a first-level map of a million groups (64 MB at most) before the general one."""
    name = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before = spark.conf.get(name)
    spark.conf.set(name, "20")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _signatures(lines: DataFrame, bands: int) -> DataFrame:
    """(id, key, word, bits) of lines (lid, line): for each class that has shingles, the key of its band and its part of the
    sketch, some bits of the long that has the number word."""
    coded = lines.select("lid", wide(F.col("line")).alias("coded"))
    each = coded.select("lid", "coded", F.explode(starts(F.col("coded"))).alias("k")).select("lid", shingle_hash(F.col("coded"), F.col("k")).alias("h"))
    minima = [F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"m{r}") for r, c in enumerate(ORDERS)]
    by_class = each.groupBy("lid", F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * bands, 32).cast("int").alias("class")).agg(*minima)
    bits = F.lit(0).cast("long")
    for r in range(len(ORDERS)):
        bits = bits.bitwiseOR(F.shiftleft(F.shiftright(f"m{r}", 17).bitwiseAND(F.lit(15)), 4 * r))
    keyed = by_class.select("lid", "class", F.xxhash64("class", *[f"m{r}" for r in range(len(ORDERS))]).alias("key"), bits.alias("bits"))
    place = F.expr("shiftleft(bits, cast(class % 4 * 16 as int))")  # four classes in a long
    return keyed.select(F.col("lid").alias("id"), "key", F.expr("class div 4").cast("int").alias("word"), place.alias("bits"))


def _sketches(signs: DataFrame, bands: int) -> DataFrame:
    """(lid, sketch) of signatures."""
    parts = [F.bit_or(F.when(F.col("word") == k, F.col("bits")).otherwise(F.lit(0).cast("long"))) for k in range(-(-bands // 4))]
    return signs.groupBy(F.col("id").alias("lid")).agg(F.array(*parts).alias("sketch"))


def _postings(signs: DataFrame) -> DataFrame:
    """(bucket, id) of the bands that two lines share at least. They are dealt once: the smallest and the largest id need the
    same columns as the join, so both read one exchange."""
    posts = signs.select("id", F.col("key").alias("bucket")).repartition("bucket")
    buckets = posts.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    return posts.join(buckets.hint("shuffle_hash"), "bucket").select("bucket", "id")


def line_components(docs: DataFrame, similarity: float = 0.8, recall: float = 0.998, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """Places of lines (doc, tk, pos, lid), staged, and classes (id, component) of the hashes of lines that have links."""
    spark = docs.sparkSession
    with scratch(spark):  # lines are cut once; their texts go when the table of the distinct ones is there
        lines = stage(_lines(docs, id_col, text_col), "line-cut")
        places = stage(lines.select("doc", "tk", "pos", "lid"), "line-places", keep=True)
        table = _distinct(lines)
    bands = bands_for(similarity, len(ORDERS), recall)
    near = lambda x, y: close(x, y, -(-bands // 4))
    with _wide_first_map(spark):
        members = stage(_postings(_signatures(spark.table(table), bands)), "line-postings")
    # what is hashed here are longs, each of them once: buckets that two lines share at least, and ids of lines in them
    # lines that share a band are signed again for their sketches: cheaper than to keep the signatures of all lines
    shared = spark.table(table).join(members.select(F.col("id").alias("lid")).distinct().hint("shuffle_hash"), "lid", "left_semi")
    with _wide_first_map(spark):
        texts = stage(spark.table(table).join(_sketches(_signatures(shared, bands), bands).hint("shuffle_merge"), "lid"), "line-texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("line_a"), F.col("sketch").alias("sketch_a")).hint("shuffle_merge"), "a")
        pairs = pairs.join(texts.select(F.col("lid").alias("b"), F.col("line").alias("line_b"), F.col("sketch").alias("sketch_b")).hint("shuffle_merge"), "b")
        pairs = pairs.where(near(F.col("sketch_a"), F.col("sketch_b")))
        return stage(compared(pairs, similarity), "line-compared").where("same").select("a", "b")

    def confirm_lists(open_: DataFrame) -> DataFrame:
        """A list is dealt into blocks of about BLOCK_LINES lines and each pair of blocks is one key of a join, in which lines
        of different classes are compared if this is the first list that they share; only links leave it. Texts travel, and
        are cut where they arrive."""
        own = members.join(open_.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_list("bucket").alias("bands"))
        each = open_.join(own, "id").join(texts.withColumnRenamed("lid", "id"), "id")
        each = each.withColumn("blocks", F.ceil(F.col("n") / BLOCK_LINES).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = each.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "c", "bands", "sketch", "line")

        def side(number: str, suffix: str) -> DataFrame:
            rows = each.where(F.col("block") == F.col(number)).repartition("bucket", "i", "j")
            rows = rows.select("bucket", "i", "j", "id", "c", "bands", "sketch", F.array_distinct(shingles(F.col("line"))).alias("s"))
            return rows.select("bucket", "i", "j", *[F.col(c).alias(f"{c}_{suffix}") for c in ("id", "c", "bands", "sketch", "s")])

        x, y = ({c: F.col(f"{c}_{suffix}") for c in ("id", "c", "bands", "sketch", "s")} for suffix in "xy")
        # within one block both sides are the same lines; between blocks either may have the smaller id
        once = (x["c"] != y["c"]) & ((F.col("l.i") < F.col("l.j")) | (x["id"] < y["id"]))
        first = F.array_min(F.array_intersect(x["bands"], y["bands"])) == F.col("l.bucket")
        keys = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("bucket", "i", "j")]
        met = side("i", "x").alias("l").join(side("j", "y").hint("merge").alias("r"), [*keys, once & near(x["sketch"], y["sketch"])])
        # in the join's condition the rest would make its method too long to be compiled; the explode stands in a method of its own
        link = F.struct(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
        return met.select(F.explode(F.when(first & alike(x["s"], y["s"], similarity), F.array(link))).alias("p")).select("p.a", "p.b")

    classes = link_classes(members.select("bucket", "id"), confirm, confirm_lists, "lines", leaders=1)
    spark.sql(f"DROP TABLE {table}")  # all that follows reads staged rows
    return places, classes


def dropped_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc, tk, gone): for each document that loses lines, their positions."""
    with scratch(docs.sparkSession):
        places, classes = line_components(docs, **options)
        total = places.count()
        if classes is None:
            places = places.withColumn("c", F.col("lid"))
        else:
            places = places.join(classes, F.col("lid") == F.col("id"), "left").select("doc", "tk", "pos", F.coalesce("component", "lid").alias("c"))
            places = stage(places, "line-classed")
        at = F.struct("doc", "tk", "pos")
        firsts = stage(places.groupBy("c").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-firsts")
        # a line on which a large share of all documents agree is looked up by broadcast, the others by a join
        gone = attach_groups(places, firsts, "c", "n", total, "doc").where("n > 1").where(at != F.col("first"))
        return stage(gone.groupBy("doc", "tk").agg(F.collect_set("pos").alias("gone")), "line-drops", keep=True)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the lines that go, and n_lines and n_dropped: how many lines it had, blank ones included, and how many went.

    Columns of docs with these two names are replaced.
    """
    drops = dropped_lines(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias("__doc"), F.col("tk").alias("__tk"), F.col("gone").alias("__gone"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    out = docs.join(drops.hint("shuffle_merge"), (key == F.col("__doc")) & (F.xxhash64(text_col) == F.col("__tk")), "left")
    lines = _split(text_col)
    left = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda x, k: ~F.array_contains("__gone", k)), "\n"))
    breaks = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))  # only texts that lose lines are split
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(breaks + 1).cast("long")
    n_dropped = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long")
    others = [left.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*others, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
