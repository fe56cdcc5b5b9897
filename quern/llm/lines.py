"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

A line's shingles are anchored at its words, so that an inserted character moves
none of them: a word of six to twelve characters is one, a shorter word is
lengthened to six by what follows it (the next word at most), and a longer one,
such as a line in a script without spaces, gives all its windows of five. Every
character of a line is in a shingle.

1. Equal lines become one line, the first by document and place. Lines are told
   apart by two 64-bit hashes with different seeds; a line that many documents
   share is cut to one row in each task before anything is shuffled.
2. A line's signature is made of ``ROWS`` times ``COLUMNS`` MinHash values over its
   shingles: a shingle's 64-bit hash is combined with one constant for each value,
   and the least result of the line counts.
3. The values stand in a rectangle; its columns and diagonals are the bands. Two
   lines of similarity 0.8 share a band with a probability of 0.98, of 0.85 with 0.995.
4. In a band each line is compared with the band's first line, by the exact Jaccard
   similarity of all their shingles, as sets of 64-bit hashes. Pairs at or above the threshold make
   components. Bands whose lines are then still in several components are compared
   exactly, each line with all of other components, in cells of bounded size, until
   no two near lines of a band are apart.
5. Components, found by star rounds, keep the line that comes first.

Defined cases: null text counts as empty; lines of spaces only always stay; lines
with the same shingles, such as lines that differ in spaces, are near. Rows with one
doc_id are ordered by a hash of their texts; rows that repeat a doc_id and its text
are one document and keep the same lines. A null doc_id counts as larger than all
others. A document whose lines all go stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, written_by
from .graph import components
from .repeats import LAST

THRESHOLD = 0.8
#: Characters that a word is lengthened to, the longest word that is one shingle, and the windows of longer ones.
SHORT, LONG, WINDOW = 6, 12, 5
#: The rectangle of MinHash values; a band has one value of each row.
ROWS, COLUMNS, SLOPES = 4, 5, 2
#: Lines of a block; two blocks of a band are compared in one cell.
CELL = 128


def constants(n: int = ROWS * COLUMNS) -> list[int]:
    """One 64-bit constant for each MinHash value, by the steps of a multiplicative generator."""
    x, out = 0x9E3779B97F4A7C15, []
    for _ in range(n):
        x = (x * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64)
        out.append(x - (1 << 63))
    return out


def band_places(rows: int = ROWS, columns: int = COLUMNS, slopes: int = SLOPES) -> list[list[int]]:
    """The places of each band in the rectangle: its columns, then its diagonals."""
    return [[columns * r + (slope * r + c) % columns for r in range(rows)] for slope in range(slopes) for c in range(columns)]


def identity(doc_id: Column, text: Column) -> list[Column]:
    """doc and twin, which order and tell apart documents."""
    return [F.coalesce(doc_id.cast("long"), F.lit(int(LAST))).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("twin")]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def first_lines(documents: DataFrame) -> DataFrame:
    """h1, h2, doc, twin, no and line: the first of equal lines that are not blank."""
    told_apart = documents.select(*identity(F.col("doc_id"), F.col("text")), "text")  # first, as a text is hashed once and not for each of its lines
    every = told_apart.select("doc", "twin", F.posexplode(split_lines(F.col("text"))).alias("no", "line")).where(F.trim("line") != "")
    hashed = every.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), "doc", "twin", "no", "line")
    order = Window.partitionBy("h1", "h2").orderBy("doc", "twin", "no")
    return hashed.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def shingles(lines: DataFrame, *keys: str) -> DataFrame:
    """The keys and h, the hash of a shingle, of each shingle of ``line``. Rows instead of functions on arrays, as those are not compiled."""
    words = F.array_remove(F.split("line", " "), "")
    pairs = lines.select(*keys, words.alias("words")).select(*keys, F.inline(F.arrays_zip("words", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("after"))).alias("word", "after"))
    word = F.col("word")
    lengthened = F.substring(F.concat(word, F.lit(" "), F.coalesce("after", F.lit(""))), 1, SHORT)
    anchored = F.when(F.char_length(word) >= SHORT, F.substring(word, 1, LONG)).otherwise(lengthened)
    every = F.when(F.char_length(word) > LONG, F.regexp_extract_all(word, F.lit(rf"(?s)(?=(.{{{WINDOW}}}))"), 1)).otherwise(F.array(anchored))
    return pairs.select(*keys, F.explode(every).alias("shingle")).select(*keys, F.xxhash64("shingle").alias("h"))


def banded(first: DataFrame) -> DataFrame:
    """id and bands of lines (id, h1, h2, line); grouped by what the lines are dealt by."""
    hashes = shingles(first, "h1", "h2", "id")
    signed = hashes.groupBy("h1", "h2", "id").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"m{i}") for i, c in enumerate(constants())])
    return signed.select("id", F.array(*[F.xxhash64(F.lit(k), *[f"m{i}" for i in places]) for k, places in enumerate(band_places())]).alias("bands"))


def only_wanted(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 27) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``, by a bitmap of hashed keys.

    The bitmap has at most 2 ** bits bits (16 MB) however many keys there are, so it is safe to
    broadcast; when it is full it lets every row pass, and the join that follows decides."""
    number = F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1
    bitmap = wanted.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))
    at = F.bitmap_bit_position(number)
    byte = F.ascii(F.decode(F.substr(F.col("bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bitmap), "bucket")
    return joined.where(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1)) != 0).drop("bucket", "bitmap")


def near(a: Column, b: Column, both: Column, threshold: float) -> Column:
    """Whether two sets, ``both`` of whose elements are common, have at least the threshold's Jaccard similarity."""
    return both >= F.lit(threshold) * (F.size(a) + F.size(b) - both) - 1e-9


def mask_of(h: Column) -> Column:
    """An aggregate: 64 bits, of which each hash sets one."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")))


def can_be_near(a: Column, b: Column, mask_a: Column, mask_b: Column, threshold: float) -> Column:
    """False only for sets below the threshold: each bit that only one mask has stands for an element, at least, that only its set has."""
    only = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    return near(a, b, F.least(F.size(a) - only(mask_a, mask_b), F.size(b) - only(mask_b, mask_a)), threshold)


def near_in_cell(members: Column, threshold: float) -> Column:
    """Of each asking member (id, component, rest, asks, set, mask) of a cell that is near to others of other components:
    a (its component), b (the smallest of theirs) and more (whether there are several). Of two that both ask in
    their band the later one asks."""

    def alike(x, y):
        apart = (y["component"] != x["component"]) & (~y["rest"] | (y["id"] < x["id"]))
        possible = can_be_near(x["set"], y["set"], x["mask"], y["mask"], threshold)
        return F.when(~apart, False).when(~possible, False).otherwise(F.transform(F.array(F.size(F.array_intersect(x["set"], y["set"]))), lambda c: near(x["set"], y["set"], c, threshold))[0])

    def links(cell):
        found = F.transform(F.filter(cell, lambda x: x["asks"]), lambda x: F.struct(x["component"].alias("a"), F.transform(F.filter(cell, lambda y: F.when(y["asks"], False).otherwise(alike(x, y))), lambda y: y["component"]).alias("to")))
        return F.transform(F.filter(found, lambda x: F.size(x["to"]) > 0), lambda x: F.struct(x["a"].alias("a"), F.array_min(x["to"]).alias("b"), (F.array_min(x["to"]) < F.array_max(x["to"])).alias("more")))

    return F.transform(F.array(members), links)[0]


def cells_of(placed: DataFrame, sets: DataFrame, cell: int = CELL) -> DataFrame:
    """(band, members) of bands (band, id, component): the lines outside a band's largest component ask, all are asked.

    Both are dealt into blocks of about ``cell`` lines, and each two blocks share a cell, so lines of the largest
    component are never compared with each other, and if few are outside, all others are in one cell each."""
    counted = placed.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / cell).cast("int")
    sized = placed.join(counted.where("most < n").select("band", "main", blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("most")).alias("rest_blocks")), "band").join(sets, "id").withColumn("rest", F.col("component") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = sized.where("rest").select("band", own("rest_blocks").alias("i"), upto("all_blocks").alias("j"), "id", "component", "rest", F.lit(True).alias("asks"), "set", "mask")
    asked = sized.select("band", upto("rest_blocks").alias("i"), own("all_blocks").alias("j"), "id", "component", "rest", F.lit(False).alias("asks"), "set", "mask")
    return asking.unionByName(asked).groupBy("band", "i", "j").agg(F.collect_list(F.struct("id", "component", "rest", "asks", "set", "mask")).alias("members")).select("band", "members")


def rest_of_bands(met: DataFrame, groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``groups`` (id, component) united over all near lines of bands whose lines are in several; of bands with the same lines one counts.

    A line makes one link in a round, however many lines it is near to; bands in which one was near to several
    components are looked at again after these links, so a round halves the components that are still apart."""
    bands = None
    while True:
        placed = met.where("n > 2").select("band", "id").join(groups, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
        if bands is None:
            parted = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "id")).alias("y")).where("least <> most")
            bands = durable(parted.groupBy("members", "x", "y").agg(F.min("band").alias("band")).select("band"))
        found = durable(cells_of(placed.join(bands, "band"), sets).select("band", F.explode(near_in_cell(F.col("members"), threshold)).alias("p")).select("band", "p.*"))
        if found.isEmpty():
            return groups
        joined = durable(components(found))
        moved = groups.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        groups = durable(moved.unionByName(joined.join(groups.select("id"), "id", "left_anti")))
        bands = durable(found.where("more").select("band").distinct())
        if bands.isEmpty():
            return groups


def near_lines(documents: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, doc, twin, no and line of the distinct lines, dealt by their hashes; id and component of those that have near copies)."""
    lines = written_by(first_lines(documents).withColumn("id", F.monotonically_increasing_id()), "h1", "h2")
    in_bands = banded(lines).select("id", F.explode("bands").alias("band")).repartition("band")  # one exchange serves the heads and the join with them
    heads = in_bands.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    met = durable(in_bands.join(heads.hint("shuffle_hash"), "band"))  # few bands have several lines, so a table of them spares sorting all
    pairs = met.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    wanted = met.select("id").distinct()
    texts = only_wanted(lines.select("id", "line"), wanted, "id").join(wanted.hint("shuffle_hash"), "id")  # no semi join, as that is moved before the bitmap
    sets = durable(shingles(texts, "id").groupBy("id").agg(F.collect_set("h").alias("set"), mask_of(F.col("h")).alias("mask")))
    side = lambda s: sets.select(F.col("id").alias(s), F.col("set").alias(f"set_{s}"), F.col("mask").alias(f"mask_{s}"))
    sided = pairs.join(side("a"), "a").join(side("b"), "b")
    common = sided.where(can_be_near(F.col("set_a"), F.col("set_b"), F.col("mask_a"), F.col("mask_b"), threshold)).select("a", "b", "set_a", "set_b", F.size(F.array_intersect("set_a", "set_b")).alias("both"))
    groups = durable(components(common.where(near(F.col("set_a"), F.col("set_b"), F.col("both"), threshold)).select("a", "b")))
    return lines, rest_of_bands(met, groups, sets, threshold)


def kept_lines(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc, twin and kept (the numbers, from 0, of the lines that stay) of documents that keep lines that are not blank."""
    lines, groups = near_lines(documents, threshold)
    placed = lines.select("id", "doc", "twin", "no")
    first = placed.join(groups.hint("shuffle_hash"), "id").groupBy("component").agg(F.min(F.struct("doc", "twin", "no", "id")).alias("first"))
    gone = groups.join(first, "component").where(F.col("id") != F.col("first.id")).select("id")
    return placed.join(gone.hint("shuffle_hash"), "id", "left_anti").groupBy("doc", "twin").agg(F.collect_list("no").alias("kept"))


def removed_lines(lines: Column, kept: Column) -> Column:
    """The numbers of the lines of a text that are not blank and do not stay."""
    filled = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    return F.array_except(filled, F.coalesce(kept, F.array().cast("array<int>")))


def drop_repeats(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without the repeated lines; n_chars, where there is one, follows."""
    given = documents.select(F.struct("*").alias("row"), *identity(F.col("doc_id"), F.col("text"))).join(kept_lines(documents, threshold), ["doc", "twin"], "left")
    judged = F.transform(F.array(F.struct(split_lines(F.col("row.text")).alias("lines"), F.col("kept"))), lambda x: F.struct(x["lines"].alias("lines"), removed_lines(x["lines"], x["kept"]).alias("removed")))
    rest = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["removed"]), lambda i: F.get(x["lines"], i)), "\n")
    text = F.transform(judged, lambda x: F.when(F.size(x["removed"]) > 0, rest(x)))[0]
    out = given.select("row", text.alias("shorter"))
    new = {"text": F.coalesce("shorter", "row.text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("shorter").isNull(), F.col("row.n_chars")).otherwise(F.char_length("shorter").cast(documents.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])


def summary(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (sorted numbers, from 0, of the lines to go) for every row of ``documents``."""
    filled = F.filter(F.transform(split_lines(F.col("text")), lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    counted = documents.select("doc_id", *identity(F.col("doc_id"), F.col("text")), F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"), filled.alias("filled"))
    joined = counted.join(kept_lines(documents, threshold), ["doc", "twin"], "left")
    removed = F.array_except("filled", F.coalesce("kept", F.array().cast("array<int>")))
    return joined.select("doc_id", "n_lines", removed.alias("removed")).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")
