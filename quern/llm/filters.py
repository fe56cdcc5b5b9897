"""Audit of how document filters interact, over every order of applying them.

Each row gets a mask of the five filters that it fails. Rows are counted by part and
mask, so at most 32 cells a part are left of any number of documents. Each cell then
meets the array of all 120 orders, which is broadcast, and folds it: ``transform``
takes one order at a time and ``aggregate`` walks its five steps, so a cell gives 600
structs weighted by its counts. The cells of a part are added up element by element.

Failure conditions (words: maximal runs of characters that are not white space in
ASCII): A under 200 words; B fewer than half as many distinct words as words; C more
than 2 % of the code points are A to Z; D holds one of ``#$%&*|``; E the text equals
one of a row with a smaller doc_id.

E compares whole texts by SHA-256. The first doc_id of a text is found by a sum that
is combined before it is shuffled, and rows ask for it by text and doc_id together, so
a text that a third of all rows share is dealt over all tasks.

Defined cases: a null text is empty and a null source is the part ''; a row with a null
doc_id has no smaller doc_id, is not itself one, and has no label; rows that repeat a
doc_id with its text are no copies of each other; a document labelled more than once
counts as good or toxic if any of its labels says so; null labels say nothing; an empty
table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
MASKS = 1 << len(FILTERS)

LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2


def failures(text) -> list:
    """The conditions A to D of a text column."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.size(words) - (trimmed == "").cast("int")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n, 100 * upper > UPPER_PERCENT * F.length(text), text.rlike("[#$%&*|]")]


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, part, the hash of the text and the mask of A to D of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(F.col("text")))), F.lit(0))
    return own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.alias("mask"))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of a part fail exactly the mask's filters."""
    rows = durable(judged(documents))
    known = rows.where("doc_id is not null")
    first = known.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    asked = known.join(told, "doc_id", "left").join(first, ["doc_id", "key"], "left")
    copy = F.when(F.col("is_first"), 0).otherwise(1 << FILTERS.index("E"))
    marked = asked.select("part", (F.col("mask") + copy).alias("mask"), "good", "toxic")
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return marked.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def _walked(order, mask, n, good, toxic):
    """The five structs of one order (places of filters) for a cell."""
    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    zero = F.lit(0).cast("long")

    def step(state, place):
        bit = F.element_at(F.lit([1 << i for i in range(len(FILTERS))]), place + 1)
        fails = mask.bitwiseAND(bit) != 0
        here = state["alive"] & fails
        values = [F.when(state["alive"] & ~fails, n), F.when(here, n), F.when(~state["alive"] & fails, n), F.when(mask == bit, n), F.when(here, good), F.when(here, toxic)]
        made = F.struct(*[F.coalesce(v, zero).alias(c) for c, v in zip(COUNTS, values, strict=True)])
        return F.struct((state["alive"] & ~fails).alias("alive"), F.concat(state["steps"], F.array(made)).cast(kind).alias("steps"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("steps"))
    return F.aggregate(order, start, step, lambda state: state["steps"])


def folded(counted: DataFrame) -> DataFrame:
    """(part, sums): the 600 summed structs of each part, by order and step."""
    spark = counted.sparkSession
    orders = F.lit([[FILTERS.index(f) for f in order] for order in ORDERS])
    table = spark.range(MASKS).select(F.col("id").cast("int").alias("mask"), orders.alias("orders"))
    met = counted.join(F.broadcast(table), "mask")
    each = met.select("part", F.flatten(F.transform("orders", lambda o: _walked(o, F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")))).alias("steps"))
    gathered = each.groupBy("part").agg(F.collect_list("steps").alias("of_cells"))
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    return gathered.select("part", F.aggregate(F.slice("of_cells", 2, MASKS), F.col("of_cells")[0], lambda sums, cell: F.zip_with(sums, cell, add)).alias("sums"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, with the counts of ``COUNTS`` and ``shapley``.

    A part's cells are at most 32, so what is gathered of a part has a fixed size."""
    steps, places = len(FILTERS), F.lit([FILTERS.index(f) for order in ORDERS for f in order])
    rows = folded(cells(documents, labels)).select("part", F.posexplode("sums").alias("at", "sums"))
    own = Window.partitionBy("part", F.element_at(places, F.col("at") + 1))
    return rows.select(
        "part",
        F.element_at(F.lit(ORDERS), F.floor(F.col("at") / steps).cast("int") + 1).alias("filter_order"),
        (F.col("at") % steps + 1).cast("int").alias("step"),
        *[f"sums.{c}" for c in COUNTS],
        F.sum("sums.removed").over(own).alias("shapley"),
    )


#: The same in DuckDB.
SQL = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
failed AS (
  SELECT w.part, coalesce(t.good, 0) AS good, coalesce(t.toxic, 0) AS toxic,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e
  FROM words w LEFT JOIN told t ON w.doc_id = t.doc_id
),
cells AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY part, a, b, c, d, e
),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(f, i)),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS places
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE q.i <> p.i AND r.i NOT IN (p.i, q.i) AND s.i NOT IN (p.i, q.i, r.i) AND t.i NOT IN (p.i, q.i, r.i, s.i)
),
steps AS (
  SELECT part, filter_order, step, places[step] AS place, n, good, toxic,
         fails[places[step]] AS fail,
         len(list_filter(places[1:step - 1], lambda p: fails[p])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM cells, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
summed AS (
  SELECT part, filter_order, step, place,
         sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fail AND single THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, place
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, place) AS BIGINT) AS shapley
FROM summed
"""
