"""Operator 9: removal of repeated runs of lines, by winnowing over line hashes.  Native: DataFrame functions only.

A run is a sequence of consecutive non-blank lines of one document.  A run of at least ``min_words``
words whose lines occur, in the same order and without other non-blank lines between, at an earlier
place is deleted with the blank lines inside it.  Places are ordered by document id (null first), then text, then line.
Shorter repeats (a licence line, a heading) stay: they are the noise that the threshold is for.

Method: windows are the shortest stretches from each line on, and up to each line, that have ``min_words`` words.  Each window
selects its least line hash (leftmost of equals); a selected line is one position, however many windows select it, and
its hash is its fingerprint.  A run of enough words holds a window, and equal windows select the same
line, so equal runs share a fingerprint wherever they stand.  Positions are joined by fingerprint; one that stands alone
goes.  A match is extended from the selected line both ways, over all the windows that selected it: positions whose whole
stretch is the same are one group, and all but its first place are deleted from end to end.  The first places of different stretches
around one fingerprint agree in part at most: there each window is matched on its own, by its content (128-bit hashes).  That reaches the
ends of a run exactly: every line of a long enough run lies in a window inside it.

No group is collected: first places are aggregated before the shuffle, positions meet the first place of their stretch by
a join that the adaptive skew join can split, and what is gathered for one document is bounded by its own number
of lines (spans are merged by a running maximum).

Null texts stay null; an empty text stays empty.  Rows of equal id and text are one document and are treated alike; texts of one id are
ordered by a sort over ranges, so an id of very many texts is in no single task.  Other columns pass through; a column named
``lines_deleted`` is replaced by the count.  An empty table gives no rows.
Words of a line: blanks in the trimmed line plus one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, stage, staging

MIN_WORDS = 50
KEY = ["line_dedup_id", "line_dedup_hash"]


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.withColumns({KEY[0]: F.col(id_col).cast("long"), KEY[1]: F.xxhash64(F.col(text_col))})


def _by_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the document key; null ids are equal."""
    return left.join(right, left[KEY[0]].eqNullSafe(right[KEY[0]]) & (left[KEY[1]] == right[KEY[1]]), how).drop(*(right[k] for k in KEY))


def positions(documents: DataFrame, min_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Selected lines: document key, line, fingerprint, the windows (first and last line, two content hashes), two hashes of all of them."""
    lines = _keyed(documents, id_col, text_col).select(*KEY, F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    trimmed = F.trim(F.col("line"))
    lines = lines.filter(trimmed != "").select(
        *KEY,
        "at",
        F.xxhash64("line").alias("h"),
        F.xxhash64(F.lit(7), F.col("line")).alias("g"),
        (F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"),
    ).distinct()  # rows of equal id and text
    document = Window.partitionBy(*KEY).orderBy("at")
    ordered = lines.withColumn("through", F.sum("words").over(document)).withColumn("before", F.col("through") - F.col("words"))
    forward = Window.partitionBy(*KEY).orderBy("before").rangeBetween(0, min_words - 1)
    backward = Window.partitionBy(*KEY).orderBy("through").rangeBetween(1 - min_words, 0)

    def content(frame: Window) -> F.Column:
        return F.struct(
            F.min("at").over(frame).alias("first"),
            F.max("at").over(frame).alias("last"),
            F.xxhash64(F.collect_list("h").over(frame)).alias("c1"),
            F.xxhash64(F.collect_list("g").over(frame)).alias("c2"),
            F.min(F.struct("h", "at")).over(frame).alias("selected"),
            F.sum("words").over(frame).alias("words"),
        )

    both = ordered.select(*KEY, content(forward).alias("f"), content(backward).alias("b"))
    windows = both.select(*KEY, F.explode(F.array_distinct(F.array("f", "b"))).alias("w")).filter(F.col("w.words") >= min_words)
    windows = windows.select(*KEY, F.col("w.selected.at").alias("at"), F.col("w.selected.h").alias("fingerprint"), F.struct("w.first", "w.last", "w.c1", "w.c2").alias("window"))
    selected = windows.groupBy(*KEY, "at", "fingerprint").agg(F.array_sort(F.collect_set("window")).alias("windows"))
    whole = lambda c: F.xxhash64(F.transform("windows", lambda w: w[c]))
    return selected.withColumns({"r1": whole("c1"), "r2": whole("c2")})


def text_order(documents: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Document key and rank, in order of text, of the documents of ids that have several texts."""
    keyed = _keyed(documents.filter(F.col(text_col).isNotNull()), id_col, text_col)
    several = keyed.groupBy(KEY[0]).agg((F.min(KEY[1]) != F.max(KEY[1])).alias("several")).filter("several").select(F.col(KEY[0]).alias("several_id"))
    several = stage(several, f"{root}/several")
    texts = keyed.join(several, keyed[KEY[0]].eqNullSafe(several["several_id"]), "left_semi").select(*KEY, F.col(text_col).alias("line_dedup_text")).distinct()
    return stage(texts.orderBy(KEY[0], "line_dedup_text").select(*KEY, F.monotonically_increasing_id().alias("rank")), f"{root}/order")


def repeated_spans(selected: DataFrame, order: DataFrame) -> DataFrame:
    """Document key, first, last: stretches of lines that occur earlier.  ``selected`` is read several times: give a written table."""
    alone = selected.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    met = _by_key(selected.join(alone, "fingerprint", "left_semi"), order, "left")
    met = met.withColumn("place", F.struct(KEY[0], F.coalesce("rank", F.lit(-1)).alias("rank"), "at", KEY[1])).select("place", "windows", "r1", "r2")
    origins = met.groupBy("r1", "r2").agg(F.min("place").alias("origin"))
    extended = met.join(origins, ["r1", "r2"])
    later = extended.filter(F.col("place") != F.col("origin")).select(*(F.col(f"place.{k}") for k in KEY), F.array_min(F.transform("windows", lambda w: w["first"])).alias("first"), F.array_max(F.transform("windows", lambda w: w["last"])).alias("last"))
    parts = extended.filter(F.col("place") == F.col("origin")).select("place", F.explode("windows").alias("w"))
    parts = parts.select(F.struct(f"place.{KEY[0]}", "place.rank", "w.first", f"place.{KEY[1]}").alias("place"), "w.last", "w.c1", "w.c2")
    first = parts.groupBy("c1", "c2").agg(F.min("place").alias("origin"), F.max("place").alias("latest")).filter(F.col("origin") != F.col("latest"))
    edges = parts.join(first.select("c1", "c2", "origin"), ["c1", "c2"]).filter(F.col("place") != F.col("origin"))
    return later.unionByName(edges.select(*(F.col(f"place.{k}") for k in KEY), "place.first", "last"))


def kept_stretches(spans: DataFrame) -> DataFrame:
    """Document key, gaps (start and length of each stretch of lines that stays before a deleted one), rest (the line after the last), deleted."""
    before = Window.partitionBy(*KEY).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("last").over(before), F.lit(-1))  # the last line deleted so far
    steps = spans.select(*KEY, "last", "first", reach.alias("reach"))
    gap = F.greatest(F.col("first") - F.col("reach") - 1, F.lit(0))
    gone = F.greatest(F.col("last") - F.greatest(F.col("reach"), F.col("first") - 1), F.lit(0))
    stays = F.struct((F.col("reach") + 1).alias("start"), gap.alias("length"))
    return steps.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.when(gap > 0, stays))).alias("gaps"), (F.max("last") + 1).alias("rest"), F.sum(gone).cast("int").alias("deleted"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated runs deleted, and ``lines_deleted``."""
    root = staging(documents.sparkSession, "lines")
    selected = stage(positions(documents, min_words, id_col, text_col), f"{root}/positions")
    spans = kept_stretches(repeated_spans(selected, text_order(documents, root, id_col, text_col)))
    names = [c for c in documents.columns if c != "lines_deleted"]
    joined = _by_key(_keyed(documents.select(*names), id_col, text_col), spans.select(*KEY, F.struct("gaps", "rest", "deleted").alias("line_dedup_spans")), "left")
    lines, at = F.split(F.col(text_col), "\n"), F.col("line_dedup_spans")
    tail = F.slice(lines, at["rest"] + 1, F.greatest(F.size(lines) - at["rest"], F.lit(0)))
    kept = F.concat(F.flatten(F.transform(at["gaps"], lambda g: F.slice(lines, g["start"] + 1, g["length"]))), tail)
    left = F.when(at.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(left.alias(c) if c == text_col else F.col(c) for c in names), F.coalesce(at["deleted"], F.lit(0)).alias("lines_deleted"))


def query(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(documents)


#: The same by contents, without hashes or fingerprints.
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
k AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k, doc_id, text, string_split(text, chr(10)) AS ls FROM d),
l0 AS (SELECT k, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM k),
l AS (SELECT k, pos, line, length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) + 1 AS words FROM l0 WHERE trim(line, ' ') <> ''),
o AS (SELECT *, CAST(sum(words) OVER (PARTITION BY k ORDER BY pos) AS BIGINT) AS through FROM l),
w0 AS (
  SELECT k, sum(words) OVER f AS words, min(pos) OVER f AS a, max(pos) OVER f AS z, list(line) OVER f AS c FROM o WINDOW f AS (PARTITION BY k ORDER BY through - words RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT k, sum(words) OVER f, min(pos) OVER f, max(pos) OVER f, list(line) OVER f FROM o WINDOW f AS (PARTITION BY k ORDER BY through RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
w AS (SELECT DISTINCT k, a, z, array_to_string(c, chr(10)) AS c FROM w0 WHERE words >= {MIN_WORDS}),
later AS (SELECT k, a, z FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k, a) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT l0.k, l0.pos FROM l0 JOIN later ON l0.k = later.k AND l0.pos BETWEEN later.a AND later.z),
kept AS (SELECT l0.k, coalesce(string_agg(line, chr(10) ORDER BY l0.pos) FILTER (WHERE gone.k IS NULL), '') AS text, count(gone.k) AS n FROM l0 LEFT JOIN gone ON l0.k = gone.k AND l0.pos = gone.pos GROUP BY l0.k)
SELECT documents.doc_id, kept.text AS text, CAST(coalesce(kept.n, 0) AS INTEGER) AS lines_deleted
FROM documents LEFT JOIN k ON documents.doc_id IS NOT DISTINCT FROM k.doc_id AND documents.text = k.text LEFT JOIN kept ON k.k = kept.k
"""
