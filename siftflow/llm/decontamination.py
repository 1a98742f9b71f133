"""Benchmark decontamination with a distributed positional inverted index.

The documents are split into words once, into a written table. How often each term of the items occurs is counted over all
documents, and each window of an item takes its two rarest terms. The index, a written table too, holds (term, row, pos) for
every place of those terms. The list of a window's rarest term, shifted by its offset in the window, gives candidate starts;
those stay that the shifted list of the second confirms. What remains is compared with the document's words, so the match is
exact whatever the index hashes. Windows with a term that no document has are dropped. Of the texts only those with a candidate
move to that comparison (see common.parted).

Native: DataFrame functions only. The items are the stated query set. Their terms and windows are broadcast if there are at
most BROADCAST_ROWS of them, which is checked, and joined by a shuffle otherwise.

A null text or item text has no words. Rows are judged each for themselves, whatever their doc_id, which may be null or
repeated. Other columns of either table are ignored. Repeated item rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftflow.llm.common import numbered, parted, word_array, written

WINDOW = 10
BROADCAST_ROWS = 300_000


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(wid, phrase, n, items): distinct windows; an item with fewer words, but not none, is one."""
    words = items.select(F.col(id_col).alias("item"), word_array(F.col(text_col)).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    each = words.select("item", "n", F.explode(F.expr("transform(sequence(0, size(w) - n), i -> array_join(slice(w, i + 1, n), ' '))")).alias("phrase"))
    found = each.groupBy("phrase", "n").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return found.select(F.xxhash64("phrase", F.lit(1)).alias("wid"), "phrase", "n", "items")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def split_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table (row, doc_id, words, n_words): the words joined by one space."""
    rows = numbered(docs, id_col, text_col).select("row", "doc_id", word_array(F.col("text")).alias("w"))
    return written(rows.select("row", "doc_id", F.array_join("w", " ").alias("words"), F.size("w").cast("long").alias("n_words")), "words")


def places(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, row, pos): the places of the given terms, a term being the hash of a word."""
    each = words.select("row", F.posexplode(F.split("words", " ")).alias("pos", "word")).select(F.xxhash64("word").alias("term"), "row", "pos")
    return each.join(small(terms), "term", "left_semi")


def term_counts(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): in how many places each of the given terms stands, if in any."""
    return places(words, terms).groupBy("term").agg(F.count("*").alias("df"))


def window_terms(windows: DataFrame) -> DataFrame:
    return windows.select("wid", "n", F.posexplode(F.split("phrase", " ")).alias("off", "word")).select("wid", "n", "off", F.xxhash64("word").alias("term"))


def seeds_of(windows: DataFrame, often: DataFrame) -> DataFrame:
    """A written table (wid, term1, off1, term2, off2): the two rarest terms of each window, the second null in windows of one word."""
    terms = window_terms(windows).join(often, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = terms.withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy("df", "off")))
    seeds = ranked.groupBy("wid").agg(*(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("term", "off", "df")))
    return written(seeds.where("df1 > 0").drop("df1", "df2"), "seeds")


def candidates(seeds: DataFrame, index: DataFrame) -> DataFrame:
    """(wid, row, start): where the two rarest terms of a window stand at their offsets.

    Windows that overlap mostly share their two terms and the gap between them, so places are confirmed once for all of those.
    """
    seeds = seeds.withColumn("gap", F.col("off2") - F.col("off1"))
    pairs = small(seeds.where("term2 IS NOT NULL").select("term1", "term2", "gap").distinct())
    first = index.select(F.col("term").alias("term1"), "row", F.col("pos").alias("pos1")).join(pairs, "term1")
    second = index.join(small(seeds.where("term2 IS NOT NULL").select(F.col("term2").alias("term")).distinct()), "term", "left_semi").select(F.col("term").alias("term2"), "row", "pos")
    both = first.withColumn("pos", F.col("pos1") + F.col("gap")).where("pos >= 0").join(second, ["term2", "row", "pos"], "left_semi").join(small(seeds), ["term1", "term2", "gap"])
    single = index.select(F.col("term").alias("term1"), "row", F.col("pos").alias("pos1")).join(small(seeds.where("term2 IS NULL")), "term1")
    start = (F.col("pos1") - F.col("off1")).alias("start")
    return both.select("wid", "row", start).unionByName(single.select("wid", "row", start)).where("start >= 0")


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, hits (array of exact matches: start, n, items)."""
    windows = written(item_windows(items, item_col, item_text, window), "item_windows")
    words = split_words(docs, id_col, text_col)
    often = written(term_counts(words, window_terms(windows).select("term").distinct()), "term_counts")
    seeds = seeds_of(windows, often)
    sought = seeds.select(F.explode(F.array("term1", "term2")).alias("term")).where("term IS NOT NULL").distinct()
    index = written(places(words, sought), "postings")
    found = written(candidates(seeds, index).join(small(windows), "wid").groupBy("row").agg(F.collect_list(F.struct("start", "n", "phrase", "items")).alias("maybe")), "candidates")
    asked = parted(words.select("row", "words"), found, "row")[0].join(found, "row").withColumn("w", F.split("words", " "))
    exact = F.expr("filter(maybe, m -> array_join(slice(w, m.start + 1, m.n), ' ') = m.phrase)")
    hits = written(asked.select("row", exact.alias("hits")).where(F.size("hits") > 0), "hits")
    kind = "array<struct<start:int,n:int,phrase:string,items:array<string>>>"
    some, none = parted(words.select("row", "doc_id", "n_words"), hits, "row")
    joined = some.join(hits, "row", "left").unionByName(none.withColumn("hits", F.lit(None).cast(kind)))
    return joined.select("doc_id", "n_words", F.coalesce("hits", F.array().cast(kind)).alias("hits"))


def contamination(docs: DataFrame, items: DataFrame, **cols) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside matches), items (sorted ids as strings), contaminated."""
    m = phrase_matches(docs, items, **cols)
    hit = F.size(F.expr("array_distinct(flatten(transform(hits, h -> sequence(h.start, h.start + h.n - 1))))")).cast("long")
    found = m.select("doc_id", "n_words", hit.alias("n_hit"), F.expr("array_sort(array_distinct(flatten(transform(hits, h -> h.items))))").alias("items"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def proximity_matches(docs: DataFrame, items: DataFrame, terms: int = 3, slop: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, doc_id): the item's `terms` rarest different terms (all, if it has fewer) lie within `slop` consecutive words.

    Postings fall into two overlapping rows of bins of 2 x slop words, so any slop consecutive words lie in one bin, and a bin
    holds at most 2 x slop places. A row per item and document row that match; null ids are null there too.
    """
    own = items.select(F.col(item_col).cast("string").alias("item"), F.explode(F.array_distinct(word_array(F.col(item_text)))).alias("word")).select("item", F.xxhash64("word").alias("term")).distinct()
    words = split_words(docs, id_col, text_col)
    often = term_counts(words, own.select("term").distinct())
    ranked = own.join(often, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("df", "term"))).where(F.col("r") <= terms)
    ranked = written(ranked.withColumn("need", F.count("*").over(Window.partitionBy("item"))).select("item", "term", "need"), "rarest")
    at = written(places(words, ranked.select("term").distinct()), "postings").join(small(ranked), "term")
    bins = at.withColumn("b", F.explode(F.array(F.struct(F.lit(0).alias("of"), F.floor(F.col("pos") / (2 * slop)).alias("at")), F.struct(F.lit(1).alias("of"), F.floor((F.col("pos") + slop) / (2 * slop)).alias("at")))))
    held = bins.groupBy("item", "row", "need", "b").agg(F.countDistinct("term").alias("n"), F.collect_set(F.struct("pos", "term")).alias("p")).where("n = need")
    near = held.where(F.exists("p", lambda x: F.size(F.array_distinct(F.transform(F.filter("p", lambda y: (y.pos >= x.pos) & (y.pos < x.pos + slop)), lambda y: y.term))) == F.col("need")))
    found = written(near.select("item", "row").distinct(), "near")
    return parted(words.select("row", "doc_id"), found, "row")[0].join(found, "row").select("item", "doc_id")
