"""Benchmark decontamination over a positional inverted index, with DataFrame operations only.

The index holds one posting (row, pos, term) for every document word that some benchmark window uses,
as a written table dealt by document, so building it needs no shuffle. Each window then asks for its
terms from the rarest to the most frequent: the postings of the rarest give candidate starts (position
less the term's offset in the window), and each further term keeps the starts that have it at its own
offset. The two next rarest terms cut nearly all candidates, so the postings of frequent words are only
joined for what is left. With ``slop`` above 0, a term may stand up to that many words from its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, HEAVY_SHARE, join_by_skewed_key, lower_az, materialize, release_others, sized, text_or_empty, written

#: Fixed value: what stands between words, once A-Z are lowered.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Terms, from the rarest on, whose postings are joined one by one before the rest.
_EARLY = 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(text), _BETWEEN), "")


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words) and which item has which (wid, item). An item without words has none."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), words_of(text_or_empty(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (n - 1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("words")).distinct()
    numbered = materialize(cut.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("wid", F.monotonically_increasing_id()), "windows")
    return numbered.select("wid", "words"), numbered.select("wid", F.explode("items").alias("item"))


def _dealt(each: DataFrame, terms: DataFrame) -> DataFrame:
    """each (row, doc_id, pos, word) with the term of its word, words that are no term left out.

    Words with a large share of all places are few; their terms are broadcast, and they are gone before the rest shuffle by word.
    """
    counts = materialize(each.groupBy("word").agg(F.count(F.lit(1)).alias("uses")), "word-counts")
    total = counts.agg(F.sum("uses")).first()[0] or 0
    heavy = counts.filter(F.col("uses") > max(1.0, total * HEAVY_SHARE)).select("word")  # at most 1 / HEAVY_SHARE words
    common = each.join(F.broadcast(heavy.join(terms, "word")), "word")
    return common.unionByName(each.join(F.broadcast(heavy), "word", "left_anti").join(terms.hint("merge"), "word"))


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """Postings (row, doc_id, pos, term) of the given terms; each row also has a posting of term -1 at its word count."""
    row = F.monotonically_increasing_id() if row is None else row
    words = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("doc_id"), words_of(text_or_empty(text_col)).alias("words"))
    if n_terms > BROADCAST_ROWS:
        ends = words.select("row", "doc_id", F.size("words").alias("pos"), F.lit(-1).cast("long").alias("term"))
        return materialize(_dealt(words.select("row", "doc_id", F.posexplode("words").alias("pos", "word")), terms).select("row", "doc_id", "pos", "term").unionByName(ends), "postings")
    each = words.select("row", "doc_id", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    found = each.join(sized(terms, n_terms), "word", "left").filter(F.col("term").isNotNull() | F.col("word").isNull())
    return materialize(found.select("row", "doc_id", "pos", F.coalesce("term", F.lit(-1)).alias("term")), "postings")


def _by_term(postings: DataFrame, own: DataFrame, count: int, tf: DataFrame, total: int) -> DataFrame:
    """postings joined to window terms (own, ``count`` rows): by broadcast if these are few, else by term, where postings of a frequent term are dealt over several keys."""
    if count <= BROADCAST_ROWS:
        return postings.join(F.broadcast(own), "term")
    limit = max(10_000, int(total * HEAVY_SHARE))
    heavy = F.broadcast(tf.filter(F.col("tf") > limit).select("term", F.ceil(F.col("tf") / limit).cast("int").alias("deals")))  # at most 1 / HEAVY_SHARE terms
    dealt = postings.join(heavy, "term", "left").withColumn("deal", F.pmod(F.xxhash64("row", "pos"), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
    copies = own.join(heavy, "term", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    return dealt.join(copies, ["term", "deal"]).drop("deal")


def find_windows(index: DataFrame, windows: DataFrame, terms: DataFrame, n_terms: int, slop: int = 0) -> DataFrame:
    """Occurrences (row, start, wid, n) of windows; with slop, start is where the rarest term puts the window and exact says if all terms are in place."""
    postings = index.filter(F.col("term") >= 0).drop("doc_id")
    tf = materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    total = tf.agg(F.sum("tf")).first()[0] or 0
    spread = windows.select("wid", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
    counted = terms.join(sized(tf, n_terms), "term", "left")  # terms are distinct, so none of them is a hot key
    if n_terms <= BROADCAST_ROWS:
        places = spread.join(F.broadcast(counted), "word")
    else:
        uses = spread.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
        places = join_by_skewed_key(spread, materialize(counted.join(uses, "word"), "counted-terms"), ["word"], "uses", spread.count()).drop("uses")
    by_rarity = Window.partitionBy("wid").orderBy("tf", "offset")
    whole = Window.partitionBy("wid")
    places = places.withColumn("absent", F.count(F.when(F.col("tf").isNull(), 1)).over(whole)).filter("absent = 0")
    places = materialize(places.select("wid", "n", "offset", "term", F.row_number().over(by_rarity).alias("rank")), "window-terms")
    count = places.count()
    own = places.filter("rank = 1").select("wid", "n", "term", F.col("offset").alias("lead"))
    found = _by_term(postings, own, count, tf, total).select("row", (F.col("pos") - F.col("lead")).alias("start"), "wid", "n", F.lit(True).alias("exact")).filter("start >= 0")
    around = F.sequence(F.lit(-slop), F.lit(slop))
    for rank in range(2, _EARLY + 1):
        found = materialize(found, "candidates")
        own = places.filter(F.col("rank") == rank)
        asked = found.join(sized(own.drop("n", "rank"), count), "wid").select("*", F.explode(around).alias("off")).withColumn("pos", F.col("start") + F.col("offset") + F.col("off"))
        held = postings.join(sized(own.select("term").distinct(), count), "term", "left_semi")
        kept = asked.join(held, ["row", "pos", "term"], "left_semi").select("row", "start", "wid", "n", (F.col("exact") & (F.col("off") == 0)).alias("exact"))
        found = _merged(kept.unionByName(found.filter(F.col("n") < rank)), slop)
    found = materialize(found, "candidates")
    rest = places.filter(F.col("rank") > _EARLY)
    asked = found.join(sized(rest.drop("n", "rank"), count), "wid").select("*", F.explode(around).alias("off")).withColumn("pos", F.col("start") + F.col("offset") + F.col("off"))
    rows = materialize(found.select("row").distinct(), "candidate-rows")
    held = postings.join(sized(rows, rows.count()), "row", "left_semi")
    there = asked.join(held, ["row", "pos", "term"], "left_semi").groupBy("row", "start", "wid", "offset").agg(F.max(F.col("exact") & (F.col("off") == 0)).alias("exact"))
    counted = there.groupBy("row", "start", "wid").agg(F.count(F.lit(1)).alias("have"), F.min("exact").alias("exact"))
    all_there = found.drop("exact").join(counted, ["row", "start", "wid"]).filter(F.col("have") == F.col("n") - _EARLY).drop("have")
    return all_there.unionByName(found.filter(F.col("n") <= _EARLY))


def _merged(found: DataFrame, slop: int) -> DataFrame:
    return found if slop == 0 else found.groupBy("row", "start", "wid", "n").agg(F.max("exact").alias("exact"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", row: Column | None = None
) -> DataFrame:
    """One row per document: row, doc_id, n_words, n_hit, items array of strings, contaminated.

    Windows are ``n`` consecutive words of an item, or all words of a shorter one. A word is hit when it
    lies inside an occurrence. Null texts have no words; a null item id counts as an empty string; each
    row of a repeated id is a document of its own; without documents or windows nothing is hit. With
    slop above 0, proximity matches count too, and are judged from the word the rarest term points at.
    row may name a unique number of each row of docs; else one is made.
    """
    windows, owners = benchmark_windows(benchmark, n, item_col, item_text_col)
    terms = windows.select(F.explode("words").alias("word")).distinct()
    terms = materialize(terms.withColumn("term", F.monotonically_increasing_id()), "terms")
    n_terms = terms.count()
    index = build_index(docs, terms, n_terms, id_col, text_col, row)
    found = materialize(find_windows(index, windows, terms, n_terms, slop), "occurrences")
    hit = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    pairs = found.select("row", "wid").distinct().join(sized(owners, owners.count()), "wid").select("row", "item").distinct()
    items = pairs.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    every = index.filter("term = -1").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    joined = every.join(hit.join(items, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a hit, with all their columns."""
    before = written()
    packed = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "decontaminate-docs")
    texts = packed.select("row", F.col(f"doc.`{id_col}`").alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text"))
    found = decontaminate(texts, benchmark, n, id_col="doc_id", text_col="text", row=F.col("row"))
    gone = materialize(found.filter("contaminated").select("row"), "contaminated")
    release_others(docs.sparkSession, before, "decontaminate-docs", "contaminated")
    return packed.join(sized(gone, gone.count()), "row", "left_anti").select("doc.*")
