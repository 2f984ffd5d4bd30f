"""Hybrid retrieval.

`queries`: query_id, query_text, query_embedding and optional filter columns
program / faculty / document_type (NULL or '' = no restriction).
`chunks`: chunk_id, content, embedding plus, after `chunk_document_join`,
document_title, program, faculty, document_type.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atril import settings as S
from atril.functions import text as tx
from atril.operators import grid, scale
from atril.session import materialise_tidily as materialise

FILTERS = ["program", "faculty", "document_type"]


def chunk_document_join(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's descriptive columns (inner, on document_id).

    No hint: the planner broadcasts a small document table from its measured size,
    otherwise a sort-merge join whose skewed documents AQE splits.
    """
    described = documents.select(
        "document_id", F.col("title").alias("document_title"), *FILTERS
    )
    return chunks.join(described, "document_id")


def _with_filters(queries: DataFrame) -> DataFrame:
    present = set(queries.columns)
    return queries.withColumns({
        f: tx.truthy(F.col(f)) if f in present else F.lit(None).cast("string") for f in FILTERS
    })


def retrieval_filters(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, document_id) pairs admitted by the filters of a query.

    Only restricted queries produce pairs; an unrestricted query admits every
    document and is reported by `unrestricted_queries`.  The join is an equi-join on
    the query's most selective given field, the other fields are checked on top.
    """
    q = _with_filters(queries)
    parts = []
    for i, field in enumerate(FILTERS):
        mine = q.where(F.col(field).isNotNull())
        for earlier in FILTERS[:i]:
            mine = mine.where(F.col(earlier).isNull())
        mine = mine.select("query_id", *[F.col(f).alias(f"_q_{f}") for f in FILTERS])
        cond = F.col(f"_q_{field}") == F.col(field)
        for later in FILTERS[i + 1:]:
            cond &= F.col(f"_q_{later}").isNull() | (F.col(f"_q_{later}") == F.col(later))
        parts.append(documents.join(mine, cond).select("query_id", "document_id"))
    return scale.union_all(parts)


# ------------------------------------------------------------------ vector search


def _asked_fields(queries: DataFrame) -> list[str]:
    """Filters that a question of this table can set: a column that is absent needs no look at the chunks."""
    return [f for f in FILTERS if f in queries.columns]


def vector_topk(
    queries: DataFrame, chunks: DataFrame, k: int = S.TOP_K * S.CANDIDATE_MULTIPLIER, threshold: float = S.SCORE_THRESHOLD,
) -> DataFrame:
    """K1: the k nearest chunks of every query by exact cosine, those >= threshold.

    Each task multiplies packs of chunks with blocks of questions and keeps k rows per query, so nothing
    but k rows per query and task is shuffled.  Because the threshold is monotone in the score it is applied
    during the scan.  Ties go to the smaller chunk_id; the score is rounded to 4 digits after the comparison.
    """
    partial = grid.blocked_product(_with_filters(queries), chunks, _asked_fields(queries), k, threshold)
    ranked = scale.top_n(partial, ["query_id"], [F.desc("raw"), F.asc("chunk_id")], k, "rn")
    return ranked.select("query_id", "chunk_id", F.round("raw", 4).alias("score"), "rn")


def query_chunk_scan(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every query against every eligible chunk, reduced in place to the number
    of compared chunks and the best cosine; the pairs themselves are never rows."""
    partial = grid.blocked_product(_with_filters(queries), chunks, _asked_fields(queries), None)
    return partial.groupBy("query_id").agg(
        F.sum("n").alias("n_compared"), F.round(F.max("best"), 4).alias("best_score")
    )


# ------------------------------------------------------------------ keyword search

@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    from atril.functions.stemmer import stem

    return words.map(stem)


def words_of(text: Column) -> Column:
    """Lower-cased words in text order.  Cutting at what is between words takes half the time of extracting them."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}_]+"), "")


def spanish_stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("spanish"))


def stem_table(words: DataFrame, config: str) -> DataFrame:
    """(`word`, `lexeme`) of the distinct `word`s: 'simple' = the word itself; 'spanish' = its stem, without stop words."""
    words = words.select("word").distinct()
    if config == "simple":
        return words.select("word", F.col("word").alias("lexeme"))
    return words.where(~F.col("word").isin(spanish_stop_words())).select("word", _stem("word").alias("lexeme"))


def query_lexemes(queries: DataFrame, config: str) -> DataFrame:
    """Queries with `_ql`, their distinct lexemes; empty or absent without any.  No filter on `_ql` here: it would cut the texts a second time."""
    if config == "simple":
        return queries.withColumn("_ql", F.array_distinct(words_of(F.col("query_text"))))
    said = queries.select("query_id", F.explode_outer(words_of(F.col("query_text"))).alias("word")).distinct()
    lists = said.join(stem_table(said.select("word"), config), "word").groupBy("query_id").agg(F.collect_set("lexeme").alias("_ql"))
    return queries.join(lists, "query_id")


def cover_density(n: int, at: list[int], lexeme: list) -> float:
    """Clarke-Cormack-Tudhope cover density: 0.1 per cover, divided by 1 + noise words.

    `at`, `lexeme`: where the query's `n` lexemes stand, in text order.  A cover is a shortest stretch holding all
    of them; the last place of each lexeme gives its start.
    """
    last, total, before = {}, 0.0, -1
    for k, (i, t) in enumerate(zip(at, lexeme, strict=True)):
        last[t] = i
        if len(last) == n and (start := min(last.values())) > before:
            inside = k + 1 - bisect_left(at, start)
            total += 0.1 / (1 + max(i - start - (inside - 1), 0))
            before = start
    return total


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of rows (class, id, numbers, chunks) that come by class and id.

    A negative id is a piece of the class: `numbers` has the places and then the terms of some marks, and its first piece has
    the chunks.  Any other id is a question with its terms.  Only the marks of one class are held.
    """
    at, places, chunks = None, {}, None
    for batch in batches:
        asks, classes, density, members = [], [], [], []
        for cls, ask, numbers, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cls != at:
                at, places, chunks = cls, {}, None
            if ask < 0:
                half = len(numbers) // 2
                for place, term in zip(numbers[:half], numbers[half:], strict=True):
                    places.setdefault(term, []).append(place)
                chunks = chunks if own is None else own
            elif all(t in places for t in numbers):
                stand = sorted((p, t) for t in numbers for p in places[t])
                asks.append(ask)
                classes.append(cls)
                density.append(cover_density(len(numbers), *map(list, zip(*stand, strict=True))))
                members.append(chunks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(asks, pa.int64()), pa.array(classes, pa.int64()), pa.array(density, pa.float64()), pa.array(members, batch.schema.field("chunks").type)],
            ["ask", "class", "density", "chunks"])


def question_marks(terms: DataFrame, chunks: DataFrame, config: str) -> DataFrame:
    """Per chunk with a vector: its filter columns and `marks`, (place, term) of every word that stands for one of `terms`.

    The texts are cut into words once, whatever the number of queries.  A filter of bits leaves words out that no query asks
    for before anything is shuffled, and what is shuffled has the word's digest, however long the word is.
    """
    carried = [f for f in FILTERS if f in chunks.columns]
    # posexplode_outer: a plain explode makes the planner repeat the tokenizer in a scan filter.
    words = chunks.where(F.col("embedding").isNotNull()).select(
        "chunk_id", *carried, F.posexplode_outer(words_of(F.col("content"))).alias("place", "word"))
    if config == "simple":
        wanted = terms.select(F.col("lexeme").alias("word"), "term")
    else:
        wanted = materialise(stem_table(words, config).join(terms, "lexeme").select("word", "term"), "wanted")
    key = F.unhex(F.md5("word")).alias("key")
    # Stored, so that the joins behind `chunks` are over, and their files gone, before the words are shuffled.
    met = materialise(scale.maybe_in(words, "word", wanted).select("chunk_id", *carried, "place", key), "words")
    marked = met.join(wanted.select(key, "term"), "key").groupBy("chunk_id", *carried)
    return marked.agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("marks"))


def _digest(*parts: str) -> Column:
    return F.md5(F.to_json(F.struct(*parts)))


def anchored(askers: DataFrame, terms: DataFrame, postings: DataFrame, span: int = S.ANCHOR_ROWS) -> DataFrame:
    """Per question of which some lexeme occurs: its occurring `terms`, whether all do (`whole`), its rarest term as `anchor` and
    the number of `salts` its postings are cut into, so that a cut holds about `span` classes."""
    frequency = terms.join(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    rarest = askers.select("ask", F.explode("_ql").alias("lexeme")).join(frequency, "lexeme").groupBy("ask").agg(
        F.min(F.struct("df", "term")).alias("rarest"), F.sort_array(F.collect_list("term")).alias("terms"))
    return askers.join(rarest, "ask").select(
        "ask", "terms", *FILTERS, (F.size("terms") == F.size("_ql")).alias("whole"), F.col("rarest.term").alias("anchor"),
        F.ceil(F.col("rarest.df") / span).cast("int").alias("salts"))


def text_classes(marks: DataFrame, fields: list[str], most: int | None, room: int = S.CLASS_ROWS) -> DataFrame:
    """Texts with equal marks and filter values: `class`, fields, `marks`, a sketch of their terms and the `chunks` that have them.

    With `most`, the first `most` chunks; else all of them, where a text of more than `room` chunks is several classes of about
    `room`, so that no list grows with the copies.
    """
    marks = marks.withColumn("_t", _digest("marks", *fields))
    if most is None:
        marks = materialise(marks.select("chunk_id", *fields, "marks", "_t"), "marks")
        many = marks.groupBy("_t").agg(F.ceil(F.count(F.lit(1)) / room).alias("parts")).where(F.col("parts") > 1)
        part = F.pmod(F.xxhash64("chunk_id"), F.coalesce("parts", F.lit(1)))
        # At most one row in `room` rows.
        kept = marks.join(F.broadcast(many), "_t", "left").withColumn("part", part)
    else:
        kept = scale.top_n(marks, ["_t"], [F.asc_nulls_last("chunk_id")], most, "_m").withColumn("part", F.lit(0))
    same = kept.groupBy("_t", "part").agg(*(F.first(c).alias(c) for c in ("marks", *fields)), F.collect_list("chunk_id").alias("chunks"))
    return same.select(F.monotonically_increasing_id().alias("class"), *fields, "marks", "chunks", *scale.sketch(F.array_distinct("marks.term")))


def distinct_matches(
    queries: DataFrame, chunks: DataFrame, config: str, span: int, most: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches between different questions and different texts, however often either occurs.

    Returns `hits` (ask, class, rank_score, chunks), `named` (query_id, ask) and `classes`.  Queries with the same
    lexemes and filters are one `ask`; chunks with the same marks and filter values are one `class` (`text_classes`).  A question
    meets the classes that hold its rarest lexeme; postings of a frequent anchor are cut into salted parts and its questions
    sent to each.  Met pairs that a sketch of the class's terms can rule out go no further; the others are dealt out
    once, as a few numbers each, and read behind the marks of their class.  No posting list is paired with another, no text
    is shuffled, and any number of queries takes the same jobs.
    """
    lists = query_lexemes(_with_filters(queries), config).select("query_id", F.array_sort("_ql").alias("_ql"), *FILTERS)
    asked = materialise(lists, "asked").where((F.size("_ql") > 0) & F.col("query_id").isNotNull()).withColumn("_q", _digest("_ql", *FILTERS))
    askers = materialise(asked.groupBy("_q").agg(*(F.first(c).alias(c) for c in ("_ql", *FILTERS))).withColumn(
        "ask", F.monotonically_increasing_id()), "askers")
    # Terms are numbered in the order of their lexemes, which decides where two stand at one place.
    terms = materialise(askers.select(F.explode("_ql").alias("lexeme")).distinct().orderBy("lexeme").withColumn(
        "term", F.monotonically_increasing_id()), "terms")

    fields = [f for f in _asked_fields(queries) if f in chunks.columns]
    classes = materialise(text_classes(question_marks(terms, chunks, config), fields, most), "classes")
    held = classes.withColumn("terms", F.array_distinct("marks.term"))
    sketched = [c for c in classes.columns if c.startswith("sketch")]
    postings = classes.select("class", *fields, *sketched, F.explode(F.array_distinct("marks.term")).alias("term"))

    # Queries that share an id are one question here: it has matches only if the lexemes of a single one of them occur.
    asks = materialise(anchored(askers, terms, postings, span).select("*", *scale.sketch(F.col("terms"), "_q_sketch")), "asks")
    own = asked.select("query_id", "_q").join(askers.select("_q", "ask"), "_q").join(asks.select("ask", "whole"), "ask")
    named = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("ask").alias("ask"), F.bool_and("whole").alias("whole"))
    named = named.where((F.col("n") == 1) & F.col("whole")).select("query_id", "ask")

    asks = asks.where("whole")
    # A cut anchor has more than `span` postings, so these rows are few.
    cuts = F.broadcast(asks.where(F.col("salts") > 1).select(F.col("anchor").alias("term"), "salts").distinct())
    salt = F.pmod(F.xxhash64("class"), F.coalesce("salts", F.lit(1))).cast("int")
    held = scale.maybe_in(postings, "term", asks.select(F.col("anchor").alias("term"))).join(cuts, "term", "left")
    held = held.withColumn("salt", salt).drop("salts").withColumnRenamed("term", "anchor")
    salted = asks.select("ask", "terms", "anchor", *(F.col(f).alias(f"_q_{f}") for f in fields), *(c for c in asks.columns if c.startswith("_q_sketch")),
                         F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = held.join(salted, ["anchor", "salt"]).where(scale.may_hold("sketch", "_q_sketch"))
    for f in fields:
        met = met.where(F.col(f"_q_{f}").isNull() | (F.col(f"_q_{f}") == F.col(f)))

    kind = dict(classes.dtypes)["chunks"]
    pairs = met.select("class", F.col("ask").alias("id"), F.col("terms").alias("numbers"), F.lit(None).cast(kind).alias("chunks"))
    step = S.MARK_ROWS
    pieces = classes.select("class", "chunks", "marks", F.explode(F.sequence(F.lit(0), F.floor((F.size("marks") - 1) / step).cast("int"))).alias("i"))
    marks = F.slice("marks", F.col("i") * step + 1, step)
    pieces = pieces.select("class", "chunks", "i", marks.alias("m")).select(
        "class", (F.col("i") - F.lit(2**31)).alias("id"), F.concat(F.col("m.place").cast("array<bigint>"), F.col("m.term")).alias("numbers"),
        F.when(F.col("i") == 0, F.col("chunks")).alias("chunks"))
    stream = pieces.unionByName(pairs).repartition("class").sortWithinPartitions("class", "id")
    found = stream.mapInArrow(_matched, f"ask bigint, class bigint, density double, chunks {kind}")
    hits = found.select("ask", "class", F.round("density", 8).alias("rank_score"), "chunks")
    return hits, named, classes


def text_match(queries: DataFrame, chunks: DataFrame, config: str = S.TEXT_CONFIG, span: int = S.ANCHOR_ROWS) -> DataFrame:
    """(query_id, chunk_id, rank_score) where the chunk holds ALL query lexemes; different questions and texts are matched once."""
    hits, named, _ = distinct_matches(queries, chunks, config, span)
    met = hits.select("ask", F.explode("chunks").alias("chunk_id"), "rank_score")
    return met.join(named, "ask").select("query_id", "chunk_id", "rank_score")


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int = S.TOP_K, config: str = S.TEXT_CONFIG, span: int = S.ANCHOR_ROWS) -> DataFrame:
    """K2: best k full-text matches per query by cover density, ties by chunk_id.

    Ranked per different question; of chunks with the same marks only the k first can be among its k best."""
    hits, named, _ = distinct_matches(queries, chunks, config, span, k)
    met = hits.select("ask", F.explode("chunks").alias("chunk_id"), "rank_score")
    best = scale.top_n(met, ["ask"], [F.desc("rank_score"), F.asc("chunk_id")], k, "rn")
    return best.join(named, "ask").select("query_id", "chunk_id", "rank_score", "rn")


# ------------------------------------------------------------------ fusion and post-processing


def exclude_seen(keyword_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """Keyword hits (already cut to their limit) not found by the vector search."""
    return keyword_hits.join(vector_hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def hybrid_union(vector_hits: DataFrame, keyword_hits: DataFrame, baseline: float = S.SCORE_THRESHOLD) -> DataFrame:
    """Vector hits first, then unseen keyword hits at the constant baseline score."""
    fresh = exclude_seen(keyword_hits, vector_hits)
    return vector_hits.select(
        "query_id", "chunk_id", "score", F.lit("vector").alias("origin"), F.col("rn").cast("long").alias("ord")
    ).unionByName(fresh.select(
        "query_id", "chunk_id", F.lit(baseline).alias("score"), F.lit("keyword").alias("origin"),
        (F.col("rn") + F.lit(1_000_000)).cast("long").alias("ord"),
    ))


def rerank(candidates: DataFrame, w_sem: float = S.WEIGHT_SEMANTIC, w_kw: float = S.WEIGHT_KEYWORD) -> DataFrame:
    """K5: order by 0.8*score + 0.2*keyword overlap, rounded to 8 digits so that the order of a sum never decides
    a tie; the item keeps its own score."""
    scored = candidates.withColumn(
        "hybrid", F.round(w_sem * F.col("score") + w_kw * tx.keyword_score(F.col("query_text"), F.col("content")), 8)
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid"), F.asc("ord"))
    return scored.withColumn("rank", F.row_number().over(w))


def near_dup_filter(ranked: DataFrame, group: str = "query_id", limit: float = S.NEAR_DUP_JACCARD) -> DataFrame:
    """In rank order, drop rows whose head words overlap a kept row by > limit.

    The candidate list of a query is bounded by the two search limits, so it folds
    inside one row.
    """
    carried = [c for c in ranked.columns if c not in (group, "rank")]
    item = F.struct("rank", tx.head_words(F.col("content")).alias("words"), F.struct(*carried).alias("row"))
    lists = ranked.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def step(kept, x):
        clash = F.exists(kept, lambda k: tx.jaccard(k["words"], x["words"]) > limit)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    return lists.select(group, F.explode(
        F.aggregate("items", F.slice("items", 1, 0), step)).alias("i")
    ).select(group, "i.rank", "i.row.*")


def diversity_cap(ranked: DataFrame, max_per_title: int = S.MAX_CHUNKS_PER_TITLE, top_k: int = S.TOP_K) -> DataFrame:
    """At most `max_per_title` rows of one title, then the first top_k."""
    title = F.coalesce("document_title", F.lit(""))
    per_title = Window.partitionBy("query_id", title).orderBy("rank")
    kept = ranked.withColumn("_t", F.row_number().over(per_title)).where(F.col("_t") <= max_per_title).drop("_t")
    final = Window.partitionBy("query_id").orderBy("rank")
    return (
        kept.withColumn("_k", F.row_number().over(final)).where(F.col("_k") <= top_k)
        .drop("rank").withColumnRenamed("_k", "rank")
    )


def plain_cut(ranked: DataFrame, top_k: int = S.TOP_K) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank")
    return (
        ranked.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_k)
        .drop("rank").withColumnRenamed("_k", "rank")
    )


def retrieval_quality(results: DataFrame, queries: DataFrame, threshold: float = S.SCORE_THRESHOLD) -> DataFrame:
    """None / weak / good per query from the score of its first row."""
    top = results.groupBy("query_id").agg(
        F.min_by("score", "rank").alias("top_score"), F.count(F.lit(1)).alias("n_results")
    )
    label = (
        F.when(F.col("n_results").isNull(), "none")
        .when(F.col("top_score") < threshold, "weak").otherwise("good")
    )
    return queries.select("query_id").join(top, "query_id", "left").select(
        "query_id", label.alias("quality"), "top_score", F.coalesce("n_results", F.lit(0)).alias("n_results")
    )


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, k: int = S.TOP_K, threshold: float = S.SCORE_THRESHOLD,
    diversity: bool = True, keyword: bool = True, config: str = S.TEXT_CONFIG, baseline: float = S.SCORE_THRESHOLD,
) -> DataFrame:
    """Vector + keyword candidates, rerank, near-duplicate removal, title cap, top k.

    `chunks` carries the document columns (J1).  Candidates (at most 3k + k narrow rows per query) are
    written to the shared folder first; only their texts are joined with documents and shuffled.
    """
    body = chunks.select("chunk_id", "content", "document_title", "program", "faculty")
    vec = vector_topk(queries, chunks, k * S.CANDIDATE_MULTIPLIER, threshold)
    if keyword:
        vec = materialise(vec, "vector-hits")
        cand = hybrid_union(vec, keyword_topk(queries, chunks, k, config), baseline)
    else:
        cand = vec.select("query_id", "chunk_id", "score", F.lit("vector").alias("origin"),
                          F.col("rn").cast("long").alias("ord"))
    cand = materialise(cand, "candidates")
    # The semi-join reaches the scan of the chunks, below the join with their documents.
    picked = body.join(cand.select("chunk_id").distinct(), "chunk_id", "left_semi")
    met = picked.join(cand, "chunk_id").join(queries.select("query_id", "query_text"), "query_id")
    ranked = near_dup_filter(rerank(met))
    final = diversity_cap(ranked, S.MAX_CHUNKS_PER_TITLE, k) if diversity else plain_cut(ranked, k)
    return final.select(
        "query_id", "rank", "chunk_id", "score", "hybrid", "origin",
        "document_title", "program", "faculty", "content")


def retrieval_log(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One log row per query, with an empty list for queries without results."""
    entry = F.struct("rank", "chunk_id", "score", F.col("document_title").alias("title"))
    lists = results.groupBy("query_id").agg(
        F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.struct(e["chunk_id"].alias("chunk_id"), e["score"].alias("score"), e["title"].alias("title")),
        ).alias("chunks_retrieved")
    )
    joined = queries.select("query_id", "query_text").join(lists, "query_id", "left")
    empty = F.from_json(F.lit("[]"), lists.schema["chunks_retrieved"].dataType.json())
    return joined.select(
        "query_id",
        tx.excerpt(F.col("query_text"), 2000).alias("query_text"),
        F.coalesce("chunks_retrieved", empty).alias("chunks_retrieved"),
        F.try_element_at("chunks_retrieved", F.lit(1))["score"].alias("top_score"),
    )


def halving(fn, batch: list) -> list:
    """Results of a batch function; a failing batch is halved until the failing items stand alone, as None."""
    try:
        made = list(fn(batch))
        if len(made) != len(batch):
            raise ValueError("one result per item is needed")
        return made
    except Exception:
        if len(batch) == 1:
            return [None]
    middle = len(batch) // 2
    return halving(fn, batch[:middle]) + halving(fn, batch[middle:])


def expand_queries(queries: DataFrame, expand_fn, column: str = "embed_text", batch: int = S.EMBED_BATCH) -> DataFrame:
    """Text to embed per query from a pluggable batch function; where that fails for a query, or its answer is empty, the
    query itself.  One failing query costs the others of its batch nothing but a few more calls."""

    @F.pandas_udf(T.StringType())
    def expanded(texts: pd.Series) -> pd.Series:
        asked, out = texts.tolist(), []
        for start in range(0, len(asked), batch):
            part = asked[start : start + batch]
            out += [(made or "").strip() or text for made, text in zip(halving(expand_fn, part), part, strict=True)]
        return pd.Series(out, dtype=object)

    return queries.withColumn(column, expanded("query_text"))


def embed_queries(queries: DataFrame, expand_fn, embed_fn, column: str = "query_embedding") -> DataFrame:
    """Question vectors as the search uses them: the expanded text is embedded, the question itself is kept for keywords."""
    from atril.operators.ingest import embed_texts

    return embed_texts(expand_queries(queries, expand_fn), "embed_text", embed_fn, out=column)
