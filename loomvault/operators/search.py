"""Filters, ranking and hybrid search over sections."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from .query import SearchQuery, parse

# Constants of the ranking formulas and the default number of results.
K1, B = 1.2, 0.75
RRF_K = 60.0
LIMIT = 20

#: (candidates, the query's text) to section_path and score.
Scorer = Callable[[DataFrame, str], DataFrame]


def has_tag(tags: Column, name: str) -> Column:
    """The tag itself or one below it."""
    return F.exists(tags, lambda t: (t == name) | t.startswith(name + "/"))


def tag_range(tagged: DataFrame, name: str) -> DataFrame:
    """The postings (operators.index.tagged) of a tag and all below it: one range of keys, which a scan sorted by key can skip to."""
    low = name.replace("/", "\x01") + "\x01"
    return tagged.filter((F.col("key") >= low) & (F.col("key") < low[:-1] + "\x02"))


def tag_sections(tagged: DataFrame, tags: Sequence[str]) -> DataFrame:
    """section_path of the sections with any of the tags or one below it, from the postings of tags."""
    ranges = [tag_range(tagged, t).select("section_path") for t in tags]
    out = ranges[0]
    for r in ranges[1:]:
        out = out.union(r)
    return out.distinct()


def candidates(sections: DataFrame, tags: list[str] = (), folders: list[str] = (), exclude: list[str] = (), recursive: bool = True) -> DataFrame:
    """Sections with any of the tags, in any of the folders, and with none of the excluded tags."""
    out = sections
    if tags:
        out = out.filter(_any([has_tag(F.col("tags"), t) for t in tags]))
    if folders:
        test = paths.is_under_folder if recursive else paths.is_in_folder
        out = out.filter(_any([test(F.col("note_path"), f) for f in folders]))
    if exclude:
        out = out.filter(~F.arrays_overlap("tags", F.array(*map(F.lit, exclude))))
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _tf(term: str) -> Column:
    return F.size(F.filter("tokens", lambda t: t == term))


def corpus_stats(sections: DataFrame, terms: list[str] = ()) -> DataFrame:
    """One row: number of sections, their total length, and for each term the number of sections that hold it."""
    held = [F.coalesce(F.sum(F.array_contains("tokens", t).cast("long")), F.lit(0)).alias(f"df_{i}") for i, t in enumerate(terms)]
    return sections.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_len"), *held)


def bm25(found: DataFrame, corpus: DataFrame, query: str, threshold: float = 0.0) -> DataFrame:
    """found with a score above the threshold. Statistics are those of the whole corpus, whatever has been filtered.

    Terms are looked up in each section's own tokens: a scan without a shuffle. A term that the query repeats counts as often.
    """
    terms = Counter(text.naive_tokens_of(query))
    if not terms:
        return found.withColumn("score", F.lit(0.0)).filter("false")
    names = list(terms)
    row = corpus_stats(corpus.select("tokens", "token_count"), names).first()  # one row
    n, mean = row["n"], (row["total_len"] / row["n"] if row["n"] else 0.0)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("token_count") / F.lit(float(mean) or 1.0))
    score = F.lit(0.0)
    for i, (t, times) in enumerate(terms.items()):
        df = row[f"df_{i}"]
        tf = _tf(t).cast("double")
        score = score + F.lit(float(times)) * F.log(F.lit((n - df + 0.5) / (df + 0.5) + 1.0)) * tf * F.lit(K1 + 1) / (tf + norm)
    hit = F.arrays_overlap("tokens", F.array(*map(F.lit, names)))
    return found.filter(hit).withColumn("score", score).filter(F.col("score") > threshold)


def bm25_postings(postings: DataFrame, corpus: DataFrame, query: str) -> DataFrame:
    """section_path and score from a stored index (see operators.index): only the query's terms are read."""
    terms = Counter(text.naive_tokens_of(query))
    spark = postings.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t, n) for t, n in terms.items()] or [("", 0)], "term string, times int"))
    hit = postings.filter(F.col("term").isin(*terms)).join(wanted, "term")
    per_term = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has terms
    row = corpus.first()
    n, mean = row["n"], (row["total_len"] / row["n"] if row["n"] else 1.0)
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(float(mean)))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return hit.join(F.broadcast(per_term), "term").groupBy("section_path").agg(F.sum(part).alias("score"))


def tag_jaccard(found: DataFrame, query: str, n: int = text.NGRAM, threshold: float = 0.0) -> DataFrame:
    """found with the Jaccard similarity of the query's n-grams and those of the tags; sections without tags have none."""
    grams = sorted(set(text.ngrams_of(query, n)))
    stored = n == text.NGRAM and "tag_grams" in found.columns
    have = F.col("tag_grams") if stored else F.array_distinct(text.ngrams(F.array_join("tags", " "), n))
    score = lambda h: F.get(F.transform(F.array(F.size(F.array_intersect(h, F.array(*map(F.lit, grams))))), lambda both: both / (F.size(h) + len(grams) - both)), F.lit(0))
    once = F.get(F.transform(F.array(have), score), F.lit(0))  # each of the two sizes is computed once
    return found.filter(F.size("tags") > 0).withColumn("score", once).filter(F.col("score") > threshold)


def tag_postings(grams: DataFrame, query: str) -> DataFrame:
    """section_path and the score of `tag_jaccard` from stored inverted lists (see operators.index): only the query's n-grams are read.

    A section's size and the number of shared n-grams are all that the similarity needs; sections that share none are not met.
    """
    wanted = sorted(set(text.ngrams_of(query)))
    both = grams.filter(F.col("gram").isin(*wanted)).groupBy("section_path", "n_grams").agg(F.count(F.lit(1)).alias("both"))
    return both.select("section_path", (F.col("both") / (F.col("n_grams") + len(wanted) - F.col("both"))).alias("score"))


def _better(score: Column, key: Column, than_score: Column, than_key: Column) -> Column:
    return (score > than_score) | ((score == than_score) & (key < than_key))


def rrf(lists: list[DataFrame], key: str = "section_path", k: float = RRF_K, limit: int = LIMIT) -> list[tuple[str, float]]:
    """The `limit` best (key, fused score) of ranked lists (key, score), where rank r gives 1/(k + r).

    The best `limit` have 1/(k + limit) each, so one of their ranks is within m * (k + limit) - k of m lists. Only those
    candidates, a number that limit bounds, come to the driver; their deeper ranks are counted by one aggregation over each list
    into the gaps between candidates, so no list is sorted or gathered as a whole.
    """
    depth = int(len(lists) * (k + limit) - k) + 1
    lists = [x.select(F.col(key).alias("key"), "score") for x in lists]
    tops = [x.orderBy(F.desc("score"), "key").limit(depth).collect() for x in lists]
    wanted = sorted({r["key"] for top in tops for r in top})
    fused: dict[str, float] = {}
    for x, top in zip(lists, tops, strict=True):
        if len(top) < depth:  # the whole list
            own = top
        else:
            own = sorted(x.filter(F.col("key").isin(*wanted)).collect(), key=lambda r: (-r["score"], r["key"]))
        if len(top) < depth or len(own) <= len(top):
            ranks = {r["key"]: i + 1 for i, r in enumerate(own)}
        else:
            marks = F.array(*[F.struct(F.lit(r["score"]).alias("s"), F.lit(r["key"]).alias("p")) for r in own])
            gap = F.size(F.filter(marks, lambda m: _better(m["s"], m["p"], F.col("score"), F.col("key"))))
            sizes = {r["gap"]: r["n"] for r in x.groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("n")).collect()}
            ranks, before = {}, 0
            for i, r in enumerate(own):
                before += sizes.get(i, 0)  # the candidate is the last of its gap
                ranks[r["key"]] = before
        for p, r in ranks.items():
            fused[p] = fused.get(p, 0.0) + 1.0 / (k + r)
    return sorted(fused.items(), key=lambda x: (-x[1], x[0]))[:limit]


def within_budget(hits: DataFrame, tokens: int | None) -> DataFrame:
    """The longest prefix by rank whose tokens fit. hits: as few as a search's limit."""
    if tokens is None:
        return hits
    total = F.sum("token_count").over(Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("_total", total).filter(F.col("_total") <= tokens).drop("_total")


def hits(sections: DataFrame, query: str | SearchQuery, limit: int = LIMIT, token_limit: int | None = None, threshold: float = 0.0, postings: DataFrame | None = None, corpus: DataFrame | None = None, grams: DataFrame | None = None, scorers: Sequence[Scorer] | None = None) -> DataFrame:
    """Ranked sections: filters, both rankings, fusion and limit, then the token budget, then the threshold.

    postings, corpus and grams: those of a stored index, of which only the query's terms and n-grams are read; without them sections are scanned.
    scorers: rankings to fuse in place of words and tags.
    """
    q = parse(query) if isinstance(query, str) else query
    spark = sections.sparkSession
    found = candidates(sections, q.tags, q.folders)
    if q.empty:
        return found.withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0)).filter("false")
    if not q.text.strip():
        first = found.orderBy("section_path").limit(limit)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("section_path"))).withColumn("score", F.lit(1.0))
        return within_budget(ranked, token_limit)
    if scorers is not None:
        lists = [s(found, q.text) for s in scorers]
    elif postings is None:
        lists = [bm25(found, sections, q.text), tag_jaccard(found, q.text)]
    else:
        words = bm25_postings(postings, corpus, q.text)
        tagged = tag_jaccard(found, q.text) if grams is None else tag_postings(grams, q.text)
        if q.tags or q.folders:
            words, tagged = (x.join(found.select("section_path"), "section_path", "left_semi") for x in (words, tagged))
        lists = [words, tagged]
    best = rrf(lists, limit=limit)
    ranks = spark.createDataFrame([(p, s, i + 1) for i, (p, s) in enumerate(best)], "section_path string, score double, rank int")
    notes = {p.partition("#")[0] for p, _ in best}  # a filter that reaches the scan of sections sorted by note
    ranked = found.filter(F.col("note_path").isin(*notes)).join(F.broadcast(ranks), "section_path").orderBy("rank").limit(limit)
    return within_budget(ranked, token_limit).filter(F.col("score") >= threshold)


def by_note(ranked: DataFrame) -> DataFrame:
    """Hits grouped by note: sections by rank, tags, links, tokens and the best score; notes with the best score come first."""
    section = F.struct("rank", "section_path", "heading_path", "tags", "token_count", "score", "links")
    return (
        ranked.groupBy("note_path")
        .agg(
            F.array_sort(F.collect_list(section)).alias("sections"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
            F.sum("token_count").alias("token_count"), F.max("score").alias("max_score"),
        )
        .withColumn("links", F.flatten("sections.links"))
        .orderBy(F.desc("max_score"), "note_path")
    )


def search(sections: DataFrame, query: str, limit: int = LIMIT, token_limit: int | None = None, threshold: float = 0.0, postings: DataFrame | None = None, corpus: DataFrame | None = None, grams: DataFrame | None = None) -> DataFrame:
    """Notes with their hits. Without text in the query, scores are null."""
    q = parse(query)
    ranked = hits(sections, q, limit, token_limit, threshold, postings, corpus, grams)
    if not q.text.strip():
        ranked = ranked.withColumn("score", F.lit(None).cast("double"))
    return by_note(ranked)
