"""Whole searches over tables of queries: candidates of vectors and terms, fused, ranked, without repeats."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.operators import retrieve as R


def historical_search(
    queries: DataFrame, chunks: DataFrame, postings: DataFrame, k: int, banks: tuple[str, ...] = (), products: tuple[str, ...] = (), has_facts: bool | None = None, least: float = 0.0, since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """(query_id, chunk_id, doc_id, rrf, place): the k best documents among old versions, each by its best chunk.

    Queries have query_id, vector and terms; chunks chunk_id, doc_id, vector, bank, product, day, confidence, searchable, quality_status
    and has_facts. The filters hold before anything is ranked: only searchable, accepted versions are candidates, so a
    version left out takes no rank from another. Each side gives 12 k candidates, 60 at least and 600 at most, and counts
    alike. Null confidence is 0; a null day is outside of any bounds.
    """
    keep = F.coalesce(F.col("searchable"), F.lit(False)) & (F.col("quality_status") == "accepted") & (F.coalesce("confidence", F.lit(0.0)) >= least)
    for column, names in (("bank", banks), ("product", products)):
        keep = keep & F.col(column).isin(*names) if names else keep
    keep = keep if has_facts is None else keep & (F.col("has_facts") == F.lit(has_facts))
    keep = keep if since is None else keep & (F.col("day") >= since)
    keep = keep if until is None else keep & (F.col("day") <= until)
    eligible, n = chunks.filter(keep), min(max(12 * k, 60), 600)
    dense = R.cosine_topk(queries.select("query_id", "vector"), eligible.select("chunk_id", "vector"), n)
    lexical = R.lexical_topk(queries.select("query_id", "terms"), postings, n, chunks=eligible)
    hits = R.rrf_fuse(dense, lexical, 1.0, 1.0).drop("place").join(eligible.select("chunk_id", "doc_id"), "chunk_id")
    return R.best_chunk_per_document(hits, k).select("query_id", "chunk_id", "doc_id", "rrf", "place")


def unified_search(routes: DataFrame, chunks: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """The candidates of each route that are left when repeats are gone, with their place; `final` is 1 to k for those returned, else null.

    Routes have query_id, vector, terms, intent, banks, products, fields (arrays); chunks chunk_id, doc_id, offer_id, bank, product, fields, vector,
    verified and primary (may stand as evidence by its classification). Each side gives 8 k candidates, 40 at least and 500 at most.
    Products and fields don't filter, they rank; named banks filter before anything is ranked. Comparisons, and lookups and lists of
    products or fields without a named bank, take banks in turn. Chunks that may not stand as evidence only fill up.
    """
    n = min(max(8 * k, 40), 500)
    asked = routes.select("query_id", "intent", *(F.coalesce(c, F.array().cast("array<string>")).alias(f"asked_{c}") for c in ("banks", "products", "fields")))
    meta = chunks.drop("vector")
    dense = R.cosine_topk(routes.filter(~_named()).select("query_id", "vector"), chunks.select("chunk_id", "vector"), n).unionByName(_dense_of_banks(routes.filter(_named()), chunks, n))
    # a term of a route that names banks is one term for each of them, so only chunks of these banks have it
    every = F.transform("terms", lambda t: F.concat(F.lit("|"), t))
    each = F.flatten(F.transform(F.array_distinct("banks"), lambda b: F.transform("terms", lambda t: F.concat(b, F.lit("|"), t))))
    terms = routes.select("query_id", F.when(_named(), each).otherwise(every).alias("terms"))
    raw = routes.select(F.explode("terms").alias("term")).distinct()
    few = postings.join(F.broadcast(raw) if raw.limit(R.TERMS + 1).count() <= R.TERMS else raw, "term", "left_semi")  # only postings of asked terms meet the chunks
    stamped = few.join(chunks.select("chunk_id", "bank"), "chunk_id").withColumn("term", F.explode(F.array(F.concat(F.lit("|"), F.col("term")), F.concat("bank", F.lit("|"), F.col("term"))))).filter("term is not null")
    lexical = R.lexical_topk(terms, stamped.drop("bank"), n)
    fused = R.rrf_fuse(dense, lexical).drop("place")
    rows = fused.join(meta, "chunk_id").join(asked, "query_id")
    coverage = F.size(F.array_intersect(F.coalesce("fields", F.array().cast("array<string>")), F.col("asked_fields")))
    rows = rows.withColumn("product_match", F.coalesce(F.array_contains("asked_products", F.col("product")), F.lit(False))).withColumn("coverage", coverage).withColumn("field_match", coverage > 0)
    rows = rows.withColumn("fused_candidates", F.count("*").over(Window.partitionBy("query_id")))
    left = R.dedup_hits(R.relevance_rank(rows))
    spread = (F.col("intent") == "compare") | ((F.size("asked_banks") == 0) & F.col("intent").isin("lookup", "list") & ((F.size("asked_products") > 0) | (F.size("asked_fields") > 0)))
    own = Window.partitionBy("query_id", "primary", "tier", "bank")
    turns = left.withColumn("spread", F.coalesce(spread, F.lit(False))).withColumn("turn", F.row_number().over(own.orderBy("place"))).withColumn("first", F.min("place").over(own))
    order = [F.desc("primary"), *(F.when(F.col("spread"), F.col(c)) for c in ("tier", "turn", "first")), F.col("place")]
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return turns.withColumn("final", final).select("query_id", "chunk_id", "doc_id", "offer_id", "bank", "rrf", "tier", "place", "primary", "product_match", "field_match", "spread", "fused_candidates", F.when(F.col("final") <= k, F.col("final")).alias("final"))


def _named() -> Column:
    return F.coalesce(F.size("banks") > 0, F.lit(False))


def _dense_of_banks(routes: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """The n nearest chunks of each route among those of its banks; the engine keeps n rows a query and task before the shuffle."""
    asked = routes.select("query_id", R.unit(F.col("vector")).alias("asked"), F.explode(F.array_distinct("banks")).alias("bank"))
    asked = F.broadcast(asked) if asked.limit(R.TERMS // 10 + 1).count() <= R.TERMS // 10 else asked
    pairs = chunks.select("chunk_id", "bank", R.unit(F.col("vector")).alias("own")).join(asked, "bank").filter("own is not null and asked is not null")
    dot = F.aggregate(F.zip_with("asked", "own", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda x, y: x + y)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return pairs.select("query_id", "chunk_id", F.round(dot, 6).alias("score")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def search_diagnostics(routes: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each route: candidates before and after repeats went, matches among them, what is returned, and the issue no_matching_evidence where nothing is."""
    returned = F.col("final").isNotNull()
    counts = candidates.groupBy("query_id").agg(
        F.max("fused_candidates").alias("fused"), F.count("*").alias("deduplicated"), F.count_if("primary").alias("primary"), F.count_if("product_match").alias("product_matches"), F.count_if("field_match").alias("field_matches"),
        F.count_if(returned).alias("returned"), F.count_if(returned & F.col("product_match")).alias("returned_product_matches"), F.count_if(returned & F.col("field_match")).alias("returned_field_matches"), F.bool_or("spread").alias("banks_in_turn"),
    )
    numbers = [c for c in counts.columns if c not in ("query_id", "banks_in_turn")]
    rows = routes.select("query_id").join(counts, "query_id", "left").na.fill(0, numbers)
    return rows.withColumn("issue", F.when(F.col("returned") == 0, "no_matching_evidence"))
