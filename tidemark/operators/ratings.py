"""From stored calls to ratings: deduplication, JSON extraction, replicate statistics, quotes, weights.

A rating is a number or a numeric string in the JSON object of a response, prose and fences around it
ignored, clipped to the scale; anything else is missing (null, never NaN). Null keys are dropped; of a
key stored twice the earliest row stands, ties by response. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut_lineage

STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}


def call_store(calls: DataFrame) -> DataFrame:
    """One row a key."""
    order = F.struct("created_utc", F.coalesce("response", F.lit("")))
    return calls.filter("key is not null").groupBy("key").agg(F.min_by(F.struct(*[c for c in calls.columns if c != "key"]), order).alias("r")).select("key", "r.*")


def call_key(parts: dict[str, Column]) -> Column:
    """sha256 of the canonical JSON of the key fields, by name, nulls kept."""
    fields = [c.alias(k) for k, c in sorted(parts.items())]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def json_object(response: Column) -> Column:
    return F.regexp_extract(response, r"(?s)\{.*\}", 0)


def number(text: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """a clipped number, or null."""
    x = text.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratings(store: DataFrame) -> DataFrame:
    """Long ratings: key, account_hash, task, trait, replicate, rated, rating."""
    values = F.from_json(json_object(F.col("response")), "map<string,string>", STRICT)
    rows = store.select("key", "account_hash", "task", "trait", "replicate", F.explode(values).alias("rated", "value"))
    return rows.select("key", "account_hash", "task", "trait", "replicate", "rated", number(F.col("value")).alias("rating"))


def replicate_stats(rows: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation over replicates, counts of given and missing."""
    return rows.groupBy(*by).agg(
        F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("sd"), F.count("rating").alias("n"), (F.count("*") - F.count("rating")).alias("n_missing")
    )


def vocabulary(vocab: DataFrame, most: int = 256) -> list[str]:
    """The names in order of ``trait_idx``; more than ``most`` are an error, so what is made of them is bounded."""
    rows = vocab.select("name", "trait_idx").filter("name is not null").limit(4 * most + 1).collect()
    first: dict[str, int] = {}
    for r in rows:
        i = r["trait_idx"] if r["trait_idx"] is not None else 1 << 31
        first[r["name"]] = min(i, first.get(r["name"], i))
    if len(first) > most or len(rows) > 4 * most:
        raise ValueError(f"the vocabulary of a network is at most {most} names")
    return sorted(first, key=lambda n: (first[n], n))


def vocabulary_pairs(vocab: DataFrame) -> Column:
    """All ordered pairs of different names as one array literal."""
    names = vocabulary(vocab)
    return F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dep")) for a in names for b in names if a != b]) if len(names) > 1 else F.array().cast("array<struct<src:string,dep:string>>")


def grid(accounts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Every account with every ordered pair."""
    return accounts.select("account_hash", F.explode(vocabulary_pairs(vocab)).alias("p")).select("account_hash", "p.src", "p.dep")


def ablation_edges(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """A5: weight = rating of ``dep`` with everything minus its rating without ``src``; 0 if missing."""
    both_tasks = rows.filter("task in ('e1_baseline', 'e1_ablate_elicit') and account_hash is not null")
    stats = both_tasks.groupBy("account_hash", "task", "trait", "rated").agg(F.sum("rating").alias("s"), F.count("rating").alias("n"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("sd"))
    stats = cut_lineage(stats)  # the responses are parsed once, whatever is joined below
    base = stats.filter("task = 'e1_baseline'").groupBy("account_hash", F.col("rated").alias("dep")).agg((F.sum("s") / F.when(F.sum("n") > 0, F.sum("n"))).alias("full"))
    cut = stats.filter("task = 'e1_ablate_elicit'").select(
        "account_hash", F.col("trait").alias("src"), F.col("rated").alias("dep"), F.col("mean").alias("without"), F.col("sd").alias("weight_sd"), F.col("n").alias("n_replicates")
    )
    both = cut.select("account_hash", "src").distinct().join(base.select("account_hash").distinct(), "account_hash", "left_semi")
    names = vocabulary(vocab)
    targets = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    cells = both.filter(F.col("src").isin(*names)).select("account_hash", "src", F.explode(targets).alias("dep")).filter("src != dep")
    out = cells.join(base, ["account_hash", "dep"], "left").join(cut, ["account_hash", "src", "dep"], "left")
    return out.select("account_hash", "src", "dep", F.coalesce(F.col("full") - F.col("without"), F.lit(0.0)).alias("weight"), "weight_sd", F.coalesce("n_replicates", F.lit(0)).alias("n_replicates"))


def pair_edges(rows: DataFrame, task: str) -> DataFrame:
    """A6, A7 before completion: mean rating per account and named pair."""
    named = rows.filter((F.col("task") == task) & (F.col("rated") == "rating")).select("account_hash", F.split_part("trait", F.lit("->"), F.lit(1)).alias("src"), F.split_part("trait", F.lit("->"), F.lit(2)).alias("dep"), "rating")
    return replicate_stats(named.filter("src != dep and dep != ''"), "account_hash", "src", "dep").withColumnRenamed("mean", "weight")


def quotes(store: DataFrame, most: int = 240, task: str = "evidence_chunk") -> DataFrame:
    """The quotes of evidence responses: typed, trimmed, cut to ``most``, direction defaulted."""
    by_trait = F.from_json(json_object(F.col("response")), "map<string,string>", STRICT)
    rows = store.filter(F.col("task") == task).select("key", "account_hash", F.col("trait").alias("chunk"), F.explode(by_trait).alias("name", "list"))
    one = F.explode(F.from_json("list", "array<struct<quote:string,direction:string>>", STRICT))
    rows = rows.select("key", "account_hash", "chunk", "name", one.alias("q"))
    quote = F.substring(F.trim("q.quote"), 1, most)
    direction = F.when(F.lower("q.direction").isin("for", "against"), F.lower("q.direction")).otherwise("for")
    return rows.select("key", "account_hash", "chunk", "name", quote.alias("quote"), direction.alias("direction")).filter("quote is not null and quote != ''")


def ranked_quotes(rows: DataFrame, keep: int) -> DataFrame:
    """O3: per account and name, one of each normalised quote, the longest 2·keep, then the first keep by chunk."""
    norm = F.substring(F.regexp_replace(F.lower("quote"), r"\s+", " "), 1, 120)
    order = F.struct(-F.length("quote"), "chunk", "key", "quote")
    one = rows.withColumn("norm", norm).groupBy("account_hash", "name", "norm").agg(F.min(F.struct(order.alias("o"), "quote", "chunk", "direction", "key")).alias("m")).select("account_hash", "name", "m.quote", "m.chunk", "m.direction", "m.key")
    by_length = Window.partitionBy("account_hash", "name").orderBy(F.desc(F.length("quote")), "chunk", "key", "quote")
    long = one.withColumn("r", F.row_number().over(by_length)).filter(F.col("r") <= 2 * keep)
    by_chunk = Window.partitionBy("account_hash", "name").orderBy("chunk", "r")
    return long.withColumn("rank", F.row_number().over(by_chunk)).filter(F.col("rank") <= keep).drop("r")


def brief_quotes(store: DataFrame, strategy: str = "per_chunk", keep: int = 8) -> DataFrame:
    """C4: the quotes of each account's brief, ranked within a name.

    ``per_chunk``: from the answers about single chunks, merged by ``ranked_quotes``; ``single``: as one answer
    about the whole history lists them, by text.
    """
    if strategy == "per_chunk":
        return ranked_quotes(quotes(store).filter("account_hash is not null"), keep)
    if strategy != "single":
        raise ValueError(f"no such strategy: {strategy}")
    rows = quotes(store, task="evidence_brief").filter("account_hash is not null").withColumn("chunk", F.lit(None).cast("string"))
    w = Window.partitionBy("account_hash", "name").orderBy("key", "quote", "direction")
    return rows.withColumn("rank", F.row_number().over(w))


def briefs(ranked: DataFrame, vocab: DataFrame) -> DataFrame:
    """C4: ``account_hash``, ``n_quotes``, ``brief``: a heading per name in order, its quotes below it.

    An account's brief is bounded by the vocabulary times the quotes kept per name.
    """
    names = vocabulary(vocab)
    line = F.concat(F.lit("- "), "direction", F.lit(': "'), "quote", F.lit('"'), F.when(F.col("chunk").isNotNull(), F.concat(F.lit(" ("), "chunk", F.lit(")"))).otherwise(F.lit("")))
    by = ranked.filter(F.col("name").isin(*names)).groupBy("account_hash", "name").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda z: z["line"]), "\n").alias("lines"))
    whole = by.groupBy("account_hash").agg(F.sum("n").alias("n_quotes"), F.map_from_entries(F.collect_list(F.struct("name", "lines"))).alias("m"))
    part = lambda n: F.coalesce(F.concat(F.lit("# "), n, F.lit("\n"), F.try_element_at("m", n)), F.concat(F.lit("# "), n, F.lit(": nothing found")))
    return whole.select("account_hash", "n_quotes", F.array_join(F.transform(F.array(*[F.lit(n) for n in names]), part), "\n\n").alias("brief"))


def normalised_weights(rows: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """Value plus one over the sum of it: Laplace weights, uniform where all values are 0."""
    plus = F.coalesce(value, F.lit(0.0)) + 1
    total = rows.groupBy(by).agg(F.sum(plus).alias("__t"))
    return rows.join(total, by).select(by, name, (plus / F.col("__t")).alias("weight"))


def on_vocabulary(rows: DataFrame, vocab: DataFrame, value: str) -> DataFrame:
    """``rows`` (account_hash, name, value) completed to every name of the vocabulary."""
    names = F.array(*[F.lit(n) for n in vocabulary(vocab)])
    cells = rows.select("account_hash").filter("account_hash is not null").distinct().select("account_hash", F.explode(names).alias("name"))
    return cells.join(rows, ["account_hash", "name"], "left").select("account_hash", "name", F.coalesce(value, F.lit(0)).cast("double").alias("value"))


def density(quote_rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Share of the evidence that each name has, with Laplace counts."""
    counts = quote_rows.groupBy("account_hash", "name").agg(F.count("*").alias("n"))
    return normalised_weights(on_vocabulary(counts, vocab, "n"), "account_hash", "name", "value")


def self_relevance(rows: DataFrame, vocab: DataFrame, middle: float = 50.0) -> DataFrame:
    """How far from the middle the account's first baseline rating is."""
    first = rows.filter("task = 'e1_baseline'").groupBy("account_hash", "rated").agg(F.min_by("rating", F.struct("replicate", "key")).alias("r"))
    away = first.select("account_hash", F.col("rated").alias("name"), (F.abs(F.col("r") - middle) / 50 * 100).alias("away"))
    return normalised_weights(on_vocabulary(away, vocab, "away"), "account_hash", "name", "value")


def salience(rows: DataFrame, store: DataFrame, vocab: DataFrame, middle: float = 50.0) -> DataFrame:
    """Mean distance from the middle over an account's chunk responses; a missing rating counts 0."""
    responses = store.filter("task = 'e3_chunk'").groupBy("account_hash").agg(F.count("response").alias("n"))
    sums = rows.filter("task = 'e3_chunk'").groupBy("account_hash", "rated").agg(F.sum(F.coalesce(F.abs(F.col("rating") - middle), F.lit(0.0))).alias("s"))
    mean = sums.join(responses, "account_hash").select("account_hash", F.col("rated").alias("name"), (F.col("s") / F.col("n")).alias("value0"))
    return normalised_weights(on_vocabulary(mean, vocab, "value0"), "account_hash", "name", "value")


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised product of two weightings."""
    both = a.join(b.withColumnRenamed("weight", "other"), ["account_hash", "name"]).select("account_hash", "name", (F.col("weight") * F.col("other")).alias("p"))
    total = both.groupBy("account_hash").agg(F.sum("p").alias("t"))
    return both.join(total, "account_hash").select("account_hash", "name", (F.col("p") / F.col("t")).alias("weight"))


#: Node weightings by name, each from the call store and the vocabulary.
WEIGHTINGS = {
    "density": lambda store, vocab: density(quotes(store), vocab),
    "self_relevance": lambda store, vocab: self_relevance(ratings(store), vocab),
    "salience": lambda store, vocab: salience(ratings(store), store, vocab),
    "combined": lambda store, vocab: combined(density(quotes(store), vocab), self_relevance(ratings(store), vocab)),
}


def node_weights(kind: str, store: DataFrame, vocab: DataFrame) -> DataFrame:
    """account_hash, name, weight by the weighting of that name."""
    if kind not in WEIGHTINGS:
        raise KeyError(f"no weighting {kind}; there are {sorted(WEIGHTINGS)}")
    return WEIGHTINGS[kind](store, vocab)


def hash_unit(text: Column) -> Column:
    """A uniform number in [0, 1] from the first 8 hex digits of sha256; the same on any engine."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def mock_rating(text: Column) -> Column:
    """A seeded rating, rounded half to even and clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(hash_unit(text) * 100, 0)))
