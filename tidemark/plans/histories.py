"""Queries on account histories, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import prompts
from tidemark.operators import chunking, history as H
from tidemark.sources.tables import table

EXACT = ["mossbroths", "willowskillet", "copperferries"]
PREFIXES = ["quiet", "amber"]
FORUM = "nullif(trim(regexp_replace(lower(trim(subreddit)), '^/?r/', '')), '')"
BLANK = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"
EXCLUDED = "(" + FORUM + " in (" + ", ".join(f"'{x}'" for x in EXACT) + ") or " + " or ".join(f"{FORUM} like '{p}%'" for p in PREFIXES) + ")"


def _named(s, d):
    return table(s, d, "items").withColumn("subreddit", H.forum_name(F.col("subreddit")))


def account_profile(s, d):
    """A2: profile of each account over its deduplicated, normalised history."""
    rows = H.first_fetched(table(s, d, "items"), ["account_hash", "kind", "subreddit", "created_utc"]).filter("created_utc is not null")
    return H.profile(rows.withColumns({"kind": F.lower("kind"), "subreddit": H.forum_name(F.col("subreddit"))}))


FIRST = """
first_fetched as (
  select * exclude (rn) from (select *, row_number() over (partition by item_id order by fetched_utc nulls last, score nulls last, md5(coalesce(body, '')), coalesce(source, '')) as rn
  from items where item_id is not null) where rn = 1)
"""

RANKED = f"""
with ranked as (
  select item_id, account_hash, created_utc, coalesce(length(body), 0) as len,
         row_number() over (partition by account_hash order by created_utc, item_id) - 1 as position, count(*) over (partition by account_hash) as group_size
  from (select * exclude (rn) from (select *, row_number() over (partition by item_id order by fetched_utc nulls last, score nulls last, md5(coalesce(body, '')), coalesce(source, '')) as rn
        from items where item_id is not null) where rn = 1)
  where account_hash is not null and created_utc is not null)
"""


def _ranked(s, d):
    items = table(s, d, "items").withColumn("len", F.coalesce(F.length("body"), F.lit(0)))
    rows = H.first_fetched(items, ["account_hash", "created_utc", "len"])
    return H.ranked(rows, "account_hash", "created_utc", "item_id")


def sample_frame(s, d):
    """The one analytic query of the history dumps."""
    return H.sample_frame(_named(s, d), ["0000000000000000"], 5, 3)


def exclusion_exact_anti(s, d):
    """items outside an exact list of forums, as an anti join with the list."""
    items = _named(s, d).select("item_id", "subreddit").distinct()
    listed = s.createDataFrame([(x,) for x in EXACT], "subreddit string")
    return items.join(F.broadcast(listed), "subreddit", "left_anti").select("item_id", "subreddit")


def exclusion_prefix(s, d):
    """items whose forum is on the list or begins with a prefix."""
    items = _named(s, d)
    return items.filter(H.excluded(F.col("subreddit"), EXACT, PREFIXES)).select("item_id", "subreddit").distinct()


def excluded_fraction_guard(s, d):
    """rows left once accounts with too many excluded items are rejected."""
    items = _named(s, d)
    kept = H.exclusion_guard(items, H.excluded(F.col("subreddit"), EXACT, PREFIXES), 0.3)
    return kept.groupBy("account_hash").agg(F.count("*").alias("n_kept"))


def history_cap_newest_first(s, d):
    """The newest items per account and kind."""
    rows = H.first_fetched(table(s, d, "items"), ["account_hash", "kind", "created_utc"]).filter("account_hash is not null").select("item_id", "account_hash", "kind", "created_utc")
    return H.newest(rows, ["account_hash", "kind"], 5)


def union_dedupe_sources(s, d):
    """Two sources united; the dump wins over the fetch, then the least row."""
    items = table(s, d, "items")
    cols = ["item_id", "account_hash", "kind", "created_utc"]
    return H.deduped_union([items.filter("source = 'arctic_shift'"), items.filter("source = 'praw'")], "item_id", cols)


def index_upsert(s, d):
    """The index after its newest rows replaced the older ones."""
    index = table(s, d, "account_index").select("account_hash", "n_items", "n_posts", "span_days", "ingested_utc")
    newest = index.filter("account_hash is not null").groupBy("account_hash").agg(F.max("ingested_utc").alias("at"))
    split = index.join(newest, "account_hash")
    old = split.filter("ingested_utc < at").select(index.columns)
    new = split.filter("ingested_utc = at").select(index.columns).distinct()
    return H.upsert(old, new, "account_hash")


def entity_hash(s, d):
    """Raw name to hash, the dimension that never leaves its store."""
    return table(s, d, "customer").select("c_custkey", H.entity_hash(F.col("c_name"), "salt-1").alias("account_hash"))


def normalise_items(s, d):
    """Typed, defaulted items (bodies by length and hash)."""
    out = H.normalised(H.first_fetched(table(s, d, "items")))
    return out.select(*[c for c in out.columns if c != "body"], F.length("body").alias("body_length"), F.md5("body").alias("body_md5"))


def usage_json_extract(s, d):
    """JSON functions, F12: token counts out of the usage column, with what they add up to."""
    u = F.from_json("usage", "input_tokens bigint, output_tokens bigint")
    return table(s, d, "calls").select("key", u["input_tokens"].alias("tokens_in"), u["output_tokens"].alias("tokens_out"), (F.coalesce(u["input_tokens"], F.lit(0)) + F.coalesce(u["output_tokens"], F.lit(0))).alias("total")).distinct()


def props_json_extract(s, d):
    """JSON functions over the event properties."""
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


def gap_cohorts_topn(s, d):
    """Ingest cohorts by gaps in time, and the largest accounts of each."""
    rows = table(s, d, "account_index").groupBy("account_hash").agg(F.max("ingested_utc").alias("at"), F.max("n_items").alias("n_items"))
    from pyspark.sql import Window

    marked = H.gap_cohorts(rows, "at", 20 * 86400)
    w = Window.partitionBy("cohort").orderBy(F.desc_nulls_last("n_items"), "account_hash")
    return marked.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("account_hash", "cohort", "n_items", "rn")


def candidate_probe_sample(s, d):
    """Accounts in the order in which probes at fixed times meet them."""
    probes = [(i, 1400000000 + i * 37_000_000) for i in range(8)]
    return H.probe_sample(H.first_fetched(table(s, d, "items"), ["account_hash", "created_utc"]), probes, 50, 60)


def thread_order(s, d):
    """Threads of an account in the order of their first item."""
    rows = H.first_fetched(table(s, d, "items"), ["account_hash", "link_id", "created_utc"]).filter("account_hash is not null and link_id is not null")
    firsts = rows.groupBy("account_hash", "link_id").agg(F.min(F.struct("created_utc", "item_id")).alias("f"), F.count("*").alias("n"))
    flat = firsts.select("account_hash", "link_id", "n", F.col("f.created_utc").alias("first_utc"), F.col("f.item_id").alias("first_item"))
    return H.ranked(flat, "account_hash", "first_utc", "first_item").select("account_hash", "link_id", "n", (F.col("position") + 1).alias("thread_no"))


def normalise_posts(s, d):
    """Bodies of posts from title and text; parts of the catalogue stand in, every third without text."""
    rows = table(s, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" \n")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).alias("text"))
    return rows.select("p_partkey", H.post_body(F.col("title"), F.col("text")).alias("body"))


def eligible_only(s, d):
    """The newest index row of each account that is marked eligible, among those with calls."""
    index = table(s, d, "account_index").filter("account_hash is not null")
    newest = index.groupBy("account_hash").agg(F.max_by(F.struct("eligible", "n_items", "n_chunks"), F.struct("ingested_utc", F.coalesce("n_items", F.lit(-1)), F.coalesce("n_chunks", F.lit(-1)))).alias("r"), F.max("ingested_utc").alias("ingested_utc"))
    only = table(s, d, "calls").select("account_hash").distinct()
    return newest.select("account_hash", "r.*", "ingested_utc").filter("eligible").join(only, "account_hash", "left_semi").select("account_hash", "n_items", "n_chunks", "ingested_utc")


def _pieces(s, d):
    """Ranked items with what each adds to a chunk's text, as first fetched."""
    items = table(s, d, "items").withColumn("piece", F.concat(F.lit("("), F.coalesce("subreddit", F.lit("unknown")), F.lit(") "), F.coalesce(H.strip(F.col("body")), F.lit(""))))
    rows = H.first_fetched(items, ["account_hash", "created_utc", "piece"]).withColumn("len", F.length("piece"))
    return H.ranked(rows, "account_hash", "created_utc", "item_id")


def _chunk_columns(chunks, strategy):
    return chunks.select("account_hash", "chunk_id", F.lit(strategy).alias("strategy"), "t_start", "t_end", "n_chars", F.array_join("item_ids", ",").alias("item_ids"), F.md5("text").alias("text_md5"), "epoch")


def chunk_window_texts(s, d):
    """Windows of 15 items packed into texts of at most 6,000 characters."""
    rows = chunking.count_windows(_pieces(s, d), 15)
    packed = chunking.greedy_pack(rows.drop("piece"), ["account_hash", "window_no"], ["position"], "len", 6000, "item_id").select("account_hash", "window_no", "item_id", "pack")
    placed = rows.join(packed, ["account_hash", "window_no", "item_id"])
    built = chunking.texts(placed, ["account_hash", "window_no", "pack"], "position", "piece", 200)
    times = placed.groupBy("account_hash", "window_no", "pack").agg(F.min("created_utc").alias("t_start"), F.max("created_utc").alias("t_end"))
    span = rows.groupBy("account_hash").agg(F.min("created_utc").alias("lo"), F.max("created_utc").alias("hi"), F.greatest(F.lit(2), F.least(F.lit(6), F.floor(F.count("*") / 40))).cast("int").alias("bins"))
    both = built.join(times, ["account_hash", "window_no", "pack"]).join(span, "account_hash")
    epoch = F.least(F.floor((F.col("t_start") - F.col("lo")) * F.col("bins") / (F.col("hi") + 1 - F.col("lo"))), F.col("bins") - 1).cast("int")
    ordered = both.withColumn("epoch", epoch).withColumn("at", F.col("window_no") * 16 + F.col("pack"))
    return _chunk_columns(chunking.numbered(ordered, "account_hash", "at"), "window")


def prompt_requests(s, d):
    """The request for every chunk, in two versions."""
    rows, scale = table(s, d, "chunks").select("chunk_id", "text").distinct(), prompts.scale(["honest", "patient"])
    versions = [rows.select("chunk_id", F.lit(v).alias("version"), prompts.render(prompts.template(v, "e3_chunk"), text=F.col("text"), scale=scale).alias("request")) for v in ("p1", "p1b")]
    return versions[0].unionByName(versions[1]).select("chunk_id", "version", F.md5("request").alias("request_md5"), F.length("request").alias("n_chars")).distinct()


def chunk_sampled_texts(s, d):
    """A sample of each of 8 equal windows, in texts of at most 1,500 characters."""
    rows = chunking.equal_windows(_pieces(s, d).filter("group_size > 8"), 8)
    sampled = chunking.sampled_positions(rows, 1500, ["account_hash", "window_no"], "len", "position")
    kept = chunking.within_budget(sampled, ["account_hash", "window_no"], "position", "len", 1500)
    times = rows.groupBy("account_hash", "window_no").agg(F.min("created_utc").alias("t_start"), F.max("created_utc").alias("t_end"))
    built = chunking.texts(kept, ["account_hash", "window_no"], "position", "piece", 200).join(times, ["account_hash", "window_no"])
    return _chunk_columns(chunking.numbered(built.withColumn("epoch", F.floor(F.col("window_no") * 2 / 8).cast("int")), "account_hash", "window_no"), "sampled_window")


def chunk_count_windows(s, d):
    """Windows by count, short ones dropped, numbered densely."""
    rows = chunking.count_windows(_ranked(s, d), 20)
    chunks = rows.groupBy("account_hash", "window_no").agg(F.count("*").alias("n"), F.sum(F.col("len") + 2).alias("chars"), F.min("created_utc").alias("t_start"), F.max("created_utc").alias("t_end"))
    kept = chunks.withColumn("n_chars", F.col("chars") - 2).filter("n_chars >= 100")
    return chunking.numbered(kept, "account_hash", "window_no").select("account_hash", "chunk_id", "n", "n_chars", "t_start", "t_end")


def chunk_equal_windows(s, d):
    """Windows of near-equal count and the epoch each begins in."""
    rows = chunking.equal_windows(_ranked(s, d).filter("group_size >= 8"), 8)
    w = rows.groupBy("account_hash", "window_no").agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.first("group_size").alias("group_size"))
    bins = F.greatest(F.lit(2), F.least(F.lit(6), F.floor(F.col("group_size") / 40))).cast("int")
    return w.select("account_hash", "window_no", "n", "first_position", F.floor(F.col("window_no") * bins / 8).cast("int").alias("epoch"))


def chunk_sampled_positions(s, d):
    """Evenly spaced items of each window within a budget."""
    rows = chunking.equal_windows(_ranked(s, d).filter("group_size >= 8"), 8)
    return chunking.sampled_positions(rows, 1500, ["account_hash", "window_no"], "len", "position").select("account_hash", "window_no", "position", "item_id")


def epoch_bins(s, d):
    """Equal spans of an account's time."""
    rows = _ranked(s, d)
    span = rows.groupBy("account_hash").agg(F.min("created_utc").alias("lo"), F.max("created_utc").alias("hi"), F.count("*").alias("n"))
    bins = F.greatest(F.lit(2), F.least(F.lit(6), F.floor(F.col("n") / 40))).cast("int")
    binned = rows.join(span.withColumn("bins", bins), "account_hash").withColumn("epoch", chunking.epoch_bins(F.col("created_utc"), F.col("lo"), F.col("hi"), F.col("bins")))
    return binned.groupBy("account_hash", "epoch").agg(F.count("*").alias("n"))


def chunk_greedy_pack(s, d):
    """Greedy packing of each window of 40 items."""
    rows = chunking.count_windows(_ranked(s, d), 40)
    packed = chunking.greedy_pack(rows, ["account_hash", "window_no"], ["created_utc", "item_id"], "len", 2000, "position")
    return packed.select("account_hash", "window_no", "item_id", "pack")


def chunk_thread_pack(s, d):
    """Greedy packing of each thread of an account."""
    items = table(s, d, "items").withColumn("len", F.coalesce(F.length("body"), F.lit(0)))
    rows = H.first_fetched(items, ["account_hash", "link_id", "created_utc", "len"])
    packed = chunking.greedy_pack_any(H.ranked(rows, ["account_hash", "link_id"], "created_utc", "item_id"), ["account_hash", "link_id"], ["item_id"], "len", 600)
    return packed.groupBy("account_hash", "link_id", "pack").agg(F.count("*").alias("n"), (F.sum(F.col("piece_length") + 2) - 2).alias("n_chars"))


def chunk_account_pack(s, d):
    """W6 over whole accounts, whatever their size."""
    packed = chunking.greedy_pack_any(_ranked(s, d), ["account_hash"], ["item_id"], "len", 4000)
    return packed.groupBy("account_hash", "pack").agg(F.count("*").alias("n"), (F.sum(F.col("piece_length") + 2) - 2).alias("n_chars"))


def chunk_source_items(s, d):
    """Chunks exploded to their items, counted against the history (semi join)."""
    parts = table(s, d, "chunks").select("chunk_id", F.explode(F.array_distinct("item_ids")).alias("item_id")).distinct()
    known = table(s, d, "items").select("item_id").distinct().withColumn("hit", F.lit(1))
    return parts.join(known, "item_id", "left").groupBy("chunk_id").agg(F.count("*").alias("n_items"), F.count("hit").alias("n_known"))


def _pack_sql(group: str, order: str, budget: int, source: str) -> str:
    return f"""
recursive seq as (select *, row_number() over (partition by {group} order by {order}) as r from ({source})),
walk as (
  select {group}, item_id, r, len, 0 as pack, len as cur from seq where r = 1
  union all
  select {', '.join('s.' + g.strip() for g in group.split(','))}, s.item_id, s.r, s.len,
         case when w.cur + s.len + 2 <= {budget} then w.pack else w.pack + 1 end, case when w.cur + s.len + 2 <= {budget} then w.cur + s.len + 2 else s.len end
  from walk w join seq s on s.r = w.r + 1 and {' and '.join(f's.{g.strip()} = w.{g.strip()}' for g in group.split(','))})
"""


PIECES = f"""
pieces as (
  select item_id, account_hash, created_utc, '(' || coalesce(subreddit, 'unknown') || ') ' || trim(coalesce(body, ''), {BLANK}) as piece,
         row_number() over (partition by account_hash order by created_utc, item_id) - 1 as position, count(*) over (partition by account_hash) as group_size
  from (select * exclude (rn) from (select *, row_number() over (partition by item_id order by fetched_utc nulls last, score nulls last, md5(coalesce(body, '')), coalesce(source, '')) as rn
        from items where item_id is not null) where rn = 1)
  where account_hash is not null and created_utc is not null)"""

_RANKED_BODY = RANKED.strip()[len("with ranked as ("):-1]

QUERIES = {
    f.__name__: f
    for f in (
        account_profile, sample_frame, exclusion_exact_anti, exclusion_prefix, excluded_fraction_guard, history_cap_newest_first, union_dedupe_sources, index_upsert,
        entity_hash, normalise_items, usage_json_extract, props_json_extract, gap_cohorts_topn, candidate_probe_sample, thread_order, normalise_posts, eligible_only, prompt_requests, chunk_window_texts, chunk_sampled_texts, chunk_count_windows,
        chunk_equal_windows, chunk_sampled_positions, epoch_bins, chunk_greedy_pack, chunk_thread_pack, chunk_account_pack, chunk_source_items,
    )
}

_SCALE = "Answer with one object that has each of these 2 words as a key and a whole number from 0 to 100 as value, and nothing else: honest, patient"

ORACLES = {
    "prompt_requests": f"""with r as (select distinct chunk_id, version, head || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '{_SCALE}' as q
  from chunks, (values ('p1', 'Judge only this excerpt.'), ('p1b', 'Here is one excerpt; judge nothing else.')) v(version, head))
select distinct chunk_id, version, md5(q) as request_md5, cast(length(q) as int) as n_chars from r""",
    "normalise_posts": f"""with p as (select p_partkey, trim(p_name, {BLANK}) as t, trim(case p_partkey % 3 when 0 then ' ' when 1 then p_type end, {BLANK}) as x from part)
select p_partkey, case when coalesce(x, '') <> '' then trim(t || chr(10) || chr(10) || x, {BLANK}) else t end as body from p""",
    "eligible_only": """with r as (select *, row_number() over (partition by account_hash order by ingested_utc desc nulls last, coalesce(n_items, -1) desc, coalesce(n_chunks, -1) desc) as rn from account_index where account_hash is not null)
select account_hash, n_items, n_chunks, ingested_utc from r where rn = 1 and eligible and account_hash in (select account_hash from calls)""",
    "chunk_window_texts": "with recursive " + PIECES.strip() + """,
seq as (select account_hash, position // 15 as window_no, item_id, created_utc, position, piece, length(piece) as len, row_number() over (partition by account_hash, position // 15 order by position) as r from pieces),
walk as (select account_hash, window_no, item_id, r, 0 as pack, len as cur from seq where r = 1
  union all
  select s.account_hash, s.window_no, s.item_id, s.r, case when w.cur + s.len + 2 <= 6000 then w.pack else w.pack + 1 end, case when w.cur + s.len + 2 <= 6000 then w.cur + s.len + 2 else s.len end
  from walk w join seq s on s.r = w.r + 1 and s.account_hash = w.account_hash and s.window_no = w.window_no),
b as (select s.account_hash, s.window_no, pack, string_agg(piece, chr(10) || chr(10) order by position) as text, string_agg(s.item_id, ',' order by position) as item_ids, min(created_utc) as t_start, max(created_utc) as t_end
  from seq s join walk w on w.account_hash = s.account_hash and w.window_no = s.window_no and w.r = s.r group by 1, 2, 3),
sp as (select account_hash, min(created_utc) as lo, max(created_utc) as hi, greatest(2, least(6, count(*) // 40)) as bins from pieces group by 1)
select b.account_hash, b.account_hash || ':' || lpad(cast(row_number() over (partition by b.account_hash order by window_no, pack) - 1 as varchar), 5, '0') as chunk_id, 'window' as strategy, t_start, t_end, cast(length(text) as int) as n_chars, item_ids, md5(text) as text_md5,
       cast(least(floor((t_start - lo) * bins / cast(hi + 1 - lo as double)), bins - 1) as int) as epoch from b join sp using (account_hash) where length(text) >= 200""",
    "chunk_sampled_texts": "with " + PIECES.strip() + """,
g as (select account_hash, group_size, cast(k as int) as window_no, floor(k * (group_size / 8.0::double)) as lo, floor((k + 1) * (group_size / 8.0::double)) as hi from (select distinct account_hash, group_size from pieces where group_size > 8), range(8) t(k)),
w as (select r.*, window_no, length(piece) as len from g join pieces r using (account_hash) where r.position >= lo and (r.position < hi or window_no = 7)),
s as (select account_hash, window_no, count(*) as n, min(position) as o, min(created_utc) as t_start, max(created_utc) as t_end, least(count(*), greatest(1, 1500 // greatest(1, cast(sum(len) as bigint) // count(*) + 2))) as keep from w group by 1, 2),
m as (select distinct account_hash, window_no, o + cast(case when keep = 1 then 0 else floor(m * ((n - 1)::double / greatest(keep - 1, 1))) end as bigint) as position from s, unnest(range(keep)) t(m)),
c as (select w.*, coalesce(sum(len + 2) over (partition by account_hash, window_no order by position rows between unbounded preceding and 1 preceding), 0) as used from w join m using (account_hash, window_no, position)),
o as (select *, max(case when used > 0 and used + len > 1500 then 1 else 0 end) over (partition by account_hash, window_no order by position) as ended from c),
b as (select account_hash, window_no, string_agg(piece, chr(10) || chr(10) order by position) as text, string_agg(item_id, ',' order by position) as item_ids from o where ended = 0 group by 1, 2)
select b.account_hash, b.account_hash || ':' || lpad(cast(row_number() over (partition by b.account_hash order by b.window_no) - 1 as varchar), 5, '0') as chunk_id, 'sampled_window' as strategy, t_start, t_end, cast(length(text) as int) as n_chars, item_ids, md5(text) as text_md5,
       cast(floor(b.window_no * 2 / 8) as int) as epoch from b join s using (account_hash, window_no) where length(text) >= 200""",
    "account_profile": f"""with {FIRST}
select account_hash, count(*) as n_items, count(*) filter (lower(kind) = 'comment') as n_comments, count(*) filter (lower(kind) = 'post') as n_posts,
       count(distinct {FORUM}) as n_subreddits, round((max(created_utc) - min(created_utc)) / 86400, 3) as span_days
from first_fetched where account_hash is not null and created_utc is not null group by 1""",
    "sample_frame": f"""select account_hash, count(*) as n, count(distinct {FORUM}) as n_subs, min(created_utc) as first_utc, max(created_utc) as last_utc
from items where account_hash is not null and account_hash not in ('0000000000000000') group by 1 having n >= 5 and n_subs >= 3""",
    "exclusion_exact_anti": f"select distinct item_id, {FORUM} as subreddit from items where {FORUM} is null or {FORUM} not in ({', '.join(repr(x) for x in EXACT)})",
    "exclusion_prefix": f"select distinct item_id, {FORUM} as subreddit from items where {EXCLUDED}",
    "excluded_fraction_guard": f"""with m as (select account_hash, coalesce({EXCLUDED}, false) as x from items where account_hash is not null),
k as (select account_hash from m group by 1 having avg(x::int) < 0.3) select account_hash, count(*) as n_kept from m where not x and account_hash in (select account_hash from k) group by 1""",
    "history_cap_newest_first": f"""with {FIRST}
select item_id, account_hash, kind, created_utc, newest_rank from (select item_id, account_hash, kind, created_utc,
  row_number() over (partition by account_hash, kind order by created_utc desc nulls last, item_id) as newest_rank from first_fetched where account_hash is not null) where newest_rank <= 5""",
    "union_dedupe_sources": """select item_id, account_hash, kind, created_utc, source_rank from (
  select item_id, account_hash, kind, created_utc, case source when 'arctic_shift' then 0 else 1 end as source_rank,
         row_number() over (partition by item_id order by case source when 'arctic_shift' then 0 else 1 end, account_hash nulls first, kind nulls first, created_utc nulls first) as rn
  from items where item_id is not null and source in ('arctic_shift', 'praw')) where rn = 1""",
    "index_upsert": """with n as (select account_hash, max(ingested_utc) as seen from account_index where account_hash is not null group by 1),
x as (select i.account_hash, n_items, n_posts, span_days, ingested_utc, seen from account_index i join n using (account_hash))
select distinct account_hash, n_items, n_posts, span_days, ingested_utc from x where ingested_utc = seen
union all select account_hash, n_items, n_posts, span_days, ingested_utc from x where ingested_utc < seen and account_hash not in (select account_hash from x where ingested_utc = seen)""",
    "entity_hash": "select c_custkey, substr(sha256('salt-1:' || lower(trim(c_name))), 1, 16) as account_hash from customer",
    "normalise_items": f"""with {FIRST}, b as (select *, case when trim(coalesce(body, ''), {BLANK}) in ('[deleted]', '[removed]') then '' else trim(coalesce(body, ''), {BLANK}) end as t from first_fetched)
select item_id, account_hash, lower(kind) as kind, {FORUM} as subreddit, created_utc, cast(coalesce(score, 0) as int) as score, nullif(parent_id, '') as parent_id,
       coalesce(permalink, '/comments/' || split_part(link_id, '_', 2) || '/_/' || split_part(item_id, '_', 2) || '/') as permalink, cast(length(t) as int) as body_length, md5(t) as body_md5
from b where created_utc is not null""",
    "usage_json_extract": """select distinct key, tokens_in, tokens_out, coalesce(tokens_in, 0) + coalesce(tokens_out, 0) as total from (
  select key, try_cast(json_extract_string(usage, '$.input_tokens') as bigint) as tokens_in, try_cast(json_extract_string(usage, '$.output_tokens') as bigint) as tokens_out from calls)""",
    "props_json_extract": "select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events",
    "gap_cohorts_topn": """with a as (select account_hash, max(ingested_utc) as seen, max(n_items) as n_items from account_index group by 1),
g as (select *, case when seen - lag(seen) over (order by seen, account_hash) > 20 * 86400 then 1 else 0 end as s from a where seen is not null),
c as (select *, cast(sum(s) over (order by seen, account_hash rows unbounded preceding) as bigint) as cohort from g),
r as (select *, row_number() over (partition by cohort order by n_items desc nulls last, account_hash) as rn from c)
select account_hash, cohort, n_items, rn from r where rn <= 3""",
    "candidate_probe_sample": f"""with {FIRST}, p as (select cast(i as int) as probe, 1400000000 + i * 37000000 as probe_utc from range(8) t(i)),
m as (select probe, account_hash, row_number() over (partition by probe order by created_utc, item_id) as pos from p join first_fetched f on f.created_utc >= p.probe_utc where account_hash is not null),
a as (select account_hash, probe, pos, row_number() over (partition by account_hash order by probe, pos) as rn from m where pos <= 50)
select account_hash, probe, pos from a where rn = 1 order by probe, pos limit 60""",
    "thread_order": f"""with {FIRST}, t as (select account_hash, link_id, min((created_utc, item_id)) as f, count(*) as n from first_fetched where account_hash is not null and link_id is not null group by 1, 2)
select account_hash, link_id, n, row_number() over (partition by account_hash order by f) as thread_no from t""",
    "chunk_count_windows": RANKED + """, c as (select account_hash, position // 20 as w, count(*) as n, sum(len + 2) - 2 as n_chars, min(created_utc) as t_start, max(created_utc) as t_end from ranked group by 1, 2)
select account_hash, account_hash || ':' || lpad(cast(row_number() over (partition by account_hash order by w) - 1 as varchar), 5, '0') as chunk_id, n, cast(n_chars as bigint) as n_chars, t_start, t_end from c where n_chars >= 100""",
    "chunk_equal_windows": RANKED + """, b as (select account_hash, group_size, cast(k as int) as window_no, floor(k * (group_size / 8.0::double)) as lo, floor((k + 1) * (group_size / 8.0::double)) as hi
  from (select distinct account_hash, group_size from ranked where group_size >= 8), range(8) t(k))
select account_hash, window_no, count(*) as n, min(position) as first_position, cast(floor(window_no * greatest(2, least(6, b.group_size // 40)) / 8) as int) as epoch
from b join ranked r using (account_hash) where r.position >= lo and (r.position < hi or window_no = 7) group by account_hash, window_no, b.group_size""",
    "chunk_sampled_positions": RANKED + """, b as (select account_hash, group_size, cast(k as int) as window_no, floor(k * (group_size / 8.0::double)) as lo, floor((k + 1) * (group_size / 8.0::double)) as hi
  from (select distinct account_hash, group_size from ranked where group_size >= 8), range(8) t(k)),
w as (select r.*, window_no from b join ranked r using (account_hash) where r.position >= lo and (r.position < hi or window_no = 7)),
s as (select account_hash, window_no, count(*) as n, min(position) as o, least(count(*), greatest(1, 1500 // greatest(1, cast(sum(len) as bigint) // count(*) + 2))) as keep from w group by 1, 2),
m as (select distinct account_hash, window_no, o + cast(case when keep = 1 then 0 else floor(m * ((n - 1)::double / greatest(keep - 1, 1))) end as bigint) as position from s, unnest(range(keep)) t(m))
select account_hash, window_no, position, item_id from w join m using (account_hash, window_no, position)""",
    "epoch_bins": RANKED + """, s as (select account_hash, min(created_utc) as lo, max(created_utc) as hi, greatest(2, least(6, count(*) // 40)) as bins from ranked group by 1)
select account_hash, cast(case when hi = lo then 0 else least(floor((created_utc - lo) * bins / cast(hi - lo as double)), bins - 1) end as int) as epoch, count(*) as n from ranked join s using (account_hash) group by 1, 2""",
    "chunk_greedy_pack": "with " + _pack_sql("account_hash, window_no", "created_utc, item_id", 2000, f"select *, position // 40 as window_no from ({_RANKED_BODY})") + "select account_hash, window_no, item_id, pack from walk",
    "chunk_thread_pack": "with " + _pack_sql(
        "account_hash, link_id", "created_utc, item_id", 600,
        "select account_hash, link_id, item_id, created_utc, coalesce(length(body), 0) as len from (" + FIRST.strip()[len("first_fetched as ("):-1] + ") where account_hash is not null and link_id is not null and created_utc is not null",
    ) + "select account_hash, link_id, pack, count(*) as n, cast(sum(len + 2) - 2 as bigint) as n_chars from walk group by 1, 2, 3",
    "chunk_account_pack": "with " + _pack_sql("account_hash", "created_utc, item_id", 4000, _RANKED_BODY) + "select account_hash, pack, count(*) as n, cast(sum(len + 2) - 2 as bigint) as n_chars from walk group by 1, 2",
    "chunk_source_items": """with p as (select distinct chunk_id, unnest(item_ids) as item_id from chunks)
select chunk_id, count(*) as n_items, count(*) filter (item_id in (select item_id from items)) as n_known from p group by 1""",
}
