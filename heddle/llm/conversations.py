"""Rebuilding conversations from message rows (problem 1).

A user's messages form one channel in which several exchanges may interleave.
``link_replies`` scores every candidate reply link (an earlier message of the
channel at most ``GAP`` seconds before) by time, turn-taking, mentions and
lexical overlap, and picks the likeliest parent. A message without a candidate
opens a conversation, which by definition runs up to the next such message in
order of (ts, id). Within it a link of at least MIN_SCORE makes a message part
of its parent's thread; with a lower one it begins a thread of its own. Threads
are the trees of these links: they take interleaved exchanges apart.

Scale. A channel may hold a third of all messages, so no step gathers a channel:
it is cut into time buckets of ``BUCKET`` seconds; each bucket is given the
last ``GAP`` seconds before it as a halo, so links are exact across cuts. What
goes from bucket to bucket (the last root) is one row per bucket. A task
follows links to the root of a tree within its bucket; where a tree comes in
from the bucket before, pointer doubling over the few messages at such seams
finds the root. Conversations are summarised by partial aggregates.

Cases. Rows without user_id, id or ts belong to no conversation. Deliveries of
one id count once. A ts beyond 1e11 is in milliseconds, beyond 1e14 in
microseconds. Null or blank texts are messages without content. Equal times are
ordered by id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from heddle.llm.common import clean_key, settle, table

GAP = 1800.0
BUCKET = 6 * 3600
# fixed values: names of the sides in chat logs
ROLES = {
    "user": ["user", "human", "customer", "client", "you", "me", "prompter", "visitor", "member"],
    "bot": ["bot", "assistant", "ai", "agent", "model", "gpt", "ai bot", "chatbot", "chat bot", "robot", "machine"],
    "system": ["system", "sys"],
}
# Weights of a link's score; the time term falls without bound, the rest is bounded by BONUS.
W_TIME, W_TURN, W_MENTION, W_LEXICAL = 1.0, 0.7, 0.5, 1.0
BONUS = W_TURN + W_MENTION + W_LEXICAL
MIN_SCORE = -2.0  # of a reply: some seven minutes for a turn of the other side, longer the more words agree


def clean_role(column: Column | str) -> Column:
    """user, bot or system; anything else, null too, is null."""
    c = F.col(column) if isinstance(column, str) else column
    plain = F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}]+", " "))
    return F.coalesce(*[F.when(plain.isin(names), F.lit(role)) for role, names in ROLES.items()])


def has_content(column: Column | str) -> Column:
    """Whether a letter or digit stands outside square brackets."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_replace(c, r"\[[^\[\]]*\]", " ").rlike(r"[\p{L}\p{N}]"), F.lit(False))


def messages(df: DataFrame) -> DataFrame:
    """Clean rows (user, ts, id, role, content, text), each id once, in seconds."""
    ts = F.col("ts").cast("double")
    seconds = F.when(F.abs(ts) >= 1e14, ts / 1e6).when(F.abs(ts) >= 1e11, ts / 1e3).otherwise(ts)
    rows = df.select(clean_key("user_id").alias("user"), seconds.alias("ts"), F.col("id").cast("long").alias("id"), clean_role("role").alias("role"), has_content("text").alias("content"), "text")
    rows = rows.filter("user is not null and id is not null and ts is not null and not isnan(ts)")
    once = rows.groupBy("id").agg(F.max(F.struct("user", "ts", "role", "content", "text")).alias("r"))
    return once.select("r.user", "r.ts", "id", "r.role", "r.content", "r.text")


WORD = re.compile(r"\w{2,}")


def _grams(text: str | None) -> frozenset:
    """Words of spaced scripts, three-letter pieces of the others."""
    out = []
    for w in WORD.findall((text or "").lower()):
        out += [w] if w.isascii() else [w[i : i + 3] for i in range(max(1, len(w) - 2))]
    return frozenset(out)


def link_score(dt: float, turn: bool, mention: bool, overlap: float) -> float:
    return -W_TIME * math.log1p(dt / 30.0) + W_TURN * turn + W_MENTION * mention + W_LEXICAL * overlap


def _parents(ts: list, ids: list, roles: list, texts: list, first: list | None = None) -> tuple[list, list]:
    """Where the likeliest parent of each message of ordered channels stands, and its score; first: where the channel of each message begins.

    Going back in time stops, exactly, where even the full bonus loses.
    """
    grams: list = []
    parent, score = [None] * len(ids), [None] * len(ids)
    for i in range(len(ids)):
        g = _grams(texts[i])
        names = {w[1:] for w in re.findall(r"@\w+", texts[i].lower())} if texts[i] and "@" in texts[i] else frozenset()
        best, at = -math.inf, None
        j, low = i - 1, first[i] if first else 0
        while j >= low and ts[i] - ts[j] <= GAP:
            dt = ts[i] - ts[j]
            if BONUS - W_TIME * math.log1p(dt / 30.0) <= best:
                break
            common = len(g & grams[j])
            overlap = common / math.sqrt(len(g) * len(grams[j])) if common else 0.0
            s = link_score(dt, roles[j] is not None and roles[j] != roles[i], bool(names) and bool(names & {roles[j] or "", str(ids[j])}), overlap)
            if s > best:
                best, at = s, j
            j -= 1
        grams.append(g)
        if at is not None:
            parent[i], score[i] = at, best
    return parent, score


COLUMNS = ["user", "bucket", "ts", "id", "role", "content", "parent", "score", "tree", "open"]


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by user, bucket, ts, id; a group may span batches."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        begins = ((part.user != part.user.shift()) | (part.bucket != part.bucket.shift())).to_numpy()
        first = np.maximum.accumulate(np.where(begins, np.arange(len(part)), 0)).tolist()
        ids, halo = part.id.tolist(), part.halo.to_numpy()
        at, score = _parents(part.ts.tolist(), ids, part.role.tolist(), part.text.tolist(), first)
        tree, open_ = list(ids), halo.tolist()  # what is before the bucket is followed there
        for k, (j, s) in enumerate(zip(at, score)):
            if j is not None and s >= MIN_SCORE and not halo[k]:
                tree[k], open_[k] = tree[j], open_[j]
        parent = pd.array([None if j is None else ids[j] for j in at], dtype="Int64")
        own = part.assign(parent=parent, score=score, tree=tree, open=open_)[~halo][COLUMNS]
        return own.astype({"user": object, "role": object})  # joined frames hold their strings in several pieces

    rest: list[pd.DataFrame] = []  # of the group that may go on
    for b in batches:
        if b.empty:
            continue
        user, bucket = b.user.iloc[-1], b.bucket.iloc[-1]
        last = ((b.user == user) & (b.bucket == bucket)).to_numpy()
        if last.all() and (not rest or (rest[-1].user.iloc[-1], rest[-1].bucket.iloc[-1]) == (user, bucket)):
            rest.append(b)
            continue
        yield solve(pd.concat([*rest, b[~last]], ignore_index=True))
        rest = [b[last]]
    if rest:
        yield solve(pd.concat(rest, ignore_index=True))


def link_replies(df: DataFrame) -> DataFrame:
    """(user, bucket, ts, id, role, content, parent, score, tree, open) for clean messages.

    A null parent marks the first message of a conversation. ``tree`` is the
    root of the thread or, where ``open``, the message before the bucket that
    the thread goes back to.
    """
    bucket = F.floor(F.col("ts") / BUCKET).cast("long")
    last = F.floor((F.col("ts") + GAP) / BUCKET).cast("long")
    spread = df.withColumn("own", bucket).withColumn("bucket", F.explode(F.sequence(bucket, last))).withColumn("halo", F.col("bucket") != F.col("own")).drop("own")
    ordered = spread.repartition("user", "bucket").sortWithinPartitions("user", "bucket", "ts", "id")
    return ordered.mapInPandas(_link, "user string, bucket long, ts double, id long, role string, content boolean, parent long, score double, tree long, open boolean")


def seams(links: DataFrame) -> DataFrame:
    """(id, root): the root of the thread of every message that a later bucket goes back to.

    Each round doubles how far back a message sees, so a thread that runs
    through n buckets takes log2(n) rounds.
    """
    entries = links.filter("open").select(F.col("tree").alias("id")).distinct()
    hops = settle(links.select("id", "tree", "open").join(entries, "id"))
    while hops.filter("open").limit(1).count():
        far = hops.select(F.col("id").alias("tree"), F.col("tree").alias("far"), F.col("open").alias("further"))
        hops = settle(hops.join(far, "tree", "left").select("id", F.when(F.col("open"), F.col("far")).otherwise(F.col("tree")).alias("tree"), (F.col("open") & F.col("further")).alias("open")))
    return hops.select("id", F.col("tree").alias("root"))


def threads(links: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """``links`` with ``thread``: the id of the first message of its tree; ``linked``: all links, if these are some of them."""
    far = seams(links if linked is None else linked).select(F.col("id").alias("tree"), "root")
    whole = links.filter("not open").withColumn("thread", F.col("tree"))
    return whole.unionByName(links.filter("open").join(far, "tree").withColumn("thread", F.col("root")).select(*links.columns, "thread"))


def conversations(links: DataFrame) -> DataFrame:
    """One row per link tree: its ends, size, roles and the verdict why it is unusable (null: usable).

    The tree of a message is named by its root: the last root at or before it,
    found within its bucket and else carried over from earlier buckets.
    """
    place = F.struct("ts", "id")
    inside = W.partitionBy("user", "bucket").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    rooted = links.withColumn("root", F.last(F.when(F.col("parent").isNull(), F.col("id")), ignorenulls=True).over(inside))
    ends = links.filter("parent is null").groupBy("user", "bucket").agg(F.max_by("id", place).alias("end_root"))
    ends = links.groupBy("user", "bucket").agg(F.lit(1).alias("x")).drop("x").join(ends, ["user", "bucket"], "left")
    before = W.partitionBy("user").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("user", "bucket", F.last("end_root", ignorenulls=True).over(before).alias("carried"))
    named = rooted.join(carried, ["user", "bucket"]).withColumn("root", F.coalesce("root", "carried"))
    turn = F.col("role").isin("user", "bot") & F.col("content")
    whole = named.groupBy("user", "root").agg(
        F.min_by("id", place).alias("first_id"),
        F.max_by("id", place).alias("last_id"),
        F.count("*").alias("n_messages"),
        F.sum(F.col("role").isNull().cast("int")).alias("n_unreadable"),
        F.sum((turn & (F.col("role") == "user")).cast("int")).alias("n_user"),
        F.sum((turn & (F.col("role") == "bot")).cast("int")).alias("n_bot"),
        F.min_by(F.when(turn, F.col("role")), F.when(turn, place)).alias("first_role"),
        F.max_by(F.when(turn, F.col("role")), F.when(turn, place)).alias("last_role"),
    )
    why = (
        F.when(F.col("n_unreadable") > 0, "role")
        .when(F.col("n_user") == 0, "empty")
        .when(F.col("first_role") != "user", "start")
        .when(F.col("last_role") != "bot", "no reply")
    )
    return whole.withColumn("why", why)


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations(settle(link_replies(messages(table(spark, d, "messages")))))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Conversations to be dropped."""
    return _conversations(spark, d).filter("why is not null").select(F.upper("user").alias("user_id"), "first_id", "last_id")


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Usable conversations with their turns in order and the threads they form, one row per turn."""
    linked = settle(link_replies(messages(table(spark, d, "messages"))))
    good = conversations(linked).filter("why is null").select("user", "root", "first_id", "last_id")
    starts = good.select("user", F.col("first_id").alias("id"), F.col("last_id").alias("stop"))
    ends = good.select("user", F.col("last_id").alias("id"), F.lit(True).alias("closes"))
    place = W.partitionBy("user", "bucket").orderBy("ts", "id")
    marked = linked.join(starts, ["user", "id"], "left").join(ends, ["user", "id"], "left")
    own = F.last(F.when(F.col("parent").isNull(), F.struct(F.col("id").alias("first_id"), F.col("stop"))), ignorenulls=True).over(place.rowsBetween(W.unboundedPreceding, 0))
    inside = marked.withColumn("whole", own)
    tails = marked.filter("parent is null").groupBy("user", "bucket").agg(F.max_by(F.struct(F.col("id").alias("first_id"), "stop"), F.struct("ts", "id")).alias("tail"))
    buckets = linked.groupBy("user", "bucket").agg(F.lit(1).alias("x")).drop("x").join(tails, ["user", "bucket"], "left")
    carried = buckets.select("user", "bucket", F.last("tail", ignorenulls=True).over(W.partitionBy("user").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    named = inside.join(carried, ["user", "bucket"]).withColumn("whole", F.coalesce("whole", "carried"))
    return threads(named.filter(F.col("whole.stop").isNotNull()), linked).select(
        F.upper("user").alias("user_id"), F.col("whole.first_id").alias("conversation_id"), F.col("thread").alias("thread_id"), "id", "ts", "role", "content",
        F.when(F.col("score") >= MIN_SCORE, F.col("parent")).alias("parent"), F.round("score", 6).alias("score"),
    )


QUERIES = {"p1_found": p1_found, "p1_conversations": p1_conversations}

SQL = {
    "p1_found": r"""
with m as (
  select id, lower(trim(user_id, E' \t\n\r')) u,
    case when ts >= 1e14 then ts / 1e6 when ts >= 1e11 then ts / 1e3 else ts end t,
    trim(regexp_replace(lower(role), '[^\p{L}]+', ' ', 'g')) r,
    coalesce(regexp_matches(regexp_replace(text, '\[[^\[\]]*\]', ' ', 'g'), '[\p{L}\p{N}]'), false) c
  from (select distinct * from messages) where trim(user_id, E' \t\n\r') <> '' and ts is not null),
o as (select *, case when r in ('user','human','customer','client','you','me','prompter','visitor','member') then 'user'
    when r in ('bot','assistant','ai','agent','model','gpt','ai bot','chatbot','chat bot','robot','machine') then 'bot'
    when r in ('system','sys') then 'system' end role,
    case when t - lag(t) over (partition by u order by t, id) <= 1800 then 0 else 1 end s from m),
n as (select *, sum(s) over (partition by u order by t, id rows unbounded preceding) g from o),
f as (select u, g, arg_min(id, (t, id)) first_id, arg_max(id, (t, id)) last_id,
    count(*) filter (role is null) bad, count(*) filter (role = 'user' and c) nu,
    arg_min(role, (t, id)) filter (role in ('user','bot') and c) fr,
    arg_max(role, (t, id)) filter (role in ('user','bot') and c) lr from n group by u, g)
select upper(u) user_id, first_id, last_id from f
where bad > 0 or nu = 0 or coalesce(fr, '') <> 'user' or coalesce(lr, '') <> 'bot'"""
}
