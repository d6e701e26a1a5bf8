"""Quotation linking in chats, in DataFrame operations only.

Lines that start with ``>`` are quotations, nested as deep as they have marks.  Runs of lines of one level are cut into
passages at blank lines.  The whole run, the passage and each of its lines are normalised, hashed and joined to the
messages that first said them: as a whole message, one of its paragraphs or one of its lines.  The source of a passage is
one in the same conversation if possible, then that of the largest part, then that of the first line; the sources of all
matched parts are kept besides.  Originals are reduced to the first one per hash (and conversation) before the join, so a
line that a third of all messages share is one row on that side.

A message replies to the first message that it quotes at level one, if that is an earlier one of its conversation, and
otherwise to the message before it.  The first reply continues its parent's branch, later ones start a branch.  Branches
in the order of their first messages, messages in order inside, put every message behind the one it answers.  Nothing
gathers a conversation: positions are running values over sorted slices.

Defined results: a missing text is an empty message; a message with nothing but quotations has an empty body; messages
are ordered by turn, then by content, missing turns first; messages without conversation id form one conversation;
repeated rows are separate messages; a passage that no message said, or only later ones of its own conversation, stays
unlinked.  Ids of conversations are no time, so of other conversations the one with the smallest id counts as the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.tables import bind, stored
from gridlens.operators.distributed import global_row_number, null_safe_join, running

#: Marks of quotation and blanks at the start of a line, and what counts of them: up to two blanks in a row.  No pattern repeats
#: a group or looks for the end from inside a run, so the longest line takes neither stack nor squared time.
PREFIX, MARKS = r"^[ \t>]*+", r"(?s)^(.*?)(?:[ \t]{2}|[ \t]?$)"
#: Lines beyond this are no attributions.
LONGEST_ATTRIBUTION = 1000
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    """Lower case, one space for white space, no marks of quotation or punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"^[\s\p{P}]++|(?<![\s\p{P}])[\s\p{P}]++$", "")


def quote_lines(text: Column) -> Column:
    """Array of (level, line): nesting depth and the line without its marks."""
    return F.transform(F.split(text, "\n"), lambda x: bind(F.regexp_extract(F.regexp_extract(x, PREFIX, 0), MARKS, 1), lambda m: F.struct(
        F.length(F.regexp_replace(m, "[^>]", "")).alias("level"),
        F.when(m == "", x).otherwise(F.regexp_replace(x.substr(F.length(m) + 1, F.length(x)), "^ ", "")).alias("line"))))


def passages(lines: Column) -> Column:
    """Runs of lines of one level, cut at blank lines: array of (level, text, hash of the whole run)."""
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1),
                      lambda i: (i == 0) | (F.get(lines, i)["level"] != F.coalesce(F.get(lines, i - 1)["level"], F.lit(-1))))
    runs = bind(starts, lambda s: F.transform(s, lambda low, k: F.struct(
        F.get(lines, low)["level"].alias("level"),
        F.array_join(F.transform(F.slice(lines, low + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - low), lambda x: x["line"]), "\n").alias("text"))))
    return F.flatten(F.transform(F.filter(runs, lambda r: r["level"] > 0), lambda r: F.transform(
        F.filter(F.split(r["text"], r"\n\s*\n"), lambda t: normalised(t) != ""),
        lambda t: F.struct(r["level"].alias("level"), F.regexp_replace(t, r"^\s*\n|\n\s*$", "").alias("text"),
                           F.xxhash64(normalised(r["text"])).alias("run")))))


def parts(passage: Column) -> Column:
    """Parts of a passage, largest first: array of (way, hash), -1 for its whole run, 0 for itself, k for its k-th line."""
    words = F.filter(F.transform(F.split(passage["text"], "\n"), normalised), lambda x: x != "")
    own = F.xxhash64(normalised(passage["text"]))
    lines = F.transform(words, lambda x, k: F.struct((k + 1).alias("way"), F.xxhash64(x).alias("hash")))
    whole = F.array(F.struct(F.lit(-1).alias("way"), passage["run"].alias("hash")))
    self = F.array(F.struct(F.lit(0).alias("way"), own.alias("hash")))
    # What is its own whole run, or its own only line, is looked up once, as the passage.
    return F.concat(F.filter(whole, lambda x: x["hash"] != own), self, F.filter(lines, lambda x: x["hash"] != own))


def body(lines: Column) -> Column:
    """What a message says itself: lines outside quotations, without the line that introduces one."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(
        (F.length(x["line"]) <= LONGEST_ATTRIBUTION) & x["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s++|(?<!\s)\s++$", "")


def _said(text: Column) -> Column:
    """Hashes of a body: the whole, its paragraphs, its lines; nothing for texts without words."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, normalised), lambda p: p != ""), lambda p: F.xxhash64(p)))


def link_quotations(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """Per message: ids, body, reply_to, branch, position, and its quotations with their sources.

    ``position`` counts from one in the reply order of the conversation; ``branch`` is the turn of the branch's first
    message; ``quotes`` has level, passage, the conversation and turn that it comes from, if known, and ``sources`` with
    those of every matched part (``part`` -1 for the whole run, 0 for the passage, k for its k-th line with words).
    """
    rows = messages.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                           F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    rows = global_row_number(rows, ["conv", "turn", "tie"], "pos").drop("tie")
    rows = rows.withColumn("lines", quote_lines(F.col("text"))).select(
        "pos", "conv", "turn", "role", body(F.col("lines")).alias("body"), passages(F.col("lines")).alias("passages"))
    rows = stored(rows)

    quoted = rows.select("pos", "conv", F.posexplode("passages").alias("nr", "p"))
    quoted = quoted.select("pos", "conv", "nr", F.col("p.level").alias("level"), F.explode(parts(F.col("p"))).alias("x")).select(
        "pos", "conv", "nr", "level", "x.way", "x.hash")
    wanted = stored(quoted.select("hash").distinct())
    said = rows.select("pos", "conv", F.explode(_said(F.col("body"))).alias("hash")).join(wanted, "hash", "left_semi")
    inside = stored(said.groupBy("hash", "conv").agg(F.min("pos").alias("near")))
    # The first two conversations that said something: one of them is another than the quoting message's.
    first = stored(inside.groupBy("hash").agg(F.min("near").alias("far")))
    other = inside.join(first, "hash").filter("near > far").groupBy("hash").agg(F.min("near").alias("other"))
    anywhere = first.join(other, "hash", "left")
    found = null_safe_join(quoted, inside, ["hash", "conv"], "left").join(anywhere, "hash", "left")
    far = F.when(F.col("near") == F.col("far"), F.col("other")).otherwise(F.col("far"))
    source = F.when(F.col("near") < F.col("pos"), F.struct(F.lit(0).alias("away"), "way", F.col("near").alias("source"))).when(
        far.isNotNull(), F.struct(F.lit(1).alias("away"), "way", far.alias("source")))
    links = stored(found.select("pos", "nr", "level", source.alias("x")).filter("x is not null").select("pos", "nr", "level", "x.*"))
    names = rows.select(F.col("pos").alias("source"), F.col("conv").alias("source_conv"), F.col("turn").alias("source_turn"))
    known = F.struct("away", "way", "source", F.col("source_conv").alias("conv"), F.col("source_turn").alias("turn"))
    linked = links.join(names, "source").groupBy("pos", "nr", "level").agg(F.sort_array(F.collect_list(known)).alias("found"))
    best = F.get("found", F.lit(0))
    sources = linked.groupBy("pos").agg(
        F.map_from_entries(F.collect_list(F.struct("nr", "found"))).alias("sources"),
        F.min(F.when((best["away"] == 0) & (F.col("level") == 1), F.struct("nr", best["source"].alias("source"))))["source"].alias("parent"))

    placed = running(rows.select("pos", "conv", "turn"), ["pos"], {"first": ("min", F.col("pos"))}, keys=["conv"])
    placed = placed.join(sources.filter("parent is not null").select("pos", "parent"), "pos", "left")
    # Without an explicit parent the message before is answered; a break is what does not follow on it.
    before = F.when(F.col("pos") > F.col("first"), F.col("pos") - 1)
    placed = placed.withColumn("jump", F.col("parent").isNotNull() & (F.col("parent") != F.coalesce(before, F.lit(-1))))
    placed = placed.withColumn("parent", F.coalesce("parent", before))
    placed = stored(running(placed, ["pos"], {"run": ("max", F.when(F.col("jump") | (F.col("pos") == F.col("first")), F.col("pos")))}, keys=["conv"]))
    eldest = placed.filter("parent is not null").groupBy("parent").agg(F.min("pos").alias("eldest"))
    jumps = placed.filter("jump").join(eldest, "parent").filter("eldest = pos").select("pos", "parent")
    run_of = placed.select(F.col("pos").alias("parent"), "run")
    # A run that continues the branch of an earlier one points to it; pointers are doubled until they rest.
    chain = stored(jumps.join(run_of, "parent").select(F.col("pos").alias("run"), F.col("run").alias("branch")))
    while True:
        further = chain.alias("a").join(chain.alias("b"), F.col("a.branch") == F.col("b.run")).select("a.run", "b.branch")
        further = stored(further)
        if further.isEmpty():
            break
        chain = stored(chain.join(further.withColumnRenamed("branch", "next"), "run", "left").select("run", F.coalesce("next", "branch").alias("branch")))
    ordered = placed.join(chain, "run", "left").withColumn("branch", F.coalesce("branch", "run")).select("pos", "conv", "parent", "branch")
    ordered = running(ordered, ["branch", "pos"], {"position": ("sum", F.lit(1).cast("long"))}, keys=["conv"]).drop("conv")
    turn_of = rows.select("pos", "turn")
    ordered = ordered.join(turn_of.select(F.col("pos").alias("parent"), F.col("turn").alias("reply_to")), "parent", "left")
    ordered = ordered.join(turn_of.select(F.col("pos").alias("branch"), F.col("turn").alias("branch_turn")), "branch", "left")
    result = rows.join(ordered.select("pos", "position", "reply_to", "branch_turn"), "pos").join(sources.select("pos", "sources"), "pos", "left")
    quotes = F.transform("passages", lambda p, i: bind(F.element_at("sources", i), lambda found: F.struct(
        p["level"].alias("level"), p["text"].alias("passage"), F.get(found, F.lit(0))["conv"].alias("source_conversation"),
        F.get(found, F.lit(0))["turn"].alias("source_turn"), F.transform(F.coalesce(found, F.array()), lambda x: F.struct(
            x["way"].alias("part"), x["conv"].alias("conversation"), x["turn"].alias("turn"))).alias("sources"))))
    return result.select(F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), "position", "reply_to",
                         F.col("branch_turn").alias("branch"), "body", F.size("passages").alias("n_quotes"),
                         F.size(F.filter(quotes, lambda q: q["source_turn"].isNotNull())).alias("n_linked"), quotes.alias("quotes"))
