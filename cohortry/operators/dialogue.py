"""Questions in conversations: names by a trie, entities with roles, and what follow-ups refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.operators import text as X
from cohortry.sources.tables import few, stored, written

#: Words of questions about the pair compared before, ways to compare the one before with another, and
#: words of questions about the one before.
PAIR_WORDS = ["better", "worse", "pressure", "progress", "defend", "attack", "pass", "shoot", "under pressure", "how about", "what about", "compare them", "between them"]
SWAPS = ["compare him with", "compare her with", "compare them with", "compare him to", "compare her to", "compare them to"]
FOCUS_WORDS = ["his", "her", "their", "him", "strengths", "weaknesses", "archetype", "capabilities", "under pressure", "ball progression", "defensive", "passing", "pressing"]


def name_trie(names: DataFrame) -> DataFrame:
    """(parent, word, node, whole): the prefixes of names(token) by words; whole marks those that are names."""
    w = names.select("token").distinct().select(F.split("token", " ").alias("w"))
    upto = lambda i: F.array_join(F.slice("w", F.lit(1), i), " ")
    steps = w.select("w", F.posexplode("w").alias("i", "word")).select(upto(F.col("i")).alias("parent"), "word", upto(F.col("i") + 1).alias("node"), (F.size("w") == F.col("i") + 1).alias("whole"))
    return steps.groupBy("parent", "word", "node").agg(F.max("whole").alias("whole"))


def found_names(texts: DataFrame, query: str, text: str, names: DataFrame) -> DataFrame:
    """(query, pos, n, token): the names(token) of several words that stand in a text, word by word, however many words
    they have; a name within a longer one that was found is left out.

    Each word that begins a name is a start; starts move along the trie a word at a time by equi-joins, and those that
    leave it are gone. A start carries as many words as the longest name has. Spark takes the trie for as small as the
    names' file, so it is counted before it may be broadcast.
    """
    several = names.where(F.contains("token", F.lit(" ")))
    trie = written(name_trie(several))
    longest = several.agg(F.coalesce(F.max(F.size(F.split("token", " "))), F.lit(0))).first()[0]
    placed = texts.select(F.col(query).alias("query"), X.words(F.col(text)).alias("w")).select("query", "w", F.posexplode("w").alias("p", "word"))
    starts = placed.select("query", (F.col("p") + 1).alias("pos"), "word", F.slice("w", F.col("p") + 2, max(longest - 1, 1)).alias("rest"))
    roots = trie.where("parent = ''").select("word", "node", "whole")
    live, found = starts.join(few(roots), "word").select("query", "pos", "rest", "node", "whole"), None
    for n in range(2, longest + 1):
        steps = few(trie.where(F.size(F.split("node", " ")) == n))
        live = written(live.withColumn("word", F.get("rest", F.lit(n - 2))).withColumnRenamed("node", "parent").drop("whole").join(steps, ["parent", "word"]).drop("parent", "word"))
        here = live.where("whole").select("query", "pos", F.lit(n).alias("n"), F.col("node").alias("token"))
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = starts.where("false").select("query", "pos", F.lit(0).alias("n"), F.col("word").alias("token"))
    longer = found.groupBy("query").agg(F.collect_set(F.struct("pos", "n")).alias("all"))  # of one text's own names
    inside = F.exists("all", lambda o: (o["n"] > F.col("n")) & (o["pos"] <= F.col("pos")) & (o["pos"] + o["n"] >= F.col("pos") + F.col("n")))
    return found.join(longer.hint("merge"), "query").where(~inside).select("query", "pos", "n", "token")


def whole_names(texts: DataFrame, query: str, text: str, names: DataFrame) -> DataFrame:
    """(query, pos, n, token, key): found_names with the keys of each, from names(token, key)."""
    return found_names(texts, query, text, names).join(names.hint("merge"), "token").select("query", "pos", "n", "token", "key")


def question_tokens(texts: DataFrame, query: str, text: str, names: DataFrame, stop: list[str] = X.STOP_WORDS) -> DataFrame:
    """(query, place, token) of each question: names of several words, the longest first, then the words that no
    name covers, without stop words. place is their order."""
    found = written(found_names(texts, query, text, names).distinct())
    words = texts.select(F.col(query).alias("query"), F.posexplode(X.words(F.col(text))).alias("p", "token"))
    covered = found.select("query", F.explode(F.sequence(F.col("pos") - 1, F.col("pos") + F.col("n") - 2)).alias("p"))
    single = words.where((F.length("token") > 1) & ~F.col("token").isin(stop)).join(covered, ["query", "p"], "left_anti")
    place = lambda kind, size, at: F.struct(F.lit(kind).alias("kind"), size.alias("size"), at.alias("at"))
    both = found.select("query", "token", place(0, -F.length("token"), F.col("pos")).alias("place")).unionByName(single.select("query", "token", place(1, F.lit(0), F.col("p") + 1).alias("place")))
    return both.groupBy("query", "token").agg(F.min("place").alias("place"))


def resolve_both(tokens: DataFrame, players: DataFrame, teams: DataFrame, player_aliases: DataFrame | None = None, team_aliases: DataFrame | None = None) -> DataFrame:
    """(query, players, teams): the keys that tokens(query, place, token) stand for, each once, in order. A token is a
    team if it can be, unless that team was named before; else it may be a player. players and teams are name
    indexes (operators.text.name_index); aliases (token, key) come before them."""
    as_ = lambda index, aliases, name: X.resolved(tokens, index, aliases).select("query", "token", F.col("key").alias(name))
    j = tokens.join(as_(teams, team_aliases, "team"), ["query", "token"], "left").join(as_(players, player_aliases, "player"), ["query", "token"], "left")
    again = F.row_number().over(Window.partitionBy("query", "team").orderBy("place")) > 1  # tokens of one question
    j = j.withColumn("player", F.when(F.col("team").isNull() | again, F.col("player"))).withColumn("team", F.when(~again, F.col("team")))
    first = lambda c: j.where(F.col(c).isNotNull()).groupBy("query", F.col(c).alias("key")).agg(F.min("place").alias("place"))
    listed = lambda c: first(c).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("x")).select("query", F.col("x.key").alias(c + "s"))
    return listed("player").join(listed("team"), "query", "full").select("query", *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("players", "teams")])


def carried(df: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """df with the last non-null of each value among the rows of its key that come before.

    A key's rows are spread by ranges of the order; each range carries its own values on, and gets those of the
    ranges before it from a table of a row a key and range. So no task holds the rows of a long key. Null
    keys are a key.
    """
    own = {f"__c{i}": c for i, c in enumerate(values.values())}
    ranges = df.withColumns(own).repartitionByRange(key, order).withColumn("__range", F.spark_partition_id())
    placed = stored(ranges)
    here = Window.partitionBy(key, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(F.col(key).alias("__key"), F.col("__range").alias("__of")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"{c}_end") for c in own])
    earlier = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("__key", "__of", *[F.last(f"{c}_end", ignorenulls=True).over(earlier).alias(f"{c}_start") for c in own])
    inner = placed.withColumns({f"{c}_here": F.last(c, ignorenulls=True).over(here) for c in own})
    joined = inner.join(starts, (F.col("__range") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")))
    return joined.select(*df.columns, *[F.coalesce(f"{c}_here", f"{c}_start").alias(name) for c, name in zip(own, values, strict=True)])


def followed_up(turns: DataFrame, conversation: str, turn: str) -> DataFrame:
    """turns(conversation, turn, text, players, teams, intent, focus_player, compare_player, team) with what follow-ups
    refer to: intent, focus_player and compare_player filled in, reused ("pair", "swap", "focus" or null), and
    whether the player or team in focus differs from that before the turn.

    A question without names that asks about a comparison, right after one or after other such questions, is about
    the last pair; "compare him with X" puts X in the pair's second place; other questions with "his" and the
    like are about the last player in focus. The state is carried by ranges, not held for a conversation.
    Turns should be unique; a null text refers to nothing.
    """
    low = F.coalesce(F.lower("text"), F.lit(""))
    said = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    named = F.size("players") + F.size("teams") > 0
    compares, own_pair = F.col("intent") == "COMPARE_PLAYERS", F.col("compare_player").isNotNull()
    asks_pair = ~named & said(PAIR_WORDS)
    before = carried(turns, conversation, turn, {
        "__compared": F.when(~asks_pair | compares, compares), "__first": F.when(own_pair, F.col("focus_player")),
    })
    open_ = F.coalesce(F.col("__compared"), F.lit(False)) & F.col("__first").isNotNull()
    swap = said(SWAPS) & (F.size("players") == 1) & ~own_pair & open_
    kind = F.when(asks_pair & open_, "pair").when(swap, "swap")
    one = F.get("players", F.lit(0))
    before = before.withColumn("__kind", kind)
    before = carried(before, conversation, turn, {
        "__second": F.when(own_pair, F.col("compare_player")).when(F.col("__kind") == "swap", one),
        "__focus": F.when(F.col("__kind").isNotNull(), F.col("__first")).otherwise(F.col("focus_player")),
        "__team": F.col("team"),
    })
    same = F.col("__kind").isNull() & ~named & said(FOCUS_WORDS) & F.col("__focus").isNotNull()
    reused = F.coalesce("__kind", F.when(same, "focus"))
    focus = F.when(F.col("__kind").isNotNull(), F.col("__first")).when(same, F.col("__focus")).otherwise(F.col("focus_player"))
    other = F.when(F.col("__kind") == "pair", F.col("__second")).when(F.col("__kind") == "swap", one).otherwise(F.col("compare_player"))
    intent = F.when(F.col("__kind").isNotNull(), "COMPARE_PLAYERS").when(same & (F.col("intent") == "GENERAL"), "PLAYER_ANALYSIS").otherwise(F.col("intent"))
    out = before.withColumns({"__f": focus, "__o": other, "__i": intent, "reused": reused})
    moved = lambda now, was: F.coalesce(F.col(now) != F.col(was), F.col(now).isNotNull())
    out = out.withColumns({"player_changed": moved("__f", "__focus"), "team_changed": moved("team", "__team")})
    out = out.withColumns({"focus_player": F.col("__f"), "compare_player": F.col("__o"), "intent": F.col("__i")})
    return out.drop("__compared", "__first", "__kind", "__second", "__focus", "__team", "__f", "__o", "__i")
