"""Batch text operators: query normal forms, name resolution, intents, conversation context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import folded_name

#: Rewrites of questions, in order.
REWRITES = [
    (r"'s\b", ""), (r"s'\b", "s"), (r"\s*&\s*", " and "), (r"(?i)\bDM\b", "defensive midfielder"), (r"(?i)\bNo\.?\s*6\b", "defensive midfielder"),
    (r"(?i)\bNo\.?\s*8\b", "box-to-box midfielder"), (r"(?i)\bNo\.?\s*10\b", "attacking midfielder"), (r"(?i)\bCB\b", "center back"),
    (r"(?i)\bRB\b", "right back"), (r"(?i)\bLB\b", "left back"), (r"(?i)\bRW\b", "right winger"), (r"(?i)\bLW\b", "left winger"), (r"(?i)\bST\b", "striker"),
    (r"(?i)\bCF\b", "center forward"), (r"(?i)\bGK\b", "goalkeeper"), (r"(?i)\bCM\b", "central midfielder"), (r"(?i)\bAM\b", "attacking midfielder"),
    (r"(?i)\bvs\b", "compare"), (r"(?i)\bversus\b", "compare"), (r"(?i)\banalyse\b", "analyze"), (r"(?i)\bdefence\b", "defense"),
    (r"(?i)\boffence\b", "offense"), (r"(?i)\bfixture\b", "match"),
]
#: Words that decide a question's intent before and after the workspace does.
INTENTS_FIRST = [(("compare", "vs"), "COMPARE_PLAYERS"), (("recruit", "find similar", "sign", "scout"), "RECRUITMENT"), (("what if", "remove", "add", "without"), "COUNTERFACTUAL")]
WORKSPACES = {"player_intelligence": "PLAYER_ANALYSIS", "team_intelligence": "TEAM_ANALYSIS", "recruitment": "RECRUITMENT"}
INTENTS_LAST = [(("team", "squad", "tactic"), "TEAM_ANALYSIS"), (("player", "profile"), "PLAYER_ANALYSIS")]


#: Patterns of questions of taste.
SUBJECTIVE = [
    r"\bgreatest\b.*\b(?:footballer|player|ever|of all time)\b", r"\bgoat\b", r"\bbest\b.*\b(?:footballer|player|ever|of all time)\b",
    r"\bgreatest\b.*\b(?:team|manager|coach|club)\b",
]
#: Words of questions that name nobody.
STOP_WORDS = [
    "the", "and", "compare", "analyze", "who", "what", "how", "does", "is", "are", "vs", "versus", "which", "better",
    "best", "similar", "like", "replace", "replacement", "for", "at", "in", "of", "to", "a", "an", "fit", "fits",
    "would", "do", "can", "tell", "me", "about", "their", "his", "her", "its", "between", "both", "with", "from",
    "than", "that", "this", "think", "need", "has", "have", "did", "was", "were", "been", "being", "not", "no", "or",
    "but", "if", "so", "up", "out", "down", "way", "more", "most", "some", "any", "all", "each", "every", "very",
    "just", "also", "too", "presses", "pressing", "press", "weaknesses", "strengths", "style", "styles", "system",
    "systems", "formation", "tactics", "players", "player", "team", "squad", "match", "matches", "game", "games",
    "season", "seasons", "league", "competition",
]


def normalized_query(text: Column, rewrites: list[tuple[str, str]] = REWRITES) -> Column:
    """Rewrites in order; words are those of Unicode."""
    for pattern, by in rewrites:
        text = F.regexp_replace(text, "(?U)" + pattern, by)
    return text


def is_subjective(text: Column) -> Column:
    """Whether a question asks for taste; false for null."""
    hits = [text.rlike("(?iU)" + p) for p in SUBJECTIVE]
    return F.coalesce(hits[0] | hits[1] | hits[2] | hits[3], F.lit(False))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def intent(text: Column, workspace: Column | None = None) -> Column:
    low = F.lower(text)
    rules = [(_any(low, w), i) for w, i in INTENTS_FIRST]
    rules += [(workspace == k, i) for k, i in WORKSPACES.items()] if workspace is not None else []
    rules += [(_any(low, w), i) for w, i in INTENTS_LAST]
    out = F.when(*rules[0])
    for c, i in rules[1:]:
        out = out.when(c, i)
    return out.otherwise("GENERAL")


def tokens(text: Column, stop: list[str] = ()) -> Column:
    """Distinct words of the folded text with more than one letter that aren't stop words."""
    words = F.array_distinct(F.split(folded_name(text), " "))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(stop)) if stop else F.length(w) > 1)


def words(text: Column) -> Column:
    """Words of the folded text in order."""
    return F.filter(F.split(folded_name(text), " "), lambda w: w != "")


def single_tokens(texts: DataFrame, query: str, text: str, found: DataFrame, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(query, token): the distinct words of more than one letter that no found name covers, without stop words."""
    placed = texts.select(F.col(query).alias("query"), F.posexplode(words(F.col(text))).alias("p", "token")).where((F.length("token") > 1) & ~F.col("token").isin(stop))
    covered = found.select("query", F.explode(F.sequence(F.col("pos") - 1, F.col("pos") + F.col("n") - 2)).alias("p"))
    return placed.join(covered, ["query", "p"], "left_anti").select("query", "token").distinct()


def name_classes(entities: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, size): entities of the same folded names are one, with the least of their keys and their number, so
    that a name which many bear costs no more than another."""
    named = entities.select(F.col(key).alias("key"), folded_name(F.col(name)).alias("name")).distinct()
    sets = named.groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("names"))  # of one entity
    return sets.groupBy("names").agg(F.min("key").alias("key"), F.count("*").alias("size")).select("key", F.explode("names").alias("name"), "size")


def name_index(entities: DataFrame, key: str, name: str, least_prefix: int = 4, size: str | None = None) -> DataFrame:
    """(token, key, kind): whole folded names, their words, and prefixes of words from least_prefix letters on; with
    `size` (name_classes), that column too."""
    more = [] if size is None else [F.col(size).alias("size")]
    kept = ["key", *(["size"] if more else [])]
    base = entities.select(F.col(key).alias("key"), folded_name(F.col(name)).alias("n"), *more).distinct()
    words = base.select(*kept, F.explode(F.split("n", " ")).alias("w"))
    prefixes = F.transform(F.sequence(F.lit(least_prefix), F.greatest(F.length("w"), F.lit(least_prefix))), lambda i: F.substring(F.col("w"), F.lit(1), i))
    full = base.select(F.col("n").alias("token"), *kept, F.lit(1).alias("kind"))
    whole = words.select(F.col("w").alias("token"), *kept, F.lit(2).alias("kind"))
    part = words.where(F.length("w") > least_prefix).select(F.explode(prefixes).alias("token"), *kept, F.lit(3).alias("kind"))
    return full.unionByName(whole).unionByName(part).distinct()


def _size(index: DataFrame):
    return F.col("size") if "size" in index.columns else F.lit(1)


def token_sizes(index: DataFrame) -> DataFrame:
    """(token, size): the entities that a token stands for, by whatever kind."""
    return index.select("token", "key", _size(index).alias("size")).distinct().groupBy("token").agg(F.sum("size").alias("size"))


def meanings(index: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(token, n_candidates, k): a row a token: how many entities it stands for by the first kind that it matches (alias,
    whole name, word or prefix), and the least of them."""
    table = index.select("token", "key", "kind", _size(index).alias("size"))
    table = table if aliases is None else table.unionByName(aliases.select("token", "key", F.lit(0).alias("kind"), F.lit(1).cast(table.schema["size"].dataType).alias("size")))
    level = F.when(F.col("kind") == 3, 2).otherwise(F.col("kind")).alias("level")
    once = table.select("token", "key", "size", level).distinct()
    levels = once.groupBy("token", "level").agg(F.sum("size").alias("n_candidates"), F.min("key").alias("k"))
    first = levels.groupBy("token").agg(F.min(F.struct("level", "n_candidates", "k")).alias("x"))
    return first.select("token", "x.n_candidates", "x.k")


def resolved(mentions: DataFrame, index: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query, token, key, n_candidates): the entity of each token, by alias, then whole name, then word or
    prefix; null if the first kind that matches has several. What a token means is found once, before it meets its
    mentions, so that a word of many names isn't paired with all of them in each text. The index is never broadcast:
    Spark takes it for as small as the names' file."""
    j = mentions.select("query", "token").distinct().join(meanings(index, aliases).hint("merge"), "token")
    return j.select("query", "token", F.when(F.col("n_candidates") == 1, F.col("k")).alias("key"), "n_candidates")


def carried_context(turns: DataFrame, conversation: str, turn: str, value: str, out: str) -> DataFrame:
    """Each turn with the last value that it or an earlier turn of its conversation gave."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn(out, F.last(value, ignorenulls=True).over(w))


def changed(value: str, conversation: str, turn: str) -> Column:
    """Whether the value differs from the turn before; false on the first turn."""
    before = F.lag(value).over(Window.partitionBy(conversation).orderBy(turn))
    return F.coalesce(before != F.col(value), F.lit(False))


def search_score(name: Column, query: str, minutes: Column) -> Column:
    """Exact 1000, prefix 500, all words 200 and 10 a word, substring 100, some words 10 a word; and up to 50 by minutes."""
    low, q = F.lower(name), query.lower()
    words = q.split()
    hits = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    text = F.when(low == q, 1000).when(F.startswith(low, F.lit(q)), 500).when(hits == len(words), 200 + 10 * hits).when(F.contains(low, F.lit(q)), 100).otherwise(10 * hits)
    return F.when(text > 0, text + F.least(minutes / 10000.0, F.lit(50.0))).otherwise(0.0)


def routed(kind: Column, players: Column, teams: Column) -> Column:
    """Intent and entity roles (Q11) from the intent's kind and the arrays of players and teams found, in order:
    a struct of intent, focus_player, compare_player, team, team_compare."""
    p, t = F.size(players), F.size(teams)
    one = lambda xs, i: F.get(xs, F.lit(i))
    pair, clubs = (kind == "COMPARE_PLAYERS") & (p >= 2), (kind == "COMPARE_PLAYERS") & (p < 2) & (t >= 2)
    single = kind.isin("PLAYER_ANALYSIS", "COUNTERFACTUAL") & (p >= 1)
    scenario = (kind == "COUNTERFACTUAL") & (p >= 1) & (t >= 1)
    hire, squad = (kind == "RECRUITMENT") & (p >= 1), (kind == "RECRUITMENT") & (p == 0) & (t >= 1)
    club = (kind == "TEAM_ANALYSIS") & (t >= 1)
    rest = ~(pair | clubs | single | hire | squad | club)  # nothing fits: whatever was found
    focus = F.when(pair | single | hire | (rest & (p >= 1)), one(players, 0))
    team = F.when(clubs | scenario | squad | club | (rest & (p == 0) & (t >= 1)), one(teams, 0))
    routed_kind = F.when(clubs | scenario | squad, "TEAM_ANALYSIS").when((kind == "GENERAL") & team.isNotNull(), "TEAM_ANALYSIS").when((kind == "GENERAL") & focus.isNotNull(), "PLAYER_ANALYSIS").otherwise(kind)
    return F.struct(
        routed_kind.alias("intent"), focus.alias("focus_player"), F.when(pair, one(players, 1)).alias("compare_player"), team.alias("team"), F.when(clubs, one(teams, 1)).alias("team_compare"),
    )
