"""Nested match data to typed wide rows, by explicit schemas. A null at any level of a path gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.cohort import first_by

NAMED = "struct<id:bigint,name:string>"
COMPETITION = "competition_id long, competition_name string, country_name string, season_id long, season_name string, competition_gender string, competition_youth boolean, competition_international boolean"
MATCH = (
    "match_id long, match_date string, kick_off string, match_week long, competition struct<competition_id:bigint,competition_name:string>, season struct<season_id:bigint,season_name:string>, "
    "home_team struct<home_team_id:bigint,home_team_name:string>, away_team struct<away_team_id:bigint,away_team_name:string>, home_score long, away_score long, "
    f"stadium {NAMED}, referee {NAMED}, match_status string"
)
EVENT = (
    "id string, index long, period long, timestamp string, minute long, second long, "
    + ", ".join(f"{c} {NAMED}" for c in ("type", "play_pattern", "team", "player", "position"))
    + ", possession long, location array<double>, duration double, under_pressure boolean, "
    f"pass struct<recipient:{NAMED},length:double,angle:double,height:{NAMED},end_location:array<double>,type:{NAMED},outcome:{NAMED},switch:boolean,through_ball:boolean,shot_assist:boolean,goal_assist:boolean,cross:boolean,aerial_won:boolean>, "
    f"shot struct<statsbomb_xg:double,end_location:array<double>,outcome:{NAMED},type:{NAMED},technique:{NAMED},body_part:{NAMED},first_time:boolean,one_on_one:boolean,aerial_won:boolean>, "
    f"carry struct<end_location:array<double>>, dribble struct<outcome:{NAMED},overrun:boolean,nutmeg:boolean>, duel struct<type:{NAMED},outcome:{NAMED}>, "
    f"interception struct<outcome:{NAMED}>, clearance struct<aerial_won:boolean>, miscontrol struct<aerial_won:boolean>"
)
LINEUP = (
    f"team_id long, team_name string, lineup array<struct<player_id:bigint,player_name:string,player_nickname:string,birth_date:string,player_height:double,player_weight:double,jersey_number:bigint,country:{NAMED},"
    "positions:array<struct<position:string,position_id:bigint,start_reason:string>>>>"
)


def at(array: str, i: int) -> Column:
    return F.get(F.col(array), F.lit(i)).cast("double")


def flag(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(False))


def competitions(raw: DataFrame) -> DataFrame:
    """Typed competitions; country '' and gender 'male' where absent."""
    return raw.select(
        "competition_id", "competition_name", F.coalesce("country_name", F.lit("")).alias("country_name"), "season_id", "season_name",
        F.coalesce("competition_gender", F.lit("male")).alias("competition_gender"),
    ).orderBy("competition_name", "season_name")


def matches(raw: DataFrame) -> DataFrame:
    """Flat matches, each once; a date that can't be read is null."""
    flat = raw.select(
        "match_id", F.try_to_timestamp("match_date", F.lit("yyyy-MM-dd")).cast("date").alias("match_date"), "kick_off", "match_week",
        F.col("competition.competition_id"), F.col("competition.competition_name"), F.col("season.season_id"), F.col("season.season_name"),
        F.col("home_team.home_team_id"), F.col("home_team.home_team_name"), F.col("away_team.away_team_id"), F.col("away_team.away_team_name"),
        "home_score", "away_score", F.col("stadium.name").alias("stadium_name"), F.col("referee.name").alias("referee_name"), "match_status",
    )
    return first_by(flat, ["match_id"], [F.col("match_date").asc_nulls_last(), F.col("kick_off").asc_nulls_last()])


#: Columns of one event type: type, then column and value; null for events of other types.
_BY_TYPE: list[tuple[str, str, str]] = [
    ("Pass", "pass_length", "pass.length"), ("Pass", "pass_angle", "pass.angle"), ("Pass", "pass_end_x", "pass.end_location[0]"), ("Pass", "pass_end_y", "pass.end_location[1]"),
    ("Pass", "pass_recipient_id", "pass.recipient.id"), ("Pass", "pass_recipient_name", "pass.recipient.name"), ("Pass", "pass_height", "pass.height.name"),
    ("Pass", "pass_type", "pass.type.name"), ("Pass", "pass_outcome", "pass.outcome.name"), ("Pass", "pass_switch", "?pass.switch"), ("Pass", "pass_through_ball", "?pass.through_ball"),
    ("Pass", "pass_shot_assist", "?pass.shot_assist"), ("Pass", "pass_goal_assist", "?pass.goal_assist"), ("Pass", "pass_cross", "?pass.cross"),
    ("Shot", "shot_statsbomb_xg", "shot.statsbomb_xg"), ("Shot", "shot_end_x", "shot.end_location[0]"), ("Shot", "shot_end_y", "shot.end_location[1]"),
    ("Shot", "shot_end_z", "shot.end_location[2]"), ("Shot", "shot_outcome", "shot.outcome.name"), ("Shot", "shot_type", "shot.type.name"),
    ("Shot", "shot_technique", "shot.technique.name"), ("Shot", "shot_body_part", "shot.body_part.name"), ("Shot", "shot_first_time", "?shot.first_time"),
    ("Shot", "shot_one_on_one", "?shot.one_on_one"), ("Carry", "carry_end_x", "carry.end_location[0]"), ("Carry", "carry_end_y", "carry.end_location[1]"),
    ("Dribble", "dribble_outcome", "dribble.outcome.name"), ("Dribble", "dribble_overrun", "?dribble.overrun"), ("Dribble", "dribble_nutmeg", "?dribble.nutmeg"),
    ("Duel", "duel_type", "duel.type.name"), ("Duel", "duel_outcome", "duel.outcome.name"), ("Interception", "interception_outcome", "interception.outcome.name"),
]


def _value(path: str) -> Column:
    if path.startswith("?"):
        return flag(path[1:])
    if path.endswith("]"):
        name, i = path[:-1].split("[")
        return at(name, int(i))
    return F.col(path)


def events(raw: DataFrame) -> DataFrame:
    """One wide row an event; raw may carry match_id, for instance from the file's name."""
    aerial = flag("pass.aerial_won") | flag("shot.aerial_won") | flag("clearance.aerial_won") | flag("miscontrol.aerial_won")
    keep = [c for c in ("match_id",) if c in raw.columns]
    return raw.select(
        F.col("id").alias("event_id"), *keep, "index", "period", "timestamp", "minute", "second", F.col("type.id").alias("type_id"), F.col("type.name").alias("type_name"),
        F.col("play_pattern.name").alias("play_pattern"), "possession", F.col("team.id").alias("team_id"), F.col("team.name").alias("team_name"),
        F.col("player.id").alias("player_id"), F.col("player.name").alias("player_name"), F.col("position.name").alias("position_name"),
        at("location", 0).alias("location_x"), at("location", 1).alias("location_y"), "duration", flag("under_pressure").alias("under_pressure"), aerial.alias("aerial_won"),
        *[F.when(F.col("type.name") == kind, _value(path)).alias(c) for kind, c, path in _BY_TYPE],
    )


def lineups(raw: DataFrame) -> DataFrame:
    """One row a player, team and match; the starting position is that of the first 'Starting XI' stint."""
    p = raw.select("match_id", "team_id", "team_name", F.explode("lineup").alias("p"))
    start = F.get(F.filter("p.positions", lambda x: x["start_reason"] == "Starting XI"), F.lit(0))
    flat = p.select(
        "match_id", "team_id", "team_name", F.col("p.player_id"), F.col("p.player_name"), F.col("p.player_nickname"), F.col("p.jersey_number"),
        F.try_to_timestamp("p.birth_date", F.lit("yyyy-MM-dd")).cast("date").alias("birth_date"), F.col("p.player_height").alias("height_cm"), F.col("p.player_weight").alias("weight_kg"),
        F.col("p.country.id").alias("country_id"), F.col("p.country.name").alias("country_name"), start["position"].alias("starting_position"), start["position_id"].alias("starting_position_id"),
    )
    return first_by(flat, ["match_id", "player_id", "team_id"], [F.col("jersey_number").asc_nulls_last()])


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
