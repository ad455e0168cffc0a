"""Short names of players and teams as lookup tables (Q4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.scalar import folded_name

# Alias to the display name it stands for.
PLAYERS = {
    "kdb": "Kevin De Bruyne", "de bruyne": "Kevin De Bruyne", "rodri": "Rodrigo Hernández Cascante", "rodrigo hernandez": "Rodrigo Hernández Cascante",
    "haaland": "Erling Haaland", "pedri": "Pedro González López", "gavi": "Pablo Martín Páez Gavira", "odegaard": "Martin Ødegaard", "odegard": "Martin Ødegaard",
    "saka": "Bukayo Saka", "bukayo": "Bukayo Saka", "salah": "Mohamed Salah", "mo salah": "Mohamed Salah", "vvd": "Virgil van Dijk", "virgil": "Virgil van Dijk",
    "trent": "Trent Alexander-Arnold", "alexander-arnold": "Trent Alexander-Arnold", "bellingham": "Jude Bellingham", "jude": "Jude Bellingham",
    "vinicius": "Vinícius José Paixão de Oliveira Júnior", "vini": "Vinícius José Paixão de Oliveira Júnior", "vardy": "Jamie Vardy", "maguire": "Harry Maguire",
    "grealish": "Jack Grealish", "foden": "Phil Foden", "phil foden": "Phil Foden", "kane": "Harry Kane", "harry kane": "Harry Kane", "son": "Son Heung-min",
    "heung-min": "Son Heung-min", "kimmich": "Joshua Kimmich", "musiala": "Jamal Musiala", "jamal": "Jamal Musiala", "wirtz": "Florian Wirtz", "florian": "Florian Wirtz",
    "samba": "Brice Samba", "kylian": "Kylian Mbappé Lottin", "mbappe": "Kylian Mbappé Lottin", "mbappé": "Kylian Mbappé Lottin", "neymar": "Neymar da Silva Santos Junior",
    "iniesta": "Andrés Iniesta Luján", "xavi": "Xavier Hernández Creus", "puyol": "Carles Puyol i Saforcada", "busquets": "Sergio Busquets i Burgos",
    "courtois": "Thibaut Courtois", "modric": "Luka Modrić", "ramos": "Sergio Ramos", "alba": "Jordi Alba Ramos", "jordi alba": "Jordi Alba Ramos",
    "messi": "Lionel Andrés Messi Cuccittini", "lionel messi": "Lionel Andrés Messi Cuccittini", "cristiano ronaldo": "Cristiano Ronaldo dos Santos Aveiro",
    "cristiano": "Cristiano Ronaldo dos Santos Aveiro", "cr7": "Cristiano Ronaldo dos Santos Aveiro",
}
TEAMS = {
    "man city": "Manchester City", "manchester city": "Manchester City", "mancity": "Manchester City", "man united": "Manchester United", "manchester united": "Manchester United",
    "manutd": "Manchester United", "utd": "Manchester United", "liverpool": "Liverpool", "lfc": "Liverpool", "arsenal": "Arsenal", "afc": "Arsenal", "chelsea": "Chelsea",
    "cfc": "Chelsea", "tottenham": "Tottenham Hotspur", "spurs": "Tottenham Hotspur", "tot": "Tottenham Hotspur", "tottenham hotspur": "Tottenham Hotspur",
    "newcastle": "Newcastle United", "nufc": "Newcastle United", "newcastle united": "Newcastle United", "everton": "Everton", "efc": "Everton", "aston villa": "Aston Villa",
    "avfc": "Aston Villa", "west ham": "West Ham United", "whu": "West Ham United", "west ham united": "West Ham United", "leicester": "Leicester City", "lcfc": "Leicester City",
    "leicester city": "Leicester City", "brighton": "Brighton & Hove Albion", "bhafc": "Brighton & Hove Albion", "brighton and hove albion": "Brighton & Hove Albion",
    "brighton hove albion": "Brighton & Hove Albion", "wolves": "Wolverhampton Wanderers", "wwfc": "Wolverhampton Wanderers", "barca": "Barcelona", "fc barcelona": "Barcelona",
    "barcelona": "Barcelona", "real madrid": "Real Madrid", "madrid": "Real Madrid", "rmcf": "Real Madrid", "atletico": "Atlético Madrid", "atleti": "Atlético Madrid",
    "atletico madrid": "Atlético Madrid", "atlético madrid": "Atlético Madrid", "bayern": "Bayern Munich", "fc bayern": "Bayern Munich", "bayern munich": "Bayern Munich",
    "fc bayern munich": "Bayern Munich", "bvb": "Borussia Dortmund", "dortmund": "Borussia Dortmund", "borussia dortmund": "Borussia Dortmund", "psg": "Paris Saint-Germain",
    "paris": "Paris Saint-Germain", "paris saint germain": "Paris Saint-Germain", "paris saint-germain": "Paris Saint-Germain", "juventus": "Juventus", "juve": "Juventus",
    "inter": "Inter Milan", "inter milan": "Inter Milan", "ac milan": "AC Milan", "milan": "AC Milan", "napoli": "Napoli", "ssc napoli": "Napoli", "roma": "AS Roma",
    "as roma": "AS Roma", "ajax": "Ajax", "afc ajax": "Ajax", "benfica": "Benfica", "sl benfica": "Benfica", "porto": "FC Porto", "fc porto": "FC Porto",
    "sporting": "Sporting CP", "sporting cp": "Sporting CP",
}


def alias_table(spark: SparkSession, aliases: dict[str, str], entities: DataFrame, key: str, name: str) -> DataFrame:
    """(token, key): the entities that the aliases' names stand for, by folded name."""
    table = spark.createDataFrame(list(aliases.items()), "alias string, full string")
    named = entities.select(F.col(key).alias("key"), folded_name(F.col(name)).alias("__n"))
    return named.join(F.broadcast(table), F.col("__n") == folded_name(F.col("full"))).select(folded_name(F.col("alias")).alias("token"), "key").distinct()
