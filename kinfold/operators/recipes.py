"""Label tables and history features that the example tasks are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LAST5 = (-5, -1)


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def churn(entities: DataFrame, key: str, facts: DataFrame, fact_key: str, time: str, days: int = 7) -> DataFrame:
    """(key, last, will_churn): 1 if an entity did nothing in the last `days` of the facts, or never anything."""
    end = facts.agg((F.max(time) - F.expr(f"INTERVAL {days} DAYS")).alias("cutoff"))
    last = facts.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias(key)).agg(F.max(time).alias("last"))
    joined = entities.select(key).join(last, key, "left").crossJoin(F.broadcast(end))
    return joined.select(key, "last", flag(F.col("last").isNull() | (F.col("last") < F.col("cutoff"))).alias("will_churn"))


def pair_candidates(facts: DataFrame, a: str, b: str, time: str, days: int) -> DataFrame:
    """(a, b, label): pairs seen before the last `days`, and whether they are seen again within them. One shuffle on the pair."""
    rows = facts.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(time).isNotNull())
    end = rows.agg((F.max(time) - F.expr(f"INTERVAL {days} DAYS")).alias("cutoff"))
    seen = rows.crossJoin(F.broadcast(end)).groupBy(a, b).agg(F.max(F.col(time) < F.col("cutoff")).alias("before"), F.max(F.col(time) >= F.col("cutoff")).alias("after"))
    return seen.where("before").select(a, b, flag(F.col("after")).alias("label"))


def outcome(home: Column, away: Column) -> Column:
    """0 home win, 1 draw, 2 away win; null without both scores."""
    return F.when(home.isNull() | away.isNull(), None).when(home > away, 0.0).when(home == away, 1.0).otherwise(2.0)


def numeric_label(c: Column) -> Column:
    """A number kept as text; anything else is no label."""
    return c.cast("string").try_cast("double")


def sides(games: DataFrame, home: str = "home", away: str = "away") -> DataFrame:
    """Each game once for either team: (game, day, team, other, is_home, gf, ga)."""
    side = lambda t, o, h, f, a: games.select("game", "day", "season", F.col(t).alias("team"), F.col(o).alias("other"), F.lit(h).alias("is_home"), F.col(f).cast("double").alias("gf"), F.col(a).cast("double").alias("ga"))
    return side(home, away, True, "home_goals", "away_goals").unionByName(side(away, home, False, "away_goals", "home_goals"))


def _past(*keys: str):
    return Window.partitionBy(*keys).orderBy("day", "game")


def _played(rows: DataFrame, *keys: str) -> tuple[DataFrame, Window]:
    """rows with the number of finished games before each, and a window over the last five of them.

    Games without a score count for nothing in it, and get features like any other.
    """
    before = _past(*keys).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("_played", F.count("gf").over(before))
    return counted, Window.partitionBy(*keys).orderBy("_played").rangeBetween(*_LAST5)


def rolling_form(games: DataFrame) -> DataFrame:
    """(game, team, is_home, wins, draws, losses, goals_scored, goals_conceded, clean_sheets, home_wins, away_wins, days_rest).

    Over the team's last five finished games of either venue before this one: shares of five, goals of 25, whatever their number;
    days_rest is of 14 at most over 14, and 14 without a game before. Rows in one window belong to one team, whose games are few.
    """
    rows, w = _played(sides(games), "team")
    s = lambda c, n: F.coalesce(F.sum(F.when(F.col("gf").isNotNull(), c)).over(w), F.lit(0.0)) / n
    gf, ga, at_home = F.col("gf"), F.col("ga"), F.col("is_home")
    last = F.max(F.when(gf.isNotNull(), F.col("day"))).over(_past("team").rowsBetween(Window.unboundedPreceding, -1))
    rest = F.datediff("day", last)
    return rows.select(
        "game", "team", "is_home",
        s(flag(gf > ga), 5.0).alias("wins"), s(flag(gf == ga), 5.0).alias("draws"), s(flag(gf < ga), 5.0).alias("losses"), s(gf, 25.0).alias("goals_scored"), s(ga, 25.0).alias("goals_conceded"),
        s(flag(ga == 0), 5.0).alias("clean_sheets"), s(flag((gf > ga) & at_home), 5.0).alias("home_wins"), s(flag((gf > ga) & ~at_home), 5.0).alias("away_wins"),
        F.when(rest.isNull(), 14.0).otherwise(F.least(rest, F.lit(14)) / 14.0).alias("days_rest"),
    )


def form_features(games: DataFrame) -> DataFrame:
    """games with the form of both teams: home_* and away_*; home_home_wins and away_away_wins are by venue."""
    form = rolling_form(games)
    common = ["wins", "draws", "losses", "goals_scored", "goals_conceded", "clean_sheets", "days_rest"]
    side = lambda h, p, venue: form.where(F.col("is_home") == h).select("game", *(F.col(c).alias(f"{p}_{c}") for c in [*common, venue]))
    return games.join(side(True, "home", "home_wins"), "game").join(side(False, "away", "away_wins"), "game")


def head_to_head(games: DataFrame, ordered: bool = True) -> DataFrame:
    """(game, h2h_home_wins, h2h_draws, h2h_away_wins): shares of five over the pair's last five games; ordered: with the same home team."""
    pair = ["home", "away"] if ordered else ["_a", "_b"]
    rows = games.withColumn("_a", F.least("home", "away")).withColumn("_b", F.greatest("home", "away")).withColumn("gf", F.col("home_goals") + 0 * F.col("away_goals"))
    rows, w = _played(rows, *pair)
    s = lambda c: F.coalesce(F.sum(flag(c)).over(w), F.lit(0.0)) / 5.0
    h, a = F.col("home_goals"), F.col("away_goals")
    return rows.select("game", s(h > a).alias("h2h_home_wins"), s(h == a).alias("h2h_draws"), s(h < a).alias("h2h_away_wins"))


def season_table(games: DataFrame) -> DataFrame:
    """(game, team, is_home, points, gd, ppg) of the season so far: points of 99, goal difference within 50 either way, points a game of 3."""
    w = _past("team", "season").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    gf, ga = F.col("gf"), F.col("ga")
    points = total(F.when(gf > ga, 3.0).when(gf == ga, 1.0).otherwise(0.0))
    played = F.count(gf).over(w)
    gd = F.least(F.greatest(total(gf - ga) / 50.0, F.lit(-1.0)), F.lit(1.0)) * 0.5 + 0.5
    ppg = F.when(played > 0, F.least(points / (3.0 * played), F.lit(1.0))).otherwise(0.0)
    return sides(games).select("game", "team", "is_home", points.alias("_p"), (points / 99.0).alias("points"), gd.alias("gd"), ppg.alias("ppg"))


def season_features(games: DataFrame) -> DataFrame:
    """(game, home_*, away_*, points_diff)."""
    table = season_table(games)
    side = lambda h, p: table.where(F.col("is_home") == h).select("game", F.col("_p").alias(f"_{p}"), *(F.col(c).alias(f"{p}_season_{c}") for c in ("points", "gd", "ppg")))
    both = side(True, "home").join(side(False, "away"), "game")
    return both.withColumn("points_diff", (F.col("_home") - F.col("_away") + 99.0) / 198.0).drop("_home", "_away")


def fixture_features(games: DataFrame, ordered: bool = True) -> DataFrame:
    """games with form, season table and head-to-head of both teams, and home-away differences (diff_*) of what both have."""
    out = form_features(games).join(season_features(games), "game").join(head_to_head(games, ordered), "game")
    both = [c.removeprefix("home_") for c in out.columns if c.startswith("home_") and c.replace("home_", "away_", 1) in out.columns and c not in games.columns]
    return out.withColumns({f"diff_{c}": F.col(f"home_{c}") - F.col(f"away_{c}") for c in both})


def squad_means(players: DataFrame, team: str, season: str, columns: list[str]) -> DataFrame:
    """(team, season, <column>...): means over a squad, nulls left out."""
    return players.groupBy(team, season).agg(*(F.avg(c).alias(c) for c in columns))


def future_or_latest(games: DataFrame, home, away) -> DataFrame:
    """A named pairing's next game without a score, or else its latest one."""
    rows = games.where((F.col("home") == home) & (F.col("away") == away))
    return rows.orderBy(F.col("home_goals").isNotNull(), F.when(F.col("home_goals").isNull(), F.col("day")), F.desc("day"), F.desc("game")).limit(1)


def before_date(rows: DataFrame, time: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(rows before the date, the others), by a range on the raw column, which reaches the scan."""
    at = F.lit(cutoff).cast("timestamp")
    return rows.where(F.col(time) < at), rows.where(F.col(time) >= at)


def rolling_stats(rows: DataFrame, team: str, order: list[str], caps: dict[str, float]) -> DataFrame:
    """rows with roll_<stat>: the mean over the team's up to five rows before, over the cap, 1 at most; 0 without any."""
    w = Window.partitionBy(team).orderBy(*order).rowsBetween(*_LAST5)
    roll = {f"roll_{c}": F.least(F.coalesce(F.avg(F.col(c)).over(w), F.lit(0.0)) / cap, F.lit(1.0)) for c, cap in caps.items()}
    return rows.withColumns(roll)


# The statistics of a team's games and of its players in them, and what counts as most of each.
GAME_CAPS = {"shots_on": 15.0, "shots_tot": 25.0, "possession": 1.0, "corners": 15.0, "fouls": 20.0, "yellows": 4.0, "saves": 12.0, "pass_acc": 1.0}
PLAYER_CAPS = {"rating": 10.0, "goals_pp": 0.3, "assists_pp": 0.2, "tackles_pp": 3.0, "dribbles_pp": 1.0}
#: In per cent in the source.
PER_CENT = ("possession", "pass_acc")


def blank_means(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, columns): means in which blanks, and what is no number, count as 0."""
    return rows.groupBy(*keys).agg(*(F.avg(F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))).alias(c) for c in columns))


def rolling_features(games: DataFrame, cutoff: str, game_stats: DataFrame | None = None, player_stats: DataFrame | None = None) -> DataFrame:
    """games with h_roll_* and a_roll_* of the home and the away team: means over a team's up to five games before, over the cap, 1 at most.

    game_stats: (game, team, the names of GAME_CAPS); player_stats: (game, team, those of PLAYER_CAPS), a row for each player. A game without a row
    in them counts as zeros; without any of both tables the games come back as they are. Games from the cutoff date on are in no team's history and have
    zeros themselves, as have teams without a game before.
    """
    if game_stats is None and player_stats is None:
        return games
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) / (100.0 if c in PER_CENT else 1.0)
    caps = GAME_CAPS | PLAYER_CAPS
    side = lambda t, h: games.select("game", "day", F.col(t).alias("team"), F.lit(h).alias("is_home"))
    rows = side("home", True).unionByName(side("away", False)).where("team is not null")
    if game_stats is not None:
        rows = rows.join(game_stats.select("game", "team", *(number(c).alias(c) for c in GAME_CAPS)).dropDuplicates(["game", "team"]), ["game", "team"], "left")
    if player_stats is not None:
        rows = rows.join(blank_means(player_stats, ["game", "team"], list(PLAYER_CAPS)), ["game", "team"], "left")
    rows = rows.select("game", "day", "team", "is_home", *((F.coalesce(c, F.lit(0.0)) if c in rows.columns else F.lit(0.0)).alias(c) for c in caps))
    known = F.coalesce(F.col("day") < F.lit(cutoff).cast("date"), F.lit(True))
    rolled = rolling_stats(rows.where(known), "team", ["day", "game"], caps)
    out = games
    for home, prefix in ((True, "h"), (False, "a")):
        own = rolled.where(F.col("is_home") == home).select("game", *(F.col(f"roll_{c}").alias(f"{prefix}_roll_{c}") for c in caps))
        out = out.join(own, "game", "left")
    return out.fillna(0.0, [f"{p}_roll_{c}" for p in "ha" for c in caps])


def venue_features(games: DataFrame, teams: DataFrame, team: str = "team", capacity: str = "venue_capacity") -> DataFrame:
    """games with venue, the home team's ground's capacity over 90,000: 40,000 where that isn't known, and 0.5 for teams that aren't there."""
    own = teams.dropDuplicates([team]).select(F.col(team).alias("home"), (F.coalesce(F.col(capacity).cast("double"), F.lit(40000.0)) / 90000.0).alias("venue"))
    return games.join(own, "home", "left").fillna(0.5, ["venue"])


def with_defaults(rows: DataFrame, other: DataFrame, on: list[str], columns: list[str], default: object = 0.0) -> DataFrame:
    """Left join; rows without a match get the default. `on` must be unique in `other` (use last_of)."""
    return rows.join(other.select(*on, *columns), on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})


def last_of(rows: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in the order."""
    values = [c for c in rows.columns if c not in on]
    return rows.groupBy(*on).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*on, *(F.col(f"_v.{c}").alias(c) for c in values))


def top_k(rows: DataFrame, group: str, score: str, tie: str, k: int = 5, groups: int | None = None) -> DataFrame:
    """rows with rank, of which the first k of each group stay; the limit reaches the sort as a group limit. groups: only of so many, the smallest."""
    if groups is not None:
        rows = rows.join(F.broadcast(rows.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).limit(groups)), group)
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_means(rows: DataFrame, group: str, value: str, k: int = 10) -> DataFrame:
    return rows.groupBy(group).agg(F.avg(value).alias("mean_value")).orderBy(F.desc("mean_value"), group).limit(k)


def latest_period(rows: DataFrame, year: str, week: str, label: str) -> DataFrame:
    """Rows of the last (year, week) that has labels."""
    known = rows.where(F.col(label).isNotNull())
    last = known.agg(F.max(F.struct(year, week)).alias("_l"))
    return known.join(F.broadcast(last), F.struct(year, week) == F.col("_l")).drop("_l")


def pair_lookup(asked: DataFrame, rows: DataFrame, a: str, b: str, order: list[str], value: str) -> DataFrame:
    """asked with value: that of the pair's latest row, or else of a's latest; null if a has none."""
    latest = F.max_by(value, F.struct(*order))
    pairs = rows.groupBy(a, b).agg(latest.alias("_pair"))
    alone = rows.groupBy(a).agg(latest.alias("_alone"))
    out = asked.join(pairs, [a, b], "left").join(alone, a, "left")
    source = F.when(F.col("_pair").isNotNull(), "pair").when(F.col("_alone").isNotNull(), "first").otherwise("none")
    return out.withColumn(value, F.coalesce("_pair", "_alone")).withColumn("source", source).drop("_pair", "_alone")


def slot_order(day: Column, days: tuple[str, ...] = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")) -> Column:
    out = F.lit(len(days))
    for i, d in reversed(list(enumerate(days))):
        out = F.when(day == d, i).otherwise(out)
    return out


def fuzzy_match(names: DataFrame, column: str, text: str) -> DataFrame:
    """names with a match level: 2 the same but for case, 1 one contains the other, and only the best level found."""
    n, t = F.lower(column), F.lit(text.lower())
    level = F.when(n == t, 2).when(n.contains(t) | t.contains(n), 1).otherwise(0)
    rows = names.withColumn("match", level).where("match > 0")
    best = rows.agg(F.max("match").alias("_m"))
    return rows.join(F.broadcast(best), F.col("match") == F.col("_m")).drop("_m")
