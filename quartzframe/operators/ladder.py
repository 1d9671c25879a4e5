"""Self-play ladders over a match log: seq, match_id, slot, agent, reward, status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.plans import tables

START, K = 1500.0, 24.0
#: Statuses of a forfeit.
FORFEITS = ("TIMEOUT", "INVALID", "ERROR")


#: The hypothesis that follows from a recommendation.
FOLLOWS = {"scripted_sufficient": "weigh_rl_cost", "iterate_heuristic_or_search": "iterate_or_search", "weak_vs_random_fix_first": "fix_heuristic_first"}


def outcomes(log: DataFrame, forfeit_is_loss: bool = False) -> DataFrame:
    """log with outcome: unknown without a reward, loss below the best of the match, draw if tied for it, else win."""
    w = Window.partitionBy("match_id")
    best = F.max("reward").over(w)
    tied = F.count_if(F.col("reward") == F.col("_best")).over(w)
    forfeit = F.col("status").isin(*FORFEITS) if forfeit_is_loss else F.lit(False)
    out = F.when(forfeit, "loss").when(F.col("reward").isNull(), "unknown").when(F.col("reward") < F.col("_best"), "loss").when(F.col("_tied") > 1, "draw").otherwise("win")
    return log.withColumn("_best", best).withColumn("_tied", tied).withColumn("outcome", out).drop("_best", "_tied")


def rates(log: DataFrame) -> DataFrame:
    """agent, played, wins, draws, losses, invalid, win_rate (of decided), invalid_rate. Crashed matches count as played."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = outcomes(log).groupBy("agent").agg(F.count(F.lit(1)).alias("played"), n("win").alias("wins"), n("draw").alias("draws"), n("loss").alias("losses"), F.count_if(F.col("status").isin(*FORFEITS)).alias("invalid"))
    decided = F.col("wins") + F.col("draws") + F.col("losses")
    return out.withColumns({"win_rate": F.when(decided > 0, F.col("wins") / decided), "invalid_rate": F.col("invalid") / F.col("played")})


def recommendation(rates_: DataFrame) -> DataFrame:
    """Adds health and recommendation of each agent against its opponents."""
    healthy = F.col("invalid") == 0
    by_rate = F.when(F.col("win_rate").isNull(), "inconclusive").when(F.col("win_rate") >= 0.65, "scripted_sufficient").when(F.col("win_rate") >= 0.55, "iterate_heuristic_or_search").otherwise("weak_vs_random_fix_first")
    return rates_.withColumns({"health": F.when(healthy, "PASS").otherwise("FAIL"), "recommendation": F.when(healthy, by_rate).otherwise("fix_health_first")})


def win_matrix(log: DataFrame) -> DataFrame:
    """winner, loser, wins: pairs of one match in which one reward is greater. Players of a match are few."""
    a, b = log.alias("a"), log.alias("b")
    pairs = a.join(b, (F.col("a.match_id") == F.col("b.match_id")) & (F.col("a.reward") > F.col("b.reward")))
    return pairs.groupBy(F.col("a.agent").alias("winner"), F.col("b.agent").alias("loser")).agg(F.count(F.lit(1)).alias("wins")).where("winner <> loser")


def matchup_shares(log: DataFrame) -> DataFrame:
    """agent, opponent, wins, losses, share of every ordered pair that met with a winner."""
    m = win_matrix(log)
    both = m.select(F.col("winner").alias("agent"), F.col("loser").alias("opponent"), "wins", F.lit(0).alias("losses")).union(m.select("loser", "winner", F.lit(0), "wins"))
    sums = both.groupBy("agent", "opponent").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))
    return sums.withColumn("share", F.col("wins") / (F.col("wins") + F.col("losses")))


def profile(log: DataFrame) -> DataFrame:
    """agent, weakest and strongest opponent with their shares, and the hypotheses that follow, in order."""
    per = matchup_shares(log).groupBy("agent").agg(
        F.min_by("opponent", F.struct("share", "opponent")).alias("weakest"), F.min("share").alias("weakest_share"),
        F.max_by("opponent", F.struct("share", "opponent")).alias("strongest"), F.max("share").alias("strongest_share"),
    )
    joined = per.join(recommendation(rates(log)).select("agent", "invalid_rate", "recommendation"), "agent")
    then = F.create_map(*(F.lit(x) for pair in FOLLOWS.items() for x in pair))
    flags = F.array(F.when(F.col("invalid_rate") > 0, "fix_legality_first"), F.when(F.col("weakest_share") < 0.45, "target_weak_matchup"), F.try_element_at(then, F.col("recommendation")))
    found = F.filter(flags, lambda x: x.isNotNull())
    return joined.withColumn("hypotheses", F.when(F.size(found) == 0, "iterate").otherwise(F.array_join(found, ","))).drop("recommendation")


def elo(log: DataFrame, ladder: str | None = None, k: float = K, start: float = START) -> DataFrame:
    """[ladder,] agent, rating after all matches in order of seq: every pair of a match plays one update from the ratings
    that the earlier pairs left. A ladder is a sequence by nature: its games are sorted (which can spill) and read once
    by one task that holds its agents' ratings only; ladders run side by side."""
    key = F.col(ladder).cast("string") if ladder else F.lit("")
    rewarded = log.where("reward IS NOT NULL").groupBy(key.alias("ladder"), "match_id").agg(F.min("seq").alias("seq"), F.sort_array(F.collect_list(F.struct("slot", "agent", "reward"))).alias("players"))
    pairs = rewarded.select("ladder", "seq", "match_id", F.posexplode("players").alias("i", "a"), "players").select("ladder", "seq", "match_id", "i", "a", F.posexplode("players").alias("j", "b")).where("i < j AND a.agent <> b.agent")
    score = F.when(F.col("a.reward") > F.col("b.reward"), 1.0).when(F.col("a.reward") < F.col("b.reward"), 0.0).otherwise(0.5)
    games = pairs.select("ladder", "seq", "match_id", "i", "j", F.col("a.agent").alias("a"), F.col("b.agent").alias("b"), score.alias("s"))
    games = games.repartition("ladder").sortWithinPartitions("ladder", "seq", "match_id", "i", "j").select("ladder", "a", "b", "s")

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ratings = None, {}
        result = lambda: pd.DataFrame([(now, a, r) for a, r in ratings.items()], columns=["ladder", "agent", "rating"])
        for batch in batches:
            for name, a, b, s in zip(batch["ladder"], batch["a"], batch["b"], batch["s"], strict=True):
                if name != now:
                    yield result()
                    now, ratings = name, {}
                ra, rb = ratings.get(a, start), ratings.get(b, start)
                gain = k * (s - 1 / (1 + 10 ** ((rb - ra) / 400)))
                ratings[a], ratings[b] = ra + gain, rb - gain
        yield result()

    rated = games.mapInPandas(play, "ladder string, agent string, rating double").toDF("_of", "_rated", "rating")
    keys = [ladder] if ladder else []
    pool = log.select(*keys, key.alias("_ladder"), "agent").distinct()
    joined = pool.join(rated, F.col("_ladder").eqNullSafe(F.col("_of")) & (F.col("agent") == F.col("_rated")), "left")
    return joined.select(*(pool[c] for c in keys), "agent", F.coalesce("rating", F.lit(start)).alias("rating"))


def lineups(agents: DataFrame, matches: int, seed: int = 42) -> DataFrame:
    """seq, a, b: every pair of agents matches times, in hash order."""
    pairs = agents.select(F.col("agent").alias("a")).join(agents.select(F.col("agent").alias("b")), F.col("a") < F.col("b"))
    games = pairs.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(matches))).alias("n"))
    keyed = games.withColumn("h", tables.hash_key(F.concat_ws("|", "a", "b", F.col("n").cast("string")), seed))
    return tables.with_rank(keyed, [F.col("h")], "seq").select("seq", "a", "b")


def group_lineups(agents: DataFrame, matches: int, players: int, seed: int = 42) -> DataFrame:
    """seq, players (array): lineups of more than two, matches for each agent; without repeats if there are enough agents.
    The pool of a ladder is a handful of names."""
    pool = agents.agg(F.sort_array(F.collect_set("agent")).alias("pool"))
    games = pool.select("pool", F.explode(F.when(F.size("pool") > 0, F.sequence(F.lit(0), matches * F.size("pool") - 1)).otherwise(F.array().cast("array<int>"))).alias("seq"))
    drawn = lambda i, text: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("seq").cast("string"), i.cast("string"), text))
    shuffled = F.transform(F.array_sort(F.transform("pool", lambda a, i: F.struct(drawn(F.lit(0), a).alias("h"), a.alias("a")))), lambda x: x["a"])
    one = lambda i: F.get("pool", (F.conv(F.substring(drawn(i, F.lit("")), 1, 12), 16, 10).cast("long") % F.size("pool")).cast("int"))
    chosen = F.when(F.size("pool") >= players, F.slice(shuffled, 1, players)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(players)), one))
    return games.select(F.col("seq").cast("long").alias("seq"), chosen.alias("players"))
