"""Explicit schemas for every snapshot payload (never inferred).

Leaf numbers of player payloads and statistic values arrive as ints,
floats, strings with '%' or nulls, so they are read as strings and cast
leniently downstream.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, MapType, StringType, StructField,
                               StructType)

S, I, B = StringType(), IntegerType(), BooleanType()


def st(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


def arr(t) -> ArrayType:
    return ArrayType(t)


ID = st(id=I)

FIXTURES = st(response=arr(st(
    fixture=st(id=I, date=S, status=st(short=S), venue=ID),
    teams=st(home=ID, away=ID),
    league=st(round=S),
    goals=st(home=I, away=I))))

STANDING_ROW = st(team=ID, rank=I, points=I, goalsDiff=I, group=S,
                  all=st(played=I, win=I, draw=I, lose=I, goals=st(**{"for": I, "against": I})))
STANDINGS = st(response=arr(st(league=st(standings=arr(arr(STANDING_ROW))))))

EVENTS = st(parameters=st(fixture=S), response=arr(st(
    time=st(elapsed=I, extra=I), team=ID, player=ID, assist=ID, type=S, detail=S, comments=S)))

STATISTICS = st(response=arr(st(team=ID, statistics=arr(st(type=S, value=S)))))

PLAYER = st(id=I, name=S, firstname=S, lastname=S, birth=st(date=S, country=S), nationality=S,
            height=S, weight=S, photo=S)
PLAYER_STATS_BLOCK = st(
    team=ID, league=st(id=I, season=I),
    games=st(position=S, number=S, appearences=S, lineups=S, minutes=S),
    goals=st(total=S, assists=S, saves=S), dribbles=st(attempts=S, success=S), fouls=st(committed=S),
    tackles=st(total=S), passes=st(total=S, key=S, accuracy=S), cards=st(yellow=S, red=S))
PLAYER_DOC = st(response=arr(st(player=PLAYER, statistics=arr(PLAYER_STATS_BLOCK))),
                paging=st(current=I, total=I))
SQUAD = st(response=arr(st(players=arr(st(id=I, name=S, age=I, photo=S)))))
ROSTER = st(teams=MapType(S, arr(I)))

TEAMS = st(response=arr(st(team=st(id=I, name=S, country=S, logo=S),
                           venue=st(id=I, name=S, city=S, country=S, capacity=I))))

SEASON = st(year=I, start=S, end=S, current=B)
LEAGUE_ENTRY = st(league=st(id=I, name=S, logo=S), country=st(name=S), seasons=arr(SEASON))
LEAGUES = st(response=arr(LEAGUE_ENTRY))

NEWS = st(response=st(results=arr(st(id=S, webTitle=S, webPublicationDate=S, webUrl=S,
                                     fields=st(shortUrl=S, thumbnail=S, trailText=S)))))
NEWS_META = st(fetched_at_utc=S)
