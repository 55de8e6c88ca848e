"""Fixed schemas and the label catalogue (data model of the engine)."""

from __future__ import annotations

from pyspark.sql import types as T

ACHIEVEMENTS = T.StructType(
    [
        T.StructField("num_achievements_attained", T.LongType()),
        T.StructField("num_achievements_possible", T.LongType()),
        T.StructField("num_achievements_percentage", T.DoubleType()),
    ]
)

#: One fetched review per JSON line. Whole numbers in double fields are read as doubles.
RAW_REVIEW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("review", "review_url", "profile_url", "orig_url", "steam_id_number", "username", "rating", "date_posted", "date_updated")]
    + [T.StructField(n, T.DoubleType()) for n in ("total_game_hours", "total_game_hours_last_two_weeks", "found_helpful_percentage")]
    + [
        T.StructField(n, T.LongType())
        for n in (
            "num_found_helpful", "num_found_unhelpful", "num_voted_helpfulness", "num_found_funny", "num_comments", "num_friends",
            "num_groups", "num_badges", "friend_player_level", "num_games_owned", "num_reviews", "num_guides", "num_screenshots",
            "num_workshop_items",
        )
    ]
    + [T.StructField("achievement_progress", ACHIEVEMENTS)]
)

# The label names and their groups.
TIME_LABELS = ("total_game_hours", "total_game_hours_bin", "total_game_hours_last_two_weeks")
FRIENDS_LABELS = ("num_friends", "friend_player_level")
HELPFUL_LABELS = ("num_voted_helpfulness", "num_found_helpful", "found_helpful_percentage", "num_found_unhelpful")
ACHIEVEMENTS_LABELS = ("num_achievements_percentage", "num_achievements_attained", "num_achievements_possible")
OTHER_LABELS = (
    "num_guides", "num_games_owned", "num_groups", "num_workshop_items", "num_reviews", "num_found_funny", "num_badges",
    "num_screenshots", "num_comments",
)
GROUPS = (TIME_LABELS, FRIENDS_LABELS, HELPFUL_LABELS, ACHIEVEMENTS_LABELS)
LABELS = tuple(sorted(TIME_LABELS + FRIENDS_LABELS + HELPFUL_LABELS + ACHIEVEMENTS_LABELS + OTHER_LABELS))
PERCENTAGE_LABELS = ("num_achievements_percentage", "found_helpful_percentage")
NESTED = "achievement_progress"

PARTITIONS = ("training", "test", "extra")
PARTITION_ALIASES = {"train": "training"}


def partition_key(name: str) -> str:
    """One vocabulary for partitions: training, test, extra or all; ``train`` is training."""
    key = PARTITION_ALIASES.get(name.strip().lower(), name.strip().lower())
    if key not in (*PARTITIONS, "all"):
        raise ValueError(f"unknown partition: {name!r}")
    return key


def label_group(label: str) -> tuple[str, ...]:
    """The labels that must not be features when ``label`` is predicted (itself if ungrouped)."""
    return next((g for g in GROUPS if label in g), (label,))
