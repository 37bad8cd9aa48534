"""Configuration tables and fixed values.

Fixed values: the strings below must equal those of the data format the
library reads and writes (scenario names, feature names, markers, chat
template tokens, stop words, relation names).  They are listed plainly, in
their natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Scenario names, in declaration order (scenario index 0..4).
SCENARIOS = [
    "Cold-Start Browser",
    "Cold-Start Task-Oriented",
    "History-Only Explorer",
    "History + Hint Seeker",
    "Fully Expressive Seeker",
]

# Feature lists per scenario: (history features or None, target features or None).
SCENARIO_FEATURES = {
    "Cold-Start Browser": (None, ["Genres", "Keywords"]),
    "Cold-Start Task-Oriented": (
        None,
        ["Genres", "Keywords", "Actors", "Directors", "Overview", "Collection", "Visual Caption"],
    ),
    "History-Only Explorer": (["Genres", "Keywords"], []),
    "History + Hint Seeker": (["Genres", "Keywords"], ["Genres", "Keywords"]),
    "Fully Expressive Seeker": (
        ["Genres", "Keywords", "Actors", "Directors", "Overview", "Review", "Collection", "Visual Caption"],
        ["Genres", "Keywords", "Actors", "Directors", "Overview", "Review", "Collection", "Visual Caption"],
    ),
}

# Order in which feature lines are printed for one item.
FEATURE_LINE_ORDER = ["Genres", "Keywords", "Actors", "Directors", "Collection", "Overview", "Visual Caption", "Review"]

# Crew departments kept in the catalogue.
CREW_DEPARTMENTS = ["Directing", "Sound", "Production"]

# Dialogue markers of generated text.
USER_MARKERS = ["[USR]", "[USR]:"]
AI_MARKERS = ["[AI]", "[AI]:"]

# Chat template tokens (header / footer of each message).
BEGIN_OF_TEXT = "<|begin_of_text|>"
START_HEADER = "<|start_header_id|>"
END_HEADER = "<|end_header_id|>"
END_OF_TURN = "<|eot_id|>"
# Boilerplate a chat template puts at the top of the system message.
SYSTEM_DATE_BOILERPLATE = "Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024"

# Token that marks an item recommended by the assistant.
SPECIAL_TOKEN = "<|reserved_special_token_10|>"

# Entity names never used for mention detection.
ENTITY_STOP_WORDS = ["about", "by", "of", "for"]

# Knowledge-graph relation dictionary (relation_id, relation_name).
RELATIONS = [
    (0, "has_acting"),
    (1, "has_genre"),
    (2, "has_keyword"),
    (3, "has_crew"),
    (4, "has_directing"),
    (5, "has_production"),
    (6, "has_art"),
    (7, "has_editing"),
    (8, "has_writing"),
    (9, "has_visual effects"),
    (10, "has_sound"),
    (11, "has_costume & make-up"),
    (12, "has_camera"),
    (13, "has_lighting"),
    (14, "has_creator"),
]

# Role names.
ROLE_TO_CHAT = {"AI": "assistant", "user": "user"}
ROLE_TO_TOOLKIT = {"user": "Seeker", "assistant": "Recommender"}
# ------------------------------------------------------------ end fixed values

# Our own short system prompts (the wording is ours; only the intent matches).
SYSTEM_PROMPTS = {
    "Cold-Start Browser": (
        "Write a dialogue between a user who browses without a clear goal and a recommender. "
        "Alternate [USR] and [AI] turns, 5 to 10 turns, refer to items by their <id_...> tag only, "
        "and let the recommender close by recommending the target item."
    ),
    "Cold-Start Task-Oriented": (
        "Write a dialogue between a user with a precise need and no history and a recommender. "
        "Alternate [USR] and [AI] turns, 5 to 10 turns, refer to items by their <id_...> tag only, "
        "and let the recommender close by recommending the target item."
    ),
    "History-Only Explorer": (
        "Write a dialogue between a user who talks about items seen before and a recommender. "
        "Alternate [USR] and [AI] turns, 5 to 10 turns, refer to items by their <id_...> tag only, "
        "and let the recommender close with a recommendation."
    ),
    "History + Hint Seeker": (
        "Write a dialogue between a user who mentions past items and gives hints and a recommender. "
        "Alternate [USR] and [AI] turns, 5 to 10 turns, refer to items by their <id_...> tag only, "
        "and let the recommender close by recommending the target item."
    ),
    "Fully Expressive Seeker": (
        "Write a dialogue between a user who explains tastes in detail and a recommender. "
        "Alternate [USR] and [AI] turns, 5 to 10 turns, refer to items by their <id_...> tag only, "
        "and let the recommender close by recommending the target item."
    ),
}

DIALOGUE_SYSTEM_PROMPT = (
    "You are a conversational recommender for movies and TV. Learn the user's tastes "
    "from the dialogue, ask when something is unclear, and suggest fitting titles."
)

SCENARIO_SCHEMA = T.StructType(
    [
        T.StructField("scenario_idx", T.IntegerType(), False),
        T.StructField("scenario", T.StringType(), False),
        T.StructField("system_prompt", T.StringType(), False),
        T.StructField("history", T.ArrayType(T.StringType()), True),
        T.StructField("target", T.ArrayType(T.StringType()), True),
    ]
)


def scenario_table(spark: SparkSession) -> DataFrame:
    """The five-row scenario configuration table (broadcast-sized by construction)."""
    rows = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip((i, name, SYSTEM_PROMPTS[name], *SCENARIO_FEATURES[name]), SCENARIO_SCHEMA, strict=True)])
        for i, name in enumerate(SCENARIOS)
    ]
    # literals: no Python worker, and a size that the optimizer knows
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def relations_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "relation_id int, relation_name string")

# ---------------------------------------------------------------- fixed values
# Prompt text pieces (the generator reads prompts in exactly this layout).
PROMPT_HISTORY_HEADER = "The user has interacted with the following items:\n"
PROMPT_LIKED_HEADER = "User liked the following items:\n"
PROMPT_DISLIKED_HEADER = "User disliked the following items:\n"
PROMPT_TARGET_HEADER = "\nConsider the following one the target item to recommend:\n"
# Feature name in the scenario table -> (catalogue column, line label).
FEATURE_COLUMNS = {
    "Genres": ("Genres", "Genres"),
    "Keywords": ("Keywords", "Keywords"),
    "Actors": ("Acting", "Actors"),
    "Directors": ("Directing", "Directors"),
    "Collection": ("Collection", "Collection"),
    "Overview": ("Overview", "Overview"),
    "Visual Caption": ("Visual Caption", "Visual Caption"),
}
# ------------------------------------------------------------ end fixed values
